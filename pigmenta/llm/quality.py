"""Statistics of a text's quality, and from them whether it is prose, a list, a table or junk.

Method: counts of words, symbols, line ends and common words, with *repetition statistics*
(shares of repeated lines and paragraphs, share of the text that its most frequent word, its most
frequent n-grams of 2 to 4 words and its repeated n-grams of 5 to 10 words cover); filler,
boilerplate and lists are separated from prose by combined rules on them. Page furniture is what
stands, but for its numbers, on many pages. All rules are about form and repetition; none knows a
vocabulary but the table of common words that is given to it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pigmenta.llm.words import fold

PROSE, LIST, TABLE, JUNK, TITLE, BLANK = "prose", "list", "table", "junk", "title", "blank"

_WORD = re.compile(r"[^\W_]+(?:['’.,][^\W_]+)*")
_ALNUM = re.compile(r"[^\W_]+")
_LETTERS = re.compile(r"[^\W\d_]+")
_SENTENCE_END = re.compile(r"[^\W_]{2,}[%°²\"'”’»)\]]*[.!?…]+[\"'”’»)\]]*(?=\s|$)")
_BULLET = re.compile(r"^\s*(?:[-–—*•‣◦▪»·○●]|\[[ xX✓]?\]|\(?\d{1,3}[.)]|\(?[^\W\d_][.)])\s+")
_TERMINAL = re.compile(r"[.!?…:;][\"'”’»)\]]*\s*$")
_CODE = re.compile(r"</?\w+[^>]*>|\bfunction\s*\(|[{};]\s*\w+\s*=|\bvar\s+\w+\s*=|\b\w+=[\w\"']+;")
_HEX = re.compile(r"\b[0-9a-f]{2}\b")
_LONG = re.compile(r"\S{36,}")
# What stands between the items of an enumeration that is run together.
ITEM_SEPARATORS = [" / ", " · ", "; ", " | ", ", ", " • ", " – ", " - ", " > ", " + ", " & ", " * "]


@dataclass
class Quality:
    """Statistics of one text; shares are of words, lines or characters as their names say."""

    words: int = 0
    mean_word_length: float = 0.0
    symbol_ratio: float = 0.0
    terminal_line_share: float = 0.0
    common_word_share: float = 0.0
    lines: int = 0
    repeated_line_share: float = 0.0
    repeated_paragraph_share: float = 0.0
    top_word_share: float = 0.0
    top_2gram_coverage: float = 0.0
    top_3gram_coverage: float = 0.0
    top_4gram_coverage: float = 0.0
    repeated_5gram_share: float = 0.0
    repeated_6gram_share: float = 0.0
    repeated_7gram_share: float = 0.0
    repeated_8gram_share: float = 0.0
    repeated_9gram_share: float = 0.0
    repeated_10gram_share: float = 0.0


# From which value on a text is filler: the most frequent word or n-gram (three times at least), and what is
# repeated of the lines, the paragraphs and the longer n-grams; what stands there twice isn't yet. None depends on
# the length of the text.
FILLER = {
    "top_word_share": 0.5, "top_2gram_coverage": 0.55, "top_3gram_coverage": 0.5, "top_4gram_coverage": 0.45, "repeated_line_share": 0.66, "repeated_paragraph_share": 0.66,
    "repeated_5gram_share": 0.66, "repeated_6gram_share": 0.65, "repeated_7gram_share": 0.64, "repeated_8gram_share": 0.63, "repeated_9gram_share": 0.62, "repeated_10gram_share": 0.61,
}
# Of an enumeration: an item may come again.
FILLER_LIST = {"top_word_share": 0.5, "repeated_line_share": 0.8}
LEAST_WORDS = 5  # of filler


def _repeated(parts: list[str]) -> float:
    return 1 - len(set(parts)) / len(parts) if parts else 0.0


def _repetition(q: Quality, words: list[str]) -> None:
    """Sets the n-gram statistics, from short n-grams on; where none is repeated no longer one is."""
    n = len(words)
    q.top_word_share = max(Counter(words).values()) / n
    starts = range(n - 1)
    for size in range(2, 11):
        counts = Counter(zip(*(words[i:] for i in range(size)), strict=False))
        if len(counts) == len(starts):
            return
        if size <= 4:
            gram, times = counts.most_common(1)[0]
            if times >= 3:
                setattr(q, f"top_{size}gram_coverage", min(1.0, times * sum(map(len, gram)) / sum(map(len, words))))
        else:
            seen: set[tuple[str, ...]] = set()
            covered = [False] * n
            for i in starts:
                gram = tuple(words[i : i + size])
                if gram in seen:
                    covered[i : i + size] = [True] * size
                seen.add(gram)
            setattr(q, f"repeated_{size}gram_share", sum(covered) / n)
        starts = range(n - size)


def measure(text: str, common: frozenset[str]) -> Quality:
    """The statistics of ``text``. A text without words has zeros where there is nothing to divide."""
    words = _WORD.findall(text)
    folded = _WORD.findall(fold(text))
    lines = [x.strip() for x in text.split("\n") if x.strip()]
    solid = "".join(text.split())
    q = Quality(words=len(words), lines=len(lines))
    if solid:
        q.symbol_ratio = len(_ALNUM.sub("", solid)) / len(solid)
    if lines:
        q.terminal_line_share = sum(bool(_TERMINAL.search(x)) for x in lines) / len(lines)
        q.repeated_line_share = _repeated(lines)
        if len(lines) > 1:
            q.repeated_paragraph_share = _repeated([" ".join(p.split()) for p in re.split(r"\n\s*\n", text) if p.strip()])
    if words:
        n = len(words)
        q.mean_word_length = sum(map(len, words)) / n
        q.common_word_share = sum(w in common for w in folded) / max(1, len(folded))
        if folded:
            _repetition(q, folded)
    return q


def _columns(lines: list[str]) -> bool:
    """Whether the lines are rows of cells: as many of one separator in nearly each."""
    if len(lines) < 2:
        return False
    for cells in (r"\s*[|│¦]\s*", r"\t+", r"\s*;\s*", r"\s{3,}", r"\s*\.{4,}\s*", r"\s*_{4,}\s*", r"\s*,\s*"):
        rows = [[c for c in re.split(cells, x.strip().strip("|│¦")) if c] for x in lines]
        counts = Counter(len(r) for r in rows)
        usual, times = counts.most_common(1)[0]
        # A row may have lost the gap after a long first cell, an empty cell, or be the heading.
        if usual >= 2 and times >= 0.5 * len(lines) and sum(n >= 2 for n in map(len, rows)) >= 0.8 * len(lines):
            short = [len(_WORD.findall(c)) for r in rows for c in r]
            if sum(short) / len(short) <= (3.5 if cells != r"\s*,\s*" else 2.0):
                return True
    return False


def _greedily_wrapped(lines: list[str]) -> bool:
    """Whether lines are as full as a width of 25 or more allows: none had room for the next one's first word."""
    if len(lines) < 2:
        return False
    width = max(map(len, lines))
    return width >= 25 and all(len(a) + 1 + len(b.split()[0]) > width for a, b in zip(lines, lines[1:], strict=False))


def _items_run_together(text: str) -> bool:
    body = re.sub(r"^\s*[^:.!?\n]{2,40}:\s+", "", text)
    for separator in ITEM_SEPARATORS:
        items = [x for x in body.split(separator) if x.strip()]
        if len(items) < 5 if body != text else len(items) < 6:
            continue
        sizes = [len(_WORD.findall(x)) for x in items]
        if sum(sizes) / len(sizes) <= 3.5 and max(sizes) <= 8 and len(_SENTENCE_END.findall(body)) <= 1:
            return True
    return False


def filler(q: Quality, limits: dict[str, float]) -> bool:
    """Whether a text says little but the same again."""
    return q.words >= LEAST_WORDS and any(getattr(q, name) >= least for name, least in limits.items())


def _enumeration(lines: list[str], q: Quality, sentences: int) -> str | None:
    """LIST if the lines are an enumeration of items that are no sentences, PROSE if bulleted sentences, else None."""
    sizes = [len(_WORD.findall(_BULLET.sub("", x))) for x in lines]
    if len(lines) >= 2 and sum(bool(_BULLET.match(x)) for x in lines) >= 0.7 * len(lines):
        return LIST if sorted(sizes)[len(sizes) // 2] <= 7 and sum(sizes) / len(sizes) <= 7.5 else PROSE
    if _items_run_together(" ".join(lines)):
        return LIST
    if len(lines) >= 3 and max(sizes) <= 8 and sum(sizes) / len(sizes) <= 5 and not _greedily_wrapped([x.strip() for x in lines]):
        ended = sum(bool(_SENTENCE_END.search(x)) for x in lines)
        if q.common_word_share < 0.06 or (ended == 0 and sentences == 0):
            return LIST
    return None


def classify(text: str, q: Quality, font_size: int | None = None, larger_than: float | None = None, furniture: bool = False) -> str:
    """prose, list, table, junk, title or blank, by rules on form; ``q`` are the text's statistics.

    ``larger_than`` is the size from which on a one-line text is a title; ``furniture`` says that
    its like stands on many pages.
    """
    stripped = text.strip()
    if not stripped:
        return BLANK
    lines = [x for x in stripped.split("\n") if x.strip()]
    solid = "".join(stripped.split())
    words = _LETTERS.findall(stripped)
    letters = sum(map(len, words)) / len(solid)
    sentences = len(_SENTENCE_END.findall(stripped))
    mean = sum(map(len, words)) / len(words) if words else 0.0
    if _columns(lines) and not (sentences >= 2 and q.common_word_share > 0.05):
        return TABLE
    markup = sum(len(m.group()) for m in _CODE.finditer(stripped)) / len(stripped)
    encoded = sum(len(m.group()) for m in _LONG.finditer(stripped)) / len(stripped)
    hexes = sum(2 for _ in _HEX.finditer(stripped)) / len(solid)
    if (
        not words
        or (letters < 0.5 and q.symbol_ratio > 0.3)
        or (mean < 2.2 and q.symbol_ratio > 0.15)
        or markup > 0.3
        or encoded > 0.5
        or hexes > 0.5
    ):
        return JUNK
    listed = _enumeration(lines, q, sentences)
    if filler(q, FILLER_LIST if listed == LIST else FILLER):
        return JUNK
    if len(lines) == 1 and font_size is not None and larger_than is not None and font_size > larger_than and len(stripped) <= 120:
        return TITLE
    if furniture and len(lines) == 1 and len(words) <= 14 and sentences == 0 and q.symbol_ratio > 0.05:
        return JUNK
    if listed:
        return listed
    if len(lines) == 1 and len(words) <= 6 and sentences == 0:
        return TITLE
    return PROSE


STATISTICS = ", ".join(f"{name} {'int' if isinstance(default, int) else 'double'}" for name, default in asdict(Quality()).items())


def furniture_shapes(blocks: DataFrame, *, share: float = 0.001, least: int = 3) -> DataFrame:
    """shape: what short lines with numbers are alike but for these, if they stand on that share of all pages.

    ``blocks``: source, page, shape. Pages are counted by partial aggregation. A shape stands on a
    thousandth of the pages, so there are no more of them than a thousand times the lines that a
    page has on average, whatever the number of blocks.
    """
    on_page = blocks.select("source", "page", "shape").distinct()
    pages = blocks.select("source", "page").distinct().count()
    return on_page.filter("shape is not null").groupBy("shape").agg(F.count("*").alias("pages")).filter(F.col("pages") >= max(float(least), share * pages)).select("shape")


def shape_of(text: F.Column) -> F.Column:
    """One line of at most 120 characters that has a digit and is no sentence, with each word that has one masked; else null."""
    line = F.trim(text)
    short = (F.char_length(line) <= 120) & ~line.contains("\n") & line.rlike(r"\p{Nd}") & ~line.rlike(r"\p{L}{2}[.!?…]$")
    return F.when(short, F.regexp_replace(F.regexp_replace(F.lower(line), r"[^\s]*\p{Nd}[^\s]*", "0"), r"\s+", " "))


def text_quality(blocks: DataFrame, common_words: DataFrame, *, title_size: float = 11.5) -> DataFrame:
    """block_id, the statistics and kind of every block (block_id, text, font_size, source, page).

    ``common_words``: word, a table of a fixed size for each language; sent to the tasks. A null
    text gives null statistics and the kind ``blank``, as an empty one gives zeros. Rows are
    neither dropped nor shuffled: only the shapes of short lines with numbers are counted, by
    page, and the frequent ones sent along. Where there is no source or page, none is furniture.
    """
    common = frozenset(fold(r["word"]) for r in common_words.select("word").distinct().collect() if r["word"])
    key = dict(blocks.dtypes)["block_id"]
    rows = blocks.select("block_id", "text", "font_size", *[c for c in ("source", "page") if c in blocks.columns])
    if "source" in rows.columns and "page" in rows.columns:
        shaped = rows.withColumn("shape", shape_of(F.col("text")))
        often = furniture_shapes(shaped).withColumn("furniture", F.lit(True))
        rows = shaped.join(F.broadcast(often), "shape", "left").withColumn("furniture", F.coalesce("furniture", F.lit(False)))
    else:
        rows = rows.withColumn("furniture", F.lit(False))

    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = list(Quality.__dataclass_fields__)
        for part in parts:
            out = []
            for block_id, text, size, furniture in zip(part["block_id"], part["text"], part["font_size"], part["furniture"], strict=True):
                if text is None:
                    out.append((block_id, *[None] * len(names), BLANK))
                    continue
                q = measure(text, common)
                out.append((block_id, *[getattr(q, x) for x in names], classify(text, q, None if pd.isna(size) else size, title_size, furniture)))
            yield pd.DataFrame(out, columns=["block_id", *names, "kind"], dtype=object)

    return rows.select("block_id", "text", "font_size", "furniture").mapInPandas(batches, f"block_id {key}, {STATISTICS}, kind string")


def not_prose(qualities: DataFrame) -> DataFrame:
    """block_id, kind of the blocks that are a list, a table or junk."""
    return qualities.filter(qualities["kind"].isin(LIST, TABLE, JUNK)).select("block_id", "kind").distinct()
