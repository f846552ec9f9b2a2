"""Find documents that are mostly repeated keywords, links or tags rather than sentences.

Method: thresholds on top-word and n-gram shares, duplicate-line share, link-text ratio, separator
density and missing function words, *calibrated per language*. The shares of a document (its most
frequent word, its most frequent n-grams of 2 to 4 words, its repeated lines) are compared with
what is usual in its language, counted over all documents; the function words are those that fill
the language's long sentences, whatever these are about. Where a share is far above the usual,
the words and lines that make it so are stuffing; so are lines of links and lists of tags. A
document is spam if stuffing makes up more than half of its characters.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pigmenta.llm.words import fold

_LINK = re.compile(
    r"<a\b[^>]*>.*?</a>|<[^<>]{1,200}>|\[[^\]\n]*\]\(\s*\S+?\s*\)|(?:https?|ftp)://\S+|\bwww\.\S+|\b[\w-]+(?:\.[\w-]+)*\.[a-z]{2,10}(?:/\S*)?(?=[\s)>\]]|$)",
    re.IGNORECASE,
)
_MAYBE_LINK = re.compile(r"[<(]|\w[.:][\w/]")
_HASHTAG = re.compile(r"#\w+")
_WORD = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")
_SPLIT = re.compile(r"(?<=[.!?…])\s+|\n+")
_CODE = re.compile(r"\b[A-Z]{2,5}[-_]?\d{2,}\b")
_MARKS = re.compile(r"[,.!?…;:]+(?=\s|$)")
_ENDED = re.compile(r"[.!?…][\"'”’»)\]]*$")

# What stands between tags in a list of them.
SEPARATORS = ["/", "|", "·", "•", ";", ",", "»", ">", "→", "–", "\t"]
_SPACED = {s: re.compile(rf"\s*{re.escape(s)}\s+|\s+{re.escape(s)}\s*" if s != "\t" else r"\t+") for s in SEPARATORS}
_LEAD = re.compile(r"^\s*[^\W\d][\w ]{1,30}:\s+")

ALL = "all"


@dataclass
class StuffingLimits:
    """Thresholds on segments and documents."""

    share: float = 0.5  # of the characters; more than that is spam
    tag_words: float = 3.6  # words a tag has on average, at most
    tags: int = 5  # tags that make a list, at least
    fragment_words: int = 7  # a fragment has as many words at most
    ended_fragment_words: int = 5  # and this many if it ends like a sentence
    link_words: int = 8  # words around each link of a link line, at most
    repeated: int = 3  # times a fragment without function words occurs to count as repeated
    repeated_line: int = 4  # and any line
    least_words: int = 16  # of a text whose shares say anything
    times_usual: float = 4.0  # a share of as many times the usual one is dominance
    least_share: tuple[float, ...] = (0.12, 0.16, 0.22, 0.28, 0.5, 0.35)  # but no less than this, in the order of SHARES
    most_share: tuple[float, ...] = (0.25, 0.3, 0.4, 0.5, 0.75, 0.6)  # and this is enough, whatever is usual
    phrase_words: int = 8  # words between marks; a segment that has more at a stretch is a sentence or run together
    dominated: float = 0.33  # of a segment's words in dominant words and n-grams
    dominated_long: float = 0.5  # and of a segment with a long stretch,
    distinct_long: float = 0.6  # of whose words no more are distinct
    sentence_words: int = 8  # a long sentence has as many words at least
    function_words: int = 40  # taken of each language


SHARES = ("top_word", "top_2gram", "top_3gram", "top_4gram", "repeated_2grams", "repeated_lines")


@dataclass
class Calibration:
    """What is usual in each language, ``all`` included: function words, and the shares of documents that repeat anything."""

    function_words: dict[str, frozenset[str]] = field(default_factory=dict)
    usual: dict[str, dict[str, float]] = field(default_factory=dict)

    def of(self, lang: str, limits: StuffingLimits) -> tuple[frozenset[str], tuple[float, ...]]:
        """The function words of a language and, for each of SHARES, from which value on it is dominance."""
        everywhere = self.usual.get(ALL, {})
        usual = [self.usual.get(lang, {}).get(x, everywhere.get(x, 0.0)) for x in SHARES]
        bounds = tuple(min(most, max(least, limits.times_usual * u)) for u, least, most in zip(usual, limits.least_share, limits.most_share, strict=True))
        return self.function_words.get(lang, frozenset()) | self.function_words.get(ALL, frozenset()), bounds


def language(lang: str | None) -> str:
    """The label of a language in one form; missing and undetermined ones are ``all``."""
    label = (lang or "").strip().lower()[:2]
    return ALL if label in ("", "un", "al") else label


def gram_counts(words: list[str]) -> list[Counter]:
    """Counts of the n-grams of 1 to 4 words; none longer where no shorter one comes three times."""
    out = [Counter(words)]
    for size in range(2, 5):
        if max(out[-1].values(), default=0) < 3:
            break
        out.append(Counter(zip(*(words[i:] for i in range(size)), strict=False)))
    return out


def in_grams(words: list[str], grams: set, size: int) -> list[bool]:
    """Which words are in one of these n-grams of ``size`` words."""
    marked = [False] * len(words)
    for at, gram in enumerate(words if size == 1 else zip(*(words[j:] for j in range(size)), strict=False)):
        if gram in grams:
            marked[at : at + size] = [True] * size
    return marked


def shares_of(words: list[str], lines: Counter) -> dict[str, float]:
    """SHARES of a document, without those that are 0: of its words in the most frequent word or n-gram (three times
    at least) and in all 2-grams that come more than three times, of its lines in repeated ones."""
    n, counts = len(words), gram_counts(words)
    out = {x: times * (i + 1) / n for i, (x, c) in enumerate(zip(SHARES, counts, strict=False)) if (times := max(c.values(), default=0)) >= 3}
    if "top_2gram" in out:
        out["repeated_2grams"] = sum(in_grams(words, {g for g, times in counts[1].items() if times > 3}, 2)) / n
    total = sum(lines.values())
    return out | ({"repeated_lines": 1 - len(lines) / total} if len(lines) < total else {})


def dominant_words(words: list[str], function_words: frozenset[str], bounds: tuple[float, ...]) -> list[bool]:
    """Which words are in a word or n-gram that dominates the document (a function word alone doesn't), or in
    any 2-gram that comes more than three times, where these together dominate it."""
    n = len(words)
    marked = [False] * n
    for i, counts in enumerate(gram_counts(words)):
        often = {g for g, times in counts.items() if times >= 3 and times * (i + 1) >= bounds[i] * n and not (i == 0 and g in function_words)}
        if often:
            marked = [a or b for a, b in zip(marked, in_grams(words, often, i + 1), strict=True)]
        if i == 1 and any(times > 3 for times in counts.values()):
            again = in_grams(words, {g for g, times in counts.items() if times > 3}, 2)
            if sum(again) >= bounds[4] * n:
                marked = [a or b for a, b in zip(marked, again, strict=True)]
    return marked


def _tag_list(segment: str, limits: StuffingLimits) -> bool:
    body = _LEAD.sub("", segment)
    for separator, spaced in _SPACED.items():
        if body.count(separator) < limits.tags - 1:
            continue
        items = [x for x in spaced.split(body) if x.strip()]
        if len(items) >= limits.tags:
            sizes = sorted(len(_WORD.findall(x)) for x in items)
            if sum(sizes) / len(sizes) <= limits.tag_words and sizes[len(sizes) * 9 // 10] <= 6:
                return True
    return False


def segments_of(text: str) -> list[str]:
    return [s for s in _SPLIT.split(text) if s and not s.isspace()]


def stuffing(text: str, function_words: frozenset[str], bounds: tuple[float, ...], limits: StuffingLimits) -> dict[str, float]:
    """Shares of a text's characters by what they are: links, tags, keywords; and their sum as ``stuffed``."""
    segments = segments_of(text)
    sizes = [len("".join(s.split())) for s in segments]
    total = sum(sizes)
    out = {"links": 0.0, "tags": 0.0, "keywords": 0.0, "stuffed": 0.0}
    if not total:
        return out
    worded = [_WORD.findall(fold(s)) for s in segments]
    lines = Counter(" ".join(w) for w in worded)
    whole = [w for ws in worded for w in ws]
    marked = dominant_words(whole, function_words, bounds) if len(whole) >= limits.least_words else [False] * len(whole)
    repetitive = 1 - len(lines) / len(worded) >= bounds[5]
    at = 0
    for segment, size, words in zip(segments, sizes, worded, strict=True):
        dull = sum(marked[at : at + len(words)])
        at += len(words)
        links = [m.group() for m in _LINK.finditer(segment)] if _MAYBE_LINK.search(segment) else []
        if links:
            around = _WORD.findall(_LINK.sub(" ", segment))
            linked = sum(len("".join(x.split())) for x in links)
            if linked >= 0.5 * size or (
                len(around) <= limits.link_words * len(links) and (not _ENDED.search(segment.rstrip()) or not any(fold(w) in function_words for w in around))
            ):
                out["links"] += size
                continue
        tags = _HASHTAG.findall(segment)
        if tags and sum(map(len, tags)) >= 0.5 * size:
            out["tags"] += size
            continue
        if not links and (_tag_list(segment, limits) or len(_CODE.findall(segment)) >= max(3, 0.3 * len(words))):
            out["tags"] += size
            continue
        if not words:
            continue
        functional = sum(w in function_words for w in words)
        times = lines[" ".join(words)]
        longest = max(len(_WORD.findall(x)) for x in _MARKS.split(segment)) if dull else 0
        if longest > limits.phrase_words:
            stuffed = dull >= limits.dominated_long * len(words) and len(set(words)) <= limits.distinct_long * len(words)
        else:
            stuffed = dull > limits.dominated * len(words)
        if stuffed or (repetitive and times >= limits.repeated_line):
            out["keywords"] += size
        elif times >= limits.repeated and functional == 0 and len(words) <= (limits.ended_fragment_words if _ENDED.search(segment.rstrip()) else limits.fragment_words):
            out["keywords"] += size
        elif functional <= 0.02 * len(words) and len(words) >= 3 * limits.sentence_words and not _ENDED.search(segment.rstrip()):
            out["tags"] += size
    out = {k: v / total for k, v in out.items()}
    out["stuffed"] = out["links"] + out["tags"] + out["keywords"]
    return out


def calibrate(documents: DataFrame, limits: StuffingLimits | None = None) -> Calibration:
    """What is usual in each language, over all documents (text, lang).

    Tasks send counts: words of long sentences by language, and histograms of the shares of documents.
    """
    limits = limits or StuffingLimits()

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()

        def rows() -> pd.DataFrame:
            return pd.DataFrame([(*k, n) for k, n in counts.items()], columns=["what", "lang", "value", "n"], dtype=object)

        for part in parts:
            for text, lang in zip(part["text"], part["lang"], strict=True):
                labels = {language(lang), ALL}
                whole: list[str] = []
                lines: Counter = Counter()
                for s in segments_of(text):
                    folded = _WORD.findall(fold(s))
                    whole += folded
                    lines[" ".join(folded)] += 1
                    if len(folded) >= limits.sentence_words and _ENDED.search(s.rstrip()):
                        for w in {fold(w) for w in _WORD.findall(s) if w.islower()}:
                            for label in labels:
                                counts["word", label, w] += 1
                if len(whole) >= limits.least_words:
                    for name, share in shares_of(whole, lines).items():
                        for label in labels:
                            counts[name, label, f"{share:.2f}"] += 1
            if len(counts) > 200_000:
                yield rows()
                counts.clear()
        yield rows()

    counted = documents.select("text", "lang").filter("text is not null").mapInPandas(count, "what string, lang string, value string, n long")
    sums = counted.groupBy("what", "lang", "value").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("what", "lang").orderBy(F.desc("n"), "value")
    # At most 40 words and 101 values of each share a label; labels have two letters.
    rows = sums.withColumn("r", F.row_number().over(order)).filter((F.col("what") != "word") | (F.col("r") <= limits.function_words)).collect()
    out = Calibration()
    for label in {r["lang"] for r in rows}:
        out.function_words[label] = frozenset(r["value"] for r in rows if r["lang"] == label and r["what"] == "word")
        for name in SHARES:
            shares = sorted((float(r["value"]), r["n"]) for r in rows if r["lang"] == label and r["what"] == name)
            half, seen = sum(n for _, n in shares) / 2, 0
            for value, n in shares:
                seen += n
                if seen >= half:
                    out.usual.setdefault(label, {})[name] = value
                    break
    return out


def stuffed_shares(documents: DataFrame, limits: StuffingLimits | None = None) -> DataFrame:
    """doc_id, links, tags, keywords, stuffed for every document (doc_id, text, lang).

    Shares are of the characters that are not white space. Null and blank texts have shares of 0.
    Rows are neither joined nor dropped nor shuffled.
    """
    limits = limits or StuffingLimits()
    usual = calibrate(documents, limits)
    key = dict(documents.dtypes)["doc_id"]

    def judge(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [stuffing(text or "", *usual.of(language(lang), limits), limits) for text, lang in zip(part["text"], part["lang"], strict=True)]
            yield pd.DataFrame(rows, columns=["links", "tags", "keywords", "stuffed"], dtype=float).assign(doc_id=part["doc_id"].to_numpy())[["doc_id", "links", "tags", "keywords", "stuffed"]]

    return documents.select("doc_id", "text", "lang").mapInPandas(judge, f"doc_id {key}, links double, tags double, keywords double, stuffed double")


def spam_documents(documents: DataFrame, limits: StuffingLimits | None = None) -> DataFrame:
    """Distinct doc_id of the documents of which more than half is stuffing."""
    limits = limits or StuffingLimits()
    return stuffed_shares(documents, limits).filter(F.col("stuffed") > limits.share).select("doc_id").distinct()
