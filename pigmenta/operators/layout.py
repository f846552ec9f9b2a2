"""Layout: from positioned words to text in reading order, and from text to sections."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pigmenta.functions.text import strip
from pigmenta.session import totals_before

BOLD_FLAG = 16
BULLETS = "•-*‣◦"
SENTENCE_END = ".:;!?"


def font_sizes(spans: DataFrame) -> DataFrame:
    """doc_id, page, seq, size (one decimal), chars of the spans that are not blank."""
    return spans.filter(strip(F.col("text")) != "").select("doc_id", "page", "seq", F.bround("size", 1).alias("size"), F.char_length(strip(F.col("text"))).alias("chars"))


def body_size(rows: DataFrame, per: str, size: str, weight: Column, order: list[str], default: float = 10.0) -> DataFrame:
    """The most frequent size of each group by weight; of equals the one seen first; a default for groups without sizes."""
    first = F.min(F.struct(*order))
    sums = rows.filter(F.col(size).isNotNull()).groupBy(per, size).agg(F.sum(weight).alias("w"), first.alias("first"))
    most = sums.groupBy(per).agg(F.max("w").alias("w"))
    best = sums.join(most, [per, "w"]).groupBy(per).agg(F.min_by(size, "first").alias("body_size"))
    return rows.select(per).distinct().join(best, per, "left").withColumn("body_size", F.coalesce(F.col("body_size").cast("double"), F.lit(default)))


def span_styles(spans: DataFrame) -> DataFrame:
    """Spans with ``is_bold`` read off their flags."""
    return spans.withColumn("is_bold", F.col("flags").bitwiseAND(BOLD_FLAG) != 0)


def overlap_ratio(a: str, b: str) -> Column:
    """Share of box ``a`` that box ``b`` covers; 0 where they don't meet. Boxes are structs x0, y0, x1, y1."""
    side = lambda lo, hi: F.least(F.col(f"{a}.{hi}"), F.col(f"{b}.{hi}")) - F.greatest(F.col(f"{a}.{lo}"), F.col(f"{b}.{lo}"))
    width, height = side("x0", "x1"), side("y0", "y1")
    area = F.greatest(F.col(f"{a}.x1") - F.col(f"{a}.x0"), F.lit(1e-6)) * F.greatest(F.col(f"{a}.y1") - F.col(f"{a}.y0"), F.lit(1e-6))
    return F.when((width <= 0) | (height <= 0), 0.0).otherwise(width * height / area)


def styled_words(words: DataFrame, spans: DataFrame, default_size: float = 10.0, least: float = 0.5) -> DataFrame:
    """Words with the size and boldness of the span that covers them most, the first of equals.

    Joined by document and page; a word that no span covers by half is of the default style.
    """
    box = lambda: F.struct("x0", "y0", "x1", "y1")
    left = words.select("doc_id", "page", F.col("seq"), "text", box().alias("wb"))
    right = span_styles(spans).select("doc_id", "page", F.col("seq").alias("span_seq"), "size", "is_bold", box().alias("sb"))
    pairs = left.join(right, ["doc_id", "page"], "left").withColumn("ratio", F.when(F.col("sb").isNotNull(), overlap_ratio("wb", "sb")))
    best = pairs.groupBy("doc_id", "page", "seq").agg(F.first("text").alias("text"), F.first("wb").alias("box"), F.max("ratio").alias("ratio"), F.max_by(F.struct("size", "is_bold"), F.struct("ratio", -F.col("span_seq"))).alias("style"))
    good = F.coalesce(F.col("ratio") >= least, F.lit(False))
    return best.select(
        "doc_id", "page", "seq", F.col("box.x0"), F.col("box.y0"), F.col("box.x1"), F.col("box.y1"), "text",
        F.when(good, F.col("style.size")).otherwise(default_size).alias("size"), F.when(good, F.col("style.is_bold")).otherwise(False).alias("is_bold"),
    )


def without_near_duplicates(words: DataFrame, per: list[str], least: float = 0.6) -> DataFrame:
    """Words without those that repeat a kept earlier word of the same text in nearly the same box.

    Greedy in order of ``seq`` among equal words of a page, so a chain of drifting copies keeps
    one word wherever the overlap with the last kept one ends.
    """
    box = F.struct("seq", F.struct("x0", "y0", "x1", "y1").alias("b"))
    grouped = words.groupBy(*per, "text").agg(F.sort_array(F.collect_list(box)).alias("boxes"))

    @F.pandas_udf("array<int>")
    def kept(groups: pd.Series) -> pd.Series:
        def one(boxes: list) -> list[int]:
            keep: list[dict] = []
            for x in boxes:
                if not any(_covers(x["b"], k["b"]) >= least and _covers(k["b"], x["b"]) >= least for k in keep):
                    keep.append(x)
            return [int(k["seq"]) for k in keep]

        return pd.Series([one(g) for g in groups], dtype=object)

    ids = grouped.select(*per, "text", F.explode(kept("boxes")).alias("seq"))
    return words.join(ids, [*per, "text", "seq"], "left_semi")


def _covers(a: dict, b: dict) -> float:
    w = min(a["x1"], b["x1"]) - max(a["x0"], b["x0"])
    h = min(a["y1"], b["y1"]) - max(a["y0"], b["y0"])
    return w * h / (max(a["x1"] - a["x0"], 1e-6) * max(a["y1"] - a["y0"], 1e-6)) if w > 0 and h > 0 else 0.0


def gaps(intervals: DataFrame, per: list[str], low: str, high: str, least: float) -> DataFrame:
    """Free stretches between the merged intervals of each group that are longer than ``least``: gap_start, gap_end."""
    before = Window.partitionBy(*per).orderBy(low, high).rowsBetween(Window.unboundedPreceding, -1)
    reach = intervals.withColumn("gap_start", F.max(high).over(before))
    return reach.filter(F.col(low) - F.col("gap_start") > least).select(*per, "gap_start", F.col(low).alias("gap_end")).distinct()


# Reading order of one page, from its words.


@dataclass
class Line:
    text: str
    x0: float
    y0: float
    x1: float
    y1: float
    bold_ratio: float = 0.0
    size: float = 10.0
    margin: float = 0.0
    prefix: str | None = None
    rest: str | None = None
    heading: bool = False


COLUMN, ROW = "col", "row"


def bold_prefix(words: list[dict], most_words: int = 8, most_chars: int = 60) -> tuple[str, str] | None:
    """A run of bold words at a line's start that ends with a colon, and what follows it."""
    run = 0
    while run < len(words) and words[run]["is_bold"]:
        run += 1
    head = " ".join(w["text"] for w in words[:run])
    tail = " ".join(w["text"] for w in words[run:])
    return (head, tail) if 0 < run <= most_words and len(head) <= most_chars and head.endswith(":") and tail.strip() else None


def rows_of(words: list[dict], tolerance: float) -> list[list[dict]]:
    """Words by rows: each joins the first row whose top is within the tolerance. Tops are met in
    order, so rows that lie too far above are never looked at again."""
    tops: list[float] = []
    rows: list[list[dict]] = []
    first = 0
    for w in sorted(words, key=lambda w: (w["y0"], w["x0"])):
        while first < len(tops) and w["y0"] - tops[first] > tolerance:
            first += 1
        if first < len(tops):
            rows[first].append(w)
        else:
            tops.append(w["y0"])
            rows.append([w])
    return rows


def lines_of(words: list[dict], tolerance: float = 2.5) -> list[Line]:
    """Lines from words: a word joins the first line whose top is within the tolerance."""
    out = []
    for row in rows_of(words, tolerance):
        row.sort(key=lambda w: w["x0"])
        sizes = Counter(round(w["size"], 1) for w in row)
        split = bold_prefix(row)
        out.append(Line(
            " ".join(w["text"] for w in row), min(w["x0"] for w in row), min(w["y0"] for w in row), max(w["x1"] for w in row), max(w["y1"] for w in row),
            sum(w["is_bold"] for w in row) / len(row), sizes.most_common(1)[0][0], prefix=split[0] if split else None, rest=split[1] if split else None,
        ))
    return out


def free_stretches(spans: list[tuple[float, float]], least: float) -> list[tuple[float, float]]:
    """What is free between intervals for more than ``least``."""
    out, reach = [], None
    for a, b in sorted(spans):
        if reach is not None and a - reach > least:
            out.append((reach, a))
        reach = b if reach is None else max(reach, b)
    return out


def cut_page(words: list[dict], gap_x: float = 5.0, gap_y: float = 3.0, tolerance: float = 2.5, depth: int = 0) -> list[Line | str]:
    """Lines of a page in reading order, by recursive cuts at the widest free column, else row.

    Column gaps must be wider where few or tall lines make them unlikely; between parts stands
    ``col`` or ``row``. A part without cuts gives its lines, with the usual left edge as margin.
    """
    if not words:
        return []
    top, bottom = min(w["y0"] for w in words), max(w["y1"] for w in words)
    tall = max(w["y1"] - w["y0"] for w in words)
    need = max(gap_x, 0.8 * tall) if bottom - top > 200 or len(rows_of(words, tolerance)) <= 2 else max(gap_x / 2, 2.0)
    if depth < 10:
        for axis, (lo, hi), least, mark in (("x", ("x0", "x1"), need, COLUMN), ("y", ("y0", "y1"), gap_y, ROW)):
            free = free_stretches([(w[lo], w[hi]) for w in words], least)
            edge_lo, edge_hi = min(w[lo] for w in words) + 1, max(w[hi] for w in words) - 1
            free = [g for g in free if g[0] > edge_lo and g[1] < edge_hi]
            if free:
                a, b = max(free, key=lambda g: g[1] - g[0])
                middle = (a + b) / 2
                first = [w for w in words if w[hi] <= middle]
                second = [w for w in words if w[hi] > middle]
                if first and second:
                    return [*cut_page(first, gap_x, gap_y, tolerance, depth + 1), mark, *cut_page(second, gap_x, gap_y, tolerance, depth + 1)]
    lines = lines_of(words, tolerance)
    margin = Counter(round(x.x0) for x in lines).most_common(1)[0][0]
    for x in lines:
        x.margin = float(margin)
    return list(lines)


# What speaks for a heading and against it, and the limits of each.
WEIGHTS = {"bold": 3, "not_bold": -2, "larger": 2, "at_margin": 2, "new_paragraph": 2, "colon": 2, "capitals": 1, "after_space": 1, "mid_sentence": -3, "mixed_bold": -2}
HEADING_SCORE = 6
BOLD_SHARE, LONGEST_HEADING, MARGIN_TOLERANCE, GAP_SIZES = 0.6, 50, 3.0, 1.6


def _heading_score(x: Line, before: Line | None, after_break: bool, body: float, ratio: float) -> int:
    """The score of one line, given the line before it and whether a break lies between."""
    bold, at_margin, colon = x.bold_ratio >= BOLD_SHARE, abs(x.x0 - x.margin) <= MARGIN_TOLERANCE, x.text.rstrip().endswith(":")
    space = after_break or (before is not None and x.y0 - before.y1 > GAP_SIZES * before.size)
    ended = before is not None and before.text.rstrip()[-1:] in SENTENCE_END
    starts = space or ended or before is None
    goes_on = before is not None and (wrap_hyphen(before.text, x.text) or (before.heading and bold and at_margin and not ended))
    facts = {
        "bold": bold, "not_bold": not bold, "larger": x.size >= ratio * body, "at_margin": at_margin, "new_paragraph": starts, "colon": colon, "capitals": x.text.isupper(),
        "after_space": space, "mid_sentence": not starts and not goes_on, "mixed_bold": 0 < x.bold_ratio < 1 and not (at_margin and colon),
    }
    return sum(WEIGHTS[k] for k, holds in facts.items() if holds)


def mark_headings(items: list[Line | str], body: float, ratio: float = 1.1, threshold: int = HEADING_SCORE) -> None:
    """Sets ``heading`` on the lines that score enough, in order, each seeing what came before it.

    A line without a letter or without a word of three characters is none; one with a bold prefix
    is one whatever its length; others have 50 characters at most.
    """
    before: Line | None = None
    after_break = True
    for x in items:
        if isinstance(x, str):
            after_break = True
            continue
        if not x.text.strip():
            continue
        worded = any(len(t) >= 3 and any(c.isalpha() for c in t) for t in x.text.replace(":", " ").split())
        short = len(x.text.strip()) <= LONGEST_HEADING
        x.heading = worded and (x.prefix is not None or (short and _heading_score(x, before, after_break, body, ratio) >= threshold))
        before, after_break = x, False


def wrap_hyphen(a: str, b: str) -> bool:
    """Whether a line ends with a letter and a hyphen and the next one goes on in lower case."""
    return bool(re.search(r"[^\W\d_]-\s*$", a)) and b.lstrip()[:1].islower()


def wrap_joined(a: str, b: str) -> str:
    """Two lines of one text: glued over a hyphen between letters if the second begins in lower case."""
    if wrap_hyphen(a, b):
        return re.sub(r"-\s*$", "", a) + b.lstrip()
    return f"{a} {b}"


def merge_headings(items: list[Line | str]) -> list[Line | str]:
    """Headings that are one: side by side across a column break on one baseline, or wrapped over two lines."""
    across: list[Line | str] = []
    for x in items:
        last = across[-2] if len(across) >= 2 and across[-1] == COLUMN else None
        if isinstance(x, Line) and isinstance(last, Line) and x.heading and last.heading and abs(x.y0 - last.y0) <= 3 and 0 <= x.x0 - last.x1 <= x.size:
            last.text, last.x1 = f"{last.text} {x.text}", x.x1
            across.pop()
        else:
            across.append(x)
    out: list[Line | str] = []
    merged: set[int] = set()
    for x in across:
        last = out[-1] if out else None
        if isinstance(x, Line) and isinstance(last, Line) and x.heading and last.heading and id(last) not in merged and last.prefix is None and last.text.rstrip()[-1:] not in SENTENCE_END:
            last.text = wrap_joined(last.text, x.text)
            last.prefix, last.rest, last.y1 = (wrap_joined(last.text.removesuffix(x.text), x.prefix) if x.prefix else None), x.rest, x.y1
            merged.add(id(last))
        else:
            out.append(x)
    return out


def assemble(items: list[Line | str]) -> str:
    """Text of a page: headings after "## ", bullets on lines of their own, a blank line at a
    column break, other lines joined to what they continue."""
    out: list[str] = []
    open_line = False
    for x in items:
        if isinstance(x, str):
            if x == COLUMN and out and out[-1] != "":
                out.append("")
            open_line = False
        elif x.heading:
            out.append("## " + (x.prefix or x.text))
            open_line = False
            if x.rest:
                out.append(x.rest)
                open_line = x.rest.rstrip()[-1:] not in SENTENCE_END
        elif x.text.lstrip()[:1] in BULLETS and x.text.strip():
            out.append(x.text)
            open_line = x.text.rstrip()[-1:] not in SENTENCE_END
        else:
            if open_line:
                out[-1] = wrap_joined(out[-1], x.text)
            else:
                out.append(x.text)
            open_line = x.text.rstrip()[-1:] not in SENTENCE_END
    return "\n".join(out)


def page_texts(words: DataFrame, bodies: DataFrame, *, gap_x: float = 5.0, gap_y: float = 3.0, tolerance: float = 2.5, ratio: float = 1.1, threshold: int = HEADING_SCORE) -> DataFrame:
    """doc_id, page, text of each page in reading order, from its styled words; a page is one group."""
    word = F.struct("seq", "x0", "y0", "x1", "y1", "text", "size", "is_bold")
    # By a stated number of tasks: pages are much work for few bytes, by which tasks would be merged.
    tasks = max(words.sparkSession.sparkContext.defaultParallelism, int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    apart = words.join(bodies.select("doc_id", "body_size"), "doc_id").repartition(tasks, "doc_id", "page")
    grouped = apart.groupBy("doc_id", "page").agg(F.collect_list(word).alias("words"), F.max("body_size").alias("body_size"))

    @F.pandas_udf("string")
    def read(pages: pd.Series, sizes: pd.Series) -> pd.Series:
        out = []
        for page, body in zip(pages, sizes, strict=True):
            items = cut_page(sorted(page, key=lambda w: w["seq"]), gap_x, gap_y, tolerance)
            mark_headings(items, float(body), ratio, threshold)
            out.append(assemble(merge_headings(items)))
        return pd.Series(out, dtype=object)

    return grouped.select("doc_id", "page", read("words", "body_size").alias("text"))


# Whole documents.


def without_boilerplate(pages: DataFrame, doc: str, page: str, *, least_pages: int = 4, share: float = 0.8, longest: int = 120) -> DataFrame:
    """Lines of pages (doc, page, line_no, line) without those that stand on most pages of a document.

    Documents of fewer than ``least_pages`` pages keep all lines.
    """
    lines = pages.select(doc, page, F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    count = pages.groupBy(doc).agg(F.count_distinct(page).alias("pages"))
    key = strip(F.col("line"))
    frequency = lines.filter((key != "") & (F.char_length(key) <= longest)).groupBy(doc, key.alias("key")).agg(F.count_distinct(page).alias("on"))
    often = frequency.join(count, doc).filter((F.col("pages") >= least_pages) & (F.col("on") >= F.greatest(F.lit(2), F.floor(F.col("pages") * F.lit(share))))).select(doc, "key")
    return lines.withColumn("key", key).join(often, [doc, "key"], "left_anti").drop("key")


SECTION = "struct<heading:string,body:string>"


def page_sections(pages: DataFrame) -> DataFrame:
    """Adds ``parts``, array<struct<heading, body>>: the "## " headings of each page, by array expressions alone.

    Text before the first heading is left out. Of equal headings all have the body of the last.
    A heading without a body is joined with the next one, whatever that has; the last of a page
    stays as it is. A null text has null parts.
    """
    pieces = F.split(F.concat(F.lit("\n"), "text"), "\n## ", -1)
    section = lambda p: F.struct(strip(F.regexp_extract(p, r"^[^\n]*", 0)).alias("heading"), strip(F.regexp_replace(p, r"^[^\n]*", "")).alias("body"))
    cut = pages.withColumn("_cut", F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), section))
    last_body = lambda x: F.element_at(F.filter("_cut", lambda y: y["heading"] == x["heading"]), -1)["body"]
    distinct = F.size(F.array_distinct(F.transform("_cut", lambda x: x["heading"]))) == F.size("_cut")
    once = F.when(distinct, F.col("_cut")).otherwise(F.transform("_cut", lambda x: F.struct(x["heading"].alias("heading"), last_body(x).alias("body"))))
    cut = cut.withColumn("_cut", once).withColumn("_cut", F.transform("_cut", lambda x, i: F.struct(x["heading"].alias("heading"), x["body"].alias("body"), (i == F.size("_cut") - 1).alias("last"))))
    state = f"struct<out:array<{SECTION}>,held:string>"

    def fold(acc: Column, x: Column) -> Column:
        add = lambda heading: F.struct(F.concat(acc["out"], F.array(F.struct(heading.alias("heading"), x["body"].alias("body")))).alias("out"), F.lit(None).cast("string").alias("held")).cast(state)
        hold = F.struct(acc["out"].alias("out"), x["heading"].alias("held")).cast(state)
        return F.when(acc["held"].isNotNull(), add(strip(F.concat(acc["held"], F.lit(" "), x["heading"])))).when((x["body"] == "") & ~x["last"], hold).otherwise(add(x["heading"]))

    start = F.struct(F.array().cast(f"array<{SECTION}>").alias("out"), F.lit(None).cast("string").alias("held")).cast(state)
    return cut.withColumn("parts", F.aggregate("_cut", start, fold)["out"]).drop("_cut")


def sections(pages: DataFrame, doc: str, order: list[str]) -> DataFrame:
    """Sections of a document, page by page: doc, section_no, heading, body.

    See :func:`page_sections`; of equal headings of a document the last stands, at the place of the first.
    """
    each = page_sections(pages.select(doc, *order, "text")).select(doc, *order, F.posexplode("parts").alias("pos", "x"))
    place = F.struct(*order, "pos")
    once = each.groupBy(doc, F.col("x.heading").alias("heading")).agg(F.max_by("x.body", place).alias("body"), F.min(place).alias("first"))
    return totals_before(once.select(doc, "heading", "body", "first", F.lit(1).alias("n")), [doc], ["first"], ["n"]).select(doc, F.col("n_before").alias("section_no"), "heading", "body")


def font_sections(blocks: DataFrame, doc: str, order: list[str], *, factor: float = 1.15) -> DataFrame:
    """Sections of layout blocks (with body_size): a block in a larger font starts one; doc, section_no, heading, text.

    Blocks before the first heading make a section without one; of headings in a row the last
    counts; a heading without text makes none.
    """
    marked = blocks.withColumn("is_heading", F.coalesce(F.col("font_size") > factor * F.col("body_size"), F.lit(False)))
    counts = totals_before(marked.select(doc, *order, F.col("is_heading").cast("int").alias("n")), [doc], order, ["n"])
    numbered = marked.join(counts.select(doc, *order, (F.col("n_before") + F.col("n")).alias("section_no")), [doc, *order])
    part = F.when(~F.col("is_heading"), F.struct(*order, F.regexp_replace(strip(F.col("text")), "\n", " ").alias("t")))
    parts = F.transform(F.sort_array(F.collect_list(part)), lambda x: x["t"])
    return (
        numbered.groupBy(doc, "section_no")
        .agg(F.max(F.when(F.col("is_heading"), strip(F.col("text")))).alias("heading"), F.array_join(parts, " ").alias("text"))
        .filter("text <> ''")
    )


def noise_tenths(text: Column) -> Column:
    """How much a block looks like noise, in tenths: no full stop 3, short lines 3, many special
    characters 2, long words 2; 10 for a blank text."""
    stripped = strip(text)
    lines = F.size(F.split(stripped, "\n"))
    chars = F.char_length(stripped)
    special = F.char_length(F.regexp_replace(stripped, r"(?U)[\p{L}\p{N}_\s.,;:!?()'\"%-]", ""))
    words = F.size(F.filter(F.split(stripped, r"(?U)\s+"), lambda x: x != ""))
    points = (
        F.when(~stripped.rlike(r"[.!?]$"), 3).otherwise(0)
        + F.when((chars / lines < 25) & (chars < 150), 3).otherwise(0)
        + F.when(special / chars > 0.03, 2).otherwise(0)
        + F.when(chars / words > 12, 2).otherwise(0)
    )
    return F.when(stripped == "", 10).otherwise(F.least(points, F.lit(10)))


def without_noise(blocks: DataFrame, *, threshold: int = 5, small: float = 0.92, exempt_headings: bool = False, factor: float = 1.15) -> DataFrame:
    """Blocks (with body_size) that are neither small print nor noise.

    Headings are judged like others and mostly lost, unless ``exempt_headings``.
    """
    noisy = (noise_tenths(F.col("text")) >= threshold) | F.coalesce(F.col("font_size") < small * F.col("body_size"), F.lit(False))
    if exempt_headings:
        noisy = noisy & ~F.coalesce(F.col("font_size") > factor * F.col("body_size"), F.lit(False))
    return blocks.filter(~noisy)
