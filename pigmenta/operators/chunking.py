"""Chunking: sliding, parent-child, recursive, structural and semantic."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pigmenta.functions.text import sentences, strip
from pigmenta.functions.vectors import cosine_distance
from pigmenta.session import apart, totals_before


def sliding_pieces(text: Column, size: int, overlap: int) -> Column:
    """Pieces of ``size`` characters every ``size - overlap``, stripped, blank ones dropped."""
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be less than the size")
    starts = F.when(F.char_length(text) > 0, F.sequence(F.lit(0), F.char_length(text) - 1, F.lit(size - overlap)))
    return F.filter(F.transform(starts, lambda i: strip(F.substring(text, i + 1, F.lit(size)))), lambda p: p != "")


def parent_child(pages: DataFrame, parent_size: int = 1024, parent_overlap: int = 128, child_size: int = 256, child_overlap: int = 32) -> DataFrame:
    """Children of the parents of each page: source, page_number, page_id, parent_no, parent_id,
    parent_text, child_no, child_id, chunk_index, chunk_length, text.

    ``pages``: source, page_number, page_id (unique), text. Parents are cut from a page and counted over
    the pages of a source in order of page number and id; children are cut from the stripped
    parent and counted over the source; ``chunk_index`` is the place within the parent.
    """
    parents = sliding_pieces(F.col("text"), parent_size, parent_overlap)
    # Pieces are cut once: a struct column that nothing above it can be folded into.
    cut = pages.select("source", "page_number", "page_id", F.explode(F.array(parents)).alias("parents")).filter(F.size("parents") > 0)
    cut = cut.select("source", "page_number", "page_id", F.explode(F.array(F.transform("parents", lambda p: F.struct(p.alias("parent_text"), sliding_pieces(p, child_size, child_overlap).alias("nested"))))).alias("cut"))
    # Counters over a source come from counts of its pages, which are narrow.
    counts = cut.select("source", "page_number", "page_id", F.size("cut").alias("p"), F.aggregate("cut", F.lit(0), lambda n, c: n + F.size(c["nested"])).alias("c"))
    offsets = totals_before(counts, ["source"], ["page_number", "page_id"], ["p", "c"]).select("page_id", "p_before", "c_before")
    starts = F.aggregate("cut", F.array(F.lit(0)), lambda n, c: F.concat(n, F.array(F.element_at(n, -1) + F.size(c["nested"]))))
    placed = cut.join(offsets, "page_id").withColumn("starts", starts)
    each = placed.select("source", "page_number", "page_id", "p_before", "c_before", "starts", F.posexplode("cut").alias("pos", "x"))
    children = each.select(
        "source",
        "page_number",
        "page_id",
        (F.col("p_before") + F.col("pos")).alias("parent_no"),
        F.col("x.parent_text").alias("parent_text"),
        (F.col("c_before") + F.get("starts", F.col("pos"))).alias("first"),
        F.posexplode("x.nested").alias("chunk_index", "text"),
    )
    return numbered_ids(children.withColumn("child_no", F.col("first") + F.col("chunk_index")).drop("first").withColumn("chunk_length", F.char_length("text")))


def numbered_ids(chunks: DataFrame) -> DataFrame:
    """Adds parent_id and child_id: the source without its suffix, and the number of the parent or child in it."""
    stem = F.regexp_replace("source", r"\.[^.]+$", "")
    return chunks.withColumns({"parent_id": F.concat(stem, F.lit("_parent_"), F.col("parent_no")), "child_id": F.concat(stem, F.lit("_child_"), F.col("child_no"))})


def page_driver(pages: DataFrame, pieces: Column) -> DataFrame:
    """Chunks of each page with ids that tell page, place on it and place in the source: source,
    page_number, page_id, chunk_no, chunk_id ("p<page>_c<place>_<number in the source>"), text.

    ``pages``: source, page_number, page_id (unique) and what ``pieces``, an array of texts, is made
    of; pages of a source are counted in order of page number and id. An unknown page is page 0.
    """
    cut = pages.select("source", "page_number", "page_id", F.explode(F.array(pieces)).alias("pieces")).filter(F.size("pieces") > 0)
    counts = cut.select("source", "page_number", "page_id", F.size("pieces").alias("n"))
    before = totals_before(counts, ["source"], ["page_number", "page_id"], ["n"]).select("page_id", "n_before")
    each = cut.join(before, "page_id").select("source", "page_number", "page_id", "n_before", F.posexplode("pieces").alias("chunk_no", "text"))
    number = F.concat(F.lit("p"), F.coalesce("page_number", F.lit(0)), F.lit("_c"), "chunk_no", F.lit("_"), F.col("n_before") + F.col("chunk_no"))
    return each.select("source", "page_number", "page_id", "chunk_no", number.alias("chunk_id"), "text")


def keep_first(df: DataFrame, key: Column, order: list[Column | str]) -> DataFrame:
    """The first row of each key by an explicit order; null keys are one key."""
    return df.withColumn("_key", key).withColumn("_r", F.row_number().over(Window.partitionBy("_key").orderBy(*order))).filter("_r = 1").drop("_key", "_r")


def keep_first_in_place(df: DataFrame, key: Column, order: list[Column | str]) -> DataFrame:
    """As :func:`keep_first`, for keys of which few stand more than once: only rows of those move."""
    single, several = apart(df, key)
    return single if several is None else single.unionByName(keep_first(several, key, order))


def split_recursively(text: str, size: int, overlap: int, separators: tuple[str, ...] = ("\n\n", "\n", ". ", " ", "")) -> list[str]:
    """Pieces of at most ``size`` characters, cut at the first separator that serves.

    Separators stay at the start of the piece they precede; splits are merged greedily and a
    piece begins with as much of the last one as ``overlap`` allows. A part that is still too
    long is cut at the next separator; the empty one cuts between any two characters.
    """

    def merge(parts: list[str]) -> list[str]:
        out: list[str] = []
        held: list[str] = []
        length = 0
        for part in parts:
            if held and length + len(part) > size:
                out.append("".join(held))
                while held and (length > overlap or length + len(part) > size):
                    length -= len(held.pop(0))
            held.append(part)
            length += len(part)
        return [*out, "".join(held)] if held else out

    at = next((i for i, s in enumerate(separators) if not s or s in text), len(separators) - 1)
    separator = separators[at]
    cut = list(text) if not separator else [p for p in re.split(f"(?={re.escape(separator)})", text) if p]
    out: list[str] = []
    fitting: list[str] = []
    for part in cut:
        if len(part) <= size:
            fitting.append(part)
            continue
        out += merge(fitting)
        fitting = []
        out += split_recursively(part, size, overlap, separators[at + 1 :]) if at + 1 < len(separators) else [part]
    out += merge(fitting)
    return [p for p in (x.strip() for x in out) if p]


def recursive_pieces(size: int, overlap: int) -> object:
    """A vectorised function from a text to its recursively split pieces; null gives null."""

    @F.pandas_udf("array<string>")
    def split(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([None if t is None else split_recursively(t, size, overlap) for t in texts], dtype=object)

    return split


def structural_parent_child(sections: DataFrame, parent_size: int = 2000, parent_overlap: int = 100, child_size: int = 300, child_overlap: int = 30, *, dedupe: bool = True) -> DataFrame:
    """Parents and children of sections (doc_id, section_no, heading, text), none across a heading.

    Ids are counted per document before equal contents are dropped, so they may have gaps.
    """
    cut = sections.select("doc_id", "section_no", "heading", recursive_pieces(parent_size, parent_overlap)("text").alias("parents"))
    sizes = cut.select("doc_id", "section_no", F.size("parents").alias("n"))
    offsets = totals_before(sizes, ["doc_id"], ["section_no"], ["n"]).select("doc_id", "section_no", "n_before")
    parents = cut.join(offsets, ["doc_id", "section_no"]).select("doc_id", "heading", "n_before", F.posexplode("parents").alias("pos", "parent_text"))
    nested = parents.select("doc_id", "heading", (F.col("n_before") + F.col("pos")).alias("parent_no"), "parent_text", recursive_pieces(child_size, child_overlap)("parent_text").alias("nested"))
    inner = totals_before(nested.select("doc_id", "parent_no", F.size("nested").alias("n")), ["doc_id"], ["parent_no"], ["n"]).select("doc_id", "parent_no", "n_before")
    children = nested.join(inner, ["doc_id", "parent_no"]).select("doc_id", "parent_no", "heading", "parent_text", "n_before", F.posexplode("nested").alias("child_pos", "content"))
    children = children.withColumn("child_no", F.col("n_before") + F.col("child_pos")).select(
        "doc_id", F.concat(F.lit("p"), "parent_no").alias("parent_id"), F.concat(F.lit("c"), "child_no").alias("child_id"), "child_no", "heading", "content", "parent_text"
    )
    return keep_first(children, F.struct("doc_id", "content"), ["child_no"]) if dedupe else children


def sentence_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row a sentence of ``text``: the keys, sentence_no, sentence."""
    return df.select(*keys, F.posexplode(sentences(F.col("text"))).alias("sentence_no", "sentence"))


def neighbourhoods(df: DataFrame, keys: list[str], text: str, order: str, buffer: int = 1) -> DataFrame:
    """Adds ``neighbourhood``: each text with ``buffer`` texts before and after it in its group."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-buffer, buffer)
    return df.withColumn("neighbourhood", F.array_join(F.collect_list(text).over(w), " "))


def semantic_groups(df: DataFrame, keys: list[str], vector: str, order: str, percentile: float = 0.9) -> DataFrame:
    """Adds distance (to the next row of the group) and group_no.

    A group ends where the distance is above the group's percentile, which is interpolated;
    distances are rounded to 9 decimals before the strict comparison.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    following = F.lead(vector).over(w)
    measured = df.withColumn("distance", F.when(following.isNotNull(), F.round(cosine_distance(F.col(vector), following), 9)))
    limit = F.round(F.percentile("distance", F.lit(percentile)).over(Window.partitionBy(*keys)), 9)
    broken = measured.withColumn("is_break", F.coalesce(F.col("distance") > limit, F.lit(False)))
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    return broken.withColumn("group_no", F.coalesce(F.sum(F.col("is_break").cast("int")).over(before), F.lit(0)))


def constrain_sizes(pieces: list[str], least: int = 200, most: int = 1800, overlap: int = 100, boundaries: list[bool] | None = None, *, strict_tail: bool = False) -> list[str]:
    """Pieces merged until they have ``least`` characters; longer ones than ``most`` slide-cut.

    Where ``boundaries`` says that a piece starts a part, what is held is given out first. The
    last remainder joins the piece before it, across a boundary too unless ``strict_tail``.
    """
    merged: list[str] = []
    held, crossed = "", False
    for i, piece in enumerate(pieces):
        if boundaries and boundaries[i] and held:
            merged.append(held)
            held, crossed = "", True
        held = f"{held} {piece}".strip() if held else piece
        if len(held) >= least:
            merged.append(held)
            held, crossed = "", False
    if held:
        if merged and not (strict_tail and crossed):
            merged[-1] = f"{merged[-1]} {held}"
        else:
            merged.append(held)
    out: list[str] = []
    for piece in merged:
        if len(piece) <= most:
            out.append(piece)
        else:
            step = most - overlap
            out += [p for p in (piece[i : i + most].strip() for i in range(0, len(piece), step)) if p]
    return out


def merge_short(pieces: list[str], least_words: int = 15) -> list[str]:
    """Fragments of fewer words join the piece before; the first may stay short."""
    out: list[str] = []
    for p in pieces:
        if out and len(p.split()) < least_words:
            out[-1] = f"{out[-1]} {p}"
        else:
            out.append(p)
    return out


# Fixed value: a line that starts a part: marked, numbered with two digits at most, or in capitals of ASCII.
HEADING = r"^\s*(#{1,6}\s+.+|\d{1,2}(\.\d{1,2})*\.?\s+[A-Z].{0,80}|[A-Z][A-Z\s\-:]{4,80})\s*$"


def structural_units(df: DataFrame, keys: list[str]) -> DataFrame:
    """Units between blank lines: the keys, unit_no, unit, is_heading (of its first line)."""
    units = F.filter(F.transform(F.split("text", r"\n\s*\n"), strip), lambda u: u != "")
    cut = df.select(*keys, F.posexplode(units).alias("unit_no", "unit"))
    return cut.withColumn("is_heading", strip(F.regexp_extract("unit", r"^[^\n]*", 0)).rlike("(?U)" + HEADING))


def semantic_chunks(rows: DataFrame, keys: list[str], text: str, vector: str, order: str, *, percentile: float = 0.9, least: int = 200, most: int = 1800, overlap: int = 100) -> DataFrame:
    """Semantic groups of ordered, embedded texts, joined and brought to size: keys, chunk_no, text.

    The group a key makes is one document's, so it is folded in one piece.
    """
    grouped = semantic_groups(rows, keys, vector, order, percentile)
    joined = grouped.groupBy(*keys, "group_no").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, text))), lambda x: x[text]), " ").alias("piece"))
    listed = joined.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("group_no", "piece"))), lambda x: x["piece"]).alias("pieces"))

    @F.pandas_udf("array<string>")
    def bring_to_size(pieces: pd.Series) -> pd.Series:
        return pd.Series([constrain_sizes(list(p), least, most, overlap) for p in pieces], dtype=object)

    return listed.select(*keys, F.posexplode(bring_to_size("pieces")).alias("chunk_no", "text"))
