"""Cut texts that are longer than a limit into pieces under it, at natural boundaries, with overlap.

Method: *sparse-table range-maximum index over boundary strengths*. Every place where a text may
be cut has a strength (paragraph, line, sentence, word); the index answers which cut is the
strongest in the window of permitted lengths, the rightmost of equals. From the cut one steps
back by the overlap to the next clean start.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What ends a word here, and what ends a sentence.
SPACES = " \t\r\n"
SENTENCE_MARKS = ".!?…。！？؟"
CLOSERS = "\"'”’»)]"

FORCED, WORD, SENTENCE, LINE, PARAGRAPH = range(5)
KINDS = ["forced", "word", "sentence", "line", "paragraph"]
LAST = "end"


def boundary_strengths(text: str) -> np.ndarray:
    """Strength of a cut before each code point (0 where there is none), and one more for the end.

    A cut is where a word has ended: the character before it is no white space and the one after
    it is. Its strength depends on the white space that follows and on the mark before.
    """
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    n = len(codes)
    space = np.isin(codes, [ord(c) for c in SPACES])
    strength = np.zeros(n + 1, dtype=np.int8)
    if not n:
        return strength
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    if not len(ends):
        return strength
    solid = np.flatnonzero(~space)
    after = np.searchsorted(solid, ends)
    gap_end = np.where(after < len(solid), solid[np.minimum(after, len(solid) - 1)], n)
    feeds = np.concatenate([[0], np.cumsum((codes == 10) | ((codes == 13) & (np.append(codes[1:], 0) != 10)))])
    lines = feeds[gap_end] - feeds[ends]
    last = ends - 1
    closing = np.isin(codes[last], [ord(c) for c in CLOSERS]) & (last > 0)
    mark = np.isin(codes[np.where(closing, last - 1, last)], [ord(c) for c in SENTENCE_MARKS])
    strength[ends] = np.where(lines > 1, PARAGRAPH, np.where(lines == 1, LINE, np.where(mark, SENTENCE, WORD)))
    return strength


class RangeMaximum:
    """Sparse table: the strongest place of any window in constant time, the rightmost of equals."""

    def __init__(self, strength: np.ndarray, longest: int) -> None:
        self.base = len(strength) + 1
        self.levels = [strength.astype(np.int64) * self.base + np.arange(len(strength))]
        width = 1
        while 2 * width <= min(longest, len(strength)):
            row = self.levels[-1]
            self.levels.append(np.maximum(row[:-width], row[width:]))
            width *= 2

    def strongest(self, first: int, last: int) -> tuple[int, int]:
        """(strength, place) over first..last, both included."""
        level = (last - first + 1).bit_length() - 1
        row = self.levels[level]
        best = int(max(row[first], row[last + 1 - (1 << level)]))
        return divmod(best, self.base)


class StretchMaximum:
    """Range maximum for windows that move on: the table is built over a stretch of a few windows at a time,
    so it takes no more memory for a long text than for one of four windows."""

    def __init__(self, strength: np.ndarray, longest: int) -> None:
        self.strength, self.longest, self.first, self.last = strength, longest, 0, -1

    def strongest(self, first: int, last: int) -> tuple[int, int]:
        """(strength, place) over first..last, both included."""
        if first < self.first or last > self.last:
            self.first, self.last = first, min(len(self.strength) - 1, first + 4 * self.longest)
            self.index = RangeMaximum(self.strength[self.first : self.last + 1], self.longest)
        force, at = self.index.strongest(first - self.first, last - self.first)
        return force, at + self.first


def plan_cuts(text: str, limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """(start, end, strength of the cut at the end) of each piece of ``text``; offsets in code points.

    A piece has ``limit`` code points at most. Windows first ask for the strongest cut in the
    upper half of the permitted lengths; if there is none, in all of them; if the next start
    leaves none, it moves up to the last cut, and only if even then there is none (a run of more
    than ``limit`` code points without white space) the text is cut by force. Starts step back
    from the cut by ``overlap`` code points, or by fewer to begin at a word. White space between
    two pieces, or at either end of the text, may belong to none.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be less than the limit")
    n = len(text)
    if n <= limit:
        return [(0, n, PARAGRAPH + 1)]
    strength = boundary_strengths(text)
    index = StretchMaximum(strength, limit + 1)
    space = np.isin(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4"), [ord(c) for c in SPACES])
    solid = np.flatnonzero(~space).astype(np.int32 if n < 1 << 31 else np.int64)
    if not len(solid):
        return [(0, limit, WORD)]
    word_starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]])).astype(solid.dtype)
    end_of_text = int(solid[-1]) + 1

    def first_solid(at: int) -> int:
        """The first place from ``at`` on that is no white space; the end of the text if there is none."""
        k = int(np.searchsorted(solid, at))
        return int(solid[k]) if k < len(solid) else n

    pieces = []
    start = done = first_solid(0)
    while True:
        if end_of_text - start <= limit:
            pieces.append((start, end_of_text, PARAGRAPH + 1))
            return pieces
        top = min(start + limit, n)
        least = max(done, start) + 1
        low = max(least, start + limit // 2)
        force, cut = index.strongest(low, top) if low <= top else (0, 0)
        if not force:
            force, cut = index.strongest(least, top) if least <= top else (0, 0)
        if not force and start < first_solid(done):
            start = first_solid(done)
            continue
        if not force:
            cut = top
        pieces.append((start, cut, force))
        done = cut
        back = max(cut - overlap, start + 1)
        k = int(np.searchsorted(word_starts, back))
        start = int(min(word_starts[k] if k < len(word_starts) else n, first_solid(cut)))
        if not force and start >= cut:
            start = back


def _plan_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        cuts = []
        for text, limit, overlap in zip(batch["text"], batch["max_chars"], batch["overlap_chars"], strict=True):
            cuts.append([{"start": a, "end": b, "cut_kind": KINDS[k] if k < len(KINDS) else LAST} for a, b, k in plan_cuts(text, int(limit), int(overlap))])
        batch = batch.drop(columns=["max_chars", "overlap_chars"])
        batch["cuts"] = pd.Series(cuts, index=batch.index, dtype=object)
        yield batch


CUT = "struct<start:int,end:int,cut_kind:string>"


def split_plans(items: DataFrame, limits: DataFrame) -> DataFrame:
    """Where to cut each item: field_name, item_key, text, cuts array<struct<start, end, cut_kind>>.

    ``items``: field_name, item_key, text. ``limits``: field_name, max_chars, overlap_chars, one
    row a field; fields are few, whatever the number of items. Items whose field has no limit are
    left out. Null texts have null cuts; an empty text has one empty piece. Rows are neither
    joined nor dropped, so repeated rows give repeated plans. Texts within their limit get their
    one piece in the JVM; only longer ones are taken to Python.
    """
    sized = items.select("field_name", "item_key", "text").join(
        F.broadcast(limits.select("field_name", "max_chars", "overlap_chars").dropDuplicates(["field_name"])), "field_name"
    )
    whole = F.array(F.struct(F.lit(0).alias("start"), F.char_length("text").cast("int").alias("end"), F.lit(LAST).alias("cut_kind")))
    short = sized.filter("text is null or char_length(text) <= max_chars").select(
        "field_name", "item_key", "text", F.when(F.col("text").isNotNull(), whole).cast(f"array<{CUT}>").alias("cuts")
    )
    key = dict(sized.dtypes)["item_key"]
    long = sized.filter("char_length(text) > max_chars").mapInPandas(_plan_batches, f"field_name string, item_key {key}, text string, cuts array<{CUT}>")
    return short.unionByName(long)


def split_items(items: DataFrame, limits: DataFrame) -> DataFrame:
    """Ordered pieces of each item: field_name, item_key, piece_no, start, n_chars, cut_kind, piece.

    See :func:`split_plans`. Null texts give no piece.
    """
    return split_plans(items, limits).select("field_name", "item_key", "text", F.posexplode("cuts").alias("piece_no", "cut")).select(
        "field_name",
        "item_key",
        "piece_no",
        F.col("cut.start").alias("start"),
        (F.col("cut.end") - F.col("cut.start")).alias("n_chars"),
        F.col("cut.cut_kind").alias("cut_kind"),
        F.substring("text", F.col("cut.start") + 1, F.col("cut.end") - F.col("cut.start")).alias("piece"),
    )


def oversized(items: DataFrame, limits: DataFrame) -> DataFrame:
    """Distinct (field_name, item_key, forced) of items that are longer than their limit.

    Whether an item is longer than its limit is a matter of its length; forced is read off the
    cutting plan: a cut had to be made inside a run without white space.
    """
    plans = split_plans(items, limits).join(F.broadcast(limits.select("field_name", "max_chars").dropDuplicates(["field_name"])), "field_name")
    forced = F.exists("cuts", lambda c: c["cut_kind"] == KINDS[FORCED])
    return (
        plans.filter("char_length(text) > max_chars and item_key is not null")
        .select("field_name", F.col("item_key").cast("string").alias("item_key"), F.when(forced, "yes").otherwise("no").alias("forced"))
        .distinct()
    )
