"""Find the documents of a corpus that contain texts of an evaluation set, fully or in part.

Method: *greedy string tiling*. Documents and items are brought together by shared seeds (runs of
``min_tile`` words, by Karp-Rabin hashes), seeds are grown to common runs, and the longest runs
are marked one after the other as tiles that do not overlap. The tiles say how much of an item
is in the document, in whatever order its passages stand there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pigmenta.llm.words import plain_words

MIN_TILE = 5
BLOCK_BYTES = 32 << 20
_BASE = 1_000_003
_MASK = (1 << 61) - 1
SHAPE = "doc_id {doc}, item_id {item}, item_words int, matched_words int, longest_tile int, tiles array<struct<item_start:int,doc_start:int,words:int>>"


def rolling(words: list[int], length: int) -> list[int]:
    """Karp-Rabin hash of every run of ``length`` words."""
    if len(words) < length:
        return []
    top = pow(_BASE, length - 1, _MASK)
    h = 0
    for w in words[:length]:
        h = (h * _BASE + w) % _MASK
    out = [h]
    for gone, new in zip(words, words[length:], strict=False):
        h = ((h - gone * top) * _BASE + new) % _MASK
        out.append(h)
    return out


def greedy_tiles(item: list[int], doc: list[int], min_tile: int = MIN_TILE) -> list[tuple[int, int, int]]:
    """(start in item, start in doc, words) of tiles, longest first, ties by item then document.

    Each word of either side is in one tile at most. Negative numbers match nothing.
    """
    free_item, free_doc = [True] * len(item), [True] * len(doc)
    tiles: list[tuple[int, int, int]] = []
    length = min_tile
    found: list[tuple[int, int, int]] = []
    where: dict[int, list[int]] = {}
    for i, h in enumerate(rolling(item, length)):
        where.setdefault(h, []).append(i)
    # All maximal runs, from the seeds; a later run that a tile cuts into is shortened and put back.
    for j, h in enumerate(rolling(doc, length)):
        for i in where.get(h, ()):
            if i and j and item[i - 1] == doc[j - 1] >= 0:
                continue  # not the start of its run
            k = 0
            while i + k < len(item) and j + k < len(doc) and item[i + k] == doc[j + k] >= 0:
                k += 1
            if k >= min_tile:
                found.append((k, i, j))
    by_length: dict[int, list[tuple[int, int]]] = {}
    for k, i, j in found:
        by_length.setdefault(k, []).append((i, j))
    for k in range(max(by_length, default=0), min_tile - 1, -1):
        for i, j in sorted(by_length.pop(k, [])):
            runs, at = [], 0
            while at < k:
                if free_item[i + at] and free_doc[j + at]:
                    end = at
                    while end < k and free_item[i + end] and free_doc[j + end]:
                        end += 1
                    runs.append((at, end - at))
                    at = end
                else:
                    at += 1
            for at, size in runs:
                if size == k:
                    tiles.append((i, j, k))
                    free_item[i : i + k] = free_doc[j : j + k] = [False] * k
                elif size >= min_tile:
                    by_length.setdefault(size, []).append((i + at, j + at))
    return tiles


class SeedIndex:
    """Items by the seeds they hold, for one block of the evaluation set."""

    def __init__(self, items: list[tuple[object, str]], min_tile: int) -> None:
        self.raw, self.min_tile, self.items = items, min_tile, None

    def __getstate__(self) -> tuple:
        return self.raw, self.min_tile

    def __setstate__(self, state: tuple) -> None:
        self.__init__(*state)

    def build(self) -> None:
        self.number: dict[str, int] = {}
        self.items = [(key, [self.number.setdefault(w, len(self.number)) for w in plain_words(text)]) for key, text in self.raw]
        self.seeds: dict[int, list[int]] = {}
        for n, (_, words) in enumerate(self.items):
            for h in set(rolling(words, self.min_tile)):
                self.seeds.setdefault(h, []).append(n)

    def matches(self, text: str) -> Iterator[tuple[object, int, list[tuple[int, int, int]]]]:
        """(item, its number of words, tiles) of each item that shares a seed with ``text``."""
        if self.items is None:
            self.build()
        number = self.number
        doc = [number.get(w, -1) for w in plain_words(text)]
        hit: set[int] = set()
        run = 0
        known = np.array(doc, dtype=np.int64) >= 0
        if int(known.sum()) < self.min_tile:
            return
        for j, w in enumerate(doc):
            run = run + 1 if w >= 0 else 0
            if run >= self.min_tile:
                h = 0
                for x in doc[j + 1 - self.min_tile : j + 1]:
                    h = (h * _BASE + x) % _MASK
                hit.update(self.seeds.get(h, ()))
        for n in sorted(hit):
            key, words = self.items[n]
            if tiles := greedy_tiles(words, doc, self.min_tile):
                yield key, len(words), tiles


def leaks(documents: DataFrame, items: DataFrame, *, min_tile: int = MIN_TILE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Every document and item that share a run of ``min_tile`` words or more.

    ``documents``: doc_id, text. ``items``: item_id, text. Result: doc_id, item_id, item_words,
    matched_words, longest_tile, tiles. Letter case, white space and marks don't count; null and
    wordless texts match nothing; an item shorter than ``min_tile`` words matches nothing. Items
    that share an id are looked for separately and give a row each; equal rows are given once.

    The evaluation set is the stated query set: it is sent to the tasks in blocks of
    ``block_bytes`` of text, each block against all documents, so no size of it breaks a task.
    Documents are read in place and never shuffled; only matches move.
    """
    shape = SHAPE.format(doc=dict(documents.dtypes)["doc_id"], item=dict(items.dtypes)["item_id"])
    rows = items.select("item_id", "text").filter("text is not null").distinct()
    blocks: list[list[tuple[object, str]]] = [[]]
    size = 0
    for r in rows.toLocalIterator():
        if size > block_bytes:
            blocks.append([])
            size = 0
        blocks[-1].append((r["item_id"], r["text"]))
        size += len(r["text"].encode())
    texts = documents.select("doc_id", "text").filter("text is not null")
    out = None
    for block in blocks:
        index = SeedIndex(block, min_tile)

        def search(batches: Iterator[pd.DataFrame], index: SeedIndex = index) -> Iterator[pd.DataFrame]:
            for batch in batches:
                found = []
                for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                    for key, n, tiles in index.matches(text):
                        found.append((doc_id, key, n, sum(k for *_, k in tiles), max(k for *_, k in tiles), [{"item_start": i, "doc_start": j, "words": k} for i, j, k in tiles]))
                yield pd.DataFrame(found, columns=["doc_id", "item_id", "item_words", "matched_words", "longest_tile", "tiles"], dtype=object)

        part = texts.mapInPandas(search, shape)
        out = part if out is None else out.unionByName(part)
    return out


def leaked_passages(found: DataFrame, *, passage_words: int = 12) -> DataFrame:
    """doc_id, item_id where ``passage_words`` consecutive words of the item stand in the document.

    The first tile of a pair is its longest common run, so the longest tile decides exactly.
    """
    return found.filter(F.col("longest_tile") >= passage_words).select("doc_id", "item_id").distinct()


def leaked_coverage(found: DataFrame, *, coverage: float = 0.5) -> DataFrame:
    """doc_id, item_id, coverage where the tiles cover that share of an item's words, in any order."""
    return (
        found.withColumn("coverage", F.col("matched_words") / F.col("item_words"))
        .filter(F.col("coverage") >= coverage)
        .groupBy("doc_id", "item_id")
        .agg(F.max("coverage").alias("coverage"))
    )
