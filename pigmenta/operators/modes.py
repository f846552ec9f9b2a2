"""Four ways to retrieve: by vectors or by vectors and terms, with the chunk itself or its parent as context."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pigmenta.operators import fusion

MODES = ("semantic", "semantic_parent_child", "hybrid", "hybrid_parent_child")


def run_mode(mode: str, dense: DataFrame, sparse: DataFrame, keep: int) -> DataFrame:
    """query_id, id, rank of the ``keep`` best of each query.

    ``dense`` (query_id, id, distance, rank) and ``sparse`` (query_id, id, score, rank) are the
    candidate lists. The parent modes rank like the others; see :func:`mode_report`. An unknown
    mode is an error.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}; there are {', '.join(MODES)}")
    best = fusion.fuse(dense, sparse, keep) if mode.startswith("hybrid") else dense.filter(F.col("rank") <= keep)
    return best.select("query_id", "id", "rank")


def mode_report(dense: DataFrame, sparse: DataFrame, chunks: DataFrame, parents: DataFrame, keep: int, modes: tuple[str, ...] = MODES) -> DataFrame:
    """mode, query_id, pages (sorted, each once), chunks: what each mode retrieves for each query.

    ``chunks``: id, parent_id, page_number; ``parents``: parent_id, page_number. Pages are those of
    the chunks, in the parent modes of their parents; parents that are missing have none, an unknown
    page is 0. Give lists that are written once: each is read by every mode.
    """
    ranked = reduce(DataFrame.unionByName, [run_mode(m, dense, sparse, keep).withColumn("mode", F.lit(m)) for m in modes])
    known = ranked.join(chunks.select("id", "parent_id", F.coalesce("page_number", F.lit(0)).alias("own")), "id")
    of_parent = parents.select("parent_id", F.coalesce("page_number", F.lit(0)).alias("above"))
    page = F.when(F.col("mode").endswith("parent_child"), F.col("above")).otherwise(F.col("own"))
    return known.join(of_parent, "parent_id", "left").groupBy("mode", "query_id").agg(F.sort_array(F.collect_set(page)).alias("pages"), F.count("*").alias("chunks"))
