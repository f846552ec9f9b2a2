"""Rank fusion, hybrid retrieval, confidence, and what is kept of a ranked list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pigmenta.functions.vectors import similarity_of
from pigmenta.operators.dense import rank_within

RRF_K = 60
DROP_BELOW, LOW_BELOW = 0.35, 0.55
DENSE_WEIGHT, SPARSE_WEIGHT = 0.7, 0.3
LOW_TAG = "[DÜŞÜK GÜVEN] "


def fuse(dense: DataFrame, sparse: DataFrame, k: int | None = None, *, rrf_k: int = RRF_K) -> DataFrame:
    """Reciprocal-rank fusion of two ranked lists: query_id, id, rrf, dense_distance, sparse_score, rank.

    Ranks count from 1, a list adds 1 / (rrf_k + rank). Equal sums keep the order of first
    appearance: the dense list, then what only the sparse one has.
    """
    both = dense.select("query_id", "id", F.col("rank").alias("dense_rank"), F.col("distance").alias("dense_distance")).join(
        sparse.select("query_id", "id", F.col("rank").alias("sparse_rank"), F.col("score").alias("sparse_score")), ["query_id", "id"], "full"
    )
    gain = lambda c: F.coalesce(1.0 / (rrf_k + F.col(c)), F.lit(0.0))
    scored = both.withColumn("rrf", F.round(gain("dense_rank") + gain("sparse_rank"), 9))
    first = F.coalesce(F.col("dense_rank"), F.lit(1_000_000) + F.col("sparse_rank"))
    return rank_within(scored, "query_id", [F.desc("rrf"), first], k).select("query_id", "id", "rrf", "dense_distance", "sparse_score", "rank")


def confident(results: DataFrame, decimals: int = 6) -> DataFrame:
    """Adds confidence and confidence_label (high, low, drop) to fused results.

    Sparse scores are brought to 0..1 within a query (all equal: 1); the weights are 0.7 and 0.3
    where both scores are there, one alone counts in full, none gives 1. Labels are decided on
    the unrounded value.
    """
    w = Window.partitionBy("query_id")
    low, high = F.min("sparse_score").over(w), F.max("sparse_score").over(w)
    normal = F.when(F.col("sparse_score").isNull(), None).when(high - low < 1e-9, 1.0).otherwise((F.col("sparse_score") - low) / (high - low))
    dense = similarity_of(F.col("dense_distance"))
    with_parts = results.withColumn("_d", dense).withColumn("_s", normal)
    value = (
        F.when(F.col("_d").isNotNull() & F.col("_s").isNotNull(), DENSE_WEIGHT * F.col("_d") + SPARSE_WEIGHT * F.col("_s"))
        .when(F.col("_d").isNotNull(), F.col("_d"))
        .when(F.col("_s").isNotNull(), F.col("_s"))
        .otherwise(1.0)
    )
    label = F.when(F.col("_c") < DROP_BELOW, "drop").when(F.col("_c") < LOW_BELOW, "low").otherwise("high")
    # Values are rounded far below what is shown, so that sums in another order give the same label.
    return with_parts.withColumn("_c", F.round(value, 9)).withColumns({"confidence": F.round("_c", decimals) + F.lit(0.0), "confidence_label": label}).drop("_c", "_d", "_s")


def gated(results: DataFrame) -> DataFrame:
    """Results that are not to be dropped."""
    return results.filter("confidence_label <> 'drop'")


def gate_report(results: DataFrame) -> DataFrame:
    """Per query: how many of each label, and the highest confidence."""
    count = lambda x: F.count_if(F.col("confidence_label") == x)
    return results.groupBy("query_id").agg(F.max("confidence").alias("best"), count("high").alias("high"), count("low").alias("low"), count("drop").alias("dropped"))


def tagged(text: Column, label: Column) -> Column:
    """A text with a mark before it if its confidence is low."""
    return F.when(label == "low", F.concat(F.lit(LOW_TAG), text)).otherwise(text)


def best_per_parent(results: DataFrame, parent: Column, keep: int | None = None) -> DataFrame:
    """The first result of each parent of a query, ranked anew, ``keep`` at most (none or 0: all).

    ``parent`` is the parent's id, or what stands for it where that is null or empty.
    """
    keyed = results.withColumn("_parent", parent)
    first = keyed.withColumn("_r", F.row_number().over(Window.partitionBy("query_id", "_parent").orderBy("rank"))).filter("_r = 1").drop("_r")
    renumbered = first.withColumnRenamed("rank", "_rank")
    return rank_within(renumbered, "query_id", ["_rank"], keep or None).drop("_rank", "_parent")
