"""The queries of this subpackage, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pigmenta.llm import leakage, lookalikes, mixing, nested_dedup, pairs, permutation_index, quality, spam, splitting
from pigmenta.session import spread, table


def _named_texts(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").select(F.lit("pages.text").alias("field_name"), F.col("page_id").cast("string").alias("key"), "text")
    names = table(spark, d, "paint_properties").select(F.lit("paint_properties.ürün_adı").alias("field_name"), F.col("doc_id").alias("key"), F.col("`ürün_adı`").alias("text"))
    return spread(pages.unionByName(names))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.look_alike_pairs(_named_texts(spark, d))


def p1_classes(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.look_alike_classes(_named_texts(spark, d))


def p1_forms(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.canonical_forms(_named_texts(spark, d))


def _items(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").select(F.lit("pages.text").alias("field_name"), F.col("page_id").cast("string").alias("item_key"), "text")
    parents = table(spark, d, "parent_chunks").select(F.lit("parent_chunks.text").alias("field_name"), F.col("parent_id").alias("item_key"), "text")
    return pages.unionByName(parents)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.oversized(_items(spark, d), table(spark, d, "split_limits"))


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_items(_items(spark, d), table(spark, d, "split_limits"))


def _contents(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "children_df").select(F.col("child_id").alias("key"), "content"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return nested_dedup.copies_of(_contents(spark, d)).select(F.col("representative").alias("child_id_a"), F.col("key").alias("child_id_b"))


def p3_records(spark: SparkSession, d: str) -> DataFrame:
    return nested_dedup.collapse(_contents(spark, d)).select(F.col("representative").alias("child_id"), "copies")


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "child_chunks").select(F.col("child_id").alias("id"), F.col("embedding").alias("vector"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    pairs_ = permutation_index.similar_pairs(permutation_index.most_similar(_vectors(spark, d)))
    return pairs_.select(F.col("id_a").alias("child_id_a"), F.col("id_b").alias("child_id_b"))


def p4_similar(spark: SparkSession, d: str) -> DataFrame:
    return permutation_index.most_similar(_vectors(spark, d))


def _qualities(spark: SparkSession, d: str) -> DataFrame:
    return quality.text_quality(spread(table(spark, d, "blocks").select("block_id", "text", "font_size", "source", "page")), table(spark, d, "common_words"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return quality.not_prose(_qualities(spark, d))


def p5_statistics(spark: SparkSession, d: str) -> DataFrame:
    return _qualities(spark, d)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.defective_pairs(table(spark, d, "questions_df"), table(spark, d, "common_words"))


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(spread(table(spark, d, "documents").select("doc_id", "text")), table(spark, d, "eval_items"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_passages(_leaks(spark, d))


def p7_coverage(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_coverage(_leaks(spark, d))


def _mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.share_report(_mixture(spark, d), table(spark, d, "mix_targets"))


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d)


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text", "lang"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return spam.spam_documents(_documents(spark, d))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return spam.stuffed_shares(_documents(spark, d))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (p1_found, p1_classes, p1_forms, p2_found, p2_pieces, p3_found, p3_records, p4_found, p4_similar, p5_found, p5_statistics, p6_found, p7_found, p7_coverage, p8_shares, p8_mixture, p9_found, p9_shares)
}
