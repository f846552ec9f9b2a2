"""Answers from metadata, and contexts from retrieved chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pigmenta.functions.text import plain_number
from pigmenta.operators.chunking import keep_first


def ordered_text(text: Column, order: Column, separator: str) -> Column:
    """Texts of a group joined in an explicit order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), text.alias("t")))), lambda x: x["t"]), separator)


def representative(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key."""
    return keep_first(df, F.col(key), order)


def parent_of(children: DataFrame, parents: DataFrame) -> DataFrame:
    """Children with their parent's text; the child's own where the parent is missing."""
    known = parents.select("parent_id", F.col("text").alias("parent_text"))
    return children.join(known, "parent_id", "left").withColumn("context", F.coalesce("parent_text", "text"))


def range_text(low: Column, high: Column, unit: Column) -> Column:
    """"low-high unit", one number where both are equal, null where neither is known."""
    a, b = plain_number(low), plain_number(high)
    value = F.when(low.isNull(), b).when(high.isNull() | (low == high), a).otherwise(F.concat(a, F.lit("-"), b))
    return F.when(value.isNotNull(), F.concat_ws(" ", value, unit))


def list_answer(df: DataFrame, per: list[str], name: str, label: Column) -> DataFrame:
    """"<label> ürünler:", a blank line and the sorted names, each after a bullet."""
    head = F.concat(F.coalesce(F.nullif(label, F.lit("")), F.lit("Eşleşen")), F.lit(" ürünler:\n\n"))
    names = F.array_join(F.transform(F.sort_array(F.collect_set(name)), lambda n: F.concat(F.lit("• "), n)), "\n")
    return df.groupBy(*per).agg(F.concat(head, names).alias("answer"))


def no_list_answer(label: Column) -> Column:
    """What is said where nothing matches."""
    return F.concat(F.coalesce(F.nullif(label, F.lit("")), F.lit("Eşleşen")), F.lit(" ürün bulunamadı."))


def value_lines(df: DataFrame, key: str, fields: list[tuple[str, Column]]) -> DataFrame:
    """key, answer: "Label: value" lines for the fields that are known; keys with none are left out."""
    lines = F.filter(F.array(*[F.when(v.isNotNull(), F.concat(F.lit(f"{label}: "), v)) for label, v in fields]), lambda x: x.isNotNull())
    return df.select(key, F.array_join(lines, "\n").alias("answer")).filter("answer <> ''")


def flat_context(results: DataFrame) -> DataFrame:
    """query_id, context: "[Sayfa n]" and text of each result, blank lines between, by rank."""
    block = F.concat(F.lit("[Sayfa "), F.col("page_number"), F.lit("]\n"), F.col("text"))
    return results.groupBy("query_id").agg(ordered_text(block, F.col("rank"), "\n\n").alias("context"))


def parent_context(results: DataFrame) -> DataFrame:
    """query_id, context: the parents of the results once each, in order of their first result."""
    first = results.withColumn("_r", F.row_number().over(Window.partitionBy("query_id", "parent_id").orderBy("rank"))).filter("_r = 1")
    return first.groupBy("query_id").agg(ordered_text(F.col("context"), F.col("rank"), "\n\n").alias("context"))
