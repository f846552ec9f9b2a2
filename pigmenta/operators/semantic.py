"""Chunks of texts by meaning: sentences are embedded with their neighbours and cut where the meaning turns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pigmenta.operators.chunking import constrain_sizes, merge_short, neighbourhoods, semantic_groups, sentence_rows, structural_units
from pigmenta.sources.providers import Embedder, with_embeddings


def semantic_pieces(texts: DataFrame, keys: list[str], *, embed: Embedder | None = None, buffer: int = 1, percentile: float = 0.9) -> DataFrame:
    """The keys, piece_no, piece: groups of sentences of each ``text``.

    A sentence is embedded with ``buffer`` sentences on either side; a piece ends where the
    distance to the next one is above the text's percentile. A text is one group.
    """
    rows = neighbourhoods(sentence_rows(texts, keys), keys, "sentence", "sentence_no", buffer)
    embedded = with_embeddings(rows, embed, "neighbourhood")
    grouped = semantic_groups(embedded, keys, "embedding", "sentence_no", percentile)
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("sentence_no", "sentence"))), lambda s: s["sentence"]), " ")
    return grouped.groupBy(*keys, F.col("group_no").alias("piece_no")).agg(joined.alias("piece"))


def _listed(pieces: DataFrame, keys: list[str], order: list[str], fields: list[str]) -> DataFrame:
    return pieces.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*order, *fields))).alias("pieces"))


def semantic_text_chunks(texts: DataFrame, keys: list[str], *, embed: Embedder | None = None, least: int = 200, most: int = 1800, overlap: int = 100) -> DataFrame:
    """The keys, chunk_no, chunk: semantic pieces brought to size."""

    @F.pandas_udf("array<string>")
    def sized(groups: pd.Series) -> pd.Series:
        return pd.Series([constrain_sizes([p["piece"] for p in g], least, most, overlap) for g in groups], dtype=object)

    listed = _listed(semantic_pieces(texts, keys, embed=embed), keys, ["piece_no"], ["piece"])
    return listed.select(*keys, F.posexplode(sized("pieces")).alias("chunk_no", "chunk"))


def hybrid_chunks(texts: DataFrame, keys: list[str], *, embed: Embedder | None = None, long_unit: int = 400, least: int = 200, most: int = 1800, overlap: int = 100) -> DataFrame:
    """The keys, chunk_no, chunk: units between blank lines, long ones cut by meaning, brought to size within headings."""
    units = structural_units(texts, keys)
    nested = [*keys, "unit_no"]
    whole = units.filter(F.char_length("unit") <= long_unit).select(*nested, F.lit(0).cast("long").alias("piece_no"), F.col("unit").alias("piece"))
    cut = semantic_pieces(units.filter(F.char_length("unit") > long_unit).select(*nested, F.col("unit").alias("text")), nested, embed=embed)
    flagged = whole.unionByName(cut.withColumn("piece_no", F.col("piece_no").cast("long"))).join(units.select(*nested, "is_heading"), nested)
    starts = (F.col("is_heading") & (F.col("piece_no") == 0)).alias("starts")

    @F.pandas_udf("array<string>")
    def sized(groups: pd.Series) -> pd.Series:
        return pd.Series([constrain_sizes([p["piece"] for p in g], least, most, overlap, [bool(p["starts"]) for p in g]) for g in groups], dtype=object)

    listed = _listed(flagged.select(*nested, "piece_no", "piece", starts), keys, ["unit_no", "piece_no"], ["piece", "starts"])
    return listed.select(*keys, F.posexplode(sized("pieces")).alias("chunk_no", "chunk"))


def semantic_children(parents: DataFrame, key: str = "parent_id", *, embed: Embedder | None = None, buffer: int = 2, percentile: float = 0.85, least_words: int = 15) -> DataFrame:
    """key, child_no, content: semantic pieces of each parent's text, short fragments joined to the piece before."""

    @F.pandas_udf("array<string>")
    def merged(groups: pd.Series) -> pd.Series:
        return pd.Series([merge_short([p["piece"] for p in g], least_words) for g in groups], dtype=object)

    listed = _listed(semantic_pieces(parents, [key], embed=embed, buffer=buffer, percentile=percentile), [key], ["piece_no"], ["piece"])
    return listed.select(key, F.posexplode(merged("pieces")).alias("child_no", "content"))
