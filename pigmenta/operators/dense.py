"""Dense retrieval: exact similarity of stated queries to all rows, top k; centroids, projections."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pigmenta.functions.vectors import dot, doubles, norm
from pigmenta.session import query_blocks

METRICS = ("cosine", "l2", "ip")


def distances(queries: np.ndarray, rows: np.ndarray, metric: str) -> np.ndarray:
    """Distance of each query (row) to each vector (column), in double precision."""
    product = queries @ rows.T
    if metric == "ip":
        return 1 - product
    if metric == "l2":
        return np.maximum((queries**2).sum(axis=1)[:, None] + (rows**2).sum(axis=1)[None, :] - 2 * product, 0.0)
    return 1 - product / (np.linalg.norm(queries, axis=1)[:, None] * np.linalg.norm(rows, axis=1)[None, :] + 1e-10)


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions, lengths, flat numbers) of the vectors of a list column that are neither null nor have null elements."""
    lengths = np.asarray(column.value_lengths().fill_null(-1))
    flat = column.flatten()
    whole = lengths >= 0
    if flat.null_count:
        owner = np.repeat(np.flatnonzero(whole), lengths[whole])
        whole[owner[np.asarray(flat.is_null())]] = False
    at = np.flatnonzero(whole)
    kept = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return at, lengths[at], kept


class NearestRows:
    """The k nearest rows of stated queries over the batches of one task, by matrix products; ties by the smaller id."""

    def __init__(self, queries: pa.Table, k: int, metric: str, decimals: int) -> None:
        self.k, self.metric, self.decimals = k, metric, decimals
        self.ids = queries.column("query_id").combine_chunks()
        column = queries.column("query_embedding").combine_chunks()
        at, lengths, flat = _matrix(column)
        starts = np.cumsum(lengths) - lengths
        self.by_size = {int(n): (at[lengths == n], np.stack([flat[s : s + n] for s in starts[lengths == n]])) for n in np.unique(lengths) if n > 0}

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}  # by size: query, distance, id
        kind = None
        for batch in batches:
            kind = batch.schema.field("id").type
            at, lengths, flat = _matrix(batch.column("embedding"))
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            for size, (who, queries) in self.by_size.items():
                pick = np.flatnonzero(lengths == size)
                if not len(pick):
                    continue
                starts = (np.cumsum(lengths) - lengths)[pick]
                rows = flat[starts[:, None] + np.arange(size)] if len(pick) < len(at) else flat.reshape(-1, size)
                for s in range(0, len(queries), max(1, 8_000_000 // len(rows))):
                    some = slice(s, s + max(1, 8_000_000 // len(rows)))
                    d = np.round(distances(queries[some], rows, self.metric), self.decimals) + 0.0
                    d[np.isnan(d)] = np.inf
                    limit = np.partition(d, self.k - 1, axis=1)[:, self.k - 1] if self.k < d.shape[1] else np.full(len(d), np.inf)
                    q, r = np.nonzero((d <= limit[:, None]) & (d < np.inf))
                    new = (who[some][q], d[q, r], ids[at[pick[r]]])
                    best[size] = self._first(tuple(np.concatenate(x) for x in zip(best[size], new, strict=True)) if size in best else new)
        for q, d, i in best.values():
            yield pa.RecordBatch.from_arrays([self.ids.take(pa.array(q)), pa.array(i, type=kind), pa.array(d)], names=["query_id", "id", "distance"])

    def _first(self, found: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q, d, i = found
        order = np.lexsort((i.astype("U") if i.dtype == object else i, d, q))
        q, d, i = q[order], d[order], i[order]
        stay = np.arange(len(q)) - np.searchsorted(q, q) < self.k
        return q[stay], d[stay], i[stay]


def rank_within(df: DataFrame, per: str, order: list[Column | str], k: int | None) -> DataFrame:
    """Adds ``rank`` from 1 on in each group, and keeps the first ``k`` (all for none)."""
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(per).orderBy(*order)))
    return ranked.filter(F.col("rank") <= k) if k else ranked


def dense_top_k(corpus: DataFrame, queries: DataFrame, k: int, *, metric: str = "cosine", where: Column | None = None, decimals: int = 6) -> DataFrame:
    """query_id, id, distance, rank of the ``k`` nearest rows of each query.

    ``corpus``: id, embedding and whatever ``where`` needs; the predicate goes to the scan.
    ``queries``: query_id, query_embedding; the stated query set, which goes along with the tasks
    in blocks of 65,536, so the corpus is read once for each of them. In a task a batch of rows
    meets all queries of a block in one matrix product, and the first ``k`` are all that moves.
    Distances are rounded, ties go to the smaller id. Vectors that are null, have a null element,
    another length than the query's or no distance (not a number) are left out.
    """
    rows = corpus.filter(where) if where is not None else corpus
    known = rows.select("id", "embedding").filter("embedding is not null")
    asked = queries.select("query_id", "query_embedding").filter("query_embedding is not null")
    shape = f"query_id {dict(queries.dtypes)['query_id']}, id {dict(corpus.dtypes)['id']}, distance double"
    parts = [rank_within(known.mapInArrow(NearestRows(q.toArrow(), k, metric, decimals), shape), "query_id", ["distance", "id"], k) for q in query_blocks(asked, "query_id", block=65_536)]
    return reduce(DataFrame.unionByName, parts)


def centroids(vectors: DataFrame, key: str) -> DataFrame:
    """The mean vector of each key, element by element: key, centroid."""
    each = vectors.select(key, F.posexplode("embedding").alias("pos", "x"))
    means = each.groupBy(key, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return means.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "m"))), lambda e: e["m"]).alias("centroid"))


def centroid_similarity(vectors: DataFrame, key: str) -> DataFrame:
    """Adds the cosine of each vector to the centroid of its key; keys are few or joined by shuffle."""
    joined = vectors.join(centroids(vectors, key), key)
    return joined.withColumn("similarity", F.round(dot(F.col("embedding"), F.col("centroid")) / (norm(F.col("embedding")) * norm(F.col("centroid")) + 1e-10), 6) + F.lit(0.0))


def project(vectors: DataFrame, k: int = 2) -> DataFrame:
    """The first ``k`` principal components: id, components array. Signs are arbitrary."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = vectors.select("id", array_to_vector(doubles(F.col("embedding"))).alias("features"))
    return PCA(k=k, inputCol="features", outputCol="out").fit(rows).transform(rows).select("id", vector_to_array("out").alias("components"))


def dimension(vectors: DataFrame) -> DataFrame:
    """How many vectors of each length there are; a collection has one."""
    return vectors.filter("embedding is not null").groupBy(F.size("embedding").alias("dimension")).agg(F.count("*").alias("n"))
