"""Small helpers around a SparkSession: reading tables, cutting lineage, bounded sizes."""

from __future__ import annotations

import tempfile
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there.

    The folder is the session's ``spark.checkpoint.dir``. Only where that is unset in a local
    session (tests) a temporary folder is used; a cluster must name one. A lost executor then costs nothing: the files
    are on storage that all executors share.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", "") or sc.getConf().get("spark.checkpoint.dir", "")
        if not folder and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="pigmenta-checkpoint-"))
    return df.checkpoint(eager=True)


def spread(df: DataFrame, *, per_task_bytes: int = 2 << 20, scan: bool = True) -> DataFrame:
    """Spread an input of few files over enough tasks for work that is heavy per byte.

    A scan makes tasks by file size alone, so a few megabytes of text would be one task however
    costly each row is. An input that already has a task for every core is left in place; a
    smaller one moves once, evenly. What isn't a mere scan (``scan`` false) always moves, as
    results of shuffles are gathered in tasks by size alone too.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution()
    if scan and plan.toRdd().getNumPartitions() >= cores:
        return df
    size = int(str(plan.optimizedPlan().stats().sizeInBytes()))
    most = max(32 * cores, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(max(cores, min(most, -(-size // per_task_bytes))))


def apart(df: DataFrame, key: Column, *, most: int = 1 << 20) -> tuple[DataFrame, DataFrame | None]:
    """Rows whose key stands once, and rows whose key may stand more often (none: there is none).

    Only hashes of keys move. Those that stand more than once go along with the tasks, so rows stay
    where they are; of more than ``most`` such hashes all rows count as the second kind.
    """
    repeated = cut_lineage(df.select(F.xxhash64(key).alias("_hash")).groupBy("_hash").agg(F.count("*").alias("n")).filter("n > 1").select("_hash"))
    n = repeated.count()
    if not n:
        return df, None
    if n > most:
        return df.filter(F.lit(False)), df
    hashed = df.withColumn("_hash", F.xxhash64(key))
    return tuple(hashed.join(F.broadcast(repeated), "_hash", how).drop("_hash") for how in ("left_anti", "left_semi"))


def attach_hot_aware(rows: DataFrame, groups: DataFrame, key: str, count: str, *, hot_groups: int = 1000) -> DataFrame:
    """Inner join of ``rows`` to one row a ``key`` of ``groups``, in which a key may hold a third of all rows.

    Groups with more than 1/``hot_groups`` of all rows are fewer than ``hot_groups`` by
    arithmetic, so they can be broadcast whatever the data are; their rows never move. The rest
    are joined by a shuffle in which no key is large.

    Null keys match nothing. ``groups`` may have its own columns besides ``key`` and ``count``
    and must hold a key once.
    """
    total = groups.agg(F.sum(count).alias("n")).first()["n"] or 0
    limit = total / hot_groups
    hot = groups.filter(F.col(count) > limit)
    cold = groups.filter(F.col(count) <= limit)
    hot_rows = rows.join(F.broadcast(hot), key)
    cold_rows = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key)
    return hot_rows.unionByName(cold_rows)


def totals_before(rows: DataFrame, per: list[str], order: list[str], values: list[str]) -> DataFrame:
    """Adds ``<value>_before``: the sum of each value over the earlier rows of its group.

    A group may hold any share of the rows: they are sorted by range over all tasks, summed up
    within a range, and ranges of a group (few, whatever its size) get what went before them.
    ``order`` must tell the rows of a group apart. Give narrow rows: they are written once, so
    that ranges stay what they are.
    """
    placed = cut_lineage(rows.repartitionByRange(*per, *order).withColumn("_range", F.spark_partition_id()))
    earlier = Window.partitionBy("_range", *per).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ranges = placed.groupBy("_range", *per).agg(*[F.sum(v).alias(f"_{v}") for v in values])
    before = Window.partitionBy(*per).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.select(
        F.col("_range").alias("_at"), *[F.col(f"`{p}`").alias(f"_per{i}") for i, p in enumerate(per)], *[F.coalesce(F.sum(f"_{v}").over(before), F.lit(0)).alias(f"_{v}") for v in values]
    )
    same = reduce(lambda a, b: a & b, [F.col(f"`{p}`").eqNullSafe(F.col(f"_per{i}")) for i, p in enumerate(per)], F.col("_range") == F.col("_at"))
    inside = placed.withColumns({f"{v}_before": F.coalesce(F.sum(v).over(earlier), F.lit(0)) for v in values})
    joined = inside.join(offsets, same)
    return joined.withColumns({f"{v}_before": F.col(f"{v}_before") + F.col(f"_{v}") for v in values}).drop("_range", "_at", *[f"_per{i}" for i in range(len(per))], *[f"_{v}" for v in values])


def query_blocks(queries: DataFrame, key: str, *, block: int = 2048) -> list[DataFrame]:
    """A stated query set in blocks of about ``block`` rows, each small enough to be broadcast.

    The set is counted; its blocks are taken by hash of the key, so they are the same each time.
    """
    n = -(-queries.count() // block)
    return [queries] if n <= 1 else [queries.filter(F.pmod(F.xxhash64(key), F.lit(n)) == b) for b in range(n)]


def attach_asked(rows: DataFrame, asked: DataFrame, key: str) -> DataFrame:
    """Inner join of ``rows`` to ``asked``: what was found for a stated query set, a few rows a query.

    ``asked`` goes along with the tasks in blocks of about 65,536 rows, so rows never move; it is
    read once for each block and to be counted, so give what is written.
    """
    return reduce(DataFrame.unionByName, [rows.join(F.broadcast(q), key) for q in query_blocks(asked, key, block=65_536)])


def only_asked(rows: DataFrame, asked: DataFrame, key: str) -> DataFrame:
    """The rows whose key ``asked`` has; see :func:`attach_asked`."""
    return attach_asked(rows, cut_lineage(asked.select(key).distinct()), key)
