"""Collections as ordinary Parquet tables: create, append, upsert, get, count, ingest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pigmenta.operators.dense import METRICS


class Collection:
    """A table of (id, document, embedding, metadata columns) at a path, with a metric.

    Metadata are columns, so predicates on them reach the scan. The path holds version folders and
    a file that names the current one. Appends add files to it, by batch; an upsert writes the
    next version and then replaces the name, in one step, so readers see either the old or the new
    table and a crash between loses nothing. Versions before the last one are removed.
    """

    APPENDED = -1  # the batch of rows that were added without one

    def __init__(self, spark: SparkSession, path: str, *, metric: str = "cosine", dimension: int | None = None) -> None:
        if metric not in METRICS:
            raise ValueError(f"unknown metric {metric}")
        self.spark, self.path, self.metric, self.dimension = spark, path.rstrip("/"), metric, dimension

    def _fs(self, path: str) -> tuple:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def version(self) -> int:
        """The number of the current version; 0 for a collection that isn't there yet."""
        fs, p = self._fs(f"{self.path}/_current")
        if not fs.exists(p):
            return 0
        stream = fs.open(p)
        try:
            return int(stream.readLine())
        finally:
            stream.close()

    def _folder(self, version: int) -> str:
        return f"{self.path}/v{version:06d}"

    def _switch(self, version: int) -> None:
        fs, written = self._fs(f"{self.path}/_next")
        stream = fs.create(written, True)
        stream.writeBytes(f"{version}\n")
        stream.close()
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        overwrite = self.spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
        overwrite[0] = hadoop.Options.Rename.OVERWRITE
        hadoop.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(written, hadoop.Path(f"{self.path}/_current"), overwrite)

    def exists(self) -> bool:
        return self.version() > 0

    def read(self, *, without_batch: int | None = None) -> DataFrame:
        """All rows, or all but those of one batch."""
        rows = self.spark.read.parquet(self._folder(self.version()))
        return (rows if without_batch is None else rows.filter(F.col("batch_no") != without_batch)).drop("batch_no")

    def count(self) -> int:
        return self.read().count() if self.exists() else 0

    def _checked(self, rows: DataFrame) -> DataFrame:
        if self.dimension is None or "embedding" not in rows.columns:
            return rows
        wrong = F.concat(F.lit(f"embedding is not of {self.dimension} numbers: "), F.col("id"))
        return rows.withColumn("embedding", F.when(F.col("embedding").isNull() | (F.size("embedding") == self.dimension), F.col("embedding")).otherwise(F.raise_error(wrong).cast("array<double>")))

    def add(self, rows: DataFrame, batch_no: int | None = None) -> None:
        """Appends rows in bulk. A numbered batch replaces what it wrote before, so writing it again changes nothing."""
        version = self.version() or 1
        folder = f"{self._folder(version)}/batch_no={self.APPENDED if batch_no is None else batch_no}"
        self._checked(rows).write.mode("append" if batch_no is None else "overwrite").parquet(folder)
        if not self.exists():
            self._switch(version)

    def upsert(self, rows: DataFrame, version: str) -> None:
        """Puts rows in; of an id the one with the highest ``version`` stays."""
        new = self._checked(rows)
        current = self.version()
        merged = last_wins(self.read().unionByName(new, allowMissingColumns=True), "id", version) if current else last_wins(new, "id", version)
        merged.write.mode("overwrite").parquet(f"{self._folder(current + 1)}/batch_no={self.APPENDED}")
        self._switch(current + 1)
        fs, old = self._fs(self._folder(current - 1))
        fs.delete(old, True)

    def get(self, ids: DataFrame | None = None, where: Column | None = None, limit: int | None = None) -> DataFrame:
        """Rows by ids (a table with ``id``), by predicate, or all; a limit takes the smallest ids."""
        rows = self.read()
        if where is not None:
            rows = rows.filter(where)
        if ids is not None:
            rows = rows.join(ids.select("id").distinct(), "id", "left_semi")
        return rows.orderBy("id").limit(limit) if limit else rows


def last_wins(rows: DataFrame, key: str, version: str) -> DataFrame:
    """One row a key: that of the highest version."""
    w = Window.partitionBy(key).orderBy(F.desc(version), *[F.col(f"`{c}`").cast("string") for c in rows.columns if c not in (key, version)])
    return rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def unseen(candidates: DataFrame, ingested: DataFrame, key: str = "source") -> DataFrame:
    """Rows of sources that aren't in yet."""
    return candidates.join(ingested.select(key).distinct(), key, "left_anti")
