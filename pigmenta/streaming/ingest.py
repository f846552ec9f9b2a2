"""Incremental ingestion as a stream: each page that arrives is chunked once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pigmenta.operators.chunking import numbered_ids, parent_child
from pigmenta.session import cut_lineage
from pigmenta.sources.providers import Embedder, with_embeddings
from pigmenta.sources.readers import nonblank_pages
from pigmenta.sources.store import Collection, unseen

PAGES = "page_id long, source string, page_number int, text string"


def ingest(pages: DataFrame, children: Collection, parents: Collection | None = None, *, embed: Embedder | None = None, batch_no: int | None = None) -> None:
    """Chunks and appends the pages that aren't in the collection yet, by page_id.

    Parents and children of a source are numbered on from those it has, so pages of a source may
    come in any number of batches. A batch with a number may be written again after a failure: what
    it wrote before doesn't count as seen and is replaced. Chunks are embedded if ``embed`` is given.
    """
    fresh = nonblank_pages(pages).dropDuplicates(["page_id"])
    known = children.read(without_batch=batch_no) if children.exists() else None
    if known is not None:
        fresh = unseen(fresh, known, "page_id")
    chunks = parent_child(fresh)
    if known is not None:
        before = known.groupBy("source").agg((F.max("parent_no") + 1).alias("parents_before"), (F.max("child_no") + 1).alias("children_before"))
        moved = chunks.join(before, "source", "left")
        chunks = numbered_ids(moved.withColumns({"parent_no": F.col("parent_no") + F.coalesce("parents_before", F.lit(0)), "child_no": F.col("child_no") + F.coalesce("children_before", F.lit(0))}))
    chunks = cut_lineage(chunks)
    rows = chunks.select(F.col("child_id").alias("id"), "parent_id", "source", "page_id", "page_number", "parent_no", "child_no", "text", "chunk_index", "chunk_length", *([] if parents else ["parent_text"]))
    if parents is not None:
        parents.add(chunks.filter("chunk_index = 0").select(F.col("parent_id").alias("id"), "source", "page_id", "page_number", F.col("parent_text").alias("text")), batch_no)
    children.add(with_embeddings(rows, embed) if embed else rows, batch_no)


def ingest_stream(
    spark: SparkSession, folder: str, children: Collection, checkpoint: str, parents: Collection | None = None, *, embed: Embedder | None = None, once: bool = True, files_a_batch: int | None = None
) -> StreamingQuery:
    """Runs :func:`ingest` on Parquet files that arrive in a folder.

    The state is the checkpoint and the collection itself. Each batch is written under its own
    number, so one that is tried again after a failure neither repeats nor loses a page.
    """
    reader = spark.readStream.schema(PAGES)
    stream = (reader.option("maxFilesPerTrigger", files_a_batch) if files_a_batch else reader).parquet(folder)
    writer = stream.writeStream.foreachBatch(lambda batch, n: ingest(batch, children, parents, embed=embed, batch_no=n)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
