"""Readers: page texts, blocks from spans, questions, optional PDF files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pigmenta import schemas
from pigmenta.functions.text import strip


def nonblank_pages(pages: DataFrame) -> DataFrame:
    """Pages that have text; page numbers stay as they are."""
    return pages.filter(strip(F.col("text")) != "")


def selected_pages(pages: DataFrame, numbers: list[int] | None = None) -> DataFrame:
    """Pages of these numbers, or all."""
    return pages if numbers is None else pages.filter(F.col("page_number").isin(numbers))


def blocks_from_spans(spans: DataFrame) -> DataFrame:
    """Layout blocks (doc_id, page, block_no): spans joined by line, lines by line feed, the largest size rounded, the hull."""
    line = spans.groupBy("doc_id", "page", "block_no", "line_no").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "").alias("line"),
        F.max("size").alias("size"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
    )
    return line.groupBy("doc_id", "page", "block_no").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("text"),
        F.bround(F.max("size"), 0).cast("int").alias("font_size"),
        F.struct(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")).alias("bbox"),
    )


def questions(spark: SparkSession, path: str) -> DataFrame:
    """Questions from JSON; evidence is a text or a list of texts there, always a list here."""
    raw = spark.read.schema("id long, question string, question_type string, evidence string, answer string").json(path, multiLine=True)
    listed = F.from_json("evidence", "array<string>")
    return raw.withColumn("evidence", F.when(F.col("evidence").startswith("["), listed).when(F.col("evidence").isNotNull(), F.array("evidence")))


def plain_questions(spark: SparkSession, path: str) -> DataFrame:
    """Questions of a text file, one a line: id (place in the file), question, note behind "problem"."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("id", "line")).filter(strip(F.col("line")) != "")
    note = F.regexp_extract("line", r"(?i)\s(problem\b.*)$", 1)
    return rows.select("id", strip(F.regexp_replace("line", r"(?i)\sproblem\b.*$", "")).alias("question"), F.nullif(note, F.lit("")).alias("note"))


def pdf_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages of PDF files, where a PDF library is installed on the executors."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        try:
            from pypdf import PdfReader
        except ImportError as e:
            raise RuntimeError("reading PDF files needs the pypdf library") from e
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                pages = [(i, p.extract_text() or "") for i, p in enumerate(PdfReader(io.BytesIO(content)).pages, 1)]
                stem = name.rsplit("/", 1)[-1]
                yield pd.DataFrame([(stem.rsplit(".", 1)[0], stem, i, t) for i, t in pages], columns=["doc_id", "source", "page_number", "text"])

    return nonblank_pages(spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(read, schemas.PAGE))
