"""Graph retrieval: evidence passages, mentions, expansion over neighbours, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pigmenta.functions.text import strip
from pigmenta.operators.chunking import keep_first
from pigmenta.session import cut_lineage


def evidence_corpus(questions: DataFrame) -> DataFrame:
    """Passages of the questions' evidence: seq_question, seq, parent_id, content; equal ones kept once.

    ``questions``: id, evidence array<string>. A passage is stripped, blank and null ones are
    dropped. The first copy by question id and place stays, so later questions lose theirs.
    """
    rows = questions.select("id", "evidence").distinct().select("id", F.posexplode("evidence").alias("pos", "raw"))
    passages = rows.select("id", "pos", strip(F.col("raw")).alias("content")).filter("content <> ''")
    kept = keep_first(passages, F.col("content"), ["id", "pos"])
    return kept.select(F.col("id").alias("source_question_id"), "pos", F.concat(F.lit("q"), "id").alias("parent_id"), "content")


def mentions(triples: DataFrame) -> DataFrame:
    """entity, chunk: which entity stands in which chunk, as subject or object."""
    return (
        triples.select(F.col("subject").alias("entity"), F.col("source_chunk").alias("chunk"))
        .unionByName(triples.select(F.col("object").alias("entity"), F.col("source_chunk").alias("chunk")))
        .filter("entity is not null")
        .distinct()
    )


def edges(triples: DataFrame) -> DataFrame:
    """a, b: neighbours in either direction."""
    pairs = triples.select(F.col("subject").alias("a"), F.col("object").alias("b")).filter("a is not null and b is not null")
    return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def expand(seeds: DataFrame, links: DataFrame, hops: int) -> DataFrame:
    """seed_key, entity, hop: entities within ``hops`` of the seeds (seed_key, entity), nearest hop.

    Only entities that are new in a hop are followed in the next; each hop is a join whose result
    is written once, so plans don't grow with the number of hops.
    """
    reached = seeds.select("seed_key", "entity").distinct().withColumn("hop", F.lit(0))
    front = reached
    for hop in range(1, hops + 1):
        further = front.join(links, front["entity"] == links["a"]).select("seed_key", F.col("b").alias("entity")).distinct()
        fresh = further.join(reached.select("seed_key", "entity"), ["seed_key", "entity"], "left_anti").withColumn("hop", F.lit(hop))
        front = cut_lineage(fresh) if hop < hops else fresh
        reached = reached.unionByName(front)
    return reached


WORD = 64  # queries whose sets go along as the bits of one number


def graph_context(seed_chunks: DataFrame, triples: DataFrame, hops: int = 1) -> DataFrame:
    """query_id, chunk, via (vector or graph): the seeds and the chunks that their entities lead to.

    ``seed_chunks``: query_id, chunk. An entity next to many leads each query to as many chunks, so
    queries are numbered and followed 64 at a time, as bits of a number for each entity and chunk;
    pairs come about in the last step, once each, and aren't moved.
    """
    stand_in = mentions(triples)
    seeds = seed_chunks.select("query_id", "chunk").distinct()
    place = F.row_number().over(Window.orderBy("query_id")).cast("long") - 1
    numbered = cut_lineage(seeds.select("query_id").distinct().withColumn("_n", place).select("query_id", F.expr(f"_n div {WORD}").alias("word"), (F.col("_n") % WORD).cast("int").alias("bit")))
    of_seeds = seeds.join(F.broadcast(numbered), seeds["query_id"].eqNullSafe(numbered["query_id"])).select("chunk", "word", F.expr("shiftleft(1L, bit)").alias("bits"))
    own = cut_lineage(of_seeds.groupBy("chunk", "word").agg(F.bit_or("bits").alias("bits")))
    reached = own.join(stand_in, "chunk").groupBy("entity", "word").agg(F.bit_or("bits").alias("bits"))
    links = edges(triples)
    for _ in range(hops):
        near = cut_lineage(reached)
        further = near.join(links, near["entity"] == links["a"]).select(F.col("b").alias("entity"), "word", "bits")
        reached = near.unionByName(further).groupBy("entity", "word").agg(F.bit_or("bits").alias("bits"))
    led = reached.join(stand_in, "entity").select("chunk", "word", "bits", F.lit(0).cast("long").alias("seed"))
    both = led.unionByName(own.select("chunk", "word", "bits", F.col("bits").alias("seed"))).groupBy("chunk", "word").agg(F.bit_or("bits").alias("bits"), F.bit_or("seed").alias("seed"))
    queries = numbered.groupBy("word").agg(F.collect_list(F.struct("bit", "query_id")).alias("queries"))
    pairs = both.join(F.broadcast(queries), "word").select("chunk", "bits", "seed", F.explode("queries").alias("x")).select("chunk", "bits", "seed", "x.*")
    has = lambda c: F.expr(f"shiftrightunsigned({c}, bit) & 1L") == 1
    return pairs.filter(has("bits")).select("query_id", "chunk", F.when(has("seed"), "vector").otherwise("graph").alias("via"))


def retrieval_recall(retrieved: DataFrame, truth: DataFrame) -> DataFrame:
    """query_id, hit, num_retrieved: whether a passage of the question itself was retrieved.

    ``retrieved``: query_id, passage; ``truth``: passage, source_question_id.
    """
    joined = retrieved.join(truth, "passage", "left")
    return joined.groupBy("query_id").agg(F.max(F.coalesce(F.col("source_question_id") == F.col("query_id"), F.lit(False))).alias("hit"), F.count("*").alias("num_retrieved"))
