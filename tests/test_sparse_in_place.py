import math
import random
from collections import Counter, defaultdict
from pathlib import Path

import pyarrow as pa
from pyspark.sql import functions as F

from pigmenta.operators import sparse
from pigmenta.session import apart

DOCUMENTS, QUESTIONS = "id long, text string", "query_id long, query_text string"


def best(docs, queries, k, kept=lambda i: True):
    """As the SQL says: rows of one id and length are one document's, others of an id add up."""
    n, avgdl = len(docs), sum(len((t or "").split()) for _, t in docs) / len(docs)
    tf = Counter((i, len(t.split()), w) for i, t in docs for w in (t or "").split())
    raw = {w: math.log(n - x + 0.5) - math.log(x + 0.5) for w, x in Counter(w for _, _, w in tf).items()}
    idf = {w: x if x >= 0 else 0.25 * sum(raw.values()) / len(raw) for w, x in raw.items()}
    out = {}
    for q, text in queries:
        scores = defaultdict(float, {i: 0.0 for i, _ in docs})
        for (i, dl, w), x in tf.items():
            scores[i] += text.split().count(w) * idf[w] * x * 2.5 / (x + 1.5 * (0.25 + 0.75 * dl / avgdl))
        order = sorted((-round(s, 6), i) for i, s in scores.items() if kept(i))[:k]
        out |= {(q, r): (i, -s + 0.0) for r, (s, i) in enumerate(order, 1)}
    return out


def found(top):
    return {(r["query_id"], r["rank"]): (r["id"], r["score"]) for r in top.collect()}


def test_documents_that_score_below_nothing_are_no_filling(spark):
    docs = [(1, "a"), (2, "a"), (3, "")]
    top = sparse.sparse_top_k(sparse.build_index(spark.createDataFrame(docs, DOCUMENTS)), spark.createDataFrame([(9, "a")], QUESTIONS), 1)
    assert found(top) == best(docs, [(9, "a")], 1) == {(9, 1): (3, 0.0)}


def test_neither_postings_nor_scored_pairs_are_written(spark):
    words = [f"w{i}" for i in range(40)]
    docs = spark.createDataFrame([(i, " ".join(random.Random(i).sample(words, 30))) for i in range(3000)], DOCUMENTS).repartition(4)
    folder = Path(spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")) if spark.sparkContext._jsc.sc().getCheckpointDir().isDefined() else Path(spark.conf.get("spark.checkpoint.dir"))
    before = sum(p.stat().st_size for p in folder.rglob("*") if p.is_file())
    top = sparse.sparse_top_k(sparse.build_index(docs), spark.createDataFrame([(i, words[i]) for i in range(40)], QUESTIONS), 3)
    assert top.count() == 120
    assert sum(p.stat().st_size for p in folder.rglob("*") if p.is_file()) - before < 100_000


def test_many_batches_ties_and_ids_that_stand_more_than_once(spark, monkeypatch):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(25)]
    docs = [(rng.randrange(150), " ".join(rng.choices(words, [1 / (i + 1) for i in range(25)], k=rng.choice((0, 3, 3, 8))))) for _ in range(400)] + [(1000 + i, "w3 w20") for i in range(30)] + [(2000, None)]
    queries = [(q, " ".join(rng.choices(words, k=4))) for q in range(20)] + [(99, "unknown"), (100, "")]
    monkeypatch.setattr(sparse, "CELLS", 1)
    for share in (0.0, 0.003, 2.0):
        monkeypatch.setattr(sparse, "BROAD", share)
        df = spark.createDataFrame(docs, DOCUMENTS).withColumn("even", F.col("id") % 2 == 0).repartition(3)
        asked = spark.createDataFrame(queries, QUESTIONS)
        index = sparse.build_index(df)
        got, want = found(sparse.sparse_top_k(index, asked, 4)), best(docs, queries, 4)
        assert got == want
    even = best(docs, queries, 4, lambda i: i % 2 == 0)
    assert found(sparse.sparse_top_k(index, asked, 4, where=F.col("even"))) == even
    assert found(sparse.sparse_top_k(index, asked, 4, where=F.col("even"), rows=df.select("id", "even"))) == even
    assert sparse.sparse_top_k(sparse.build_index(df.limit(0)), asked, 4).count() == 0


def test_best_documents_hold_what_a_task_has_seen():
    asked = pa.table({"query_id": [7], "term": ["x"], "times": [1], "df": [2], "idf": [1.0]})
    batch = lambda *rows: pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.string()), pa.array([w for _, w in rows], pa.list_(pa.string()))], names=["id", "words"])
    first = sparse.BestDocuments(pa.table({"query_id": [7, 8]}), asked, 5, 1.0, 2, 6)
    rows = pa.Table.from_batches(first(iter([batch(("c\0", ["x"]), ("b", None)), batch(("c", ["x"]), ("a", [])), batch((None, ["x"]))]))).to_pylist()
    assert [(r["query_id"], r["id"], r["score"]) for r in rows] == [(7, "c", 1.0), (7, "c\0", 1.0), (8, "a", 0.0), (8, "b", 0.0)]


def test_rows_whose_key_stands_once_stay(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (None, "d"), (None, "e")], "k long, t string")
    single, several = apart(df, F.col("k"))
    assert [r["t"] for r in single.collect()] == ["a"] and sorted(r["t"] for r in several.collect()) == ["b", "c", "d", "e"]
    single, several = apart(df, F.col("k"), most=1)
    assert single.count() == 0 and several.count() == 5
    assert apart(df.filter("k = 1"), F.col("k"))[1] is None


def test_a_filter_on_the_documents_joins_nothing(spark, tmp_path):
    from pigmenta.plans import registry

    spark.createDataFrame([(i, f"w{i % 3} x", "en" if i % 2 else "tr") for i in range(20)], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(50, "w1 w2")], "id long, question string").write.parquet(str(tmp_path / "questions_df.parquet"))
    top = registry.QUERIES["bm25_topk_filtered"](spark, str(tmp_path))
    assert "Join" not in top._jdf.queryExecution().executedPlan().toString()
    assert {r["id"] % 2 for r in top.collect()} == {1} and top.count() == 10
