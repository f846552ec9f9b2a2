import numpy as np
import pytest
from pyspark.sql import functions as F

from pigmenta.session import attach_hot_aware, cut_lineage
from pigmenta.sources import providers, readers, store
from pigmenta.streaming import ingest

import __spark_entry__ as entry


def test_collection_round_trip(spark, tmp_path):
    c = store.Collection(spark, str(tmp_path / "c"), dimension=2)
    assert c.count() == 0
    c.add(spark.createDataFrame([("a", [1.0, 0.0], 1), ("b", [0.0, 1.0], 1)], "id string, embedding array<double>, v int"))
    c.upsert(spark.createDataFrame([("b", [1.0, 1.0], 2), ("c", None, 1)], "id string, embedding array<double>, v int"), "v")
    assert {(r["id"], r["v"]) for r in c.get().collect()} == {("a", 1), ("b", 2), ("c", 1)}
    assert [r["id"] for r in c.get(ids=spark.createDataFrame([("c",), ("x",)], "id string")).collect()] == ["c"]
    assert [r["id"] for r in c.get(where=F.col("v") == 1, limit=1).collect()] == ["a"]
    with pytest.raises(Exception, match="not of 2 numbers"):
        c.add(spark.createDataFrame([("z", [1.0], 1)], "id string, embedding array<double>, v int"))
    with pytest.raises(ValueError, match="unknown metric"):
        store.Collection(spark, "x", metric="nope")


def test_unseen(spark):
    a = spark.createDataFrame([("s", 1), ("t", 2)], "source string, n int")
    assert [r["n"] for r in store.unseen(a, a.filter("n = 1")).collect()] == [2]


def test_question_readers(spark, tmp_path):
    (tmp_path / "q.json").write_text('[{"id": 1, "question": "a", "evidence": ["x", "y"], "answer": "b"}, {"id": 2, "question": "c", "evidence": "z"}]')
    assert {r["id"]: r["evidence"] for r in readers.questions(spark, str(tmp_path / "q.json")).collect()} == {1: ["x", "y"], 2: ["z"]}
    (tmp_path / "q.txt").write_text("Soru bir?\n\nSoru iki? problem: uzun\n")
    assert [(r["question"], r["note"]) for r in readers.plain_questions(spark, str(tmp_path / "q.txt")).orderBy("id").collect()] == [("Soru bir?", None), ("Soru iki?", "problem: uzun")]


def test_blocks_from_spans(spark):
    df = spark.createDataFrame([("d", 1, 0, 0, 0, "a", 9.5, 0.0, 0.0, 1.0, 1.0), ("d", 1, 0, 0, 1, "b", 12.4, 1.0, 0.0, 3.0, 2.0), ("d", 1, 0, 1, 2, "c", 9.0, 0.0, 2.0, 1.0, 3.0)],
                               "doc_id string, page int, block_no int, line_no int, seq int, text string, size double, x0 double, y0 double, x1 double, y1 double")
    r = readers.blocks_from_spans(df).first()
    assert (r["text"], r["font_size"], r["bbox"]["x1"], r["bbox"]["y1"]) == ("ab\nc", 12, 3.0, 3.0)


def test_providers(spark):
    df = spark.createDataFrame([("red paint",), (None,), ("",)], "text string")
    out = [r["embedding"] for r in providers.with_embeddings(df).collect()]
    assert out[1] is None and abs(np.linalg.norm(out[0]) - 1) < 1e-6 and not any(out[2])
    q = spark.createDataFrame([("why",)], "question string")
    assert providers.rewritten(q).first()["search_text"] == "why"
    assert providers.rewritten(q, lambda s: s + "!").first()["search_text"] == "why!"
    assert providers.answers(q.withColumn("context", F.lit("c")), lambda s, u: u.upper()).first()["answer"] == "C\n\nWHY"


def test_stream_ingests_each_source_once(spark, tmp_path):
    pages = spark.createDataFrame([(1, "s.pdf", 1, "x" * 300), (2, "t.pdf", 1, " ")], "page_id long, source string, page_number int, text string")
    pages.write.parquet(str(tmp_path / "in"))
    children = store.Collection(spark, str(tmp_path / "out"))
    for _ in range(2):
        ingest.ingest_stream(spark, str(tmp_path / "in"), children, str(tmp_path / "state")).awaitTermination()
    first = children.count()
    ingest.ingest(pages, children)
    assert first == children.count() == 2


PAGE = "page_id long, source string, page_number int, text string"


def test_later_pages_of_a_source_are_kept(spark, tmp_path):
    for n, ids in enumerate([(1, 2), (3, 4), (4, 5)]):
        spark.createDataFrame([(i, "s.pdf", i, chr(96 + i) * 300) for i in ids], PAGE).coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
    children, parents = (store.Collection(spark, str(tmp_path / x)) for x in ("children", "parents"))
    ingest.ingest_stream(spark, str(tmp_path / "in/*"), children, str(tmp_path / "state"), parents, embed=providers.hashing_embedder(8), files_a_batch=1).awaitTermination()
    rows = children.read().collect()
    assert sorted({r["page_id"] for r in rows}) == [1, 2, 3, 4, 5] and len({r["id"] for r in rows}) == len(rows) == 10 and all(len(r["embedding"]) == 8 for r in rows)
    assert sorted(r["id"] for r in parents.read().collect()) == [f"s_parent_{i}" for i in range(5)]


def test_a_batch_written_again_changes_nothing(spark, tmp_path):
    children = store.Collection(spark, str(tmp_path / "c"))
    first, second = (spark.createDataFrame([(i, "s.pdf", i, "x" * 300)], PAGE) for i in (1, 2))
    ingest.ingest(first, children, batch_no=0)
    ingest.ingest(second, children, batch_no=1)
    before = sorted(map(tuple, children.read().collect()))
    ingest.ingest(second, children, batch_no=1)
    assert sorted(map(tuple, children.read().collect())) == before and len(before) == 4


def test_a_crash_in_an_upsert_loses_nothing(spark, tmp_path, monkeypatch):
    c = store.Collection(spark, str(tmp_path / "c"))
    c.add(spark.createDataFrame([("a", 1)], "id string, v int"))

    def crash(version):
        raise OSError("lost")

    monkeypatch.setattr(c, "_switch", crash)
    with pytest.raises(OSError, match="lost"):
        c.upsert(spark.createDataFrame([("a", 2)], "id string, v int"), "v")
    monkeypatch.undo()
    assert [tuple(r) for r in c.read().collect()] == [("a", 1)]
    c.upsert(spark.createDataFrame([("a", 3), ("b", 1)], "id string, v int"), "v")
    assert sorted(tuple(r) for r in c.read().collect()) == [("a", 3), ("b", 1)]


def test_hot_aware_join_keeps_rows(spark):
    rows = spark.range(2000).select(F.when(F.col("id") < 1500, 0).otherwise(F.col("id")).alias("k"), "id")
    groups = rows.groupBy("k").agg(F.count("*").alias("n"))
    assert attach_hot_aware(rows, groups, "k", "n", hot_groups=10).count() == 2000


def test_cut_lineage_uses_the_given_folder(spark):
    df = cut_lineage(spark.range(5))
    assert df.count() == 5 and spark.sparkContext._jsc.sc().getCheckpointDir().isDefined()


def test_contract():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert "default_qa" in entry.queries()


@pytest.mark.skipif(not __import__("os").path.isdir("/root/testdata/sf0.001"), reason="no test data")
def test_queries_run_against_sql(spark):
    import duckdb

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for p in __import__("pathlib").Path(d).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    from pigmenta.plans import registry

    for name in ("bm25_topk", "confidence", "sections_from_headings", "parent_child_chunks", "graph_khop", "metadata_lookup"):
        df = registry.QUERIES[name](spark, d)
        got = sorted(map(str, [tuple(r[c] for c in sorted(df.columns)) for r in df.collect()]))
        cur = con.execute(registry.SQL[name])
        cols = [x[0] for x in cur.description]
        want = sorted(map(str, [tuple(dict(zip(cols, r, strict=True))[c] for c in sorted(cols)) for r in cur.fetchall()]))
        assert got == want, name
    assert entry.entry(spark).count() >= 0
