import pytest
from pyspark.sql import functions as F

from pigmenta.operators import chunking, graph
from pigmenta.plans import registry
from pigmenta.session import attach_asked, only_asked


def test_rows_of_what_was_found(spark):
    rows = spark.createDataFrame([(i, f"t{i}") for i in range(50)] + [(3, "again"), (None, "none")], "id long, text string")
    asked = spark.createDataFrame([(1, 3), (2, 3), (2, 7), (2, 99), (3, None)], "query_id long, id long")
    assert sorted((r["query_id"], r["text"]) for r in attach_asked(rows, asked, "id").collect()) == [(1, "again"), (1, "t3"), (2, "again"), (2, "t3"), (2, "t7")]
    assert sorted(r["text"] for r in only_asked(rows, asked, "id").collect()) == ["again", "t3", "t7"]


def test_first_of_a_key_without_moving_the_others(spark):
    rows = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 1, "z"), (None, 5, "v"), (None, 4, "w")], "k string, n int, t string")
    assert sorted(r["t"] for r in chunking.keep_first_in_place(rows, F.col("k"), ["n"]).collect()) == ["w", "y", "z"]
    assert chunking.keep_first_in_place(rows.filter("t > 'x'").filter("k is not null"), F.col("k"), ["n"])._jdf.queryExecution().executedPlan().toString().count("Exchange") == 0


def test_texts_of_chunks_and_parents_stay(spark, tmp_path):
    chunks = [(f"c{i}", f"p{i // 2}", f"w{i % 10} x", i, f"s{i}") for i in range(40)] + [("c1", "p0", "w1 x", 1, "s1")]
    spark.createDataFrame(chunks, "child_id string, parent_id string, text string, page_number int, source string").write.parquet(str(tmp_path / "child_chunks.parquet"))
    spark.createDataFrame([(f"p{i}", f"text of {i}") for i in range(20)], "parent_id string, text string").write.parquet(str(tmp_path / "parent_chunks.parquet"))
    spark.createDataFrame([(50, "w3 w3")], "id long, question string").write.parquet(str(tmp_path / "questions_df.parquet"))
    assert [r["context"] for r in registry.QUERIES["context_parent_child"](spark, str(tmp_path)).collect()] == ["\n\n".join(f"text of {i}" for i in (6, 11, 1, 16, 0))]
    flat = registry.QUERIES["context_flat"](spark, str(tmp_path))
    moved = [x for x in flat._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning(child_id" in x or "Exchange hashpartitioning(_key" in x]
    assert len(moved) <= 1 and flat.count() == 1  # only chunks whose id stands twice


def test_pairs_of_queries_and_sheets_are_not_moved(spark):
    """Two hundred queries, three of whose sheets lead to all of three hundred; one leads nowhere, one sheet is in no triple."""
    triples = spark.createDataFrame([(f"p{i}", "r", f"t{i % 3}", f"s{i}") for i in range(300)] + [("q", "r", None, "s999")], "subject string, relation string, object string, source_chunk string")
    seeds = [(q, f"s{q % 250}") for q in range(200)] + [(199, "s0"), (199, "s1"), (500, "other"), (None, "s0")]
    got = graph.graph_context(spark.createDataFrame(seeds, "query_id long, chunk string"), triples, 1)
    rows = [tuple(r) for r in got.collect()]
    kinds = {q: {int(s[1:]) % 3 for x, s in seeds if x == q and s != "other"} for q, _ in seeds}
    want = {(q, f"s{i}", "vector" if (q, f"s{i}") in seeds else "graph") for q in kinds for i in range(300) if i % 3 in kinds[q]} | {(500, "other", "vector")}
    assert len(rows) == len(set(rows)) and set(rows) == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(query_id" not in plan


def _folder_bytes(spark):
    from pathlib import Path

    set_up = spark.sparkContext._jsc.sc().getCheckpointDir()
    folder = Path(set_up.get().removeprefix("file:") if set_up.isDefined() else spark.conf.get("spark.checkpoint.dir"))
    return sum(p.stat().st_size for p in folder.rglob("*") if p.is_file())


def test_vectors_of_chunks_are_not_written(spark, tmp_path):
    vector = lambda i: [float((i * j) % 7 + 1) for j in range(64)]
    chunks = [(f"c{i}", f"p{i // 2}", f"w{i % 10} " + "x" * 300, i, vector(i)) for i in range(600)]
    spark.createDataFrame(chunks, "child_id string, parent_id string, text string, page_number int, embedding array<float>").write.parquet(str(tmp_path / "child_chunks.parquet"))
    spark.createDataFrame([(f"p{i}", f"text {i}", i) for i in range(300)], "parent_id string, text string, page_number int").write.parquet(str(tmp_path / "parent_chunks.parquet"))
    spark.createDataFrame([(50, "w3 w3"), (100, "w4")], "id long, question string").write.parquet(str(tmp_path / "questions_df.parquet"))
    spark.createDataFrame([(50, vector(3), 1)], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    before = _folder_bytes(spark)
    rows = registry.QUERIES["compare_modes"](spark, str(tmp_path)).collect()
    assert {(r["mode"], r["query_id"]): r["chunks"] for r in rows} == {(m, q): 5 for q in (50, 100) for m in ("hybrid", "hybrid_parent_child")} | {(m, 50): 5 for m in ("semantic", "semantic_parent_child")}
    assert _folder_bytes(spark) - before < 150_000


@pytest.mark.skipif(not __import__("os").path.isdir("/root/testdata/sf0.001"), reason="no test data")
def test_texts_are_taken_for_what_was_found(spark, tmp_path, monkeypatch):
    from pigmenta.operators import answers

    spark.createDataFrame([(i, f"w{i % 10} x", f"site{i % 4}") for i in range(60)], "doc_id long, text string, site string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(50, "w3 w3"), (100, "Alfa ile Beta arasındaki fark nedir?")], "id long, question string").write.parquet(str(tmp_path / "questions_df.parquet"))
    spark.createDataFrame([(i, [1.0 + i, 2.0], 1) for i in range(101)], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    answer = registry.QUERIES["default_qa"](spark, str(tmp_path))
    assert "Window" not in answer._jdf.queryExecution().executedPlan().toString() and answer.count() == 2
    properties = spark.read.parquet("/root/testdata/sf0.001/paint_properties.parquet").limit(2)
    named = properties.withColumns({"source": F.concat(F.lit("s"), F.monotonically_increasing_id()), "ürün_adı": F.element_at(F.array(F.lit("Alfa"), F.lit("Beta")), (F.monotonically_increasing_id() + 1).cast("int"))})
    named.coalesce(1).write.parquet(str(tmp_path / "paint_properties.parquet"))
    spark.createDataFrame([(f"p{i}", f"text {i}", f"s{i}") for i in range(50)], "parent_id string, text string, source string").write.parquet(str(tmp_path / "parent_chunks.parquet"))
    given = {}
    monkeypatch.setattr(answers, "representative", lambda df, key, order, real=answers.representative: given.update({key: df.count()}) or real(df, key, order))
    rows = {r["id"]: r for r in registry.QUERIES["routed_answers"](spark, str(tmp_path)).collect()}
    assert (rows[100]["intent"], rows[100]["answer"]) == ("comparison", "text 0\n\ntext 1") and given["source"] == 2
