import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pigmenta.operators import dense, fusion, graph, modes, sparse


def corpus(spark):
    return spark.createDataFrame([(1, "red paint dries fast"), (2, "blue paint"), (3, "wood stain dries"), (4, None), (5, "")], "id long, text string")


def okapi(docs, query, k1=1.5, b=0.75):
    tf = {i: Counter((t or "").split()) for i, t in docs}
    n, avgdl = len(docs), sum(sum(c.values()) for c in tf.values()) / len(docs)
    df = Counter(w for c in tf.values() for w in c)
    raw = {w: math.log(n - x + 0.5) - math.log(x + 0.5) for w, x in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {w: x if x >= 0 else 0.25 * mean for w, x in raw.items()}
    return {i: sum(idf[w] * c[w] * (k1 + 1) / (c[w] + k1 * (1 - b + b * sum(c.values()) / avgdl)) for w in query.split() if w in c) for i, c in tf.items()}


def test_bm25_against_formula(spark):
    docs = [(r["id"], r["text"]) for r in corpus(spark).collect()]
    q = spark.createDataFrame([(9, "paint dries paint")], "query_id long, query_text string")
    got = {r["id"]: r["score"] for r in sparse.sparse_top_k(sparse.build_index(corpus(spark)), q, 5).collect()}
    want = okapi(docs, "paint dries paint")
    assert got == {i: round(s, 6) for i, s in want.items()}


def test_bm25_zero_rows_fill_the_list(spark):
    q = spark.createDataFrame([(9, "nothing here")], "query_id long, query_text string")
    rows = sparse.sparse_top_k(sparse.build_index(corpus(spark)), q, 3).orderBy("rank").collect()
    assert [(r["id"], r["score"]) for r in rows] == [(1, 0.0), (2, 0.0), (3, 0.0)]


def test_bm25_filter_leaves_statistics(spark):
    q = spark.createDataFrame([(9, "paint")], "query_id long, query_text string")
    index = sparse.build_index(corpus(spark))
    everything = {r["id"]: r["score"] for r in sparse.sparse_top_k(index, q, 5).collect()}
    rows = corpus(spark).select("id", (F.col("id") == 2).alias("ok"))
    kept = sparse.sparse_top_k(index, q, 5, where=F.col("ok"), rows=rows).collect()
    assert [(r["id"], r["score"]) for r in kept] == [(2, everything[2])]


def test_dense_ties_nulls_and_where(spark):
    df = spark.createDataFrame([(3, [1.0, 0.0], "a"), (1, [2.0, 0.0], "a"), (2, [0.0, 1.0], "b"), (4, None, "a")], "id long, embedding array<float>, kind string")
    q = spark.createDataFrame([(7, [1.0, 0.0])], "query_id long, query_embedding array<float>")
    assert [r["id"] for r in dense.dense_top_k(df, q, 5).orderBy("rank").collect()] == [1, 3, 2]
    assert [r["id"] for r in dense.dense_top_k(df, q, 5, where=F.col("kind") == "b").collect()] == [2]


def lists(spark):
    d = spark.createDataFrame([(1, "a", 0.5, 1), (1, "b", 0.6, 2)], "query_id long, id string, distance double, rank int")
    s = spark.createDataFrame([(1, "b", 2.0, 1), (1, "c", 1.0, 2)], "query_id long, id string, score double, rank int")
    return d, s


def test_rrf_order(spark):
    rows = fusion.fuse(*lists(spark)).orderBy("rank").collect()
    assert [r["id"] for r in rows] == ["b", "a", "c"]
    assert abs(rows[0]["rrf"] - (1 / 62 + 1 / 61)) < 1e-8


def test_confidence_cases(spark):
    df = spark.createDataFrame([(1, "a", 0.5, 1.0), (1, "b", None, None), (1, "c", 0.9, None), (1, "d", None, 0.0)], "query_id long, id string, dense_distance double, sparse_score double")
    got = {r["id"]: (r["confidence"], r["confidence_label"]) for r in fusion.confident(df).collect()}
    assert got == {"a": (0.65, "high"), "b": (1.0, "high"), "c": (0.1, "drop"), "d": (0.0, "drop")}
    alike = df.filter("sparse_score is not null").withColumn("sparse_score", F.lit(2.0)).withColumn("dense_distance", F.lit(None).cast("double"))
    assert {r["confidence"] for r in fusion.confident(alike).collect()} == {1.0}


def test_best_per_parent(spark):
    df = spark.createDataFrame([(1, "a", "p", 1), (1, "b", "p", 2), (1, "c", "q", 3)], "query_id long, id string, parent string, rank int")
    assert [(r["id"], r["rank"]) for r in fusion.best_per_parent(df, F.col("parent"), 5).orderBy("rank").collect()] == [("a", 1), ("c", 2)]
    assert fusion.best_per_parent(df, F.col("parent"), 0).count() == 2


def test_evidence_keeps_first_copy(spark):
    df = spark.createDataFrame([(2, ["x", " y ", None, ""]), (1, ["x"]), (1, ["x"]), (3, None)], "id long, evidence array<string>")
    rows = sorted((r["source_question_id"], r["content"]) for r in graph.evidence_corpus(df).collect())
    assert rows == [(1, "x"), (2, "y")]


def test_expand_bounds_hops(spark):
    t = spark.createDataFrame([("a", "r", "b", "c1"), ("b", "r", "c", "c2"), ("c", "r", "d", "c3")], "subject string, relation string, object string, source_chunk string")
    seeds = spark.createDataFrame([("q", "a"), ("q", "unknown")], "seed_key string, entity string")
    got = {(r["entity"], r["hop"]) for r in graph.expand(seeds, graph.edges(t), 2).collect()}
    assert got == {("a", 0), ("unknown", 0), ("b", 1), ("c", 2)}
    chunks = spark.createDataFrame([("q", "c1")], "query_id string, chunk string")
    assert {(r["chunk"], r["via"]) for r in graph.graph_context(chunks, t, 1).collect()} == {("c1", "vector"), ("c2", "graph"), ("c3", "graph")}


def test_centroid_and_projection(spark):
    df = spark.createDataFrame([(1, "k", [1.0, 0.0, 0.0]), (2, "k", [0.0, 1.0, 0.0]), (3, "k", [0.0, 0.0, 1.0])], "id long, label string, embedding array<float>")
    assert [round(x, 6) for x in dense.centroids(df, "label").first()["centroid"]] == [0.333333] * 3
    assert len(dense.project(df).first()["components"]) == 2


def test_graph_rag_follows_edges_from_the_retrieved_chunks(spark, tmp_path):
    import duckdb

    from pigmenta.plans import registry

    sheets = [("P1", "mat", None, "s1"), ("P2", "mat", "iç", "s2"), ("P3", "saten", "iç", "s3"), ("P3", None, "dış", "s4"), ("P4", "parlak", "dış", "s5"), ("P5", None, None, "s6")]
    chunks = [(f"c{i}{j}", f"{w} text {j}", f"s{i}") for i, w in enumerate(("alfa", "beta", "gama", "delta", "epsilon", "zeta", "eta"), 1) for j in range(3)]
    tables = {
        "paint_properties": spark.createDataFrame(sheets, "`ürün_adı` string, doku string, `kullanım_alanı` string, source string"),
        "child_chunks": spark.createDataFrame([(i, "p" + i, t, 1, s) for i, t, s in chunks], "child_id string, parent_id string, text string, page_number int, source string"),
        "parent_chunks": spark.createDataFrame([], "parent_id string, text string"),
        "questions_df": spark.createDataFrame([(50, "alfa"), (100, "epsilon"), (150, "zeta"), (200, "eta"), (201, "beta")], "id long, question string"),
    }
    con = duckdb.connect()
    for name, df in tables.items():
        df.coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    triples = [(p, o, s) for p, doku, use, s in sheets for o in (doku, use) if o]
    want = set()
    for query, seed in ((50, "s1"), (100, "s5"), (150, "s6"), (200, "s7")):
        entities = {e for p, o, s in triples if s == seed for e in (p, o)}
        entities |= {e for p, o, _ in triples for e, other in ((p, o), (o, p)) if other in entities}
        want |= {(query, s, "graph") for p, o, s in triples if s != seed and {p, o} & entities} | {(query, seed, "vector")}
    assert (50, "s3", "graph") not in want and (100, "s3", "graph") in want  # two edges away, one edge away
    got = [(r["query_id"], r["chunk"], r["via"]) for r in registry.QUERIES["graph_rag"](spark, str(tmp_path)).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert set(con.execute(registry.SQL["graph_rag"]).fetchall()) == want


def test_dense_against_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(f"r{i:03d}", [float(x) for x in rng.normal(size=4)]) for i in range(120)] + [("n1", None), ("n2", [1.0]), ("n3", [None, 1.0, 1.0, 1.0]), ("n4", [math.nan, 1.0, 1.0, 1.0]), ("z", [0.0] * 4)]
    df = spark.createDataFrame(rows, "id string, embedding array<double>").repartition(5)
    asked = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(3)] + [(8, [2.0]), (9, None)]
    q = spark.createDataFrame(asked, "query_id int, query_embedding array<double>")
    for metric, distance in (("cosine", lambda a, b: 1 - a @ b / (np.linalg.norm(a) * np.linalg.norm(b) + 1e-10)), ("l2", lambda a, b: ((a - b) ** 2).sum()), ("ip", lambda a, b: 1 - a @ b)):
        got = {(r["query_id"], r["rank"]): (r["id"], r["distance"]) for r in dense.dense_top_k(df, q, 6, metric=metric).collect()}
        for query_id, vector in asked[:3]:
            known = [(i, np.array(v)) for i, v in rows if v is not None and len(v) == 4 and None not in v and not any(map(math.isnan, v))]
            want = sorted((round(float(distance(np.array(vector), v)), 6), i) for i, v in known)[:6]
            assert [got[query_id, n + 1][0] for n in range(6)] == [i for _, i in want]
            assert [got[query_id, n + 1][1] for n in range(6)] == pytest.approx([d for d, _ in want], abs=2e-6)
        assert {k for k in got if k[0] == 8} == {(8, 1)} and not {k for k in got if k[0] == 9}
    assert dense.dense_top_k(df.limit(0), q, 3).count() == 0 and dense.dense_top_k(df, q.limit(0), 3).count() == 0


def test_modes(spark):
    near = spark.createDataFrame([(1, "a", 0.1, 1), (1, "b", 0.2, 2), (1, "c", 0.3, 3)], "query_id int, id string, distance double, rank int")
    terms = spark.createDataFrame([(1, "c", 9.0, 1), (1, "d", 8.0, 2), (2, "d", 1.0, 1)], "query_id int, id string, score double, rank int")
    chunks = spark.createDataFrame([("a", "p", 1), ("b", "p", 2), ("c", "q", None), ("d", "gone", 4)], "id string, parent_id string, page_number int")
    parents = spark.createDataFrame([("p", 1), ("q", 7)], "parent_id string, page_number int")
    got = {(r["mode"], r["query_id"]): (r["pages"], r["chunks"]) for r in modes.mode_report(near, terms, chunks, parents, 2).collect()}
    assert got == {
        ("semantic", 1): ([1, 2], 2), ("semantic_parent_child", 1): ([1], 2), ("hybrid", 1): ([0, 1], 2), ("hybrid_parent_child", 1): ([1, 7], 2), ("hybrid", 2): ([4], 1), ("hybrid_parent_child", 2): ([], 1),
    }
    with pytest.raises(ValueError, match="unknown mode"):
        modes.run_mode("both", near, terms, 2)
