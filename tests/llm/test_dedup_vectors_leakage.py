import itertools
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pigmenta.llm import leakage as le
from pigmenta.llm import nested_dedup as nd
from pigmenta.llm import permutation_index as pi

CONTENT = "key string, content string"


def groups(spark, rows):
    return sorted((r["representative"], r["key"]) for r in nd.copies_of(spark.createDataFrame(rows, CONTENT)).collect())


def test_layouts_of_one_record(spark):
    rows = [
        ("a", "Ürün: Silka Mat; Ambalaj: 2,5 L; İnceltme: %5"), ("b", "AMBALAJ = 2,5 l | ÜRÜN = SİLKA MAT | inceltme = %5"), ("c", '{"İnceltme": "%5", "Ürün": "Silka  Mat", "Ambalaj": "2,5 L"}'),
        ("d", "Ürün : Silka Mat\nİnceltme : %5\nAmbalaj : 2,5 L"), ("e", "Ürün: Silka Mat • Ambalaj: 2,5 L • İnceltme: 5"), ("f", "Ürün: 2,5 L; Ambalaj: Silka Mat; İnceltme: %5"), ("g", "Ürün: Silka Mat; Ambalaj: 25 L; İnceltme: %5"),
    ]
    assert groups(spark, rows) == [("a", "b"), ("a", "c"), ("a", "d")]


def test_deep_nesting_is_text(spark):
    deep = "[" * 50_000 + "]" * 50_000
    some = '{"a": ' * 300 + '"x"' + "}" * 300
    rows = [("1", deep), ("2", deep + " "), ("3", some), ("4", some.upper()), ("5", "[" * 90 + '"b"' + "]" * 90), ("6", " " + "[" * 90 + '"B"' + "]" * 90)]
    assert groups(spark, rows) == [("1", "2"), ("3", "4"), ("5", "6")]


def test_fields_by_tab_and_comma(spark):
    rows = [("1", "Ürün: Silka Mat, Ambalaj: 2,5 L"), ("2", "Ambalaj: 2,5 L\tÜrün: Silka Mat"), ("3", "Ambalaj: 2,5 L; Ürün: Silka Mat"), ("4", "Ürün: Silka, Mat ve parlak")]
    assert groups(spark, rows) == [("1", "2"), ("1", "3")]


def test_texts_by_words_in_order(spark):
    rows = [("1", "Kuruma 6-7 saat sürer."), ("2", "  KURUMA   6-7 saat,\nsürer!"), ("3", "kuruma 67 saat sürer"), ("4", "saat kuruma 6-7 sürer"), ("5", "Isı +5"), ("6", "ısı 5"), ("7", "ISI: +5"), ("8", None), ("9", None)]
    assert groups(spark, rows) == [("1", "2"), ("5", "7")]


def test_empty_repeated_and_hot(spark):
    assert groups(spark, []) == []
    rows = [(f"{i:04d}", "aynı metin") for i in range(500)] + [("x", ""), ("y", " ... ")]
    got = groups(spark, rows)
    assert len(got) == 500 and ("x", "y") in got and all(a == "0000" for a, b in got if a != "x")
    records = {r["representative"]: r["copies"] for r in nd.collapse(spark.createDataFrame(rows, CONTENT)).collect()}
    assert records == {"0000": 500, "x": 2}


def test_collisions_are_taken_apart(spark, monkeypatch):
    monkeypatch.setattr(nd, "_digest", lambda kind, parts: b"same")
    rows = [("1", "a b"), ("2", "A  b."), ("3", "c"), ("4", "C"), ("5", "d")]
    assert groups(spark, rows) == [("1", "2"), ("3", "4")]


def test_nested_json():
    a = nd.merkle(nd.parse('{"x": {"p": "1", "q": ["a", "b"]}, "y": null}'))
    assert a == nd.merkle(nd.parse('{"y": "", "x": {"q": ["A", "B."], "p": 1}}'))
    assert a != nd.merkle(nd.parse('{"y": "", "x": {"q": ["b", "a"], "p": 1}}'))


def test_json_numbers_repeated_names_and_one_field(spark):
    rows = [
        ("a", '{"a": 1.50, "b": "x"}'), ("b", "a: 1.50; b: x"), ("c", '{"b": "x", "a": 1.5}'), ("d", '{"n": "p", "n": "q", "m": 1}'), ("e", '{"n": "r", "n": "q", "m": 1}'), ("f", "m: 1 | n: q | n: p"),
        ("g", '{"Sarfiyat": 10}'), ("h", "SARFİYAT : 10"), ("i", "sarfiyat 10"), ("j", '{"Sarfiyat": 11}'), ("k", '{"x": {"y": 1}}'), ("l", '{"x": ["y", 1]}'), ("m", "[]"), ("n", "{}"),
    ]
    assert groups(spark, rows) == [("a", "b"), ("d", "f"), ("g", "h"), ("g", "i")]


# Vectors.


def brute(vectors, k):
    ids = sorted(vectors)
    m = np.array([vectors[i] for i in ids], dtype=np.float64)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    out = set()
    for i, a in enumerate(ids):
        order = sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-round(float(m[i] @ m[j]), 6), ids[j]))
        out |= {(a, ids[j]) for j in order[:k]}
    return out


def clustered(n, d, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(max(2, n // 40), d))
    x = centres[rng.integers(0, len(centres), n)] + 0.25 * rng.normal(size=(n, d))
    return {f"v{i:05d}": [float(v) for v in np.float32(r)] for i, r in enumerate(x)}


def table(spark, vectors):
    return spark.createDataFrame(list(vectors.items()), "id string, vector array<float>")


def test_recall_against_brute_force(spark):
    v = clustered(1500, 16)
    got = {(r["id"], r["neighbour"]) for r in pi.most_similar(table(spark, v), 16, pi.IndexSettings(sample=600)).collect()}
    want = brute(v, 10)
    assert len(got & want) / len(want) >= 0.9


def with_blob(n, d, seed):
    rng = np.random.default_rng(seed)
    blob = rng.normal(size=d) + 0.3 * rng.normal(size=(n // 3, d))
    return clustered(n - n // 3, d, seed) | {f"b{i:05d}": [float(v) for v in np.float32(r)] for i, r in enumerate(blob)}


def test_regions_are_divided_and_keep_recall(spark):
    """Many more vectors than outer pivots can share out, a third of them in one cluster: as with 10^9 and the defaults."""
    v = with_blob(1800, 16, seed=3)
    s = pi.IndexSettings(sample=200, max_pivots=8, region=300, file=128, rerank=100)
    rows = table(spark, v)
    regions, divided = pi.region_rows(rows, len(v), 16, s)
    sizes = {r["file"]: r["count"] for r in regions.groupBy("file").count().collect()}
    assert divided and max(sizes.values()) <= s.region and regions.filter("is_query").select("id").distinct().count() == len(v)
    found = {(r["id"], r["neighbour"]) for r in pi.most_similar(rows, 16, s).collect()}
    want = brute(v, 10)
    assert len(found & want) / len(want) >= 0.9
    inside = {p for p in want if p[0][0] == "b"}
    assert len(found & inside) / len(inside) >= 0.85  # a cluster without structure in it is the hardest case


def test_footrule_decides_which_candidates_are_kept():
    """Of a small region too: what footrule leaves out is not reranked, so a neighbour far by order is missed."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 32)).astype(np.float32)
    ids = np.array([f"{i:03d}" for i in range(200)])
    kept = pi.search_region(ids, x, np.ones(200, dtype=bool), pi.IndexSettings(rerank_share=0.3))
    every = pi.search_region(ids, x, np.ones(200, dtype=bool), pi.IndexSettings(rerank_share=1.0))
    got, want = set(zip(*kept[:2], strict=True)), set(zip(*every[:2], strict=True))
    assert len(want) == 2000 and 0.4 < len(got & want) / len(want) < 1


@pytest.mark.parametrize("copies", [19, 20, 21, 40])
def test_rows_do_not_depend_on_being_a_crowd(spark, copies):
    v = {f"c{i:03d}": [float(np.float32(x * (i % 3 + 1))) for x in (1.0, 0.0, 0.5)] for i in range(copies)} | clustered(30, 3) | {"a": [10.0, 0.0, 5.0]}
    got = {(r["id"], r["neighbour"]) for r in pi.most_similar(table(spark, v), 3, pi.IndexSettings(crowd=20, rerank_share=1.0, vectors_a_pivot=100)).collect()}
    assert got == brute(v, 10)


def test_small_table_is_exact_and_unusable_rows_take_no_part(spark):
    v = clustered(15, 4, seed=1)
    bad = [("n", None), ("z", [0.0] * 4), ("s", [1.0]), ("q", [math.nan, 1.0, 1.0, 1.0]), ("i", [math.inf, 1.0, 1.0, 1.0]), ("e", [None, 1.0, 1.0, 1.0]), (None, [1.0] * 4)]
    df = table(spark, v).unionByName(spark.createDataFrame(bad, "id string, vector array<float>"))
    df = df.unionByName(df.limit(5))
    assert {(r["id"], r["neighbour"]) for r in pi.most_similar(df, 4).collect()} == brute(v, 10)
    assert pi.most_similar(df.limit(0), 4).count() == 0
    assert pi.most_similar(df.filter("id = 'v00000'"), 4).count() == 0


def test_ties_go_to_the_smaller_id(spark):
    v = {f"c{i:02d}": [1.0, 0.0] for i in range(14)} | {"a": [0.9, 0.1]}
    got = {(r["id"], r["neighbour"]) for r in pi.most_similar(table(spark, v), 2).collect()}
    assert got == brute(v, 10)


def test_crowd_of_copies(spark):
    v = {f"c{i:03d}": [1.0, 0.0, 0.5] for i in range(60)} | clustered(40, 3)
    got = {(r["id"], r["neighbour"]) for r in pi.most_similar(table(spark, v), 3, pi.IndexSettings(crowd=20, rerank_share=1.0, vectors_a_pivot=100)).collect()}
    assert got == brute(v, 10)


def test_one_id_with_two_vectors_counts_once(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0]), ("a", [0.0, 1.0]), ("b", [1.0, 0.1]), ("c", [0.1, 1.0])], "id string, vector array<float>")
    rows = pi.most_similar(df, 2).collect()
    assert sorted((r["id"], r["neighbour"]) for r in rows) == [("a", "b"), ("a", "c"), ("b", "a"), ("b", "c"), ("c", "a"), ("c", "b")]


def test_nothing_is_missed_where_footrule_leaves_out(spark):
    """The bounds of a weak index, and none at all, give the rows of brute force; a ball without structure in many blocks too."""
    v = with_blob(1800, 16, seed=5)
    want = brute(v, 10)
    for s in (
        pi.IndexSettings(rerank_share=0.1, probes=1, posts=1),
        pi.IndexSettings(sample=200, max_pivots=8, region=300, file=128, rerank=100, block=60),
        pi.IndexSettings(sample=100, centres=3, rerank_share=0.1, block=500),
    ):
        rows = pi.most_similar(table(spark, v), 16, s).collect()
        assert len(rows) == len(want) and {(r["id"], r["neighbour"]) for r in rows} == want


@pytest.mark.skipif(not __import__("os").path.isdir("/root/testdata/sf0.01"), reason="no test data")
def test_rows_of_a_whole_table_are_those_of_the_sql(spark):
    import duckdb

    from pigmenta.llm import queries, sql

    d = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW child_chunks AS SELECT * FROM '{d}/child_chunks.parquet'")
    want = con.execute(sql.SQL["p4_found"]).fetchall()
    got = [tuple(r) for r in queries.p4_found(spark, d).collect()]
    assert len(got) == len(want) and set(got) == set(want)


def of_sql(spark, folder, vectors):
    """(rows of p4_found, rows of its SQL) over vectors of 64 elements."""
    import duckdb
    import pyarrow as pa
    import pyarrow.parquet as pq

    from pigmenta.llm import queries, sql

    embedding = pa.array([[float(x) for x in v] for v in vectors.values()], pa.list_(pa.float32()))
    pq.write_table(pa.table({"child_id": pa.array(list(vectors)), "embedding": embedding}), folder / "child_chunks.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW child_chunks AS SELECT * FROM '{folder}/child_chunks.parquet'")
    return sorted(tuple(r) for r in queries.p4_found(spark, str(folder)).collect()), sorted(con.execute(sql.SQL["p4_found"]).fetchall())


def test_ids_that_end_in_nul_are_ids(spark, tmp_path):
    v = dict(zip(["", "\0", "a", "a\0", "a\0\0", "é", "\uffee", "\U0001f600"], np.ones((8, 64)), strict=True))
    got, want = of_sql(spark, tmp_path, v | {f"k{i}": x for i, x in enumerate(np.eye(64)[:20] + 0.1)})
    assert got == want and ("a", "a\0") in want


def test_halves_are_rounded_as_in_the_sql(spark, tmp_path):
    """Whole numbers with 128 as sum of squares have cosines of n / 128, which end in a half after 6 decimals."""
    rng = np.random.default_rng(1)
    v = {}
    while len(v) < 500:
        x = rng.choice([-2, -1, 0, 1, 2], size=64, p=[0.2, 0.2, 0.1, 0.2, 0.3])
        if (x * x).sum() == 128 or len(v) % 2 and rng.random() < 0.02:
            v[f"v{len(v):05d}"] = x
    got, want = of_sql(spark, tmp_path, v)
    assert got == want
    x, y = np.array([2.0] * 31 + [1.0] * 4 + [0.0] * 29), np.array([2.0] * 31 + [0.0] * 3 + [1.0] * 4 + [0.0] * 26)
    assert pi.cosines(np.array([x, -x, 3 * x]), np.array([y, y, y])).tolist() == [0.976563, -0.976563, 0.976563]  # 125 / 128 is 0.9765625


@pytest.mark.parametrize("crowd", [20, 1000])
@pytest.mark.parametrize("noise", [0.0, 1e-7, 1e-5])
def test_crowd_of_about_one_direction(spark, crowd, noise):
    """Its members differ in what they are near to, and others in which of them they are near to."""
    rng = np.random.default_rng(3)
    c = np.round(1e4 * pi.unit_rows(rng.normal(size=(1, 64)))[0].astype(float)) / 1e4
    x = np.vstack([c + noise * rng.uniform(-1, 1, size=(90, 64)), c + 2e-5 * rng.normal(size=(30, 64)), c + 0.01 * rng.normal(size=(60, 64))])
    x[:30] *= 2.0 ** rng.integers(-9, 9, size=(30, 1))
    v = {f"v{i:03d}": [float(e) for e in np.float32(r)] for i, r in zip(rng.permutation(180), x, strict=True)}
    rows = pi.most_similar(table(spark, v), 64, pi.IndexSettings(crowd=crowd, block=50)).collect()
    assert len(rows) == 1800 and {(r["id"], r["neighbour"]) for r in rows} == brute(v, 10)


def test_search_stops_where_k_are_alike():
    rng = np.random.default_rng(6)
    x = np.vstack([np.ones((3000, 8)) + 1e-3 * rng.normal(size=(3000, 8)) * (np.arange(3000)[:, None] % 3 > 0), rng.normal(size=(3000, 8))])[rng.permutation(6000)].astype(np.float32)
    units, every = pi.unit_rows(x), np.arange(6000)
    q, c, similarity = pi._best_by_bound(units, x, every[::40], every, np.full(6000, -1.0), 10, {})
    got = set(zip(q.tolist(), c.tolist(), strict=True))
    for i in every[::40].tolist():
        exact = pi.cosines(np.repeat(x[i : i + 1], 6000, axis=0), x)
        best = [j for j in np.lexsort((every, -exact)).tolist() if j != i][:10]
        assert {j for a, j in got if a == i} == set(best)


def test_shapeless_vectors_and_few_of_them(spark):
    rng = np.random.default_rng(8)
    for n, d in ((700, 6), (9, 6), (2, 3)):
        v = {f"v{i:04d}": [float(x) for x in np.float32(r)] for i, r in enumerate(rng.normal(size=(n, d)))}
        got = pi.most_similar(table(spark, v), d, pi.IndexSettings(rerank_share=0.1, block=50)).collect()
        assert {(r["id"], r["neighbour"]) for r in got} == brute(v, 10) and len(got) == n * min(10, n - 1)


def test_centres_by_way_of_others_are_near():
    rng = np.random.default_rng(4)
    centres = pi.unit_rows(rng.normal(size=(3000, 64)))
    x = pi.unit_rows(centres[rng.integers(0, 3000, 500)] + 0.05 * rng.normal(size=(500, 64)))
    index = pi.Centres.of(centres)
    assert index.coarse and (index.near(x, 0.8)[0] == index.nearest(x)[0]).all()
    far = pi.unit_rows(rng.normal(size=(50, 64)))
    assert (index.near(far, 0.8)[0] == index.nearest(far)[0]).all()


@settings(max_examples=50, deadline=None)
@given(st.permutations(range(6)), st.permutations(range(6)), st.integers(1, 5))
def test_footrule(a, b, length):
    a, b = a[:length], b[:length]
    place = lambda x, p: x.index(p) if p in x else length
    distance = sum(abs(place(a, p) - place(b, p)) for p in set(a) | set(b))
    most = length * (length + 1)
    got = int(pi.footrule_similarity(np.array([a], dtype=np.uint16), np.array([b], dtype=np.uint16))[0, 0])
    assert distance == most - 2 * got


# Leakage.


def longest_run(a, b):
    return max((k for i, j in itertools.product(range(len(a)), range(len(b))) for k in range(1, min(len(a) - i, len(b) - j) + 1) if a[i : i + k] == b[j : j + k]), default=0)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=14), st.lists(st.integers(0, 3), max_size=18))
def test_tiles(item, doc):
    doc = [-1 if x == 3 else x for x in doc]
    tiles = le.greedy_tiles(item, doc, 2)
    used_i, used_d = set(), set()
    for i, j, k in tiles:
        assert item[i : i + k] == doc[j : j + k] and k >= 2
        assert not used_i & set(range(i, i + k)) and not used_d & set(range(j, j + k))
        used_i |= set(range(i, i + k))
        used_d |= set(range(j, j + k))
    run = longest_run(item, doc)
    assert max((k for *_, k in tiles), default=0) == (run if run >= 2 else 0)


def test_leaks_in_blocks(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(400)]
    items = {i: " ".join(rng.choices(words, k=30)) for i in range(20)}
    w = items[3].split()
    docs = [(1, "önce " + items[0].upper() + " sonra"), (2, " ".join(w[:11]) + " x"), (3, "> " + "\n> ".join(f"«{x}»," for x in w[5:17])), (4, None), (5, ""), (6, " ".join(w[15:]) + " y " + " ".join(w[:15]))]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    e = spark.createDataFrame([*items.items(), (99, None), (98, "çok kısa")], "item_id long, text string")
    for size in (le.BLOCK_BYTES, 200):
        found = le.leaks(d, e, block_bytes=size)
        assert sorted((r["doc_id"], r["item_id"]) for r in le.leaked_passages(found).collect()) == [(1, 0), (3, 3), (6, 3)]
        cover = {(r["doc_id"], r["item_id"]): r["coverage"] for r in le.leaked_coverage(found).collect()}
        assert cover == {(1, 0): 1.0, (6, 3): 1.0}
    assert le.leaks(d.limit(0), e).count() == 0 and le.leaks(d, e.limit(0)).count() == 0
