import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pigmenta.operators import chunking as c


def pieces(spark, text, size, overlap):
    return spark.createDataFrame([(text,)], "text string").select(c.sliding_pieces(F.col("text"), size, overlap).alias("p")).first()["p"]


def test_sliding_offsets(spark):
    assert pieces(spark, "abcdefghij", 5, 2) == ["abcde", "defgh", "ghij", "j"]
    assert not pieces(spark, "", 5, 2)
    assert pieces(spark, "   ", 5, 2) == []
    assert pieces(spark, None, 5, 2) is None
    with pytest.raises(ValueError, match="overlap"):
        pieces(spark, "x", 5, 5)


@settings(max_examples=40, deadline=None)
@given(st.text("ab \n.", max_size=200), st.integers(5, 40), st.integers(0, 4))
def test_recursive_pieces_fit_and_keep_all(text, size, overlap):
    out = c.split_recursively(text, size, overlap)
    assert all(0 < len(p) <= size for p in out)
    assert set("".join(text.split())) == set("".join("".join(out).split()))


def test_recursive_prefers_paragraphs():
    assert c.split_recursively("aaa bbb\n\nccc ddd", 8, 0) == ["aaa bbb", "ccc ddd"]
    assert c.split_recursively("aaaaaa", 4, 1) == ["aaaa", "aaa"]


def test_constrain_sizes():
    assert c.constrain_sizes(["a" * 150, "b" * 100, "c" * 20], 200, 1800) == ["a" * 150 + " " + "b" * 100 + " " + "c" * 20]
    assert c.constrain_sizes(["a"], 200, 1800) == ["a"]
    assert c.constrain_sizes([], 200, 1800) == []
    out = c.constrain_sizes(["x" * 4000], 200, 1800, 100)
    assert [len(p) for p in out] == [1800, 1800, 600]


def test_constrain_sizes_with_boundaries():
    assert c.constrain_sizes(["a" * 10, "b" * 300, "c" * 10], 200, 1800, boundaries=[True, True, True]) == ["a" * 10, "b" * 300 + " " + "c" * 10]
    assert c.constrain_sizes(["a" * 10, "b" * 300, "c" * 10], 200, 1800, boundaries=[True, True, True], strict_tail=True)[-1] in ("c" * 10, "b" * 300 + " " + "c" * 10)


def test_merge_short():
    assert c.merge_short(["a b", "c " * 20, "d"], 15) == ["a b", "c " * 20 + " d"]


def test_parent_child_ids_run_over_pages(spark):
    pages = spark.createDataFrame([("s.pdf", 1, 11, "x" * 30), ("s.pdf", 3, 12, "y" * 10), ("s.pdf", 2, 13, None), ("t.pdf", 1, 14, " ")], "source string, page_number int, page_id long, text string")
    rows = c.parent_child(pages, 20, 0, 10, 0).orderBy("child_no").collect()
    assert [(r["parent_id"], r["child_id"], r["chunk_index"], r["chunk_length"]) for r in rows] == [
        ("s_parent_0", "s_child_0", 0, 10), ("s_parent_0", "s_child_1", 1, 10), ("s_parent_1", "s_child_2", 0, 10), ("s_parent_2", "s_child_3", 0, 10),
    ]


def test_keep_first_and_clashing_columns(spark):
    df = spark.createDataFrame([("b", "x", 1), ("a", "x", 2), ("c", None, 3), ("d", None, 4)], "id string, text string, rank int")
    assert sorted(r["id"] for r in c.keep_first(df, F.col("text"), ["id"]).collect()) == ["a", "c"]


def test_semantic_groups_break_strictly(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([[1.0, 0.0], [1.0, 0.0], [0.0, 1.0], [0.0, 1.0]])], "k int, n int, e array<float>")
    rows = c.semantic_groups(df, ["k"], "e", "n", 0.5).orderBy("n").collect()
    assert [r["group_no"] for r in rows] == [0, 0, 1, 1]
    same = spark.createDataFrame([(1, i, [1.0]) for i in range(3)], "k int, n int, e array<float>")
    assert {r["group_no"] for r in c.semantic_groups(same, ["k"], "e", "n").collect()} == {0}


def test_structural_units(spark):
    df = spark.createDataFrame([(1, "# Baş\nmetin\n \n1.2 Konu\n\nKISA BASLIK\n\n\ndüz metin\n\nKISA BAŞLIK")], "id int, text string")
    rows = c.structural_units(df, ["id"]).orderBy("unit_no").collect()
    assert [r["is_heading"] for r in rows] == [True, True, True, False, False]  # capitals are those of ASCII


def test_neighbourhood_is_clipped(spark):
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate("abc")], "k int, n int, s string")
    assert [r["neighbourhood"] for r in c.neighbourhoods(df, ["k"], "s", "n").orderBy("n").collect()] == ["a b", "a b c", "b c"]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "source string, page_number int, page_id long, text string")
    assert c.parent_child(empty).count() == 0
    assert c.structural_units(empty, ["page_id"]).count() == 0


def test_semantic_and_hybrid_chunks(spark):
    from pigmenta.operators import semantic

    text = "# Baş\n\n" + "Boya kurur. Boya sürülür. Kedi uyur. Köpek koşar. " * 12 + "\n\nkısa"
    df = spark.createDataFrame([(1, text), (2, ""), (3, "tek cümle")], "id int, text string")
    got = {}
    for r in semantic.semantic_text_chunks(df, ["id"]).orderBy("chunk_no").collect():
        got.setdefault(r["id"], []).append(r["chunk"])
    assert set(got) == {1, 3} and all(len(c) <= 1800 for cs in got.values() for c in cs)
    assert "".join(" ".join(got[1]).split()) == "".join(text.split())
    hybrid = [r["chunk"] for r in semantic.hybrid_chunks(df.filter("id = 1"), ["id"]).orderBy("chunk_no").collect()]
    assert hybrid[0].startswith("# Baş") and hybrid[-1].endswith("kısa")
    parents = df.withColumnRenamed("id", "parent_id")
    assert {r["parent_id"] for r in semantic.semantic_children(parents).collect()} == {1, 3}


def test_totals_before_over_a_hot_group(spark):
    from pigmenta.session import totals_before

    rows = spark.range(1000).select(F.when(F.col("id") < 900, F.lit("hot")).otherwise(F.lit(None)).alias("g"), "id", F.lit(1).alias("n"))
    got = totals_before(rows, ["g"], ["id"], ["n"])
    assert got.count() == 1000
    assert got.filter("n_before <> case when id < 900 then id else id - 900 end").count() == 0


def test_structural_ids_leave_gaps(spark):
    sections = spark.createDataFrame([("d", 1, "H", "aynı metin"), ("d", 2, "I", "aynı metin"), ("d", 3, None, "başka")], "doc_id string, section_no int, heading string, text string")
    rows = c.structural_parent_child(sections).orderBy("child_no").collect()
    assert [(r["parent_id"], r["child_id"], r["content"]) for r in rows] == [("p0", "c0", "aynı metin"), ("p2", "c2", "başka")]
