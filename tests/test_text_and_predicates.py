import pytest
from pyspark.sql import functions as F

from pigmenta.functions import text as t
from pigmenta.functions import vectors as v
from pigmenta.operators import predicates as p


def one(spark, expr, value=None):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x")).alias("y")).first()["y"]


def test_strip_takes_unicode_space(spark):
    assert one(spark, t.strip, " \t a b\n ") == "a b"
    assert one(spark, t.strip, None) is None


def test_tokens_are_ascii_runs(spark):
    assert one(spark, t.tokens, "Çift Kat 12,5 boya") == ["ift", "kat", "12", "5", "boya"]


def test_sentences_keep_marks(spark):
    assert one(spark, t.sentences, " Bir. İki!  Üç? dört ") == ["Bir.", "İki!", "Üç?", "dört"]
    assert one(spark, t.sentences, "   ") == []


@pytest.mark.parametrize(("text", "value"), [("0,019", 0.019), ("0.019", 0.019), ("50", 50.0), ("x", None), (None, None)])
def test_number(spark, text, value):
    assert one(spark, t.number, text) == value


def test_plain_number(spark):
    rows = spark.createDataFrame([(5.0,), (2.5,), (None,)], "x double").select(t.plain_number(F.col("x")).alias("y")).collect()
    assert [r["y"] for r in rows] == ["5", "2.5", None]


def test_contains_token(spark):
    assert one(spark, lambda c: t.contains_token(c, "5"), "1, 5, 15") is True
    assert one(spark, lambda c: t.contains_token(c, "1.5"), "1, 5, 15") is False
    assert one(spark, lambda c: t.contains_token(c, "5"), None) is False


@pytest.mark.parametrize(("a", "b", "joined"), [("getiril-", "melidir", "getirilmelidir"), ("2020-", "yılı", "2020- yılı"), ("ön-", "Büyük", "ön- Büyük")])
def test_hyphen_join(spark, a, b, joined):
    assert spark.createDataFrame([(a, b)], "a string, b string").select(t.hyphen_joined(F.col("a"), F.col("b")).alias("y")).first()["y"] == joined


def test_similarity_is_clamped_and_keeps_null(spark):
    rows = spark.createDataFrame([(-0.5,), (0.25,), (3.0,), (None,)], "x double").select(v.similarity_of(F.col("x")).alias("y")).collect()
    assert [r["y"] for r in rows] == [1.0, 0.75, 0.0, None]


def test_cosine_of_zero_vector(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    assert df.select(v.cosine_distance(F.col("a"), F.col("b")).alias("y")).first()["y"] == 1.0


def test_where_builder():
    assert p.build_where({}) is None
    assert p.build_where({"a": 1, "b": None, "c": ""}) == {"a": {"$eq": 1}}
    assert p.build_where({"a": 1, "b": {"$gt": 2}}) == {"$and": [{"a": {"$eq": 1}}, {"b": {"$gt": 2}}]}


def test_where_absent_key_is_false_even_for_ne(spark):
    df = spark.createDataFrame([("x", 1), ("y", None), ("z", 3)], "id string, n int")
    ids = lambda c: [r["id"] for r in df.filter(p.where_column(c)).orderBy("id").collect()]
    assert ids({"n": {"$ne": 1}}) == ["z"]
    assert ids({"n": {"$gte": 1}}) == ["x", "z"]
    assert ids({"n": {"$unknown": 1}}) == []
    assert ids({"$and": [{"n": {"$gt": 1}}, {"id": "z"}]}) == ["z"]
    assert ids(None) == ["x", "y", "z"]


def test_where_reaches_the_scan(spark, tmp_path):
    spark.range(10).selectExpr("id", "named_struct('k', id) AS meta").write.parquet(str(tmp_path / "t"))
    plan = spark.read.parquet(str(tmp_path / "t")).filter(p.where_column({"id": {"$gt": 3}}))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(id,3)" in plan


