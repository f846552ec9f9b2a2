"""Cases worked by hand from the rules, for operators that SQL cannot express: the SQL states what must come out."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pigmenta.operators import chunking, intent, layout

SQL: dict[str, str] = {}


def _values(rows: list[tuple], columns: str) -> str:
    literal = lambda x: "NULL" if x is None else f"'{x.replace(chr(39), chr(39) * 2)}'" if isinstance(x, str) else str(x)
    return f"(VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) v({columns})"


# Pages: lines of (x, y, size, bold words from the left, text), and the text in reading order.
PAGES = [
    ([(0, 0, 14, 1, "UYGULAMA"), (0, 30, 10, 0, "Boya iki kat"), (0, 42, 10, 0, "sürülür.")], "## UYGULAMA\nBoya iki kat sürülür."),
    ([(0, 0, 10, 0, "SARFİYAT:"), (0, 30, 10, 0, "Bir litre yeter.")], "## SARFİYAT:\nBir litre yeter."),  # capitals and a colon make up for what isn't bold
    ([(0, 0, 10, 0, "Sarfiyat:"), (0, 30, 10, 0, "Bir litre yeter.")], "Sarfiyat:\nBir litre yeter."),
    ([(0, 0, 10, 1, "TEKNİK bilgi"), (0, 30, 10, 0, "metin burada.")], "TEKNİK bilgi\nmetin burada."),  # half bold isn't bold
    ([(0, 0, 10, 3, "demir-çelik-sac yü-"), (0, 12, 10, 2, "zeylerde uygulama:"), (0, 40, 10, 0, "İki kat sürülür.")], "## demir-çelik-sac yüzeylerde uygulama:\nİki kat sürülür."),
    ([(0, 0, 10, 2, "Cam ve Seramik"), (0, 12, 10, 2, "Yüzeylerde Uygulama:"), (0, 40, 10, 0, "İki kat.")], "## Cam ve Seramik Yüzeylerde Uygulama:\nİki kat."),  # two thirds bold: 3 + 2 + 2 + 1 - 2
    ([(0, 0, 10, 3, "Cam ve Seramik"), (0, 12, 10, 2, "Yüzeylerde Uygulama:"), (0, 40, 10, 0, "İki kat.")], "## Cam ve Seramik Yüzeylerde Uygulama:\nİki kat."),
    ([(0, 0, 10, 0, "sol"), (200, 0, 10, 0, "sağ"), (0, 12, 10, 0, "alt"), (200, 12, 10, 0, "son")], "sol alt\n\nsağ son"),
    ([(0, 0, 10, 2, "Ham Yüzey: Öncelikle temizlenir.")], "## Ham Yüzey:\nÖncelikle temizlenir."),
    ([(0, 0, 10, 0, "• madde"), (0, 12, 10, 0, "devam"), (0, 24, 10, 0, "• ikinci.")], "• madde devam\n• ikinci."),
    ([(0, 0, 24, 1, "+%20"), (0, 40, 10, 0, "daha parlak.")], "+%20\ndaha parlak."),
    ([(0, 0, 10, 0, "suyu getiril-"), (0, 12, 10, 0, "melidir.")], "suyu getirilmelidir."),
]


def page_cases(spark: SparkSession, d: str) -> DataFrame:
    rows = []
    for case, (lines, _) in enumerate(PAGES):
        seq = 0
        for x, y, size, bold, text in lines:
            at = float(x)
            for i, w in enumerate(text.split()):
                rows.append((case, 1, seq, at, float(y), at + 5.0 * len(w), float(y + size), w, float(size), i < bold))
                at, seq = at + 5.0 * len(w) + 2.0, seq + 1
    words = spark.createDataFrame(rows, "doc_id int, page int, seq int, x0 double, y0 double, x1 double, y1 double, text string, size double, is_bold boolean")
    bodies = words.select("doc_id").distinct().withColumn("body_size", F.lit(10.0))
    return layout.page_texts(words, bodies).select(F.col("doc_id").alias("case_no"), "text")


SQL["page_cases"] = f"SELECT CAST(case_no AS INTEGER) AS case_no, text FROM {_values([(i, t) for i, (_, t) in enumerate(PAGES)], 'case_no, text')}"

# Texts of sections on two pages, and heading and body of what they give, in order.
SECTION_PAGES = [
    (["giriş\n## A\n## B\ngövde\n## C\nilk\n## C\nson\n## Z"], [("A B", "gövde"), ("C", "son"), ("Z", "")]),
    (["## A\nbir", "önsöz\n## B\niki"], [("A", "bir"), ("B", "iki")]),  # what stands before the first heading of a page belongs to none
    (["## A\n## B\n## C\nüç"], [("A B", ""), ("C", "üç")]),  # headings are joined by twos
    (["## A\nbir\n## B", "## C\niki\n## A\nyeni"], [("A", "yeni"), ("B", ""), ("C", "iki")]),
    (["metin", ""], []),
]


def section_cases(spark: SparkSession, d: str) -> DataFrame:
    rows = [(case, page, text) for case, (pages, _) in enumerate(SECTION_PAGES) for page, text in enumerate(pages)]
    found = layout.sections(spark.createDataFrame(rows, "case_no int, page int, text string"), "case_no", ["page"])
    return found.select("case_no", F.col("section_no").cast("long").alias("section_no"), "heading", "body")


SQL["section_cases"] = "SELECT CAST(case_no AS INTEGER) AS case_no, CAST(no AS BIGINT) AS section_no, heading, body FROM " + _values(
    [(c, n, h, b) for c, (_, parts) in enumerate(SECTION_PAGES) for n, (h, b) in enumerate(parts)], "case_no, no, heading, body"
)

# Lines and whether they start a part.
HEADING_LINES = [
    ("# Bir", 1), ("####### yedi", 0), ("#Bir", 0), ("1. Giris", 1), ("1.2 Title", 1), ("12.34. Title", 1), ("123 Title", 0), ("1 title", 0), ("1234", 0), ("A-1", 0), ("12.5 - 30", 0),
    ("GENEL BAKIS", 1), ("ABCD", 0), ("ABCDE", 1), ("TEKNIK: A-B", 1), ("TEKNIK 2", 0), ("Metin", 0), ("  UYGULAMA  ", 1),
]


def heading_cases(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([(i, f"{t}\nsonra") for i, (t, _) in enumerate(HEADING_LINES)], "case_no int, text string")
    return chunking.structural_units(rows, ["case_no"]).select("case_no", F.col("is_heading").cast("int").alias("is_heading"))


SQL["heading_cases"] = "SELECT CAST(a AS INTEGER) AS case_no, CAST(b AS INTEGER) AS is_heading FROM " + _values([(i, h) for i, (_, h) in enumerate(HEADING_LINES)], "a, b")

# Texts, size, overlap, and the pieces of recursive splitting.
SPLITS = [
    ("aaaa bbbb cccc", 9, 0, ["aaaa bbbb", "cccc"]), ("aaaa bbbb cccc", 10, 5, ["aaaa bbbb", "bbbb cccc"]), ("aaaa bbbb cccc", 9, 5, ["aaaa bbbb", "cccc"]), ("bir\n\niki üç", 6, 0, ["bir", "iki", "üç"]),
    ("abcdefgh", 3, 1, ["abc", "cde", "efg", "gh"]), ("Bir. İki. Üç", 6, 0, ["Bir", ". İki", ". Üç"]), ("kısa", 50, 5, ["kısa"]), ("  ", 5, 1, []), ("", 5, 1, []),
]


def split_cases(spark: SparkSession, d: str) -> DataFrame:
    parts = [spark.createDataFrame([(i, t)], "case_no int, text string").select("case_no", F.posexplode(chunking.recursive_pieces(size, overlap)("text")).alias("piece_no", "piece")) for i, (t, size, overlap, _) in enumerate(SPLITS)]
    return reduce(DataFrame.unionByName, parts)


SQL["split_cases"] = "SELECT CAST(a AS INTEGER) AS case_no, CAST(b AS INTEGER) AS piece_no, piece FROM " + _values([(i, n, p) for i, (*_, pieces) in enumerate(SPLITS) for n, p in enumerate(pieces)], "a, b, piece")

# Pieces, which of them start a part, whether the tail stays apart; and what they become at 10 to 20 characters with an overlap of 5.
SIZES = [
    (["abc", "defghijk"], None, False, ["abc defghijk"]), (["abcdefghij", "kl"], None, False, ["abcdefghij kl"]), (["abcdefghijklmnopqrstuvwxy"], None, False, ["abcdefghijklmnopqrst", "pqrstuvwxy"]),
    (["abc", "def"], [True, True], False, ["abc def"]), (["abc", "def"], [True, True], True, ["abc", "def"]), (["abc", "defghijklm", "no"], [True, True, False], False, ["abc", "defghijklm no"]), (["kısa"], None, False, ["kısa"]), ([], None, False, []),
]


def size_cases(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([(i, p, b, s) for i, (p, b, s, _) in enumerate(SIZES)], "case_no int, pieces array<string>, starts array<boolean>, strict boolean")

    @F.pandas_udf("array<string>")
    def sized(pieces: pd.Series, starts: pd.Series, strict: pd.Series) -> pd.Series:
        each = zip(pieces, starts, strict, strict=True)
        return pd.Series([chunking.constrain_sizes(list(p), 10, 20, 5, None if b is None else list(b), strict_tail=s) for p, b, s in each], dtype=object)

    return rows.select("case_no", F.posexplode(sized("pieces", "starts", "strict")).alias("piece_no", "piece"))


SQL["size_cases"] = "SELECT CAST(a AS INTEGER) AS case_no, CAST(b AS INTEGER) AS piece_no, piece FROM " + _values([(i, n, p) for i, (*_, pieces) in enumerate(SIZES) for n, p in enumerate(pieces)], "a, b, piece")

# Questions, and their products, properties, stated filters and route.
PRODUCTS = [("Aqualux Mat", ["aqualux"]), ("Wood Maxx", None), ("Exxen Mat", None)]
ROUTES = [
    ("Aqualux sarfiyatı nedir?", "Aqualux Mat", "sarfiyat", "", "metadata_question", "Sarfiyat"), ("wood-maxx ve Aqualux Mat arasındaki fark nedir?", "Aqualux Mat,Wood Maxx", "", "", "comparison", ""),
    ("Hangi ürünler su bazlı ve yarı mat?", "", "su_bazlı,doku", "su_bazlı=true,doku=yarı mat", "metadata_list", "Su bazlı + Doku"), ("Hangi ürünler iç cephe içindir?", "", "kullanım_alanı", "kullanım_alanı=iç cephe", "metadata_list", "Kullanım alanı"),
    ("Exxen Mat litre başına kaç metrekare boyar?", "Exxen Mat", "sarfiyat,ambalaj_boyutları", "", "metadata_question", "Sarfiyat + Ambalaj boyutları"), ("Aqualux kaç saatte kurur?", "Aqualux Mat", "dokunma_kuruması,katlar_arası_bekleme,son_kuruma", "", "metadata_question", "Dokunma kuruması + Katlar arası bekleme süresi + Son kuruma"),
    ("Wood Maxx farkı nedir?", "Wood Maxx", "", "", "default_qa", ""), ("Boyadan önce ne yapılır?", "", "", "", "default_qa", ""),
]


def route_cases(spark: SparkSession, d: str) -> DataFrame:
    questions = spark.createDataFrame([(i, q) for i, (q, *_) in enumerate(ROUTES)], "id int, question string")
    products = spark.createDataFrame(PRODUCTS, "name string, aliases array<string>")
    route = intent.routed(questions, products)
    stated = F.transform("filters", lambda x: F.concat(x["key"], F.lit("="), x["value"]))
    return route.select(F.col("id").alias("case_no"), F.array_join("products", ",").alias("products"), F.array_join("properties", ",").alias("properties"), F.array_join(stated, ",").alias("filters"), "intent", "label")


SQL["route_cases"] = "SELECT CAST(a AS INTEGER) AS case_no, products, properties, filters, intent, label FROM " + _values([(i, *rest) for i, (_, *rest) in enumerate(ROUTES)], "a, products, properties, filters, intent, label")

QUERIES = {f.__name__: f for f in (page_cases, section_cases, heading_cases, split_cases, size_cases, route_cases)}
