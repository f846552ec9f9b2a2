from pyspark.sql import functions as F

from pigmenta.operators import answers, extraction, intent
from pigmenta.operators import layout as lay


def word(text, x, y, bold=False, size=10.0, seq=0):
    return {"text": text, "x0": x, "y0": y, "x1": x + 5.0 * len(text), "y1": y + 10.0, "is_bold": bold, "size": size, "seq": seq}


def test_columns_are_read_one_after_the_other():
    words = [word("sol", 0, 0), word("sağ", 200, 0), word("alt", 0, 12), word("son", 200, 12)]
    items = lay.cut_page(words)
    assert [x if isinstance(x, str) else x.text for x in items] == ["sol", "alt", "col", "sağ", "son"]


def test_inline_bold_prefix():
    words = [word("Ham", 0, 0, True), word("Yüzey:", 20, 0, True), word("Öncelikle", 60, 0)]
    line = lay.lines_of(words)[0]
    assert (line.prefix, line.rest) == ("Ham Yüzey:", "Öncelikle")
    lay.mark_headings([line], 10.0)
    assert lay.assemble([line]) == "## Ham Yüzey:\nÖncelikle"


def test_heading_gates():
    for text in ("+%20", "2.5 L"):
        line = lay.Line(text, 0, 0, 10, 10, 1.0, 14.0)
        lay.mark_headings([line], 10.0)
        assert not line.heading
    title = lay.Line("UYGULAMA", 0, 0, 10, 10, 1.0, 14.0)
    lay.mark_headings([title], 10.0)
    assert title.heading


def test_assembly_joins_wrapped_lines():
    items = [lay.Line("suyu getiril-", 0, 0, 1, 1), lay.Line("melidir.", 0, 2, 1, 3), lay.Line("• madde", 0, 4, 1, 5), lay.Line("devam", 0, 6, 1, 7)]
    assert lay.assemble(items) == "suyu getirilmelidir.\n• madde devam"


def test_body_size_tie_is_first_seen(spark):
    df = spark.createDataFrame([("d", 12.0, 1), ("d", 10.0, 2), ("e", None, 1)], "doc string, size double, seq int")
    got = {r["doc"]: r["body_size"] for r in lay.body_size(df, "doc", "size", F.lit(1), ["seq"]).collect()}
    assert got == {"d": 12.0, "e": 10.0}


def test_styles_by_best_overlap(spark):
    words = spark.createDataFrame([("d", 1, 0, 0.0, 0.0, 10.0, 10.0, "a"), ("d", 1, 1, 100.0, 0.0, 110.0, 10.0, "b")], "doc_id string, page int, seq int, x0 double, y0 double, x1 double, y1 double, text string")
    spans = spark.createDataFrame([("d", 1, 0, 0.0, 0.0, 10.0, 10.0, "a", 14.0, 16), ("d", 1, 1, 0.0, 0.0, 10.0, 10.0, "a", 9.0, 0)], "doc_id string, page int, seq int, x0 double, y0 double, x1 double, y1 double, text string, size double, flags int")
    got = {r["text"]: (r["size"], r["is_bold"]) for r in lay.styled_words(words, spans).collect()}
    assert got == {"a": (14.0, True), "b": (10.0, False)}


def test_near_duplicates_drift(spark):
    rows = [("d", i, 4.0 * i, 0.0, 4.0 * i + 10, 10.0, "w") for i in range(4)]
    df = spark.createDataFrame(rows, "doc string, seq int, x0 double, y0 double, x1 double, y1 double, text string")
    assert sorted(r["seq"] for r in lay.without_near_duplicates(df, ["doc"]).collect()) == [0, 2]


def test_sections_merge_and_overwrite(spark):
    text = "giriş\n## A\n## B\ngövde\n## C\nilk\n## C\nson\n## Z"
    df = spark.createDataFrame([("d", 1, text)], "doc string, page int, text string")
    got = [(r["heading"], r["body"]) for r in lay.sections(df, "doc", ["page"]).orderBy("section_no").collect()]
    assert got == [("A B", "gövde"), ("C", "son"), ("Z", "")]


def test_font_sections(spark):
    rows = [("d", 0, "önce", 10), ("d", 1, "Baş", 14), ("d", 2, "Son Baş", 14), ("d", 3, "metin", 10), ("d", 4, "Boş", 14)]
    df = spark.createDataFrame(rows, "doc string, seq int, text string, font_size int").withColumn("body_size", F.lit(10.0))
    assert [(r["heading"], r["text"]) for r in lay.font_sections(df, "doc", ["seq"]).orderBy("section_no").collect()] == [(None, "önce"), ("Son Baş", "metin")]


def test_noise_of_a_heading(spark):
    df = spark.createDataFrame([("Introduction",), ("",), ("Bu cümle yeterince uzundur ve bir noktayla biter.",)], "t string")
    assert [r["n"] for r in df.select(lay.noise_tenths(F.col("t")).alias("n")).collect()] == [6, 10, 0]


def test_boilerplate_needs_four_pages(spark):
    few = spark.createDataFrame([("d", i, "aynı\nözel" + str(i)) for i in range(3)], "doc string, page int, text string")
    many = spark.createDataFrame([("d", i, "aynı\nözel" + str(i)) for i in range(5)], "doc string, page int, text string")
    assert lay.without_boilerplate(few, "doc", "page").count() == 6
    assert {r["line"] for r in lay.without_boilerplate(many, "doc", "page").collect()} == {f"özel{i}" for i in range(5)}


def test_gaps(spark):
    df = spark.createDataFrame([("d", 0.0, 5.0), ("d", 5.0, 8.0), ("d", 12.0, 20.0), ("d", 13.0, 14.0), ("d", 24.0, 25.0)], "doc string, a double, b double")
    assert sorted((r["gap_start"], r["gap_end"]) for r in lay.gaps(df, ["doc"], "a", "b", 4.0).collect()) == []
    assert sorted((r["gap_start"], r["gap_end"]) for r in lay.gaps(df, ["doc"], "a", "b", 3.0).collect()) == [(8.0, 12.0), (20.0, 24.0)]


def test_percentages(spark):
    df = spark.createDataFrame([("%5 inceltilerek",), ("maksimum %20-25 inceltilerek",), ("20-25% olur",), ("4-6 saat",), ("Kullanıma hazırdır",), (None,)], "t string")
    got = [r["p"] and (r["p"]["lo"], r["p"]["hi"]) for r in df.select(extraction.percentage(F.col("t")).alias("p")).collect()]
    assert got == [(5.0, 5.0), (20.0, 25.0), (20.0, 25.0), (0.0, 0.0), (0.0, 0.0), None]


def test_property_record(spark):
    page = "## Silkano®\nSu bazlı, iç cephe için yarı mat boyadır.\n## KURUMA SÜRESİ\nDokunma kuruması: 30-60 dakika"
    parts = [("KURUMA SÜRESİ", "Dokunma kuruması: 30-60 dakika\nSon Kuruma: 7 gün"), ("SARFİYAT", "8-10 m 2 boyanır"), ("AMBALAJ", "2,5 L ve 15 L"), ("İNCELTME", "%5 su"), ("DEPOLAMA", "24 ay")]
    df = spark.createDataFrame([("d", page, parts)], "doc_id string, first_page string, sections array<struct<heading:string,body:string>>")
    r = extraction.properties(df).first()
    assert (r["ürün_adı"], r["su_bazlı"], r["voc_uyumlu"], r["kullanım_alanı"], r["doku"]) == ("Silkano", True, False, "iç cephe", "yarı mat")
    assert (r["dokunma_kuruması_min"], r["dokunma_kuruması_max"], r["son_kuruma"], r["son_kuruma_birimi"]) == (30.0, 60.0, 7.0, "gün")
    assert (r["sarfiyat_min"], r["sarfiyat_birimi"], r["ambalaj_boyutları"], r["ambalaj_boyutları_birimi"]) == (8.0, "m²/Litre", [2.5, 15.0], "L")
    assert (r["inceltme_fırça_rulo"]["lo"], r["depolama_süresi"], r["inceltme_havasız_püskürtme"]) == (5.0, 24.0, None)
    flat = extraction.flattened(extraction.properties(df), ["ambalaj_boyutları", "voc_uyumlu", "doku"]).first()
    assert (flat["prop_ambalaj_boyutları"], flat["prop_voc_uyumlu"]) == ("2.5, 15", False)


def test_routes(spark):
    q = [
        (1, "Hangi ürünler su bazlıdır?", "metadata_list"),
        (2, "Silkano ile Flora Silan arasındaki temel fark nedir?", "comparison"),
        (3, "Silkano'un sarfiyatı ve depolama süresi nedir?", "metadata_question"),
        (4, "Karmeno Yalıtan'ın özellikleri nelerdir?", "default_qa"),
        (5, "Duvaro mat litre başına kaç metrekare boyanabilir", "metadata_question"),
    ]
    questions = spark.createDataFrame([x[:2] for x in q], "id long, question string")
    products = spark.createDataFrame([("Silkano",), ("Flora Silan",), ("Duvaro Mat",), (None,)], "name string")
    got = {r["id"]: r for r in intent.routed(questions, products).collect()}
    assert {i: r["intent"] for i, r in got.items()} == {i: w for i, _, w in q}
    assert got[2]["products"] == ["Flora Silan", "Silkano"]
    assert got[3]["properties"] == ["sarfiyat", "depolama_süresi"]
    assert "doku" not in got[5]["properties"]


def test_range_text_and_lists(spark):
    df = spark.createDataFrame([("a", 8.0, 10.0, "m²"), ("b", 8.0, 8.0, "m²"), ("c", None, None, "m²")], "name string, lo double, hi double, u string")
    assert [r["t"] for r in df.select(answers.range_text(F.col("lo"), F.col("hi"), F.col("u")).alias("t")).collect()] == ["8-10 m²", "8 m²", None]
    assert answers.list_answer(df.withColumn("g", F.lit(1)), ["g"], "name", F.lit("")).first()["answer"] == "Eşleşen ürünler:\n\n• a\n• b\n• c"
    lines = answers.value_lines(df, "name", [("Sarfiyat", answers.range_text(F.col("lo"), F.col("hi"), F.col("u")))]).collect()
    assert {r["name"] for r in lines} == {"a", "b"}


def test_open_routes_go_to_the_hook(spark):
    questions = spark.createDataFrame([(1, "sarfiyat bilgisi"), (2, "Silka Flora"), (3, "depolama bilgisi")], "id long, question string")
    products = spark.createDataFrame([("Silka",), ("Flora",)], "name string")
    said = {"sarfiyat bilgisi": ("metadata_question", "sarfiyat"), "Silka Flora": ("comparison", ""), "depolama bilgisi": ("metadata_question", "doku")}
    got = {r["id"]: r["intent"] for r in intent.routed(questions, products, lambda q: said[q]).collect()}
    assert got == {1: "metadata_question", 2: "comparison", 3: "default_qa"}
    assert {r["intent"] for r in intent.routed(questions, products).collect()} == {"default_qa"}


def test_query_blocks_cover_all(spark):
    from pigmenta.operators import dense
    from pigmenta.session import query_blocks

    q = spark.range(50).select(F.col("id").alias("query_id"), F.array(F.col("id").cast("float"), F.lit(1.0)).alias("query_embedding"))
    blocks = query_blocks(q, "query_id", block=10)
    assert len(blocks) == 5 and sum(b.count() for b in blocks) == 50
    corpus = q.select(F.col("query_id").alias("id"), F.col("query_embedding").alias("embedding"))
    assert dense.dense_top_k(corpus, q, 2).count() == 100
