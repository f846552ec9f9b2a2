import pytest
from pyspark.sql import functions as F

from pigmenta.llm import mixing as mx
from pigmenta.llm import pairs as pr
from pigmenta.llm import quality as ql
from pigmenta.llm import spam as sm

COMMON = frozenset("bir bu ve için the and of is a to".split())


@pytest.mark.parametrize(("kind", "text"), [
    ("prose", "Boya tabakası dokunma kuruluğuna 33 dakikada ulaşır, tam sertleşme ise 4 gün sürer."),
    ("prose", "– Renk tonu üretim serisine göre değişebildiğinden aynı duvarda tek seri kullanılmalıdır.\n– Boyanan alan ilk 24 gün silinmemeli, sonrasında yumuşak bezle temizlenmelidir."),
    ("prose", "Sıvalı duvar gibi zor yüzeylerde\nönce yalıtım astarı sürülmesi nefes\nalma özelliği değerini artırır"),
    ("list", "• Ahşap astarı\n• Fırça\n• 2 L ambalaj"),
    ("list", "Renkler: krem; beton yüzey; eski boyalı duvar; pistole; rulo; fırça"),
    ("list", "Renk kalıcılığı\n13 L ambalaj\nantipas astar\nMorvinta Plastor"),
    ("table", "| Kod | Kat |\n| esneklik | 4,1 |\n| yayılma | % |"),
    ("table", "esneklik ........ 12-20 %\npH .......... 54,0 —\nyayılma ....... g/L 30,9"),
    ("junk", "test test test test test test test test"),
    ("junk", "==================\n22"),
    ("junk", "RJ74QBL_X7-93R3QCWBEYKXNWWV59QZ7Z3Y3WUZ__R5GLBN44V2PFXSZ"),
    ("title", "KURUMA SÜRESİ"),
    ("blank", " \n "),
])
def test_kinds(kind, text):
    assert ql.classify(text, ql.measure(text, COMMON), 10, 11.5) == kind


A = "Boyanan duvar önce kuru bezle silinir ve sonra ikinci kat sürülür."
LINES = ["ince ve koyu sürülür.", "kalın ve boz kurur.", "eski ve yaş dökülür."]
ORDER = (0, 0, 1, 1, 2, 2, 0, 2, 1, 0)  # no two stand behind each other twice, so no longer n-gram is repeated


def broken(line, at):
    words = line.split()
    return line if not at else " ".join(words[:at]) + "\n" + " ".join(words[at:])


ONLY = {  # the statistics that make a text filler, and such a text
    ("top_word_share",): "test eder test yapar test olur test test",
    ("top_2gram_coverage",): "ucuz boyalar mavi ucuz boyalar kırmızı ucuz boyalar yeşil ucuz boyalar",
    ("repeated_line_share",): "\n".join(LINES[i] for i in ORDER),
    ("repeated_paragraph_share",): "\n\n".join(broken(LINES[i], ORDER[:n].count(i)) for n, i in enumerate(ORDER)),
    tuple(f"repeated_{n}gram_share" for n in range(5, 11)): " ".join([A] * 3),
}


@pytest.mark.parametrize("names", ONLY)
def test_each_repetition_statistic_decides(names, monkeypatch):
    text = ONLY[names]
    q = ql.measure(text, COMMON)
    assert ql.classify(text, q, 10, 11.5) == "junk"
    hit = {k for k, least in ql.FILLER.items() if getattr(q, k) >= least}
    assert set(names) <= hit and (len(names) == 1 or hit == set(names))
    for rules in ("FILLER", "FILLER_LIST"):
        monkeypatch.setattr(ql, rules, {k: v for k, v in getattr(ql, rules).items() if k not in names})
    assert ql.classify(text, q, 10, 11.5) != "junk"


def test_filler_does_not_depend_on_length():
    vocabulary = [f"kelime{i}" for i in range(300)]
    words = [vocabulary[(i * i + 7 * i // 5) % 300] for i in range(20_000)]
    long_prose = " ".join(f"{w.capitalize()}." if i % 9 == 8 else w for i, w in enumerate(words[:2000]))
    assert len(set(words)) / len(words) < 0.3 and ql.measure(long_prose, COMMON).top_word_share < 0.1
    assert ql.classify(f"{A} {A}", ql.measure(f"{A} {A}", COMMON), 10, 11.5) == "prose"
    for times in (3, 300):
        assert ql.classify(f"{A} " * times, ql.measure(f"{A} " * times, COMMON), 10, 11.5) == "junk"


def test_furniture_is_what_stands_on_many_pages(spark):
    rows = [(i, f"Sayfa {i} / 49 · Rev.00 · DNE{i}-379 · www", 8, "a", i) for i in range(1, 4)] + [(9, "Kutu 5 · 7 x · yy", 8, "a", 1), (10, "Kutu 5 · 7 x · yy", 8, "a", 1), (11, None, 8, None, None)]
    blocks = spark.createDataFrame(rows, "block_id long, text string, font_size int, source string, page int")
    got = {r["block_id"] for r in ql.not_prose(ql.text_quality(blocks, spark.createDataFrame([("tr", "bir")], "lang string, word string"))).collect()}
    assert got == {1, 2, 3}


def test_measures():
    q = ql.measure("Bu bir evdir.\nBu bir evdir.\n\nSon satır", COMMON)
    assert (q.words, q.lines, q.repeated_line_share, q.terminal_line_share) == (8, 3, pytest.approx(1 / 3), pytest.approx(2 / 3))
    assert q.common_word_share == 0.5 and q.mean_word_length == pytest.approx(sum(map(len, "Bu bir evdir Bu bir evdir Son satır".split())) / 8)
    assert ql.measure("", COMMON) == ql.Quality() and ql.measure("?!", COMMON).symbol_ratio == 1.0


def test_quality_table(spark):
    blocks = spark.createDataFrame([(1, None, 10), (2, "", None), (3, "• fırça\n• rulo\n• astar", 10), (3, "• fırça\n• rulo\n• astar", 10), (4, "x " * 50_000, 10)], "block_id long, text string, font_size int")
    words = spark.createDataFrame([("tr", "bir"), ("tr", None)], "lang string, word string")
    rows = ql.text_quality(blocks, words)
    assert rows.count() == 5 and rows.filter("block_id = 1").first()["words"] is None
    assert sorted((r["block_id"], r["kind"]) for r in ql.not_prose(rows).collect()) == [(3, "list"), (4, "junk")]
    assert ql.text_quality(blocks.limit(0), words).count() == 0


# Pairs.

NAMES = ["Silka Mat ABC12", "Flora Saten XYZ34", "Duvarya Parlak QRS56", "Astarel Mat TUV78"]


def sample_pairs():
    rows, i = [], 0
    for n in NAMES:
        for hours in range(10, 22):
            i += 1
            rows.append((i, f"{n} için kaç saat beklenir ve bu ne kadar sürer?", f"{n} dokunma kuruluğuna {hours} saatte ulaşır."))
            i += 1
            rows.append((i, f"How many hours does {n} need to dry and can it be stored?", f"{n} is dry to the touch after {hours} hours."))
    q = f"{NAMES[0]} için kaç saat beklenir ve bu ne kadar sürer?"
    rows += [
        (901, q, None), (902, q, " … "), (903, q, "N/A"), (904, q, q.upper()), (905, q, f"Soru: {q} {q}"), (906, q, "Üzgünüm, bu soruyu yanıtlamam mümkün değil."),
        (907, q, f"{NAMES[0]} dokunma kuruluğuna 12 saa"), (908, q, f"{NAMES[0]} dokunma…"), (909, q, f"{NAMES[0]} is dry to the touch after 12 hours."), (910, q, "15 saat"),
        (911, q, f"{q} {NAMES[0]} dokunma kuruluğuna 12 saatte ulaşır"), (912, q, "Hayır, yalnız 3 saatte ulaşır."), (913, None, "15 saat"), (914, q, "Silka Ma"),
    ]
    return rows


def test_defects(spark):
    pairs = spark.createDataFrame(sample_pairs() * 2, "id long, question string, answer string").withColumn("defect", F.lit("clash"))
    words = spark.createDataFrame([("tr", w) for w in "için bu ne kadar ve".split()] + [("en", w) for w in "how does to and can it be".split()], "lang string, word string")
    got = {r["id"]: r["defect"] for r in pr.defective_pairs(pairs, words).collect()}
    want = {901: "empty", 902: "empty", 903: "empty", 904: "copies_question", 905: "copies_question", 906: "refusal", 907: "truncated", 908: "truncated", 909: "other_language", 914: "truncated"}
    assert got == want
    assert pr.defective_pairs(pairs.limit(0), words).count() == 0


def test_evidence_that_goes_on(spark):
    q = f"{NAMES[0]} nerede kullanılır?"
    whole = f"{NAMES[0]} nemli bodrum duvarında tek kat sürülür ve 3 saatte kurur."
    passages = [None, "Başka bir cümle. " + whole.upper()]
    cases = [
        (f"{NAMES[0]} nemli bodrum duv", "truncated"), (f"{NAMES[0]} nemli bodrum duvarında", "truncated"), (f"{NAMES[0]} nemli bodrum duvarında tek kat sürülür", None),
        ("nemli bodrum duvar", None), (NAMES[0], None), ("bodrum duvarında tek kat sürülür", None), (whole, None), (whole[:-1], None), (f"{NAMES[0]} başka duvarda", None),
    ]
    for answer, defect in cases:
        assert pr.goes_on(answer, pr.name_of(q), passages, 3) == (defect is not None), answer
    only = [(1, q, cases[0][0], passages), (1, q, cases[0][0], passages), (4, q, "15 saat", ["15 saatte kurur."])]  # none is a longer sibling
    words = spark.createDataFrame([("tr", "ve"), ("en", "and")], "lang string, word string")
    for given in (only, [(*r[:3], None) for r in only]):
        pairs = spark.createDataFrame(given, "id long, question string, answer string, evidence array<string>")
        got = [tuple(r) for r in pr.defective_pairs(pairs, words).collect()]
        assert got == ([(1, "truncated")] if given is only else [])


def test_length_limit(spark):
    rows = [(f"{'x' * 80}",)] * 60 + [("y" * n + ".",) for n in range(60, 100)]
    assert pr.length_limits(spark.createDataFrame(rows, "answer string"), pr.PairSettings()) == [80]


def test_shortened():
    assert pr.shortened("kapalı ambal", "kapalı ambalajda saklanır.")
    assert not pr.shortened("kapalı saklanır", "kapalı saklanır. sonra açılır.")
    assert not pr.shortened("hayır", "hayır, olmaz.")
    assert not pr.shortened("a", "b") and not pr.shortened("", "b")


@pytest.mark.parametrize(("declines", "text"), [
    (True, "As an AI language model, I don't provide such information."), (True, "Üzgünüm, bu konuda bilgi veremem."), (True, "Bunu cevaplamayı reddediyorum."),
    (True, "Bilmiyorum, bu bilgiye erişimim yok."), (True, "I must decline. Please ask your dealer."), (True, "Özür dilerim. Bunu paylaşamam."), (True, "Das kann ich leider nicht beantworten."),
    (False, "You should not use it; I cannot stress enough that the surface must be dry."), (False, "Hayır, inceltilmeden kullanılır."), (False, "Tamam, astar gerekir."),
    (False, "No, the paint is ready to use."), (False, "Bu değer kataloğa bağlıdır."), (False, "Fırça temizlenir. Ben bunu önermem."),
])
def test_refusals_by_grammar(declines, text):
    assert pr.refuses(text, None) == declines


def test_an_answer_that_says_what_the_evidence_says_is_no_refusal(spark):
    rows = [(1, "Can I paint it wet?", "I would say we do not recommend painting plastered surfaces while damp.", ["Painting plastered surfaces while damp is not recommended."]), (2, "Can I paint it wet?", "We do not share details about it.", [None, "Painting plastered surfaces is easy."])]
    pairs = spark.createDataFrame(rows, "id long, question string, answer string, evidence array<string>")
    words = spark.createDataFrame([("en", "would"), ("tr", "bir")], "lang string, word string")
    assert {r["id"]: r["defect"] for r in pr.defective_pairs(pairs, words).collect()} == {2: "refusal"}


# Mixing.


def test_quotas():
    t = {"a": (0.5, 1), "b": (0.3, 2), "c": (0.2, 1)}
    q = mx.quotas({"a": 1000, "b": 100}, t, None)
    assert q["a"] / q["b"] == pytest.approx(5 / 3) and q["b"] == pytest.approx(200)
    q = mx.quotas({"a": 1000, "b": 100}, t, 1000)
    assert q == {"b": 200.0, "a": pytest.approx(800)}
    assert mx.quotas({}, t, None) == {}


def test_blocks_grow_where_there_are_too_many():
    assert mx.block_size(10**6, mx.MixSettings()) == 16
    copies = {"a": 4 * 10**12, "b": 10**12, "c": 5}
    size = mx.block_size(sum(copies.values()), mx.MixSettings())
    blocks = {s: -(-n // size) for s, n in copies.items()}
    tree = mx.splitting_tree(blocks, 64, 3)
    assert {s: sum(x) for s, x in tree.items()} == blocks and max(tree["a"]) < 1.01 * min(tree["a"])


def test_splitting_tree_is_exact():
    got = mx.splitting_tree({"a": 1000, "b": 37, "c": 0}, 7, 1)
    assert {s: sum(x) for s, x in got.items()} == {"a": 1000, "b": 37, "c": 0}
    sizes = [sum(x[i] for x in got.values()) for i in range(7)]
    assert max(sizes) - min(sizes) <= 3


def test_mixture(spark):
    docs = [(i, "abc"[i % 3 and 1 + i % 2] if i % 10 else None, 5 + i % 7, "x y") for i in range(3000)] + [(9000, "a", None, "üç beş, yedi"), (9001, "z", 5, "q")]
    df = spark.createDataFrame(docs, "doc_id long, source string, n_tokens long, text string")
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.3, 3), ("c", 0.1, 1), ("missing", 0.1, 4)], "source string, target_share double, max_repeats int")
    m = mx.mixture(df, targets, mx.MixSettings(shards=4, block=8))
    rows = m.collect()
    report = {r["source"]: r for r in mx.share_report(m, targets).collect()}
    assert report["missing"]["share_reached"] == 0 and report["a"]["share_reached"] == pytest.approx(0.5 / 0.9, abs=0.005) and report["b"]["share_reached"] == pytest.approx(0.3 / 0.9, abs=0.005)
    assert all(r["most_copies"] <= r["max_repeats"] for r in report.values())
    assert len({(r["doc_id"], r["copy_no"]) for r in rows}) == len(rows) and {r["shard"] for r in rows} == {0, 1, 2, 3}
    again = mx.mixture(df.repartition(7), targets, mx.MixSettings(shards=4, block=8)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))
    assert mx.mixture(df.limit(0), targets).count() == 0 and mx.mixture(df, targets.limit(0)).count() == 0


def test_tokens_by_rule(spark):
    assert spark.createDataFrame([("Üç_beş, 7!",)], "text string").select(mx.tokens_of().alias("n")).first()["n"] == 4


def test_public_tokenizer(spark):
    public = pytest.importorskip("public_tokenizers")
    rows = mx.public_tokens(spark.createDataFrame([("hello world",), (None,)], "text string"), public.path("byte_bpe_50k.json")).collect()
    assert [r["n_tokens"] for r in rows] == [2, None]


# Spam.

SENTENCES = "Boya tabakası dokunma kuruluğuna 33 dakikada ulaşır. Kuru film kalınlığı kat başına ortalama 95 µm olarak ölçülmüştür. Yüzey nemi yüzde 11 değerinin altına inmeden bu ürün kullanılmamalıdır. "


def test_stuffing_kinds():
    f, limits = frozenset({"bir", "için", "bu"}), sm.StuffingLimits()
    share = lambda t: sm.stuffing(t, f, limits.least_share, limits)["stuffed"]
    assert share("\n".join(f"https://a{i}.example/x" for i in range(9))) == 1
    assert share("ucuz boya > a1.example (3)\nucuz boya : a2.test\n" * 5) == 1
    assert share(" ".join(f"#boya{i}" for i in range(30))) == 1
    assert share("Etiketler: mat 2L / SKU-11 / ucuz boya / Silka / saten / mat") == 1
    assert share("Ucuz boya. Dış cephe boya! Ucuz boya. " * 20) > 0.9
    assert share("Uygun dış cephe boya burada, Hemen dış cephe boya için tıkla! En iyi dış cephe boya burada. " * 8) > 0.9
    assert share(SENTENCES * 2) == 0
    assert 0 < share(SENTENCES * 3 + "\nKaynak: https://a.example/x") < 0.3
    assert share("") == 0 and share(" \n ") == 0


def test_spam_table(spark):
    docs = [(1, SENTENCES, "tr"), (2, "Ucuz boya. Dış cephe boya! " * 30, None), (3, None, "tr"), (4, "", "EN"), (5, SENTENCES + "#boya " * 90, "tr"), (5, SENTENCES + "#boya " * 90, "tr")]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    assert sorted(r["doc_id"] for r in sm.spam_documents(df).collect()) == [2, 5]
    assert sm.stuffed_shares(df).count() == 6 and sm.spam_documents(df.limit(0)).count() == 0


PROBE = "Kaliteli boya fiyatları için en iyi ucuz boya fiyatları burada, ucuz boya ve boya fiyatları."
PHRASE = "Tüm renklerde ve her boyda en uygun kampanyalı iç cephe silikonlu astar boya tiner rulo fırça seçenekleri için bizi hemen arayın."
KINDS = {  # bounds that no share reaches, but for one; and a text that this one makes spam
    "repeated_lines": (PROBE + " ") * 12,
    "top_2gram": " ".join(f"{a} ucuz boya {b}!" for a in ("Bugün", "Hemen", "Uygun") for b in ("burada", "fırsatı", "seçenekleri")),
    "repeated_2grams": "boya satın al kampanyalı boya markaları online kampanya boya satın al toptan indirim boya markaları toptan indirim " * 8 + "son.",
}


@pytest.mark.parametrize("name", KINDS)
def test_each_share_decides(name):
    f, limits = frozenset({"için", "en", "ve", "bizi"}), sm.StuffingLimits()
    off = tuple(9.0 if x != name else least for x, least in zip(sm.SHARES, limits.least_share, strict=True))
    assert sm.stuffing(KINDS[name], f, off, limits)["stuffed"] > 0.9
    assert sm.stuffing(KINDS[name], f, (9.0,) * 6, limits)["stuffed"] == 0


def test_a_repeated_long_phrase_is_stuffing_and_a_sentence_said_twice_is_not():
    f, limits = frozenset({"için", "en", "ve", "her"}), sm.StuffingLimits()
    assert sm.stuffing((PHRASE + " ") * 6, f, limits.least_share, limits)["stuffed"] == 1.0
    assert sm.stuffing(SENTENCES + PHRASE + " " + PHRASE, f, limits.least_share, limits)["stuffed"] == 0


def test_bounds_follow_the_language():
    c = sm.Calibration({}, {"tr": {"top_2gram": 0.06}, "all": {"top_2gram": 0.01, "top_word": 0.5}})
    assert c.of("tr", sm.StuffingLimits())[1] == (0.25, 0.24, 0.22, 0.28, 0.5, 0.35) and c.of("de", sm.StuffingLimits())[1][1] == 0.16
