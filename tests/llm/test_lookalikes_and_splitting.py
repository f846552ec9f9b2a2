import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pigmenta.llm import lookalikes as la
from pigmenta.llm import splitting as sp

RECORDS = "field_name string, key string, text string"


def pairs(spark, rows):
    return sorted((r["field_name"], r["key_a"], r["key_b"]) for r in la.look_alike_pairs(spark.createDataFrame(rows, RECORDS)).collect())


def test_same_looks_are_paired_and_others_not(spark):
    rows = [
        ("f", "01", "Öznilo Mat 452"), ("f", "02", "Öznilo Mat 452"), ("f", "03", "Öｚｎｉｌｏ Ｍａｔ ４５２"), ("f", "04", "Öznilo M​at 452"), ("f", "05", "Öznilо Маt 452"),
        ("f", "06", "öznilo Mat 452"), ("f", "07", "Öznilo  Mat 452"), ("f", "08", "Öznilo-Mat 452"), ("f", "09", "Oznilo Mat 452"), ("g", "10", "Öznilo Mat 452"), ("f", "11", "Öznilo Mat 452"),
    ]
    got = pairs(spark, rows)
    alike = ["01", "02", "03", "04", "05", "11"]
    assert got == sorted(("f", a, b) for i, a in enumerate(alike) for b in alike[i + 1 :] if (a, b) != ("01", "11"))


def test_what_a_turkish_reader_tells_apart(spark):
    rows = [("f", str(i), t) for i, t in enumerate(["ısı", "isi", "şap", "sap", "m²", "m2", "0A", "OA", "a b", "a\nb", "1", "l", "I", "İ"])]
    assert pairs(spark, rows) == []


def test_no_cases(spark):
    assert pairs(spark, [("f", "1", None), ("f", "2", ""), ("f", "3", " "), ("f", "4", " "), ("f", "5", "x"), ("f", "5", "х"), (None, "6", "y")]) == []
    assert pairs(spark, []) == []


def test_repeated_rows_and_hot_text_count_once(spark):
    rows = [("f", f"{i:04d}", "abc") for i in range(300)] * 2 + [("f", "x", "аbc")]
    assert len(pairs(spark, rows)) == 300


def test_parts_of_hot_texts_and_classes_give_the_same_pairs(spark, monkeypatch):
    rows = [("f", f"{i:02d}", "abc") for i in range(25)] + [("f", f"v{i}", "ab" + "\u200b" * (i + 1) + "c") for i in range(14)] + [("g", "00", "abc"), ("g", "z", "другое")]
    whole = pairs(spark, rows)
    assert len(whole) == 25 * 14 + 14 * 13 // 2
    monkeypatch.setattr(la, "PART", 4)
    assert pairs(spark, rows) == whole
    got = la.look_alike_classes(spark.createDataFrame(rows, RECORDS)).collect()
    assert len(got) == 39 and {(r["texts"], r["records"]) for r in got} == {(15, 39)} and len({r["class_id"] for r in got}) == 1


def test_stacked_marks_give_pairs_not_stacks():
    marks = [chr(0x300 + i) for i in range(20)]
    forms = la.count_forms(["a" + "".join(marks[i:]) for i in range(19)])
    assert len(forms) == 1 + 20 + 20 and all(len(f) <= 2 for f in forms)


def test_rewriting_goes_on_until_nothing_changes():
    text = "a" + "".join("\u200b" + chr(0x300 + i % 2) for i in range(40)) + "ﬁ"
    rewrite = la.Rewriter(la.look_alike_map(la.count_forms([text])))
    assert rewrite(rewrite(text)) == rewrite(text) and "\u200b" not in rewrite(text)
    loop = la.Rewriter({"x": "y", "y": "x"})
    assert loop("x") == loop("y") == "x"


def test_forms_keep_rows_and_other_columns(spark):
    df = spark.createDataFrame([("á", 1, "old"), (None, 2, "old"), ("", 3, "old")], "text string, n int, form string")
    got = {r["n"]: r["form"] for r in la.canonical_forms(df).collect()}
    assert got == {1: got[1], 2: None, 3: ""} and unicodedata.normalize("NFC", got[1]) == "á"


def test_representative_is_the_most_frequent(spark):
    counts = la.count_forms(["ааааа", "a"])
    assert la.look_alike_map(counts)["a"] == "а"


def test_greedy_and_stable():
    rewrite = la.Rewriter(la.look_alike_map(la.count_forms(["ﬁş s​̧ey ѕ̧", "şfi"])))
    once = rewrite("ﬁş s​̧ey ѕ̧")
    assert once == "fiş şey ş" and rewrite(once) == once


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aаsѕiі̧̇​ｓ ı", max_size=12))
def test_rewriting_is_idempotent(text):
    rewrite = la.Rewriter(la.look_alike_map(la.count_forms([text, "aasiıs "])))
    assert rewrite(rewrite(text)) == rewrite(text)


# Splitting.


def check_cuts(text, limit, overlap):
    cuts = sp.plan_cuts(text, limit, overlap)
    covered = set()
    for a, b, _ in cuts:
        assert 0 <= a <= b <= len(text) and b - a <= limit
        covered.update(range(a, b))
    for (a, b, _), (c, d, _) in zip(cuts, cuts[1:], strict=False):
        assert c > a and d > b and b - c <= overlap
    assert all(text[i] in sp.SPACES for i in range(len(text)) if i not in covered)
    run = max(map(len, __import__("re").split("[ \t\r\n]+", text)), default=0)
    assert any(k == sp.FORCED for *_, k in cuts) == (run > limit)
    return cuts


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aab  .\n!", max_size=120), st.integers(4, 30), st.integers(0, 3))
def test_cuts_against_definition(text, limit, overlap):
    check_cuts(text, limit, overlap)


def test_the_table_follows_the_window():
    text = "Bir cümle var. " * 3000
    assert sp.StretchMaximum(sp.boundary_strengths(text), 101).strongest(40_000, 40_100) == sp.RangeMaximum(sp.boundary_strengths(text), 101).strongest(40_000, 40_100)
    index = sp.StretchMaximum(sp.boundary_strengths(text), 101)
    index.strongest(40_000, 40_100)
    assert sum(len(x) for x in index.index.levels) <= 8 * 405


def test_long_texts():
    check_cuts("kelime " * 20_000, 1000, 100)
    check_cuts("x" * 50_000, 1000, 100)
    check_cuts(" " * 5000, 1000, 100)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=60), st.data())
def test_range_maximum(values, data):
    a = data.draw(st.integers(0, len(values) - 1))
    b = data.draw(st.integers(a, len(values) - 1))
    best = max(range(a, b + 1), key=lambda i: (values[i], i))
    assert sp.RangeMaximum(np.array(values, dtype=np.int64), len(values)).strongest(a, b) == (values[best], best)


def test_prefers_paragraph_then_line_then_sentence():
    assert [k for *_, k in sp.plan_cuts("aa bb cc.\n\ndd ee ff gg", 14, 0)][0] == sp.PARAGRAPH
    assert [k for *_, k in sp.plan_cuts("aa bb cc\ndd ee. ff gg", 16, 0)][0] == sp.LINE
    assert sp.plan_cuts("aa bb. cc dd ee", 10, 0)[0] == (0, 6, sp.SENTENCE)
    with pytest.raises(ValueError, match="overlap"):
        sp.plan_cuts("x", 3, 3)


def test_pieces_table(spark):
    items = spark.createDataFrame([("p", "1", "bir iki üç dört beş"), ("p", "2", None), ("p", "3", ""), ("p", "4", "kısa"), ("q", "5", "y" * 50), ("p", "6", "z" * 15), ("p", "6", "z" * 15)], "field_name string, item_key string, text string")
    limits = spark.createDataFrame([("p", 10, 3)], "field_name string, max_chars int, overlap_chars int")
    rows = sp.split_items(items, limits).orderBy("item_key", "piece_no").collect()
    by = {}
    for r in rows:
        by.setdefault(r["item_key"], []).append(r["piece"])
        assert len(r["piece"]) == r["n_chars"] <= 10
    assert by["1"][0] == "bir iki üç" and set(by) == {"1", "3", "4", "6"} and by["3"] == [""]
    assert sorted((r["item_key"], r["forced"]) for r in sp.oversized(items, limits).collect()) == [("1", "no"), ("6", "yes")]
    assert sp.oversized(items.limit(0), limits).count() == 0
