"""Texts that look the same are stored with different characters: give each one consistent form.

Method: *look-alike classes by union-find over strings and code points*. Nodes are code points
and short strings (a letter with its combining marks, the letters of a ligature, the empty
string for what is invisible); edges come from Unicode's own decompositions and from the fixed
table below. Of each class the form that is most frequent in the corpus represents it, and texts
are rewritten greedily, longest match first from the left, by a multi-pattern automaton.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pigmenta.session import attach_hot_aware, cut_lineage

# Letters of other scripts that are drawn like a Latin letter, before it.
DRAWN_ALIKE = (
    # Cyrillic
    "АA ВB СC ЕE НH ІI ЈJ КK МM ОO РP ԚQ ЅS ТT УY ҮY ԜW ХX "
    "аa сc ԁd еe һh іi јj оo рp ԛq ѕs ѵv ԝw хx уy "
    # Greek
    "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX ϹC ͿJ "
    "οo νv ϲc ϳj "
    # Palochka, Armenian and others
    "ӀI ӏl օo հh ոn սu զq յj ցg ՏS ԼL ՕO ՍU ɑa ɡg "
    # Cherokee
    "ᎪA ᏴB ᏟC ᎠD ᎬE ᏀG ᎻH ᎫJ ᏦK ᏞL ᎷM ᏢP ᎡR ᏚS ᎢT ᏙV ᏔW ᏃZ "
    # Lisu
    "ꓮA ꓐB ꓚC ꓓD ꓰE ꓝF ꓖG ꓧH ꓲI ꓙJ ꓗK ꓡL ꓟM ꓠN ꓳO ꓑP ꓣR ꓢS ꓔT ꓴU ꓦV ꓪW ꓫX ꓬY ꓜZ"
).split()

# Hyphens of one length.
HYPHENS = "-\u2010\u2011"

# Marks of category other than Cf that show nothing.
OTHER_INVISIBLE = "\u034f\u115f\u1160\u17b4\u17b5\u3164\uffa0"

DOT_ABOVE = "\u0307"

LINE_CONTROLS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85"


def invisible(ch: str) -> bool:
    """Whether a code point shows nothing and takes no room."""
    kind = unicodedata.category(ch)
    return (
        kind == "Cf"
        or (kind == "Cc" and ch not in LINE_CONTROLS)
        or ch in OTHER_INVISIBLE
        or "\ufe00" <= ch <= "\ufe0f"
        or "\U000e0100" <= ch <= "\U000e01ef"
    )


class UnionFind:
    """Disjoint sets of strings."""

    def __init__(self) -> None:
        self.parent: dict[str, str] = {}

    def find(self, x: str) -> str:
        root = x
        while (up := self.parent.setdefault(root, root)) != root:
            root = up
        while self.parent[x] != root:
            self.parent[x], x = root, self.parent[x]
        return root

    def union(self, a: str, b: str) -> None:
        self.parent[self.find(a)] = self.find(b)

    def classes(self) -> list[list[str]]:
        out: dict[str, list[str]] = {}
        for x in self.parent:
            out.setdefault(self.find(x), []).append(x)
        return list(out.values())


def compatible(ch: str) -> str | None:
    """The plain letters that ``ch`` is a wide, narrow, font or ligature form of, if it is one.

    Superscripts, fractions, circled and squared forms are told apart by a reader and stay.
    """
    tag, _, rest = unicodedata.decomposition(ch).partition(" ")
    if not tag.startswith("<"):
        return None
    plain = unicodedata.normalize("NFKC", ch)
    if tag in ("<wide>", "<narrow>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>"):
        return plain
    letters = "".join(chr(int(x, 16)) for x in rest.split())
    return plain if tag == "<compat>" and letters.isalpha() else None


def look_alike_map(counts: dict[str, int]) -> dict[str, str]:
    """What to rewrite to what, for a corpus with these frequencies.

    ``counts`` has the corpus's code points and its clusters of a code point with combining
    marks. Their number is bounded by the alphabet, not by the corpus.
    """
    sets = UnionFind()
    seen = {ch for k in counts for ch in k}
    single: set[str] = set(seen)
    for ch in seen:
        if invisible(ch):
            sets.union(ch, "")
        elif unicodedata.category(ch) == "Zs":
            sets.union(ch, " ")
        elif plain := compatible(ch):
            sets.union(ch, plain)
            single.update(plain)
    for pair in DRAWN_ALIKE:
        if pair[0] in single:
            sets.union(pair[0], pair[1])
            single.add(pair[1])
    for hyphen in HYPHENS[1:]:
        if hyphen in single:
            sets.union(hyphen, HYPHENS[0])
    alike: dict[str, list[str]] = {}
    for members in sets.classes():
        ones = [x for x in members if len(x) == 1]
        for x in ones:
            alike[x] = ones
    # A letter with a mark: whichever look-alike of the letter carries it. A dot over i, j or ı adds nothing to see.
    marks = [ch for ch in single if unicodedata.combining(ch)]
    for mark in marks:
        for base in list(single):
            if not base.isalpha():
                continue
            for latin in alike.get(base, [base]):
                whole = unicodedata.normalize("NFC", latin + mark)
                if len(whole) == 1:
                    sets.union(base + mark, whole)
            if mark == DOT_ABOVE and (dotted := {"i": "i", "j": "j", "ı": "i"}.get(next((x for x in alike.get(base, [base]) if x in "ijı"), ""))):
                sets.union(base + mark, dotted)
    for ch in list(single):  # precomposed letters of other scripts
        canonical = unicodedata.normalize("NFD", ch)
        if len(canonical) > 1 and ch not in sets.parent:
            sets.union(canonical, ch)

    def frequency(form: str) -> int:
        if form in counts or len(form) < 2:
            return counts.get(form, 0)
        return min(counts.get(ch, 0) for ch in form) if not unicodedata.combining(form[-1]) else 0

    rewrite: dict[str, str] = {}
    for members in sets.classes():
        composed = [x for x in members if unicodedata.normalize("NFC", x) == x] or members
        best = "" if "" in members else max(composed, key=lambda x: (frequency(x), unicodedata.normalize("NFKC", x) == x, -len(x), [-ord(ch) for ch in x]))
        rewrite |= {x: best for x in members if x != best and x}
    return rewrite


class Rewriter:
    """Rewrites texts by a map of patterns; picklable, the automaton is built where it is used."""

    def __init__(self, rewrite: dict[str, str]) -> None:
        self.rewrite = rewrite
        self.automaton = None

    def __getstate__(self) -> dict[str, str]:
        return self.rewrite

    def __setstate__(self, rewrite: dict[str, str]) -> None:
        self.__init__(rewrite)

    def __call__(self, text: str | None) -> str | None:
        """``text`` in its consistent form; null stays null.

        Passes repeat until nothing changes, as taking out an invisible character can bring a letter
        and its mark together. What a pass puts in is no pattern by itself, so it only changes again
        with its neighbours, and then becomes shorter; were passes to come back to a text all the
        same, the smallest text of the cycle is the form of all of them.
        """
        if text is None or not self.rewrite:
            return text
        if self.automaton is None:
            import ahocorasick

            self.automaton = ahocorasick.Automaton()
            for k, v in self.rewrite.items():
                self.automaton.add_word(k, (len(k), v))
            self.automaton.make_automaton()
        seen: list[str] = []
        while True:
            text = unicodedata.normalize("NFC", text) if not text.isascii() else text
            out, last = [], 0
            for end, (length, to) in self.automaton.iter_long(text):
                out += text[last : end + 1 - length], to
                last = end + 1
            if not out:
                return text
            if text in seen:
                return min(seen[seen.index(text) :])
            seen.append(text)
            out.append(text[last:])
            text = "".join(out)


MARKED = re.compile("[^\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f][\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f]+")


def count_forms(texts: Iterable[str]) -> Counter:
    """Frequencies of code points and of code points with a combining mark: of each mark in a stack of them, so
    there are no more forms than pairs of code points, whatever the texts."""
    counts: Counter = Counter()
    for text in texts:
        counts.update(text)
        if not text.isascii():
            for stack in MARKED.findall(text):
                counts.update(stack[0] + mark for mark in stack[1:])
    return counts


def _count_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts: Counter = Counter()
    for batch in batches:
        counts.update(count_forms(batch["text"].dropna()))
    yield pd.DataFrame({"form": list(counts.keys()), "n": list(counts.values())}, dtype=object)


def form_counts(texts: DataFrame) -> dict[str, int]:
    """Frequencies over a whole column ``text``. Each task sends its alphabet, not its texts."""
    rows = texts.select("text").mapInPandas(_count_batches, "form string, n long").groupBy("form").agg(F.sum("n").alias("n"))
    return {r["form"]: r["n"] for r in rows.collect()}


def canonical_forms(records: DataFrame) -> DataFrame:
    """Adds ``form``, the consistent form of ``text``, to ``records``.

    Classes and their representatives are those of all texts together, whatever other columns
    say. Null texts get a null form, empty texts an empty one; rows are neither dropped nor
    joined, and other columns stay (an existing ``form`` is replaced).
    """
    rewriter = Rewriter(look_alike_map(form_counts(records)))

    @F.pandas_udf("string")
    def rewrite(texts: pd.Series) -> pd.Series:
        return pd.Series([rewriter(t) for t in texts], dtype=object)

    return records.withColumn("form", rewrite(F.col("text")))


PART = 10_000  # rows of one key that are joined together


def _keyed(records: DataFrame) -> DataFrame:
    """field_name, form_id, text_id, key of records with a text to see and a key; written once, so no text is rewritten for each use."""
    formed = canonical_forms(records.select("field_name", "key", "text").filter("field_name is not null and text is not null and key is not null"))
    return cut_lineage(
        formed.filter(F.regexp_replace("form", r"(?U)^\s+$", "") != "")
        .select(F.xxhash64("field_name").alias("_field"), "field_name", F.sha2("form", 256).alias("form_id"), F.sha2("text", 256).alias("text_id"), "key")
        .select("field_name", F.concat_ws("/", "_field", "form_id").alias("form_id"), F.concat_ws("/", "_field", "text_id").alias("text_id"), "key")
        .distinct()
    )


def _parts(n: str) -> F.Column:
    return F.ceil(F.col(n) / PART).cast("int")


def _classes(keyed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Texts with the number of their records, and classes of more than one text with the number of texts and records."""
    texts = keyed.groupBy("field_name", "form_id", "text_id").agg(F.count("*").alias("n"))
    return texts, texts.groupBy("form_id").agg(F.count("*").alias("texts"), F.sum("n").alias("records")).filter("texts > 1")


def look_alike_classes(records: DataFrame) -> DataFrame:
    """One row a record whose text looks like another text of its field: field_name, key, class_id, texts, records.

    ``texts`` and ``records`` are those of the class. Records as in :func:`look_alike_pairs`; rows
    grow with the records, not with their pairs.
    """
    keyed = _keyed(records)
    _, classes = _classes(keyed)
    members = attach_hot_aware(keyed, classes, "form_id", "records")
    return members.select("field_name", "key", F.col("form_id").alias("class_id"), "texts", "records")


def look_alike_pairs(records: DataFrame) -> DataFrame:
    """Pairs of keys of one field whose texts look the same and are not the same string.

    ``records``: field_name, key, text. Null and blank texts make no pair, a key makes none with
    itself, repeated rows count once. Within a class only texts that differ are brought
    together, so exact copies are never paired; the rows given out are those asked for. A class of
    many texts and a text of many records are joined in parts of PART rows.
    """
    keyed = _keyed(records)
    texts, classes = _classes(keyed)
    mixed = cut_lineage(attach_hot_aware(texts, classes.drop("records"), "form_id", "texts"))
    # Texts of a class: parts of it against the whole, the other way round for the same two only once.
    one = mixed.select("form_id", "field_name", "text_id", "n", F.pmod(F.xxhash64("text_id"), _parts("texts")).cast("int").alias("part"))
    other = mixed.select("form_id", F.col("text_id").alias("other_id"), F.col("n").alias("m"), F.explode(F.sequence(F.lit(0), _parts("texts") - 1)).alias("part"))
    links = one.join(other, ["form_id", "part"]).filter("text_id < other_id").select("field_name", "text_id", "n", "other_id", "m")
    # Keys of both texts: parts of the one against parts of the other.
    held = attach_hot_aware(keyed.select("text_id", "key"), mixed.select("text_id", "n"), "text_id", "n").select("text_id", "key", F.pmod(F.xxhash64("key"), _parts("n")).cast("int").alias("part"))
    every = lambda n: F.explode(F.sequence(F.lit(0), _parts(n) - 1))
    left = links.withColumn("a", every("n")).join(held.select("text_id", F.col("part").alias("a"), F.col("key").alias("key_1")), ["text_id", "a"]).withColumn("b", every("m"))
    right = links.withColumn("b", every("m")).join(held.select(F.col("text_id").alias("other_id"), F.col("part").alias("b"), F.col("key").alias("key_2")), ["other_id", "b"]).withColumn("a", every("n"))
    return (
        left.select("field_name", "text_id", "other_id", "a", "b", "key_1")
        .join(right.select("text_id", "other_id", "a", "b", "key_2"), ["text_id", "other_id", "a", "b"])
        .filter("key_1 <> key_2")
        .select("field_name", F.least("key_1", "key_2").alias("key_a"), F.greatest("key_1", "key_2").alias("key_b"))
        .distinct()
    )
