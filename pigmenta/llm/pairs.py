"""Flag question-answer pairs whose answer is defective, with the type of the defect.

Method: answers are *sorted by text*, with names and numbers masked, and compared with their
neighbours: one that is a prefix of the next is a shortened version of it, unless what follows
begins a new sentence. So is one that a passage of its own evidence continues. Lengths at which answers pile up without ending are length limits. Then
rules for copies, refusals and languages follow.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pigmenta.llm.words import fold, plain_words
from pigmenta.session import attach_hot_aware, cut_lineage, spread

EMPTY, TRUNCATED, REFUSAL, COPIES, OTHER_LANGUAGE = "empty", "truncated", "refusal", "copies_question", "other_language"

# What stands where an answer is missing.
STAND_INS = frozenset(
    "n a|na|none|null|nil|nan|tbd|tba|todo|unknown|no answer|not available|not applicable|empty|missing|undefined|"
    "boş|cevap yok|yanit yok|bilgi yok|veri yok|belirtilmemiş|bilinmiyor|cevap girilmedi|"
    "k a|keine antwort|keine angabe|unbekannt|leer|нет ответа|нет данных|xxx".split("|")
)

# What a copy of the question may be introduced with.
QUESTION_LABELS = frozenset("soru sorunuz q question frage вопрос s f cevap yanit answer antwort a".split())

# How a first person declines, by the grammar of each language and set phrases. Folded: every i is a plain one.
DECLINING = [
    re.compile(x)
    for x in (
        r"\b(?!tamam\b)\w+[ae]m[ae]m\b|\b\w+m[iuü]yor(?:um|uz)\b|\b\w+m[ae]yaca[gğ][iı](?:m|z)\b|\bdeğil(?:im|iz)\b|\b\w+[iuü]m[iuü]?z? (?:yok|bulunmuyor)\b|\breddedi?yor(?:um|uz)\b",
        r"\byard[i]mc[i] ol(?:mam mümkün değil|maktan)|\b(?:yan[i]t|cevap) vermem (?:mümkün değil|uygun ol)|\b(?:yan[i]tla|cevapla|söyle|paylaş)mam (?:mümkün değil|uygun ol)|\bsöylemem (?:uygun olmaz|mümkün değil)",
        r"\b(?:i|we)(?: am|'m| are|'re| was)? (?:not able|unable|not allowed|not permitted)\b|\b(?:i|we) (?:cannot|can't|can not|could not|won't|will not|don't|do not|refuse|must decline|have to decline|must refuse|have no)\b|not permitted to (?:answer|comment)",
        r"(?:kann|darf|möchte|werde) ich .{0,40}(?:nicht|nichts|keine)\b|ich .{0,20}(?:kann|darf|möchte|werde) .{0,40}(?:nicht|nichts|keine)\b|muss (?:ich )?(?:diese|die) (?:anfrage|bitte|frage) ablehnen|bin (?:ich )?nicht (?:befugt|berechtigt|in der lage)",
        r"\bя не (?:могу|вправе|имею|знаю)\b|не могу (?:ответить|помочь|сказать|поделиться)",
    )
]
_SENTENCE = re.compile(r"(?<=[.!?;])\s+")

# What a text doesn't end with.
DANGLING = frozenset("ve veya ya ile için gibi kadar en and or of the a an in on at to for with from by und oder der die das dem den ein eine mit von für auf bei nach и или в на с для".split())

_NAME = re.compile(r"(?:[^\W\d_][\w’']*\s+){1,6}(?=[A-Z0-9]*[A-Z])[A-Z0-9]{4,8}\b")
_NUMBER = re.compile(r"\d+(?:[.,:/–-]\d+)*")
_END = re.compile(r"[.!?。؟][\"'”’»)\]]*$")
_CUT = re.compile(r"(?:\.{2,}|…|[,;–—-])\s*$")
_BEGINS = re.compile(r"(?:^|[.!?]\W*\s)[^\w+±%-]*$")
# What may follow a complete statement; a mark, a comma or a word that joins another.
_COMPLETE = re.compile(r"\W*$|[\"'”’»)\]]*\s*[.!?:;,|•]|\s+(?:[–—-]|(?:ve|veya|ya|ancak|ama|fakat|çünkü|and|or|but|while|und|oder|aber|denn|и|или|но|а)\b)")
_LETTERS = re.compile(r"[^\W\d_]+")
ENDED = r"[.!?][\"'”’»)\]]*\s*$"
_SPACE = re.compile(r"\s+")
NAME, NUMBER = "\x01", "0"
PAIR = ["id", "question", "answer", "refused", "asked", "said"]


@dataclass
class PairSettings:
    """Parameters; the defaults are those of production."""

    language_rounds: int = 3  # in which the language model is taught, each over all rows
    language_margin: float = 3.0  # in nats
    frequent: int = 20  # times that a word occurs to count as frequent
    final_share: float = 0.015  # of them at the end of an answer, at most, for a word that doesn't end one
    spike: float = 6.0  # times its surroundings that a length must occur to be a limit
    spike_rows: int = 30  # and times in all
    spike_open: float = 0.8  # share of its answers without an end
    value_words: int = 3  # words of a complete short value, at most


def name_of(question: str) -> str | None:
    """The product named in a question: capitalised words and a code, without the words before it."""
    m = _NAME.search(question)
    if not m:
        return None
    words = m.group().split()
    start = len(words) - 1
    while start and words[start - 1][:1].isupper():
        start -= 1
    # At the beginning of a sentence a capital says nothing; the longest run that the text repeats would be needed.
    return " ".join(words[start:])


def normal(text: str) -> str:
    return _SPACE.sub(" ", text).strip()


def mask(answer: str, name: str | None) -> str:
    """The answer in one case, its name and numbers replaced."""
    text = normal(answer)
    if name:
        text = re.sub(re.escape(name), NAME, text, flags=re.IGNORECASE)
    text = _NAME.sub(lambda m: m.group() if NAME in m.group() else NAME, text)
    return fold(_NUMBER.sub(NUMBER, text))


def stem(masked: str) -> str:
    """A masked answer without marks of being cut at its end."""
    return _CUT.sub("", masked).strip()


def breaks_in_name(answer: str, name: str | None) -> bool:
    """Whether an answer ends inside the name."""
    if not name:
        return False
    tail, whole = fold(stem(normal(answer))), fold(name)
    if tail.endswith(whole):
        return False
    ends = [i for i, c in enumerate(whole) if c == " "]
    for size in range(len(whole) - 1, 2, -1):
        if tail.endswith(whole[:size]) and (len(tail) == size or tail[-size - 1] == " "):
            return size not in ends[:1]  # its first word may be any word
    return False


def copies(question: str, answer: str) -> bool:
    """Whether an answer is nothing but its question, once or more often, perhaps with a label."""
    asked, said = plain_words(question), plain_words(answer)
    if not asked or not said:
        return False
    rest, at, times = [], 0, 0
    while at < len(said):
        if said[at : at + len(asked)] == asked:
            times += 1
            at += len(asked)
        else:
            rest.append(said[at])
            at += 1
    return times > 0 and all(w in QUESTION_LABELS for w in rest)


def empty(answer: str | None) -> bool:
    """Whether an answer is null, blank, only marks or a stand-in."""
    if answer is None:
        return True
    words = plain_words(answer)
    return not words or " ".join(words) in STAND_INS


def informs(answer: str, name: str | None, passages: list[str | None], common: frozenset[str]) -> bool:
    """Whether an answer says what its evidence does: two words of four letters that aren't common ones or in a name stand in both."""
    content = {w for w in plain_words(without_name(answer, name)) if len(w) >= 4 and w not in common}
    told = {w for p in passages if p for w in plain_words(without_name(p, name))}
    return len(content & told) >= 2


def refuses(answer: str, name: str | None) -> bool:
    return declines(mask(answer, name))


def declines(text: str) -> bool:
    """Whether a masked answer declines and gives no information: a first person declines in its first sentence
    (behind an apology of three words at most, if that ends like one), and there is no number in it."""
    if NUMBER in text.replace(NAME, ""):
        return False
    sentences = _SENTENCE.split(text)
    head = " ".join(sentences[:2]) if len(sentences[0].split()) <= 3 else sentences[0]
    return any(p.search(head) for p in DECLINING)


def nameless(masked: str) -> str:
    """A masked text without names and numbers."""
    return masked.replace(NAME, " ").replace(NUMBER, " ")


def without_name(text: str, name: str | None) -> str:
    return nameless(mask(text, name))


BUCKETS = 1 << 18  # features are counted by hash, so the model is of one size whatever the vocabulary


def _bucket(feature: str) -> int:
    return zlib.crc32(feature.encode()) % BUCKETS


class LanguageModel:
    """Naive Bayes over words and three-letter pieces, counted in buckets of their hashes over all pairs.

    What is labelled are questions, first by the common words of the languages, then by the model;
    answers count towards the language of their question if the model doesn't find another one in them.
    """

    def __init__(self, seeds: dict[str, set[str]]) -> None:
        self.seeds = seeds
        self.names = sorted(seeds)
        self.totals: list[float] = []
        self.known = b""  # whether a bucket was seen
        self.logs: np.ndarray | None = None
        self.buckets: dict[str, int] = {}

    @staticmethod
    def features(text: str) -> list[str]:
        out = []
        for w in re.findall(r"[^\W\d_]+", text):
            out.append(w)
            padded = f"_{w}_"
            out += [padded[i : i + 3] for i in range(len(padded) - 2)]
        return out

    def places(self, features: list[str]) -> list[int]:
        known = self.buckets
        if len(known) > 500_000:
            known.clear()
        return [known[f] if f in known else known.setdefault(f, _bucket(f)) for f in features]

    def seeded(self, text: str) -> str | None:
        words = re.findall(r"[^\W\d_]+", text)
        score = {lang: sum(w in s for w in words) for lang, s in self.seeds.items()}
        best = sorted(score.values(), reverse=True)
        return max(score, key=score.get) if best and best[0] > (best[1] if len(best) > 1 else 0) else None

    def label(self, question: str) -> str | None:
        return self.seeded(question) if self.logs is None else self.best(question)[0] or self.seeded(question)

    def counted(self, batches: Iterator[pd.DataFrame], with_answers: bool) -> Iterator[pd.DataFrame]:
        """lang, bucket, n of a task's labelled pairs (asked, said, n: how often)."""
        sums: dict[str, Counter] = {lang: Counter() for lang in self.names}
        for batch in batches:
            for asked, said, times in zip(batch["asked"], batch["said"], batch["n"], strict=True):
                lang = self.label(asked)
                if not lang:
                    continue
                features = self.features(asked)
                if with_answers and self.best(said)[0] in (None, lang):
                    features += self.features(said)
                own = sums[lang]
                for f in self.places(features):
                    own[f] += times
        for n, lang in enumerate(self.names):
            yield pd.DataFrame({"lang": n, "bucket": list(sums[lang]), "n": list(sums[lang].values())}).astype("int64")

    def learned(self, sums: list[tuple[int, int, int]]) -> None:
        """Takes over the sums of all tasks."""
        counts = np.zeros((len(self.names), BUCKETS))
        for lang, bucket, n in sums:
            counts[lang, bucket] = n
        seen = counts.any(axis=0)
        total = counts.sum(axis=1, keepdims=True) + 0.5 * (int(seen.sum()) + 1)
        self.logs = np.log((counts + 0.5) / total).astype(np.float32)
        self.totals, self.known = total[:, 0].tolist(), seen.astype(np.uint8).tobytes()
        self.buckets = {}

    def best(self, text: str) -> tuple[str | None, dict[str, float]]:
        """(language, scores); features that no language has seen are left out."""
        at = [b for b in self.places(self.features(text)) if self.known[b]] if self.logs is not None else []
        if not at:
            return None, {}
        score = dict(zip(self.names, self.logs[:, at].sum(axis=1).tolist(), strict=True))
        return max(score, key=score.get), score

    def differs(self, question: str, answer: str, margin: float) -> bool:
        """Whether an answer is in another language than its question."""
        letters = [c for c in answer if c.isalpha()]
        if letters:
            script = lambda s: sum("Ѐ" <= c <= "ӿ" for c in s) / max(1, len(s))
            asked = [c for c in question if c.isalpha()]
            if abs(script(letters) - script(asked)) > 0.5:
                return True
        lang, _ = self.best(question)
        said, score = self.best(answer)
        if not (lang and said and said != lang and score[said] - score[lang] >= margin):
            return False
        words = [w for w in re.findall(r"[^\W\d_]+", answer) if len(w) > 1]
        own = self.names.index(lang)
        times = np.exp(self.logs[:, self.places(words)]) * np.array(self.totals)[:, None] - 0.5 if words else np.zeros((len(self.names), 0))
        usual = np.flatnonzero(times[own] > 0.1 * times.sum(axis=0) + 0.01)
        return len(usual) < 0.5 * len(words)  # a unit or a term may be common to both


def seed_words(common_words: DataFrame) -> dict[str, set[str]]:
    """The common words of each language, folded: a table of a fixed size."""
    seeds: dict[str, set[str]] = {}
    for r in common_words.select("lang", "word").filter("lang is not null and word is not null").distinct().collect():
        seeds.setdefault(r["lang"], set()).add(fold(r["word"]))
    return seeds


def fit_language_model(pairs: DataFrame, common_words: DataFrame, settings: PairSettings) -> LanguageModel:
    """Fitted on all pairs (asked, said, n: how often), each different one once in a round.

    Tasks count features by language, the sums (languages times BUCKETS at most) make the model.
    Words that several languages have in common don't label.
    """
    seeds = seed_words(common_words)
    shared = Counter(w for s in seeds.values() for w in s)
    model = LanguageModel({lang: {w for w in s if shared[w] == 1} for lang, s in seeds.items()})
    for turn in range(settings.language_rounds):
        counted = pairs.mapInPandas(lambda batches, turn=turn: model.counted(batches, turn > 0), "lang long, bucket long, n long")
        model.learned([tuple(r) for r in counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect()])
    return model


def goes_on(answer: str, name: str | None, passages: list[str | None], value_words: int) -> bool:
    """Whether a passage of the evidence continues an unended answer within its word or sentence.

    Complete short values, whole names and parts from the middle of a sentence that don't have the
    name are excepted, and so is what only a further clause follows.
    """
    text = normal(answer)
    if _END.search(text) or len(text.split()) <= value_words:
        return False
    masked = mask(text, name)
    if masked == NAME:
        return False
    said = fold(text)
    for passage in passages:
        whole = fold(normal(passage or ""))
        at = whole.find(said)
        while at >= 0:
            rest = whole[at + len(said) :]
            apart = not (at and whole[at - 1].isalnum())
            if apart and (NAME in masked or _BEGINS.search(whole[:at])) and not _COMPLETE.match(rest):
                return True
            at = whole.find(said, at + 1)
    return False


def _evidence_batches(batches: Iterator[pd.DataFrame], value_words: int, common: frozenset[str]) -> Iterator[pd.DataFrame]:
    """What needs the evidence of a pair: whether it goes on where the answer ends, and whether the answer
    declines without saying what it says; question and answer without names and numbers, and the masked answer."""
    for batch in batches:
        out = []
        for q, a, e in zip(batch["question"], batch["answer"], batch["evidence"], strict=True):
            name, passages = name_of(q or ""), [] if e is None else list(e)
            going = a is not None and bool(passages) and goes_on(a, name, passages, value_words)
            masked = None if a is None else mask(a, name)
            refused = a is not None and declines(masked) and not informs(a, name, passages, common)
            out.append((going, refused, without_name(q or "", name), None if a is None else nameless(masked), None if a is None else stem(masked)))
        columns = pd.DataFrame(out, columns=["continued", "refused", "asked", "said", "masked"], index=batch.index, dtype=object)
        yield pd.concat([batch.drop(columns="evidence"), columns], axis=1)


def _neighbours(batches: Iterator[pd.DataFrame], compare: Callable[[str, str], bool]) -> Iterator[pd.DataFrame]:
    """In sorted order: how each text compares with its successor; the last one is left open."""
    last: str | None = None
    first = True
    for batch in batches:
        out = []
        for text in batch["text"]:
            if last is not None:
                out.append((last, compare(last, text), "first" if first else "inner"))
                first = False
            last = text
        yield pd.DataFrame(out, columns=["text", "hit", "place"], dtype=object)
    if last is not None:
        yield pd.DataFrame([(last, False, "only" if first else "last")], columns=["text", "hit", "place"], dtype=object)


def shortened(text: str, successor: str) -> bool:
    """Whether ``text`` is a shortened version of the text sorted next."""
    if not text or not successor.startswith(text) or text == successor:
        return False
    rest = successor[len(text) :]
    if _END.search(text) or re.match(r"[\"'”’»)\]]*\s*[.!?:;]", rest):
        return False  # the sentence is whole, another follows
    return not (len(text.split()) == 1 and rest.startswith(","))  # yes or no, then more


def neighbour_comparison(texts: DataFrame, compare: Callable[[str, str], bool]) -> DataFrame:
    """text, hit for every text of a table of distinct texts: whether ``compare(text, its successor)``.

    The texts are sorted by range over all tasks. Only the first and the last text of each task
    go to the driver, to compare across the seams. The sorted texts are written once, so the
    seams are those of the result.
    """
    compared = texts.select("text").orderBy("text").mapInPandas(lambda batches: _neighbours(batches, compare), "text string, hit boolean, place string")
    compared = cut_lineage(compared)
    seams = compared.filter("place <> 'inner'").select("text", "place").collect()  # two a task
    order = sorted((r["text"].encode(), r["text"], r["place"]) for r in seams)
    cut = [a for (_, a, place), (_, b, _) in zip(order, order[1:], strict=False) if place in ("last", "only") and compare(a, b)]
    return compared.select("text", (F.col("hit") | F.col("text").isin(cut)).alias("hit"))


def begins(word: str, successor: str) -> bool:
    """Whether a word is the beginning of the one sorted next."""
    return successor.startswith(word) and successor != word


def length_limits(answers: DataFrame, settings: PairSettings) -> list[int]:
    """Lengths at which answers pile up unended: a histogram of lengths, one row a length."""
    ended = F.col("answer").rlike(ENDED)
    rows = answers.filter("answer is not null").groupBy(F.char_length("answer").alias("size")).agg(F.count("*").alias("n"), F.count_if(~ended).alias("unended")).filter("size >= 20").collect()
    count = {r["size"]: r["n"] for r in rows}
    out = []
    for r in rows:
        around = sorted(count.get(r["size"] + d, 0) for d in range(-5, 6) if d)
        if r["n"] >= settings.spike_rows and r["n"] >= settings.spike * max(1, around[5]) and r["unended"] >= settings.spike_open * r["n"]:
            out.append(r["size"])
    return out


def defective_pairs(pairs: DataFrame, common_words: DataFrame, settings: PairSettings | None = None) -> DataFrame:
    """Distinct (id, defect) of the pairs (id, question, answer, evidence) whose answer is defective.

    At most one defect a pair: empty, copies_question, refusal, truncated, other_language, in
    this order. A null question is an empty text. Ids with several different rows are judged by
    row; rows with null ids are judged like others. An empty table gives an empty result. The
    evidence, array<string>, may be missing.
    """
    settings = settings or PairSettings()
    key = dict(pairs.dtypes)["id"]
    value_words = settings.value_words
    evidence = F.col("evidence") if "evidence" in pairs.columns else F.lit(None).cast("array<string>")
    read = spread(pairs.select("id", "question", "answer", evidence.alias("evidence")), per_task_bytes=1 << 20)
    common = frozenset(w for words in seed_words(common_words).values() for w in words)  # a fixed table
    read = read.mapInPandas(lambda batches: _evidence_batches(batches, value_words, common), f"id {key}, question string, answer string, continued boolean, refused boolean, asked string, said string, masked string")
    once = read.groupBy("id", "question", "answer").agg(*[F.max(c).alias(c) for c in ("continued", "refused", "asked", "said", "masked")])
    rows = cut_lineage(spread(once, per_task_bytes=1 << 20, scan=False))
    continued = rows.filter("continued").select(*PAIR, F.lit(True).alias("shortened"))
    texts = rows.filter("question is not null and answer is not null").groupBy("asked", "said").agg(F.count("*").alias("n"))
    model = fit_language_model(cut_lineage(spread(texts, per_task_bytes=1 << 20, scan=False)), common_words, settings)
    limits = set(length_limits(rows, settings))
    masked = rows.drop("continued")
    counted = masked.filter("masked <> ''").groupBy(F.col("masked").alias("text")).agg(F.count("*").alias("n"))
    shorter = counted.join(neighbour_comparison(counted, shortened).filter("hit"), "text", "left").select(F.col("text").alias("masked"), "n", F.coalesce("hit", F.lit(False)).alias("shortened"))
    last = F.when(~F.col("answer").rlike(ENDED), F.regexp_extract("masked", r"(?U)(?:^|[^\p{L}])(\p{L}+)$", 1))
    flagged = attach_hot_aware(masked.filter("masked <> ''").withColumn("last", last), shorter, "masked", "n").drop("n", "masked")
    ends = final_words(masked, settings).filter("unlikely")
    open_ended = attach_hot_aware(flagged.filter("last <> ''"), ends, "last", "n").select(*PAIR, F.lit(True).alias("shortened"))
    judged = flagged.select(*PAIR, "shortened").unionByName(open_ended).unionByName(continued)
    bare = masked.filter("masked is null or masked = ''").select(*PAIR, F.lit(False).alias("shortened"))
    judged = judged.unionByName(bare).groupBy(*PAIR).agg(F.max("shortened").alias("shortened"))
    margin = settings.language_margin

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[tuple[str, str], bool] = {}  # of the last texts without names, which many pairs share

        def differs(asked: str, said: str) -> bool:
            if len(known) > 100_000:
                known.clear()
            if (asked, said) not in known:
                known[asked, said] = model.differs(asked, said, margin)
            return known[asked, said]

        for batch in batches:
            out = []
            for i, q, a, declined, asked, said, short in zip(*[batch[c] for c in [*PAIR, "shortened"]], strict=True):
                q = q or ""
                name = name_of(q)
                if empty(a):
                    out.append((i, EMPTY))
                elif copies(q, a):
                    out.append((i, COPIES))
                elif declined:
                    out.append((i, REFUSAL))
                elif truncated(a, name, short, limits):
                    out.append((i, TRUNCATED))
                elif differs(asked, said):
                    out.append((i, OTHER_LANGUAGE))
            yield pd.DataFrame(out, columns=["id", "defect"], dtype=object)

    return judged.mapInPandas(judge, f"id {key}, defect string").distinct()


def final_words(masked: DataFrame, settings: PairSettings) -> DataFrame:
    """last, n, unlikely: for each word that ends an answer without a mark, whether an answer may end with it.

    It may not if it is frequent and hardly ever stands at an end, or if it stands nowhere else
    and is the beginning of another word.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[str, list[int]] = {}
        for batch in batches:
            for text, answer in zip(batch["masked"], batch["answer"], strict=True):
                words = _LETTERS.findall(text.replace(NAME, " "))
                ended = bool(_END.search(normal(answer)))
                for i, w in enumerate(words):
                    c = counts.setdefault(w, [0, 0, 0])
                    c[0] += 1
                    if i == len(words) - 1 and text.endswith(w):
                        c[1] += 1
                        c[2] += ended
        yield pd.DataFrame([(w, *c) for w, c in counts.items()], columns=["text", "times", "final", "ended"], dtype=object)

    counted = masked.filter("masked is not null").select("masked", "answer").mapInPandas(count, "text string, times long, final long, ended long")
    words = cut_lineage(counted.groupBy("text").agg(F.sum("times").alias("times"), F.sum("final").alias("final"), F.sum("ended").alias("ended")))
    begun = neighbour_comparison(words, begins)
    frequent = (F.col("times") >= settings.frequent) & (F.col("final") <= settings.final_share * F.col("times"))
    broken = (F.col("final") == F.col("times")) & (F.col("ended") == 0) & F.col("hit")
    return words.filter("final > ended").join(begun, "text").select(F.col("text").alias("last"), F.col("final").alias("n"), (frequent | broken).alias("unlikely"))


def truncated(answer: str, name: str | None, short: bool, limits: set[int]) -> bool:
    """Whether an answer breaks off: shortened, cut by a mark, at a limit, in a name or at a word that needs another."""
    text = normal(answer)
    if _CUT.search(text) or short or breaks_in_name(text, name):
        return True
    if _END.search(text):
        return False
    words = plain_words(text)
    if len(answer) in limits:
        return True
    return len(words) > 1 and words[-1] in DANGLING
