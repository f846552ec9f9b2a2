"""Typed properties from the sections of a data sheet, by declarative rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pigmenta.functions.text import FLAGS, first_match, number, strip

# What marks a section, and the patterns of its values.
NUM = r"(\d+(?:[.,]\d+)?)"
TIME_UNIT = "(dakika|saat|gün)"
TOUCH = rf"Dokunma kuruması:\s*(\d+)\s*[-–]\s*(\d+)\s*{TIME_UNIT}"
RECOAT = rf"Katlar arası bekleme süresi:\s*(\d+)\s*[-–]\s*(\d+)\s*{TIME_UNIT}"
CURE = rf"(?:Son|Sert)\s*Kuruma(?:sı)?\s*:\s*(\d+)\s*{TIME_UNIT}"
SPREAD = rf"{NUM}\s*[-–]\s*{NUM}\s*(m\s?2|m²)"
SHELF = r"(\d+)\s*(yıl|ay|gün)"
TEXTURES = r"(lüks\s*parlak|yarı\s*parlak|tam\s*parlak|parlak|yarı\s*mat|tam\s*mat|mat)"
PLACES = r"(iç\s*cephe|dış\s*cephe)"
INTRO = r"^##[^\n]*\n(.*?)(?=\n##\s|\z)"
TITLE = r"##\s*([^\n]+)"
TRADE_MARKS = "[®™]"
WATER_BASED, LOW_VOC = r"su\s*bazlı", r"VOC\s*Uyumlu"
THINNING_MENTION, THINNING_WINDOW = "[İIiı]nceltme", 200
PERCENT_RANGE = rf"%\s*{NUM}\s*[-–]\s*{NUM}|{NUM}\s*[-–]\s*{NUM}\s*%"
PERCENT_ONE = rf"%\s*{NUM}|{NUM}\s*%"
PACKAGE = rf"{NUM}\s*(Litre|litre|L)\b"


def find_section(sections: Column, *keywords: str) -> Column:
    """Body of the first section whose heading has all keywords; ``sections`` is an array of structs heading, body."""
    found = F.filter(sections, lambda s: reduce(lambda a, b: a & b, [s["heading"].rlike(FLAGS + k) for k in keywords]))
    return F.try_element_at(found, F.lit(1))["body"]


def value_unit(text: Column, pattern: str) -> tuple[Column, Column]:
    return number(first_match(text, pattern, 1)), first_match(text, pattern, 2)


def range_unit(text: Column, pattern: str) -> tuple[Column, Column, Column]:
    return number(first_match(text, pattern, 1)), number(first_match(text, pattern, 2)), first_match(text, pattern, 3)


def percentage(text: Column) -> Column:
    """struct lo, hi of a percentage: the first range, else the first single number twice, the mark before
    or behind it; 0 if a text states none, null without a text."""
    low = F.coalesce(first_match(text, PERCENT_RANGE, 1), first_match(text, PERCENT_RANGE, 3))
    high = F.coalesce(first_match(text, PERCENT_RANGE, 2), first_match(text, PERCENT_RANGE, 4))
    one = F.coalesce(first_match(text, PERCENT_ONE, 1), first_match(text, PERCENT_ONE, 2))
    pair = lambda a, b: F.struct(a.alias("lo"), b.alias("hi"))
    zero = F.lit(0.0)
    return F.when(text.isNull() | (text == ""), None).when(low.isNotNull() & high.isNotNull(), pair(number(low), number(high))).when(one.isNotNull(), pair(number(one), number(one))).otherwise(pair(zero, zero))


def airless_percentage(text: Column) -> Column:
    """The percentage within a window behind the first mention of thinning; null without a mention, or with nothing behind it."""
    at = F.regexp_instr(text, F.lit(THINNING_MENTION))
    return F.when(at > 0, percentage(F.substring(text, at + F.char_length(F.lit("inceltme")), F.lit(THINNING_WINDOW))))


def properties(documents: DataFrame) -> DataFrame:
    """One row of typed properties a document: doc_id and the columns of the property record.

    ``documents``: doc_id, first_page (text), sections array<struct<heading, body>> in order. Flags
    and texture come from the first section of the first page, values from the sections their
    keywords name; what isn't there is null.
    """
    intro = strip(first_match(F.col("first_page"), INTRO, 1))
    parts = F.col("sections")
    drying = find_section(parts, "KURUMA", "SÜRE")
    coverage = F.replace(find_section(parts, "SARFİYAT"), F.lit("\n"), F.lit(" "))
    airless = F.coalesce(find_section(parts, "havasız"), find_section(parts, "airless"), find_section(parts, "püskürtme"))
    packaging = find_section(parts, "AMBALAJ")
    touch = range_unit(drying, TOUCH)
    recoat = range_unit(drying, RECOAT)
    cure = value_unit(drying, CURE)
    spread = range_unit(coverage, SPREAD)
    shelf = value_unit(find_section(parts, "DEPOLAMA"), SHELF)
    sizes = F.transform(F.regexp_extract_all(packaging, F.lit(f"(?U){PACKAGE}"), F.lit(1)), number)
    thin, spray = percentage(find_section(parts, "ncelt")), airless_percentage(airless)
    return documents.select(
        "doc_id",
        strip(F.regexp_replace(first_match(F.col("first_page"), TITLE, 1), TRADE_MARKS, "")).alias("ürün_adı"),
        F.coalesce(intro.rlike(FLAGS + WATER_BASED), F.lit(False)).alias("su_bazlı"),
        F.coalesce(intro.rlike(FLAGS + LOW_VOC), F.lit(False)).alias("voc_uyumlu"),
        F.lower(F.regexp_replace(first_match(intro, PLACES, 1), r"(?U)\s+", " ")).alias("kullanım_alanı"),
        first_match(intro, TEXTURES, 1).alias("doku"),
        *[c.alias(f"dokunma_kuruması_{n}") for c, n in zip(touch, ("min", "max", "birimi"), strict=True)],
        *[c.alias(f"katlar_arası_bekleme_{n}") for c, n in zip(recoat, ("min", "max", "birimi"), strict=True)],
        cure[0].alias("son_kuruma"),
        cure[1].alias("son_kuruma_birimi"),
        spread[0].alias("sarfiyat_min"),
        spread[1].alias("sarfiyat_max"),
        F.when(spread[2].isNotNull(), F.concat(F.regexp_replace(spread[2], r"m\s?2", "m²"), F.lit("/Litre"))).alias("sarfiyat_birimi"),
        thin.alias("inceltme_fırça_rulo"),
        F.when(thin.isNotNull(), "%").alias("inceltme_fırça_rulo_birimi"),
        spray.alias("inceltme_havasız_püskürtme"),
        F.when(spray.isNotNull(), "%").alias("inceltme_havasız_püskürtme_birimi"),
        shelf[0].alias("depolama_süresi"),
        shelf[1].alias("depolama_süresi_birimi"),
        F.coalesce(sizes, F.array().cast("array<double>")).alias("ambalaj_boyutları"),
        first_match(packaging, PACKAGE, 2).alias("ambalaj_boyutları_birimi"),
    )


def flattened(props: DataFrame, fields: list[str], prefix: str = "prop_") -> DataFrame:
    """Properties as flat metadata: prefixed, empty texts and lists null, lists joined by ", ", with all of them as JSON."""
    kinds = dict(props.dtypes)

    def flat(name: str) -> Column:
        c = F.col(f"`{name}`")
        if kinds[name] == "string":
            return F.nullif(c, F.lit(""))
        if kinds[name].startswith("array"):
            text = F.array_join(F.transform(c, lambda x: F.when(x == F.floor(x), x.cast("long").cast("string")).otherwise(x.cast("string")) if "double" in kinds[name] else x.cast("string")), ", ")
            return F.nullif(text, F.lit(""))
        if kinds[name].startswith("struct"):
            return F.to_json(c)
        return c

    return props.select("doc_id", F.to_json(F.struct(*[f"`{f}`" for f in fields])).alias("properties_json"), *[flat(f).alias(prefix + f) for f in fields])
