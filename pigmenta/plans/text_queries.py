"""Queries on pages, chunks and layout blocks, each with its SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pigmenta.functions.text import hyphen_joined, hyphen_wrapped, tokens
from pigmenta.operators import chunking, layout, semantic
from pigmenta.session import spread, table
from pigmenta.sources import readers, store

STRIP = r"regexp_replace(regexp_replace({x}, '^[\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}]+', ''), '[\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}]+$', '')"
SPACE_CLASS = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
SQL: dict[str, str] = {}


def strip_sql(x: str) -> str:
    return STRIP.format(x=x)


def nonblank_pages(spark: SparkSession, d: str) -> DataFrame:
    return readers.nonblank_pages(table(spark, d, "pages")).select("page_id", "source", "page_number", F.char_length("text").alias("chars"))


SQL["nonblank_pages"] = f"SELECT page_id, source, page_number, CAST(length(text) AS INTEGER) AS chars FROM pages WHERE {strip_sql('text')} <> ''"

TOKENS = "regexp_extract_all(lower(replace(text, 'İ', 'i̇')), '[a-z0-9]+')"


def tokenize_counts(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "documents").select(F.explode(tokens(F.col("text"))).alias("token"))
    return words.groupBy("token").agg(F.count("*").alias("n"))


SQL["tokenize_counts"] = f"SELECT token, count(*) AS n FROM (SELECT unnest({TOKENS}) AS token FROM documents) GROUP BY token"


def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    return chunking.sentence_rows(table(spark, d, "documents").filter("text is not null"), ["doc_id"])


SQL["sentence_split"] = rf"""
WITH s AS (
  SELECT doc_id, list_filter(list_transform(string_split(regexp_replace({strip_sql('text')}, '([.!?])[\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}]+', '\1' || chr(1), 'g'), chr(1)),
    lambda x: {strip_sql('x')}), lambda x: x <> '') AS l
  FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS sentence_no, unnest(l) AS sentence FROM s"""


def sliding_chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.posexplode(chunking.sliding_pieces(F.col("text"), 256, 32)).alias("chunk_no", "chunk"))


def pieces_sql(text: str, size: int, overlap: int) -> str:
    return f"list_filter(list_transform(range(0, length({text}), {size - overlap}), lambda i: {strip_sql(f'substring({text}, CAST(i AS BIGINT) + 1, {size})')}), lambda p: p <> '')"


SQL["sliding_chunks"] = f"""
WITH s AS (SELECT doc_id, {pieces_sql('text', 256, 32)} AS l FROM documents)
SELECT doc_id, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS chunk_no, unnest(l) AS chunk FROM s"""


def parent_child_chunks(spark: SparkSession, d: str) -> DataFrame:
    pages = spread(table(spark, d, "pages").filter("text is not null"))
    return chunking.parent_child(pages).select("page_id", "parent_id", "child_id", "chunk_index", "chunk_length", "text")


SQL["parent_child_chunks"] = f"""
WITH p AS (SELECT source, page_number, page_id, {pieces_sql('text', 1024, 128)} AS l FROM pages WHERE text IS NOT NULL),
q AS (SELECT source, page_number, page_id, generate_subscripts(l, 1) AS pos, unnest(l) AS parent_text FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY page_number, page_id, pos) - 1 AS parent_no FROM q),
c AS (SELECT source, page_id, parent_no, {pieces_sql('parent_text', 256, 32)} AS l FROM r),
e AS (SELECT source, page_id, parent_no, generate_subscripts(l, 1) - 1 AS chunk_index, unnest(l) AS text FROM c),
n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY parent_no, chunk_index) - 1 AS child_no, regexp_replace(source, '\\.[^.]+$', '') AS stem FROM e)
SELECT page_id, stem || '_parent_' || parent_no AS parent_id, stem || '_child_' || child_no AS child_id, CAST(chunk_index AS INTEGER) AS chunk_index, CAST(length(text) AS INTEGER) AS chunk_length, text FROM n""".replace("\\\\", "\\")


def page_chunk_ids(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").filter("text is not null and source is not null")
    return chunking.page_driver(pages, chunking.sliding_pieces(F.col("text"), 500, 50)).select("page_id", "chunk_id", F.char_length("text").alias("chars"))


SQL["page_chunk_ids"] = f"""
WITH p AS (SELECT source, page_number, page_id, {pieces_sql('text', 500, 50)} AS l FROM pages WHERE text IS NOT NULL AND source IS NOT NULL),
c AS (SELECT source, page_number, page_id, generate_subscripts(l, 1) - 1 AS i, unnest(l) AS text FROM p)
SELECT page_id, 'p' || coalesce(page_number, 0) || '_c' || i || '_' || (row_number() OVER (PARTITION BY source ORDER BY page_number NULLS FIRST, page_id, i) - 1) AS chunk_id, CAST(length(text) AS INTEGER) AS chars FROM c"""


def chunk_dedupe(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "child_chunks").filter("text is not null").select("child_id", "text")
    return chunking.keep_first(chunks, F.col("text"), ["child_id"]).select("child_id", F.char_length("text").alias("chars"))


SQL["chunk_dedupe"] = "SELECT min(child_id) AS child_id, CAST(length(text) AS INTEGER) AS chars FROM child_chunks WHERE text IS NOT NULL GROUP BY text"


def recursive_split(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "pages").filter("text is not null")
    return rows.select("page_id", F.posexplode(chunking.recursive_pieces(500, 50)("text")).alias("piece_no", "piece"))


def structural_units(spark: SparkSession, d: str) -> DataFrame:
    units = chunking.structural_units(table(spark, d, "pages").filter("text is not null"), ["page_id"])
    return units.select("page_id", "unit_no", "unit")


SQL["structural_units"] = rf"""
WITH s AS (SELECT page_id, list_filter(list_transform(string_split_regex(text, '\n[\t\n\x0b\f\r ]*\n'), lambda x: {strip_sql('x')}), lambda x: x <> '') AS l FROM pages WHERE text IS NOT NULL)
SELECT page_id, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS unit_no, unnest(l) AS unit FROM s"""


def unit_headings(spark: SparkSession, d: str) -> DataFrame:
    units = chunking.structural_units(table(spark, d, "pages").filter("text is not null"), ["page_id"])
    return units.groupBy("page_id").agg(F.count_if("is_heading").alias("headings"), F.count("*").alias("units"))


SQL["unit_headings"] = rf"""
WITH u AS ({SQL['structural_units']}), f AS (SELECT page_id, {strip_sql("regexp_extract(unit, '^[^' || chr(10) || ']*')")} AS line FROM u)
SELECT page_id, count(*) FILTER (regexp_matches(line, '^{SPACE_CLASS}*(#{{1,6}}{SPACE_CLASS}+.+|[0-9]{{1,2}}(\.[0-9]{{1,2}})*\.?{SPACE_CLASS}+[A-Z].{{0,80}}|[A-Z]([A-Z\-:]|{SPACE_CLASS}){{4,80}}){SPACE_CLASS}*$')) AS headings, count(*) AS units FROM f GROUP BY page_id"""


def size_constraints(spark: SparkSession, d: str) -> DataFrame:
    units = chunking.structural_units(table(spark, d, "pages").filter("text is not null"), ["page_id"])
    listed = units.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("unit_no", "unit", "is_heading"))).alias("u"))

    @F.pandas_udf("array<string>")
    def sized(groups):  # noqa: ANN001, ANN202
        return pd.Series([chunking.constrain_sizes([x["unit"] for x in g], boundaries=[bool(x["is_heading"]) for x in g]) for g in groups], dtype=object)

    return listed.select("page_id", F.posexplode(sized("u")).alias("chunk_no", "chunk"))


# Layout blocks.


def _sized_blocks(spark: SparkSession, d: str) -> DataFrame:
    blocks = table(spark, d, "blocks").filter("text is not null")
    return blocks.join(layout.body_size(blocks, "source", "font_size", F.lit(1), ["page", "seq", "block_id"]), "source")


BODY = """
o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY page, seq, block_id) AS o FROM blocks WHERE text IS NOT NULL),
f AS (SELECT source, font_size, count(*) AS w, min(o) AS first FROM o WHERE font_size IS NOT NULL GROUP BY ALL),
m AS (SELECT DISTINCT ON (source) source, CAST(font_size AS DOUBLE) AS body_size FROM f ORDER BY source, w DESC, first),
sized AS (SELECT o.*, coalesce(m.body_size, 10.0) AS body_size FROM o LEFT JOIN m USING (source))
"""


def body_size_mode(spark: SparkSession, d: str) -> DataFrame:
    return _sized_blocks(spark, d).select("source", "body_size").distinct()


SQL["body_size_mode"] = f"WITH {BODY} SELECT DISTINCT source, body_size FROM sized"


def body_size_by_chars(spark: SparkSession, d: str) -> DataFrame:
    spans = layout.font_sizes(_spans(spark, d))
    return layout.body_size(spans, "doc_id", "size", F.col("chars"), ["seq"]).select("doc_id", "body_size")


def noise_score(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "blocks").filter("text is not null").select("block_id", layout.noise_tenths(F.col("text")).alias("tenths"))


NOISE = rf"""
CASE WHEN t = '' THEN 10 ELSE least(10,
  CASE WHEN NOT regexp_matches(t, '[.!?]$') THEN 3 ELSE 0 END
  + CASE WHEN length(t) / len(string_split(t, chr(10))) < 25 AND length(t) < 150 THEN 3 ELSE 0 END
  + CASE WHEN length(regexp_replace(t, '[\p{{L}}\p{{N}}_\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}.,;:!?()''"%-]', '', 'g')) / length(t) > 0.03 THEN 2 ELSE 0 END
  + CASE WHEN length(t) / len(list_filter(string_split_regex(t, '{SPACE_CLASS}+'), lambda x: x <> '')) > 12 THEN 2 ELSE 0 END) END
"""
SQL["noise_score"] = f"SELECT block_id, CAST({NOISE} AS INTEGER) AS tenths FROM (SELECT block_id, {strip_sql('text')} AS t FROM blocks WHERE text IS NOT NULL)"


def noise_filter(spark: SparkSession, d: str) -> DataFrame:
    return layout.without_noise(_sized_blocks(spark, d)).select("block_id")


SQL["noise_filter"] = f"""
WITH {BODY}
SELECT block_id FROM (SELECT block_id, font_size, body_size, {strip_sql('text')} AS t FROM sized)
WHERE NOT ({NOISE} >= 5) AND NOT coalesce(font_size < 0.92 * body_size, false)"""


def sections_from_fonts(spark: SparkSession, d: str) -> DataFrame:
    clean = layout.without_noise(_sized_blocks(spark, d), exempt_headings=True)
    return layout.font_sections(clean, "source", ["page", "seq", "block_id"]).select("source", F.col("section_no").cast("long").alias("section_no"), "heading", "text")


SQL["sections_from_fonts"] = f"""
WITH {BODY},
n AS (SELECT *, {strip_sql('text')} AS t, coalesce(font_size > 1.15 * body_size, false) AS is_heading FROM sized),
clean AS (SELECT * FROM n WHERE NOT (({NOISE} >= 5 OR coalesce(font_size < 0.92 * body_size, false)) AND NOT is_heading)),
s AS (SELECT *, sum(CAST(is_heading AS INTEGER)) OVER w AS section_no,
    last_value(CASE WHEN is_heading THEN t END IGNORE NULLS) OVER w AS heading FROM clean WINDOW w AS (PARTITION BY source ORDER BY page, seq, block_id))
SELECT source, CAST(section_no AS BIGINT) AS section_no, max(heading) AS heading, string_agg(replace(t, chr(10), ' '), ' ' ORDER BY page, seq, block_id) AS text
FROM s WHERE NOT is_heading GROUP BY source, section_no HAVING text <> ''"""


def structural_chunks(spark: SparkSession, d: str) -> DataFrame:
    clean = layout.without_noise(_sized_blocks(spark, d))
    parts = layout.font_sections(clean, "source", ["page", "seq", "block_id"]).withColumnRenamed("source", "doc_id")
    return chunking.structural_parent_child(parts).select("doc_id", "parent_id", "child_id", "heading", "content")


def sections_from_headings(spark: SparkSession, d: str) -> DataFrame:
    pages = spread(table(spark, d, "pages").filter("text is not null"))
    return layout.sections(pages, "source", ["page_number", "page_id"]).select("source", F.col("section_no").cast("long").alias("section_no"), "heading", "body")


SECTIONS = rf"""
l AS (SELECT source, page_number, page_id, generate_subscripts(x, 1) AS line_no, unnest(x) AS line FROM (SELECT *, string_split(text, chr(10)) AS x FROM pages WHERE text IS NOT NULL)),
g AS (SELECT *, starts_with(line, '## ') AS h, sum(CAST(starts_with(line, '## ') AS INTEGER)) OVER (PARTITION BY page_id ORDER BY line_no) AS no FROM l),
b AS (SELECT source, page_number, page_id, no, max(CASE WHEN h THEN {strip_sql("substring(line, 4)")} END) AS title,
    {strip_sql("coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT h), '')")} AS own FROM g WHERE no > 0 GROUP BY ALL),
lb AS (SELECT *, last_value(own) OVER (PARTITION BY page_id, title ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS body FROM b),
r AS (SELECT *, no - coalesce(max(CASE WHEN body <> '' THEN no END) OVER (PARTITION BY page_id ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS in_run,
    lead(title) OVER w AS next_title, lead(body) OVER w AS next_body, lag(body) OVER w AS prev_body FROM lb WINDOW w AS (PARTITION BY page_id ORDER BY no)),
j AS (SELECT source, page_number, page_id, no, CASE WHEN body = '' AND next_title IS NOT NULL THEN {strip_sql("title || ' ' || next_title")} ELSE title END AS heading, CASE WHEN body = '' AND next_title IS NOT NULL THEN next_body ELSE body END AS body
    FROM r WHERE in_run % 2 = 1),
first_last AS (SELECT source, heading, min((page_number, page_id, no)) AS first, max_by(body, (page_number, page_id, no)) AS body FROM j GROUP BY ALL),
sections AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY first) - 1 AS section_no, heading, body FROM first_last)
"""
SQL["sections_from_headings"] = f"WITH {SECTIONS} SELECT source, section_no, heading, body FROM sections"


def boilerplate_lines(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").filter("text is not null").select("source", "page_number", "page_id", "text")
    kept = layout.without_boilerplate(pages, "source", "page_id", share=0.3)
    return kept.groupBy("source").agg(F.count("*").alias("lines"), F.sum(F.char_length("line")).alias("chars"))


SQL["boilerplate_lines"] = f"""
WITH l AS (SELECT source, page_id, unnest(string_split(text, chr(10))) AS line FROM pages WHERE text IS NOT NULL),
k AS (SELECT *, {strip_sql('line')} AS key FROM l),
c AS (SELECT source, count(DISTINCT page_id) AS pages FROM pages WHERE text IS NOT NULL GROUP BY source),
f AS (SELECT source, key, count(DISTINCT page_id) AS seen FROM k WHERE key <> '' AND length(key) <= 120 GROUP BY ALL),
often AS (SELECT f.source, f.key FROM f JOIN c USING (source) WHERE pages >= 4 AND seen >= greatest(2, floor(pages * 0.3)))
SELECT source, count(*) AS lines, CAST(sum(length(line)) AS BIGINT) AS chars FROM k ANTI JOIN often USING (source, key) GROUP BY source"""


def hyphen_join(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "pages").filter("text is not null").select("page_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    nxt = F.lead("line").over(Window.partitionBy("page_id").orderBy("line_no"))
    pairs = lines.withColumn("following", nxt).filter("following is not null")
    return pairs.select("page_id", "line_no", hyphen_wrapped(F.col("line"), F.col("following")).alias("wrapped"), hyphen_joined(F.col("line"), F.col("following")).alias("joined"))


SQL["hyphen_join"] = rf"""
WITH l AS (SELECT page_id, CAST(generate_subscripts(x, 1) - 1 AS INTEGER) AS line_no, unnest(x) AS line FROM (SELECT page_id, string_split(text, chr(10)) AS x FROM pages WHERE text IS NOT NULL)),
p AS (SELECT *, lead(line) OVER (PARTITION BY page_id ORDER BY line_no) AS following FROM l),
w AS (SELECT *, regexp_matches(line, '\p{{L}}-{SPACE_CLASS}*$') AND regexp_matches(following, '^{SPACE_CLASS}*\p{{Ll}}') AS wrapped FROM p WHERE following IS NOT NULL)
SELECT page_id, line_no, wrapped,
  CASE WHEN wrapped THEN regexp_replace(line, '-{SPACE_CLASS}*$', '') || regexp_replace(following, '^{SPACE_CLASS}+', '') ELSE line || ' ' || following END AS joined FROM w"""


def gap_projection(spark: SparkSession, d: str) -> DataFrame:
    boxes = table(spark, d, "blocks").filter("bbox is not null").select("source", "page", F.col("bbox.y0").alias("y0"), F.col("bbox.y1").alias("y1"))
    return layout.gaps(boxes, ["source", "page"], "y0", "y1", 3.0)


SQL["gap_projection"] = """
WITH b AS (SELECT source, page, bbox.y0 AS y0, bbox.y1 AS y1 FROM blocks WHERE bbox IS NOT NULL),
r AS (SELECT *, max(y1) OVER (PARTITION BY source, page ORDER BY y0, y1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap_start FROM b)
SELECT DISTINCT source, page, gap_start, y0 AS gap_end FROM r WHERE y0 - gap_start > 3.0"""


def box_overlap(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "blocks").filter("bbox is not null").select("source", "page", "block_id", "bbox")
    other = b.select("source", "page", F.col("block_id").alias("other_id"), F.col("bbox").alias("other"))
    pairs = b.join(other, ["source", "page"]).filter("block_id <> other_id")
    return pairs.select("block_id", "other_id", (F.round(layout.overlap_ratio("bbox", "other"), 6) + F.lit(0.0)).alias("ratio")).filter("ratio > 0")


SQL["box_overlap"] = """
WITH p AS (SELECT a.block_id, b.block_id AS other_id, a.bbox AS x, least(a.bbox.x1, b.bbox.x1) - greatest(a.bbox.x0, b.bbox.x0) AS w, least(a.bbox.y1, b.bbox.y1) - greatest(a.bbox.y0, b.bbox.y0) AS h
  FROM blocks a JOIN blocks b ON a.source = b.source AND a.page = b.page AND a.block_id <> b.block_id)
SELECT block_id, other_id, round(w * h / (greatest(x.x1 - x.x0, 1e-6) * greatest(x.y1 - x.y0, 1e-6)), 6) + 0.0 AS ratio FROM p WHERE w > 0 AND h > 0 AND round(w * h / (greatest(x.x1 - x.x0, 1e-6) * greatest(x.y1 - x.y0, 1e-6)), 6) > 0"""


def _words(spark: SparkSession, d: str) -> DataFrame:
    """Words of the pages with places derived from their number: twelve to a line."""
    rows = table(spark, d, "pages").filter("text is not null").select(F.col("page_id").alias("doc_id"), F.coalesce("page_number", F.lit(0)).alias("page"), F.posexplode(F.filter(F.split("text", r"(?U)\s+"), lambda w: w != "")).alias("seq", "text"))
    x, y = (F.col("seq") % 12) * 50.0, F.floor(F.col("seq") / 12) * 14.0
    return rows.select("doc_id", "page", "seq", x.alias("x0"), y.alias("y0"), (x + 45.0).alias("x1"), (y + 10.0).alias("y1"), "text", F.lit(10.0).alias("size"), (F.col("text") == F.upper("text")).alias("is_bold"))


def dedupe_words(spark: SparkSession, d: str) -> DataFrame:
    words = _words(spark, d)
    drifted = words.withColumns({"seq": F.col("seq") + 100_000, "x0": F.col("x0") + 1.0, "x1": F.col("x1") + 1.0})
    kept = layout.without_near_duplicates(words.unionByName(drifted), ["doc_id", "page"])
    return kept.groupBy("doc_id").agg(F.count("*").alias("words"))


SQL["dedupe_words"] = f"""
SELECT page_id AS doc_id, CAST(len(list_filter(string_split_regex(text, '{SPACE_CLASS}+'), lambda x: x <> '')) AS BIGINT) AS words FROM pages
WHERE text IS NOT NULL AND len(list_filter(string_split_regex(text, '{SPACE_CLASS}+'), lambda x: x <> '')) > 0"""


def xy_cut(spark: SparkSession, d: str) -> DataFrame:
    words = _words(spark, d)
    return layout.page_texts(words, layout.body_size(words, "doc_id", "size", F.char_length("text"), ["seq"]))


def neighbour_window(spark: SparkSession, d: str) -> DataFrame:
    rows = chunking.sentence_rows(table(spark, d, "documents").filter("text is not null"), ["doc_id"])
    return chunking.neighbourhoods(rows, ["doc_id"], "sentence", "sentence_no").select("doc_id", "sentence_no", "neighbourhood")


SQL["neighbour_window"] = f"""
WITH rows AS ({SQL['sentence_split']})
SELECT doc_id, sentence_no, string_agg(sentence, ' ') OVER (PARTITION BY doc_id ORDER BY sentence_no ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS neighbourhood FROM rows"""


def upsert_last_wins(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").filter("page_number is not null").select(F.concat_ws("#", "source", "page_number").alias("id"), "page_id", F.char_length("text").alias("chars"))
    return store.last_wins(pages, "id", "page_id")


SQL["upsert_last_wins"] = "SELECT DISTINCT ON (id) source || '#' || page_number AS id, page_id, CAST(length(text) AS INTEGER) AS chars FROM pages WHERE page_number IS NOT NULL ORDER BY id, page_id DESC"


def incremental_ingest(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").select("page_id", "source")
    done = table(spark, d, "child_chunks").select("source")
    return store.unseen(pages, done).select("page_id", "source")


SQL["incremental_ingest"] = "SELECT page_id, source FROM pages ANTI JOIN (SELECT DISTINCT source FROM child_chunks) USING (source)"

def page_subset(spark: SparkSession, d: str) -> DataFrame:
    return readers.selected_pages(table(spark, d, "pages"), [1, 2]).select("page_id", "source", "page_number")


SQL["page_subset"] = "SELECT page_id, source, page_number FROM pages WHERE page_number IN (1, 2)"


def get_by_ids(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "child_chunks").select("parent_id").distinct()
    return table(spark, d, "parent_chunks").join(ids, "parent_id", "left_semi").select("parent_id", F.char_length("text").alias("chars")).distinct()


SQL["get_by_ids"] = "SELECT DISTINCT parent_id, CAST(length(text) AS INTEGER) AS chars FROM parent_chunks WHERE parent_id IN (SELECT parent_id FROM child_chunks)"


def collection_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "child_chunks").groupBy("source").agg(F.count("*").alias("chunks"), F.count_distinct("parent_id").alias("parents"))


SQL["collection_counts"] = "SELECT source, count(*) AS chunks, count(DISTINCT parent_id) AS parents FROM child_chunks GROUP BY source"


def _spans(spark: SparkSession, d: str) -> DataFrame:
    """Blocks as spans of their lines, bold where a line is in capitals."""
    rows = table(spark, d, "blocks").filter("text is not null and bbox is not null").select("block_id", F.coalesce("font_size", F.lit(10)).alias("s"), "bbox", F.posexplode(F.split("text", "\n")).alias("seq", "text"))
    y = F.col("bbox.y0") + F.col("seq") * 12.0
    return rows.select(F.col("block_id").alias("doc_id"), F.lit(1).alias("page"), "seq", F.col("bbox.x0").alias("x0"), y.alias("y0"), F.col("bbox.x1").alias("x1"), (y + 10.0).alias("y1"), "text", F.col("s").cast("double").alias("size"), F.when(F.col("text") == F.upper("text"), 16).otherwise(0).alias("flags"))


SPANS = """sp AS (SELECT block_id AS doc_id, generate_subscripts(l, 1) - 1 AS seq, bbox, unnest(l) AS text, CAST(coalesce(font_size, 10) AS DOUBLE) AS size
  FROM (SELECT *, string_split(text, chr(10)) AS l FROM blocks WHERE text IS NOT NULL AND bbox IS NOT NULL))"""


def font_census(spark: SparkSession, d: str) -> DataFrame:
    return layout.font_sizes(_spans(spark, d)).groupBy("size").agg(F.sum("chars").alias("chars"), F.count("*").alias("spans"))


SQL["font_census"] = f"WITH {SPANS} SELECT size, CAST(sum(length({strip_sql('text')})) AS BIGINT) AS chars, count(*) AS spans FROM sp WHERE {strip_sql('text')} <> '' GROUP BY size"


SQL["body_size_by_chars"] = f"""
WITH {SPANS}, s AS (SELECT doc_id, seq, round(size, 1) AS size, length({strip_sql('text')}) AS chars FROM sp WHERE {strip_sql('text')} <> ''),
w AS (SELECT doc_id, size, sum(chars) AS w, min(seq) AS first FROM s GROUP BY ALL)
SELECT DISTINCT ON (doc_id) doc_id, size AS body_size FROM w ORDER BY doc_id, w DESC, first"""


def block_scan(spark: SparkSession, d: str) -> DataFrame:
    spans = _spans(spark, d).withColumns({"block_no": F.lit(0), "line_no": F.col("seq")})
    return readers.blocks_from_spans(spans).select("doc_id", "text", "font_size")


SQL["block_scan"] = f"WITH {SPANS} SELECT doc_id, string_agg(text, chr(10) ORDER BY seq) AS text, CAST(max(size) AS INTEGER) AS font_size FROM sp GROUP BY doc_id"


def styled_words(spark: SparkSession, d: str) -> DataFrame:
    spans = _spans(spark, d)
    words = spans.select("doc_id", "page", "seq", (F.col("x0") + 1).alias("x0"), (F.col("y0") + 7).alias("y0"), (F.col("x0") + 21).alias("x1"), (F.col("y0") + 15).alias("y1"), "text")
    styled = layout.styled_words(words, spans)
    return styled.select("doc_id", "seq", "size", "is_bold")


SQL["styled_words"] = f"""
WITH {SPANS}, s AS (SELECT doc_id, seq, text, size, bbox.x0 AS x0, bbox.y0 + seq * 12.0 AS y0, bbox.x1 AS x1, bbox.y0 + seq * 12.0 + 10.0 AS y1 FROM sp),
w AS (SELECT doc_id, seq, x0 + 1 AS x0, y0 + 7 AS y0, x0 + 21 AS x1, y0 + 15 AS y1 FROM s),
p AS (SELECT w.doc_id, w.seq, s.seq AS span_seq, s.size, s.text, least(w.x1, s.x1) - greatest(w.x0, s.x0) AS a, least(w.y1, s.y1) - greatest(w.y0, s.y0) AS b, w FROM w JOIN s USING (doc_id)),
r AS (SELECT *, CASE WHEN a <= 0 OR b <= 0 THEN 0.0 ELSE a * b / (greatest(w.x1 - w.x0, 1e-6) * greatest(w.y1 - w.y0, 1e-6)) END AS ratio FROM p),
m AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY doc_id, seq ORDER BY ratio DESC, span_seq) = 1)
SELECT doc_id, CAST(seq AS INTEGER) AS seq, CASE WHEN ratio >= 0.5 THEN size ELSE 10.0 END AS size, CASE WHEN ratio >= 0.5 THEN text = upper(text) ELSE false END AS is_bold FROM m"""


def flat_section_chunks(spark: SparkSession, d: str) -> DataFrame:
    clean = layout.without_noise(_sized_blocks(spark, d))
    parts = layout.font_sections(clean, "source", ["page", "seq", "block_id"])
    return parts.select("source", "section_no", "heading", F.posexplode(chunking.recursive_pieces(500, 50)("text")).alias("chunk_no", "chunk"))


def semantic_text_chunks(spark: SparkSession, d: str) -> DataFrame:
    return semantic.semantic_text_chunks(table(spark, d, "pages").filter("text is not null").select("page_id", "text"), ["page_id"])


def hybrid_chunks(spark: SparkSession, d: str) -> DataFrame:
    return semantic.hybrid_chunks(table(spark, d, "pages").filter("text is not null").select("page_id", "text"), ["page_id"])


def semantic_children(spark: SparkSession, d: str) -> DataFrame:
    return semantic.semantic_children(table(spark, d, "parent_chunks").filter("text is not null").groupBy("parent_id").agg(F.min("text").alias("text")))


QUERIES = {
    f.__name__: f
    for f in (
        nonblank_pages, tokenize_counts, sentence_split, sliding_chunks, parent_child_chunks, page_chunk_ids, chunk_dedupe, recursive_split, structural_units, unit_headings, size_constraints,
        body_size_mode, body_size_by_chars, noise_score, noise_filter, sections_from_fonts, structural_chunks, sections_from_headings, boilerplate_lines, hyphen_join, gap_projection, box_overlap,
        page_subset, get_by_ids, collection_counts, font_census, block_scan, styled_words, flat_section_chunks, semantic_text_chunks, hybrid_chunks, semantic_children, dedupe_words, xy_cut, neighbour_window, upsert_last_wins, incremental_ingest,
    )
}
