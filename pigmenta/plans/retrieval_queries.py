"""Queries on retrieval: dense, sparse, hybrid, contexts, graph; each with its SQL where SQL can express it.

Query sets are the questions whose id is divisible by 50, against all rows. Embeddings are given
for numbers only, so document n and question n are paired with vector n.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pigmenta.functions.vectors import rounded, similarity_of
from pigmenta.operators import answers, chunking, dense, fusion, graph, modes, sparse
from pigmenta.plans.text_queries import TOKENS, strip_sql
from pigmenta.session import attach_asked, cut_lineage, only_asked, spread, table

SQL: dict[str, str] = {}
K = 10
POOL, FINAL = 40, 5
GRAPH_SEEDS, GRAPH_HOPS = 3, 1  # as in the reference


def _questions(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "questions_df").filter("question is not null and id % 50 = 0")
    return q.groupBy(F.col("id").alias("query_id")).agg(F.min("question").alias("query_text"))


QUESTIONS = "q AS (SELECT id AS query_id, min(question) AS query_text FROM questions_df WHERE question IS NOT NULL AND id % 50 = 0 GROUP BY id)"


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def _vector_queries(spark: SparkSession, d: str) -> DataFrame:
    return _vectors(spark, d).filter("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query_embedding"))


VECTORS = """
v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e, label FROM embeddings),
vq AS (SELECT id AS query_id, e AS qe FROM v WHERE id % 50 = 0)
"""
DISTANCE = "round(1 - list_dot_product(e, qe) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(qe, qe)) + 1e-10), 6) + 0.0"


def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    return dense.dense_top_k(_vectors(spark, d), _vector_queries(spark, d), K)


SQL["dense_topk"] = f"""
WITH {VECTORS}, s AS (SELECT query_id, id, {DISTANCE} AS distance FROM v CROSS JOIN vq)
SELECT query_id, id, distance, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS INTEGER) AS rank FROM s QUALIFY rank <= {K}"""


def dense_topk_filtered(spark: SparkSession, d: str) -> DataFrame:
    return dense.dense_top_k(_vectors(spark, d), _vector_queries(spark, d), K, where=F.col("label") == 3)


SQL["dense_topk_filtered"] = f"""
WITH {VECTORS}, s AS (SELECT query_id, id, {DISTANCE} AS distance FROM v CROSS JOIN vq WHERE label = 3)
SELECT query_id, id, distance, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS INTEGER) AS rank FROM s QUALIFY rank <= {K}"""


def dense_similarity(spark: SparkSession, d: str) -> DataFrame:
    top = dense.dense_top_k(_vectors(spark, d), _vector_queries(spark, d), K, metric="l2")
    return top.select("query_id", "id", rounded(similarity_of(F.col("distance"))).alias("similarity"), "rank")


SQL["dense_similarity"] = f"""
WITH {VECTORS}, s AS (SELECT query_id, id, round(list_sum(list_transform(range(1, 65), lambda i: (e[i] - qe[i]) * (e[i] - qe[i]))), 6) + 0.0 AS distance FROM v CROSS JOIN vq)
SELECT query_id, id, round(greatest(0.0, least(1.0, 1 - distance)), 6) + 0.0 AS similarity, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS INTEGER) AS rank FROM s QUALIFY rank <= {K}"""


def dimension_probe(spark: SparkSession, d: str) -> DataFrame:
    return dense.dimension(table(spark, d, "child_chunks"))


SQL["dimension_probe"] = "SELECT CAST(len(embedding) AS INTEGER) AS dimension, count(*) AS n FROM child_chunks WHERE embedding IS NOT NULL GROUP BY 1"


def centroid_outlier(spark: SparkSession, d: str) -> DataFrame:
    return dense.centroid_similarity(_vectors(spark, d), "label").filter("similarity < 0.25").select("id", "label", "similarity")


SQL["centroid_outlier"] = f"""
WITH {VECTORS}, u AS (SELECT label, generate_subscripts(e, 1) AS pos, unnest(e) AS x FROM v),
m AS (SELECT label, pos, avg(x) AS m FROM u GROUP BY ALL), c AS (SELECT label, list(m ORDER BY pos) AS c FROM m GROUP BY label),
s AS (SELECT id, label, round(list_dot_product(e, c) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(c, c)) + 1e-10), 6) + 0.0 AS similarity FROM v JOIN c USING (label))
SELECT * FROM s WHERE similarity < 0.25"""


def pca_2d(spark: SparkSession, d: str) -> DataFrame:
    return dense.project(_vectors(spark, d)).select("id", F.round(F.abs(F.col("components")[0]), 6).alias("x"), F.round(F.abs(F.col("components")[1]), 6).alias("y"))


# Sparse retrieval over the documents.


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")


BM25 = f"""
w AS (SELECT doc_id AS id, {TOKENS} AS words FROM documents),
corpus AS (SELECT count(*) AS n, avg(len(words)) AS avgdl FROM w),
x AS (SELECT id, len(words) AS dl, unnest(words) AS term FROM w),
postings AS (SELECT id, term, dl, count(*) AS tf FROM x GROUP BY ALL),
t AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
raw AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw_idf FROM t, corpus),
terms AS (SELECT term, df, CASE WHEN raw_idf < 0 THEN 0.25 * (SELECT avg(raw_idf) FROM raw) ELSE raw_idf END AS idf FROM raw),
{QUESTIONS},
a AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({TOKENS.replace('text', 'query_text')}) AS term FROM q) GROUP BY ALL),
scored AS (SELECT query_id, id, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS s FROM a JOIN terms USING (term) JOIN postings USING (term), corpus GROUP BY ALL),
bm25 AS (SELECT query_id, id, round(coalesce(s, 0), 6) + 0.0 AS score FROM (SELECT query_id, id FROM q, w) LEFT JOIN scored USING (query_id, id))
"""


def bm25_stats(spark: SparkSession, d: str) -> DataFrame:
    index = sparse.build_index(_documents(spark, d))
    return index.terms.select("term", "df", rounded(F.col("idf")).alias("idf"))


SQL["bm25_stats"] = f"WITH {BM25} SELECT term, df, round(idf, 6) + 0.0 AS idf FROM terms"


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return sparse.sparse_top_k(sparse.build_index(_documents(spark, d)), _questions(spark, d), K)


SQL["bm25_topk"] = f"WITH {BM25} SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM bm25 QUALIFY rank <= {K}"


def bm25_topk_filtered(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", "lang")
    return sparse.sparse_top_k(sparse.build_index(rows), _questions(spark, d), K, where=F.col("lang") == "en")


SQL["bm25_topk_filtered"] = f"""
WITH {BM25} SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank
FROM bm25 WHERE id IN (SELECT doc_id FROM documents WHERE lang = 'en') QUALIFY rank <= {K}"""


# Hybrid retrieval: documents that have a vector.


def _asked_vectors(spark: SparkSession, d: str, queries: DataFrame) -> DataFrame:
    return _vectors(spark, d).join(queries.select(F.col("query_id").alias("id")), "id").select(F.col("id").alias("query_id"), F.col("embedding").alias("query_embedding"))


def _lists(spark: SparkSession, d: str, k: int) -> tuple[DataFrame, DataFrame]:
    queries = _questions(spark, d)
    vectors = _asked_vectors(spark, d, queries)
    docs = _documents(spark, d)
    embedded = _vectors(spark, d).select("id", "embedding").join(docs.select("id"), "id")
    return dense.dense_top_k(embedded, vectors, k), sparse.sparse_top_k(sparse.build_index(docs), queries, k)


HYBRID = f"""
{BM25},
{VECTORS},
hv AS (SELECT v.* FROM v JOIN documents ON id = doc_id),
hq AS (SELECT v.id AS query_id, v.e AS qe FROM v JOIN q ON v.id = q.query_id),
dl AS (SELECT query_id, id, {DISTANCE} AS distance, row_number() OVER (PARTITION BY query_id ORDER BY {DISTANCE}, id) AS rank FROM hv, hq QUALIFY rank <= {{k}}),
sl AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM bm25 QUALIFY rank <= {{k}}),
fu AS (SELECT coalesce(dl.query_id, sl.query_id) AS query_id, coalesce(dl.id, sl.id) AS id,
  round(coalesce(1.0 / (60 + dl.rank), 0) + coalesce(1.0 / (60 + sl.rank), 0), 9) AS rrf, dl.distance AS dense_distance, sl.score AS sparse_score, coalesce(dl.rank, 1000000 + sl.rank) AS o
  FROM dl FULL JOIN sl ON dl.query_id = sl.query_id AND dl.id = sl.id),
fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, o) AS rank FROM fu),
cn AS (SELECT *, CASE WHEN dense_distance IS NOT NULL THEN greatest(0.0, least(1.0, 1 - dense_distance)) END AS ds,
  CASE WHEN sparse_score IS NULL THEN NULL WHEN max(sparse_score) OVER w - min(sparse_score) OVER w < 1e-9 THEN 1.0
    ELSE (sparse_score - min(sparse_score) OVER w) / (max(sparse_score) OVER w - min(sparse_score) OVER w) END AS ss
  FROM fused WHERE rank <= {{k}} WINDOW w AS (PARTITION BY query_id)),
cc AS (SELECT *, round(CASE WHEN ds IS NOT NULL AND ss IS NOT NULL THEN 0.7 * ds + 0.3 * ss ELSE coalesce(ds, ss, 1.0) END, 9) AS c FROM cn),
conf AS (SELECT query_id, id, rrf, dense_distance, sparse_score, rank, round(c, 6) + 0.0 AS confidence, CASE WHEN c < 0.35 THEN 'drop' WHEN c < 0.55 THEN 'low' ELSE 'high' END AS confidence_label FROM cc)
"""


def hybrid_sql(k: int) -> str:
    return HYBRID.replace("{k}", str(k))


def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    return fusion.fuse(*_lists(spark, d, K)).select("query_id", "id", "rrf", "rank")


SQL["rrf_fusion"] = f"WITH {hybrid_sql(K)} SELECT query_id, id, rrf, CAST(rank AS INTEGER) AS rank FROM fused"


def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    return fusion.fuse(*_lists(spark, d, 15), FINAL)


SQL["hybrid_search"] = f"WITH {hybrid_sql(15)} SELECT query_id, id, rrf, dense_distance, sparse_score, CAST(rank AS INTEGER) AS rank FROM fused WHERE rank <= {FINAL}"


def _confident(spark: SparkSession, d: str) -> DataFrame:
    return fusion.confident(fusion.fuse(*_lists(spark, d, POOL), POOL))


def confidence(spark: SparkSession, d: str) -> DataFrame:
    return _confident(spark, d).select("query_id", "id", "rank", "confidence", "confidence_label")


SQL["confidence"] = f"WITH {hybrid_sql(POOL)} SELECT query_id, id, CAST(rank AS INTEGER) AS rank, confidence, confidence_label FROM conf"


def confidence_gate(spark: SparkSession, d: str) -> DataFrame:
    return fusion.gate_report(_confident(spark, d))


SQL["confidence_gate"] = f"""
WITH {hybrid_sql(POOL)} SELECT query_id, max(confidence) AS best, count(*) FILTER (confidence_label = 'high') AS high, count(*) FILTER (confidence_label = 'low') AS low,
  count(*) FILTER (confidence_label = 'drop') AS dropped FROM conf GROUP BY query_id"""


def _final(spark: SparkSession, d: str) -> DataFrame:
    """The gated pool, one result a site, the best five."""
    sites = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.coalesce(F.nullif("site", F.lit("")), F.concat(F.lit("doc"), "doc_id")).alias("site"))
    pool = fusion.gated(_confident(spark, d))
    joined = pool.join(sites, "id")
    return fusion.best_per_parent(joined, F.col("site"), FINAL)


FINAL_SQL = f"""
{hybrid_sql(POOL)},
g AS (SELECT conf.*, text, coalesce(nullif(site, ''), 'doc' || doc_id) AS site FROM conf JOIN documents ON id = doc_id WHERE confidence_label <> 'drop'),
f1 AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY query_id, site ORDER BY rank) = 1),
final AS (SELECT * EXCLUDE (rank), row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM f1 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY f1.rank) <= {FINAL})
"""


def dedupe_by_parent(spark: SparkSession, d: str) -> DataFrame:
    return _final(spark, d).select("query_id", "id", "site", "confidence", "rank")


SQL["dedupe_by_parent"] = f"WITH {FINAL_SQL} SELECT query_id, id, site, confidence, CAST(rank AS INTEGER) AS rank FROM final"


def default_qa(spark: SparkSession, d: str) -> DataFrame:
    """A question's context: the gated, deduplicated best results, low ones marked, joined by rank."""
    found = attach_asked(_documents(spark, d), cut_lineage(_final(spark, d)), "id")
    final = found.withColumn("text", fusion.tagged(F.col("text"), F.col("confidence_label")))
    return final.groupBy("query_id").agg(answers.ordered_text(F.col("text"), F.col("rank"), "\n\n").alias("context"), F.count("*").alias("results"))


SQL["default_qa"] = f"""
WITH {FINAL_SQL} SELECT query_id, string_agg(CASE WHEN confidence_label = 'low' THEN '[DÜŞÜK GÜVEN] ' ELSE '' END || text, chr(10) || chr(10) ORDER BY rank) AS context, count(*) AS results FROM final GROUP BY query_id"""


# Chunks and their parents: sparse retrieval over child chunks.


def _children(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "child_chunks").filter("text is not null").select("child_id", "parent_id", "text", "page_number")
    return chunking.keep_first_in_place(spread(c, per_task_bytes=1 << 20), F.col("child_id"), ["parent_id", "page_number"])


def _parents(spark: SparkSession, d: str, asked: DataFrame | None = None) -> DataFrame:
    """Texts of parents, all or those of the results given."""
    known = table(spark, d, "parent_chunks").filter("text is not null").select("parent_id", "text")
    return (only_asked(known, asked, "parent_id") if asked is not None else known).groupBy("parent_id").agg(F.min("text").alias("text"))


CHILDREN = """
ch AS (SELECT DISTINCT ON (child_id) child_id, parent_id, text, page_number FROM child_chunks WHERE text IS NOT NULL ORDER BY child_id, parent_id NULLS FIRST, page_number NULLS FIRST),
pa AS (SELECT parent_id, min(text) AS parent_text FROM parent_chunks WHERE text IS NOT NULL GROUP BY parent_id)
"""


def parent_expand(spark: SparkSession, d: str) -> DataFrame:
    joined = answers.parent_of(_children(spark, d), _parents(spark, d))
    return joined.select("child_id", "parent_id", F.char_length("context").alias("chars"))


SQL["parent_expand"] = f"WITH {CHILDREN} SELECT child_id, parent_id, CAST(length(coalesce(parent_text, text)) AS INTEGER) AS chars FROM ch LEFT JOIN pa USING (parent_id)"


def _chunk_results(spark: SparkSession, d: str, k: int = FINAL) -> DataFrame:
    children = _children(spark, d).withColumnRenamed("child_id", "id")
    top = sparse.sparse_top_k(sparse.build_index(children.select("id", "text"), once=True), _questions(spark, d), k)
    return attach_asked(children, cut_lineage(top), "id")


CHUNK_RESULTS = f"""
{CHILDREN},
{BM25.replace('FROM documents', 'FROM ch').replace('doc_id AS id', 'child_id AS id')},
top AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM bm25 QUALIFY rank <= {FINAL}),
res AS (SELECT top.*, parent_id, text, page_number FROM top JOIN ch ON id = child_id)
"""


def context_flat(spark: SparkSession, d: str) -> DataFrame:
    results = _chunk_results(spark, d).withColumn("page_number", F.coalesce("page_number", F.lit(0)))
    return answers.flat_context(results)


SQL["context_flat"] = f"WITH {CHUNK_RESULTS} SELECT query_id, string_agg('[Sayfa ' || coalesce(page_number, 0) || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS context FROM res GROUP BY query_id"


def context_parent_child(spark: SparkSession, d: str) -> DataFrame:
    results = cut_lineage(_chunk_results(spark, d))
    return answers.parent_context(answers.parent_of(results, _parents(spark, d, results)))


SQL["context_parent_child"] = f"""
WITH {CHUNK_RESULTS}, o AS (SELECT res.*, coalesce(parent_text, text) AS c FROM res LEFT JOIN pa USING (parent_id) QUALIFY row_number() OVER (PARTITION BY query_id, parent_id ORDER BY rank) = 1)
SELECT query_id, string_agg(c, chr(10) || chr(10) ORDER BY rank) AS context FROM o GROUP BY query_id"""


MODE_POOL = 15


def compare_modes(spark: SparkSession, d: str) -> DataFrame:
    """The four modes over the child chunks, for the stated questions; vectors are asked for by those that have one."""
    queries = _questions(spark, d)
    rows = table(spark, d, "child_chunks").filter("text is not null").select(F.col("child_id").alias("id"), "parent_id", "text", "page_number", "embedding")
    once = chunking.keep_first_in_place(spread(rows, per_task_bytes=1 << 20), F.col("id"), ["parent_id", "page_number"])
    near = cut_lineage(dense.dense_top_k(once.filter(F.size("embedding") == 64), _asked_vectors(spark, d, queries), MODE_POOL))
    sparse_list = cut_lineage(sparse.sparse_top_k(sparse.build_index(once.select("id", "text"), once=True), queries, MODE_POOL))
    found = only_asked(once.select("id", "parent_id", "page_number"), near.select("id").unionByName(sparse_list.select("id")), "id")
    parents = table(spark, d, "parent_chunks").filter("text is not null").groupBy("parent_id").agg(F.min("page_number").alias("page_number"))
    return modes.mode_report(near, sparse_list, found, parents, FINAL)


CHUNK_HYBRID = (
    hybrid_sql(MODE_POOL)
    .replace("FROM documents", "FROM ch")
    .replace("doc_id AS id", "child_id AS id")
    .replace("hv AS (SELECT v.* FROM v JOIN documents ON id = doc_id)", """hv AS (SELECT DISTINCT ON (child_id) child_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM child_chunks
  WHERE text IS NOT NULL AND len(embedding) = 64 AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR isnan(x))))""")
)
SQL["compare_modes"] = f"""
WITH {CHILDREN}, {CHUNK_HYBRID}, pp AS (SELECT parent_id, coalesce(min(page_number), 0) AS above FROM parent_chunks WHERE text IS NOT NULL GROUP BY parent_id),
m AS (SELECT 'semantic' AS mode, query_id, id FROM dl WHERE rank <= {FINAL} UNION ALL SELECT 'hybrid', query_id, id FROM fused WHERE rank <= {FINAL}),
k AS (SELECT mode, query_id, coalesce(page_number, 0) AS own, above FROM m JOIN ch ON id = child_id LEFT JOIN pp USING (parent_id))
SELECT mode, query_id, list_sort(list(DISTINCT own)) AS pages, count(*) AS chunks FROM k GROUP BY ALL
UNION ALL SELECT mode || '_parent_child', query_id, coalesce(list_sort(list(DISTINCT above) FILTER (above IS NOT NULL)), []), count(*) FROM k GROUP BY ALL"""


def _embedded_chunks(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "child_chunks").filter("text is not null and embedding is not null and size(embedding) = 64 and parent_id is not null and chunk_index_in_page is not null and not exists(embedding, x -> isnan(x))")
    once = chunking.keep_first(rows.select("child_id", "parent_id", "text", "chunk_index_in_page", "embedding"), F.col("child_id"), ["parent_id"])
    return once.withColumn("o", F.struct("chunk_index_in_page", "child_id"))


def semantic_breaks(spark: SparkSession, d: str) -> DataFrame:
    grouped = chunking.semantic_groups(_embedded_chunks(spark, d), ["parent_id"], "embedding", "o")
    return grouped.select("child_id", "parent_id", rounded(F.col("distance")).alias("distance"), "is_break", F.col("group_no").cast("long").alias("group_no"))


SQL["semantic_breaks"] = """
WITH r AS (SELECT DISTINCT ON (child_id) child_id, parent_id, chunk_index_in_page AS i, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM child_chunks
  WHERE text IS NOT NULL AND len(embedding) = 64 AND parent_id IS NOT NULL AND chunk_index_in_page IS NOT NULL AND NOT list_bool_or(list_transform(embedding, lambda x: isnan(x))) ORDER BY child_id, parent_id),
n AS (SELECT *, lead(e) OVER (PARTITION BY parent_id ORDER BY i, child_id) AS qe FROM r),
m AS (SELECT child_id, parent_id, i, CASE WHEN qe IS NOT NULL THEN round(1 - list_dot_product(e, qe) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(qe, qe)) + 1e-10), 9) END AS distance FROM n),
t AS (SELECT *, coalesce(distance > round(quantile_cont(distance, 0.9) OVER (PARTITION BY parent_id), 9), false) AS is_break FROM m)
SELECT child_id, parent_id, round(distance, 6) + 0.0 AS distance, is_break,
  CAST(coalesce(sum(CAST(is_break AS INTEGER)) OVER (PARTITION BY parent_id ORDER BY i, child_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS group_no FROM t"""


def semantic_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.semantic_chunks(_embedded_chunks(spark, d), ["parent_id"], "text", "embedding", "o")


# Graph retrieval.


def evidence_corpus(spark: SparkSession, d: str) -> DataFrame:
    return graph.evidence_corpus(table(spark, d, "questions_df")).select("source_question_id", F.col("pos").cast("long").alias("pos"), "parent_id", "content")


EVIDENCE = f"""
e AS (SELECT DISTINCT id, evidence FROM questions_df),
u AS (SELECT id, generate_subscripts(evidence, 1) - 1 AS pos, unnest(evidence) AS raw FROM e),
s AS (SELECT id, pos, {strip_sql('raw')} AS content FROM u),
passages AS (SELECT DISTINCT ON (content) id AS source_question_id, CAST(pos AS BIGINT) AS pos, 'q' || id AS parent_id, content FROM s WHERE content <> '' ORDER BY content, id, pos)
"""
SQL["evidence_corpus"] = f"WITH {EVIDENCE} SELECT * FROM passages"


def _triples(spark: SparkSession, d: str) -> DataFrame:
    """Which product has which texture and place of use, according to which sheet."""
    sheets = table(spark, d, "paint_properties").select(F.col("`ürün_adı`").alias("p"), "doku", F.col("`kullanım_alanı`").alias("k"), "source").distinct()
    part = lambda c, r: sheets.filter(F.col(c).isNotNull() & F.col("p").isNotNull()).select(F.col("p").alias("subject"), F.lit(r).alias("relation"), F.col(c).alias("object"), F.col("source").alias("source_chunk"))
    return part("doku", "doku").unionByName(part("k", "kullanım"))


TRIPLES = """
sh AS (SELECT DISTINCT "ürün_adı" AS p, doku, "kullanım_alanı" AS k, source FROM paint_properties),
tr AS (SELECT p AS subject, doku AS object, source AS source_chunk FROM sh WHERE p IS NOT NULL AND doku IS NOT NULL UNION ALL SELECT p, k, source FROM sh WHERE p IS NOT NULL AND k IS NOT NULL),
me AS (SELECT subject AS entity, source_chunk AS chunk FROM tr UNION SELECT object, source_chunk FROM tr),
ed AS (SELECT subject AS a, object AS b FROM tr UNION SELECT object, subject FROM tr)
"""


def graph_khop(spark: SparkSession, d: str) -> DataFrame:
    triples = _triples(spark, d)
    seeds = triples.select(F.col("object").alias("seed_key"), F.col("object").alias("entity")).distinct()
    return graph.expand(seeds, graph.edges(triples), 2)


SQL["graph_khop"] = f"""
WITH {TRIPLES}, h0 AS (SELECT DISTINCT object AS seed_key, object AS entity, 0 AS hop FROM tr),
h1 AS (SELECT DISTINCT seed_key, b AS entity, 1 AS hop FROM h0 JOIN ed ON entity = a), h2 AS (SELECT DISTINCT seed_key, b AS entity, 2 AS hop FROM h1 JOIN ed ON entity = a)
SELECT seed_key, entity, CAST(min(hop) AS INTEGER) AS hop FROM (SELECT * FROM h0 UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2) GROUP BY ALL"""


def graph_context(spark: SparkSession, d: str) -> DataFrame:
    triples = _triples(spark, d)
    sheets = table(spark, d, "pages").filter("page_id % 50 = 0").select(F.col("page_id").alias("query_id"), F.col("source").alias("chunk"))
    return graph.graph_context(sheets, triples, 0)


SQL["graph_context"] = f"""
WITH {TRIPLES}, sd AS (SELECT DISTINCT page_id AS query_id, source AS chunk FROM pages WHERE page_id % 50 = 0),
en AS (SELECT DISTINCT query_id, entity FROM sd JOIN me USING (chunk)),
al AS (SELECT query_id, chunk FROM sd UNION SELECT query_id, chunk FROM en JOIN me USING (entity))
SELECT query_id, chunk, CASE WHEN sd.chunk IS NULL THEN 'graph' ELSE 'vector' END AS via FROM al LEFT JOIN sd USING (query_id, chunk)""".replace("sd.chunk IS NULL", "(query_id, chunk) NOT IN (SELECT (query_id, chunk) FROM sd)").replace(" FROM al LEFT JOIN sd USING (query_id, chunk)", " FROM al")


def graph_rag(spark: SparkSession, d: str) -> DataFrame:
    """The sheets of the best chunks of each stated question, and those that their entities and these entities' neighbours stand in.

    Chunks are searched by BM25, as only some questions have a vector; a sheet stands for its chunks, as triples name sheets.
    """
    of_sheet = table(spark, d, "child_chunks").filter("text is not null and source is not null").select(F.col("child_id").alias("id"), F.col("source").alias("chunk"))
    index = sparse.build_index(_children(spark, d).select(F.col("child_id").alias("id"), "text"), once=True)
    top = sparse.sparse_top_k(index, _questions(spark, d), GRAPH_SEEDS)
    seeds = cut_lineage(attach_asked(of_sheet, cut_lineage(top), "id").select("query_id", "chunk").distinct())
    return graph.graph_context(seeds, _triples(spark, d), GRAPH_HOPS)


SQL["graph_rag"] = f"""
WITH {CHUNK_RESULTS}, {TRIPLES}, sd AS (SELECT DISTINCT query_id, source AS chunk FROM top JOIN child_chunks ON id = child_id WHERE rank <= {GRAPH_SEEDS} AND text IS NOT NULL AND source IS NOT NULL),
e0 AS (SELECT DISTINCT query_id, entity FROM sd JOIN me USING (chunk)),
e1 AS (SELECT * FROM e0 UNION SELECT query_id, b FROM e0 JOIN ed ON entity = a),
led AS (SELECT DISTINCT query_id, chunk FROM e1 JOIN me USING (entity))
SELECT query_id, chunk, 'vector' AS via FROM sd UNION ALL SELECT query_id, chunk, 'graph' FROM (SELECT * FROM led EXCEPT SELECT * FROM sd)"""


def retrieval_recall(spark: SparkSession, d: str) -> DataFrame:
    passages = graph.evidence_corpus(table(spark, d, "questions_df")).select(F.concat_ws("#", "parent_id", "pos").alias("id"), "content", "source_question_id")
    top = sparse.sparse_top_k(sparse.build_index(passages.select("id", F.col("content").alias("text"))), _questions(spark, d), 3)
    found = graph.retrieval_recall(top.select("query_id", F.col("id").alias("passage")), passages.select(F.col("id").alias("passage"), "source_question_id"))
    return found.agg(rounded(F.avg(F.col("hit").cast("int"))).alias("recall"), F.count_if("hit").alias("hits"), F.count("*").alias("questions"))


SQL["retrieval_recall"] = f"""
WITH {EVIDENCE}, pg AS (SELECT parent_id || '#' || pos AS child_id, content AS text, source_question_id FROM passages),
{BM25.replace('FROM documents', 'FROM pg').replace('doc_id AS id', 'child_id AS id')},
top AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM bm25 QUALIFY rank <= 3),
h AS (SELECT query_id, bool_or(source_question_id = query_id) AS hit FROM top JOIN pg ON id = child_id GROUP BY query_id)
SELECT round(avg(CAST(hit AS INTEGER)), 6) + 0.0 AS recall, count(*) FILTER (hit) AS hits, count(*) AS questions FROM h"""

QUERIES = {
    f.__name__: f
    for f in (
        dense_topk, dense_topk_filtered, dense_similarity, dimension_probe, centroid_outlier, pca_2d, bm25_stats, bm25_topk, bm25_topk_filtered, rrf_fusion, hybrid_search, confidence,
        confidence_gate, dedupe_by_parent, default_qa, parent_expand, context_flat, context_parent_child, compare_modes, semantic_breaks, semantic_chunks, evidence_corpus, graph_khop,
        graph_context, graph_rag, retrieval_recall,
    )
}
