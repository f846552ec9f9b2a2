"""SQL for the queries of this subpackage that SQL can express on whole tables."""

from __future__ import annotations

_ITEMS = """
items AS (
  SELECT 'pages.text' AS field_name, CAST(page_id AS VARCHAR) AS item_key, text FROM pages
  UNION ALL SELECT 'parent_chunks.text', parent_id, text FROM parent_chunks)
"""

_WORDS = r"""
  regexp_extract_all(lower(replace(replace(replace(replace({text}, 'İ', 'i'), 'I', 'i'), 'ı', 'i'), 'ß', 'ss')), '[\p{{L}}\p{{N}}\p{{M}}]+')
"""

SQL: dict[str, str] = {
    "p2_found": rf"""
WITH {_ITEMS}
SELECT DISTINCT i.field_name, i.item_key,
  CASE WHEN list_max(list_transform(string_split_regex(i.text, '[ \t\r\n]+'), lambda x: length(x))) > l.max_chars THEN 'yes' ELSE 'no' END AS forced
FROM items i JOIN split_limits l USING (field_name)
WHERE length(i.text) > l.max_chars""",
    "p4_found": """
WITH usable AS (
  SELECT DISTINCT ON (child_id) child_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v
  FROM child_chunks
  WHERE len(embedding) = 64 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
    AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
ranked AS (
  SELECT a.child_id AS x, b.child_id AS y,
    row_number() OVER (PARTITION BY a.child_id ORDER BY round(list_cosine_similarity(a.v, b.v), 6) DESC, b.child_id) AS r
  FROM usable a JOIN usable b ON a.child_id <> b.child_id
  QUALIFY r <= 10)
SELECT DISTINCT least(x, y) AS child_id_a, greatest(x, y) AS child_id_b FROM ranked""",
    "p7_found": f"""
WITH d AS (SELECT doc_id, {_WORDS.format(text="text")} AS w FROM documents),
e AS (SELECT item_id, {_WORDS.format(text="text")} AS w FROM eval_items),
dg AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) AS g FROM d WHERE len(w) >= 12),
eg AS (SELECT item_id, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) AS g FROM e WHERE len(w) >= 12)
SELECT DISTINCT doc_id, item_id FROM dg JOIN eg USING (g)""",
}
