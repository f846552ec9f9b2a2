"""Explicit schemas of the engine's tables; nothing is inferred."""

from __future__ import annotations




PAGE = "doc_id string, source string, page_number int, text string"
BLOCK = "doc_id string, page int, seq int, text string, font_size int, bbox struct<x0:double,y0:double,x1:double,y1:double>"
SPAN = "doc_id string, page int, seq int, x0 double, y0 double, x1 double, y1 double, text string, size double, flags int"
WORD = "doc_id string, page int, seq int, x0 double, y0 double, x1 double, y1 double, text string, size double, is_bold boolean"
LINE = "doc_id string, page int, seq int, kind string, text string, x0 double, y0 double, x1 double, y1 double, bold_ratio double, dominant_size double, block_margin double, inline_prefix string, inline_rest string"
PARENT = "parent_id string, text string, page_number int, source string"
CHILD = "child_id string, parent_id string, text string, page_number int, chunk_index_in_page int, chunk_length int, source string"
QUESTION = "id long, question string, question_type string, evidence array<string>, answer string"
TRIPLE = "subject string, relation string, object string, source_chunk string"
RANGE = "struct<lo:double,hi:double>"
