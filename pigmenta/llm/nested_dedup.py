"""Collapse records that are the same but for white space, letter case, punctuation or field order.

Method: *Merkle-style bottom-up hashing of nested records*. A content is read as a tree: text is
an ordered node of words, named fields (in lines, lists or JSON) are an unordered node of
name-value nodes. Leaves are normalised and hashed, the digests of children are combined upwards
(sorted first at unordered nodes), records are grouped by the digest of their root, and every
group is confirmed by a comparison of the complete structures.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pigmenta.llm.words import number_aware_words
from pigmenta.session import attach_hot_aware, cut_lineage

# A tree: ("text", words) | ("field", name, tree) | ("fields", [trees], unordered) | ("list", [trees], ordered).

# What separates the named fields of a record, in the order tried.
FIELD_SEPARATORS = [";", "|", "•", "\n", "\t"]

# A comma sets fields apart only before a name and its mark: there are commas in values.
_COMMA = re.compile(r"\s*,\s+(?=[^\W\d_][^:=,\n]{0,60}[:=])")
DEEPEST = 100  # levels of nesting that are read as a record; what is nested deeper is text

_FIELD = re.compile(r"\s*([^\W\d_][^:=\n]{0,60}?)\s*[:=]\s*(\S.*?)\s*", re.DOTALL)
_BULLET = re.compile(r"^[\s*•>\-–]+(?=\D)")


class _Fields(tuple):
    """The (name, value) pairs of a JSON object, repeated names included."""


def _of_json(value: object) -> tuple:
    if isinstance(value, _Fields):
        return ("fields", [("field", tuple(number_aware_words(k)), _of_json(v)) for k, v in value])
    if isinstance(value, list):
        return ("list", [_of_json(v) for v in value])
    return ("text", tuple(number_aware_words("" if value is None else str(value))))


def _too_deep(value: object) -> bool:
    """Whether a JSON value has more than DEEPEST levels; level by level, so no depth breaks it."""
    level = [value]
    for _ in range(DEEPEST):
        level = [x for v in level if isinstance(v, _Fields | list) for x in ((pair[1] for pair in v) if isinstance(v, _Fields) else v)]
        if not level:
            return False
    return True


def parse(content: str) -> tuple:
    """The tree of a content. What is neither JSON (of at most DEEPEST levels) nor at least two named fields is one text.

    So is JSON of one plain field: in other layouts a single name isn't told from words before a colon.
    Numbers stay as they are written.
    """
    stripped = content.strip()
    if stripped[:1] in "{[" and stripped[-1:] in "}]":
        try:
            value = json.loads(stripped, strict=False, parse_float=str, parse_int=str, parse_constant=str, object_pairs_hook=_Fields)
        except (ValueError, RecursionError):
            value = None
        if _too_deep(value):
            value = None
        if isinstance(value, _Fields) and len(value) == 1 and not isinstance(value[0][1], _Fields | list):
            name, plain = value[0]
            return ("text", (*number_aware_words(name), *_of_json(plain)[1]))
        if isinstance(value, _Fields | list):
            return _of_json(value)
    for separator in [*FIELD_SEPARATORS, _COMMA]:
        parts = [p for p in (stripped.split(separator) if isinstance(separator, str) else separator.split(stripped)) if p.strip()]
        if len(parts) < 2:
            continue
        fields = [_FIELD.fullmatch(_BULLET.sub("", p)) for p in parts]
        if all(fields):
            return ("fields", [("field", tuple(number_aware_words(m[1])), ("text", tuple(number_aware_words(m[2])))) for m in fields])
    return ("text", tuple(number_aware_words(stripped)))


def _digest(kind: str, parts: list[bytes]) -> bytes:
    h = hashlib.blake2b(kind.encode(), digest_size=16)
    for p in parts:
        h.update(len(p).to_bytes(4, "big"))
        h.update(p)
    return h.digest()


def merkle(tree: tuple) -> tuple[bytes, str]:
    """(digest of the root, complete canonical structure) of a tree, from the leaves up."""
    kind = tree[0]
    if kind == "text":
        return _digest("text", [w.encode() for w in tree[1]]), "t" + json.dumps(tree[1], ensure_ascii=False)
    if kind == "field":
        digest, structure = merkle(tree[2])
        return _digest("field", [" ".join(tree[1]).encode(), digest]), "f" + json.dumps(tree[1], ensure_ascii=False) + structure
    children = [merkle(t) for t in tree[1]]
    if kind == "fields":
        children.sort()
    return _digest(kind, [d for d, _ in children]), kind[0].upper() + "[" + ",".join(s for _, s in children) + "]"


def _hash_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        made = [merkle(parse(c)) for c in batch["content"]]
        yield pd.DataFrame({"key": list(batch["key"]), "root": [d for d, _ in made], "structure": [s for _, s in made]}, dtype=object)


def root_digests(records: DataFrame) -> DataFrame:
    """key, root (16 bytes), structure of every record (key, content) with a content. Null contents are left out."""
    key = dict(records.dtypes)["key"]
    return records.select("key", "content").filter("content is not null").mapInPandas(_hash_batches, f"key {key}, root binary, structure string")


def collapse(records: DataFrame) -> DataFrame:
    """One row a record: root, structure, representative (its smallest key), copies.

    ``records``: key, content. Rows with a null content make no record; a blank or merely
    punctuated content is the record of no words. Digests are grouped with partial aggregation,
    so a record with very many copies is a few rows a task before anything moves. Roots under
    which structures differ (a collision of digests) are taken apart by structure, so every
    group given out has been compared in full.
    """
    hashed = root_digests(records)
    return hashed.groupBy("root", "structure").agg(F.min("key").alias("representative"), F.count("*").alias("copies"))


def copies_of(records: DataFrame) -> DataFrame:
    """key, representative, copies for every record that has copies, the representative itself left out.

    Each key is expected once; keys that are repeated with the same content count as copies of
    themselves in ``copies`` but give no row, as do null keys. Groups of copies may hold any share of all rows.
    """
    hashed = root_digests(records)
    groups = hashed.groupBy("root").agg(
        F.min("key").alias("representative"), F.count("*").alias("copies"), F.min("structure").alias("low"), F.max("structure").alias("high")
    )
    # What is joined is narrow and written once: groups that have copies, and the digests of all records.
    groups = cut_lineage(groups.filter("copies > 1").select("root", "representative", "copies", (F.col("low") == F.col("high")).alias("sure")))
    sure = groups.filter("sure").drop("sure")
    keyed = cut_lineage(hashed.select("root", "key"))
    found = attach_hot_aware(keyed, sure, "root", "copies").select("key", "representative", "copies")
    collided = hashed.join(groups.filter("not sure").select("root"), "root", "left_semi")
    apart = collided.groupBy("root", "structure").agg(F.min("key").alias("representative"), F.count("*").alias("copies")).filter("copies > 1")
    rest = collided.select("root", "structure", "key").join(apart, ["root", "structure"]).select("key", "representative", "copies")
    if not groups.filter("not sure").limit(1).count():  # as a rule no digests collide
        return found.filter("key <> representative").distinct()
    return found.unionByName(rest).filter("key <> representative").distinct()
