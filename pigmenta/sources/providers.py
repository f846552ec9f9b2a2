"""Embedding and language models behind interfaces; the defaults need no network."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Embedder = Callable[[list[str]], np.ndarray]
Answerer = Callable[[str, str], str]


def hashing_embedder(size: int = 64) -> Embedder:
    """A deterministic embedding of words by hash, of unit length; a text without words is all zero."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), size))
        for i, text in enumerate(texts):
            for w in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
                out[i, h % size] += 1 if h >> 63 else -1
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(length == 0, 1, length)

    return embed


def with_embeddings(rows: DataFrame, embed: Embedder | None = None, text: str = "text", batch: int = 256) -> DataFrame:
    """Adds ``embedding`` of a text column, asked for in batches; null texts get null."""
    chosen = embed or hashing_embedder()

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            known = texts.dropna()
            out = pd.Series([None] * len(texts), index=texts.index, dtype=object)
            for s in range(0, len(known), batch):
                part = known.iloc[s : s + batch]
                for i, v in zip(part.index, chosen(list(part)), strict=True):
                    out[i] = v.astype(np.float32)
            yield out

    return rows.withColumn("embedding", run(F.col(text)))


def no_answer(system: str, user: str) -> str:
    """Stands where no language model is: its failure value."""
    return ""


def rewritten(questions: DataFrame, rewrite: Callable[[str], str] | None = None) -> DataFrame:
    """Adds ``search_text``: what is embedded for a question, a hypothetical passage if a writer is given."""
    if rewrite is None:
        return questions.withColumn("search_text", F.col("question"))

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else rewrite(t) for t in texts], dtype=object)

    return questions.withColumn("search_text", run("question"))


def answers(contexts: DataFrame, ask: Answerer | None = None, system: str = "Answer from the context only.") -> DataFrame:
    """Adds ``answer`` to (question, context), by a language model behind ``ask``."""
    chosen = ask or no_answer

    @F.pandas_udf("string")
    def run(question: pd.Series, context: pd.Series) -> pd.Series:
        return pd.Series([chosen(system, f"{c or ''}\n\n{q or ''}") for q, c in zip(question, context, strict=True)], dtype=object)

    return contexts.withColumn("answer", run("question", "context"))
