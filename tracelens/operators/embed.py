"""Embedding at the model boundary: any function from texts to vectors, run in Arrow batches over each different text once."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Embedder = Callable[[list[str]], np.ndarray]


def hashed(dim: int = 64) -> Embedder:
    """A local embedder that needs no model: words are dealt to signed places by their hash."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), np.float32)
        for i, text in enumerate(texts):
            for word in text.lower().split():
                h = hashlib.blake2b(word.encode(), digest_size=8).digest()
                out[i, int.from_bytes(h[:4], "little") % dim] += 1 if h[4] & 1 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)

    return embed


EMBEDDERS: dict[str, Callable[[], Embedder]] = {"hashed": hashed}


def resolve(name: str) -> Embedder:
    """An embedder by name; an unknown one raises."""
    if name not in EMBEDDERS:
        raise KeyError(f"unknown embedder {name}; known: {', '.join(sorted(EMBEDDERS))}")
    return EMBEDDERS[name]()


def embed(rows: DataFrame, text: str, embedder: Embedder, model: str, known: DataFrame | None = None) -> DataFrame:
    """rows with model_id and embedding. Each different text is embedded once, and none that known(text_sha, model_id, embedding)
    has of this model; null texts are empty ones."""

    @F.pandas_udf("array<float>")
    def call(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(list(embedder(batch.tolist())))

    sha = F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)
    named = rows.withColumn("text_sha", sha)
    todo = named.select("text_sha", F.coalesce(F.col(text), F.lit("")).alias("said")).dropDuplicates(["text_sha"])
    had = None
    if known is not None:
        had = known.where(F.col("model_id") == model).select("text_sha", "embedding")
        todo = todo.join(had, "text_sha", "left_anti")
    made = todo.select("text_sha", call("said").alias("embedding"))
    return named.join(made if had is None else made.union(had), "text_sha").withColumn("model_id", F.lit(model))
