"""Providers of embeddings and of chat answers, with their caches, and the key-value table."""

from __future__ import annotations

import hashlib
import random
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Embedder(Protocol):
    """Turns texts into vectors; runs on the executors, so it must pickle."""

    name: str
    dim: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashEmbedder:
    """A stand-in without a model: signed counts of hashed words. For tests; it says nothing about meaning."""

    def __init__(self, dim: int = 64):
        self.name, self.dim = f"hash-{dim}", dim

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for k, text in enumerate(texts):
            for word in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                out[k, h % self.dim] += 1 if h >> 63 else -1
        return out


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows over their double-precision norms; rows of a norm of 1e-9 or less are left alone."""
    norm = np.sqrt((np.asarray(x, float) ** 2).sum(axis=1, keepdims=True))
    return np.divide(x, norm, out=np.array(x, float), where=norm > 1e-9)


#: Tokens of a text that a model reads; the rest is cut off.
MAX_TOKENS = 512


def cut_tokens(text: str, spans: Callable[[str], list[tuple[int, int]]], limit: int = MAX_TOKENS) -> str:
    """The text up to the end of its token number `limit`; spans gives the places of its tokens."""
    found = spans(text)
    return text if len(found) <= limit else text[: found[limit - 1][1]]


def embed(texts: DataFrame, embedder: Embedder, cache: DataFrame | None = None, id_col: str = "chunk_id", text_col: str = "search_text") -> DataFrame:
    """(chunk_id, key, embedding): unit vectors, the first dim values of each; keys known to cache are not asked for.

    Equal texts are embedded once: the texts' keys are made distinct before the provider runs. An embedder with a
    method spans(text), the places of its tokens, gets each text cut to its MAX_TOKENS; keys are of whole texts.
    """
    key = F.sha2(F.concat(F.lit(f"{embedder.name}|{embedder.dim}|"), F.col(text_col)), 256)
    rows = texts.select(F.col(id_col).alias("chunk_id"), F.col(text_col).alias("text"), key.alias("key"))
    todo = rows.groupBy("key").agg(F.first("text").alias("text"))
    if cache is not None:
        todo = todo.join(cache, "key", "left_anti")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            spans = getattr(embedder, "spans", None)
            asked = [cut_tokens(t, spans) for t in f["text"]] if spans else list(f["text"])
            v = unit_rows(np.asarray(embedder.embed(asked))[:, : embedder.dim])
            yield pd.DataFrame({"key": f["key"], "embedding": list(v.astype(np.float32))})

    made = todo.mapInPandas(run, "key string, embedding array<float>")
    known = made if cache is None else made.unionByName(cache.select("key", "embedding"))
    return rows.select("chunk_id", "key").join(known, "key").select("chunk_id", "key", "embedding")


class ChatError(RuntimeError):
    """A call that failed; temporary tells whether another try makes sense."""

    def __init__(self, message: str, status: int = 0):
        super().__init__(message)
        self.temporary = status == 429 or status >= 500


def chat(send: Callable[[dict], dict], model: str, system: str, user: str, tries: int = 4, wait: float = 0.5, sleep: Callable[[float], None] = time.sleep, **options: object) -> str:
    """One chat completion through send, which takes the request and returns the response or raises ChatError.

    Temporary failures are tried again after wait, doubled each time, within a fifth either way; an empty answer, or
    one cut off at its length, is an error.
    """
    request = {"model": model, "messages": [{"role": "system", "content": system}, {"role": "user", "content": user}], **options}
    for k in range(tries):
        try:
            choice = send(request)["choices"][0]
            break
        except ChatError as e:
            if not e.temporary or k == tries - 1:
                raise
            sleep(wait * 2**k * random.uniform(0.8, 1.2))
    if choice.get("finish_reason") == "length":
        raise ChatError("the answer was cut off")
    if not (choice["message"].get("content") or "").strip():
        raise ChatError("the answer is empty")
    return choice["message"]["content"]


def put(table: DataFrame, key: str, value: str) -> DataFrame:
    """A key-value table with one pair set."""
    return table.filter(F.col("key") != key).unionByName(table.sparkSession.createDataFrame([(key, value)], "key string, value string"))


def get(table: DataFrame, key: str) -> str | None:
    row = table.filter(F.col("key") == key).select("value").first()
    return row[0] if row else None
