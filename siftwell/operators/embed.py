"""Embedding texts.

An ``Embedder`` turns a batch of texts into vectors; it is made once per worker and gets batches planned by length.
The default hashes tokens into a fixed number of signed buckets, takes the mean and normalises it: it is
deterministic, needs no model, gives unit vectors and the zero vector for texts without tokens.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import Protocol

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from siftwell.functions.vectors import unit_rows
from siftwell.session import spread

MAX_TOKENS = 2048


class Embedder(Protocol):
    dim: int

    def tokens(self, text: str) -> list[int]: ...

    def embed(self, batch: list[list[int]]) -> np.ndarray: ...


@lru_cache(100_000)
def _word_ids(word: str) -> tuple[int, ...]:
    """Hashes of a word and of its camel-case pieces."""
    parts = {word.lower(): None} | {p.lower(): None for p in re.findall(r"[A-Z]?[a-z]+|\d+", word)}
    return tuple(xxhash.xxh3_64_intdigest(p) for p in parts)


class HashEmbedder:
    """Signed hashing of words and their pieces."""

    def __init__(self, dim: int = 256):
        self.dim = dim

    def tokens(self, text: str) -> list[int]:
        return [i for w in re.findall(r"[^\W_]+", text) for i in _word_ids(w)][:MAX_TOKENS]

    def embed(self, batch: list[list[int]]) -> np.ndarray:
        """Mean of the tokens' signed unit buckets, scaled to length 1; the zero vector for none."""
        counts = np.array([len(x) for x in batch])
        if not counts.sum():
            return np.zeros((len(batch), self.dim), np.float32)
        ids = np.concatenate([np.array(x, np.uint64) for x in batch])
        rows = np.repeat(np.arange(len(batch)), counts)
        sign = np.where(ids >> np.uint64(63), 1.0, -1.0)
        cell = rows * self.dim + (ids % np.uint64(self.dim)).astype(np.int64)
        sums = np.bincount(cell, weights=sign, minlength=len(batch) * self.dim).reshape(len(batch), self.dim)
        return unit_rows(sums / np.maximum(counts, 1)[:, None]).astype(np.float32)


def plan_batches(lengths: list[int], max_items: int, max_tokens: int) -> list[list[int]]:
    """Places in order of length, packed greedily while count <= ``max_items`` and count * longest <= ``max_tokens``."""
    out: list[list[int]] = []
    for i in sorted(range(len(lengths)), key=lambda i: (lengths[i], i)):
        if out and len(out[-1]) < max_items and (len(out[-1]) + 1) * lengths[i] <= max_tokens:
            out[-1].append(i)
        else:
            out.append([i])
    return out


def batch_size_for(billions: float | None, hidden: int | None = None) -> int:
    """Texts in a batch for a model's size in billions of parameters, else for its width."""
    if billions is not None:
        return 2 if billions > 6 else 4 if billions > 3 else 8 if billions > 1 else 24
    if hidden is not None:
        return 2 if hidden >= 3000 else 4 if hidden >= 2000 else 8 if hidden >= 1500 else 24
    return 8


def model_billions(name: str) -> float | None:
    """The size that a model's name states, as in ``7b`` or ``0.6B``."""
    m = re.search(r"(\d+(?:\.\d+)?)\s*b(?![a-z0-9]*it)", name.lower())
    return float(m.group(1)) if m else None


def embed_halving(embedder: Embedder, batch: list[list[int]]) -> np.ndarray:
    """Embeds a batch; one that is too large for memory is halved until single texts remain."""
    try:
        return embedder.embed(batch)
    except MemoryError:
        if len(batch) == 1:
            raise
        half = len(batch) // 2
        return np.concatenate([embed_halving(embedder, batch[:half]), embed_halving(embedder, batch[half:])])


def embed_texts(embedder: Embedder, texts: list[str | None], max_items: int = 32, max_tokens: int = 16_384) -> np.ndarray:
    """Vectors in the order of the texts; blank texts get the zero vector."""
    ids = [embedder.tokens(t)[:MAX_TOKENS] if t and t.strip() else [] for t in texts]
    out = np.zeros((len(texts), embedder.dim), np.float32)
    live = [i for i, x in enumerate(ids) if x]
    for batch in plan_batches([len(ids[i]) for i in live], max_items, max_tokens):
        rows = [live[j] for j in batch]
        out[rows] = embed_halving(embedder, [ids[i] for i in rows])
    return out


def embed_text(embedder: Embedder, text: str) -> list[float]:
    """One query's vector; empty for a blank text."""
    return embed_texts(embedder, [text])[0].tolist() if text.strip() else []


def embed_column(text: Column, make: Callable[[], Embedder] = HashEmbedder, max_items: int = 32) -> Column:
    """array<float> column; the embedder is made once per task."""

    @pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        embedder = make()
        for batch in batches:
            yield pd.Series(list(embed_texts(embedder, batch.tolist(), max_items)))

    return run(text)


def embed_chunks(chunks: DataFrame, make: Callable[[], Embedder] = HashEmbedder) -> DataFrame:
    texts = spread(chunks.select("workspace_id", "chunk_id", "content"))
    return texts.select("workspace_id", "chunk_id", embed_column(F.col("content"), make).alias("embedding"))


def batch_plan_col(lengths: Column, max_items: int, max_tokens: int) -> Column:
    """Column form of the planner: from an array of structs (length, id), ids with their batch numbers from 0."""
    start = F.struct(
        F.array().cast("array<struct<id:bigint,batch:int>>").alias("done"), F.lit(-1).alias("batch"), F.lit(0).alias("items")
    )

    def step(s: Column, x: Column) -> Column:
        fits = (s["batch"] >= 0) & (s["items"] < max_items) & ((s["items"] + 1) * x["length"] <= max_tokens)
        n = F.when(fits, s["batch"]).otherwise(s["batch"] + 1)
        row = F.struct(x["id"].cast("bigint").alias("id"), n.alias("batch"))
        return F.struct(
            F.concat(s["done"], F.array(row)).alias("done"), n.alias("batch"), F.when(fits, s["items"] + 1).otherwise(1).alias("items")
        )

    return F.aggregate(F.array_sort(lengths), start, step, lambda s: s["done"])


def batch_table(texts: DataFrame, group: str, length: str, max_items: int, max_tokens: int) -> DataFrame:
    """(group, batch, items, longest): the planner over a table, lengths ascending within each group.

    The fold needs the lengths of a group in one array, so equal lengths are counted first: a row per (group, length),
    however many texts have it."""
    runs = texts.groupBy(group, F.col(length).alias("length")).agg(F.count(F.lit(1)).alias("n"))
    packed = runs.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("length", "n"))).alias("runs"))
    return packed.select(group, F.inline(_pack_runs(max_items, max_tokens)))


def _pack_runs(most: int, tokens: int) -> Column:
    """Batches (batch, items, longest) of runs of equal lengths in ascending order."""
    start = F.struct(
        F.array().cast("array<struct<batch:int,items:bigint,longest:int>>").alias("done"), F.lit(0).cast("bigint").alias("items"), F.lit(0).alias("longest")
    )

    def close(s: Column) -> Column:
        row = F.array(F.struct(F.size(s["done"]).alias("batch"), s["items"].alias("items"), s["longest"].alias("longest")))
        return F.when(s["items"] > 0, F.concat(s["done"], row)).otherwise(s["done"])

    def step(s: Column, x: Column) -> Column:
        room = F.greatest(F.least(F.lit(most), F.floor(F.lit(tokens) / x["length"]).cast("int")), F.lit(1)).cast("bigint")
        fit = F.least(x["n"], F.when(s["items"] > 0, F.greatest(room - s["items"], F.lit(0))).otherwise(room))
        rest = x["n"] - fit
        whole = F.when(rest > 0, F.floor((rest - 1) / room)).otherwise(F.lit(0).cast("bigint"))
        last = rest - whole * room
        filled = F.struct(
            s["done"].alias("done"), (s["items"] + fit).alias("items"), F.when(fit > 0, x["length"]).otherwise(s["longest"]).alias("longest")
        )
        full = close(filled)
        more = F.when(
            whole > 0,
            F.transform(F.sequence(F.lit(1).cast("bigint"), whole), lambda i: F.struct((F.size(full) + i - 1).cast("int").alias("batch"), room.alias("items"), x["length"].alias("longest"))),
        ).otherwise(F.array().cast("array<struct<batch:int,items:bigint,longest:int>>"))
        return F.when(rest == 0, filled).otherwise(F.struct(F.concat(full, more).alias("done"), last.alias("items"), x["length"].alias("longest")))

    return F.aggregate("runs", start, step, close)
