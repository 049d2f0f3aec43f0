"""Reranking a bounded list of candidates.

A ``Reranker`` scores (query, documents) in batches. The default scores by weighted overlap of words; the neutral one
gives 0 to all, which keeps the order. The deadline is looked at between batches.
"""

from __future__ import annotations

import math
import re
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.errors import PythonException
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from siftwell.functions.text import content_words, query_tokens
from siftwell.operators.sparse import terms_of

DOC_CHARS = 1000
QUERY_TOKENS = 128


class RerankFailure(RuntimeError):
    """The reranker could not score a batch."""


class RerankTimeout(RerankFailure):
    """The deadline passed before all batches were scored."""


def is_failure(error: BaseException) -> bool:
    """Whether a failed query failed in its reranker: the worker's last error is one of the two above."""
    if isinstance(error, RerankFailure):
        return True
    last = [line for line in str(error).split("\n") if re.match(r"\s*(?:\w+\.)*[A-Z]\w*(?:Error|Exception|Failure|Timeout|Interrupt)\b", line)]
    return isinstance(error, PythonException) and any(re.match(r"\s*(?:\w+\.)*Rerank(?:Failure|Timeout)\b", line) for line in last)


class Reranker(Protocol):
    def score(self, query: str, documents: list[str]) -> list[float]: ...


class NeutralReranker:
    def score(self, query: str, documents: list[str]) -> list[float]:
        return [0.0] * len(documents)


class OverlapReranker:
    """Share of the query's words that the document holds, rarer (longer) words weighing more."""

    def score(self, query: str, documents: list[str]) -> list[float]:
        words = {t for w in (content_words(query) or query_tokens(query)) for t in terms_of(w)}
        weight = {w: 1 + math.log(len(w)) for w in words}
        whole = sum(weight.values()) or 1.0
        return [sum(x for w, x in weight.items() if w in set(terms_of(d))) / whole for d in documents]


def batch_size(n: int) -> int:
    return 1 if n <= 5 else 2 if n <= 12 else 4


def budget_ms(n: int) -> int:
    return max(500, 250 * n)


def grace_s(timeout_s: float) -> float:
    """Seconds that a worker gets beyond its budget."""
    return min(10.0, max(1.0, timeout_s / 2))


def head_size(count: int, n: int, most: int = 30, profile_most: int = 12) -> int:
    """How many candidates are reranked for n wanted results."""
    return max(1, min(count, most, profile_most, max(n, 3 * n)))


def truncate(text: str, chars: int = DOC_CHARS) -> str:
    return text[:chars]


def rerank(reranker: Reranker, query: str, documents: list[str | None], size: int | None = None, timeout_ms: int | None = None) -> list[float]:
    """Scores in the order of the documents; NaN becomes 0. Raises ``RerankTimeout`` when time runs out."""
    query = " ".join(query.split()[:QUERY_TOKENS])
    end = time.monotonic() + timeout_ms / 1000 if timeout_ms else None
    size = size or batch_size(len(documents))
    out: list[float] = []
    for i in range(0, len(documents), size):
        if end and time.monotonic() > end:
            raise RerankTimeout(f"{len(out)} of {len(documents)} documents scored")
        try:
            scores = reranker.score(query, [truncate(d or "") for d in documents[i : i + size]])
        except Exception as e:
            raise RerankFailure(f"{type(e).__name__}: {e}") from e
        out += [0.0 if s is None or math.isnan(s) else float(s) for s in scores]
    return out


def score_column(query: str, text: Column, make: Callable[[], Reranker] = OverlapReranker, timeout_ms: int | None = None) -> Column:
    @pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        reranker = make()
        for batch in batches:
            yield pd.Series(rerank(reranker, query, batch.tolist(), timeout_ms=timeout_ms))

    return run(text)


def overlap_col(query: str, text: Column) -> Column:
    """Column form of a plain overlap: how many of the query's content words the text holds."""
    low = F.lower(F.coalesce(text, F.lit("")))
    out = F.lit(0)
    for w in dict.fromkeys(content_words(query)):
        out = out + F.when(low.contains(w), 1).otherwise(0)
    return out
