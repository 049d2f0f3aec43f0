"""Throughput of embedding, reranking and search, and retrieval quality, over a folder of test tables."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions.text import estimate_tokens_col, snippets_col
from siftwell.operators import embed, metrics, rerank
from siftwell.plans import catalog
from siftwell.session import table


def corpus_sample(docs: DataFrame, samples: int, max_chars: int = 1800, text_col: str = "text") -> DataFrame:
    """(snippet): the first ``samples`` distinct slices of the texts; a sample is the feature here."""
    parts = docs.select(F.explode(snippets_col(F.col(text_col), max_chars)).alias("snippet")).distinct()
    return parts.orderBy(F.xxhash64("snippet"), "snippet").limit(samples)


def timed(name: str, items: int, work: Callable[[], object], repeats: int) -> list[tuple[str, float, int]]:
    """Seconds of each repeat, after one run that does not count."""
    work()
    out = []
    for _ in range(repeats):
        start = time.perf_counter()
        work()
        out.append((name, time.perf_counter() - start, items))
    return out


def run_all(spark: SparkSession, sf_dir: str, samples: int = 128, repeats: int = 3) -> list[dict]:
    """Rows of ``metrics.run_summary``, and of the macro-averaged retrieval metrics."""
    sample = corpus_sample(table(spark, sf_dir, "documents"), samples).persist()
    n, tokens = sample.agg(F.count(F.lit(1)), F.sum(estimate_tokens_col(F.col("snippet")))).first()
    write = lambda df: df.write.format("noop").mode("overwrite").save()
    runs = timed("texts", n, lambda: write(sample.select(embed.embed_column(F.col("snippet")))), repeats)
    runs += [("tokens", s, tokens) for _, s, _ in runs]
    runs += timed("rerank-docs", n, lambda: write(sample.select(rerank.score_column(catalog.WORDS, F.col("snippet")))), repeats)
    runs += timed("searches", 1, lambda: write(catalog.QUERIES["hybrid_search"](spark, sf_dir)), repeats)
    summary = metrics.run_summary(spark.createDataFrame(runs, "name string, seconds double, items bigint"))
    out = [r.asDict() for r in summary.orderBy("name").collect()]
    out += [r.asDict() for r in catalog.QUERIES["metrics_macro"](spark, sf_dir).collect()]
    sample.unpersist()
    return out
