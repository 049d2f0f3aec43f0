"""Fusing rankings, filtering them and ordering by a reranker's scores."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.window import Window

RRF_K = 60


def rrf(dense: DataFrame, sparse: DataFrame, k: int, id_col: str = "chunk_id", rrf_k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of ``dense`` (id, score as dense_score, rank) and ``sparse`` (id, bm25_score, rank).

    Ties rank by dense score, then dense hits in their order before others. Both sides are top-k lists, so the
    full join is small."""
    d = dense.select(id_col, F.col("score").alias("dense_score"), F.col("rank").alias("dense_rank"))
    s = sparse.select(id_col, "bm25_score", F.col("rank").alias("sparse_rank"))
    both = d.join(s, id_col, "full_outer")
    part = lambda c: F.coalesce(1 / (F.lit(float(rrf_k)) + F.col(c)), F.lit(0.0))
    scored = both.withColumn("hybrid_score", part("dense_rank") + part("sparse_rank")).withColumn("source", provenance())
    order = [
        F.desc(F.round("hybrid_score", 12)), F.desc(F.coalesce("dense_score", F.lit(0.0))),
        F.asc_nulls_last("dense_rank"), F.asc_nulls_last("sparse_rank"), F.col(id_col),
    ]
    return scored.orderBy(*order).limit(max(1, k)).withColumn("fused_rank", F.row_number().over(Window.orderBy(*order)))


def provenance() -> Column:
    d, s = F.col("dense_rank").isNotNull(), F.col("sparse_rank").isNotNull()
    return F.when(d & s, "both").when(d, "dense").when(s, "sparse").otherwise("unknown")


def check_pattern(pattern: str, case_sensitive: bool = False) -> re.Pattern:
    """The compiled pattern; ``ValueError`` with a readable text for a bad one."""
    try:
        return re.compile(pattern, 0 if case_sensitive else re.IGNORECASE)
    except re.error as e:
        raise ValueError(f"invalid regex: {e}") from e


def regex_filter(hits: DataFrame, pattern: str, text_col: str = "content", case_sensitive: bool = False) -> DataFrame:
    """Hits in which the pattern is found, in Python's dialect; meant for a top-k list, after its limit."""
    compiled = check_pattern(pattern, case_sensitive)

    @pandas_udf("boolean")
    def found(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t is not None and compiled.search(t) is not None)

    return hits.filter(found(text_col))


def order_reranked(hits: DataFrame, head: int, score: Column) -> DataFrame:
    """The first ``head`` hits by the reranker's score (NaN and null as 0), then the rest in the fused order.

    Adds ``rerank_score`` (null outside the head) and ``final_rank``."""
    in_head = F.col("fused_rank") <= head
    value = F.coalesce(F.nanvl(score.cast("double"), F.lit(0.0)), F.lit(0.0))
    scored = hits.withColumn("rerank_score", F.when(in_head, value))
    order = Window.orderBy(F.desc(in_head), F.desc("rerank_score"), "fused_rank")
    return scored.withColumn("final_rank", F.row_number().over(order))
