"""Retrieval quality and throughput.

``ranked`` has (query_id, doc_id, rank) with ranks from 1, ``qrels`` (query_id, doc_id, rel) with grades above 0 for
relevant documents. Queries are those of ``qrels``; one without ranked results has 0 everywhere. Repeated rows of
a pair count once, with the best rank or grade.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def evaluate(ranked: DataFrame, qrels: DataFrame, mrr_k: int = 5, recall_k: int = 12, ndcg_k: int = 12) -> DataFrame:
    """(query_id, mrr, recall, ndcg). Recall and gain are over the first max(1, k) results; gain is 2**rel - 1."""
    rel = qrels.filter("rel > 0").groupBy("query_id", "doc_id").agg(F.max("rel").cast("double").alias("rel"))
    best = ranked.groupBy("query_id", "doc_id").agg(F.min("rank").alias("rank"))
    hits = rel.join(best, ["query_id", "doc_id"], "left")
    ideal = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rel"), "doc_id"))
    gain = F.pow(F.lit(2.0), F.col("rel")) - 1
    at = lambda r: gain / F.log2(r + 1.0)
    rows = hits.withColumn("ideal", ideal)
    out = rows.groupBy("query_id").agg(
        F.coalesce(1 / F.min(F.when(F.col("rank") <= max(1, mrr_k), F.col("rank"))), F.lit(0.0)).alias("mrr"),
        (F.count(F.when(F.col("rank") <= max(1, recall_k), 1)) / F.count(F.lit(1))).alias("recall"),
        F.coalesce(F.sum(F.when(F.col("rank") <= max(1, ndcg_k), at(F.col("rank")))), F.lit(0.0)).alias("dcg"),
        F.coalesce(F.sum(F.when(F.col("ideal") <= max(1, ndcg_k), at(F.col("ideal")))), F.lit(0.0)).alias("idcg"),
    )
    return out.select("query_id", "mrr", "recall", F.when(F.col("idcg") > 1e-12, F.col("dcg") / F.col("idcg")).otherwise(0.0).alias("ndcg"))


def macro_average(per_query: DataFrame) -> DataFrame:
    return per_query.agg(F.count(F.lit(1)).alias("queries"), *(F.avg(c).alias(c) for c in ("mrr", "recall", "ndcg")))


def run_summary(runs: DataFrame) -> DataFrame:
    """(name, runs, avg_s, best_s, worst_s, items_per_s) of timed runs (name, seconds, items)."""
    return runs.groupBy("name").agg(
        F.count(F.lit(1)).alias("runs"), F.avg("seconds").alias("avg_s"), F.min("seconds").alias("best_s"), F.max("seconds").alias("worst_s"),
        (F.sum("items") / F.nullif(F.sum("seconds"), F.lit(0.0))).alias("items_per_s"),
    )


def leaderboard(results: DataFrame, by: list[str]) -> DataFrame:
    """Results with their place, best first by the columns in order."""
    order = Window.orderBy(*(F.desc_nulls_last(c) for c in by), "name")
    return results.withColumn("place", F.row_number().over(order))
