"""Queries of the training-data operators, and the SQL that some of them can be held against."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm import credentials, garbled, leakage, mixing, neighbours, parsing, prose, provenance
from siftwell.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.mutual_pairs(table(spark, d, "chunk_vectors"))


def p1_similar_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs between class representatives of the chunk vectors."""
    return neighbours.similar_pairs(table(spark, d, "chunk_vectors"))[0]


def p1_classes(spark: SparkSession, d: str) -> DataFrame:
    """Class membership of every usable chunk vector."""
    return neighbours.similar_pairs(table(spark, d, "chunk_vectors"))[1]


def p1_embeddings_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of embeddings, each among the other's ten most similar, without a bar."""
    return neighbours.mutual_of(neighbours.nearest_neighbours(table(spark, d, "embeddings")))


def p1_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The ten most similar of every chunk vector."""
    return neighbours.nearest_neighbours(table(spark, d, "chunk_vectors"))


def p1_embeddings_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The ten most similar of every embedding."""
    return neighbours.nearest_neighbours(table(spark, d, "embeddings"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    prose_of = prose.file_prose(table(spark, d, "chunks"), table(spark, d, "documents"))
    return prose_of.select("workspace_id", "filepath", "nl_lang")


def p2_prose(spark: SparkSession, d: str) -> DataFrame:
    return prose.file_prose(table(spark, d, "chunks"), table(spark, d, "documents"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    places = credentials.credential_places(table(spark, d, "chunks"))
    return places.select("workspace_id", "filepath", "line_no").distinct()


def p3_places(spark: SparkSession, d: str) -> DataFrame:
    return credentials.credential_places(table(spark, d, "chunks"))


def p3_redacted(spark: SparkSession, d: str) -> DataFrame:
    return credentials.redacted_files(table(spark, d, "chunks"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    files = provenance.file_origins(table(spark, d, "chunks"), table(spark, d, "upstream_files"))
    return files.filter("origin <> 'written'").select("workspace_id", "filepath")


def p4_origins(spark: SparkSession, d: str) -> DataFrame:
    return provenance.file_origins(table(spark, d, "chunks"), table(spark, d, "upstream_files"))


def p4_written(spark: SparkSession, d: str) -> DataFrame:
    return provenance.hand_written(table(spark, d, "chunks"), table(spark, d, "upstream_files"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return parsing.invalid_files(table(spark, d, "chunks"))


def p5_files(spark: SparkSession, d: str) -> DataFrame:
    return parsing.parse_files(table(spark, d, "chunks"))


def p5_rates(spark: SparkSession, d: str) -> DataFrame:
    return parsing.parse_rates(table(spark, d, "chunks"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leak_report(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    plan = mixing.plan_mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))
    return plan.filter("NOT reachable").select("mix_id", "source")


def p7_sample(spark: SparkSession, d: str) -> DataFrame:
    return mixing.sample_mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_report(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p7_entropy(spark: SparkSession, d: str) -> DataFrame:
    """Shares of the sources at half of the greatest entropy that equal shares of eight sources would have."""
    return mixing.temperature_shares(mixing.source_totals(table(spark, d, "documents")), math.log(8) / 2)


def p7_source_totals(spark: SparkSession, d: str) -> DataFrame:
    return mixing.source_totals(table(spark, d, "documents"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return garbled.garbled_documents(table(spark, d, "documents")).select("doc_id").distinct()


def p8_repaired(spark: SparkSession, d: str) -> DataFrame:
    return garbled.repaired_documents(table(spark, d, "documents"))


def p8_chains(spark: SparkSession, d: str) -> DataFrame:
    """Garbled documents by source and chain."""
    cases = garbled.judged(table(spark, d, "documents")).filter("clean < 0.5")
    return cases.groupBy("source", "chain").agg(F.count(F.lit(1)).alias("documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k[0] == "p" and k[1].isdigit()}


_TOKENS = "greatest(1, n_chars // 4)"
_SOURCE = "nullif(lower(trim(source)), '')"

ORACLE = {
    "p7_source_totals": f"""
        SELECT {_SOURCE} AS source, count(*) AS docs, CAST(sum({_TOKENS}) AS BIGINT) AS tokens
        FROM documents GROUP BY 1""",
    "p7_found": f"""
        WITH s AS (SELECT {_SOURCE} AS source, sum({_TOKENS}) AS tokens FROM documents GROUP BY 1),
             t AS (SELECT sum(tokens) AS all_tokens FROM s),
             m AS (SELECT *, sum(weight) OVER (PARTITION BY mix_id) AS whole FROM mix_targets)
        SELECT m.mix_id, m.source FROM m CROSS JOIN t LEFT JOIN s ON s.source = m.source
        WHERE coalesce(s.tokens, 0) * m.max_repeats < m.weight / m.whole * m.budget_share * t.all_tokens""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
