"""Source files that do not parse (problem 5).

Each file with a suffix of a known language is recognised by an error-correcting chart parser for that
language; its cost is the least number of token edits (insert, delete, replace) that repair it,
and a file with cost 0 is valid. The places of the edits tell truncation, merge conflicts and files of
another language from local damage. Texts without error are recognised at cost 0 by the chart's memoised columns. Behind
the chart, Python's own parser checks py files exactly; the chart alone decides the other languages.

Defined results: an empty file is valid for py, js, ts, java and rs, and invalid for go and json; null bytes
and texts of any length are read whole; files of other suffixes have no row. See ``files`` for nulls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.files import map_files, suffix_of
from siftwell.llm.syntax.grammars import LANGUAGES, accepts, diagnose


def _rows(path: str, text: str) -> list[tuple]:
    language = suffix_of(path)
    cost, damage, lines, least = diagnose(language, text)
    return [(language, cost, least, damage, lines)]


def parse_files(chunks: DataFrame) -> DataFrame:
    """(workspace_id, filepath, language, edit_cost, least, damage, edit_lines) of every file with a known suffix; ``least`` where
    the cost is known to be the minimum, else it is an upper bound."""
    return map_files(chunks, "language string,edit_cost int,least boolean,damage string,edit_lines array<int>", _rows, LANGUAGES)


def invalid_files(chunks: DataFrame) -> DataFrame:
    """(workspace_id, filepath) of the files with a cost, without looking for their repairs."""
    rows_of = lambda path, text: [] if accepts(suffix_of(path), text) else [(suffix_of(path),)]
    return map_files(chunks, "language string", rows_of, LANGUAGES).select("workspace_id", "filepath")


def parse_rates(chunks: DataFrame) -> DataFrame:
    """Files and invalid files per workspace and language, by kind of damage."""
    bad = lambda d: F.count(F.when(F.col("damage") == d, 1)).alias(d)
    return (
        parse_files(chunks)
        .groupBy("workspace_id", "language")
        .agg(
            F.count(F.lit(1)).alias("files"),
            F.count(F.when(F.col("edit_cost") > 0, 1)).alias("invalid"),
            *map(bad, ("truncation", "conflict", "mismatch", "local")),
        )
        .withColumn("invalid_rate", F.col("invalid") / F.col("files"))
    )
