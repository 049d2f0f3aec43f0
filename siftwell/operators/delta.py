"""Change detection by content hash.

Null hashes on disk mark files that could not be read; they count as unchanged. Keys are (workspace_id,
filepath); repeated rows of a key count once, upper-case hashes equal lower-case ones.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.functions.ids import content_hash_col
from siftwell.operators.whole import assemble

KEY = ["workspace_id", "filepath"]
#: Blank lines at the end of a cut file that are tried against its stored hash.
BLANK_ENDS = 1_000


def hash_files(files: DataFrame) -> DataFrame:
    """(workspace_id, filepath, file_hash) of files with their bytes."""
    return files.select(*KEY, content_hash_col(F.col("content")).alias("file_hash"))


def _current_hash(starts: list[int], ends: list[int], texts: list[str], whole: bool, stored: str | None) -> str:
    if whole:  # of several contents the largest hash, as for hashes
        return max(hashlib.sha256((t or "").encode()).hexdigest() for t in texts)
    text = assemble(starts, ends, texts)
    state = hashlib.sha256(text.encode())
    first = state.hexdigest()
    if stored is None or stored == first:
        return first
    newline = b"\r\n" if text.endswith("\r\n") else b"\n"
    for _ in range(BLANK_ENDS):
        state.update(newline)
        if state.hexdigest() == stored:
            return stored
    return first


def hash_chunked(chunks: DataFrame, stored: DataFrame) -> DataFrame:
    """(workspace_id, filepath, file_hash) of every file of ``chunks``, however it is cut.

    A file in one piece (chunk_type ``file``) is hashed as it is. One that was cut is put together by line number; the
    blank lines at its end are in no chunk, so its hash is the stored one if some number of them gives that. Chunks and
    stored hashes of a file meet in one group."""
    part = F.struct(
        F.col("start_line").cast("int").alias("start_line"),
        F.col("end_line").cast("int").alias("end_line"),
        F.col("content").cast("string").alias("content"),
    )
    kind = F.coalesce(F.col("chunk_type") == "file", F.lit(False))
    rows = chunks.select(*KEY, part.alias("part"), kind.alias("whole"), F.lit(None).cast("string").alias("stored"))
    known = stored.select(*KEY, F.lit(None).cast(rows.schema["part"].dataType).alias("part"), F.lit(None).cast("boolean").alias("whole"), F.lower("file_hash").alias("stored"))
    files = (
        rows.unionByName(known)
        .filter("filepath IS NOT NULL")
        .groupBy(*KEY)
        .agg(F.collect_set("part").alias("parts"), F.bool_and("whole").alias("whole"), F.max("stored").alias("stored"))
        .filter(F.size("parts") > 0)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = batch.column(2)
            ends, fields = parts.offsets.to_pylist(), parts.values
            columns = [fields.field(i).to_pylist() for i in range(3)]
            flags = zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())
            found = [_current_hash(*(c[a:z] for c in columns), *x) for a, z, x in zip(ends, ends[1:], flags)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(found, pa.string())], [*KEY, "file_hash"])

    return files.mapInArrow(run, "workspace_id string, filepath string, file_hash string")


def _one_per_key(hashes: DataFrame, name: str) -> DataFrame:
    return hashes.filter("filepath IS NOT NULL").groupBy(*KEY).agg(F.max(F.lower("file_hash")).alias(name), F.count(F.lit(1)).alias(name + "_n"))


def classify(current: DataFrame, stored: DataFrame) -> DataFrame:
    """(workspace_id, filepath, status, current_hash, stored_hash), status new, modified, unchanged or deleted.

    One full join on the key; both sides are aggregated on it first, so they arrive partitioned alike."""
    a, b = _one_per_key(current, "current_hash"), _one_per_key(stored, "stored_hash")
    both = a.join(b, KEY, "full_outer")
    status = (
        F.when(F.col("current_hash_n").isNull(), "deleted")
        .when(F.col("current_hash").isNull(), "unchanged")
        .when(F.col("stored_hash").isNull(), "new")
        .when(F.col("current_hash") != F.col("stored_hash"), "modified")
        .otherwise("unchanged")
    )
    return both.select(*KEY, status.alias("status"), "current_hash", "stored_hash")


def deleted(current: DataFrame, stored: DataFrame) -> DataFrame:
    """Keys that are stored but no longer there."""
    return stored.select(*KEY).filter("filepath IS NOT NULL").distinct().join(current.select(*KEY).distinct(), KEY, "left_anti")


def to_replace(changes: DataFrame) -> DataFrame:
    """Keys whose chunks go: new, modified and deleted files."""
    return changes.filter(F.col("status") != "unchanged").select(*KEY)


def summary(changes: DataFrame) -> DataFrame:
    count = lambda *s: F.count(F.when(F.col("status").isin(*s), 1))
    return changes.groupBy("workspace_id").agg(
        count("new").alias("new_files"),
        count("modified").alias("modified_files"),
        count("unchanged").alias("unchanged_files"),
        count("deleted").alias("deleted_files"),
        count("new", "modified", "deleted").alias("changed_or_deleted"),
    )
