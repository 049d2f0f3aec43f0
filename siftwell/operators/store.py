"""Snapshots of a workspace's tables.

A snapshot is an immutable folder ``v=N`` with one Parquet table each for chunks, vectors, postings and hashes. A
commit writes the next folder and then moves the pointer file in one step, so that all tables change together
and readers of the old snapshot are not disturbed. Merges are anti-joins on the key plus a union; a table
is laid out by workspace.
"""

from __future__ import annotations

import os
import random
import time
from collections.abc import Callable
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwell import schemas
from siftwell.session import broadcast_if_small

TABLES = {"chunks": schemas.CHUNKS, "vectors": schemas.VECTORS, "postings": schemas.POSTINGS, "file_hashes": schemas.FILE_HASHES}
MAX_BROADCAST_KEYS = 100_000
RETRIES = 3
BASE_DELAY = 0.25


def upsert(old: DataFrame, new: DataFrame, key: list[str], order: list[str] | None = None) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with the same key; of several new rows with one key the
    last by ``order`` stays (else an arbitrary one of equal rows). Null keys match each other."""
    columns = old.columns
    if order:
        last = F.max_by(F.struct(*columns), F.struct(*order))
        new = new.groupBy(*key).agg(last.alias("r")).select("r.*")
    else:
        new = new.dropDuplicates(key)
    return delete(old, new, key).unionByName(new.select(*columns))


def delete(old: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    """``old`` without the rows whose key occurs in ``keys``."""
    gone = keys.select(*(F.col(k).alias(f"__{k}") for k in key)).distinct()
    same = F.lit(True)
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return old.join(broadcast_if_small(gone, MAX_BROADCAST_KEYS), same, "left_anti")


def delete_files(old: DataFrame, paths: list[str]) -> DataFrame:
    """``old`` without the rows of the named files; blank names are left out."""
    wanted = [p for p in paths if p]
    return old.filter(~F.col("filepath").isin(*wanted)) if wanted else old


def with_retries(work: Callable[[], None], retries: int = RETRIES, delay: float = BASE_DELAY) -> None:
    """Runs ``work``, again after growing pauses when the file system or a job fails."""
    for n in range(retries + 1):
        try:
            return work()
        except (OSError, Py4JJavaError) as e:
            if n == retries:
                raise RuntimeError(f"failed {retries + 1} times") from e
            time.sleep(max(0.05, delay) * 2**n * (1 + random.random() / 10))


#: Seconds after which a lock that no writer has touched counts as left behind; a table must be written within them.
LOCK_EXPIRES_S = 6 * 3600


class SnapshotStore:
    """Versioned tables below a folder that the driver and all executors see."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, str(path)
        os.makedirs(self.path, exist_ok=True)

    @property
    def _pointer(self) -> str:
        return os.path.join(self.path, "CURRENT")

    def version(self) -> int:
        try:
            with open(self._pointer) as f:
                return int(f.read())
        except FileNotFoundError:
            return 0

    def table(self, name: str, version: int | None = None) -> DataFrame:
        """A table of the current (or a given) snapshot; empty before the first commit."""
        at = os.path.join(self.path, f"v={self.version() if version is None else version}", name)
        if os.path.isdir(at):
            return self.spark.read.schema(TABLES[name]).parquet(at)
        return self.spark.createDataFrame([], TABLES[name])

    @contextmanager
    def _lock(self):
        """One writer at a time. A lock whose writer has not touched it for ``LOCK_EXPIRES_S`` is one of a crash and is removed."""
        lock = os.path.join(self.path, "LOCK")
        try:
            if time.time() - os.stat(lock).st_mtime > LOCK_EXPIRES_S:
                os.unlink(lock)
        except FileNotFoundError:
            pass
        try:
            handle = os.open(lock, os.O_CREAT | os.O_EXCL | os.O_WRONLY)
        except FileExistsError as e:
            raise RuntimeError(f"another commit holds {lock}") from e
        try:
            yield
        finally:
            os.close(handle)
            os.unlink(lock)

    def commit(self, **tables: DataFrame) -> int:
        """Writes the next snapshot: the given tables, and the others as they are."""
        with self._lock():
            n = self.version() + 1
            folder = os.path.join(self.path, f"v={n}")
            for name, schema in TABLES.items():
                df = tables[name] if name in tables else self.table(name)
                df = df.select(*(F.col(f.name).cast(f.dataType) for f in schema))
                os.utime(os.path.join(self.path, "LOCK"))
                with_retries(lambda df=df, name=name: df.write.mode("overwrite").parquet(os.path.join(folder, name)))
            temporary = self._pointer + ".next"
            with open(temporary, "w") as f:
                f.write(str(n))
                f.flush()
                os.fsync(f.fileno())
            os.replace(temporary, self._pointer)
            return n

    def reset(self) -> int:
        """Commits empty tables."""
        return self.commit(**{n: self.spark.createDataFrame([], s) for n, s in TABLES.items()})

    def clear_workspace(self, workspace: str) -> int:
        return self.commit(**{n: self.table(n).filter(~F.col("workspace_id").eqNullSafe(workspace)) for n in TABLES})

    def prune(self, keep: int = 2) -> list[int]:
        """Removes snapshots older than the last ``keep``."""
        import shutil

        now = self.version()
        old = [int(d[2:]) for d in os.listdir(self.path) if d.startswith("v=") and int(d[2:]) <= now - keep]
        for n in old:
            shutil.rmtree(os.path.join(self.path, f"v={n}"))
        return sorted(old)

    def status(self) -> DataFrame:
        """(workspace_id, chunks, files, tokens)."""
        return workspace_status(self.table("chunks"))

    def ids_of_file(self, workspace: str, path: str) -> DataFrame:
        return self.table("chunks").filter((F.col("workspace_id") == workspace) & (F.col("filepath") == path)).select("chunk_id")

    def size_bytes(self) -> int:
        return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(self.path) for f in fs)


def workspace_status(chunks: DataFrame) -> DataFrame:
    """Chunks, files and tokens per workspace; repeated chunk rows count once."""
    once = chunks.select("workspace_id", "chunk_id", "filepath", "token_count").distinct()
    per_file = once.groupBy("workspace_id", "filepath").agg(F.count(F.lit(1)).alias("n"), F.sum("token_count").alias("t"))
    return per_file.groupBy("workspace_id").agg(
        F.sum("n").alias("chunks"), F.count("filepath").alias("files"), F.sum("t").alias("tokens")
    )


def cast_to(df: DataFrame, schema: T.StructType) -> DataFrame:
    return df.select(*(F.col(f.name).cast(f.dataType) for f in schema))
