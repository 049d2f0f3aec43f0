"""Session construction, table access and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Settings for a session made here; a session that the caller made is never reconfigured.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str = "local[4]", app: str = "siftwell", **conf: str) -> SparkSession:
    """A session with the defaults above; ``conf`` uses ``__`` for dots."""
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in {**DEFAULT_CONF, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for ``checkpoint()``: what ``spark.checkpoint.dir`` names, else, in a local
    session only, a temporary one. A cluster without the setting is an error, as a machine-local
    folder would be lost with its executor."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(named)
        return named
    present = sc._jsc.sc().getCheckpointDir()
    if present.isDefined():
        return present.get()
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = os.path.join(tempfile.gettempdir(), f"siftwell-{os.getuid()}")
    sc.setCheckpointDir(made)
    return made


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """``df`` hinted for broadcast when it has at most ``max_rows`` rows, counted here; else ``df``
    as it is, so that the join shuffles. Reads at most ``max_rows + 1`` rows to find out."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def spread(df: DataFrame) -> DataFrame:
    """``df`` in at least as many partitions as the session has task slots: a scan of one small or
    unsplittable file is redistributed before work on rows that costs far more than moving them;
    a scan with enough splits stays as it is."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    if "Exchange" in plan or "InMemory" in plan:  # counting its partitions would run it; a shuffle has chosen them
        return df
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * slots) if df.rdd.getNumPartitions() < slots else df
