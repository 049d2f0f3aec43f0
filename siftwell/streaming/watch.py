"""File events: cleaning, coalescing, debouncing and applying them.

Batch forms work on tables of events, stream forms on unbounded ones. A workspace may hold any share of all events:
orders within one are computed per time bucket (or folder), and carried over buckets by sums of theirs, so
that no task holds a workspace.

Redelivered events (same id) count once; null paths and workspaces and paths in skipped folders are left out; unknown
event types count as modified. Events exactly one gap apart belong together.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from siftwell.operators.paths import clean_path_col, ignored_event_path

QUIET_S = 2.5
MICRO_BATCH = 10
BUCKET_S = 3600


def clean_events(events: DataFrame) -> DataFrame:
    """(event_id, workspace_id, path, event_type, event_ts, arrived_at): once each, with clean paths."""
    kind = F.when(F.col("event_type").isin("created", "modified", "deleted"), F.col("event_type")).otherwise("modified")
    rows = events.select(
        "event_id", "workspace_id", clean_path_col(F.col("path")).alias("path"), kind.alias("event_type"), "event_ts", "arrived_at"
    ).filter("workspace_id IS NOT NULL AND path <> '' AND event_ts IS NOT NULL AND NOT isnan(event_ts) AND abs(event_ts) < 1e15")
    first = F.min(F.struct("arrived_at", "workspace_id", "path", "event_type", "event_ts"))
    once = rows.filter(~ignored_event_path(F.col("path"))).groupBy("event_id").agg(first.alias("r"))
    return once.select("event_id", "r.workspace_id", "r.path", "r.event_type", "r.event_ts", "r.arrived_at")


def coalesce_events(events: DataFrame, order: list[str], keys: list[str] | None = None) -> DataFrame:
    """(workspace_id, path, event_type): the last event of each path in arrival order (aggregated before the shuffle)."""
    return events.groupBy(*(keys or ["workspace_id"]), "path").agg(F.max_by("event_type", F.struct(*order)).alias("event_type"))


def session_numbers(events: DataFrame, gap_s: float, bucket_s: int = BUCKET_S) -> DataFrame:
    """``events`` with ``session_no``, from 1 in each workspace: a new one begins after more than ``gap_s`` of silence."""
    rows = events.withColumn("__b", F.floor(F.col("event_ts") / bucket_s))
    inside = Window.partitionBy("workspace_id", "__b").orderBy("event_ts", "event_id")
    gap = F.col("event_ts") - F.lag("event_ts").over(inside)
    rows = rows.withColumn("__inner", F.when(gap > gap_s, 1).otherwise(0))  # the first of a bucket: see below
    buckets = rows.groupBy("workspace_id", "__b").agg(
        F.min("event_ts").alias("first"), F.max("event_ts").alias("last"), F.sum("__inner").alias("inner")
    )
    along = Window.partitionBy("workspace_id").orderBy("__b")
    before = F.lag("last").over(along)
    opened = buckets.withColumn("open", F.when(before.isNull() | (F.col("first") - before > gap_s), 1).otherwise(0))
    ahead = F.coalesce(F.sum(F.col("inner") + F.col("open")).over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = opened.select("workspace_id", "__b", (ahead + F.col("open")).alias("__offset"))
    running = F.sum("__inner").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    return rows.join(offsets, ["workspace_id", "__b"]).withColumn("session_no", F.col("__offset") + running).select(*events.columns, "session_no")


def debounce_sessions(events: DataFrame, gap_s: float = QUIET_S) -> DataFrame:
    """(workspace_id, session_no, first_ts, last_ts, events, paths) of each burst of events."""
    numbered = session_numbers(events, gap_s)
    per_path = numbered.groupBy("workspace_id", "session_no", "path").agg(
        F.count(F.lit(1)).alias("n"), F.min("event_ts").alias("a"), F.max("event_ts").alias("z")
    )
    return per_path.groupBy("workspace_id", "session_no").agg(
        F.min("a").alias("first_ts"), F.max("z").alias("last_ts"), F.sum("n").alias("events"), F.count(F.lit(1)).alias("paths")
    )


def micro_batches(events: DataFrame, gap_s: float = QUIET_S, size: int = MICRO_BATCH) -> DataFrame:
    """(workspace_id, session_no, action, path, batch_no): what each burst asks for, deletes first, by folder and path,
    in batches of ``size``. Places in the order are counted per folder and carried over the folders."""
    last = coalesce_events(session_numbers(events, gap_s), ["arrived_at", "event_id"], ["workspace_id", "session_no"])
    rows = last.select(
        "workspace_id", "session_no", "path", F.when(F.col("event_type") == "deleted", "delete").otherwise("touch").alias("action"),
        F.regexp_replace("path", "[^/]*$", "").alias("folder"),
    )
    group = ["workspace_id", "session_no", "action"]
    within = F.row_number().over(Window.partitionBy(*group, "folder").orderBy("path"))
    along = Window.partitionBy(*group).orderBy("folder").rowsBetween(Window.unboundedPreceding, -1)
    folders = rows.groupBy(*group, "folder").agg(F.count(F.lit(1)).alias("n"))
    offsets = folders.select(*group, "folder", F.coalesce(F.sum("n").over(along), F.lit(0)).alias("ahead"))
    placed = rows.withColumn("place", within).join(offsets, [*group, "folder"])
    return placed.select(*group, "path", F.floor((F.col("ahead") + F.col("place") - 1) / size).cast("int").alias("batch_no"))


def stream_sessions(events: DataFrame, gap_s: float = QUIET_S, lateness: str = "10 minutes") -> DataFrame:
    """Stream form of debouncing: session windows per workspace over event time, events later than ``lateness`` dropped.

    ``event_ts`` is seconds since the epoch; times without zone must be cast to timestamps before."""
    timed = events.withColumn("ts", F.timestamp_micros((F.col("event_ts") * 1_000_000).cast("bigint"))).withWatermark("ts", lateness)
    window = F.session_window("ts", f"{int(gap_s * 1000)} milliseconds")
    return timed.groupBy("workspace_id", window.alias("w")).agg(F.count(F.lit(1)).alias("events")).select(
        "workspace_id", F.col("w.start").alias("first_ts"), F.col("w.end").alias("closed_ts"), "events"
    )


def plan_batch(batch: DataFrame, order: Column | list[str]) -> tuple[DataFrame, DataFrame]:
    """(deletes, touches) of one micro-batch of events, each path once."""
    last = coalesce_events(batch, order if isinstance(order, list) else [order])
    paths = last.select("workspace_id", F.col("path").alias("filepath"), "event_type")
    return paths.filter("event_type = 'deleted'").drop("event_type"), paths.filter("event_type <> 'deleted'").drop("event_type")


class Counters:
    """What a watch did so far."""

    def __init__(self):
        self.received = self.coalesced = self.deleted = self.touched = self.runs = 0

    def as_dict(self) -> dict[str, int]:
        return dict(vars(self))


def watch(
    events: DataFrame,
    apply: Callable[[DataFrame, DataFrame], None],
    checkpoint: str,
    trigger: str | None = f"{QUIET_S} seconds",
    order: list[str] | None = None,
    counters: Counters | None = None,
) -> StreamingQuery:
    """Applies a stream of events: every trigger, the deletes and touches of what arrived go to ``apply(deletes, touches)``.

    The trigger's interval is the quiet time; offsets in the checkpoint make the queue durable, so there is no overflow,
    and a batch that fails is run again. With ``trigger`` null, what is there is processed and the query ends."""
    order = order or ["event_ts", "seq"]

    def run(batch: DataFrame, _: int) -> None:
        batch = batch.filter(F.col("path").isNotNull()).withColumn("path", clean_path_col(F.col("path")))
        batch = batch.filter((F.col("path") != "") & ~ignored_event_path(F.col("path"))).persist()
        try:
            n = batch.count()
            if n:
                deletes, touches = plan_batch(batch, order)
                if counters:
                    counters.received += n
                    counters.deleted += deletes.count()
                    counters.touched += touches.count()
                    counters.coalesced = n - counters.deleted - counters.touched
                    counters.runs += 1
                apply(deletes, touches)
        finally:
            batch.unpersist()

    writer = events.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=trigger) if trigger else writer.trigger(availableNow=True)
    return writer.start()
