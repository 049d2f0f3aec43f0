import json
import time

import pytest
from pyspark.sql import functions as F

from siftwell.sources.tree import register
from siftwell.streaming import watch

DDL = "event_id bigint, workspace_id string, path string, event_type string, event_ts double, arrived_at timestamp"


def events(spark, rows):
    full = [(i, w, p, t, ts, None) for i, (w, p, t, ts) in enumerate(rows, 1)]
    return spark.createDataFrame(full, DDL).withColumn("arrived_at", F.timestamp_seconds(F.col("event_id")))


def test_cleaning(spark):
    rows = [("w", "./a\\b.py", "modified", 1.0), ("w", None, "modified", 1.0), (None, "x", "modified", 1.0), ("w", "node_modules/x", "deleted", 1.0), ("w", "c", "moved", 2.0)]
    df = events(spark, rows)
    got = {(r.path, r.event_type) for r in watch.clean_events(df.unionByName(df)).collect()}
    assert got == {("a/b.py", "modified"), ("c", "modified")}
    assert watch.clean_events(df.limit(0)).count() == 0


def test_coalesce_and_batches(spark):
    df = events(spark, [("w", "a", "modified", 1.0), ("w", "a", "modified", 1.1), ("w", "a", "created", 1.2), ("w", "b", "deleted", 1.3), ("w", "c", "created", 1.4)])
    got = {r.path: r.event_type for r in watch.coalesce_events(df, ["arrived_at", "event_id"]).collect()}
    assert got == {"a": "created", "b": "deleted", "c": "created"}
    plan = {(r.action, r.path, r.batch_no) for r in watch.micro_batches(df, 2.5).collect()}
    assert plan == {("delete", "b", 0), ("touch", "a", 0), ("touch", "c", 0)}


def test_storm_is_cut_into_batches(spark):
    df = events(spark, [("w", f"d{i % 7}/f{i:04}.py", "modified", 1.0 + i / 1000) for i in range(1000)])
    counts = [r["count"] for r in watch.micro_batches(df).groupBy("batch_no").count().collect()]
    assert len(counts) == 100 and set(counts) == {10}


def test_sessions_over_buckets(spark):
    times = [0.0, 2.5, 5.1, 3599.0, 3601.0, 3603.4, 7300.0, 7300.0]
    df = events(spark, [("w", f"p{i}", "modified", t) for i, t in enumerate(times)] + [("v", "p", "modified", 5.0)])
    got = sorted((r.workspace_id, r.session_no, r.first_ts, r.last_ts, r.events) for r in watch.debounce_sessions(df, 2.5).collect())
    assert got == [("v", 1, 5.0, 5.0, 1), ("w", 1, 0.0, 2.5, 2), ("w", 2, 5.1, 5.1, 1), ("w", 3, 3599.0, 3603.4, 3), ("w", 4, 7300.0, 7300.0, 2)]


def test_stream_applies_batches(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    rows = [{"workspace_id": "w", "path": p, "event_type": t, "event_ts": i * 1.0, "seq": i} for i, (p, t) in enumerate([("./a", "modified"), ("b", "created"), ("b", "deleted"), (".git/x", "modified"), (None, "modified")])]
    (source / "1.json").write_text("\n".join(map(json.dumps, rows)))
    stream = spark.readStream.schema("workspace_id string, path string, event_type string, event_ts double, seq bigint").json(str(source))
    seen, counters = [], watch.Counters()
    apply = lambda d, t: seen.append(([r.filepath for r in d.collect()], [r.filepath for r in t.collect()]))
    for _ in range(2):  # the second start finds nothing new
        watch.watch(stream, apply, str(tmp_path / "ck"), trigger=None, counters=counters).awaitTermination(120)
    assert seen == [(["b"], ["a"])] and counters.as_dict() == {"received": 3, "coalesced": 1, "deleted": 1, "touched": 1, "runs": 1}


def test_stream_sessions(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    rows = [{"workspace_id": "w", "path": "a", "event_type": "modified", "event_ts": t} for t in (1.0, 2.0, 30.0, 5000.0)]
    (source / "1.json").write_text("\n".join(map(json.dumps, rows)))
    stream = spark.readStream.schema("workspace_id string, path string, event_type string, event_ts double").json(str(source))
    query = watch.stream_sessions(stream, 2.5, "1 second").writeStream.format("memory").queryName("sessions").outputMode("append")
    q = query.option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [r.events for r in spark.table("sessions").orderBy("first_ts").collect()] == [2, 1]


def test_tree_changes(spark, tmp_path):
    root = tmp_path / "t"
    root.mkdir()
    (root / "a.py").write_text("1")
    register(spark)
    seen = []
    stream = spark.readStream.format("tree_changes").option("root", str(root)).load()
    apply = lambda d, t: seen.append(({r.filepath for r in d.collect()}, {r.filepath for r in t.collect()}))
    q = watch.watch(stream, apply, str(tmp_path / "ck"), trigger="0 seconds")
    try:
        time.sleep(6)
        (root / "a.py").unlink()
        (root / "b.py").write_text("2")
        end = time.time() + 60
        while time.time() < end and not any("b.py" in t for _, t in seen):
            time.sleep(0.5)
    finally:
        q.stop()
    assert {"a.py"} in [d for d, _ in seen] and any("b.py" in t for _, t in seen)


def test_listings_outlive_the_stream(tmp_path):
    from siftwell.sources.tree import _ChangeStream

    root, state = tmp_path / "tree", tmp_path / "state"
    root.mkdir()
    (root / "a.py").write_text("a = 1\n")
    (root / "b.py").write_text("b = 1\n")
    first = _ChangeStream({"root": str(root), "state": str(state), "allow_unsafe": "true"})
    start = first.initialOffset()
    (root / "a.py").unlink()
    (root / "c.py").write_text("c = 1\n")
    again = _ChangeStream({"root": str(root), "state": str(state), "allow_unsafe": "true"})
    end = again.latestOffset()
    events = {(r[1], r[2]) for part in again.partitions(start, end) for r in again.read(part)}
    assert events == {("a.py", "deleted"), ("c.py", "created")} and again.latestOffset() == end
    again.commit(end)
    assert sorted(p.name for p in state.iterdir()) == [f"{end['n']}.json"]


def test_lock_of_a_crash_expires(spark, tmp_path, monkeypatch):
    from siftwell.operators import store

    s = store.SnapshotStore(spark, str(tmp_path / "s"))
    s.commit()
    lock = tmp_path / "s" / "LOCK"
    lock.write_text("")
    with pytest.raises(RuntimeError):
        s.commit()
    monkeypatch.setattr(store, "LOCK_EXPIRES_S", -1)
    s.commit()
    assert not lock.exists()
