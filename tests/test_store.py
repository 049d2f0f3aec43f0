import pytest
from pyspark.sql import functions as F

from siftwell.operators import delta, store

KEY = ["workspace_id", "filepath"]
DDL = "workspace_id string, filepath string, file_hash string"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_upsert_and_delete(spark):
    old = spark.createDataFrame([("w", "a", "1"), ("w", "b", "2"), (None, "a", "3")], DDL)
    new = spark.createDataFrame([("w", "a", "9"), ("w", "c", "4"), ("w", "c", "4"), (None, "a", "5")], DDL).withColumn("extra", F.lit(1))
    assert rows(store.upsert(old, new, KEY)) == rows(spark.createDataFrame([("w", "a", "9"), ("w", "b", "2"), ("w", "c", "4"), (None, "a", "5")], DDL))
    ordered = spark.createDataFrame([("w", "a", "7", 1), ("w", "a", "8", 2)], DDL + ", n int")
    assert [r[2] for r in rows(store.upsert(old, ordered, KEY, ["n"])) if r[:2] == ("w", "a")] == ["8"]
    assert rows(store.delete(old, old.limit(0), KEY)) == rows(old)
    assert rows(store.delete_files(old, ["", "a"])) == [("w", "b", "2")] and store.delete_files(old, []).count() == 3


def test_delta_states(spark):
    now = spark.createDataFrame([("w", "new", "1"), ("w", "same", "Ab"), ("w", "mod", "2"), ("w", "unread", None), ("w", "same", "ab")], DDL)
    old = spark.createDataFrame([("w", "same", "aB"), ("w", "mod", "3"), ("w", "gone", "4"), ("w", "unread", "5"), ("w", "gone", "4")], DDL)
    got = delta.classify(now, old)
    assert {r.filepath: r.status for r in got.collect()} == {"new": "new", "same": "unchanged", "mod": "modified", "gone": "deleted", "unread": "unchanged"}
    assert [r.filepath for r in delta.deleted(now, old).collect()] == ["gone"]
    assert delta.to_replace(got).count() == 3
    assert delta.summary(got).first().changed_or_deleted == 3
    assert delta.classify(now.limit(0), old.limit(0)).count() == 0


def test_snapshots(spark, tmp_path):
    s = store.SnapshotStore(spark, tmp_path / "s")
    assert s.version() == 0 and s.table("file_hashes").count() == 0
    s.commit(file_hashes=spark.createDataFrame([("w", "a", "1"), ("v", "a", "2")], DDL))
    before = s.table("file_hashes")
    s.commit(file_hashes=store.upsert(before, spark.createDataFrame([("w", "a", "9")], DDL), KEY))
    assert rows(before) == [("v", "a", "2"), ("w", "a", "1")]  # the old snapshot stays readable
    assert rows(s.table("file_hashes")) == [("v", "a", "2"), ("w", "a", "9")]
    again = store.SnapshotStore(spark, tmp_path / "s")
    assert again.version() == 2
    s.clear_workspace("w")
    assert rows(s.table("file_hashes")) == [("v", "a", "2")]
    assert s.prune(1) == [1, 2] and s.size_bytes() > 0
    s.reset()
    assert s.table("file_hashes").count() == 0
    (tmp_path / "s" / "LOCK").touch()
    with pytest.raises(RuntimeError):
        s.reset()


def test_retries():
    seen = []

    def fails_twice():
        seen.append(1)
        if len(seen) < 3:
            raise OSError("busy")

    store.with_retries(fails_twice, 3, 0.01)
    assert len(seen) == 3
    with pytest.raises(RuntimeError):
        store.with_retries(lambda: (_ for _ in ()).throw(OSError("no")), 1, 0.01)


def test_status_counts_once(spark):
    df = spark.createDataFrame([("w", "1", "a", 5), ("w", "1", "a", 5), ("w", "2", "a", 6), ("v", "3", "b", 1)], "workspace_id string, chunk_id string, filepath string, token_count int")
    assert {r.workspace_id: (r.chunks, r.files, r.tokens) for r in store.workspace_status(df).collect()} == {"w": (2, 1, 11), "v": (1, 1, 1)}
