"""Source trees as a Spark data source.

``spark.read.format("source_tree").option("root", ...)`` gives one row per indexable file. Listing runs on the
driver (names only); contents are read by the tasks, a partition per batch of paths. Spark's own file source hides
names that begin with ``_`` or ``.`` and empty files, so it can't serve here. The root must be a folder that all
executors see. A file that can't be read is left out, as binary files are.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from siftwell.functions.ids import workspace_id
from siftwell.operators.paths import SKIP_FOLDERS, check_root
from siftwell.sources.gitignore import IgnoreRules

# Suffixes (and names) of files that are text.
TEXT_SUFFIXES = frozenset(
    (
        ".py .js .ts .jsx .tsx .go .rs .java .c .cpp .h .hpp .html .css .scss .sass .less .vue .svelte .json .yaml .yml .toml .xml .ini "
        ".cfg .conf .md .txt .rst .csv .log .sh .bash .zsh .fish .ps1 .bat .cmd .sql .graphql .gql .dockerfile .makefile .cmake "
        ".gitignore .dockerignore .env .lock"
    ).split()
)
SNIFF_BYTES = 8192
BATCH = 512
SCHEMA = "workspace_id string, filepath string, content binary, size bigint, mtime timestamp"


def is_binary(path: Path) -> bool:
    """Known text suffixes are text; else a NUL in the first bytes, or not being readable, makes a file binary."""
    if path.suffix.lower() in TEXT_SUFFIXES:
        return False
    try:
        with open(path, "rb") as f:
            return b"\0" in f.read(SNIFF_BYTES)
    except OSError:
        return True


def list_files(root: str | os.PathLike) -> Iterator[Path]:
    """Indexable files below the root: no dot-files, none in skipped folders, none ignored by the root's own
    ``.gitignore`` and no binaries. Dot-folders outside the skipped ones are walked."""
    base = Path(root)
    ignore = base / ".gitignore"
    try:
        rules = IgnoreRules(ignore.read_text(encoding="utf-8", errors="replace").splitlines())
    except OSError:
        rules = IgnoreRules([])
    for folder, folders, names in os.walk(base):
        folders[:] = sorted(d for d in folders if d not in SKIP_FOLDERS)
        for name in sorted(names):
            path = Path(folder, name)
            if not name.startswith(".") and not rules.ignores(path.relative_to(base).as_posix()) and not is_binary(path):
                yield path


class _Batch(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(paths)
        self.paths = paths


class _TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = str(check_root(options["root"], options.get("allow_unsafe", "false") == "true"))
        self.workspace = workspace_id(self.root, options.get("workspace_id"))
        self.batch = int(options.get("batch", BATCH))

    def partitions(self) -> list[InputPartition]:
        paths = [p.relative_to(self.root).as_posix() for p in list_files(self.root)]
        return [_Batch(paths[i : i + self.batch]) for i in range(0, len(paths), self.batch)] or [_Batch([])]

    def read(self, partition: _Batch) -> Iterator[tuple]:
        for rel in partition.paths:
            path = os.path.join(self.root, rel)
            try:
                with open(path, "rb") as f:
                    raw = f.read()
                stat = os.stat(path)
            except OSError:
                continue
            yield self.workspace, rel, raw, stat.st_size, datetime.fromtimestamp(stat.st_mtime, timezone.utc)


class _ChangeStream(DataSourceStreamReader):
    """Changes between two listings of a tree, as events; the offset is the time of the listing.

    A listing is kept per offset, so that a batch can be read again. With the option ``state``, a folder that outlives the driver
    (beside the query's checkpoint, say), listings are kept there: after a restart the first batch reports what was created,
    modified and deleted in between. Without it they are kept in memory, and the first batch after a restart reports every
    file as modified, but no deletion."""

    def __init__(self, options: dict):
        self.state = options.get("state")
        self.root = str(check_root(options["root"], options.get("allow_unsafe", "false") == "true"))
        self.workspace = workspace_id(self.root, options.get("workspace_id"))
        self.seen: dict[int, dict[str, tuple]] = {}
        self.n = 0
        if self.state:
            os.makedirs(self.state, exist_ok=True)
            for name in os.listdir(self.state):
                if (number := name.removesuffix(".json")).isdigit():
                    with open(os.path.join(self.state, name)) as f:
                        self.seen[int(number)] = {k: tuple(v) for k, v in json.load(f).items()}
            self.n = max(self.seen, default=0)

    def _keep(self, n: int, listing: dict[str, tuple]) -> None:
        """The listing is on disk before its offset is given out."""
        self.seen[n] = listing
        if self.state:
            name = os.path.join(self.state, f"{n}.json")
            with open(name + ".next", "w") as f:
                json.dump(listing, f)
                f.flush()
                os.fsync(f.fileno())
            os.replace(name + ".next", name)

    def _listing(self) -> dict[str, tuple]:
        out = {}
        for p in list_files(self.root):
            try:
                s = p.stat()
            except OSError:
                continue
            out[p.relative_to(self.root).as_posix()] = (s.st_mtime_ns, s.st_size)
        return out

    def initialOffset(self) -> dict:
        if self.n not in self.seen:
            self._keep(self.n, self._listing())
        return {"n": self.n}

    def latestOffset(self) -> dict:
        now = self._listing()
        if self.seen.get(self.n) != now:
            self.n += 1
            self._keep(self.n, now)
        return {"n": self.n}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        a, z = self.seen.get(start["n"], {}), self.seen.get(end["n"], {})
        now = datetime.now(timezone.utc).timestamp()
        rows = [("created" if p not in a else "modified", p) for p in sorted(z) if a.get(p) != z[p]]
        rows += [("deleted", p) for p in sorted(set(a) - set(z))]
        return [_Batch([(self.workspace, p, kind, now, i) for i, (kind, p) in enumerate(rows)])]

    def read(self, partition: _Batch) -> Iterator[tuple]:
        yield from partition.paths

    def commit(self, end: dict) -> None:
        for n in [n for n in self.seen if n < end["n"]]:
            del self.seen[n]
            if self.state and os.path.exists(name := os.path.join(self.state, f"{n}.json")):
                os.unlink(name)


class SourceTree(DataSource):
    """Format ``source_tree``: option ``root``, and ``workspace_id``, ``batch``, ``allow_unsafe`` if wanted."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _TreeReader(self.options)


class TreeChanges(DataSource):
    """Format ``tree_changes``: a stream of file events of a tree."""

    @classmethod
    def name(cls) -> str:
        return "tree_changes"

    def schema(self) -> str:
        return "workspace_id string, path string, event_type string, event_ts double, seq bigint"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _ChangeStream(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SourceTree)
    spark.dataSource.register(TreeChanges)


def read_tree(spark: SparkSession, root: str, workspace: str | None = None, **options: str) -> DataFrame:
    """(workspace_id, filepath, content, size, mtime) of the tree at ``root``."""
    register(spark)
    reader = spark.read.format("source_tree").option("root", str(root))
    for key, value in ({"workspace_id": workspace} if workspace else {}).items() | options.items():
        reader = reader.option(key, value)
    return reader.load()
