"""Files put together from their chunks.

A file is (workspace_id, filepath). Its distinct chunks are laid out by line number; where chunks
overlap, the one that starts first (the longest of several) gives the line. A method chunk's extra
first line ``# Class: ...`` is not a line of the file, and lines that no chunk holds are blank.

Defined results: null content counts as an empty chunk; rows with a null filepath belong to no
file; null line numbers count as line 1; workspace_id may be null. Repeated rows count once. A
chunk whose text and line numbers disagree keeps its text. Further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_HEADER = "# Class: "
#: Line ends as the chunker counts them.
_LINE_ENDS = re.compile(r"\r\n|[\n\r\v\f\x1c-\x1e\x85  ]")
_RARE_ENDS = re.compile(r"\r(?!\n)|[\v\f\x1c-\x1e\x85  ]")


def count_lines(text: str) -> int:
    """Number of lines as ``str.splitlines`` counts them."""
    if _RARE_ENDS.search(text):
        return len(text.splitlines())
    return text.count("\n") + (not text.endswith("\n") and text != "")


def suffix_of(path: str) -> str:
    """What follows the last dot of the path, in lower case; empty without one in the file's name."""
    name = path.replace("\\", "/").rsplit("/", 1)[-1]
    return name.rsplit(".", 1)[1].lower() if "." in name else ""


def assemble(starts: list[int], ends: list[int], texts: list[str]) -> str:
    """The text of a file from its chunks, in any order and with repeats."""
    if len(texts) == 1 and (starts[0] or 1) <= 1 and not (texts[0] or "").startswith(_HEADER):
        return texts[0] or ""
    rows = sorted(((s or 1), -(e or 1), t or "") for s, e, t in zip(starts, ends, texts))
    out: list[str] = []
    at, newline = 1, "\n"
    for start, end, text in rows:
        end = -end
        if end < at:
            continue
        if text.startswith(_HEADER) and count_lines(text) == end - start + 2:
            text = text.split("\n", 1)[1]
        if start > at:
            if out and not out[-1].endswith(("\n", "\r")):
                out.append(newline)
            out.append(newline * (start - at))
        elif start < at:
            text = "".join(text.splitlines(keepends=True)[at - start :])
        elif out and text and not out[-1].endswith(("\n", "\r")):
            out.append(newline)
        if text.endswith("\r\n"):
            newline = "\r\n"
        out.append(text)
        at = max(at, end + 1)
    return "".join(out)


def file_chunks(chunks: DataFrame) -> DataFrame:
    """(workspace_id, filepath, parts): the distinct chunks of each file; one file is one group, and
    repeats of its chunks are dropped before the shuffle."""
    part = F.struct(
        F.col("start_line").cast("int").alias("start_line"),
        F.col("end_line").cast("int").alias("end_line"),
        F.col("content").cast("string").alias("content"),
    )
    return (
        chunks.filter("filepath IS NOT NULL")
        .groupBy("workspace_id", "filepath")
        .agg(F.collect_set(part).alias("parts"))
    )


def map_files(
    chunks: DataFrame,
    schema: str,
    rows_of: Callable[[str, str], list[tuple]],
    suffixes: tuple[str, ...] | None = None,
    setup: Callable[[], None] | None = None,
) -> DataFrame:
    """Rows (workspace_id, filepath, *row) for each row that ``rows_of(filepath, text)`` gives.

    ``schema`` names the columns of these rows. With ``suffixes``, files of others are dropped at the scan."""
    if suffixes is not None:
        suffix = F.lower(F.regexp_extract("filepath", r"\.([^./\\]*)$", 1))
        chunks = chunks.filter(suffix.isin(*suffixes))
    names = [c.split()[0] for c in schema.split(",")]
    whole = f"workspace_id string, filepath string, {schema}"
    types = [pa.string(), pa.string(), *(_ARROW[c.split()[1]] for c in schema.split(","))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if setup:
            setup()
        for batch in batches:
            spaces, paths = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            parts = batch.column(2)
            ends, fields = parts.offsets.to_pylist(), parts.values
            starts_, ends_, texts_ = (fields.field(i).to_pylist() for i in range(3))
            out: list[list] = [[] for _ in types]
            for i, (space, path) in enumerate(zip(spaces, paths)):
                a, z = ends[i], ends[i + 1]
                for row in rows_of(path, assemble(starts_[a:z], ends_[a:z], texts_[a:z])):
                    for column, value in zip(out, (space, path, *row)):
                        column.append(value)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(out, types)], ["workspace_id", "filepath", *names])

    return file_chunks(chunks).mapInArrow(run, whole)


_ARROW = {
    "string": pa.string(),
    "bigint": pa.int64(),
    "int": pa.int32(),
    "double": pa.float64(),
    "boolean": pa.bool_(),
    "array<int>": pa.list_(pa.int32()),
    "array<string>": pa.list_(pa.string()),
}


def file_texts(chunks: DataFrame) -> DataFrame:
    """(workspace_id, filepath, text)."""
    return map_files(chunks, "text string", lambda path, text: [(text,)])
