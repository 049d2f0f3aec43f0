"""Splitting files into addressable chunks.

A file of up to ``MAX_TOKENS`` estimated tokens is one chunk. Longer Python files are cut at functions and classes
(a class is a chunk, and each of its methods again), Go files at their top-level declarations, and others at
line ends into blocks of up to ``BLOCK_CHARS`` characters; text between definitions becomes blocks. A file that
does not parse falls back to blocks.

Defined results: null and blank files have no chunks; bytes that are not UTF-8 become replacement characters; line
ends become ``\\n``; a single longer line is never cut.
"""

from __future__ import annotations

import ast
import re
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark import Accumulator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from siftwell.functions import ids
from siftwell.functions.text import estimate_tokens
from siftwell.schemas import CHUNKS
from siftwell.session import spread

MAX_TOKENS = 1000
BLOCK_CHARS = 4000

Chunk = tuple  # (chunk_id, content, chunk_type, start_line, end_line, name, parent)


def decode(raw: bytes | str | None) -> str:
    """Text as a program in text mode reads it."""
    if raw is None:
        return ""
    text = raw if isinstance(raw, str) else bytes(raw).decode("utf-8", "replace")
    return text.replace("\r\n", "\n").replace("\r", "\n")


def suffix_of(path: str) -> str:
    name = path.replace("\\", "/").rsplit("/", 1)[-1]
    return name.rsplit(".", 1)[1].lower() if "." in name.lstrip(".") else ""


def chunk_file(path: str, text: str) -> list[Chunk]:
    if not text.strip():
        return []
    if estimate_tokens(text) <= MAX_TOKENS:
        return [(ids.file_chunk_id(path), text, "file", 1, len(text.splitlines()), None, None)]
    lines = text.splitlines(keepends=True)
    cut = {"py": _python_spans, "go": _go_spans}.get(suffix_of(path))
    spans = cut(text, lines) if cut else None
    return _blocks(path, lines) if spans is None else _assemble(path, lines, spans)


def _blocks(path: str, lines: list[str]) -> list[Chunk]:
    """Greedy packing of whole lines."""
    out, start, size = [], 0, 0
    for i, line in enumerate(lines):
        if i > start and size + len(line) > BLOCK_CHARS:
            out.append(_block(path, lines, start + 1, i))
            start, size = i, 0
        size += len(line)
    if start < len(lines):
        out.append(_block(path, lines, start + 1, len(lines)))
    return out


def _block(path: str, lines: list[str], first: int, last: int) -> Chunk:
    return ids.block_chunk_id(path, first), "".join(lines[first - 1 : last]), "code_block", first, last, None, None


def _assemble(path: str, lines: list[str], spans: list[tuple]) -> list[Chunk]:
    """Chunks of definitions (kind, name, parent, first, last, resume) in order, and of the text between them;
    text goes on at line ``resume`` after a definition."""
    out, at = [], 1

    def gap(last: int) -> None:
        if at <= last and "".join(lines[at - 1 : last]).strip():
            out.append(_block(path, lines, at, last))

    for kind, name, parent, first, last, resume in spans:
        if kind == "end":  # of a class: what is left of its body
            gap(last)
            at = last + 1
            continue
        gap(first - 1)
        body = "".join(lines[first - 1 : last])
        if kind.endswith("_declaration"):
            key = ids.declaration_chunk_id(path, kind, name, first)
        else:
            key = ids.definition_chunk_id(path, kind, parent, name, first)
        if parent and kind != "class":
            body = f"# Class: {parent}\n{body}"
        out.append((key, body, kind, first, last, name, parent))
        at = resume
    gap(len(lines))
    return out


def _python_spans(text: str, lines: list[str]) -> list[tuple] | None:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return None
    spans: list[tuple] = []

    def visit(node: ast.AST, parent: str | None) -> None:
        found = [n for n in ast.iter_child_nodes(node) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))]
        for n in sorted(found, key=lambda n: n.lineno):
            last = n.end_lineno or n.lineno
            if isinstance(n, ast.ClassDef):
                spans.append(("class", n.name, parent, n.lineno, last, n.lineno + 1))
                visit(n, n.name)
                spans.append(("end", None, None, 0, last, last + 1))
            else:
                spans.append(("method" if parent else "function", n.name, parent, n.lineno, last, last + 1))

    visit(tree, None)
    return spans


_GO_SKIP = re.compile(r'//[^\n]*|/\*[\s\S]*?\*/|"(?:[^"\\\n]|\\.)*"|`[^`]*`|\'(?:[^\'\\\n]|\\.)*\'|[{}()\[\]\n]|\b(?:func|type)\b')
_GO_FUNC = re.compile(r"func\s*(\((?:[^()]|\([^()]*\))*\))?\s*([^\W\d]\w*)")
_GO_TYPE = re.compile(r"type\s+(?:\(\s*)?([^\W\d]\w*)?")


def _go_spans(text: str, lines: list[str]) -> list[tuple] | None:
    """Top-level declarations, found by brackets outside strings and comments; null where they do not pair."""
    depth, line, spans = 0, 1, []
    begun: tuple | None = None
    fresh = True
    for m in _GO_SKIP.finditer(text):
        token = m.group()
        if token == "\n":
            line += 1
            if depth == 0 and begun:
                spans.append((*begun[:3], begun[3], line - 1, line))
                begun = None
            continue
        if token in "{([":
            depth += 1
        elif token in "})]":
            depth -= 1
            if depth < 0:
                return None
        elif token == "func" and depth == 0 and not begun:
            if head := _GO_FUNC.match(text, m.start()):
                begun = ("method_declaration" if head.group(1) else "function_declaration", head.group(2), None, line)
        elif token == "type" and depth == 0 and not begun:
            head = _GO_TYPE.match(text, m.start())
            begun = ("type_declaration", head.group(1) or "anonymous", None, line)
        else:
            line += token.count("\n")
    if depth:
        return None
    if begun:
        spans.append((*begun[:3], begun[3], len(lines), len(lines) + 1))
    return spans


_COLUMNS = [f.name for f in CHUNKS]


def _rows(workspace: str | None, path: str, raw: bytes | str | None, failed: Accumulator | None = None) -> Iterator[tuple]:
    try:
        chunks = chunk_file(path, decode(raw))
    except Exception:  # a file that breaks the chunker has no chunks, but is counted
        if failed is not None:
            failed.add(1)
        return
    language = suffix_of(path)
    for key, body, kind, first, last, name, parent in chunks:
        yield workspace, key, path, body, kind, first, last, language, estimate_tokens(body), name, parent


def chunk_files(files: DataFrame, failed: Accumulator | None = None) -> DataFrame:
    """Chunks of (workspace_id, filepath, content); content is bytes or text. ``failed`` counts the files that break the chunker, once
    for each time that they are read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [r for w, p, c in zip(batch.workspace_id, batch.filepath, batch.content) if p is not None for r in _rows(w, p, c, failed)]
            yield pd.DataFrame(rows, columns=_COLUMNS)

    return spread(files.select("workspace_id", "filepath", "content")).mapInPandas(run, CHUNKS)


def block_spans_col(text_col: str = "text"):
    """Column form of the fallback: array of (start_line, end_line, chars) of greedy line packing, in the JVM.

    Lines end at ``\\n``, as after decoding; a last line without one counts."""
    lines = F.filter(F.split(text_col, r"(?<=\n)"), lambda x: F.length(x) > 0)
    start = F.struct(
        F.array().cast("array<struct<start_line:int,end_line:int,chars:int>>").alias("done"),
        F.lit(1).alias("first"), F.lit(0).alias("last"), F.lit(0).alias("chars"),
    )

    def block(s):
        return F.array(F.struct(s["first"].alias("start_line"), s["last"].alias("end_line"), s["chars"].alias("chars")))

    def step(s, line):
        n = F.length(line)
        full = (s["chars"] > 0) & (s["chars"] + n > BLOCK_CHARS)
        return F.struct(
            F.when(full, F.concat(s["done"], block(s))).otherwise(s["done"]).alias("done"),
            F.when(full, s["last"] + 1).otherwise(s["first"]).alias("first"),
            (s["last"] + 1).alias("last"),
            F.when(full, n).otherwise(s["chars"] + n).alias("chars"),
        )

    return F.aggregate(lines, start, step, lambda s: F.when(s["chars"] > 0, F.concat(s["done"], block(s))).otherwise(s["done"]))


@udtf(returnType="chunk_id: string, content: string, chunk_type: string, start_line: int, end_line: int, name: string, parent: string")
class ChunkFile:
    """SQL table function ``chunk_file(filepath, content)``."""

    def eval(self, filepath: str, content: str):
        if filepath is not None and content is not None:
            yield from chunk_file(filepath, decode(content))


def register(spark) -> None:
    spark.udtf.register("chunk_file", ChunkFile)
