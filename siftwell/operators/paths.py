"""Path and metadata predicates."""

from __future__ import annotations

import os
from pathlib import Path, PurePosixPath

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Folder names at which a project-relative path may begin.
ANCHORS = ("src", "internal", "pkg", "cmd", "app", "apps", "config", "configs", "lib", "services", "service")
# Folders that are never indexed.
SKIP_FOLDERS = (
    ".git .venv venv env __pycache__ node_modules .hg .svn chroma_data chroma_test .mypy_cache .pytest_cache dist build .next .nuxt "
    "target .idea .vscode .siftwell"
).split()
# Folders that are too wide to be a workspace.
UNSAFE_ROOTS = "/ /System /Library /Applications /Users /Volumes /private /usr /opt /bin /sbin /etc /var /tmp".split()


def clean_path_col(path: Column) -> Column:
    """Forward slashes, no leading ``./`` and no slashes around."""
    p = F.regexp_replace(path, r"\\", "/")
    return F.regexp_replace(F.regexp_replace(p, r"^(?:\./)+", ""), r"^/+|/+$", "")


def normalise_path(path: str | None, root: str | None = None) -> str | None:
    """A path as the user gives it, relative to the root; null for blank, empty for the root itself."""
    raw = (path or "").strip()
    if not raw:
        return None
    out = raw.replace("\\", "/")
    if root:
        base = Path(root).expanduser().resolve()
        p = Path(raw).expanduser()
        if p.is_absolute():
            try:
                rel = p.resolve().relative_to(base).as_posix()
                return "" if rel == "." else rel
            except ValueError:
                return out.lstrip("./")
    while out.startswith("./"):
        out = out[2:]
    return out.strip("/")


def path_variants(path: str) -> list[str]:
    """The path, its tails that begin at an anchor folder, and its name."""
    parts = [p for p in path.replace("\\", "/").split("/") if p]
    tails = ["/".join(parts), *("/".join(parts[i:]) for i, p in enumerate(parts) if p in ANCHORS), *parts[-1:]]
    return list(dict.fromkeys(t for t in tails if t))


def resolve_paths(paths: DataFrame, wanted: str, column: str = "filepath") -> DataFrame:
    """(filepath): the indexed paths that ``wanted`` means: equal to or ending in a variant, else below a folder
    variant, else, for a bare name, files of that name. Only the best of these tiers counts.

    The variants are few, so each becomes a predicate on the distinct paths; no join is needed. A path that ends
    in an indexed path as a whole counts only when the match begins at an anchor folder or the start."""
    variants = path_variants(wanted)
    full = [v for v in variants if "/" in v]
    p = F.col("filepath")
    distinct = paths.select(clean_path_col(F.col(column)).alias("filepath")).filter("filepath <> ''").distinct()
    exact, below, named = F.lit(False), F.lit(False), F.lit(False)
    for v in full:
        exact = exact | (p == v) | p.endswith("/" + v)
        if not PurePosixPath(v).suffix:
            below = below | p.startswith(v + "/")
    if not full:
        for v in variants:
            named = named | (p == v) | p.endswith("/" + v)
            below = below | (p.startswith(v + "/") if not PurePosixPath(v).suffix else F.lit(False))
    tier = F.when(exact, 1).when(below & F.lit(bool(full)), 2).when(named, 3)
    ranked = distinct.withColumn("tier", tier).filter("tier IS NOT NULL")
    best = ranked.agg(F.min("tier").alias("best"))
    return ranked.join(F.broadcast(best), F.col("tier") == F.col("best")).select("filepath")  # best is one row


def lexical_path_predicate(path: str | None, column: str = "filepath") -> Column:
    """Rows of a file (by name or path) or, without suffix, of a folder anywhere; true for no path."""
    clean = (path or "").replace("\\", "/").strip("/")
    p = F.col(column)
    if not clean:
        return F.lit(True)
    if "/" in clean and not PurePosixPath(clean).suffix:
        return p.startswith(clean + "/") | p.contains("/" + clean + "/")
    return (p == clean) | p.endswith("/" + clean)


def metadata_predicate(paths: list[str] | None = None, language: str | None = None) -> Column | None:
    """Conjunction of the filters given; null when there is none."""
    out = None
    if paths:
        out = F.col("filepath") == paths[0] if len(paths) == 1 else F.col("filepath").isin(*paths)
    if language:
        same = F.col("language") == language
        out = same if out is None else out & same
    return out


def ignored_event_path(path: Column) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, SKIP_FOLDERS)))


def safe_relative_col(path: Column) -> Column:
    """Whether a path stays inside its root: not blank, not absolute, no step upwards."""
    clean = F.regexp_replace(path, r"\\", "/")
    return clean.isNotNull() & (F.trim(clean) != "") & ~clean.startswith("/") & ~F.array_contains(F.split(clean, "/"), "..")


def inside(root: str | os.PathLike, path: str | os.PathLike) -> Path:
    """The resolved path, which must be the root or lie below it (compared by components)."""
    base = Path(root).expanduser().resolve()
    target = (base / path).resolve()
    if target != base and base not in target.parents:
        raise PermissionError(f"{path} is outside of {base}")
    return target


def check_root(root: str | os.PathLike, allow_unsafe: bool = False) -> Path:
    """A folder fit to be a workspace: it exists and is none of the system's own folders."""
    base = Path(root).expanduser().resolve()
    if not base.is_dir():
        raise NotADirectoryError(str(root))
    if str(base) in UNSAFE_ROOTS and not allow_unsafe:
        raise PermissionError(f"{base} is too wide for a workspace")
    return base
