"""Command line: ``python -m siftwell.cli ...``."""

from __future__ import annotations

import argparse
import os
import shutil
import sys

from siftwell import __version__
from siftwell.config import MODELS, PROFILES, load_settings, resolve_model, save_settings
from siftwell.functions.text import format_bytes
from siftwell.workspace import resolve_root


def _engine(args: argparse.Namespace):
    from siftwell.plans.search import SearchEngine
    from siftwell.session import get_spark

    root = resolve_root(args.directory)
    store = args.store or os.path.join(str(root), ".siftwell")
    return SearchEngine(get_spark(args.master), store, str(root), args.workspace_id)


def _db(args: argparse.Namespace) -> int:
    engine = _engine(args)
    if args.action == "status":
        for r in engine.store.status().orderBy("workspace_id").collect():
            print(f"{r.workspace_id}: {r.chunks} chunks, {r.files} files, {r.tokens} tokens")
        print(f"size: {format_bytes(engine.store.size_bytes())}, snapshot {engine.store.version()}")
    elif args.action == "clear":
        engine.store.clear_workspace(engine.workspace)
    else:
        shutil.rmtree(engine.store.path)
    return 0


def _models(kind: str, args: argparse.Namespace) -> int:
    settings = load_settings()
    field = "embedder" if kind == "embedder" else "reranker"
    if args.action == "ls":
        for m in MODELS.values():
            if m.kind == kind:
                print(("* " if getattr(settings, field) == m.key else "  ") + f"{m.key}: {m.note}")
    elif args.action == "current":
        print(getattr(settings, field))
    elif args.action == "set":
        setattr(settings, field, resolve_model(args.name, kind).key)
        save_settings(settings)
    elif args.action in ("pull", "rm"):
        resolve_model(args.name, kind)
        print("built in, nothing to " + ("fetch" if args.action == "pull" else "remove"))
    return 0


def _profile(args: argparse.Namespace) -> int:
    settings = load_settings()
    if args.action == "ls":
        for p in PROFILES.values():
            print(("* " if settings.profile == p.name else "  ") + f"{p.name}: {p.embedder}, {p.reranker}, batch {p.batch}")
    elif args.action == "current":
        print(settings.profile)
    elif args.action == "set":
        p = PROFILES[args.name]
        settings.profile, settings.embedder, settings.reranker = p.name, p.embedder, p.reranker
        save_settings(settings)
    else:
        from siftwell.plans.benchmark import run_all
        from siftwell.session import get_spark

        for row in run_all(get_spark(args.master), args.data, args.samples, args.repeats):
            print(row)
    return 0


def _tool(args: argparse.Namespace) -> int:
    engine = _engine(args)
    if args.command == "sync":
        engine.sync()
        print(engine.get_sync_status())
    elif args.command == "search":
        if not args.no_sync:
            engine.sync()
        if args.semantic:
            print(engine.semantic_search(args.query, args.n, args.filepath, args.language))
        else:
            print(engine.smart_search(args.query, args.n, args.filepath, args.regex))
    elif args.command == "read":
        print(engine.read_full_file(args.filepath))
    elif args.command == "serve":
        from siftwell.plans.service import serve

        return serve(engine, sys.stdin, sys.stdout)
    return 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="siftwell")
    p.add_argument("--master", default="local[*]")
    p.add_argument("--store")
    p.add_argument("--workspace-id")
    p.add_argument("--directory")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("version")
    sub.add_parser("info")
    db = sub.add_parser("db")
    db.add_argument("action", choices=["status", "clear", "reset"])
    for name in ("model", "reranker"):
        m = sub.add_parser(name)
        m.add_argument("action", choices=["ls", "current", "set", "pull", "rm"])
        m.add_argument("name", nargs="?", default="")
    pr = sub.add_parser("profile")
    pr.add_argument("action", choices=["ls", "current", "set", "benchmark"])
    pr.add_argument("name", nargs="?", default="fast")
    pr.add_argument("--data", default="")
    pr.add_argument("--samples", type=int, default=128)
    pr.add_argument("--repeats", type=int, default=3)
    sub.add_parser("sync")
    s = sub.add_parser("search")
    s.add_argument("query")
    s.add_argument("-n", type=int, default=5)
    s.add_argument("--filepath")
    s.add_argument("--language")
    s.add_argument("--regex")
    s.add_argument("--semantic", action="store_true")
    s.add_argument("--no-sync", action="store_true")
    r = sub.add_parser("read")
    r.add_argument("filepath")
    sub.add_parser("serve")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "version":
        print(__version__)
        return 0
    if args.command == "info":
        s = load_settings()
        print(f"siftwell {__version__}\nprofile {s.profile}\nembedder {s.embedder}\nreranker {s.reranker}")
        return 0
    if args.command == "db":
        return _db(args)
    if args.command in ("model", "reranker"):
        return _models("embedder" if args.command == "model" else "reranker", args)
    if args.command == "profile":
        return _profile(args)
    return _tool(args)


if __name__ == "__main__":
    sys.exit(main())
