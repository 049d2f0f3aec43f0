"""The tools over a line protocol: one JSON object a line, ``{"id": 1, "tool": "smart_search", "arguments": {...}}``."""

from __future__ import annotations

import json
from typing import TextIO

from siftwell.plans.search import SearchEngine

TOOLS = ("sync_workspace", "get_sync_status", "semantic_search", "smart_search", "read_full_file")


def call(engine: SearchEngine, tool: str, arguments: dict) -> str:
    """Runs a tool. The first search syncs the workspace if no sync has run."""
    if tool not in TOOLS:
        raise KeyError(f"unknown tool: {tool}")
    if tool == "sync_workspace":
        engine.sync(arguments.get("directory"))
        return engine.get_sync_status()
    if tool.endswith("_search") and engine.progress.status == "idle":
        engine.sync()
    return getattr(engine, tool)(**arguments)


def serve(engine: SearchEngine, requests: TextIO, answers: TextIO) -> int:
    for line in requests:
        if not line.strip():
            continue
        ident = None
        try:
            request = json.loads(line)
            ident = request.get("id")
            answer = {"id": ident, "result": call(engine, request["tool"], request.get("arguments") or {})}
        except Exception as e:
            answer = {"id": ident, "error": f"{type(e).__name__}: {e}"}
        answers.write(json.dumps(answer) + "\n")
        answers.flush()
    return 0
