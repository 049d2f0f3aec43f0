"""Finding the root folder of a workspace."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping
from pathlib import Path

from siftwell.operators.paths import check_root

#: Environment variables that may name the root, the first that is set wins.
ROOT_VARIABLES = ("WORKSPACE_PATH", "MCP_WORKSPACE_ROOT", "PROJECT_ROOT")


def has_placeholder(value: str) -> bool:
    """Whether an editor's placeholder was left unexpanded."""
    return re.search(r"\$\{[^}]+\}|%[^%]+%", value) is not None


def expand(value: str, env: Mapping[str, str] | None = None) -> str:
    """Home folder and variables in shell or ``%NAME%`` style; names that are not set stay."""
    env = os.environ if env is None else env
    out = re.sub(r"\$\{(\w+)\}|\$(\w+)|%([^%]+)%", lambda m: env.get(next(g for g in m.groups() if g), m.group()), value)
    return os.path.expanduser(out)


def resolve_root(argument: str | None = None, env: Mapping[str, str] | None = None, allow_unsafe: bool = False) -> Path:
    """The argument, else the first variable set, else the current folder."""
    env = os.environ if env is None else env
    given = argument or next((env[v] for v in ROOT_VARIABLES if env.get(v)), None) or os.getcwd()
    path = expand(given, env)
    if has_placeholder(path):
        raise ValueError(f"unresolved placeholder in workspace path: {given}")
    return check_root(path, allow_unsafe)
