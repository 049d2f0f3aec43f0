"""Ignore rules of a root folder's ``.gitignore``."""

from __future__ import annotations

import re
from collections.abc import Iterable


def _translate(pattern: str) -> str:
    """A glob to a regular expression; ``**`` crosses folders, ``*`` and ``?`` do not."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
            continue
        if pattern.startswith("**", i):
            out.append(".*")
            i += 2
            continue
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[":
            end = pattern.find("]", i + 2)
            if end < 0:
                out.append(r"\[")
            else:
                inner = pattern[i + 1 : end].replace("\\", r"\\")
                out.append("[" + ("^" + inner[1:] if inner[0] in "!^" else inner) + "]")
                i = end
        elif c == "\\" and i + 1 < len(pattern):
            i += 1
            out.append(re.escape(pattern[i]))
        else:
            out.append(re.escape(c))
        i += 1
    return "".join(out)


class IgnoreRules:
    """Rules in order; the last that matches a path or one of its parents decides."""

    def __init__(self, lines: Iterable[str]):
        self.rules: list[tuple[re.Pattern, bool, bool]] = []
        for line in lines:
            rule = line.rstrip("\r\n")
            if not rule.endswith("\\ "):
                rule = rule.rstrip()
            if not rule or rule.startswith("#"):
                continue
            keep = rule.startswith("!")
            rule = rule[1:] if keep or rule.startswith(("\\!", "\\#")) else rule
            folder = rule.endswith("/")
            rule = rule.rstrip("/")
            anchored = "/" in rule
            rule = rule.lstrip("/")
            if rule:
                prefix = "" if anchored else "(?:.*/)?"
                self.rules.append((re.compile(prefix + _translate(rule) + r"\Z"), keep, folder))

    def ignores(self, path: str, folder: bool = False) -> bool:
        """Whether a path (with forward slashes, relative to the root) is ignored."""
        parts = path.strip("/").split("/")
        for n in range(1, len(parts)):
            if self._verdict("/".join(parts[:n]), True):
                return True
        return self._verdict("/".join(parts), folder)

    def _verdict(self, path: str, folder: bool) -> bool:
        out = False
        for pattern, keep, only_folder in self.rules:
            if (folder or not only_folder) and pattern.match(path):
                out = not keep
        return out
