"""The least number of edits of a text by spans: exact at any cost, in time cubic in the tokens.

Every rule of a grammar is taken as an automaton whose edges consume a token (free where it fits, 1 where it is
replaced), insert one (1), or call a rule. For every span of the text and every rule the least cost to read the span as
that rule comes from shorter spans; spans of one length are computed at once, as rows over their first tokens.

Guards (the next token is none of these) go with the places, through calls and returns. An inserted semicolon is free
where a newline, a closing brace or the end follows; else a closing brace must be made next. That it may stand only where
no other way takes the token can't be told from a span, so for scripts the cost is a lower bound, met where the edited
text is then recognised by the chart.
"""

from __future__ import annotations

import heapq
import tempfile
from collections import defaultdict

import numpy as np

#: Restriction after a semicolon that only a closing brace can justify.
BRACE = ("only", frozenset("}"))
#: Bytes of a table that is held in memory; larger ones are files.
HELD = 1 << 28


def _allowed(kinds: frozenset[str], barred) -> frozenset[str]:
    return kinds if barred is None else kinds & barred[1] if barred[0] == "only" else kinds - barred[1]


def _guarded(barred, guard):
    if not guard:
        return barred
    if barred is None:
        return ("bar", guard)
    return ("bar", barred[1] | guard) if barred[0] == "bar" else ("only", barred[1] - guard)


class Spans:
    def __init__(self, grammar):
        self.grammar = grammar
        self._automata()
        self._least()
        self._lay_out()
        self._units()

    def _automata(self) -> None:
        """States and edges of each rule under each restriction on its first token."""
        g, net = self.grammar, self.grammar.net
        exits: dict[tuple, set] = defaultdict(set)
        while True:
            before, automata, todo = sum(map(len, exits.values())), {}, [(g.start, None)]
            while todo:
                key = todo.pop()
                if key in automata:
                    continue
                rule, barred = key
                at = {(g.rules[rule][0], barred): 0}
                states, edges = list(at), []
                for place, b in states:  # grows
                    out = []

                    def to(p, c):
                        if (p, c) not in at:
                            at[p, c] = len(states)
                            states.append((p, c))
                        return at[p, c]

                    for t, guard in net.silent[place]:
                        out.append(("silent", None, to(t, _guarded(b, guard))))
                    for kinds, t in net.terms[place]:
                        if real := _allowed(kinds - g.free, b):
                            out.append(("term", real, to(t, None)))
                        if kinds & g.free and (b is None or b[0] == "bar"):
                            out.append(("free", to(t, BRACE), to(t, None)))
                    for name, t in net.calls[place]:
                        todo.append((name, b))
                        for c in sorted(exits[name, b], key=repr):
                            out.append(("call", (name, b, c), to(t, c)))
                    edges.append(out)
                for place, b in states:
                    if place == g.rules[rule][1]:
                        exits[key].add(b)
                automata[key] = (states, edges)
            if sum(map(len, exits.values())) == before:
                break
        self.automata = automata
        self.names = [(*k, b) for k in automata for b in sorted(exits[k], key=repr)]
        self.number = {k: n for n, k in enumerate(self.names)}
        self.scripts = bool(g.free)

    def _made(self, kinds: frozenset[str]) -> str | None:
        made = (kinds & self.grammar.makes) or kinds - self.grammar.unmade
        return min(made) if made else None

    def _ways(self, key: tuple, source: int, free: int) -> tuple[dict, dict]:
        """Least costs from a state without consuming a token, and how each state is reached."""
        edges, best, via, heap = self.automata[key][1], {source: 0}, {}, [(0, source)]
        while heap:
            cost, s = heapq.heappop(heap)
            if cost > best[s]:
                continue
            for what, x, t in edges[s]:
                if what == "free":
                    more, t = 0, t if free else x
                elif what == "term":
                    more = 1 if self._made(x) else None
                else:
                    more = 0 if what == "silent" else self.least[free].get(x)
                if more is not None and cost + more < best.get(t, 10**9):
                    best[t] = cost + more
                    via[t] = (s, what, x)
                    heapq.heappush(heap, (cost + more, t))
        return best, via

    def _least(self) -> None:
        """For each rule the least number of tokens that make it, where a semicolon is free and where it isn't."""
        self.least: list[dict] = [{}, {}]
        for free in (0, 1):
            changed = True
            while changed:
                changed = False
                for key, (states, _) in self.automata.items():
                    best, _ = self._ways(key, 0, free)
                    for s, cost in best.items():
                        name = (*key, states[s][1])
                        if name in self.number and states[s][0] == self.grammar.rules[key[0]][1] and cost < self.least[free].get(name, 10**9):
                            self.least[free][name], changed = cost, True

    def _lay_out(self) -> None:
        """Entries (states after a token or a call) and sinks (states before one, and final ones) of all automata."""
        terms, calls, self.parts, self.part_of = [], [], [], {}
        self.final = np.zeros(len(self.names), int)
        entries = sinks = 0
        for key, (states, edges) in self.automata.items():
            ends = sorted({0} | {t for out in edges for what, _, t in out if what in ("term", "call")})
            last = {s: (*key, b) for s, (p, b) in enumerate(states) if p == self.grammar.rules[key[0]][1]}
            starts = sorted({s for s, out in enumerate(edges) if any(w in ("term", "call") for w, _, _ in out)} | set(last))
            entry, sink = {s: entries + n for n, s in enumerate(ends)}, {s: sinks + n for n, s in enumerate(starts)}
            cost = np.full((2, len(ends), len(starts)), 10**6)
            for free in (0, 1) if self.scripts else (0,):
                for n, e in enumerate(ends):
                    best, _ = self._ways(key, e, free)
                    for m, s in enumerate(starts):
                        cost[free, n, m] = best.get(s, 10**6)
            if not self.scripts:
                cost[1] = cost[0]
            for s, name in last.items():
                self.final[self.number[name]] = sink[s]
            for s, out in enumerate(edges):
                for what, x, t in out:
                    if what == "term":
                        terms.append((entry[t], sink[s], x))
                    elif what == "call":
                        calls.append((entry[t], sink[s], self.number[x]))
            self.part_of[key] = len(self.parts)
            self.parts.append((key, entries, entries + len(ends), sinks, sinks + len(starts), cost, ends, starts))
            entries, sinks = entries + len(ends), sinks + len(starts)
        self.entries, self.sinks = entries, sinks
        self.terms, self.calls = sorted(terms, key=lambda x: x[:2]), sorted(calls)

    def _units(self) -> None:
        """Least cost of a rule over a span that another rule reads, by free and other semicolons at either end."""
        n = len(self.names)
        part = [p for p in self.parts for _ in range(p[4] - p[3])]  # of each sink
        self.start_cost = np.zeros((2, self.sinks), int)
        for p in self.parts:
            self.start_cost[:, p[3] : p[4]] = p[5][:, 0]
        self.unit = {}
        for a in (0, 1):
            for b in (0, 1):
                z = np.full((n, n), 10**6)
                np.fill_diagonal(z, 0)
                for e, s, r in self.calls:
                    p = part[s]
                    for name, o in self.number.items():
                        if name[:2] == p[0]:
                            z[r, o] = min(z[r, o], self.start_cost[a, s] + p[5][b, e - p[1], self.final[o] - p[3]])
                for k in range(n):
                    z = np.minimum(z, z[:, k : k + 1] + z[k : k + 1])
                self.unit[a, b] = z

    # texts
    def repair(self, kinds: list[str]) -> list[tuple[int, str, str]]:
        """The edits of least total cost."""
        return _Text(self, kinds).edits()


def _least_by(groups: np.ndarray, rows: np.ndarray, into: np.ndarray) -> None:
    """Lowers ``into[g]`` to the least of the rows of each group; groups are sorted."""
    if len(groups):
        first = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
        into[groups[first]] = np.minimum(into[groups[first]], np.minimum.reduceat(rows, first, axis=0))


class _Text:
    def __init__(self, spans: Spans, kinds: list[str]):
        self.s, self.kinds, self.n = spans, kinds, len(kinds)
        most = self.n + max((x for t in spans.least for x in t.values()), default=0) + 1
        self.type, self.inf = (np.int16, 16_000) if 4 * most < 16_000 else (np.int32, 10**9 // 2)
        base = [k.lstrip("\n") for k in kinds]
        self.free = np.array([k[:1] == "\n" or b == "}" for k, b in zip(kinds, base)] + [True], dtype=int) * spans.scripts
        fits = {k: np.array([k not in x for _, _, x in spans.terms], self.type) for k in set(base)}
        self.miss = np.stack([fits[b] for b in base], axis=1) if base else np.zeros((len(spans.terms), 0), self.type)
        self.unit = {k: np.minimum(z, self.inf).astype(self.type) for k, z in spans.unit.items()}
        self.ways = [np.minimum(p[5], self.inf).astype(self.type) for p in spans.parts]
        self._fill()

    def _rows(self, rows: int) -> list[np.ndarray]:
        """A table of ``rows`` for every span, by length."""
        n = self.n
        size = rows * (n + 1) * (n + 2) // 2
        if size * self.type().itemsize <= HELD:
            flat = np.empty(size, self.type)
        else:
            flat = np.memmap(tempfile.TemporaryFile(prefix="spans-"), self.type, "w+", shape=(size,))
        out, at = [], 0
        for m in range(n + 1):
            out.append(flat[at : at + rows * (n + 1 - m)].reshape(rows, n + 1 - m))
            at += rows * (n + 1 - m)
        return out

    def _out(self, x: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Costs at the sinks from those at the entries, for spans with a free semicolon at their end or none."""
        s = self.s
        v = np.full((s.sinks, x.shape[1]), self.inf, self.type)
        for free in (0, 1) if s.scripts else (0,):
            chosen = np.flatnonzero(ends == free)
            if not len(chosen):
                continue
            y = x[:, chosen] if s.scripts else x
            w = np.full((s.sinks, len(chosen)), self.inf, self.type)
            for (_, e0, e1, s0, s1, *_), k in zip(s.parts, self.ways):
                out = w[s0:s1]
                for e in range(e0, e1):
                    np.minimum(out, k[free, e - e0][:, None] + y[e], out=out)
            v[:, chosen] = w
        return v

    def _fill(self) -> None:
        s, n, typed = self.s, self.n, self.type
        te, ts = (np.array([t[c] for t in s.terms], int) for c in (0, 1))
        ce, cs, cr = (np.array([t[c] for t in s.calls], int) for c in (0, 1, 2))
        start = np.minimum(s.start_cost, self.inf).astype(typed)
        part_of = np.array([s.part_of[k[:2]] for k in s.names])
        self.cost, before = self._rows(len(s.names)), self._rows(len(s.calls))
        x = np.full((s.entries, n + 1), self.inf, typed)
        x[[p[1] for p in s.parts]] = 0
        for m in range(n + 1):
            w = n + 1 - m
            first, ends = self.free[:w], self.free[m:]
            if m:
                x = np.minimum(x[:, :w] + typed(1), typed(self.inf))
                _least_by(te, v[ts, :w] + self.miss[:, m - 1 :], x)
                if m > 1:
                    got, one = np.full((len(s.calls), w), self.inf, typed), np.empty((len(s.calls), w), typed)
                    for k in range(1, m):
                        np.take(self.cost[m - k][:, k : k + w], cr, axis=0, out=one, mode="clip")
                        one += before[k][:, :w]
                        np.minimum(got, one, out=got)
                    _least_by(ce, got, x)
            own = np.full((len(s.names), w), self.inf, typed)
            for r, p in enumerate(part_of):
                _, e0, e1, s0, *_ = s.parts[p]
                k = self.ways[p][:, :, s.final[r] - s0]
                own[r] = (x[e0:e1] + (k[ends].T if s.scripts else k[0][:, None])).min(axis=0)
            own = np.minimum(own, typed(self.inf))
            cost = self.cost[m]
            cost[:] = self.inf
            for key, z in self.unit.items():
                chosen = np.flatnonzero((first == key[0]) & (ends == key[1]))
                if len(chosen):
                    y = own[:, chosen]
                    best = y.copy()
                    for r in range(len(z)):
                        np.minimum(best, z[r][:, None] + y[r], out=best)
                    cost[:, chosen] = best
            if m:
                _least_by(ce, np.minimum(cost[cr], typed(self.inf)) + (start[:, cs][first].T if s.scripts else start[0, cs][:, None]), x)
            v = self._out(x, ends)
            before[m][:] = v[cs]

    def edits(self) -> list[tuple[int, str, str]]:
        s = self.s
        whole = [r for r, k in enumerate(s.names) if k[:2] == (s.grammar.start, None) and k[2] != BRACE]
        todo, out = [(min(whole, key=lambda r: self.cost[self.n][r, 0]), 0, self.n)], []
        while todo:  # from the last token to the first
            top = todo.pop()
            if isinstance(top[1], str):
                out.append(top)
            elif self.cost[top[2] - top[1]][top[0], top[1]]:
                todo += reversed(self._parts(*top))
        return out[::-1]

    def _parts(self, r: int, i: int, j: int) -> list[tuple]:
        """Edits and spans of rules, last first, that make the least cost of a rule over a span."""
        s, inf = self.s, self.inf
        n_part = s.part_of[s.names[r][:2]]
        key, e0, e1, s0, s1, _, ends, starts = s.parts[n_part]
        ways = np.minimum(self.ways[n_part].astype(np.int32), inf)
        terms = [(e - e0, a - s0, t) for t, (e, a, _) in enumerate(s.terms) if e0 <= e < e1]
        calls = [(e - e0, a - s0, c) for e, a, c in s.calls if e0 <= e < e1]
        x, v = np.full((j - i + 1, e1 - e0), inf), np.full((j - i + 1, s1 - s0), inf)
        x[0, 0] = 0
        spans = {c: [] for _, _, c in calls}
        for k in range(j - i + 1):
            if k:
                x[k] = x[k - 1] + 1
                for e, a, t in terms:
                    x[k, e] = min(x[k, e], v[k - 1, a] + self.miss[t, i + k - 1])
                for c in spans:
                    spans[c] = np.array([self.cost[k - m][c, i + m] for m in range(k)])
                for e, a, c in calls:
                    x[k, e] = min(x[k, e], (v[:k, a] + spans[c]).min())
            v[k] = (x[k][:, None] + ways[self.free[i + k]]).min(axis=0)
        out, k, a = [], j - i, int(s.final[r]) - s0
        while True:
            e = int((x[k] + ways[self.free[i + k]][:, a]).argmin())
            out += reversed([(i + k, "insert", kind) for kind in self._inserted(key, ends[e], starts[a], int(self.free[i + k]))])
            while True:
                if k == 0 and e == 0:
                    return out
                cost = x[k, e]
                found = next(((b, t) for f, b, t in terms if f == e and v[k - 1, b] + self.miss[t, i + k - 1] == cost), None)
                if found:
                    if self.miss[found[1], i + k - 1]:
                        out.append((i + k - 1, "replace", s._made(s.terms[found[1]][2]) or ""))
                    k, a = k - 1, found[0]
                    break
                found = next(((b, c, m) for f, b, c in calls if f == e for m in range(k - 1, -1, -1) if v[m, b] + self.cost[k - m][c, i + m] == cost), None)
                if found:
                    out.append((found[1], i + found[2], i + k))
                    k, a = found[2], found[0]
                    break
                out.append((i + k - 1, "delete", self.kinds[i + k - 1]))
                k -= 1

    def _inserted(self, key: tuple, source: int, state: int, free: int) -> list[str]:
        """The kinds of the tokens inserted from one state to another."""
        out, todo = [], [(key, source, state)]
        while todo:
            top = todo.pop()
            if isinstance(top, str):
                out.append(top)
                continue
            key, source, state = top
            via = self.s._ways(key, source, free)[1]
            while state != source:
                state, what, x = via[state]
                if what == "term":
                    todo.append(self.s._made(x))
                elif what == "call" and self.s.least[free][x]:
                    states = self.s.automata[x[:2]][0]
                    todo.append((x[:2], 0, states.index((self.s.grammar.rules[x[0]][1], x[2]))))
        return out
