"""Error-correcting chart recognition over recursive transition networks.

A grammar is EBNF text: ``Rule = ... ;`` with ``'literal'``, ``CLASS`` (a token class), ``Rule``, ``[ ]``
optional, ``{ }`` repeated, ``( )``, ``|`` and ``!('a' 'b')``: the next token is none of these. Rules must
not be left-recursive.

A chart column is the set of all live items, an item being a place in the network with the stack of
places to return to. Columns are interned, and the column after a token is remembered, so that the
chart of a text without errors is a walk over a table that grows as texts need it.

Where no item takes the next token, columns get costs: deleting a token, inserting one or replacing
one costs 1 each, and so does each token that would complete the text at its end. ``repair`` finds the edits of
least total cost.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from siftwell.llm.syntax.spans import Spans

END = "<end>"
#: Interned columns after which the tables of a grammar are dropped and grown anew.
MAX_COLUMNS = 5_000


class _Net:
    """Places of the network: terminal edges, silent edges, calls."""

    def __init__(self):
        self.terms: list[list[tuple[frozenset[str], int]]] = []
        self.silent: list[list[tuple[int, frozenset[str] | None]]] = []
        self.calls: list[list[tuple[str, int]]] = []

    def place(self) -> int:
        self.terms.append([])
        self.silent.append([])
        self.calls.append([])
        return len(self.terms) - 1


_SYMBOL = re.compile(r"\s*(?:#[^\n]*\n\s*)*(?:'([^']+)'|([A-Za-z_]\w*)|(!\()|([=;|(){}\[\]]))")


class Grammar:
    """``classes``: further token kinds that a class name stands for, itself included if it is a kind."""

    def __init__(self, text: str, start: str, classes: dict[str, Iterable[str]] | None = None):
        self.classes = {k: frozenset(v) for k, v in (classes or {}).items()}
        self.net, self.rules, self.finals = _Net(), {}, set()
        self._text, self._at = text, 0
        self._parse()
        self._least_costs()
        self._alike()
        self.start = start
        self.spans: Spans | None = None  # made when a text needs it
        self.clear()

    # the grammar's own notation
    def _peek(self) -> tuple | None:
        m = _SYMBOL.match(self._text, self._at)
        return m and (m.groups(), m.end())

    def _take(self) -> tuple:
        got, self._at = self._peek()
        return got

    def _parse(self) -> None:
        while self._peek():
            name = self._take()[1]
            assert self._take()[3] == "=", name
            first = self.rules.setdefault(name, (self.net.place(), self.net.place()))
            self.finals.add(first[1])
            self._choice(*first)
            assert self._take()[3] == ";", name

    def _choice(self, a: int, z: int) -> None:
        while True:
            self._row(a, z)
            if self._peek() and self._peek()[0][3] == "|":
                self._take()
            else:
                return

    def _row(self, a: int, z: int) -> None:
        net, at = self.net, a
        while (got := self._peek()) and got[0][3] not in ("|", ";", ")", "]", "}"):
            lit, name, guard, mark = self._take()
            to = net.place()
            if guard:
                out = set()
                while (x := self._take())[3] != ")":
                    out |= {x[0]} if x[0] else self.classes.get(x[1], {x[1]})
                net.silent[at].append((to, frozenset(out)))
            elif lit:
                net.terms[at].append((frozenset([lit]), to))
            elif name and name.isupper():
                net.terms[at].append((self.classes.get(name, frozenset([name])), to))
            elif name:
                if name not in self.rules:
                    self.rules[name] = (net.place(), net.place())
                net.calls[at].append((name, to))
            else:
                if mark == "{":
                    loop = net.place()
                    net.silent[at].append((loop, None))
                    self._choice(loop, loop)
                    net.silent[loop].append((to, None))
                else:
                    self._choice(at if mark == "(" else self._via(at), to)
                    if mark == "[":
                        net.silent[at].append((to, None))
                assert self._take()[3] == {"(": ")", "[": "]", "{": "}"}[mark]
            at = to
        net.silent[at].append((z, None))

    def _via(self, at: int) -> int:
        to = self.net.place()
        self.net.silent[at].append((to, None))
        return to

    def _least_costs(self) -> None:
        """For each place the least number of tokens to the end of its rule."""
        net, inf = self.net, 10**6
        cost = [inf] * len(net.terms)
        for _, z in self.rules.values():
            cost[z] = 0
        changed = True
        while changed:
            changed = False
            for p in range(len(cost)):
                best = cost[p]
                for kinds, t in net.terms[p]:
                    best = min(best, cost[t] + (not kinds & self.free))
                for t, _ in net.silent[p]:
                    best = min(best, cost[t])
                for name, t in net.calls[p]:
                    best = min(best, cost[self.rules[name][0]] + cost[t])
                if best < cost[p]:
                    cost[p], changed = best, True
        self.cost = cost
        passing = set(self.finals)  # places from which only the end of the rule can be reached
        grown = True
        while grown:
            grown = False
            for p in range(len(cost)):
                if p not in passing and not net.terms[p] and not net.calls[p] and net.silent[p]:
                    if all(t in passing and not g for t, g in net.silent[p]):
                        passing.add(p)
                        grown = True
        self.passing = passing

    #: Kinds that insertion never needs, and those that the grammar treats as no other.
    unmade: frozenset[str] = frozenset()
    #: Kinds that completing a text doesn't cost anything.
    free: frozenset[str] = frozenset()
    apart: frozenset[str] = frozenset()

    def _alike(self) -> None:
        """One kind for all that stand in the same edges and guards: edits need only one of them."""
        where: dict[str, list] = {}
        for p, edges in enumerate(self.net.terms):
            for n, (kinds, _) in enumerate(edges):
                for k in kinds:
                    where.setdefault(k, []).append((p, n))
        for p, edges in enumerate(self.net.silent):
            for n, (_, guard) in enumerate(edges):
                for k in guard or ():
                    where.setdefault(k, []).append((-1 - p, n))
        self.literals = frozenset(where)
        first: dict[tuple, str] = {}
        for k in sorted(where):
            if k not in self.unmade:
                first.setdefault((k,) if k in self.apart else tuple(where[k]), k)
        self.makes = frozenset(first.values())

    def variants(self, column: Column, kind: str) -> list[Column]:
        """The columns in which a token edited before ``kind`` may stand."""
        return [column]

    # columns
    def clear(self) -> None:
        self._columns: dict[frozenset, Column] = {}
        self._nodes: dict[tuple, tuple] = {}
        self._closed: dict[tuple, tuple] = {}
        if not hasattr(self, "dead"):  # columns that outlive the tables still lead to it
            self.dead = self.column_type(self, frozenset(), False)
        items, done = self._close([(self.rules[self.start][0], None, None)])
        self.first = self._column(items, done)

    def bound(self) -> None:
        """Drops the tables when they have grown large; called between texts."""
        if len(self._columns) > MAX_COLUMNS or len(self._nodes) > 10 * MAX_COLUMNS:
            self.clear()

    def kept(self, column: Column) -> Column:
        """``column``, which goes on in new tables if the old ones have grown large in the middle of a text."""
        if len(self._columns) <= MAX_COLUMNS and len(self._nodes) <= 10 * MAX_COLUMNS:
            return column
        self.clear()
        return self._column(set(column.items), column.done)

    def _node(self, place: int, parent: tuple | None) -> tuple:
        key = (place, id(parent))
        node = self._nodes.get(key)
        if node is None:
            cost = self.cost[place] + (parent[2] if parent else 0)
            node = self._nodes[key] = (place, parent, cost)
        return node

    def _close(self, todo: list) -> tuple[set, bool]:
        net, items, done, seen = self.net, set(), False, set()
        while todo:
            place, parent, barred = todo.pop()
            key = (place, id(parent), barred)
            if key in seen:
                continue
            seen.add(key)
            if place in self.finals:
                if parent is None:
                    done = True
                else:
                    todo.append((parent[0], parent[1], barred))
                continue
            if net.terms[place]:
                items.add((place, parent, barred))
            for to, guard in net.silent[place]:
                todo.append((to, parent, barred if not guard else guard if not barred else barred | guard))
            for name, to in net.calls[place]:
                todo.append((self.rules[name][0], parent if to in self.passing else self._node(to, parent), barred))
        return items, done

    def _column(self, items: set, done: bool) -> Column:
        if not items and not done:
            return self.dead
        key = frozenset((p, id(q), b) for p, q, b in items) | frozenset([done])
        column = self._columns.get(key)
        if column is None:
            column = self._columns[key] = self.column_type(self, frozenset(items), done)
        return column

    def _after(self, column: Column, kind: str) -> Column:
        if kind == END:
            return column if column.done else self.dead
        terms = self.net.terms
        items, done = set(), False
        for place, parent, barred in column.items:
            if barred is None or kind not in barred:
                for kinds, to in terms[place]:
                    if kind in kinds:
                        found = self._from(to, parent)
                        items |= found[0]
                        done |= found[1]
        return self._column(items, done)

    def _from(self, place: int, parent: tuple | None) -> tuple:
        """(items, done, kinds taken next, parent) of a place, remembered; the parent is held so that its id stays its own."""
        key = (place, id(parent))
        found = self._closed.get(key)
        if found is None:
            items, done = self._close([(place, parent, None)])
            takes = {k for p, _, barred in items for kinds, _ in self.net.terms[p] for k in kinds if not barred or k not in barred}
            found = self._closed[key] = (items, done, takes, parent)
        return found


class Column(dict):
    """A chart column; as a mapping, token kind -> the column after it."""

    __slots__ = ("grammar", "items", "done", "_follow")

    def __init__(self, grammar: Grammar, items: frozenset, done: bool):
        self.grammar, self.items, self.done, self._follow = grammar, items, done, None

    def __missing__(self, kind: str) -> Column:
        out = self[kind] = self.grammar._after(self, kind)
        return out

    def __hash__(self) -> int:
        return id(self)

    def __eq__(self, other: object) -> bool:
        return self is other

    def follow(self) -> dict[str, set[str]]:
        """Kind that some item takes next (one of those alike) -> kinds taken after it."""
        if self._follow is None:
            self._follow = self._taken()
        return self._follow

    def _taken(self) -> dict[str, set[str]]:
        terms, makes, out = self.grammar.net.terms, self.grammar.makes, {}
        for place, parent, barred in self.items:
            for kinds, to in terms[place]:
                takes = None
                for k in kinds & makes:
                    if not barred or k not in barred:
                        takes = takes or self.grammar._from(to, parent)[2]
                        if k in out:
                            out[k] |= takes
                        else:
                            out[k] = set(takes)
        return {k: out[k] for k in sorted(out)}

    def goes_on(self, kind: str, follow: set[str], after: str) -> bool:
        """Whether ``after`` can come after ``kind``, as far as ``follow`` tells; no is certain."""
        return after in follow

    def least_end(self) -> int:
        """The least number of tokens that complete the text from here."""
        if self.done:
            return 0
        cost = self.grammar.cost
        return min((cost[p] + (q[2] if q else 0) for p, q, _ in self.items), default=10**6)


def walk(grammar: Grammar, kinds: list[str], column: Column | None = None, at: int = 0) -> tuple[int, Column]:
    """The number of tokens taken from ``at`` on, and the last live column."""
    if column is None:
        grammar.bound()
    column = column or grammar.first
    dead = grammar.dead
    for i in range(at, len(kinds)):
        after = column[kinds[i]]
        if after is dead:
            return i, column
        column = after
    return len(kinds), column


def repair(grammar: Grammar, kinds: list[str], window: int = 6, ahead: int = 6, beam: int = 48, budget: int = 6_000) -> tuple[int, list[tuple[int, str, str]], bool]:
    """(cost, edits, least): the cheapest repair of a whole text; an edit is (token place, "insert" / "delete" /
    "replace", kind).

    First each error is repaired by the cheapest edits within ``window`` tokens before it after which the parse goes on for
    ``ahead`` tokens or to the end (of the places after a first edit, the ``beam`` that come furthest get a second, half as many
    after each error where none does and the token is deleted), however many errors there are. That bounds the cost. Then every way
    to edit the text anywhere at a lower total cost is tried, cost by cost; one that is found is the minimum. Cost 1 is always tried
    wholly. Where the ``budget`` of places (a place being a token with a column before it) ends the search at a higher cost, the
    minimum comes from the costs of all spans instead (``spans``), at any cost. ``least`` is false only where that cannot tell: for
    scripts, if the edited text needs a semicolon that only a newline stands for where another way takes the next token, and the
    bounds differ; then the cost is an upper bound."""
    grammar.bound()
    cost, edits = _error_by_error(grammar, kinds, window, ahead, beam)
    strange = sum(k.lstrip("\n") not in grammar.literals for k in kinds)  # each of them takes an edit
    for most in range(max(1, strange), cost):
        found, complete = cheapest(grammar, kinds, most, budget if most > 1 else None)
        if found is not None:
            return len(found), found, True
        if not complete:
            if grammar.spans is None:
                grammar.spans = Spans(grammar)
            found = grammar.spans.repair(kinds)
            if len(found) < cost and takes(grammar, kinds, found):
                return len(found), found, True
            return cost, edits, len(found) >= cost
    return cost, edits, True


def takes(grammar: Grammar, kinds: list[str], edits: list[tuple[int, str, str]]) -> bool:
    """Whether the edited text is recognised; the edits are in the order of their places, insertions first."""
    at: dict[int, list] = {}
    for i, what, t in edits:
        at.setdefault(i, []).append((what, t))
    columns = {grammar.first}
    for i, kind in enumerate([*kinds, END]):
        kept = True
        for what, t in at.get(i, ()):
            if what != "delete":
                columns = {b[t] for c in columns for b in grammar.variants(c, kind)} - {grammar.dead}
            kept = kept and what == "insert"
        if kept:
            columns = {c[kind] for c in columns} - {grammar.dead}
    return bool(columns)


def _completed(column: Column) -> int:
    """The least number of tokens inserted at the end of a text that has ``column`` there."""
    return 0 if column[END] is not column.grammar.dead else max(1, column.least_end())


def cheapest(grammar: Grammar, kinds: list[str], most: int, budget: int | None) -> tuple[list | None, bool]:
    """(edits, complete) of the cheapest repair of at most ``most`` edits anywhere in the text, None where there is none.

    Places are reached in order of cost, each once; the edits of a place lead to places of the next cost. ``complete`` is
    false if the ``budget`` of places ran out before every place of a lower cost was tried."""
    n, dead, best = len(kinds), grammar.dead, None
    seen: set[tuple[int, int]] = set()
    seeds: list[tuple[int, Column, tuple]] = [(0, grammar.first, ())]
    for cost in range(most + 1):
        trail = []
        for i, column, done in seeds:
            while (i, id(column)) not in seen:
                seen.add((i, id(column)))
                trail.append((i, column, done))
                if i == n:
                    total = cost + _completed(column)
                    if total <= most:
                        most = total - 1
                        best = [*done, *((n, "insert", "") for _ in range(total - cost))]
                    break
                after = column[kinds[i]]
                if after is dead:
                    break
                column, i = after, i + 1
        if cost >= most:
            break
        seeds, last = [], cost + 1 == most
        for i, column, done in sorted(trail, key=lambda x: -x[0]):  # of equal costs the last place, where the text shows its error
            if i == n:
                continue
            seeds += edited(kinds, i, column, done, last)
            if budget is not None and len(trail) + len(seeds) > budget:
                return best, False
    return best, True


def edited(kinds: list[str], i: int, column: Column, done: tuple, alive: bool) -> list[tuple[int, Column, tuple]]:
    """Where one edit at token ``i`` leads; with ``alive``, only where the next token is taken after it."""
    dead, kind = column.grammar.dead, kinds[i]
    after = kinds[i + 1] if i + 1 < len(kinds) else None
    out = []
    if not alive or after is None or column[after] is not dead:
        out.append((i + 1, column, (*done, (i, "delete", kind))))
    for before in column.grammar.variants(column, kind):
        for t, follow in before.follow().items():
            if not alive or before.goes_on(t, follow, kind):
                if (c := before[t]) is not dead and (not alive or c[kind] is not dead):
                    out.append((i, c, (*done, (i, "insert", t))))
            if not alive or after is None or before.goes_on(t, follow, after):
                if (c := before[t]) is not dead and (not alive or after is None or c[after] is not dead):
                    out.append((i + 1, c, (*done, (i, "replace", t))))
    return out


def _error_by_error(grammar: Grammar, kinds: list[str], window: int, ahead: int, beam: int) -> tuple[int, list[tuple[int, str, str]]]:
    column, at, edits, n = grammar.first, 0, [], len(kinds)
    trail = [(0, column)]  # places since the last edit, each with the column before its token
    dead, failed = grammar.dead, -1 - ahead  # where an error was last met by deletion alone
    while True:
        while at < n and (after := column[kinds[at]]) is not dead:
            column = after
            at += 1
            trail.append((at, column))
        if at == n:
            least = _completed(column)
            return len(edits) + least, [*edits, *((n, "insert", "") for _ in range(least))]
        way = _local(kinds, at, trail[-1 - window :], min(n, at + ahead), beam if at - failed > ahead else 0)
        if way is None:  # texts of another language are full of these: a shorter look each time
            way, failed, beam = (at + 1, column, ((at, "delete", kinds[at]),)), at, beam // 2 if at - failed > ahead else beam
        at, column, done = way
        edits.extend(done)
        column = grammar.kept(column)
        trail = [(at, column)]


def _local(kinds: list[str], at: int, trail: list, far: int, beam: int) -> tuple | None:
    """(place, column, edits) of the cheapest repair around an error at ``at``: of those of the least cost whose parse
    comes to ``far``, the one that goes on furthest. Where two edits don't do, None."""
    n, dead = len(kinds), trail[0][1].grammar.dead
    seen: set[tuple[int, int]] = set()
    places = [(i, c, ()) for i, c in reversed(trail)]
    for cost in (1, 2):
        reached, dying = [], []
        for i, column, done in places:
            for j, c, d in edited(kinds, i, column, done, cost == 2) if i < n else ():
                if (j, id(c)) in seen:
                    continue
                seen.add((j, id(c)))
                k, x, way = j, c, [(j, c, d)]
                while k < n and (y := x[kinds[k]]) is not dead:
                    x, k = y, k + 1
                    if k <= far:
                        way.append((k, x, d))
                if k >= far and k > at:
                    reached.append((_completed(x) if k == n else 1, -k, len(reached), (j, c, d)))
                elif cost == 1:
                    dying += way
        if reached:
            return min(reached)[3]
        once = {(i, id(c)): (i, c, d) for i, c, d in reversed(dying)}
        places = sorted(once.values(), key=lambda x: -x[0])[:beam]
    return None


Grammar.column_type = Column
