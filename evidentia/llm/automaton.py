"""One deterministic automaton for many rules.

A rule is a regular expression over bytes. Each rule becomes a search machine
by subset construction, whose states are the possible starts of a match in
order, the earliest first; the machines run side by side as one product,
which is minimised and laid out as one transition array. One pass over the
bytes then reports every end of a leftmost, longest, non-overlapping match of
every rule. A second, reversed automaton per rule walks back from an end to
its start.

Syntax: literals, ``[...]`` with ranges, ``(...)``, ``|``, ``?``, ``*``, ``+``,
``{n}``, ``{n,}``, ``{n,m}``, ``\\xHH`` and escaped punctuation, all ASCII.

One pass decides a rule only if its match, once complete, goes on byte by byte
or ends (as ``X+`` tails do), and if no later start can be complete before an
earlier one is settled. A rule without these properties is refused when it is
compiled (``RuleError``), never scanned wrongly.
"""

from __future__ import annotations

from dataclasses import dataclass

END = 0xFF                     # a byte that no UTF-8 text holds: ends a text
MAX_REPEAT = 256


class RuleError(ValueError):
    """A rule that cannot be read, or not be decided in one pass."""


@dataclass(frozen=True)
class Rule:
    """``match`` is what is searched for; a found match counts if all of it
    also matches ``keep`` (none: every match counts)."""
    kind: str
    match: str
    keep: str | None = None
    either_case: bool = False


# --- expressions -----------------------------------------------------------------

class _Reader:
    """Expression text -> tree of ("set", mask), ("cat", ..), ("alt", ..), ("rep", x, lo, hi)."""

    def __init__(self, text: str, either_case: bool):
        if not text.isascii():
            raise RuleError(f"only ASCII rules: {text!r}")
        self.s, self.i, self.either = text, 0, either_case

    def tree(self):
        t = self.alternatives()
        if self.i < len(self.s):
            raise RuleError(f"unexpected {self.s[self.i]!r} in {self.s!r}")
        return t

    def at(self, c: str) -> bool:
        return self.i < len(self.s) and self.s[self.i] == c

    def take(self) -> str:
        if self.i >= len(self.s):
            raise RuleError(f"{self.s!r} ends too early")
        self.i += 1
        return self.s[self.i - 1]

    def alternatives(self):
        parts = [self.sequence()]
        while self.at("|"):
            self.i += 1
            parts.append(self.sequence())
        return parts[0] if len(parts) == 1 else ("alt", parts)

    def sequence(self):
        parts = []
        while self.i < len(self.s) and self.s[self.i] not in "|)":
            parts.append(self.repeated())
        return ("cat", parts)

    def repeated(self):
        x = self.atom()
        while self.i < len(self.s) and self.s[self.i] in "?*+{":
            c = self.take()
            if c == "{":
                inner = ""
                while not self.at("}"):
                    inner += self.take()
                self.i += 1
                lo, comma, hi = inner.partition(",")
                if not lo.isdigit() or (hi and not hi.isdigit()):
                    raise RuleError(f"bad repeat {{{inner}}} in {self.s!r}")
                low, high = int(lo), (int(hi) if hi else None) if comma else int(lo)
            else:
                low, high = {"?": (0, 1), "*": (0, None), "+": (1, None)}[c]
            if max(low, high or 0) > MAX_REPEAT or (high is not None and high < low):
                raise RuleError(f"repeat out of range in {self.s!r}")
            x = ("rep", x, low, high)
        return x

    def atom(self):
        c = self.take()
        if c == "(":
            t = self.alternatives()
            if self.take() != ")":
                raise RuleError(f"no closing bracket in {self.s!r}")
            return t
        if c == "[":
            return ("set", self.members())
        if c in ".^$*+?{":
            raise RuleError(f"{c!r} is not supported in {self.s!r}")
        return ("set", self.mask(self.escaped() if c == "\\" else ord(c)))

    def escaped(self) -> int:
        c = self.take()
        if c == "x":
            return int(self.take() + self.take(), 16)
        if c.isalnum():
            raise RuleError(f"\\{c} is not supported in {self.s!r}")
        return ord(c)

    def members(self) -> int:
        mask, first = 0, True
        while first or not self.at("]"):
            c = self.take()
            if first and c == "^":
                raise RuleError(f"[^ is not supported in {self.s!r}")
            first = False
            lo = self.escaped() if c == "\\" else ord(c)
            hi = lo
            if self.at("-") and self.s[self.i + 1:self.i + 2] not in ("]", ""):
                self.i += 1
                d = self.take()
                hi = self.escaped() if d == "\\" else ord(d)
            for b in range(lo, hi + 1):
                mask |= self.mask(b)
        self.i += 1
        return mask

    def mask(self, b: int) -> int:
        m = 1 << b
        if self.either and chr(b).isalpha():
            m |= 1 << ord(chr(b).swapcase())
        return m


class _Nfa:
    """Nodes with one byte-set edge or empty edges, built from trees."""

    def __init__(self):
        self.eps: list[list[int]] = []
        self.edge: list[tuple[int, int] | None] = []

    def node(self) -> int:
        self.eps.append([])
        self.edge.append(None)
        return len(self.eps) - 1

    def add(self, tree, start: int, backwards: bool = False) -> int:
        """Append ``tree`` after ``start``; the node where it ends."""
        kind = tree[0]
        if kind == "set":
            out = self.node()
            mid = self.node()
            self.eps[start].append(mid)
            self.edge[mid] = (tree[1], out)
            return out
        if kind == "cat":
            for t in (reversed(tree[1]) if backwards else tree[1]):
                start = self.add(t, start, backwards)
            return start
        if kind == "alt":
            out = self.node()
            for t in tree[1]:
                self.eps[self.add(t, start, backwards)].append(out)
            return out
        _, x, low, high = tree
        for _ in range(low):
            start = self.add(x, start, backwards)
        if high is None:
            loop = self.node()
            self.eps[start].append(loop)
            self.eps[self.add(x, loop, backwards)].append(loop)
            out = self.node()
            self.eps[loop].append(out)
            return out
        out = self.node()
        self.eps[start].append(out)
        for _ in range(high - low):
            start = self.add(x, start, backwards)
            self.eps[start].append(out)
        return out

    def closure(self, nodes) -> frozenset:
        """Nodes with an edge, and end nodes, that are reached without a byte."""
        seen, todo = set(), list(nodes)
        while todo:
            n = todo.pop()
            if n not in seen:
                seen.add(n)
                todo.extend(self.eps[n])
        return frozenset(n for n in seen if self.edge[n] or not self.eps[n])

    def step(self, nodes, byte: int) -> frozenset:
        return self.closure([e[1] for e in map(self.edge.__getitem__, nodes) if e and e[0] >> byte & 1])


# --- machines ------------------------------------------------------------------------

def _minimal(rows: list[list[tuple]]) -> list[list[tuple]]:
    """Moore's partition refinement of a machine whose rows hold (next, output)
    per byte class; state 0 stays the first."""
    part = [0] * len(rows)
    count = 1
    while True:
        names: dict = {}
        new = [names.setdefault((part[i], tuple((part[n], o) for n, o in row)), len(names)) for i, row in enumerate(rows)]
        if len(names) == count:
            break
        part, count = new, len(names)
    out: list = [None] * count
    for i, row in enumerate(rows):
        if out[part[i]] is None:
            out[part[i]] = [(part[n], o) for n, o in row]
    return out                 # state 0 is seen first, so it is class 0


def _explore(first, step, classes: list[int]) -> list[list[tuple]]:
    """All states reachable from ``first`` with ``step(state, byte) -> (state, output)``."""
    ids, order, rows = {first: 0}, [first], []
    while len(rows) < len(order):
        row = []
        for b in classes:
            nxt, out = step(order[len(rows)], b)
            if nxt not in ids:
                ids[nxt] = len(order)
                order.append(nxt)
            row.append((ids[nxt], out))
        rows.append(row)
    return rows


def _search_machine(rule: Rule, bit: int, classes: list[int]) -> list[list[tuple]]:
    """Search machine of one rule; an output is (ended, counted) as bits."""
    nfa = _Nfa()
    begin, match_end = nfa.node(), None
    match_end = nfa.add(_Reader(rule.match, rule.either_case).tree(), begin)
    searched = set(range(len(nfa.eps)))
    keep_begin = nfa.node()
    keep_end = nfa.add(_Reader(rule.keep or rule.match, rule.either_case).tree(), keep_begin)
    fresh = nfa.closure([begin, keep_begin])
    if match_end in fresh:
        raise RuleError(f"{rule.kind}: matches the empty text")

    def step(state, byte):
        complete, groups = state
        if complete:
            went = nfa.step(groups[0], byte)
            if match_end in went:
                return (True, (went,)), (0, 0)
            if went & searched:
                raise RuleError(f"{rule.kind}: a complete match may go on without being complete")
            nxt, _ = step((False, ()), byte)
            return nxt, (bit, bit if keep_end in groups[0] else 0)
        alive, seen = [], set()
        for g in (*groups, fresh):
            went = nfa.step(g, byte)
            new = (went & searched) - seen
            if not new:
                continue
            if match_end in new:
                if alive:
                    raise RuleError(f"{rule.kind}: a later start may be complete before an earlier one")
                return (True, (went,)), (0, 0)
            seen |= new
            alive.append(new | (went - searched))
        return (False, tuple(alive)), (0, 0)

    return _minimal(_explore((False, ()), step, classes))


def _byte_classes(trees) -> tuple[list[int], bytes]:
    """Bytes that no rule tells apart share a class: (one byte per class, class of each byte)."""
    masks: set = set()

    def walk(t):
        if t[0] == "set":
            masks.add(t[1])
        else:
            for x in (t[1] if t[0] != "rep" else [t[1]]):
                walk(x)

    for t in trees:
        walk(t)
    ordered = sorted(masks)
    names: dict = {}
    of = bytes(names.setdefault(tuple(m >> b & 1 for m in ordered), len(names)) for b in range(256))
    return [of.index(k) for k in range(len(names))], of


class Automaton:
    """The compiled rules: plain lists and bytes, so it travels with a task."""

    def __init__(self, rules: list[Rule]):
        if len({r.kind for r in rules}) < len(rules):
            raise RuleError("two rules of one kind")
        self.kinds = [r.kind for r in rules]
        trees = [_Reader(x, r.either_case).tree() for r in rules for x in (r.match, r.keep or r.match)]
        reps, self.classes = _byte_classes(trees)
        self.width = len(reps)
        parts = [_search_machine(r, 1 << k, reps) for k, r in enumerate(rules)]
        index = {b: k for k, b in enumerate(reps)}

        def step(state, byte):
            k = index[byte]
            went = [p[s][k] for p, s in zip(parts, state)]
            ended = counted = 0
            for _, (e, c) in went:
                ended, counted = ended | e, counted | c
            return tuple(n for n, _ in went), (ended, counted)

        rows = _minimal(_explore((0,) * len(parts), step, reps))
        self.states = len(rows)
        # next state as an offset into the array; ~offset where a match ended
        self.next = [~(n * self.width) if o[0] else n * self.width for row in rows for n, o in row]
        self.out = {i * self.width + k: o for i, row in enumerate(rows) for k, (_, o) in enumerate(row) if o[0]}
        self.back = [self._backwards(r, reps) for r in rules]

    def _backwards(self, rule: Rule, reps: list[int]):
        """(transition array, complete states) of the reversed rule, None where it stops."""
        nfa = _Nfa()
        begin = nfa.node()
        end = nfa.add(_Reader(rule.match, rule.either_case).tree(), begin, backwards=True)
        rows = _minimal(_explore((False, nfa.closure([begin])),
                                 lambda s, b: ((end in (w := nfa.step(s[1], b)), w), (end in w, not w)), reps))
        return [None if o[1] else (n * self.width, o[0]) for row in rows for n, o in row]

    def ends(self, data: bytes) -> list[tuple[int, int, int]]:
        """(position after it, ended rules, counted rules) of every match end.
        ``data`` is in classes and its last byte is that of END."""
        nxt, out, found, s = self.next, self.out, [], 0
        for i, b in enumerate(data):
            k = s + b
            s = nxt[k]
            if s < 0:
                s = ~s
                found.append((i, *out[k]))
        return found

    def start(self, rule: int, data: bytes, end: int, low: int) -> int:
        """Leftmost start, not before ``low``, of a match of ``rule`` that ends at ``end``."""
        table, s, best = self.back[rule], 0, end
        for i in range(end - 1, low - 1, -1):
            went = table[s + data[i]]
            if went is None:
                break
            s, complete = went
            if complete:
                best = i
        return best

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, end, rule) of every match that counts, by start, then rule.
        ``data``: texts, each followed by END."""
        data = data.translate(self.classes)
        last = [0] * len(self.kinds)
        found = []
        for end, ended, counted in self.ends(data):
            for r in range(len(last)):
                if ended >> r & 1:
                    if counted >> r & 1:
                        found.append((self.start(r, data, end, last[r]), end, r))
                    last[r] = end
        found.sort(key=lambda x: (x[0], x[2]))
        return found
