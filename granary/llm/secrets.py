"""Secret scan with one combined deterministic automaton.

The rules' regular expressions are parsed to an NFA over bytes, determinised together by
subset construction behind a start loop, minimised by partition refinement and stored as
one transition array. A single pass over a text's bytes then watches all rules at once.
Where it reports that a rule can end, that rule's reversed automaton finds the leftmost
start and its anchored automaton the longest end.

A null text counts as empty: no spans.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame

from .rows import map_rows, pick


@dataclass(frozen=True)
class Rule:
    """``pattern``: literals, classes, groups, ``|``, ``?``, ``*``, ``+``, ``{n}``, ``{n,}``. ``fold``: ASCII letters of bare words in either case.

    A match shorter than ``size``, or whose value behind the delimiter is shorter than ``least``, is dropped after matching.
    """

    kind: str
    pattern: str
    fold: bool = False
    base: bool = False
    least: int = 0
    size: int = 0


# The base rules. The hex run is written {8,}, so that common letters don't report an
# end: shorter runs of the one class would be dropped after matching, with the same spans left. No
# other run is counted in the automaton, since every further counter would multiply the states.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", fold=True, base=True, least=6),
    Rule("access", r"AKIA[A-Z0-9]+", base=True, size=20),
    Rule("hex", r"[0-9a-f]{8,}", base=True, size=24),
)
#: Public token formats that the base rules don't name.
EXTRA = (
    Rule("github", r"gh(p|o|u|s|r)_[A-Za-z0-9]+", size=34),
    Rule("jwt", r"eyJ[A-Za-z0-9_.-]+", size=40),
    # the key's own lines too, as far as they are base64, and the END line; line ends may be written as escapes
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----(([\x0A\x0D]|\\n|\\r)+[A-Za-z0-9+/=]+)*(([\x0A\x0D]|\\n|\\r)+-----END [A-Z ]*PRIVATE KEY-----)?"),
)
RULES = BASE + EXTRA


class Parser:
    """A regular expression to a tree: a frozenset of bytes, or ("cat" | "alt", parts), ("rep", part, least, unbounded)."""

    def __init__(self, pattern: str, fold: bool) -> None:
        self.p, self.at, self.fold = pattern, 0, fold

    def peek(self) -> str:
        return self.p[self.at] if self.at < len(self.p) else ""

    def take(self) -> str:
        self.at += 1
        return self.p[self.at - 1]

    def parse(self):
        tree = self.either()
        if self.at < len(self.p):
            raise ValueError(f"unexpected {self.peek()!r} at {self.at} in {self.p!r}")
        return tree

    def either(self):
        parts = [self.sequence()]
        while self.peek() == "|":
            self.take()
            parts.append(self.sequence())
        return parts[0] if len(parts) == 1 else ("alt", parts)

    def sequence(self):
        parts = []
        while self.peek() not in ("", "|", ")"):
            part = self.atom()
            while self.peek() and self.peek() in "?*+{":
                part = self.repeated(part, self.take())
            parts.append(part)
        return ("cat", parts)

    def repeated(self, part, sign: str):
        if sign == "{":
            to = self.p.index("}", self.at)
            least, comma, most = self.p[self.at : to].partition(",")
            self.at = to + 1
            if most:
                raise ValueError("{n,m} is not supported")
            return ("rep", part, int(least), bool(comma))
        return ("alt", [part, ("cat", [])]) if sign == "?" else ("rep", part, int(sign == "+"), True)

    def byte(self) -> int:
        c = self.take()
        if c != "\\":
            return ord(c)
        if self.peek() == "x":
            self.at += 3
            return int(self.p[self.at - 2 : self.at], 16)
        return ord(self.take())

    def atom(self):
        if self.peek() == "(":
            self.take()
            tree = self.either()
            self.take()
            return tree
        if self.peek() != "[":
            b = self.byte()
            return frozenset({b, ord(chr(b).swapcase())} if self.fold and chr(b).isalpha() else {b})
        self.take()
        out: set[int] = set()
        while self.peek() != "]":
            low = high = self.byte()
            if self.peek() == "-" and self.p[self.at + 1] != "]":
                self.take()
                high = self.byte()
            out |= set(range(low, high + 1))
        self.take()
        return frozenset(out)


def backwards(tree):
    if isinstance(tree, frozenset):
        return tree
    if tree[0] == "rep":
        return ("rep", backwards(tree[1]), *tree[2:])
    return (tree[0], [backwards(x) for x in (tree[1][::-1] if tree[0] == "cat" else tree[1])])


class NFA:
    def __init__(self) -> None:
        self.moves: list[list[tuple[frozenset, int]]] = []
        self.free: list[list[int]] = []

    def state(self) -> int:
        self.moves.append([])
        self.free.append([])
        return len(self.moves) - 1

    def add(self, tree, at: int) -> int:
        """Appends the tree behind state ``at``; returns its last state."""
        if isinstance(tree, frozenset):
            self.moves[at].append((tree, to := self.state()))
            return to
        if tree[0] == "cat":
            for part in tree[1]:
                at = self.add(part, at)
            return at
        if tree[0] == "alt":
            to = self.state()
            for part in tree[1]:
                self.free[at].append(begin := self.state())
                self.free[self.add(part, begin)].append(to)
            return to
        for _ in range(tree[2]):
            at = self.add(tree[1], at)
        if tree[3]:
            self.free[at].append(loop := self.state())
            self.free[self.add(tree[1], loop)].append(loop)
            at = loop
        return at

    def closure(self, states) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for x in self.free[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(seen)


class DFA:
    """``step[state * width + classes[byte]]`` is the next state times ``width``; ``ends[state]`` the rules that can end there; -1: dead."""

    def __init__(self, trees: list, *, search: bool) -> None:
        nfa = NFA()
        start = nfa.state()
        last = {}
        for k, tree in enumerate(trees):
            nfa.free[start].append(begin := nfa.state())
            last[nfa.add(tree, begin)] = k
        sets = {s for moves in nfa.moves for s, _ in moves}
        groups: dict[tuple, list[int]] = defaultdict(list)
        ordered = sorted(sets, key=sorted)
        for b in range(256):
            groups[tuple(b in s for s in ordered)].append(b)
        members = list(groups.values())
        self.width = len(members)
        classes = [0] * 256
        for c, bs in enumerate(members):
            for b in bs:
                classes[b] = c
        origin = nfa.closure([start])
        number, rows = {origin: 0}, []
        todo = [origin]
        for states in todo:  # grows while it is read
            row = []
            for bs in members:
                reached = {to for s in states for chars, to in nfa.moves[s] if bs[0] in chars}
                nxt = nfa.closure(reached) | origin if search else nfa.closure(reached)
                if nxt and nxt not in number:
                    number[nxt] = len(number)
                    todo.append(nxt)
                row.append(number[nxt] if nxt else -1)
            rows.append(row)
        marks = [frozenset(last[s] for s in states if s in last) for states in todo]
        self._minimise(rows, marks)
        self.classes = bytes(classes)

    def _minimise(self, rows: list[list[int]], marks: list[frozenset]) -> None:
        """Splits the states by what they accept, then by where their moves lead, until nothing splits."""
        names: dict = {}
        block = [names.setdefault(m, len(names)) for m in marks]
        count = len(names)
        while True:
            names = {}
            block = [names.setdefault((block[i], *(block[to] if to >= 0 else -1 for to in row)), len(names)) for i, row in enumerate(rows)]
            if len(names) == count:
                break
            count = len(names)
        # plain states first: one comparison tells whether some rule ends
        order = sorted(range(count), key=lambda b: (bool(marks[block.index(b)]), b != block[0]))
        place = {b: i for i, b in enumerate(order)}
        example = [block.index(b) for b in order]
        self.start = place[block[0]] * self.width
        self.ends = [marks[e] for e in example]
        self.accepting = next((i for i, m in enumerate(self.ends) if m), count) * self.width
        self.step = [place[block[to]] * self.width if to >= 0 else -1 for e in example for to in rows[e]]


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = RULES) -> None:
        self.rules = rules
        trees = [Parser(r.pattern, r.fold).parse() for r in rules]
        self.all = DFA(trees, search=True)
        self.forward = [DFA([t], search=False) for t in trees]
        self.backward = [DFA([backwards(t)], search=False) for t in trees]

    @staticmethod
    def _longest(dfa: DFA, data: bytes, at: int, to: int, by: int) -> int:
        """The furthest position at which the automaton accepts, reading from ``at`` up to ``to``."""
        state, found, step, classes = dfa.start, at, dfa.step, dfa.classes
        while at != to:
            state = step[state + classes[data[at if by > 0 else at - 1]]]
            if state < 0:
                break
            at += by
            if state >= dfa.accepting:
                found = at
        return found

    def byte_spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(rule, start, end): leftmost-longest, non-overlapping for each rule."""
        dfa, out = self.all, []
        step, accepting, width, state = dfa.step, dfa.accepting, dfa.width, dfa.start
        passed = [0] * len(self.rules)
        for at, c in enumerate(data.translate(dfa.classes), 1):
            state = step[state + c]
            if state >= accepting:
                for k in dfa.ends[state // width]:
                    if at > passed[k]:
                        start = self._longest(self.backward[k], data, at, passed[k], -1)
                        if start == at:
                            continue
                        passed[k] = end = self._longest(self.forward[k], data, start, len(data), 1)
                        rule = self.rules[k]
                        if end - start >= rule.size and (not rule.least or self._run(data, start, end) >= rule.least):
                            out.append((k, start, end))
        return out

    @staticmethod
    def _run(data: bytes, start: int, end: int) -> int:
        """Length of the value after the keyword's delimiter (the first : or =), spaces and one opening quote."""
        m = data[start:end]
        at = min(i for i in (m.find(b":"), m.find(b"=")) if i >= 0) + 1
        rest = m[at:].lstrip(b" ")
        return len(rest) - (rest[:1] in (b'"', b"'"))

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        """(kind, start, end) in code points, by start and then in the rules' order."""
        data = text.encode("utf-8", "surrogatepass")
        found = self.byte_spans(data)
        if len(data) != len(text):
            edges, chars, before = {}, 0, 0
            for x in sorted({x for s in found for x in s[1:]}):
                chars += sum((b & 0xC0) != 0x80 for b in data[before:x]) if x - before < 64 else len(data[before:x].decode("utf-8", "surrogatepass"))
                edges[x] = chars
                before = x
            found = [(k, edges[s], edges[e]) for k, s, e in found]
        return [(self.rules[k].kind, s, e) for k, s, e in sorted(found, key=lambda x: (x[1], x[0]))]


_SCANNERS: dict[tuple, Scanner] = {}


def shared_scanner(df: DataFrame, rules: tuple[Rule, ...]):
    """The automata are compiled once, by the driver; their size depends on the rules alone."""
    if rules not in _SCANNERS:
        _SCANNERS[rules] = Scanner(rules)
    return df.sparkSession.sparkContext.broadcast(_SCANNERS[rules])


def find_secrets(df: DataFrame, rules: tuple[Rule, ...] = RULES, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, spans`` (array of ``kind, start, end``, code points, end exclusive) of every row, clean ones too."""
    shared = shared_scanner(df, rules)

    def make():
        scan = shared.value

        def step(row: dict) -> Iterator[tuple]:
            yield row["doc_id"], [{"kind": k, "start": s, "end": e} for k, s, e in scan.spans(row["text"])]

        return step

    kind = dict(df.dtypes)[id_col]
    return map_rows(pick(df, id_col, text_col), make, f"doc_id {kind}, spans array<struct<kind:string,start:int,end:int>>")


def secret_report(df: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts and digests of the spans of every row."""
    base = [r.kind for r in rules if r.base]
    shared = shared_scanner(df, rules)

    def make():
        scan = shared.value

        def step(row: dict) -> Iterator[tuple]:
            spans = scan.spans(row["text"])
            show = [f"{k}:{s}:{e}" for k, s, e in spans]
            own = ",".join(x for x, (k, _, _) in zip(show, spans, strict=True) if k in base)
            yield row["doc_id"], *(sum(k == b for k, _, _ in spans) for b in base), hashlib.sha256(own.encode()).hexdigest(), ",".join(show)

        return step

    kind = dict(df.dtypes)["doc_id"]
    return map_rows(pick(df, "doc_id", "text"), make, f"doc_id {kind}, {', '.join(f'n_{b} long' for b in base)}, base_sha256 string, spans string")


def redact(df: DataFrame, rules: tuple[Rule, ...] = RULES, *, text_col: str = "text") -> DataFrame:
    """Same columns; in the text, every span (overlapping ones as one) becomes ``[SECRET]``. Null stays null."""
    columns = df.columns
    shared = shared_scanner(df, rules)

    def make():
        scan = shared.value

        def step(row: dict) -> Iterator[tuple]:
            text = row[text_col]
            if text:
                out, at = [], 0
                for _, s, e in scan.spans(text):
                    if s >= at:
                        out += [text[at:s], "[SECRET]"]
                    at = max(at, e)
                row[text_col] = "".join([*out, text[at:]])
            yield tuple(row[c] for c in columns)

        return step

    return map_rows(df, make, ", ".join(f"`{n}` {t}" for n, t in df.dtypes))
