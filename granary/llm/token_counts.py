"""Edit-aware token counts: a segment tree of pre-tokens per document.

A text is cut into pre-tokens, whose token counts are independent of each other. Runs of
about ``leaf`` pre-tokens are the leaves of a tree that keeps the characters and tokens of
each subtree. An edit (start, end, new text) descends to the leaves it touches; these, with
context on both sides until the cutting has found the old borders again, are cut and encoded
anew, and the sums of their ancestors are updated. All other leaves stay as they are. A subtree
that edits have made deeper than twice the logarithm of its leaves is put together anew from
them, so a tree stays shallow however many edits hit one place.

Edits apply in order, each to the text that the ones before have left; positions beyond the
end are moved to the end, negative or null ones to the start. A null text counts as empty; null
edits do nothing. Each row has a result of its own, also repeated ones and those without an id;
an empty table gives an empty result. Only the three columns named are read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import Memo, map_rows

LEAF = 32


class Counter:
    """Token counts of pre-tokens of a ``.tiktoken`` vocabulary."""

    def __init__(self, vocabulary: bytes, pattern: str) -> None:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines()) if a}
        encoding = tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.cut = regex.compile(pattern).finditer
        self.count = Memo(lambda piece: len(encoding.encode_ordinary(piece)), 200_000)
        self.whole = encoding.encode_ordinary

    def pieces(self, text: str) -> list[str]:
        return [m[0] for m in self.cut(text)]


@dataclass
class Node:
    chars: int
    tokens: int
    left: Node | None = None
    right: Node | None = None
    pieces: list[str] | None = None  # of a leaf
    leaves: int = 1
    depth: int = 0


def joined(left: Node, right: Node) -> Node:
    return Node(left.chars + right.chars, left.tokens + right.tokens, left, right, None, left.leaves + right.leaves, 1 + max(left.depth, right.depth))


class Tree:
    def __init__(self, text: str, counter: Counter) -> None:
        self.counter, self.encoded = counter, 0
        self.root = self._build(counter.pieces(text))
        self.encoded = 0  # characters encoded anew since

    def _leaf(self, pieces: list[str]) -> Node:
        self.encoded += sum(map(len, pieces))
        return Node(sum(map(len, pieces)), sum(map(self.counter.count.__getitem__, pieces)), pieces=pieces)

    def _build(self, pieces: list[str]) -> Node:
        return self._join([self._leaf(pieces[i : i + LEAF]) for i in range(0, len(pieces), LEAF)] or [self._leaf([])])

    @staticmethod
    def _join(nodes: list[Node]) -> Node:
        while len(nodes) > 1:
            pairs = [nodes[i : i + 2] for i in range(0, len(nodes), 2)]
            nodes = [p[0] if len(p) == 1 else joined(*p) for p in pairs]
        return nodes[0]

    def _balanced(self, node: Node) -> Node:
        """The subtree, put together anew from its leaves if it is too deep for their number."""
        if node.depth <= 2 * node.leaves.bit_length() + 2:
            return node
        out: list[Node] = []
        stack = [node]
        while stack:
            at = stack.pop()
            if at.pieces is None:
                stack += at.right, at.left
            else:
                out.append(at)
        return self._join(out)

    def _leaves(self, node: Node, at: int, low: int, high: int, out: list[tuple[int, Node]]) -> None:
        """The leaves that overlap or touch [low, high], with their starts."""
        if at + node.chars < low or at > high:
            return
        if node.pieces is not None:
            out.append((at, node))
            return
        self._leaves(node.left, at, low, high, out)
        self._leaves(node.right, at + node.left.chars, low, high, out)

    def _replace(self, node: Node, at: int, low: int, high: int, new: list[Node]) -> Node | None:
        """The subtree without the leaves in [low, high) (whole leaves), ``new`` standing where they began."""
        if at >= high or at + node.chars <= low and not (node.chars == 0 and at == low):
            return node
        if low <= at and at + node.chars <= high:
            taken, new[:] = list(new), []
            return self._join(taken) if taken else None  # replaces whole leaves, so it is balanced
        left = self._replace(node.left, at, low, high, new)
        right = self._replace(node.right, at + node.left.chars, low, high, new)
        if left is None or right is None:
            return left or right
        return self._balanced(joined(left, right))

    def edit(self, start: int, end: int, text: str) -> None:
        size = self.root.chars
        start = min(max(start, 0), size)
        end = min(max(end, start), size)
        margin = 64
        while True:
            touched: list[tuple[int, Node]] = []
            self._leaves(self.root, 0, max(0, start - margin), min(size, end + margin), touched)
            low, high = touched[0][0], touched[-1][0] + touched[-1][1].chars
            old = [p for _, leaf in touched for p in leaf.pieces]
            span = "".join(old)
            new_span = span[: start - low] + text + span[end - low :]
            pieces = self.counter.pieces(new_span)
            if self._settled(old, pieces, start - low, len(span) - (end - low), low == 0, high == size):
                break
            margin *= 4
        new = [self._leaf(pieces[i : i + LEAF]) for i in range(0, len(pieces), LEAF)]
        if size == 0:
            self.root = self._join(new or [self._leaf([])])
        else:
            self.root = self._replace(self.root, 0, low, high, new) or self._leaf([])

    @staticmethod
    def _settled(old: list[str], new: list[str], before: int, after: int, first: bool, last: bool) -> bool:
        """Whether the new cutting agrees with the old one on at least two pre-tokens at each open end."""

        def agrees(a: list[str], b: list[str], room: int) -> bool:
            return len(a) > 2 and len(b) > 2 and a[:2] == b[:2] and sum(map(len, a[:2])) < room

        return (first or agrees(old, new, before)) and (last or agrees(old[::-1], new[::-1], after))

    @property
    def tokens(self) -> int:
        return self.root.tokens

    def text(self) -> str:
        out: list[tuple[int, Node]] = []
        self._leaves(self.root, 0, 0, self.root.chars, out)
        return "".join(p for _, leaf in out for p in leaf.pieces)


_LOADED: dict[tuple, Counter] = {}


def loaded(vocabulary: bytes, pattern: str) -> Counter:
    """One counter per Python worker."""
    key = (hashlib.sha256(vocabulary).digest(), pattern)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Counter(vocabulary, pattern)
    return _LOADED[key]


def count_with_edits(df: DataFrame, vocabulary_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", edits_col: str = "edits") -> DataFrame:
    """``doc_id, n_tokens, n_tokens_after, n_chars_after, chars_encoded`` of every row.

    ``edits_col``: array of structs ``start, end, text``. The vocabulary (under a MB) is broadcast.
    """
    with open(vocabulary_path, "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())

    def make():
        counter = loaded(shared.value, pattern)

        def step(row: dict) -> Iterator[tuple]:
            tree = Tree(row["text"] or "", counter)
            before = tree.tokens
            for e in row["edits"] or ():
                if e is not None:
                    tree.edit(e["start"] or 0, e["end"] or 0, e["text"] or "")
            yield row["doc_id"], before, tree.tokens, tree.root.chars, tree.encoded

        return step

    kind = dict(df.dtypes)[id_col]
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(edits_col).alias("edits"))
    return map_rows(rows, make, f"doc_id {kind}, n_tokens long, n_tokens_after long, n_chars_after long, chars_encoded long")
