"""Exact byte-pair encoding by backtracking over Aho-Corasick matches.

A sequence of tokens is the encoding of its text exactly if each neighbouring pair
is *compatible*: no merge crosses their border before both tokens are complete. So a
word is encoded by taking the longest vocabulary entry at each position (found for all
positions in one automaton pass), testing it against its predecessor in a memoised
pair-compatibility table, and falling back to the next shorter entry, or to the
predecessor's, where it fails. A position that has failed is marked and never tried
again, which keeps the work linear. Decoding reads byte ranges out of one string
through an offset table.

Null texts count as empty: no tokens, and the digests of the empty string. Each row has a
result of its own, also repeated ones and those without an id; an empty table gives an empty
result. Only the id and the text are read, so other columns can't clash.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import struct
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import regex
from pyspark.sql import DataFrame

from .rows import Memo, map_rows, pick, release_loaded

# The byte alphabet of byte-level BPE prints these bytes as themselves, the others from U+0100 on.
PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
# What the library's tables say of characters that Unicode 15.1 (Python's tables) lacks: ranges of letters
# and of numbers, and of capitals with the distance to their small letters.
NEWER_LETTERS = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5),
    (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
]
NEWER_NUMBERS = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]
NEWER_CAPITALS = [
    (0x1C89, 0x1C89, 1), (0xA7CB, 0xA7CB, 0x264 - 0xA7CB), (0xA7CC, 0xA7CC, 1), (0xA7CE, 0xA7CE, 1), (0xA7D2, 0xA7D2, 1), (0xA7D4, 0xA7D4, 1),
    (0xA7DA, 0xA7DA, 1), (0xA7DC, 0xA7DC, 0x19B - 0xA7DC), (0x10D50, 0x10D65, 0x20), (0x16EA0, 0x16EB8, 0x1B),
]

# Marks that the library's normalisation does not know (it leaves them where they stand), and a vowel sign that it joins to nothing.
NEWER_MARKS = [
    (0x7FD, 0x7FD), (0x898, 0x89F), (0x8CA, 0x8D3), (0x9FE, 0x9FE), (0xC3C, 0xC3C), (0xD3B, 0xD3C), (0xEBA, 0xEBA), (0x1715, 0x1715), (0x1ABF, 0x1ACE), (0x1DF6, 0x1DFA),
    (0xA82C, 0xA82C), (0x10D24, 0x10D27), (0x10EAB, 0x10EAC), (0x10EFD, 0x10EFF), (0x10F46, 0x10F50), (0x10F82, 0x10F85), (0x11070, 0x11070), (0x1133B, 0x1133B), (0x1145E, 0x1145E),
    (0x11839, 0x1183A), (0x11930, 0x11930), (0x1193D, 0x1193E), (0x11943, 0x11943), (0x119E0, 0x119E0), (0x11A34, 0x11A34), (0x11A47, 0x11A47), (0x11A99, 0x11A99), (0x11D42, 0x11D42),
    (0x11D44, 0x11D45), (0x11D97, 0x11D97), (0x11F41, 0x11F42), (0x16FF0, 0x16FF1), (0x1E08F, 0x1E08F), (0x1E130, 0x1E136), (0x1E2AE, 0x1E2AE), (0x1E2EC, 0x1E2EF), (0x1E4EC, 0x1E4EF),
]


def byte_alphabet() -> dict[str, int]:
    letters = {chr(b): b for b in PRINTED}
    hidden = [b for b in range(256) if b not in set(PRINTED)]
    return letters | {chr(0x100 + i): b for i, b in enumerate(hidden)}


def newer_characters() -> tuple[dict[int, str], dict[int, int]]:
    """The characters that the ``regex`` module knows and Python's tables lack: a stand-in of the class that the library gives
    them, which all tables know, and their small letters."""
    known_ones = regex.compile(r"\P{Cn}").findall
    stand_in: dict[int, str] = {}
    for at in range(0, 0x110000, 0x1000):  # a few at a time: workers live on, and so would the memory
        missing = "".join(c for c in map(chr, range(at, at + 0x1000)) if unicodedata.category(c) == "Cn")
        stand_in |= {ord(c): "\u0378" for c in known_ones(missing)}  # unassigned in all tables
    for ranges, known in ((NEWER_LETTERS, "\u4e00"), (NEWER_NUMBERS, "0")):
        stand_in |= {c: known for low, high in ranges for c in range(low, high + 1)}
    return stand_in, {c: c + d for low, high, d in NEWER_CAPITALS for c in range(low, high + 1)}


class BacktrackingBPE:
    """A tokenizer file of the ``tokenizers`` library: NFC, lower case, a split pattern, byte-level BPE with word ends.

    Words are strings over 512 symbols: bytes 0-255, and 256 + b for a byte b that ends its word.
    """

    def __init__(self, spec: bytes) -> None:
        spec = json.loads(spec)
        model, alphabet = spec["model"], byte_alphabet()
        end = model["end_of_word_suffix"] or ""
        self.specials = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        pattern = next(x["pattern"]["Regex"] for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        # \s of the library is the Unicode property; \s of Python also has U+001C to U+001F.
        self.finder = regex.compile(pattern.replace("\\s", "\\p{White_Space}"))
        self.stand_in, self.small = newer_characters()
        self.newer = frozenset(map(chr, self.stand_in))
        self.high = re.compile(f"[{min(*self.newer, chr(NEWER_MARKS[0][0]))}-\U0010ffff]").search
        self.marks = re.compile("([" + "".join(f"{chr(a)}-{chr(b)}" for a, b in NEWER_MARKS) + "])")

        def symbols(token: str) -> str:
            ends = bool(end) and token.endswith(end) and len(token) > len(end)
            raw = [alphabet[c] for c in (token[: -len(end)] if ends else token)]
            return "".join(map(chr, [*raw[:-1], raw[-1] + 256 * ends]))

        vocab: dict[str, int] = model["vocab"]
        size = max([*vocab.values(), *self.specials.values()]) + 1
        keys: dict[int, str] = {i: symbols(t) for t, i in vocab.items() if i not in self.specials.values()}
        self.length = [len(keys.get(i, "")) for i in range(size)]
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}  # pair of ids -> (rank, id of the merged token)
        self.parts: list[tuple[int, int] | None] = [None] * size
        self.made: list[int] = [-1] * size  # rank of the merge that makes a token; -1 for single symbols
        for at, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            a, b, ab = vocab[left], vocab[right], vocab[left + right]
            self.rank[a, b] = (at, ab)
            if self.parts[ab] is None:
                self.parts[ab], self.made[ab] = (a, b), at
            if max(self.made[a], self.made[b]) >= at:
                raise ValueError("a merge comes before the merges of its parts: not a trained BPE table")
        self._spines: dict[tuple[int, bool], list[int]] = {}
        reachable = set()
        for i in sorted(keys, key=lambda i: self.made[i]):
            p = self.parts[i]
            if p is None and self.length[i] == 1 or p and reachable.issuperset(p) and self._first_crossing(*p) == p:
                reachable.add(i)
        by_key = {keys[i]: i for i in reachable}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for key, i in by_key.items():
            self.automaton.add_word(key, i)
        self.automaton.make_automaton()
        self.shorter = [-1] * size
        for key, i in by_key.items():
            self.shorter[i] = next((by_key[key[:n]] for n in range(len(key) - 1, 0, -1) if key[:n] in by_key), -1)
        # some 60 MB a worker: with fewer entries, words and pairs that come again are worked out again
        self.compatible = Memo(lambda pair: self._first_crossing(*pair) is None, 300_000)
        self.cache = Memo(self._piece, 400_000)

        names = {i: t for t, i in vocab.items()} | {i: t for t, i in self.specials.items()}
        printed = [names.get(i, "").encode() for i in range(size)]
        self.blob = b"".join(printed)
        self.offsets = np.concatenate([[0], np.cumsum([len(x) for x in printed])]).astype(np.int64)

    def _spine(self, token: int, right: bool) -> list[int]:
        """The symbols that stand at the token's right (left) edge while it is built, first to last."""
        if (token, right) not in self._spines:
            chain = [token]
            while p := self.parts[chain[-1]]:
                chain.append(p[right])
            self._spines[token, right] = chain[::-1]
        return self._spines[token, right]

    def _first_crossing(self, a: int, b: int) -> tuple[int, int] | None:
        """The first pair across the border of ``a`` and ``b`` that merges, None if the two stay apart.

        Both sides grow in order of merge rank; on equal ranks the merge further left comes first.
        """
        left, right = self._spine(a, True), self._spine(b, False)
        i = j = 0
        never = 1 << 60
        while True:
            x, y = left[i], right[j]
            m = self.rank.get((x, y), (never, -1))[0]
            to_left = self.made[left[i + 1]] if i + 1 < len(left) else never
            to_right = self.made[right[j + 1]] if j + 1 < len(right) else never
            if m < to_left and m <= to_right:
                return x, y
            if to_left == to_right == never:
                return None
            if to_left <= to_right:
                i += 1
            else:
                j += 1

    def encode_symbols(self, word: str) -> list[int]:
        n, length, shorter, compatible = len(word), self.length, self.shorter, self.compatible
        longest = [-1] * n
        for end, token in self.automaton.iter(word):
            longest[end + 1 - length[token]] = token  # ends only grow, so the longest comes last
        out: list[int] = []
        failed = bytearray(n + 1)
        at, token = 0, longest[0]
        while at < n:
            end = at + length[token]
            if not failed[end] and (not out or compatible[out[-1], token]):
                out.append(token)
                at = end
                token = longest[at] if at < n else -1
            elif shorter[token] >= 0:
                token = shorter[token]
            else:
                failed[at] = 1
                token = out.pop()
                at -= length[token]
        return out

    def _piece(self, piece: str) -> bytes:
        word = piece.encode().decode("latin-1")
        ids = self.encode_symbols(word[:-1] + chr(ord(word[-1]) + 256))
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if any(x in text for x in self.specials) and (parts := self.special.split(text)):
            return b"".join(self.specials[x].to_bytes(4, "little") if k % 2 else self._plain(x) for k, x in enumerate(parts))
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        if text.isascii() or not self.high(text):
            text = unicodedata.normalize("NFC", text)
        else:  # newer marks are no marks to the library: nothing moves or joins across them
            text = "".join(part if k % 2 else unicodedata.normalize("NFC", part) for k, part in enumerate(self.marks.split(text)))
        if "Σ" in text:
            text = text.replace("Σ", "σ")  # lower case goes letter by letter: no final sigma
        text = text.lower()
        if text.isascii() or not self.high(text) or self.newer.isdisjoint(text):
            return b"".join(map(self.cache.__getitem__, self.finder.findall(text)))
        text = text.translate(self.small)
        return b"".join(self.cache[text[m.start() : m.end()]] for m in self.finder.finditer(text.translate(self.stand_in)))

    def decode(self, ids: bytes) -> bytes:
        """The printed tokens joined by spaces, in UTF-8; the offset table cuts each token out of the string once."""
        return b" ".join(map(self._printed.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    @functools.cached_property
    def _printed(self) -> list[bytes]:
        at = self.offsets.tolist()
        return [self.blob[a:b] for a, b in zip(at, at[1:], strict=False)]


_LOADED: dict[bytes, BacktrackingBPE] = {}


def loaded(spec: bytes) -> BacktrackingBPE:
    """One tokenizer per Python worker."""
    key = hashlib.sha256(spec).digest()
    if key not in _LOADED:
        _LOADED.clear()
        release_loaded(_LOADED)
        _LOADED[key] = BacktrackingBPE(spec)
    return _LOADED[key]


def encode_documents(df: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` and, if asked for, ``ids`` (array<int>) of every row.

    The tokenizer file (a few MB whatever the data's size) is read by the driver and
    broadcast. Rows are independent: no shuffle, and a lost task is simply run again.
    """
    with open(tokenizer_path, "rb") as f:
        spec = df.sparkSession.sparkContext.broadcast(f.read())

    def make():
        bpe = loaded(spec.value)

        def step(row: dict) -> Iterator[tuple]:
            ids = bpe.encode(row["text"])
            out = (row["doc_id"], len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield (*out, np.frombuffer(ids, "<u4").astype(np.int32)) if with_ids else out

        return step

    kind = dict(df.dtypes)[id_col]
    return map_rows(pick(df, id_col, text_col), make, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
