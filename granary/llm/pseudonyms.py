"""Format-preserving pseudonyms: a keyed Feistel permutation within each value's format.

Validated values (payment card numbers by their check digit, phone numbers, IPv4 addresses,
calendar dates, the local part of mail addresses) are numbered within their format's domain;
a keyed permutation of the domain gives the pseudonym, written in the same layout. So equal
values get equal pseudonyms in all documents, different ones stay different, and the key's
holder can invert them. The permutation is a Feistel network on a square that covers the
domain; results outside are permuted again until they fall inside.

A run of digit groups may hold more than one value: cards are sought in every window of its
groups, and a phone number ends where its country's length or its separators end it (where
both allow a following number too, it is taken in).

Text that fails validation is left as it is. Null texts stay null and have no values.
"""

from __future__ import annotations

import datetime
import hashlib
import math
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame

from .rows import map_rows, pick

ROUNDS = 8
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()
VALUE = re.compile(
    r"(?P<email>(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._+-]{0,63}(?=@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+))"
    r"|(?P<phone>(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,3}(?!\w))"
    r"|(?P<ip>(?<![\w.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![\w]|\.\d))"
    r"|(?P<date>(?<![\w.-])(?:\d{4}-\d{2}-\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4})(?![\w-]))"
    r"|(?P<card>(?<![\w+])\d(?:[ -]?\d){12,18}(?!\w))",
    re.ASCII,
)
GROUP = re.compile(r"\d+", re.ASCII)
RUN = re.compile(r"\d(?:[ -]?\d)*", re.ASCII)
#: Digit groups of cards as they are usually printed; a single group is another such layout.
CARD_LAYOUTS = {(4, 4, 4, 4), (4, 6, 5), (4, 6, 4)}
# Least and most national digits by country code; others have 7 to 12.
NATIONAL = {
    "1": (10, 10), "7": (10, 10), "20": (8, 10), "27": (9, 9), "30": (10, 10), "31": (9, 9), "32": (8, 9), "33": (9, 9), "34": (9, 9),
    "36": (8, 9), "40": (9, 9), "41": (9, 9), "44": (9, 10), "45": (8, 8), "46": (7, 10), "47": (8, 8), "48": (9, 9), "49": (7, 11),
    "52": (10, 11), "55": (10, 11), "61": (9, 9), "81": (9, 10), "82": (8, 10), "86": (10, 11), "90": (10, 10), "91": (10, 10),
    "351": (9, 9), "353": (7, 9), "380": (9, 9), "420": (9, 9), "421": (9, 9),
}
# Country codes of two digits; 1 and 7 have one digit, all others three.
TWO_DIGITS = set(
    "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
)
KINDS = ("card", "phone", "ip", "date", "email")


class Feistel:
    def __init__(self, key: bytes) -> None:
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _value(self, tweak: str, turn: int, x: int, most: int) -> int:
        size = (most.bit_length() + 71) // 8
        text = f"{tweak}:{turn}:{x}".encode()
        out = b"".join(hashlib.blake2b(text, key=self.key, salt=i.to_bytes(4, "big")).digest() for i in range(-(-size // 64)))
        return int.from_bytes(out[:size], "big") % most

    def permute(self, x: int, domain: int, tweak: str, inverse: bool = False) -> int:
        """A bijection of range(domain), chosen by the key and the tweak."""
        side = math.isqrt(domain - 1) + 1 if domain > 1 else 1
        tweak = f"{tweak}:{domain}"
        while True:
            left, right = divmod(x, side)
            for turn in range(ROUNDS):
                if inverse:
                    left, right = (right - self._value(tweak, ROUNDS - 1 - turn, left, side)) % side, left
                else:
                    left, right = right, (left + self._value(tweak, turn, right, side)) % side
            x = left * side + right
            if x < domain:
                return x


def check_digit(digits: str) -> int:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 else d * 2 - 9 * (d > 4)
    return -total % 10


def laid_out(like: str, digits: str) -> str:
    """The digits in the layout of ``like``."""
    rest = iter(digits)
    return "".join(next(rest) if c.isdigit() else c for c in like)


def valid_card(digits: str) -> bool:
    return 13 <= len(digits) <= 19 and check_digit(digits[:-1]) == int(digits[-1])


def cards(text: str, start: int) -> tuple[list[tuple[int, int]], int]:
    """The spans read as cards in the run of digit groups at ``start``, in text order, and the run's end.

    Every window of groups is tried. Of overlapping valid ones, usual layouts go first, then known
    first digits, then longer ones, then earlier ones.
    """
    end = RUN.match(text, start).end()
    groups = [m.span() for m in re.finditer(r"\d+", text[start:end])]
    if end < len(text) and re.match(r"\w", text[end], re.ASCII):
        groups.pop()
    found = []
    for i in range(len(groups)):
        digits = ""
        for k in range(i, len(groups)):
            digits += text[start + groups[k][0] : start + groups[k][1]]
            if len(digits) > 19:
                break
            if valid_card(digits):
                usual = k == i or tuple(b - a for a, b in groups[i : k + 1]) in CARD_LAYOUTS
                found.append((not usual, digits[0] not in "3456", -len(digits), i, k))
    taken: set[int] = set()
    out = []
    for *_, i, k in sorted(found):
        if taken.isdisjoint(range(i, k + 1)):
            taken |= set(range(i, k + 1))
            out.append((start + groups[i][0], start + groups[k][1]))
    return sorted(out), end


def country_code(digits: str) -> str:
    """The country code that an international number begins with, whatever its layout is."""
    return digits[: 1 if digits[:1] in ("1", "7") else 2 if digits[:2] in TWO_DIGITS else 3]


def phone_end(value: str) -> int:
    """Where the number ends in a match that may hold a following one too.

    The last group border with a length the country has; a space after a '-' or '.' ends a number that is
    long enough. Where no border fits, the whole match is one number.
    """
    groups = [m.span() for m in re.finditer(r"\d+", value)]
    digits = re.sub(r"\D", "", value)
    code = country_code(digits)
    least, most = NATIONAL.get(code, (7, 12))
    most += code != "1" and digits[len(code) :].startswith("0")  # with the trunk prefix
    end, before = None, " "
    for k, (a, b) in enumerate(groups):
        between = value[groups[k - 1][1] : a] if k else ""
        if end and between.isspace() and before in ("-", "."):
            break
        if least <= sum(map(str.isdigit, value[:b])) - len(code) <= most:
            end = b
        before = between
    return end or len(value)


class Pseudonyms:
    def __init__(self, key: bytes, inverse: bool = False) -> None:
        self.feistel, self.inverse = Feistel(key), inverse

    def _number(self, digits: str, kind: str) -> str:
        return str(self.feistel.permute(int(digits), 10 ** len(digits), f"{kind}{len(digits)}", self.inverse)).zfill(len(digits))

    def card(self, value: str) -> str | None:
        digits = re.sub(r"\D", "", value)
        if not valid_card(digits):
            return None
        body = self._number(digits[:-1], "card")
        return laid_out(value, body + str(check_digit(body)))

    def phone(self, value: str) -> str | None:
        """The country code stays, and so do leading zeros (a trunk prefix may be written or not); the other digits are permuted among the numbers of their length."""
        digits = re.sub(r"\D", "", value)
        code = country_code(digits)
        own = digits[len(code) :]
        if not 7 <= len(own) <= 12:
            return None
        zeros = own[: len(own) - len(own.lstrip("0"))]
        rest = own[len(zeros) :]
        if not rest:
            return None
        least = 10 ** (len(rest) - 1)
        x = self.feistel.permute(int(rest) - least, 9 * least, f"phone{code}", self.inverse)
        return laid_out(value, code + zeros + str(x + least))

    def ip(self, value: str) -> str | None:
        parts = value.split(".")
        if any(int(p) > 255 or len(p) > 1 and p[0] == "0" for p in parts):
            return None
        x = self.feistel.permute(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, "ip", self.inverse)
        return ".".join(map(str, x.to_bytes(4, "big")))

    def date(self, value: str) -> str | None:
        form = "%Y-%m-%d" if value[4] == "-" else "%d.%m.%Y" if value[2] == "." else "%m/%d/%Y"
        try:
            day = datetime.datetime.strptime(value, form).date().toordinal()
        except ValueError:
            return None
        if not FIRST_DAY <= day <= LAST_DAY:
            return None
        x = self.feistel.permute(day - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, "date", self.inverse)
        return datetime.date.fromordinal(x + FIRST_DAY).strftime(form)

    def email(self, value: str) -> str | None:
        """Letters stay letters of their case, digits stay digits, other characters stand."""
        x, domain = 0, 1
        sets = [(ord("0"), 10) if c.isdigit() else (ord("a"), 26) if c.islower() else (ord("A"), 26) if c.isupper() else None for c in value]
        for c, s in zip(value, sets, strict=True):
            if s:
                x, domain = x * s[1] + ord(c) - s[0], domain * s[1]
        if domain == 1:
            return None
        x = self.feistel.permute(x, domain, "email" + "".join("9" if s and s[1] == 10 else chr(s[0]) if s else c for c, s in zip(value, sets, strict=True)), self.inverse)
        out = []
        for c, s in zip(reversed(value), reversed(sets), strict=True):
            if s:
                x, d = divmod(x, s[1])
                c = chr(s[0] + d)
            out.append(c)
        return "".join(reversed(out))

    def replace(self, text: str) -> tuple[str, dict[str, int]]:
        counts = dict.fromkeys(KINDS, 0)

        out: list[str] = []
        done = at = run_end = 0  # copied up to, searched up to, digit runs read for cards up to
        spans: list[tuple[int, int]] = []  # cards to come, last one first
        while True:
            m = VALUE.search(text, at, spans[-1][0] if spans else len(text))
            if m is None and not spans:
                break
            if m is None:
                kind, (start, end) = "card", spans.pop()
            else:
                kind, (start, end) = m.lastgroup, m.span()
                if kind == "card":
                    if start >= run_end:
                        found, run_end = cards(text, start)
                        spans = found[::-1]
                        at = start
                    else:  # not of a card: other values can follow in it
                        at = GROUP.match(text, start).end()
                    continue
                if kind == "phone":
                    end = start + phone_end(m[0])
            new = getattr(self, kind)(text[start:end])
            if new is None and kind == "phone":  # a card can follow the country code
                end = start + re.match(r"\+\d+", m[0]).end()
            at = end
            if new is not None:
                counts[kind] += 1
                out += text[done:start], new
                done = end
        return "".join(out) + text[done:], counts


def pseudonymise(df: DataFrame, key: bytes, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text`` with pseudonyms, and how many values of each kind were replaced, for every row."""

    def make():
        names = Pseudonyms(key)

        def step(row: dict) -> Iterator[tuple]:
            text, counts = names.replace(row["text"] or "")
            yield row["doc_id"], None if row["text"] is None else text, *counts.values()

        return step

    kind = dict(df.dtypes)[id_col]
    return map_rows(pick(df, id_col, text_col, keep_null=True), make, f"doc_id {kind}, text string, {', '.join(f'n_{k} long' for k in KINDS)}")
