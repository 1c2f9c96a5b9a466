"""License recognition by sentence rules.

A text is cut into sentences (once at line ends too, once with lines joined, for wrapped
headers). Each piece is normalised to its lower-case words; pieces that together are a known
licence sentence count as it, since the cut also falls inside some (at colons and blank
lines). The identifiers found, in text order, are matched against the ordered rules, longest
sequences first. A rule needs its sentences one after the other.

Texts without any anchor word of a known sentence hold none and are not cut. Sentences are
looked up whatever their length or white space. A null or empty text has no match. Each match
is one row, a text without a match has none; repeated rows match each on their own, a null id
is kept, and an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame

from .rows import map_rows, pick

# Known licence sentences and notices.
SENTENCES = {
    "cc-by-nc-4": "Licensed under CC BY-NC 4.0.",
    "cc-by-4": "Licensed under CC BY 4.0.",
    "cc-by-sa-4": "Licensed under CC BY-SA 4.0.",
    "cc-by-work": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-work": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-nc-work": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "apache-2": "Licensed under the Apache License, Version 2.0.",
    "apache-head": 'Licensed under the Apache License, Version 2.0 (the "License").',
    "apache-head-use": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    "apache-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache-as-is": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "apache-see": "See the License for the specific language governing permissions and limitations under the License.",
    "gpl-3": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-2-free": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "lgpl-free": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "agpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "lgpl-warranty": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl-details": "See the GNU General Public License for more details.",
    "lgpl-details": "See the GNU Lesser General Public License for more details.",
    "agpl-details": "See the GNU Affero General Public License for more details.",
    "mit": "Released under the MIT License.",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-as-is": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "mit-liable": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mpl-2": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "zlib-as-is": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "cc0": "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.",
}
# Rules in order of precedence (licence, rule, sentences that follow each other).
RULES = (
    ("MIT", "mit-full", ("mit-grant", "mit-notice", "mit-as-is", "mit-liable")),
    ("MIT", "mit-text", ("mit-grant", "mit-notice")),
    ("Apache-2.0", "apache-full", ("apache-head-use", "apache-copy", "apache-as-is", "apache-see")),
    ("GPL-3.0-or-later", "gpl-full", ("gpl-free", "gpl-warranty", "gpl-details")),
    ("GPL-2.0-or-later", "gpl-2-full", ("gpl-2-free", "gpl-warranty", "gpl-details")),
    ("LGPL-2.1-or-later", "lgpl-full", ("lgpl-free", "lgpl-warranty", "lgpl-details")),
    ("AGPL-3.0-or-later", "agpl-full", ("agpl-free", "gpl-warranty", "agpl-details")),
    ("BSD-3-Clause", "bsd-3-text", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")),
    ("BSD-2-Clause", "bsd-2-text", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("GPL-3.0-or-later", "gpl-header", ("gpl-free", "gpl-warranty")),
    ("GPL-2.0-or-later", "gpl-2-header", ("gpl-2-free", "gpl-warranty")),
    ("LGPL-2.1-or-later", "lgpl-header", ("lgpl-free", "lgpl-warranty")),
    ("AGPL-3.0-or-later", "agpl-header", ("agpl-free", "gpl-warranty")),
    ("Apache-2.0", "apache-header", ("apache-head-use", "apache-copy")),
    ("Zlib", "zlib-text", ("zlib-as-is", "zlib-grant")),
    ("MIT", "mit-grant", ("mit-grant",)),
    ("GPL-3.0-or-later", "gpl-free", ("gpl-free",)),
    ("GPL-2.0-or-later", "gpl-2-free", ("gpl-2-free",)),
    ("LGPL-2.1-or-later", "lgpl-free", ("lgpl-free",)),
    ("AGPL-3.0-or-later", "agpl-free", ("agpl-free",)),
    ("ISC", "isc-grant", ("isc-grant",)),
    ("MPL-2.0", "mpl-line", ("mpl-2",)),
    ("Unlicense", "unlicense-line", ("unlicense",)),
    ("Zlib", "zlib-grant", ("zlib-grant",)),
    ("CC0-1.0", "cc0-line", ("cc0",)),
    ("Apache-2.0", "apache-head-use", ("apache-head-use",)),
    ("Apache-2.0", "apache-head", ("apache-head",)),
    ("Apache-2.0", "apache-line", ("apache-2",)),
    ("GPL-3.0-only", "gpl-line", ("gpl-3",)),
    ("MIT", "mit-line", ("mit",)),
    ("CC-BY-NC-4.0", "cc-by-nc-line", ("cc-by-nc-4",)),
    ("CC-BY-SA-4.0", "cc-by-sa-line", ("cc-by-sa-4",)),
    ("CC-BY-4.0", "cc-by-line", ("cc-by-4",)),
    ("CC-BY-NC-4.0", "cc-by-nc-work", ("cc-by-nc-work",)),
    ("CC-BY-SA-4.0", "cc-by-sa-work", ("cc-by-sa-work",)),
    ("CC-BY-4.0", "cc-by-work", ("cc-by-work",)),
)
WORDS = re.compile(r"[^\W_]+")
TOKEN = re.compile(r"\S+")
#: How a text is cut: marks that end a sentence before white space, and line ends that end it too (2: a blank line).
CUTS = ((".!?:;", 1), (".!?:", 2))


def normalised(sentence: str) -> str:
    return " ".join(WORDS.findall(sentence.lower()))


def ends(token: str, marks: str) -> bool:
    """Whether a mark stands among the signs at the token's end."""
    for c in reversed(token):
        if c in marks:
            return True
        if c.isalnum() or c == "_":
            return False
    return False


class Recogniser:
    def __init__(self, sentences: dict[str, str], rules: tuple) -> None:
        self.known = {normalised(s): name for name, s in sentences.items()}
        # greedy cover: few long (so rare) anchor words, one of them in every known sentence
        rest, self.anchors = set(self.known), []
        while rest:
            words = {w for s in rest for w in s.split() if len(w) > 6} or {w for s in rest for w in s.split()}
            best = max(sorted(words), key=lambda w: (sum(w in s.split() for s in rest), len(w)))
            self.anchors.append(best)
            rest = {s for s in rest if best not in s.split()}
        self.by_first: dict[str, list[str]] = {}
        for s in self.known:
            self.by_first.setdefault(s.partition(" ")[0], []).append(s)
        self.rules = sorted(enumerate(rules), key=lambda r: (-len(r[1][2]), r[0]))

    def _pieces(self, text: str, marks: str, lines: int) -> list[tuple[str, int, int]]:
        """Normalised words, start and end of each piece with words; one pass over the text."""
        out, start, end = [], -1, 0
        for m in TOKEN.finditer(text):
            if start >= 0 and text.count("\n", end, m.start()) >= lines:
                out.append((start, end))
                start = -1
            start, end = m.start() if start < 0 else start, m.end()
            if ends(m[0], marks):
                out.append((start, end))
                start = -1
        out += [(start, end)] * (start >= 0)
        return [(words, a, b) for a, b in out if (words := normalised(text[a:b]))]

    def _sentences(self, pieces: list[tuple[str, int, int]]) -> list[dict[str, int]]:
        """For each piece, the known sentences that start there, with the piece after their last one."""
        out: list[dict[str, int]] = []
        for i, (words, _, _) in enumerate(pieces):
            out.append({})
            for s in self.by_first.get(words.partition(" ")[0], ()):
                got, k = words, i + 1
                while len(got) < len(s) and k < len(pieces) and s.startswith(got + " "):
                    got, k = f"{got} {pieces[k][0]}", k + 1
                if got == s:
                    out[i][self.known[s]] = k
        return out

    def matches(self, text: str) -> list[tuple[str, str, int, int]]:
        """(licence, rule, start, end), by start; code points, end exclusive."""
        lower = text.lower()
        if not any(a in lower for a in self.anchors):
            return []
        found: list[tuple[int, int, int, str, str]] = []
        for marks, lines in CUTS:
            pieces = self._pieces(text, marks, lines)
            starts = self._sentences(pieces)
            at = [i for i, names in enumerate(starts) if names]
            used: set[int] = set()
            for order, (licence, rule, wanted) in self.rules:
                for i in at:
                    k = i
                    for w in wanted:
                        k = starts[k].get(w, -1) if 0 <= k < len(starts) else -1
                    if k > 0 and used.isdisjoint(range(i, k)):
                        used |= set(range(i, k))
                        found.append((pieces[i][1], -pieces[k - 1][2], order, licence, rule))
        out: list[tuple[str, str, int, int]] = []
        for start, end, _, licence, rule in sorted(set(found)):
            if not out or start >= out[-1][3]:
                out.append((licence, rule, start, -end))
        return out


def find_licenses(df: DataFrame, sentences: dict[str, str] = SENTENCES, rules: tuple = RULES, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, license, rule, start, end`` for each match."""

    def make():
        recogniser = Recogniser(sentences, rules)

        def step(row: dict) -> Iterator[tuple]:
            for m in recogniser.matches(row["text"]):
                yield row["doc_id"], *m

        return step

    kind = dict(df.dtypes)[id_col]
    return map_rows(pick(df, id_col, text_col), make, f"doc_id {kind}, license string, rule string, start int, end int")
