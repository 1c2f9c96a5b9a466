"""WARC derivatives: metadata and plain-text conversion records for response records.

Each response gives two records that name it in ``WARC-Refers-To`` and keep its target,
date and digests: ``metadata`` (``application/warc-fields``: title, links, language and the
response's own headers) and ``conversion`` (``text/plain``). Record ids are version-5 UUIDs
of the source id and the kind, so that a task that runs again writes the same records.

A null payload counts as empty, with an empty conversion. A response without id or target is
kept; its derivatives then name none. Repeated responses give repeated derivatives. An empty
table gives an empty result; only the columns named are read, so others can't clash.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rows import map_rows

#: The format demands a date of every record.
NO_DATE = "1970-01-01T00:00:00Z"
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:warc:derivative")
# Elements whose content isn't text, and elements that stand on lines of their own.
HIDDEN = {"script", "style", "template", "noscript"}
BLOCKS = set("p div li ul ol h1 h2 h3 h4 h5 h6 tr table article section nav header footer blockquote pre title head body br hr".split())
NAME = re.compile(r"[a-zA-Z][^\s/<>]*")
STOP = re.compile(r"[\"'>]")
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
CLOSE = {n: re.compile(rf"</{n}\s*>", re.I) for n in (*HIDDEN, "title")}
LANGUAGE = re.compile(r"[A-Za-z-]+")
HEADER = "`id` string, `target_uri` string, `date` string, `http_headers` string, `payload` string"


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


class Page:
    """One pass over a page: its text without tags and hidden elements, title, language and links.

    Every search goes forward from where the last one ended, and a search that finds nothing is not
    made again, so the work is linear in the page, whatever is in it. Quotes in tags hide ``>`` until the first
    tag that would not end by them; from there on quotes are ordinary characters. A tag that is never
    closed is text; a hidden element or comment that is never closed hides the rest.
    """

    def __init__(self, page: str) -> None:
        self.page, self.quotes, self.lost = page, True, set()
        self.title, self.language = "", ""
        self.links: list[str] = []
        out, at = [], 0
        while (start := page.find("<", at)) >= 0:
            out.append(page[at:start])
            if page.startswith("<!--", start):
                stop = page.find("-->", start + 4)
                out.append(" ")
                at = len(page) if stop < 0 else stop + 3
                continue
            closing = page.startswith("/", start + 1)
            name = NAME.match(page, start + 1 + closing)
            other = page.startswith(("!", "?"), start + 1)
            end = self._end(start) if name or other else -1
            if end < 0:
                out.append("<")
                at = start + 1
                continue
            at = end + 1
            if not name:
                continue
            tag = name[0].lower()
            if not closing and tag in HIDDEN:
                out.append(" ")
                at = self._closed(tag, at)
                continue
            if tag in BLOCKS:
                out.append("\n")
            if closing:
                continue
            if tag in ("a", "html"):
                self._attributes(tag, name.end(), end)
            elif tag == "title" and not self.title and "title" not in self.lost:
                if stop := CLOSE["title"].search(page, at):
                    self.title = one_line(page[at : stop.start()])
                    out += html.unescape(page[at : stop.start()]), "\n"
                    at = stop.end()
                else:
                    self.lost.add("title")
        out.append(page[at:])
        lines = (" ".join(x.split()) for x in html.unescape("".join(out)).split("\n"))
        self.text = "\n".join(x for x in lines if x)

    def _end(self, start: int) -> int:
        """Where the tag at ``start`` ends, -1 if it doesn't."""
        if ">" in self.lost:
            return -1
        at = start
        while self.quotes and (m := STOP.search(self.page, at)):
            if m[0] == ">":
                return m.start()
            other = -1 if m[0] in self.lost else self.page.find(m[0], m.end())
            if other < 0:
                self.lost.add(m[0])
            at = other + 1 if other >= 0 else m.end()
        self.quotes = False
        end = self.page.find(">", start)
        if end < 0:
            self.lost.add(">")
        return end

    def _closed(self, tag: str, at: int) -> int:
        stop = CLOSE[tag].search(self.page, at)
        return stop.end() if stop else len(self.page)

    def _attributes(self, tag: str, start: int, end: int) -> None:
        found: dict[str, str] = {}
        for m in ATTRIBUTE.finditer(self.page, start, end):
            found.setdefault(m[1].lower(), next((x for x in m.groups()[1:] if x is not None), ""))
        if tag == "a" and "href" in found:
            self.links.append(html.unescape(found["href"]).strip())
        if tag == "html" and not self.language and (m := LANGUAGE.match(found.get("lang", "").strip())):
            self.language = m[0]


def one_line(text: str) -> str:
    return " ".join(html.unescape(text).split())


def header_fields(head: str) -> list[tuple[str, str]]:
    """Names and values, empty ones too; folded lines belong to the value before them, lines without a name are dropped."""
    out: list[tuple[str, str]] = []
    for line in re.split(r"\r\n|\n|\r", head):
        name, colon, value = line.partition(":")
        if line[:1] in (" ", "\t"):
            if out:
                out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip()}".strip())
        elif colon and name.strip():
            out.append((name.strip().lower(), value.strip()))
    return out


def derive(row: dict) -> list[dict]:
    """The metadata and the conversion record of a response (a dict with the fields of ``HEADER``)."""
    payload = row["payload"] or ""
    source, page = digest(payload.encode("utf-8", "replace")), Page(payload)
    fields = [(k, v) for k, v in (("title", page.title), ("languageOfPage", page.language)) if v]
    fields += [("outlink", x) for x in page.links if x]
    fields += [(f"source-{k}", v) for k, v in header_fields(row["http_headers"] or "")]
    blocks = {
        "metadata": ("application/warc-fields", "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in fields)),
        "conversion": ("text/plain; charset=utf-8", page.text),
    }
    out = []
    for kind, (content_type, block) in blocks.items():
        data = block.encode("utf-8", "replace")
        out.append({
            "record_type": kind,
            "record_id": f"<urn:uuid:{uuid.uuid5(NAMESPACE, kind + ' ' + (row['id'] or '') + ' ' + source)}>",
            "refers_to": row["id"], "refers_to_target_uri": row["target_uri"], "refers_to_date": row["date"],
            "content_type": content_type, "content_length": len(data), "block_digest": digest(data), "source_payload_digest": source, "block": block,
        })
    return out


def serialise(record: dict) -> bytes:
    """A derivative as the bytes of a WARC/1.1 record. Header values stay on one line; a record without a date has ``NO_DATE``."""
    names = (
        ("WARC-Type", "record_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Target-URI", "refers_to_target_uri"),
        ("WARC-Refers-To-Date", "refers_to_date"), ("WARC-Block-Digest", "block_digest"), ("WARC-Source-Payload-Digest", "source_payload_digest"), ("Content-Type", "content_type"), ("Content-Length", "content_length"),
    )
    values = [("WARC-Date", record["refers_to_date"] or NO_DATE), *((name, record[key]) for name, key in names if record[key] is not None)]
    head = "".join(f"{name}: {' '.join(str(value).split())}\r\n" for name, value in values)
    return f"WARC/1.1\r\n{head}\r\n".encode() + record["block"].encode("utf-8", "replace") + b"\r\n\r\n"


def derivatives(responses: DataFrame, *, key: Column | str = "key") -> DataFrame:
    """Two rows per response. ``key`` (long) is carried along; the other columns are those of ``HEADER``."""
    rows = responses.select((F.col(key) if isinstance(key, str) else key).cast("long").alias("key"), *(F.col(c).cast("string").alias(c) for c in ("id", "target_uri", "date", "http_headers", "payload")))
    names = ("record_type", "record_id", "refers_to", "refers_to_target_uri", "refers_to_date", "content_type", "content_length", "block_digest", "source_payload_digest", "block")

    def make():
        def step(row: dict) -> Iterator[tuple]:
            for r in derive(row):
                yield row["key"], *(r[n] for n in names)

        return step

    return map_rows(rows, make, "key long, " + ", ".join(f"{n} {'long' if n == 'content_length' else 'string'}" for n in names))


def responses(pages: DataFrame) -> DataFrame:
    """Response records of a table ``page_id, url, html``: ids from the page id, fixed date, headers from the body."""
    return pages.select(
        F.col("page_id").alias("key"),
        F.concat(F.lit("<urn:page:"), F.col("page_id").cast("string"), F.lit(">")).alias("id"),
        F.col("url").alias("target_uri"),
        F.lit("2024-01-01T00:00:00Z").alias("date"),
        F.concat(F.lit("Content-Type: text/html; charset=utf-8\r\nContent-Length: "), F.coalesce(F.octet_length("html"), F.lit(0)).cast("string")).alias("http_headers"),
        F.col("html").alias("payload"),
    )
