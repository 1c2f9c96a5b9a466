"""Text identity and hashing expressions."""

from __future__ import annotations

import json
import unicodedata

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..session import ship


def _exact(text: str | None) -> str | None:
    return None if text is None else " ".join(unicodedata.normalize("NFKC", text).split()).casefold()


@F.pandas_udf(StringType())
def _exact_udf(text: pd.Series) -> pd.Series:
    return text.map(_exact, na_action="ignore")


#: Texts of ASCII, Latin-1 letters and Cyrillic alone: NFKC changes none of them, and lower case folds all but ß.
SAFE = "^[\\t\\n\\r\\x20-\\x7EÀ-ÖØ-öø-ÿ\\u0400-\\u04FF]*\\z"


def normalize_text_exact(text: Column | str) -> Column:
    """NFKC, white space to single spaces, trimmed, case-folded, by Python's Unicode tables for every row."""
    ship(SparkSession.getActiveSession())
    return _exact_udf(F.col(text) if isinstance(text, str) else text)


def normalize_text(text: Column | str) -> Column:
    """The same. Safe texts (see ``SAFE``) stay in built-in expressions; only the others reach Python, which sees nulls for the rest."""
    c = F.col(text) if isinstance(text, str) else text
    safe = c.rlike(SAFE)
    plain = F.replace(F.lower(F.trim(F.regexp_replace(c, "\\s+", " "))), F.lit("ß"), F.lit("ss"))
    return F.when(safe, plain).otherwise(normalize_text_exact(F.when(~safe, c)))


def result_json(result: dict) -> str:
    """Sorted keys, spaced separators, letters as they are: the form whose lines a result hash digests."""
    return json.dumps(result, ensure_ascii=False, sort_keys=True)


@F.arrow_udf(StringType())
def _written_udf(score: pa.Array) -> pa.Array:
    return pa.array([None if v is None else f"{v:.10f}" for v in score.to_pylist()], pa.string())


def written_score(score: Column | str) -> Column:
    """Ten decimals of the exact value, ties to even; null for null. Spark's format_string rounds the shortest decimal of a double, which may lie on a tie where the value doesn't."""
    ship(SparkSession.getActiveSession())
    return _written_udf((F.col(score) if isinstance(score, str) else score).cast("double"))


def _digest(*parts: Column) -> Column:
    """Hex sha256 of the parts joined by NUL."""
    return F.sha2(F.concat_ws("\0", *parts), 256)


def text_identity(language: Column, normalized: Column) -> Column:
    return F.concat(F.lit("text_"), language, F.lit("_"), F.substring(_digest(language, normalized), 1, 20))


def deterministic_id(source: Column, record: Column) -> Column:
    return F.concat(source, F.lit("_"), F.substring(_digest(source, record), 1, 20))


def hash_u64(text: Column) -> Column:
    """The first 16 hex digits of the sha256, as an unsigned number."""
    return digest_u64(F.sha2(text, 256))


def digest_u64(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)")


def hash_fraction(text: Column) -> Column:
    """[0, 1): the first eight digest bytes over 2^64."""
    return digest_fraction(F.sha2(text, 256))


def digest_fraction(digest: Column) -> Column:
    """The same of a digest in hex."""
    return digest_u64(digest).cast("double") / F.lit(2.0**64)


def normalize_answer(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.replace(F.lower(text), F.lit("ё"), F.lit("е")), "(?U)\\s+", " "))


def sentence_form(text: Column) -> Column:
    """First letter upper case; a full stop unless the text ends in . ! ? or …"""
    head = F.regexp_extract(text, "^(\\P{L}*)(\\p{L}?)", 1)
    first = F.regexp_extract(text, "^(\\P{L}*)(\\p{L}?)", 2)
    rest = F.substr(text, F.length(head) + F.length(first) + 1)
    return F.concat(head, F.upper(first), rest, F.when(text.rlike("[.!?…]\\z"), "").otherwise("."))


def token_cap(chars: Column, per_char: float, reserve: int, least: int, most: int) -> Column:
    return F.least(F.lit(most), F.greatest(F.lit(least), (F.ceil(chars * per_char) + reserve).cast("int")))


def retry_seed(seed: Column, turn: Column, stride: int) -> Column:
    """(seed + turn * stride) modulo 2^64, in decimals: a long would overflow."""
    return F.pmod(seed.cast("decimal(30,0)") + turn.cast("decimal(30,0)") * stride, F.lit(str(2**64)).cast("decimal(30,0)")).cast("decimal(20,0)")


def contained_path(path: Column) -> Column:
    """Relative, without drive letters, and never above its root on the way."""
    depth = F.aggregate(
        F.split(path, "/"),
        F.struct(F.lit(0).alias("d"), F.lit(0).alias("low")),
        lambda a, p: F.struct(
            (a.d + F.when(p == "..", -1).when(p.isin("", "."), 0).otherwise(1)).alias("d"),
            F.least(a.low, a.d + F.when(p == "..", -1).when(p.isin("", "."), 0).otherwise(1)).alias("low"),
        ),
    )
    return ~path.startswith("/") & ~F.contains(path, F.lit(":\\")) & (depth.low >= 0)


# Private, loopback, reserved and other IPv4 ranges that aren't public (first address, last address).
PRIVATE_V4 = (
    ("0.0.0.0", "0.255.255.255"), ("10.0.0.0", "10.255.255.255"), ("127.0.0.0", "127.255.255.255"), ("169.254.0.0", "169.254.255.255"), ("172.16.0.0", "172.31.255.255"),
    ("192.0.0.0", "192.0.0.8"), ("192.0.0.11", "192.0.0.255"), ("192.0.2.0", "192.0.2.255"), ("192.168.0.0", "192.168.255.255"), ("198.18.0.0", "198.19.255.255"),
    ("198.51.100.0", "198.51.100.255"), ("203.0.113.0", "203.0.113.255"), ("240.0.0.0", "255.255.255.255"),
)


def _v4(address: str) -> int:
    return sum(int(x) << 8 * (3 - k) for k, x in enumerate(address.split(".")))


def public_endpoint(url: Column) -> Column:
    """https, and a host that isn't local: addresses are tested by range, names only against ``localhost``.

    IPv6 addresses are private if they are unspecified, loopback, unique local, link local, documentation, or map a private IPv4 address.
    """
    host = F.lower(F.regexp_replace(F.try_parse_url(url, F.lit("HOST")), "^\\[|\\]\\z", ""))
    mapped = F.regexp_extract(host, "^::ffff:(\\d+\\.\\d+\\.\\d+\\.\\d+)\\z", 1)
    v4 = F.when(mapped != "", mapped).otherwise(host)
    octet = "(25[0-5]|2[0-4]\\d|1\\d\\d|[1-9]?\\d)"
    is_v4 = v4.rlike(f"^{octet}(\\.{octet}){{3}}\\z")
    parts = F.split(v4, "\\.")
    number = sum((F.try_element_at(parts, F.lit(k + 1)).try_cast("long") * F.lit(1 << 8 * (3 - k)) for k in range(4)), F.lit(0).cast("long"))
    private_v4 = F.lit(False)
    for low, high in PRIVATE_V4:
        private_v4 = private_v4 | number.between(_v4(low), _v4(high))
    is_v6 = F.contains(host, F.lit(":"))
    private_v6 = host.rlike("^(::|::1|f[cd][0-9a-f]{2}:.*|fe[89ab][0-9a-f]:.*|2001:0?db8:.*|100::.*)\\z")
    local = F.when(is_v4, private_v4).when(is_v6, private_v6).otherwise(host.isin("localhost", "localhost.localdomain"))
    return F.coalesce((F.try_parse_url(url, F.lit("PROTOCOL")) == "https") & (host != "") & ~local, F.lit(False))
