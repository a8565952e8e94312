"""Scalar functions of the log: time texts, field checks, length prefixes, payload rendering."""

from __future__ import annotations

import json
import re
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

from .errors import HistoryError
from .jsonexact import refuse

RESERVED = "palimpsest:"  # metadata keys that begin so belong to the library
META_CHAIN, META_SUBJECT, META_CIPHER = RESERVED + "chain", RESERVED + "subject", RESERVED + "cipher"
_UNITS = {"ns": 0.001, "us": 1, "µs": 1, "μs": 1, "ms": 1000, "s": 10**6, "m": 60 * 10**6, "h": 3600 * 10**6}
_RFC3339 = r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)"


def rfc3339(c: Column) -> Column:
    """An instant as text in UTC, the fraction without trailing zeros; null stays null (omitted)."""
    text = F.regexp_replace(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"\.?0{1,6}$", "")
    return F.concat(text, F.lit("Z"))


def parse_rfc3339(text: str, field: str = "time") -> datetime:
    """A naive UTC instant in microseconds, cut and not rounded. The first instant of year 1 stands for
    an unbounded end elsewhere, so as a text it is a mistake; leave the field out instead."""
    if not re.fullmatch(_RFC3339, text):
        raise HistoryError("invalid_argument", f"{field} must be an RFC 3339 instant, not {text!r}")
    try:
        out = datetime.fromisoformat(re.sub(r"(\.\d{6})\d+", r"\1", text)).astimezone(timezone.utc).replace(tzinfo=None)
    except (ValueError, OverflowError) as e:
        raise HistoryError("invalid_argument", f"{field}: {e}") from None
    if out == datetime.min:
        raise HistoryError("invalid_argument", f"{field}: leave it out to mean unbounded or now")
    return out


def rfc3339_column(c: Column) -> Column:
    """Texts to instants; null for what ``parse_rfc3339`` refuses."""
    at = F.when(c.rlike(f"^{_RFC3339}$"), F.try_to_timestamp(c))
    return F.when(at != F.lit("0001-01-01T00:00:00Z").cast("timestamp"), at)


def utc(t: datetime | None) -> datetime | None:
    """An aware instant in UTC without its zone; a naive one is UTC already."""
    return t if t is None or t.tzinfo is None else t.astimezone(timezone.utc).replace(tzinfo=None)


def parse_duration(text: str) -> timedelta:
    """Signed sums of numbers with units, such as 8760h or 1h30m; 0 needs no unit."""
    sign, body = (-1, text[1:]) if text[:1] == "-" else (1, text.removeprefix("+"))
    parts = re.findall(r"(\d+\.?\d*|\.\d+)(ns|us|µs|μs|ms|s|m|h)", body)
    if body != "0" and (not parts or "".join(a + b for a, b in parts) != body):
        raise HistoryError("invalid_policy", f"{text!r} is no duration such as 8760h")
    return sign * timedelta(microseconds=sum(float(a) * _UNITS[b] for a, b in parts))


def has_nul(c: Column) -> Column:
    return F.coalesce(F.contains(c, F.lit("\0")), F.lit(False))


def has_reserved(meta: Column) -> Column:
    return F.coalesce(F.exists(F.map_keys(meta), lambda k: k.startswith(RESERVED)), F.lit(False))


def byte(n: Column) -> Column:
    return F.unhex(F.lpad(F.hex(n.cast("long")), 2, "0"))


def uvarint(n: Column, groups: int = 10) -> Column:
    """A number in groups of seven bits, the lowest first, the high bit set on all but the last. Ten groups hold
    any 64 bits, read as unsigned; five do for a length below 2^31."""
    n = n.cast("long")
    out = byte(F.shiftrightunsigned(n, 7 * groups - 7))
    for k in range(groups - 2, -1, -1):
        part = F.shiftrightunsigned(n, 7 * k)
        out = F.when(F.shiftrightunsigned(part, 7) == 0, byte(part)).otherwise(F.concat(byte(part.bitwiseAND(127).bitwiseOR(128)), out))
    return out


def prefixed(c: Column) -> Column:
    """Bytes with their length in front; null is empty."""
    data = F.coalesce(c.cast("binary"), F.lit(b"").cast("binary"))
    return F.concat(uvarint(F.octet_length(data), 5), data)


def _is_json(text: str | None) -> bool:
    try:
        json.loads(text or "", parse_constant=refuse)
        return True
    except (ValueError, RecursionError):
        return False


def rendered(data: Column) -> Column:
    """struct<json, base64>: the text of a payload that is a JSON document, else its bytes as base64.

    Whole documents only: Spark's own parser takes what follows one in silence, so Python looks."""
    text = F.when(F.is_valid_utf8(data.cast("string")), data.cast("string"))
    ok = F.udf(_is_json, "boolean", useArrow=True)(text)
    return F.struct(F.when(ok, text).alias("json"), F.when(~ok & (F.octet_length(data) > 0), F.base64(data)).alias("base64"))
