"""JSON documents with their numbers kept as written: decoding, pointers, equality, diff."""

from __future__ import annotations

import json
import re
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from .errors import HistoryError



class _Absent:
    def __reduce__(self) -> str:
        return "ABSENT"  # one object in every process, as it is told by identity


ABSENT = _Absent()


class Number(str):
    """A number's own text. Equal numbers have equal keys: 2.5 and 2.50, 100 and 1e2, 0 and -0."""

    def key(self) -> tuple:
        sign, digits, exponent = Decimal(self).as_tuple()
        text = "".join(map(str, digits)).lstrip("0")
        short = text.rstrip("0")
        return (sign, short, exponent + len(text) - len(short)) if short else (0, "", 0)


def refuse(token: str):
    raise ValueError(f"{token} is not JSON")


def decode(data: str | bytes | None) -> dict:
    """A document. Null is an empty object; anything else that is no object is a codec error."""
    try:
        out = json.loads(data or "", parse_int=Number, parse_float=Number, parse_constant=refuse)
    except (ValueError, RecursionError) as e:
        raise HistoryError("codec", str(e)) from None
    if out is None:
        return {}
    if not isinstance(out, dict):
        raise HistoryError("codec", "the top level is no object")
    return out


def encode(value) -> str:
    """JSON text, keys sorted, numbers as they were written."""
    if isinstance(value, Number):
        return str.__str__(value)
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{encode(value[k])}" for k in sorted(value)) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(encode, value)) + "]"
    return json.dumps(value, ensure_ascii=False)


def same(a, b) -> bool:
    if isinstance(a, Number) or isinstance(b, Number):
        return isinstance(a, Number) and isinstance(b, Number) and a.key() == b.key()
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(same(a[k], b[k]) for k in a)
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(same, a, b))
    return type(a) is type(b) and a == b


def canonical(value) -> str:
    """Equal values have equal texts."""
    if isinstance(value, Number):
        sign, digits, exponent = value.key()
        return f"{'-' if sign else ''}{digits or 0}e{exponent}"
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k)}:{canonical(value[k])}" for k in sorted(value)) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    return json.dumps(value)


def escape(token: str) -> str:
    return token.replace("~", "~0").replace("/", "~1")


def escape_column(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def parse_pointer(path: str) -> list[str]:
    if path == "":
        return []
    if path[0] != "/" or re.search(r"~(?![01])", path):
        raise HistoryError("invalid_path", path)
    return [t.replace("~1", "/").replace("~0", "~") for t in path[1:].split("/")]


def value_at(doc, tokens: list[str]):
    """The value, or ABSENT; a null value is present."""
    for t in tokens:
        if isinstance(doc, dict):
            doc = doc.get(t, ABSENT)
        elif isinstance(doc, list) and re.fullmatch(r"0|[1-9][0-9]*", t) and int(t) < len(doc):
            doc = doc[int(t)]
        else:
            return ABSENT
        if doc is ABSENT:
            return ABSENT
    return doc


def diff(a, b, at: str = ""):
    """(path, op, old, new) in order: objects by key, arrays by position, a change of shape once."""
    if isinstance(a, dict) and isinstance(b, dict):
        both = [(escape(k), a.get(k, ABSENT), b.get(k, ABSENT)) for k in sorted(a.keys() | b.keys())]
    elif isinstance(a, list) and isinstance(b, list):
        n = max(len(a), len(b))
        both = [(str(i), a[i] if i < len(a) else ABSENT, b[i] if i < len(b) else ABSENT) for i in range(n)]
    else:
        if not same(a, b):
            yield at, "modified", a, b
        return
    for token, x, y in both:
        if x is ABSENT:
            yield f"{at}/{token}", "added", None, y
        elif y is ABSENT:
            yield f"{at}/{token}", "removed", x, None
        else:
            yield from diff(x, y, f"{at}/{token}")


class Codec:
    """How payloads are read: a subclass with its own ``decode`` to plain values reads another format."""

    def decode(self, data: str | bytes | None) -> dict:
        return decode(data)

    def changes(self, a: str | bytes | None, b: str | bytes | None) -> list[tuple]:
        """(path, op, old, new) between two payloads; None is a state that was not there."""
        both = diff({} if a is None else self.decode(a), {} if b is None else self.decode(b))
        return [(path, op, None if op == "added" else encode(old), None if op == "removed" else encode(new)) for path, op, old, new in both]
