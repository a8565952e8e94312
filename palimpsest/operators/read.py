"""Bitemporal reads over a record set: as-of, history, timeline, query and keyset pages."""

from __future__ import annotations

import base64
import json
import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import interval
from ..functions.errors import HistoryError

ORDER = ["tx_from", "valid_from", "id"]
RANGE = "_range"


def record_id() -> Column:
    """A record's name: its origin write, where on both axes it begins, and a mark of its entity. The same
    however the writes were cut into batches, so order and cursors do not depend on that."""
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp")).cast("string")
    return F.concat(F.lpad(F.col("k").cast("string"), 12, "0"), F.lit("-"), micros("tx_from"), F.lit("-"), F.coalesce(micros("valid_from"), F.lit("min")), F.lit("-"), F.substring(F.sha2(F.concat("kind", F.lit("\x1f"), "entity_id"), 256), 1, 10))


def with_ids(records: DataFrame) -> DataFrame:
    return records.withColumn("id", record_id())


@dataclass
class Query:
    """A conjunction of filters; what is None restricts nothing."""

    kind: str | None = None
    entity_id: str | None = None
    actor: str | None = None
    intent: int | None = None
    current_only: bool = False
    valid: tuple | None = None  # (from, to), either end may be None
    tx: tuple | None = None
    valid_at: object = None
    tx_at: object = None
    limit: int = 0
    descending: bool = False
    after: str | None = None

    def validate(self) -> None:
        for span in (self.valid, self.tx):
            if span and None not in span and not span[0] < span[1]:
                raise HistoryError("invalid_interval")
        if self.intent is not None and self.intent not in (0, 1, 2):
            raise HistoryError("unknown_intent")

    def predicate(self) -> Column:
        self.validate()
        out = F.lit(True)
        for name, value in (("kind", self.kind), ("entity_id", self.entity_id), ("actor", self.actor), ("intent", self.intent)):
            if value not in (None, ""):
                out = out & (F.col(name) == value)
        if self.current_only:
            out = out & F.col("tx_to").isNull()
        for span, (a, b) in ((self.valid, ("valid_from", "valid_to")), (self.tx, ("tx_from", "tx_to"))):
            if span and span != (None, None):
                for mine, other, less in ((a, span[1], True), (b, span[0], False)):
                    if other is not None:
                        hit = F.col(mine) < F.lit(other) if less else F.col(mine) > F.lit(other)
                        out = out & (F.col(mine).isNull() | hit)
        if self.valid_at is not None:
            out = out & interval.contains("valid_from", "valid_to", F.lit(self.valid_at))
        if self.tx_at is not None:
            out = out & interval.contains("tx_from", "tx_to", F.lit(self.tx_at))
        return out


def _directed(descending: bool) -> list[Column]:
    return [F.desc(c) if descending else F.asc(c) for c in ORDER]


def ordered(records: DataFrame, descending: bool = False) -> DataFrame:
    return records.orderBy(*_directed(descending))


def query(records: DataFrame, q: Query) -> DataFrame:
    """The records that pass, in the total order; one page of them if a limit is set."""
    out = records.where(q.predicate())
    if q.after:
        out = out.where(beyond(decode_cursor(q.after), q.descending))
    out = ordered(out, q.descending)
    return out.limit(q.limit) if q.limit > 0 else out


def page(records: DataFrame, q: Query) -> tuple[list, str | None]:
    """One page and the cursor of the next; no cursor exactly if nothing was withheld."""
    if q.limit <= 0:
        return query(records, q).collect(), None
    rows = query(records, Query(**{**q.__dict__, "limit": q.limit + 1})).collect()
    more = len(rows) > q.limit
    rows = rows[: q.limit]
    return rows, encode_cursor(rows[-1]) if more else None


def in_ranges(records: DataFrame) -> DataFrame:
    """The records dealt out and sorted by the total order, with the number of their range. To be stored before it
    is read: the cuts come from samples, and a second run may cut elsewhere."""
    return records.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).withColumn(RANGE, F.spark_partition_id())


def page_end(ranged: DataFrame, q: Query) -> str | None:
    """The cursor that ``page`` gives along with its rows, for pages too large to gather: what is left is counted
    by range, and the page's last row alone comes to the driver."""
    if q.limit <= 0:
        return None
    rest = ranged.where(q.predicate())
    if q.after:
        rest = rest.where(beyond(decode_cursor(q.after), q.descending))
    counts = sorted(((r[0], r[1]) for r in rest.groupBy(RANGE).count().collect()), reverse=q.descending)
    if sum(n for _, n in counts) <= q.limit:
        return None
    left = q.limit
    for at, n in counts:
        if left <= n:
            break
        left -= n
    place = F.row_number().over(Window.partitionBy(RANGE).orderBy(*_directed(q.descending)))
    return encode_cursor(rest.where(F.col(RANGE) == at).withColumn("_n", place).where(F.col("_n") == left).select(*ORDER).first())


def walk(ranged: DataFrame, q: Query) -> DataFrame:
    """A walk to its end, each page resumed at the cursor of the one before: the records with the page they come on
    and their place in the walk, both from 0. Rows stay where they are; the driver holds one cursor a page."""
    ends, after = [], q.after
    while after := page_end(ranged, Query(**{**q.__dict__, "after": after})):
        ends.append(after)
    rows = ranged.where(q.predicate())
    if q.after:
        rows = rows.where(beyond(decode_cursor(q.after), q.descending))
    passed = [beyond(decode_cursor(c), q.descending).cast("int") for c in ends]
    rows = rows.withColumn("page", sum(passed, F.lit(0)))
    key, side = ["page", RANGE], F.desc(RANGE) if q.descending else F.asc(RANGE)
    earlier = Window.partitionBy("page").orderBy(side).rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_rows")).select(*key, F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_start"))
    n = F.row_number().over(Window.partitionBy(*key).orderBy(*_directed(q.descending))) - 1
    placed = rows.withColumn("_n", n).join(F.broadcast(starts), key)
    return placed.withColumn("place", F.col("page").cast("long") * q.limit + F.col("_start") + F.col("_n")).drop("_n", "_start", RANGE)


def beyond(key: tuple, descending: bool) -> Column:
    """Strictly after a position. The conjunct on tx_from alone is implied; it lets scans skip row groups."""
    tx, valid, rid = key
    v = F.col("valid_from")
    if descending:
        at_valid = (v.isNotNull() & (F.lit(valid) > v)) | v.isNull() if valid is not None else F.lit(False)
        tie = v.eqNullSafe(F.lit(valid)) & (F.col("id") < rid)
        at_valid = (at_valid & ~v.eqNullSafe(F.lit(valid))) | tie
        return (F.col("tx_from") <= F.lit(tx)) & ((F.col("tx_from") < F.lit(tx)) | at_valid)
    at_valid = v.isNotNull() if valid is None else v > F.lit(valid)
    tie = v.eqNullSafe(F.lit(valid)) & (F.col("id") > rid)
    return (F.col("tx_from") >= F.lit(tx)) & ((F.col("tx_from") > F.lit(tx)) | F.coalesce(at_valid, F.lit(False)) | tie)


def encode_cursor(row) -> str:
    body = json.dumps(["p1", row["tx_from"].isoformat(), row["valid_from"].isoformat() if row["valid_from"] else "", row["id"]]).encode()
    return base64.urlsafe_b64encode(zlib.crc32(body).to_bytes(4, "big") + body).decode().rstrip("=")


def decode_cursor(token: str) -> tuple:
    from datetime import datetime

    try:
        raw = base64.urlsafe_b64decode(token + "=" * (-len(token) % 4))
        version, tx, valid, rid = json.loads(raw[4:])
        if zlib.crc32(raw[4:]).to_bytes(4, "big") != raw[:4] or version != "p1":
            raise ValueError("checksum or version")
        return datetime.fromisoformat(tx), datetime.fromisoformat(valid) if valid else None, rid
    except (ValueError, TypeError) as e:
        raise HistoryError("invalid_cursor", str(e)) from None


def now(records: DataFrame, clock: Column) -> Column:
    """The later of the clock and the last write, as one row's value."""
    return F.greatest(clock, F.max("tx_from"))


def get(records: DataFrame, probes: DataFrame) -> DataFrame:
    """probes(kind, entity_id, valid_at, tx_at) with the record that holds there, if any.

    An equi-join on the entity with both containments as its residual; on a sound record set
    at most one record matches, and on any other the first in the total order is taken.
    """
    hit = interval.contains("valid_from", "valid_to", "valid_at") & interval.contains("tx_from", "tx_to", "tx_at")
    both = probes.join(records, ["kind", "entity_id"]).where(hit)
    first = F.row_number().over(Window.partitionBy("kind", "entity_id", "valid_at", "tx_at").orderBy(*[c for c in ORDER if c in records.columns]))
    return both.withColumn("_n", first).where("_n = 1").drop("_n")


def timeline(records: DataFrame, tx_at) -> DataFrame:
    """The tiling of valid time as believed at one instant, with each tile's place."""
    n = F.row_number().over(Window.partitionBy("kind", "entity_id").orderBy("valid_from", "tx_from"))
    return records.where(interval.contains("tx_from", "tx_to", tx_at)).withColumn("position", n)


def history(records: DataFrame, kind: str, entity_id: str, **filters) -> DataFrame:
    """An entity's records; an unknown entity gives none."""
    return query(records, Query(**{**filters, "kind": kind, "entity_id": entity_id}))
