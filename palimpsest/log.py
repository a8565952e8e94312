"""A log of what was true when, and what was believed when: writes, reads and upkeep over one store.

Instants are naive and in UTC; aware ones are turned into it. Run the session in UTC.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from .functions.errors import HistoryError
from .functions.jsonexact import Codec, parse_pointer
from .functions.scalars import META_CIPHER, META_SUBJECT, utc
from .operators import compliance, fields, read, write
from .operators.merge import increment
from .operators.read import Query
from .sources.store import Store, instant

WRITES = (
    "kind string, entity_id string, data binary, valid_from timestamp_ntz, valid_to timestamp_ntz, "
    "actor struct<id:string,type:string,name:string>, reason string, meta map<string,string>, intent int, subject string, seq long"
)


@dataclass(frozen=True)
class As:
    """A point on both axes; an axis left out is now."""

    valid_at: datetime | None = None
    tx_at: datetime | None = None

    @staticmethod
    def now() -> As:
        return As()

    @staticmethod
    def valid(t: datetime) -> As:
        """What we now believe of the world at t."""
        return As(valid_at=t)

    @staticmethod
    def believed(t: datetime) -> As:
        """What we believed at t of the world as it is now."""
        return As(tx_at=t)

    @staticmethod
    def of(t: datetime) -> As:
        """What we believed at t of the world at t."""
        return As(t, t)

    def resolved(self, now: datetime) -> As:
        return As(utc(self.valid_at) or now, utc(self.tx_at) or now)


class Clock:
    """A clock that stands until it is told otherwise."""

    def __init__(self, at: datetime):
        self.at = at

    def __call__(self) -> datetime:
        return self.at

    def advance(self, by: timedelta) -> None:
        self.at += by

    def set(self, at: datetime) -> None:
        self.at = at


@dataclass
class Result:
    tx: datetime
    written: list[str]  # ids, the caller's record first, then what is left of each superseded one, left and right
    superseded: list[str]


@dataclass
class Delta:
    """The changes between two states, in order: rows of path, op, old and new."""

    changes: list[Row] = field(default_factory=list)

    def is_empty(self) -> bool:
        return not self.changes

    def paths(self) -> list[str]:
        return [c.path for c in self.changes]

    def change(self, path: str) -> Row | None:
        return next((c for c in self.changes if c.path == path), None)


@dataclass
class Report:
    now: datetime
    executed: bool
    kinds: DataFrame  # kind, examined, deleted, withheld, tombstones
    withheld: DataFrame  # id, hold_id


class Log:
    """kinds: those that may be written and asked for, any if None. chaining: link an entity's records by
    their hashes. keyring: where keys of subjects come from (``key``, ``destroy``, ``frame``). codec: how
    payloads are decoded for diffs and field histories."""

    def __init__(self, store: Store, clock: Callable[[], datetime] = instant, kinds: Iterable[str] | None = None, chaining: bool = False, keyring=None, codec: Codec | None = None):
        self.store, self.spark, self.clock = store, store.spark, clock
        self._held: DataFrame | None = None
        self.kinds, self.chaining, self.keyring, self.codec = None if kinds is None else sorted(kinds), chaining, keyring, codec or Codec()

    # Writing

    def put(self, kind: str, entity_id: str, data: bytes, valid_from: datetime | None, valid_to: datetime | None, actor: dict, **options) -> Result:
        """Assert that the entity was so over [valid_from, valid_to); None is unbounded. options: reason, meta, subject."""
        return self._one(0, kind, entity_id, data, valid_from, valid_to, actor, **options)

    def correct(self, kind: str, entity_id: str, data: bytes, valid_from: datetime | None, valid_to: datetime | None, actor: dict, **options) -> Result:
        """The same, of what was recorded wrongly."""
        return self._one(1, kind, entity_id, data, valid_from, valid_to, actor, **options)

    def _one(self, intent, kind, entity_id, data, valid_from, valid_to, actor, reason="", meta=None, subject=None) -> Result:
        who = tuple((actor or {}).get(c, "") for c in ("id", "type", "name"))
        row = (kind, entity_id, data if data is None else bytearray(data), utc(valid_from), utc(valid_to), who, reason, {k: v for k, v in (meta or {}).items() if k}, intent, subject, 0)
        if subject and self.keyring:
            self.keyring.key(subject)  # minted on first use; a destroyed one is refused here
        _, bad, made = self.write_many(self.spark.createDataFrame([row], WRITES))
        if bad.take(1):
            raise HistoryError(bad.first().error_code, f"{kind} {entity_id}")
        rows = made.collect()  # the records of one write
        new = sorted((r for r in rows if r.written), key=lambda r: (r.intent == 2, r.valid_from or datetime.min))
        return Result(new[0].tx_from, [r.id for r in new], [r.id for r in rows if not r.written])

    def write_many(self, writes: DataFrame) -> tuple[int, DataFrame, DataFrame]:
        """Write rows of WRITES (``subject`` may be missing), in the order of seq within an entity. Returns the
        log's version; the rows that break a rule, with error_code, which change nothing; and the records
        written and superseded (id, tx_from, valid_from, intent, written). Keys of subjects must exist."""
        if "subject" not in writes.columns:
            writes = writes.withColumn("subject", F.lit(None).cast("string"))
        writes = writes.withColumn("subject", F.nullif("subject", F.lit("")))
        keys = self.keyring.frame().select("subject", "key") if self.keyring else self.spark.createDataFrame([], "subject string, key binary")
        seen = writes.join(keys, "subject", "left").withColumn("error_code", write.error_code(self.kinds, self.keyring is not None, subject=True)).persist()
        bad, ok = seen.where("error_code is not null").drop("key"), seen.where("error_code is null").drop("error_code")
        # Ciphertexts are drawn once and kept: what is hashed is what is written, whatever is run again.
        sealed = compliance.sealed(ok.where("subject is not null"))
        sealed = self.store.keep(sealed, "sealed") if self.keyring else sealed
        ok = sealed.unionByName(compliance.sealed(ok.where("subject is null"))).drop("key", "subject")
        batch, touched, out = uuid.uuid4().hex, ok.select("kind", "entity_id").distinct(), {}
        clock = int((utc(self.clock()) - datetime(1970, 1, 1)) / timedelta(microseconds=1))

        def plan(current: DataFrame | None):
            numbered, base = ok, 0
            newest = None
            if current is not None:
                top = current.agg(F.max("k")).first()[0]
                base = -1 if top is None else top
                newest = current.groupBy("kind", "entity_id").agg(F.unix_micros(F.max("tx_from").cast("timestamp")).alias("tx_us"))
            made = numbered.withColumn("k", F.lit(base + 1) + F.col("seq")).withColumn("clock_us", F.lit(clock))
            made = write.instants(made, newest).drop("clock_us", "seq")
            bare = None if current is None else current.drop("token") if "token" in current.columns else current
            insert, close = increment(bare, made)
            if self.chaining:
                tails = self.store.chain_tails(touched)
                insert = compliance.stamp(insert, tails)
            elif current is not None and "token" in current.columns:
                insert = insert.withColumn("token", F.lit(None).cast("string"))
            if self._held is not None:
                self._held.unpersist()
            self._held = insert = insert.persist()  # for the caller's answer; freed by the next write
            out.update(insert=insert, close=close)
            return insert, close

        if ok.isEmpty():
            return self.store.manifest()["version"], bad, self.spark.createDataFrame([], "id string, tx_from timestamp_ntz, valid_from timestamp_ntz, intent int, written boolean")
        version = self.store.apply(plan, batch=batch, entities=touched)
        made = out["insert"].select("id", "tx_from", "valid_from", "intent", F.lit(True).alias("written"))
        if out["close"] is not None:
            nothing = [F.lit(None).cast(t).alias(c) for c, t in (("tx_from", "timestamp_ntz"), ("valid_from", "timestamp_ntz"), ("intent", "int"))]
            made = made.unionByName(out["close"].select("id", *nothing, F.lit(False).alias("written")))
        return version, bad, made

    # Reading

    def now(self) -> datetime:
        """The later of the clock and the last write."""
        log = self.store.read()
        last = None if log is None else log.agg(F.max("tx_from")).first()[0]
        return max(filter(None, (utc(self.clock()), last)))

    def _kind(self, kind: str) -> None:
        if not kind or self.kinds is not None and kind not in self.kinds:
            raise HistoryError("unknown_kind", kind)

    def _records(self) -> DataFrame:
        log = self.store.read()
        if log is not None:
            return log
        return self.spark.createDataFrame([], f"id string, {WRITES.split(', subject')[0]}, k long, tx_from timestamp_ntz, tx_to timestamp_ntz")

    def get(self, kind: str, entity_id: str, at: As = As()) -> Row:
        """The one record in force at a point, decrypted; not_found if there is none."""
        self._kind(kind)
        if not entity_id:
            raise HistoryError("missing_entity_id")
        at = at.resolved(self.now())
        rows = read.query(self._records(), Query(kind=kind, entity_id=entity_id, valid_at=at.valid_at, tx_at=at.tx_at, limit=1))
        for r in self.decrypt(rows).collect():
            compliance.refuse(r.status)
            return r
        raise HistoryError("not_found", f"{kind} {entity_id} at valid {at.valid_at}, tx {at.tx_at}")

    def history(self, kind: str, entity_id: str, **filters) -> DataFrame:
        """An entity's records as stored; filters are those of Query. An unknown entity has none."""
        self._kind(kind)
        if not entity_id:
            raise HistoryError("missing_entity_id")
        return read.history(self._records(), kind, entity_id, **filters)

    def timeline(self, kind: str, entity_id: str, at: As = As()) -> DataFrame:
        """The tiling of valid time as believed at at.tx_at; its valid_at plays no part."""
        tx = at.resolved(self.now()).tx_at
        return read.timeline(self.history(kind, entity_id, tx_at=tx), F.lit(tx).cast("timestamp_ntz")).orderBy("position")

    def query(self, q: Query) -> tuple[list[Row], str | None]:
        """A page of records as stored and the cursor of the next, if any is left. With no limit every
        match comes to the driver; use ``frame`` for answers that are large."""
        return read.page(self.frame(), self._asked(q))

    def _asked(self, q: Query) -> Query:
        if q.kind:
            self._kind(q.kind)
        return q

    def frame(self, q: Query | None = None) -> DataFrame:
        """The records of a query, all of them, as a DataFrame."""
        return self._records() if q is None else read.query(self._records(), self._asked(q))

    def diff(self, kind: str, entity_id: str, a: As, b: As) -> Delta:
        """What changed between two points; an entity missing at one is all added or all removed, at both not found."""
        now = self.now()
        out = []
        for at in (a.resolved(now), b.resolved(now)):
            try:
                out.append(bytes(self.get(kind, entity_id, at).data))
            except HistoryError as e:
                if e.code != "not_found":
                    raise
                out.append(None)
        if out == [None, None]:
            raise HistoryError("not_found", f"{kind} {entity_id} at valid {a.valid_at}, tx {a.tx_at}")
        return Delta([Row(path=p, op=op, old=x, new=y) for p, op, x, y in self.codec.changes(*out)])

    def field_history(self, kind: str, entity_id: str, path: str, at: As = As(), descending: bool = False) -> DataFrame:
        """Every change of one path at a valid instant; at.tx_at plays no part. A record that cannot be read is an error."""
        parse_pointer(path)
        rows = self.decrypt(self.history(kind, entity_id, valid_at=at.resolved(self.now()).valid_at))
        for r in rows.select("status").distinct().collect():  # five at most
            compliance.refuse(r.status)
        return fields.field_history(rows.drop("status"), path, None, descending, codec=self.codec).orderBy("position")

    def decrypt(self, records: DataFrame) -> DataFrame:
        """records with their payloads opened, and status: plain, open, shredded, no_keyring, codec or unknown_cipher."""
        return compliance.opened(records, self.keyring.frame() if self.keyring else None)

    # Upkeep

    def verify(self, kind: str, entity_id: str) -> Row:
        """One row of ``compliance.verify``; no_chain if the entity was never chained."""
        e = self.store.entries()
        if e is not None and "token" in e.columns:
            for r in compliance.verify(e.where((F.col("kind") == kind) & (F.col("entity_id") == entity_id))).collect():
                if r.status != "no_chain":
                    return r
        raise HistoryError("no_chain", f"{kind} {entity_id}")

    def chain_head(self, kind: str, entity_id: str) -> bytes:
        """The hash at the end of an entity's chain, not verified."""
        e = self.store.entries()
        if e is not None and "token" in e.columns:
            for r in compliance.chain_head(e.where((F.col("kind") == kind) & (F.col("entity_id") == entity_id))).where("head is not null").collect():
                return bytes.fromhex(r.head.removeprefix(compliance.TOKEN))
        raise HistoryError("no_chain", f"{kind} {entity_id}")

    def plan_retention(self, policies: list[tuple[str, timedelta]], now: datetime | None = None) -> Report:
        """What a sweep would do; nothing is written."""
        return self._sweep(policies, now, False)[0]

    def execute_retention(self, policies: list[tuple[str, timedelta]], now: datetime | None = None, archive: Callable[[DataFrame], None] | None = None) -> Report:
        """Destroy what no policy keeps and no hold withholds. ``archive`` gets the doomed records first, all of one
        kind at a time, and must bear being given them again: if it or the deletion of a kind fails,
        earlier kinds are gone and that one is not."""
        report, doomed = self._sweep(policies, now, True)
        for kind, _ in policies:
            ids = doomed.where(F.col("kind") == kind).select("id")
            if ids.isEmpty():
                continue
            if archive is not None:
                archive(self._records().join(ids, "id", "left_semi"))
            self.store.delete(ids)
        return report

    def _sweep(self, policies, now, executed):
        table = compliance.policy_table(self.spark, policies)
        now = utc(now) or utc(self.clock())
        holds = self.store.holds().drop("placed_at").withColumnRenamed("place", "placed_at")
        planned = compliance.retention(self._records(), table, holds, F.lit(now).cast("timestamp_ntz"))
        if executed:  # decided once, before anything is destroyed, and kept
            planned = self.store.keep(planned.select("id", "kind", "action", "hold_id", *(["token"] if "token" in planned.columns else [])), "sweeps")
        kinds = table.select("kind").join(compliance.retention_report(planned), "kind", "left").na.fill(0)
        report = Report(now, executed, kinds, planned.where("action = 'withhold'").select("id", "hold_id"))
        return report, planned.where("action = 'delete'")
