"""A log on Parquet. Records, closures, tombstones and holds are facts written once; a manifest makes them visible.

Writers add directories, then publish the next manifest, which only one of them can do: the loser
removes what it wrote, waits a little, reads again and retries. Readers resolve the newest manifest
first, so a half-written batch is never seen. Publishing is a rename that refuses an existing
target, which HDFS and local file systems do in one step; a store without that (most object
stores) needs one writer at a time.
"""

from __future__ import annotations

import json
import random
import re
import time
import uuid
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import interval
from ..functions.errors import HistoryError
from ..functions.scalars import utc
from ..operators.compliance import chain_head

RETRIES, WAIT = 8, 0.05  # attempts, and seconds before the second one; later ones wait twice as long each, or less at random
_LISTS = ("records", "closures", "tombstones")
KEPT_BATCHES = 1000  # names of one-off batches that a manifest remembers

Plan = Callable[[DataFrame | None], tuple[DataFrame | None, DataFrame | None]]


def check_name(name: str) -> str:
    """A dataset's name: a letter or underscore, then letters, digits and underscores or dashes, 63 at most."""
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_-]{0,62}", name):
        raise ValueError(f"{name!r} is no name for a log")
    return name


def instant() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)


def needs_actor(actor: dict | None, hold_id: str) -> None:
    if not (actor or {}).get("id"):
        raise HistoryError("missing_actor", hold_id)


class Store:
    def __init__(self, spark: SparkSession, path: str, clock: Callable[[], datetime] = instant):
        check_name(path.rstrip("/").rsplit("/", 1)[-1])
        self.spark, self.path, self.clock = spark, path.rstrip("/"), clock
        self.closed = False
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.migrate()

    def migrate(self) -> None:
        """Make the log's folder if there is none; safe to repeat."""
        self._fs.mkdirs(self._path(f"{self.path}/_manifest"))

    def close(self) -> None:
        self.closed = True

    def __len__(self) -> int:
        log = self.read()
        return 0 if log is None else log.count()

    # The manifest

    def manifest(self) -> dict:
        if self.closed:
            raise HistoryError("closed")
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.path}/_manifest"))]
        empty = {"version": 0, "batches": [], "streams": {}, "holds": [], **{k: [] for k in _LISTS}}
        if not (kept := [n for n in names if n.endswith(".json")]):
            return empty
        stream = self._fs.open(self._path(f"{self.path}/_manifest/{max(kept)}"))
        text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return empty | json.loads(text)

    def commit(self, new: dict) -> None:
        """Publish version n + 1, or raise conflict if somebody else has."""
        new = new | {"version": new["version"] + 1, "batches": new["batches"][-KEPT_BATCHES:]}
        part = self._path(f"{self.path}/_manifest/.{uuid.uuid4().hex}")
        stream = self._fs.create(part, False)
        stream.write(bytearray(json.dumps(new).encode()))
        stream.close()
        target = self._path(f"{self.path}/_manifest/{new['version']:08d}.json")
        if self._fs.exists(target) or not self._fs.rename(part, target):
            self._fs.delete(part, False)
            raise HistoryError("conflict")
        for old in range(max(0, new["version"] - 20), new["version"] - 10):  # readers of ten versions ago are done
            self._fs.delete(self._path(f"{self.path}/_manifest/{old:08d}.json"), False)

    def _attempt(self, change: Callable[[dict, str], dict | None]) -> dict:
        """Publish what ``change(manifest, name)`` makes of the manifest; again if somebody was faster.

        Directories called ``name`` are this attempt's and go if it does not come to be.
        """
        for attempt in range(RETRIES):
            m, name = self.manifest(), uuid.uuid4().hex
            try:
                new = change(json.loads(json.dumps(m)), name)
                if new is None:
                    return m
                self.commit(new)
                return new | {"version": new["version"] + 1}
            except Exception as e:
                for kind in _LISTS:
                    self._remove(f"{kind}/{name}")
                if not (isinstance(e, HistoryError) and e.code == "conflict" and not str(e).startswith("conflict: ")):
                    raise  # a conflict with a reason is the plan's own
            time.sleep(random.random() * WAIT * 2**attempt)
        raise HistoryError("conflict", f"{RETRIES} attempts")

    def _remove(self, folder: str) -> None:
        self._fs.delete(self._path(f"{self.path}/{folder}"), True)

    def _write(self, df: DataFrame, kind: str, name: str) -> None:
        df.write.parquet(f"{self.path}/{kind}/{name}")

    def _holding(self, m: dict, kind: str, ids: DataFrame) -> list[str]:
        """The directories that hold a row of one of the ids."""
        where = F.regexp_extract(F.input_file_name(), f"/({kind}/[0-9a-f]+)/[^/]*$", 1)
        return sorted(r[0] for r in self._frame(m, kind).withColumn("_dir", where).join(ids, "id", "left_semi").select("_dir").distinct().collect())

    def _frame(self, m: dict, kind: str) -> DataFrame | None:
        return self.spark.read.parquet(*[f"{self.path}/{d}" for d in m[kind]]) if m[kind] else None

    def keep(self, df: DataFrame, kind: str) -> DataFrame:
        """A table of its own beside the log, such as what a sweep decided; no manifest names it."""
        name = uuid.uuid4().hex
        self._write(df, kind, name)
        return self._frame({kind: [f"{kind}/{name}"]}, kind)

    # Reading

    def read(self, manifest: dict | None = None) -> DataFrame | None:
        """The log: records and what closed them; None while it is empty."""
        m = manifest or self.manifest()
        records, closures = self._frame(m, "records"), self._frame(m, "closures")
        if records is None or closures is None:
            return records
        first = closures.groupBy("id").agg(F.min("tx_to").alias("closed_at"))
        return records.join(first, "id", "left").withColumn("tx_to", F.coalesce("tx_to", "closed_at")).select(*records.columns)

    def current(self, manifest: dict | None = None, entities: DataFrame | None = None) -> DataFrame | None:
        """The open records, of ``entities`` (kind, entity_id) only if given: the filter comes before the closures."""
        m = manifest or self.manifest()
        records, closures = self._frame(m, "records"), self._frame(m, "closures")
        if records is None:
            return None
        records = records.where("tx_to is null")
        if entities is not None:
            records = records.join(entities.select("kind", "entity_id").distinct(), ["kind", "entity_id"], "left_semi").select(*records.columns)
        return records if closures is None else records.join(closures.select("id"), "id", "left_anti").select(*records.columns)

    def overlapping(self, kind: str, entity_id: str, valid_from=None, valid_to=None) -> DataFrame | None:
        """An entity's open records that meet an interval, in the order of their starts."""
        now = self.current()
        if now is None:
            return None
        hit = interval.overlaps("valid_from", "valid_to", F.lit(utc(valid_from)).cast("timestamp_ntz"), F.lit(utc(valid_to)).cast("timestamp_ntz"))
        return now.where((F.col("kind") == kind) & (F.col("entity_id") == entity_id) & hit).orderBy("valid_from")

    def tombstones(self, kind: str | None = None, entity_id: str | None = None) -> DataFrame | None:
        """(id, kind, entity_id, valid_from, tx_from, token, deleted_at) of destroyed chained records, in chain order."""
        out = self._frame(self.manifest(), "tombstones")
        if out is None:
            return None
        for c, v in (("kind", kind), ("entity_id", entity_id)):
            out = out if v is None else out.where(F.col(c) == v)
        return out.orderBy("tx_from", "valid_from", "id")

    def entries(self) -> DataFrame | None:
        """What ``compliance.verify`` walks: records and tombstones."""
        log, dead = self.read(), self.tombstones()
        if log is None or "token" not in log.columns:
            return log
        out = log.withColumn("tombstone", F.lit(False))
        return out if dead is None else out.unionByName(dead.drop("deleted_at").withColumn("tombstone", F.lit(True)), allowMissingColumns=True)

    def chain_tails(self, entities: DataFrame) -> DataFrame | None:
        """Where the chains of entities end: at one of their open records, as each write leaves one open."""
        now = self.current(entities=entities)
        return None if now is None or "token" not in now.columns else chain_head(now).withColumnRenamed("head", "token")

    # Writing

    def apply(self, plan: Plan, batch: str | tuple[str, int] | None = None, entities: DataFrame | None = None) -> int:
        """Plan inserts (with ids) and closures (id, tx_to) on the current records and publish both at once.

        A batch that was applied before is a no-op: one of a name, or (stream, number) where numbers
        only grow. Records whose id exists are not inserted again: the first one stays. With
        inserts, closing a record that is not open is a conflict and nothing is applied; without,
        closures that close nothing are skipped, and no id need be known.
        """

        def change(m: dict, name: str) -> dict | None:
            if isinstance(batch, tuple) and m["streams"].get(batch[0], -1) >= batch[1] or isinstance(batch, str) and batch in m["batches"]:
                return None
            insert, close = plan(self.current(m, entities))
            records = self._frame(m, "records")
            if insert is not None:
                if records is not None:
                    insert = insert.join(records.select("id"), "id", "left_anti").select(*insert.columns)
                self._write(insert.dropDuplicates(["id"]), "records", name)
                m["records"].append(f"records/{name}")
            if close is not None:
                open_ = self.current(m | {"records": m["records"][:-1] if insert is not None else m["records"]})
                close = close.select("id", "tx_to")
                if insert is None:
                    close = close.join(open_.select("id"), "id", "left_semi") if open_ is not None else close.limit(0)
                self._write(close, "closures", name)
                written = self._frame({"closures": [f"closures/{name}"]}, "closures")
                if insert is not None and not (written if open_ is None else written.join(open_.select("id"), "id", "left_anti")).isEmpty():
                    raise HistoryError("conflict", "a record to close is missing or closed")
                m["closures"].append(f"closures/{name}")
            if isinstance(batch, tuple):
                m["streams"][batch[0]] = batch[1]
            elif batch is not None:
                m["batches"].append(batch)
            return m

        return self._attempt(change)["version"]

    def seed(self, records: DataFrame) -> int:
        """Insert records as they are, instants and ends included, without looking at what is there."""
        return self.apply(lambda _: (records, None))

    def supersede(self, closures: DataFrame) -> int:
        """Close records without writing any; repeating it changes nothing."""
        return self.apply(lambda _: (None, closures))

    def delete(self, ids: DataFrame) -> int:
        """Destroy closed records and return how many. A batch that names a current one destroys nothing; unknown
        ids are skipped. Chained records leave a tombstone. Only directories that hold one of them are
        written anew, and the old ones go once the new manifest is out; a reader of an older manifest
        has to read it again, as what is destroyed must not stay readable."""
        state = {}

        def change(m: dict, name: str) -> dict | None:
            log = self.read(m)
            state.update(n=0, gone=[])
            if log is None:
                return None
            gone = log.join(ids.select("id").distinct(), "id", "left_semi").select(*log.columns)
            state["n"], current = gone.agg(F.count(F.lit(1)), F.count_if(F.col("tx_to").isNull())).first()
            if current:
                raise HistoryError("current_record")
            if not state["n"]:
                return None
            if "token" in log.columns:
                dead = gone.where("token is not null").select("id", "kind", "entity_id", "valid_from", "tx_from", "token", F.lit(self.clock()).cast("timestamp_ntz").alias("deleted_at"))
                self._write(dead, "tombstones", name)
                m["tombstones"].append(f"tombstones/{name}")
            for kind in ("records", "closures"):
                if m[kind]:
                    dirs = self._holding(m, kind, gone.select("id"))
                    if dirs:
                        some = self._frame({kind: dirs}, kind)
                        self._write(some.join(gone.select("id"), "id", "left_anti").select(*some.columns), kind, name)
                        m[kind] = [d for d in m[kind] if d not in dirs] + [f"{kind}/{name}"]
                        state["gone"] += dirs
            return m

        self._attempt(change)
        for d in state["gone"]:
            self._remove(d)
        return state["n"]

    def compact(self) -> None:
        """Write the log as one directory, clustered by entity, with its closures folded in."""

        def change(m: dict, name: str) -> dict | None:
            log = self.read(m)
            if log is None:
                return None
            state["old"] = m["records"] + m["closures"]
            self._write(log.repartition("kind", "entity_id").sortWithinPartitions("kind", "entity_id", "tx_from"), "records", name)
            return m | {"records": [f"records/{name}"], "closures": []}

        state = {"old": []}
        self._attempt(change)
        for d in state["old"]:
            self._remove(d)

    # Holds: few and small, so they live in the manifest

    def place_hold(self, hold: dict) -> dict:
        """hold: id, kind and entity_id ('' covers all), effective_from, reason, placed_by (an actor).

        The store says when it was placed, and a release is no part of placing."""
        if not hold.get("id"):
            raise HistoryError("missing_hold_id")
        needs_actor(hold.get("placed_by"), hold["id"])
        if any("\0" in str(v) for v in (*(hold.get(c) or "" for c in ("id", "kind", "entity_id", "reason")), *hold["placed_by"].values())):
            raise HistoryError("invalid_field", hold["id"])
        out = {"id": hold["id"], "kind": hold.get("kind") or "", "entity_id": hold.get("entity_id") or "", "effective_from": _text(utc(hold.get("effective_from"))), "reason": hold.get("reason") or ""}
        out |= {"placed_by": dict(hold["placed_by"]), "placed_at": _text(self.clock()), "released_at": None, "released_by": None, "release_reason": None}

        def change(m: dict, name: str) -> dict:
            if any(h["id"] == out["id"] for h in m["holds"]):
                raise HistoryError("hold_exists", out["id"])
            return m | {"holds": [*m["holds"], out]}

        self._attempt(change)
        return out

    def release_hold(self, hold_id: str, by: dict, reason: str = "") -> dict:
        """End a hold; its row stays. Releasing twice is an error."""
        if not hold_id:
            raise HistoryError("missing_hold_id")
        needs_actor(by, hold_id)

        def change(m: dict, name: str) -> dict:
            h = next((h for h in m["holds"] if h["id"] == hold_id), None)
            if h is None:
                raise HistoryError("not_found", hold_id)
            if h["released_at"] is not None:
                raise HistoryError("hold_released", hold_id)
            h |= {"released_at": _text(self.clock()), "released_by": dict(by), "release_reason": reason}
            return m

        return next(h for h in self._attempt(change)["holds"] if h["id"] == hold_id)

    def holds(self) -> DataFrame:
        """All holds ever placed, in the order of placing: hold_id, kind, entity_id, effective_from, reason,
        placed_by, placed_at, place, released_at, released_by, release_reason."""
        who = lambda a: a and (a["id"], a.get("type", ""), a.get("name", ""))
        time_ = lambda t: t and datetime.fromisoformat(t)
        rows = [(h["id"], h["kind"], h["entity_id"], time_(h["effective_from"]), h["reason"], who(h["placed_by"]), time_(h["placed_at"]), n, time_(h["released_at"]), who(h["released_by"]), h["release_reason"]) for n, h in enumerate(self.manifest()["holds"])]
        actor = "struct<id:string,type:string,name:string>"
        schema = f"hold_id string, kind string, entity_id string, effective_from timestamp_ntz, reason string, placed_by {actor}, placed_at timestamp_ntz, place int, released_at timestamp_ntz, released_by {actor}, release_reason string"
        return self.spark.createDataFrame(rows, schema).orderBy("place")


class MemoryStore(Store):
    """The same log in the driver's memory, for tests and small logs: rows are gathered there with every write."""

    def __init__(self, spark: SparkSession, clock: Callable[[], datetime] = instant):
        self.spark, self.clock, self.closed = spark, clock, False
        self._now: dict | None = None
        self._kept: dict[str, DataFrame] = {}

    def migrate(self) -> None:
        pass

    def manifest(self) -> dict:
        if self.closed:
            raise HistoryError("closed")
        return self._now or {"version": 0, "batches": [], "streams": {}, "holds": [], **{k: [] for k in _LISTS}}

    def commit(self, new: dict) -> None:
        if self._now and new["version"] != self._now["version"]:
            raise HistoryError("conflict")
        self._now = new | {"version": new["version"] + 1}

    def _write(self, df: DataFrame, kind: str, name: str) -> None:
        self._kept[f"{kind}/{name}"] = self.spark.createDataFrame(df.collect(), df.schema)

    def _frame(self, m: dict, kind: str) -> DataFrame | None:
        out = None
        for d in m[kind]:
            out = self._kept[d] if out is None else out.unionByName(self._kept[d])
        return out

    def _holding(self, m: dict, kind: str, ids: DataFrame) -> list[str]:
        return list(m[kind])

    def _remove(self, folder: str) -> None:
        self._kept.pop(folder, None)


def _text(t: datetime | None) -> str | None:
    return t and t.isoformat()
