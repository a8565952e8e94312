"""The event table as a bitemporal write log, and the questions asked of it.

Write k is event k: kind and entity are its type and user, its instant the transaction time, and
its valid interval reaches back and forward by hours that depend on the number; every fifth is open.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import interval, scalars
from ..functions.errors import HistoryError
from ..functions.jsonexact import escape_column
from ..functions.scalars import META_CIPHER, RESERVED
from ..log import Clock, Log
from ..operators import compliance, fields, merge, read, write
from ..sources.keyring import MemoryKeyring
from ..sources.scratch import scratch
from ..sources.store import MemoryStore, Store

VALID, EARLY, LATE = datetime(2024, 1, 12), datetime(2024, 1, 15), datetime(2024, 1, 25)
SHOWN = ["kind", "entity_id", "k", "valid_from", "valid_to", "tx_from", "tx_to", "intent"]


def ntz(t: datetime):
    return F.lit(t.isoformat(sep=" ")).cast("timestamp_ntz")


def writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    hours = lambda c: F.make_dt_interval(F.lit(0), c.cast("int"))
    return e.select(
        F.col("event_type").alias("kind"), F.col("user_id").cast("string").alias("entity_id"), F.col("event_id").alias("k"), F.col("ts").cast("timestamp_ntz").alias("tx"),
        (F.col("ts").cast("timestamp_ntz") - hours(F.col("event_id") % 97)).alias("valid_from"),
        F.when(F.col("event_id") % 5 != 0, F.col("ts").cast("timestamp_ntz") + hours(1 + F.col("event_id") % 41)).alias("valid_to"),
        F.when(F.col("event_id") % 4 == 0, 1).otherwise(0).alias("intent"), F.concat(F.lit("a"), (F.col("event_id") % 7).cast("string")).alias("actor"), F.col("props").alias("data"),
    )


def _entities_of(df: DataFrame, q: read.Query | None) -> DataFrame:
    """What a query says of kind and entity holds of writes as well as of records: an entity's records come
    from its own writes. So these filters go below the merge, and kinds into the scan."""
    for c in ("kind", "entity_id"):
        if q is not None and getattr(q, c):
            df = df.where(F.col(c) == getattr(q, c))
    return df


def records(spark: SparkSession, sf_dir: str, q: read.Query | None = None) -> DataFrame:
    return merge.replay(_entities_of(writes(spark, sf_dir), q))


def log(spark: SparkSession, sf_dir: str, q: read.Query | None = None) -> DataFrame:
    return read.with_ids(records(spark, sf_dir, q))


def put_split_log(spark, sf_dir):
    return records(spark, sf_dir).select(*SHOWN, "actor", "data")


def put_split_log_set(spark, sf_dir):
    return merge.merge_set(writes(spark, sf_dir)).select(*SHOWN, "actor", "data")


def current_tiling(spark, sf_dir):
    return records(spark, sf_dir).where("tx_to is null").select(*SHOWN)


def _entities(log: DataFrame) -> DataFrame:
    return log.select("kind", "entity_id").distinct()


def asof_get(spark, sf_dir):
    """Every entity at its own instants: halfway through each of its first writes' intervals, as believed at LATE."""
    w = writes(spark, sf_dir)
    first = w.groupBy("kind", "entity_id").agg(F.min("tx").alias("valid_at")).withColumn("tx_at", ntz(LATE))
    return read.get(records(spark, sf_dir), first).select("kind", "entity_id", "valid_at", "k", "tx_from", "intent", "data")


def belief_shift(spark, sf_dir, valid=VALID, early=EARLY):
    """Entities of which we now believe something else about ``valid`` than we did at ``early``."""
    r = records(spark, sf_dir).where(interval.contains("valid_from", "valid_to", ntz(valid)))
    was = F.max(F.when(interval.contains("tx_from", "tx_to", ntz(early)), F.col("k")))
    now = F.max(F.when(F.col("tx_to").isNull(), F.col("k")))
    both = r.groupBy("kind", "entity_id").agg(was.alias("k_then"), now.alias("k_now"))
    return both.where(~F.col("k_then").eqNullSafe(F.col("k_now")))


def timeline_at(spark, sf_dir):
    return read.timeline(records(spark, sf_dir), ntz(EARLY)).select("kind", "entity_id", "position", "k", "valid_from", "valid_to", "intent")


def _query(q: read.Query):
    return lambda spark, sf_dir: read.query(log(spark, sf_dir, q), q).select(*SHOWN, "id")


history_filtered = _query(read.Query(kind="click", entity_id="8", valid=(datetime(2024, 1, 5), datetime(2024, 1, 20)), tx=(None, LATE)))
query_by_actor = _query(read.Query(actor="a3"))
query_valid_overlap = _query(read.Query(kind="view", valid=(datetime(2024, 1, 10), datetime(2024, 1, 11))))
query_tx_overlap = _query(read.Query(tx=(datetime(2024, 1, 10), datetime(2024, 1, 12))))
query_intent = _query(read.Query(intent=1))
query_current_only = _query(read.Query(kind="error", current_only=True))
query_point = _query(read.Query(valid_at=VALID, tx_at=EARLY))


_VIEW = read.Query(kind="view")


def _views(spark, sf_dir) -> Store:
    """The views' log as a store holds it: pages are read from there, not made from the writes each time."""
    store = Store(spark, scratch(spark, "views"))
    store.seed(log(spark, sf_dir, _VIEW))
    return store


def _page(descending: bool, number: int):
    """The number-th page of 100, each resumed from the last row of the one before."""

    def run(spark, sf_dir):
        r = _views(spark, sf_dir).read()
        q = read.Query(limit=100, descending=descending)
        for _ in range(number):
            rows, after = read.page(r, q)  # a page's rows, 100 at most
            q = read.Query(limit=100, descending=descending, after=after)
        rows = read.query(r, q)
        n = F.row_number().over(Window.orderBy(*[F.desc(c) if descending else F.asc(c) for c in read.ORDER]))
        return rows.withColumn("position", n).select("position", *SHOWN, "id")

    return run


keyset_page_asc, keyset_page_desc = _page(False, 2), _page(True, 2)


def last_page_empty(spark, sf_dir):
    """One kind's log walked in pages of a seventh, both ways: each row's place in the walk, and the page it came
    on. The last page gives no cursor, so no empty page follows it."""
    store = _views(spark, sf_dir)
    r = store.keep(read.in_ranges(store.read()), "ranges")
    size = -(-r.count() // 7)

    def walk(descending):
        rows = read.walk(r, read.Query(limit=size, descending=descending))
        return rows.select(F.lit(descending).alias("descending"), "page", F.col("place").cast("int").alias("place"), "id")

    return walk(False).unionByName(walk(True))


def diff_flat(spark, sf_dir):
    r = records(spark, sf_dir)
    point = lambda t: (ntz(VALID), ntz(t))
    entities = writes(spark, sf_dir).select("kind", "entity_id").distinct()

    def at(t, name):
        probes = entities.select("kind", "entity_id", point(t)[0].alias("valid_at"), point(t)[1].alias("tx_at"))
        return read.get(r, probes).select("kind", "entity_id", F.col("data").alias(name))

    pairs = at(EARLY, "before").join(at(LATE, "after"), ["kind", "entity_id"], "full")
    return fields.diffs(pairs, ["kind", "entity_id"]).select("kind", "entity_id", "position", "path", "op", "old", "new")


def field_history_asc(spark, sf_dir):
    return fields.field_history(log(spark, sf_dir), "/k", ntz(VALID))


def field_history_desc(spark, sf_dir):
    return fields.field_history(log(spark, sf_dir), "/k", ntz(VALID), descending=True)


def changed_field(spark, sf_dir):
    """Corrections that changed /k against the record that held just before at their start."""
    r = log(spark, sf_dir)
    new = fields.values_at(r.where("intent = 1"), "/k").select("kind", "entity_id", "id", "canon", F.col("valid_from").alias("v"), F.col("tx_from").alias("t"))
    old = fields.values_at(r.where("tx_to is not null"), "/k").select("kind", "entity_id", F.col("canon").alias("old_canon"), "valid_from", "valid_to", "tx_from", "tx_to")
    hit = new.join(old, ["kind", "entity_id"]).where((F.col("tx_to") == F.col("t")) & interval.contains("valid_from", "valid_to", "v"))
    return hit.where(~F.col("canon").eqNullSafe(F.col("old_canon"))).groupBy("kind").agg(F.count(F.lit(1)).alias("changed"))


def remainder_attribution(spark, sf_dir):
    r = records(spark, sf_dir).withColumn("intent_name", interval.intent_name("intent"))
    return r.groupBy("actor", "intent_name").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("tx_to").isNull()).alias("open"))


def non_overlap_violations(spark, sf_dir):
    """Among open records of an entity, neighbours that overlap: none. The count of neighbours comes with it."""
    w = Window.partitionBy("kind", "entity_id").orderBy("valid_from")
    r = records(spark, sf_dir).where("tx_to is null").withColumns({"n": F.row_number().over(w), "before": F.lag("valid_to").over(w)})
    return r.where("n > 1").agg(F.count(F.lit(1)).alias("neighbours"), F.count_if(F.col("before").isNull() | (F.col("before") > F.col("valid_from"))).alias("violations"))


def coverage_gaps(spark, sf_dir):
    """Stretches between open records that nothing covers."""
    w = Window.partitionBy("kind", "entity_id").orderBy("valid_from")
    r = records(spark, sf_dir).where("tx_to is null").withColumn("gap_from", F.lag("valid_to").over(w))
    return r.where("gap_from < valid_from").select("kind", "entity_id", "gap_from", F.col("valid_from").alias("gap_to"), interval.duration_us("gap_from", "valid_from").alias("gap_us"))


def coverage_monotone(spark, sf_dir):
    """Per entity, the time covered within a fixed year as believed at EARLY and LATE, and whether what was covered
    at EARLY still is at LATE: closing a record opens what is left of it, so coverage only grows."""
    first, last = ntz(datetime(2023, 7, 1)), ntz(datetime(2024, 7, 1))
    within = {"a": F.greatest("valid_from", first), "b": F.least(F.coalesce("valid_to", last), last)}
    r = records(spark, sf_dir).withColumns(within).where("a < b").withColumn("us", interval.duration_us("a", "b"))
    held = lambda t: interval.contains("tx_from", "tx_to", ntz(t))
    part = lambda t: F.coalesce(F.sum(F.when(held(t), F.col("us"))), F.lit(0))
    sums = r.groupBy("kind", "entity_id").agg(part(EARLY).alias("early_us"), part(LATE).alias("late_us"))
    early, late = r.where(held(EARLY)).select("kind", "entity_id", "a", "b"), r.where(held(LATE)).select("kind", "entity_id", F.col("a").alias("c"), F.col("b").alias("d"))
    both = early.join(late, ["kind", "entity_id"]).where("a < d and c < b")
    common = both.groupBy("kind", "entity_id").agg(F.sum(interval.duration_us(F.greatest("a", "c"), F.least("b", "d"))).alias("common_us"))
    out = sums.join(common, ["kind", "entity_id"], "left").withColumn("lost_us", F.col("early_us") - F.coalesce("common_us", F.lit(0)))
    return out.select("kind", "entity_id", "early_us", "late_us", "lost_us")


def ratchet(spark, sf_dir):
    """Instants for a clock that ticks once a day, per kind and entity."""
    w = writes(spark, sf_dir).select("kind", "entity_id", "k", F.timestamp_diff("MINUTE", ntz(datetime(2024, 1, 1)), F.col("tx")).alias("m"))
    return merge.ratchet(w.withColumn("clock", F.floor(F.col("m") / 1440) * F.lit(86_400_000_000)), "clock", ["k"], ["kind", "entity_id"]).select("kind", "entity_id", "k", "tx_us")


def entities_touched(spark, sf_dir):
    return writes(spark, sf_dir).select("kind", "entity_id").distinct()


def interval_algebra(spark, sf_dir):
    """Each entity's consecutive writes: every predicate on the two intervals."""
    w = Window.partitionBy("kind", "entity_id").orderBy("k")
    a = writes(spark, sf_dir).withColumns({"pf": F.lag("valid_from").over(w), "pt": F.lag("valid_to").over(w), "n": F.row_number().over(w)}).where("n > 1")
    return a.select(
        "k", interval.overlaps("pf", "pt", "valid_from", "valid_to").alias("overlap"), interval.starts_before("pf", "valid_from").alias("before"), interval.extends_beyond("pt", "valid_to").alias("beyond"),
        interval.contains("valid_from", "valid_to", "pf").alias("holds"), interval.is_valid("valid_from", "valid_to").alias("valid"), interval.duration_us("valid_from", "valid_to").alias("us"), interval.text("valid_from", "valid_to").alias("shown"),
    )


def pointer_escape(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", escape_column(F.concat(F.col("event_type"), F.lit("~/"), F.col("props"))).alias("token"))


POLICIES = [("click", timedelta(days=3)), ("view", timedelta(days=7)), ("error", timedelta(days=10))]
HOLDS = [("h1", "click", "", "2024-01-02", 1, None), ("h2", "view", "8", "2024-01-02", 2, None), ("h3", "", "11", "2024-01-05", 3, None), ("h4", "error", "", "2024-01-03", 4, "2024-01-20"), ("h5", "view", "", "2024-02-20", 5, None)]
NOW = datetime(2024, 1, 30)


def _holds(spark):
    holds = spark.createDataFrame(HOLDS, "hold_id string, kind string, entity_id string, f string, placed_at int, r string")
    return holds.select("hold_id", "kind", "entity_id", F.col("f").cast("timestamp_ntz").alias("effective_from"), "placed_at", F.col("r").cast("timestamp_ntz").alias("released_at"))


def _planned(spark, sf_dir):
    return compliance.retention(log(spark, sf_dir), compliance.policy_table(spark, POLICIES), _holds(spark), ntz(NOW))


def retention_plan(spark, sf_dir):
    return _planned(spark, sf_dir).where("action = 'delete'").select("id", "kind", "entity_id", "tx_to")


def retention_withheld(spark, sf_dir):
    return _planned(spark, sf_dir).where("action = 'withhold'").select("id", "kind", "entity_id", "hold_id")


def retention_report(spark, sf_dir):
    return compliance.retention_report(_planned(spark, sf_dir))


def hold_activity(spark, sf_dir):
    """Each hold: whether it bites at NOW, and of how many entities it covers records."""
    entities = _entities(writes(spark, sf_dir))
    holds = _holds(spark).withColumn("active", interval.contains("effective_from", "released_at", ntz(NOW)))
    covers = ((F.col("h.kind") == "") | (F.col("h.kind") == F.col("e.kind"))) & ((F.col("h.entity_id") == "") | (F.col("h.entity_id") == F.col("e.entity_id")))
    hit = entities.alias("e").join(F.broadcast(holds.alias("h")), covers)  # five holds
    return hit.groupBy("hold_id", "active").agg(F.count(F.lit(1)).alias("entities"))


def chain_stamp(spark, sf_dir):
    return compliance.stamp(log(spark, sf_dir)).select("id", "kind", "entity_id", "token")


def chain_verify_intact(spark, sf_dir):
    return compliance.verify(compliance.stamp(log(spark, sf_dir))).select("kind", "entity_id", "entries", "chained", "tombstones", "unchained", "status", "position", "head")


def chain_verify_tampered(spark, sf_dir):
    """Every record of a write whose number is 7 modulo 50 has another actor than it was stamped with."""
    bad = compliance.stamp(log(spark, sf_dir)).withColumn("actor", F.when(F.col("k") % 50 == 7, "mallory").otherwise(F.col("actor")))
    return compliance.verify(bad).select("kind", "entity_id", "chained", "status", "position", "bad_id")


def chain_verify_moved_end(spark, sf_dir):
    """Every closed record of a write whose number is 7 modulo 50 ends a microsecond late: no hash covers an end, but
    no entry of the chain begins there."""
    late = F.when(F.col("k") % 50 == 7, F.col("tx_to") + F.expr("interval 1 microsecond")).otherwise(F.col("tx_to"))
    return compliance.verify(compliance.stamp(log(spark, sf_dir)).withColumn("tx_to", late)).select("kind", "entity_id", "status", "position", "bad_id")


def chain_unchained_prefix(spark, sf_dir):
    """Writes before number 2000 were not chained; the chain begins with the entity's next record."""
    r = log(spark, sf_dir)
    old, new = r.where("tx_from < timestamp_ntz'2024-01-05'"), r.where("tx_from >= timestamp_ntz'2024-01-05'")
    both = compliance.stamp(new).unionByName(old.withColumn("token", F.lit(None).cast("string")))
    return compliance.verify(both).select("kind", "entity_id", "entries", "chained", "unchained", "status")


def chain_incremental(spark, sf_dir):
    """Records up to an instant stamped first, the others linked on to the stored tails: the same tokens."""
    r = log(spark, sf_dir)
    first = compliance.stamp(r.where("tx_from < timestamp_ntz'2024-01-15'"))
    rest = compliance.stamp(r.where("tx_from >= timestamp_ntz'2024-01-15'"), compliance.chain_head(first).withColumnRenamed("head", "token"))
    return first.unionByName(rest).select("id", "kind", "entity_id", "token")


def tombstone_gap(spark, sf_dir):
    """Records of writes 31 modulo 60 have become tombstones, and those of 7 modulo 60 are gone without one: the
    entry after a gap does not link."""
    e = compliance.stamp(log(spark, sf_dir)).where("k % 60 <> 7").withColumn("tombstone", F.col("k") % 60 == 31)
    e = e.withColumns({c: F.when(~F.col("tombstone"), F.col(c)) for c in ("data", "actor", "valid_to", "tx_to")})
    return compliance.verify(e).where("status <> 'broken' or position > 0").select("kind", "entity_id", "status", "position")


def _swept(spark, sf_dir):
    store = Store(spark, scratch(spark, "swept"), clock=lambda: NOW)
    store.seed(compliance.stamp(log(spark, sf_dir)))
    ends = {h[0]: h[5] for h in HOLDS if h[5]}
    for hold_id, kind, entity, since, *_ in HOLDS:
        store.place_hold({"id": hold_id, "kind": kind, "entity_id": entity, "effective_from": datetime.fromisoformat(since), "placed_by": {"id": "legal"}})
        if hold_id in ends:
            store.release_hold(hold_id, {"id": "legal"})
    return store, Log(store, clock=lambda: NOW).execute_retention(POLICIES)


def sweep_executed(spark, sf_dir):
    """What a sweep reports, and what is left of each kind after it."""
    store, report = _swept(spark, sf_dir)
    left = store.read().groupBy("kind").agg(F.count(F.lit(1)).alias("left"))
    return report.kinds.join(left, "kind", "left")


def chain_after_sweep(spark, sf_dir):
    """The chains of all entities after a sweep: tombstones stand in for what was destroyed."""
    store, _ = _swept(spark, sf_dir)
    return compliance.verify(store.entries()).select("kind", "entity_id", "entries", "chained", "tombstones", "status")


def tombstones_left(spark, sf_dir):
    store, _ = _swept(spark, sf_dir)
    return store.tombstones().select("id", "kind", "entity_id", "valid_from", "tx_from", "token")


def holds_placed(spark, sf_dir):
    """Holds as placed and released, and the refusals of bad ones, in order."""
    clock = Clock(datetime(2024, 1, 1))
    store = MemoryStore(spark, clock=clock)
    refused = []

    def trial(call, *args):
        clock.advance(timedelta(hours=1))
        try:
            call(*args)
        except HistoryError as e:
            refused.append(e.code)

    for hold_id, kind, entity, since, *_ in HOLDS:
        trial(store.place_hold, {"id": hold_id, "kind": kind, "entity_id": entity, "effective_from": datetime.fromisoformat(since), "placed_by": {"id": "legal"}, "released_at": NOW})
    trial(store.place_hold, {"id": "h1", "placed_by": {"id": "legal"}})
    trial(store.place_hold, {"id": "", "placed_by": {"id": "legal"}})
    trial(store.place_hold, {"id": "h9", "placed_by": {}})
    trial(store.place_hold, {"id": "h9", "reason": "a\0b", "placed_by": {"id": "legal"}})
    trial(store.release_hold, "h4", {"id": "judge"}, "settled")
    trial(store.release_hold, "h4", {"id": "judge"})
    trial(store.release_hold, "h7", {"id": "judge"})
    trial(store.release_hold, "h5", {})
    trial(store.release_hold, "", {"id": "judge"})
    h = store.holds()
    return h.select("hold_id", "kind", "entity_id", "effective_from", F.col("placed_by.id").alias("placed_by"), "placed_at", "released_at", F.col("released_by.id").alias("released_by"), "release_reason", F.lit(" ".join(refused)).alias("refused"))


def _as_written(spark, sf_dir):
    """The events as writes that carry everything: an actor of three fields, a reason, metadata and bytes."""
    w, k = writes(spark, sf_dir), F.col("k")
    meta = F.when(k % 3 != 0, F.create_map(F.lit("ticket"), F.concat(F.lit("t"), (k % 11).cast("string"))))
    return w.withColumns({"actor": F.struct(F.col("actor").alias("id"), F.lit("user").alias("type"), F.upper("actor").alias("name")), "reason": F.concat(F.lit("r"), (k % 13).cast("string")), "meta": meta, "data": F.encode("data", "utf-8")})


def _spoilt(spark, sf_dir):
    """The same, of which every write numbered 1 to 10 modulo 101 breaks a rule, and some of them two."""
    w, m = _as_written(spark, sf_dir), F.col("k") % 101
    nul = F.lit("a\0b")
    w = w.withColumn("kind", F.when(m == 1, "").when(m == 4, nul).otherwise(F.col("kind")))
    w = w.withColumn("entity_id", F.when((m == 2) | ((m == 1) & (F.col("k") % 2 == 0)), "").otherwise(F.col("entity_id")))
    w = w.withColumn("actor", F.struct(F.when((m == 3) | ((m == 2) & (F.col("k") % 2 == 0)), "").otherwise(F.col("actor.id")).alias("id"), F.col("actor.type").alias("type"), F.when(m == 10, nul).otherwise(F.col("actor.name")).alias("name")))
    w = w.withColumn("valid_to", F.when((m == 5) | ((m == 10) & (F.col("k") % 2 == 0)), F.col("valid_from")).otherwise(F.col("valid_to")))
    w = w.withColumn("reason", F.when((m == 6) | ((m == 5) & (F.col("k") % 2 == 0)), nul).otherwise(F.col("reason")))
    bad = F.when(m == 7, F.create_map(F.lit(RESERVED + "x"), F.lit("y"))).when(m == 8, F.create_map(nul, F.lit("y"))).when(m == 9, F.create_map(F.lit("x"), nul))
    return w.withColumn("meta", F.coalesce(bad, F.col("meta")))


def put_errors(spark, sf_dir):
    return write.checked(_spoilt(spark, sf_dir)).where("error_code is not null").select("k", "error_code")


def put_validated(spark, sf_dir):
    """The record set of the writes that break no rule."""
    good = write.checked(_spoilt(spark, sf_dir)).where("error_code is null").drop("error_code")
    r = merge.replay(good)
    return r.select(*SHOWN, F.col("actor.id").alias("actor_id"), "reason", F.try_element_at("meta", F.lit("ticket")).alias("ticket"))


def remainder_meta(spark, sf_dir):
    """What is left of a superseded record keeps its writer's name, reason and metadata, whoever superseded it."""
    r = merge.replay(_as_written(spark, sf_dir)).where("intent = 2")
    return r.select("k", "valid_from", "tx_from", F.col("actor.name").alias("actor_name"), F.col("actor.type").alias("actor_type"), "reason", F.try_element_at("meta", F.lit("ticket")).alias("ticket"))


def key_destroyed(spark, sf_dir):
    """Sealed under their actor's key, read back after a2's was destroyed: how many of each actor open, and how many say what was written."""
    ring = MemoryKeyring(spark)
    for n in range(1, 7):
        ring.key(f"a{n}")
    w = _as_written(spark, sf_dir).withColumn("subject", F.when(F.col("actor.id") != "a0", F.col("actor.id")))
    sealed = compliance.sealed(w.withColumn("clear", F.col("data")).join(F.broadcast(ring.frame().select("subject", "key")), "subject", "left"))
    ring.destroy("a2")
    ring.destroy("stranger")
    out = compliance.opened(sealed.drop("key", "subject"), ring.frame())
    return out.groupBy(F.col("actor.id").alias("actor"), "status").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("data") == F.col("clear")).alias("same"))


def shred_status(spark, sf_dir):
    """Sealed under their actor's key, with the key of a2 destroyed, a3's unknown and a4's another; read back."""
    key = lambda a: F.unhex(F.sha2(F.concat(F.lit("key"), a), 256))
    actors = spark.createDataFrame([(f"a{i}",) for i in range(7)], "subject string")
    keys = actors.select("subject", key(F.col("subject")).alias("key"))
    r = log(spark, sf_dir).withColumns({"subject": F.when(F.col("actor") != "a0", F.col("actor")), "meta": F.lit(None).cast("map<string,string>")})
    sealed = compliance.sealed(r.join(F.broadcast(keys), "subject", "left")).drop("key", "subject")
    later = keys.where("subject <> 'a3'").withColumn("key", F.when(F.col("subject") == "a4", key(F.lit("other"))).when(F.col("subject") != "a2", F.col("key")))
    sealed = sealed.withColumn("meta", F.when(F.col("actor") == "a5", F.map_concat(F.map_filter("meta", lambda k, _: k != META_CIPHER), F.create_map(F.lit(META_CIPHER), F.lit("rot13")))).otherwise(F.col("meta")))
    return compliance.opened(sealed, later).select("id", "kind", "entity_id", "status", F.decode("data", "utf-8").alias("data"))


def diff_nested(spark, sf_dir):
    """Each event's document against that of the one before: an object in it, an array in that, and a key that comes and goes."""
    k = F.col("event_id")
    doc = F.concat(
        F.lit('{"s":"p'), (k % 4).cast("string"), F.lit('","n":{"y":['), (k % 5).cast("string"), F.lit(","), (k % 2).cast("string"), F.lit('.0],"x":'), (k % 3).cast("string"), F.lit("}"),
        F.when(k % 7 < 3, F.lit(',"o":null')).otherwise(F.lit("")), F.lit("}"),
    )
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", doc.alias("after"))
    pairs = e.withColumn("before", F.lag("after").over(Window.partitionBy("user_id").orderBy("event_id"))).where("before is not null")
    return fields.diffs(pairs, ["event_id"])


def current_overlapping(spark, sf_dir):
    """The open records that a write over a given day would supersede, in the order of their starts."""
    day = ntz(VALID), ntz(VALID + timedelta(days=1))
    r = log(spark, sf_dir).where("tx_to is null").where(interval.overlaps("valid_from", "valid_to", *day))
    return r.withColumn("position", F.row_number().over(Window.partitionBy("kind", "entity_id").orderBy("valid_from"))).select("kind", "entity_id", "position", "id")


def closures_only(spark, sf_dir):
    """Supersede without inserting: a store's open records of one kind are closed, twice over and with an unknown id; the first end stays."""
    store = Store(spark, scratch(spark, "closing"))
    store.seed(log(spark, sf_dir, read.Query(kind="error")))
    for end in (LATE, NOW):
        ids = store.current().where("k % 2 = 0").select("id").unionByName(spark.createDataFrame([("nobody",)], "id string"))
        store.supersede(ids.withColumn("tx_to", ntz(max(end, datetime(2024, 2, 28)))))
    return store.read().select("id", "tx_to")


def chain_heads(spark, sf_dir):
    """The ends of chains of which a record was tampered with: heads are read, not verified."""
    bad = compliance.stamp(log(spark, sf_dir)).withColumn("token", F.when(F.col("k") % 50 == 7, "v2:ff").otherwise(F.col("token")))
    return compliance.chain_head(bad)


def rfc3339_render(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    micros = F.when(F.col("event_id") % 3 == 0, 0).when(F.col("event_id") % 3 == 1, 120_000).otherwise(F.col("event_id") % 1000)
    at = F.date_trunc("second", F.col("ts").cast("timestamp")) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (micros / 1_000_000).cast("decimal(18,6)"))
    return e.select("event_id", scalars.rfc3339(at).alias("text"))


def rfc3339_parse(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    base, n = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.col("event_id") % 5
    text = F.when(n == 0, F.concat(base, F.lit("Z"))).when(n == 1, F.concat(base, F.lit(".25+02:00"))).when(n == 2, base).when(n == 3, F.lit("0001-01-01T00:00:00Z")).otherwise(F.concat(base, F.lit("-01:30")))
    return e.select("event_id", scalars.rfc3339_column(text).cast("timestamp_ntz").alias("at"))


def uvarint_prefix(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", F.hex(scalars.uvarint(F.col("event_id") * F.col("event_id"))).alias("bytes"), F.hex(scalars.prefixed(F.col("props"))).alias("prefixed"))


def data_rendering(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    data = F.when(F.col("event_id") % 3 == 0, F.encode("props", "utf-8")).when(F.col("event_id") % 3 == 1, F.encode(F.concat("props", F.lit("}")), "utf-8")).otherwise(F.unhex(F.lit("ff00fe")))
    return e.select("event_id", scalars.rendered(data).alias("d")).select("event_id", "d.json", "d.base64")


def meta_checks(spark, sf_dir):
    """NUL and the library's own prefix, in metadata keys and in texts."""
    w = _spoilt(spark, sf_dir)
    return w.select("k", scalars.has_nul(F.col("reason")).alias("nul"), scalars.has_reserved(F.col("meta")).alias("reserved"))
