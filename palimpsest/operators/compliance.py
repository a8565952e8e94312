"""Legal holds, retention, hash chains and per-subject encryption."""

from __future__ import annotations

import hashlib
from datetime import timedelta

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import interval
from ..functions.errors import HistoryError
from ..functions.scalars import META_CHAIN, META_CIPHER, META_SUBJECT, byte, prefixed, uvarint

CHAIN_ORDER = ["tx_from", "valid_from", "id"]
TOKEN = "v1:"


def check_policies(policies: list[tuple[str, timedelta]]) -> None:
    """(kind, how long to keep); each kind once."""
    if not policies:
        raise HistoryError("no_policy")
    kinds = [k for k, _ in policies]
    if "" in kinds or len(set(kinds)) < len(kinds) or any(keep <= timedelta(0) for _, keep in policies):
        raise HistoryError("invalid_policy")


def policy_table(spark, policies: list[tuple[str, timedelta]]) -> DataFrame:
    check_policies(policies)
    return spark.createDataFrame(policies, "kind string, keep interval day to second")


def active_holds(holds: DataFrame, now) -> DataFrame:
    """holds(hold_id, kind, entity_id, effective_from, placed_at, released_at) that bite at now."""
    return holds.where(interval.contains("effective_from", "released_at", now))


def held(records: DataFrame, holds: DataFrame, now) -> DataFrame:
    """records with hold_id: the first active hold in placement order that covers their entity.

    An empty kind or entity_id of a hold covers all. The four shapes are four equi-joins on
    aggregated holds, so many holds need no nested loop.
    """
    first = F.min(F.struct("placed_at", "hold_id"))
    by = active_holds(holds, now).groupBy("kind", "entity_id").agg(first.alias("h"))
    out = records
    for n, (kind, entity) in enumerate(((True, True), (True, False), (False, True), (False, False))):
        some = by.where((F.col("kind") != "" if kind else F.col("kind") == "") & (F.col("entity_id") != "" if entity else F.col("entity_id") == ""))
        keys = [c for c, has in (("kind", kind), ("entity_id", entity)) if has]
        some = some.select(*keys, F.col("h").alias(f"_h{n}"))
        out = out.join(some, keys, "left") if keys else out.crossJoin(F.broadcast(some.agg(F.min(f"_h{n}").alias(f"_h{n}"))))  # one row
    return out.withColumn("hold_id", F.array_min(F.filter(F.array(*[f"_h{n}" for n in range(4)]), lambda h: h.isNotNull()))["hold_id"]).drop(*[f"_h{n}" for n in range(4)])


def retention(records: DataFrame, policies: DataFrame, holds: DataFrame, now) -> DataFrame:
    """records of a policy's kind that it examines, with eligible, hold_id and action.

    Age runs from tx_to, the boundary included; a current record never is eligible.
    policies(kind, keep): keep is a day-time interval.
    """
    seen = records.join(policies, "kind").withColumn("cutoff", F.lit(now) - F.col("keep")).where("tx_from < cutoff")
    seen = seen.withColumn("eligible", F.col("tx_to").isNotNull() & (F.col("tx_to") <= F.col("cutoff")))
    seen = held(seen, holds, now)
    action = F.when(~F.col("eligible"), "keep").when(F.col("hold_id").isNotNull(), "withhold").otherwise("delete")
    return seen.withColumn("action", action).drop("keep", "cutoff")


def retention_report(planned: DataFrame) -> DataFrame:
    """Per kind: examined, deleted, withheld and, where records carry a token, tombstones left."""
    gone = F.col("action") == "delete"
    counts = [F.count(F.lit(1)).alias("examined"), F.count_if(gone).alias("deleted"), F.count_if(F.col("action") == "withhold").alias("withheld")]
    if "token" in planned.columns:
        counts.append(F.count_if(gone & F.col("token").isNotNull()).alias("tombstones"))
    return planned.groupBy("kind").agg(*counts)


def canonical(records: DataFrame) -> Column:
    """The bytes of a record's immutable fields, each with its length in front, so that no two records
    share them: a version byte; id, kind, entity, data, both valid ends and the first instant; the
    actor's id, type and name; the reason; a byte of intent; and the sorted metadata but for the
    chain's own key. An end that is null is empty, which no bounded end is; null and '' of a text
    are one, as a log stores neither apart."""
    actor = records.schema["actor"].dataType
    who = [F.col(f"actor.{c}") for c in ("id", "type", "name")] if isinstance(actor, StructType) else [F.col("actor"), F.lit(""), F.lit("")]
    time = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    fields = [F.col("id"), F.col("kind"), F.col("entity_id"), F.col("data"), time("valid_from"), time("valid_to"), time("tx_from"), *who, F.col("reason") if "reason" in records.columns else F.lit("")]
    meta = F.lit(b"\0").cast("binary")
    if "meta" in records.columns:
        keys = F.sort_array(F.filter(F.map_keys("meta"), lambda k: k != META_CHAIN))
        pairs = F.aggregate(keys, F.lit(b"").cast("binary"), lambda out, k: F.concat(out, prefixed(k), prefixed(F.element_at("meta", k))))
        meta = F.coalesce(F.concat(uvarint(F.size(keys), 5), pairs), meta)
    return F.concat(F.lit(b"\1").cast("binary"), *map(prefixed, fields), byte(F.col("intent")), meta)


def genesis(kind: Column, entity: Column) -> Column:
    """What an entity's first link is tied to: a chain moved from another entity fails there."""
    return F.unhex(F.sha2(F.concat(F.lit("palimpsest/chain/v1"), F.lit("\x1f"), kind, F.lit("\x1f"), entity), 256))


def stamp(records: DataFrame, tails: DataFrame | None = None) -> DataFrame:
    """records with token: each links to the one before in the total order of its entity.

    tails(kind, entity_id, token): where each entity's stored chain ends; entities without one, or
    without a readable token, start from their genesis. So a batch of new records is linked on
    without its entities' history being read. One sorted pass per partition: a chain of any length
    takes constant memory.
    """
    base = records.drop("token")
    source = base.withColumn("_canon", canonical(base)).withColumn("_start", genesis(F.col("kind"), F.col("entity_id")))
    if tails is not None:
        known = tails.select("kind", "entity_id", F.unhex(_hash("token")).alias("_tail"))
        source = source.join(known, ["kind", "entity_id"], "left").withColumn("_start", F.coalesce("_tail", "_start")).drop("_tail")
    source = source.select(*base.columns, "_canon", "_start")
    dealt = source.repartition("kind", "entity_id").sortWithinPartitions("kind", "entity_id", *CHAIN_ORDER)
    names = base.columns

    def run(batches):
        entity, last = None, b""
        for b in batches:
            tokens = []
            for kind, eid, canon, start in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("kind", "entity_id", "_canon", "_start"))):
                if (kind, eid) != entity:
                    entity, last = (kind, eid), start
                last = hashlib.sha256(last + canon).digest()
                tokens.append(TOKEN + last.hex())
            keep = [b.column(b.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(tokens, pa.string())], names=[*names, "token"])

    return dealt.mapInArrow(run, StructType([*base.schema.fields, StructField("token", StringType())]))


def _hash(token: str) -> Column:
    """The hex digits of a readable token, else null."""
    return F.when(F.col(token).rlike("^v1:[0-9a-f]{64}$"), F.substring(token, len(TOKEN) + 1, 64))


def chain_head(entries: DataFrame) -> DataFrame:
    """(kind, entity_id, head): the last readable token of each entity, unverified; null if it has none."""
    place = F.struct(*CHAIN_ORDER)
    return entries.groupBy("kind", "entity_id").agg(F.max_by("token", F.when(_hash("token").isNotNull(), place)).alias("head"))


def verify(entries: DataFrame) -> DataFrame:
    """One row per entity: entries, chained, tombstones, unchained (records before the chain began), status
    (intact, broken or no_chain), position and id of the first divergence, and the head if intact.

    Entries are records with their tokens, and tombstones (``tombstone`` true), whose stored hash
    is taken as it is; counts stop at the divergence. A window finds the previous parseable
    token, so the fold is not repeated: before the first failure stored and computed tokens
    agree. Where the links hold, a closed record must have been closed by an entry that is still
    there and later than its own: otherwise its end was moved, and the position is 0.
    """
    if "tombstone" not in entries.columns:
        entries = entries.withColumn("tombstone", F.lit(False))
    entity = ["kind", "entity_id"]
    w = Window.partitionBy(*entity).orderBy(*CHAIN_ORDER)
    rows = entries.withColumn("_hash", _hash("token")).withColumn("position", F.row_number().over(w))
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    prev = F.coalesce(F.unhex(F.last("_hash", ignorenulls=True).over(before)), genesis(F.col("kind"), F.col("entity_id")))
    in_chain = F.col("token").isNotNull() | F.col("tombstone")
    begun = F.coalesce(F.max(in_chain.cast("int")).over(before), F.lit(0)) == 1
    linked = F.coalesce(F.col("_hash") == F.sha2(F.concat(prev, canonical(entries)), 256), F.lit(False))
    rows = rows.withColumns({"_begun": begun, "_ok": F.when(F.col("tombstone"), F.col("_hash").isNotNull()).when(F.col("token").isNull(), ~begun).otherwise(linked)})
    rows = rows.withColumn("_stop", F.min(F.when(~F.col("_ok"), F.col("position"))).over(Window.partitionBy(*entity)))
    seen = F.col("_stop").isNull() | (F.col("position") < F.col("_stop"))
    bad = F.min(F.when(~F.col("_ok"), F.struct("position", "id")))
    head = F.max_by("token", F.when(F.col("_hash").isNotNull(), F.col("position")))
    # Instants at which an entry of the chain began: every end of a chained record is one of them.
    starts = entries.where(in_chain).select(*entity, F.col("tx_from").alias("tx_to"), F.lit(True).alias("_met")).distinct()
    rows = rows.join(starts, [*entity, "tx_to"], "left")
    moved = F.col("token").isNotNull() & ~F.col("tombstone") & F.col("tx_to").isNotNull() & (F.col("_met").isNull() | (F.col("tx_to") <= F.col("tx_from")))
    out = rows.groupBy(*entity).agg(
        F.count(F.lit(1)).alias("entries"), F.count_if(seen & F.col("token").isNotNull() & ~F.col("tombstone")).alias("chained"), F.count_if(seen & F.col("tombstone")).alias("tombstones"),
        F.count_if(seen & ~F.col("_begun") & ~in_chain).alias("unchained"), bad.alias("bad"), F.min(F.when(moved, F.struct("position", "id"))).alias("moved"), head.alias("head"),
    )
    broken = F.col("bad").isNotNull() | F.col("moved").isNotNull()
    status = F.when(broken, "broken").when(F.col("chained") + F.col("tombstones") == 0, "no_chain").otherwise("intact")
    place = F.when(F.col("bad").isNotNull(), F.col("bad.position")).when(F.col("moved").isNotNull(), 0)
    return out.select(*entity, "entries", "chained", "tombstones", "unchained", status.alias("status"), place.alias("position"), F.coalesce("bad.id", "moved.id").alias("bad_id"), F.when(~broken, F.col("head")).alias("head"))


SCHEME = "aes-256-gcm-1"  # what META_CIPHER of a sealed record says


def _aad() -> Column:
    return F.concat_ws("\x1f", F.lit(SCHEME), "kind", "entity_id")


def sealed(writes: DataFrame) -> DataFrame:
    """writes(subject, key, ...) with data encrypted under their subject's key and metadata that says so; rows
    without a subject stay plain. The nonce is random: write the result before anything hashes
    it, as a retried task draws anew."""
    secret = F.aes_encrypt(F.col("data").cast("binary"), "key", F.lit("GCM"), F.lit("DEFAULT"), F.lit(b"").cast("binary"), _aad())
    has, base = F.col("subject").isNotNull(), F.coalesce("meta", F.create_map().cast("map<string,string>"))
    kept = F.map_filter(base, lambda k, _: ~k.isin(META_SUBJECT, META_CIPHER))
    meta = F.map_concat(kept, F.create_map(F.lit(META_SUBJECT), F.col("subject"), F.lit(META_CIPHER), F.lit(SCHEME)))
    return writes.withColumns({"data": F.when(has, secret).otherwise(F.col("data").cast("binary")), "meta": F.when(has, meta).when(F.size("meta") > 0, F.col("meta"))})


def opened(records: DataFrame, keys: DataFrame | None) -> DataFrame:
    """records with status and data in the clear: plain, open, shredded (the key was destroyed), no_keyring
    (none, or no such key), unknown_cipher, or codec (authentication failed); but for the first two
    data is null. keys(subject, key): a destroyed key is null."""
    keys = records.sparkSession.createDataFrame([], "subject string, key binary") if keys is None else keys
    found = keys.select(F.col("subject").alias("_subject"), F.col("key").alias("_key"), F.lit(True).alias("_known"))
    out = records.withColumns({"_subject": F.try_element_at("meta", F.lit(META_SUBJECT)), "_cipher": F.try_element_at("meta", F.lit(META_CIPHER))}).join(found, "_subject", "left")
    clear = F.try_aes_decrypt("data", "_key", F.lit("GCM"), F.lit("DEFAULT"), _aad())
    status = F.when(F.col("_cipher").isNull(), "plain").when(F.col("_cipher") != SCHEME, "unknown_cipher").when(F.col("_known").isNull(), "no_keyring").when(F.col("_key").isNull(), "shredded").when(clear.isNull(), "codec").otherwise("open")
    return out.withColumn("status", status).withColumn("data", F.when(F.col("status") == "plain", F.col("data")).when(F.col("status") == "open", clear)).select(*records.columns, "status")


def refuse(status: str) -> None:
    """Raise what a reader of one record must hear of its status."""
    if status not in ("plain", "open"):
        raise HistoryError(status if status in ("shredded", "no_keyring") else "codec", status)
