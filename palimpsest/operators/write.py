"""What a write must hold before it reaches the log, and what it is given there.

Writes: kind, entity_id, data, valid_from, valid_to, actor struct<id, type, name>, reason,
meta map<string, string>, intent, and, if they are to be sealed, subject.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import interval
from ..functions.scalars import has_nul, has_reserved
from .merge import ratchet

def error_code(kinds: list[str] | None = None, keyring: bool = False, subject: bool = False) -> Column:
    """The first rule that a write breaks, in the order in which they are checked; null if none.

    kinds: those that are known, all but '' if None. subject: whether the writes have that column.
    """
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    unknown = empty("kind") if kinds is None else empty("kind") | ~F.col("kind").isin(*kinds)
    out = F.when(unknown, "unknown_kind").when(empty("entity_id"), "missing_entity_id").when(empty("actor.id"), "missing_actor")
    for c in ("kind", "entity_id", "actor.id", "actor.type", "actor.name"):
        out = out.when(has_nul(F.col(c)), "invalid_field")
    out = out.when(~F.coalesce(interval.is_valid("valid_from", "valid_to"), F.lit(True)), "invalid_interval").when(has_nul(F.col("reason")), "invalid_field")
    nul = F.exists(F.map_keys("meta"), has_nul) | F.exists(F.map_values("meta"), has_nul)
    out = out.when(has_reserved(F.col("meta")), "reserved_meta").when(F.coalesce(nul, F.lit(False)), "invalid_meta")
    out = out.when(~F.col("intent").isin(0, 1), "unknown_intent")  # remainders are the log's own
    if subject:
        has = F.coalesce(F.col("subject"), F.lit("")) != ""
        out = out.when(has, F.when(F.lit(not keyring), "no_keyring").when(F.col("key").isNull(), "key_destroyed")) if keyring else out.when(has, "no_keyring")
    return out


def checked(writes: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """writes with error_code. Those without one go on; the others are for the caller to look at, and change nothing."""
    return writes.withColumn("error_code", error_code(kinds))


def instants(writes: DataFrame, newest: DataFrame | None, clock: str = "clock_us", order: str = "k") -> DataFrame:
    """writes with tx: per entity strictly increasing, never before the clock nor at or before what the
    entity's log holds. newest: kind, entity_id, tx_us (the last instant of each entity)."""
    key = ["kind", "entity_id"]
    if newest is not None:
        writes = writes.join(newest.select(*key, "tx_us"), key, "left").withColumn(clock, F.greatest(F.col(clock), F.col("tx_us") + 1)).drop("tx_us")
    return ratchet(writes, clock, [order], key).withColumn("tx", F.timestamp_micros("tx_us").cast("timestamp_ntz")).drop("tx_us")
