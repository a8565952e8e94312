"""Supersede-and-split: a write log becomes its bitemporal record set.

Writes: kind, entity_id, k (order within the log), tx, valid_from, valid_to, intent, and any
payload: data, actor, reason, meta and whatever else the log carries. Records: kind, entity_id, k
(the write a record's state comes from), valid_from, valid_to, tx_from, tx_to, intent and that
write's payload. A write closes every open record it overlaps and re-opens what is left of each,
to its left and right, as remainders under the write's own instant. Writes whose interval is not
valid write nothing; ``write.checked`` tells them apart beforehand.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import interval
from .read import with_ids

BASE = ["kind", "entity_id", "k", "valid_from", "valid_to", "tx_from", "tx_to", "intent"]
_WRITE = ["kind", "entity_id", "k", "tx", "valid_from", "valid_to", "intent"]
_LOW, _HIGH = -(1 << 70), 1 << 70  # beyond every 64-bit instant; never stored
_TIMES = ("tx", "valid_from", "valid_to")


def payload(df: DataFrame) -> list[str]:
    """The columns that a write hands to its records unchanged."""
    return [c for c in df.columns if c not in (*_WRITE, *BASE, "id")]


class Tiles:
    """The open records of one entity: disjoint, in the order of their starts."""

    def __init__(self):
        self.tiles: list[tuple] = []  # (start, end, born, k, intent, payload)

    def write(self, start, end, tx, k, intent, load):
        """The closed tiles, and the new ones in insert order."""
        tiles = self.tiles
        at = bisect_left(tiles, start, key=lambda x: x[0])
        if at and tiles[at - 1][1] > start:
            at -= 1
        to = at
        while to < len(tiles) and tiles[to][0] < end:
            to += 1
        closed, new = tiles[at:to], [(start, end, tx, k, intent, load)]
        for t in closed:
            if t[0] < start:
                new.append((t[0], start, tx, t[3], 2, t[5]))
            if t[1] > end:
                new.append((end, t[1], tx, t[3], 2, t[5]))
        del tiles[at:to]
        for t in new:
            insort(tiles, t, key=lambda x: x[0])
        return closed, new


def _int(column: pa.Array) -> list:
    return column.cast(pa.int64()).to_pylist()


def replay(writes: DataFrame) -> DataFrame:
    """The record set by one ordered pass over each partition.

    Rows of an entity meet in one task, sorted, and stream through it: memory holds the open
    tiles of one entity, not its history. One shuffle; ties of k keep the smaller instant first.
    """
    types, load = {f.name: f.dataType for f in writes.schema.fields}, payload(writes)
    names, schema = [*BASE, *load], StructType()
    for c in names:
        schema = schema.add(c, types["tx"] if c.startswith("tx_") else types[c])
    source = writes.select(*_WRITE, *load).where(interval.is_valid("valid_from", "valid_to"))
    dealt = source.repartition("kind", "entity_id").sortWithinPartitions("kind", "entity_id", "k", "tx")

    def run(batches):
        out: list[tuple] = []
        entity, open_ = None, Tiles()
        arrow = None

        def done(tiles, until):
            for s, e, born, k, intent, held in tiles:
                out.append((*entity, k, None if s == _LOW else s, None if e == _HIGH else e, born, until, intent, *held))

        def batch_of():
            cols = list(zip(*out)) if out else [[]] * len(names)
            made = [pa.array(c, pa.int64()).cast(t) if n in BASE and pa.types.is_timestamp(t) else pa.array(c, t) for n, c, t in zip(names, cols, arrow)]
            out.clear()
            return pa.RecordBatch.from_arrays(made, names=names)

        for b in batches:
            if arrow is None:
                s = b.schema
                arrow = [s.field("tx" if c.startswith("tx_") else c).type for c in names]
            cols = [(_int(b.column(c)) if c in _TIMES else b.column(c).to_pylist()) for c in (*_WRITE, *load)]
            for kind, eid, k, tx, vf, vt, intent, *held in zip(*cols):
                if (kind, eid) != entity:
                    if entity is not None:
                        done(open_.tiles, None)
                    entity, open_ = (kind, eid), Tiles()
                closed, _ = open_.write(_LOW if vf is None else vf, _HIGH if vt is None else vt, tx, k, intent, held)
                done((t for t in closed if t[2] < tx), tx)
            if len(out) > 20_000:
                yield batch_of()
        if entity is not None:
            done(open_.tiles, None)
            yield batch_of()

    return dealt.mapInArrow(run, schema)


def increment(current: DataFrame | None, writes: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(inserts, closures) that a batch of writes makes on the open records.

    Open records replay as writes at their own instants, ahead of the batch: they are disjoint,
    so none closes another. Of what comes out, records born in the batch are inserts; an open
    record that is no longer in the result as it was has been closed at the instant of the
    first write that touched it. Work follows open tiles and new writes, not history.
    """
    if current is None:
        return with_ids(replay(writes)), None
    load = payload(writes)
    touched = current.join(writes.select("kind", "entity_id").distinct(), ["kind", "entity_id"], "left_semi")
    old = touched.select("kind", "entity_id", (F.col("k") - F.lit(1 << 62)).alias("k"), F.col("tx_from").alias("tx"), "valid_from", "valid_to", "intent", *load)
    out = replay(old.unionByName(writes.select(old.columns)))
    was = F.col("k") < F.lit(-(1 << 61))
    out = out.withColumn("k", F.when(was, F.col("k") + F.lit(1 << 62)).otherwise(F.col("k")))
    key = ["kind", "entity_id", "k", "tx_from", "valid_from", "valid_to"]

    closures = touched.join(out.where("tx_to is not null").select(*key, "tx_to").toDF(*[f"o_{c}" for c in key], "closed"), _same(touched, key)).select("id", F.col("closed").alias("tx_to"))
    born = out.join(touched.select(*key).toDF(*[f"o_{c}" for c in key]), _same(out, key), "left_anti")
    return with_ids(born), closures


def _same(df: DataFrame, key: list[str]):
    on = F.lit(True)
    for c in key:
        on = on & df[c].eqNullSafe(F.col(f"o_{c}"))
    return on


def merge_set(writes: DataFrame) -> DataFrame:
    """The same record set in set operations only.

    The valid axis of an entity is cut at all bounds; a piece of write j dies at the next write
    that covers it. A record is a maximal run of j's pieces that outlive its shortest-lived one,
    born when the first of the pieces beside it died. Work grows with the square of an entity's
    pieces, so this suits logs of few writes per entity; ``replay`` has no such term.
    """
    key = ["kind", "entity_id"]
    low = lambda c: F.struct(F.when(F.col(c).isNull(), -1).otherwise(0).alias("c"), F.col(c).alias("t"))
    high = lambda c: F.struct(F.when(F.col(c).isNull(), 1).otherwise(0).alias("c"), F.col(c).alias("t"))
    w = writes.where(interval.is_valid("valid_from", "valid_to")).withColumns({"lo": low("valid_from"), "hi": high("valid_to")})
    points = w.select(*key, F.explode(F.array("lo", "hi")).alias("p")).distinct()
    cut = points.withColumn("i", F.row_number().over(Window.partitionBy(*key).orderBy("p")))
    cover = w.join(cut, key).where("p >= lo and p < hi")
    after = Window.partitionBy(*key, "i").orderBy("k")
    cover = cover.select(*key, "k", "i", "p", F.lead("k").over(after).alias("d"), F.lead("tx").over(after).alias("dtx"))
    # A piece that outlives the log comes after every write.
    piece = F.struct("i", F.col("d").isNull().alias("never"), "d", "dtx", "p")
    runs = cover.groupBy(*key, "k").agg(F.sort_array(F.collect_list(piece)).alias("ps"))
    sooner = lambda y, x: F.when(y["never"], False).otherwise(x["never"] | (y["d"] < x["d"]))
    around = F.transform(
        "ps",
        lambda x: F.struct(
            x.alias("x"),
            F.element_at(F.concat(F.array(F.lit(None).cast("struct<i:int,never:boolean,d:bigint,dtx:timestamp_ntz,p:struct<c:int,t:timestamp_ntz>>")), F.filter("ps", lambda y: (y["i"] < x["i"]) & sooner(y, x))), -1).alias("l"),
            F.try_element_at(F.filter("ps", lambda y: (y["i"] > x["i"]) & sooner(y, x)), F.lit(1)).alias("r"),
        ),
    )
    flat = runs.select(*key, "k", F.explode(around).alias("a")).select(*key, "k", "a.x.d", F.col("a.x.dtx").alias("tx_to"), F.col("a.l.i").alias("li"), F.col("a.l.dtx").alias("ltx"), F.col("a.r.p").alias("rp"), F.col("a.r.dtx").alias("rtx")).distinct()
    flat = flat.join(cut.select(*key, (F.col("i") - 1).alias("li"), F.col("p").alias("lp")), [*key, "li"], "left")
    out = flat.join(w.select(*key, "k", "tx", "lo", "hi", "intent", *payload(writes)), [*key, "k"])
    born = F.greatest("tx", "ltx", "rtx")
    return out.select(
        *key, "k",
        F.when(F.col("li").isNull(), F.col("lo.t")).otherwise(F.col("lp.t")).alias("valid_from"),
        F.when(F.col("rp").isNull(), F.col("hi.t")).otherwise(F.col("rp.t")).alias("valid_to"),
        born.alias("tx_from"), "tx_to",
        F.when(born == F.col("tx"), F.col("intent")).otherwise(F.lit(2).cast(writes.schema["intent"].dataType)).alias("intent"),
        *payload(writes),
    ).distinct()


def ratchet(rows: DataFrame, clock: str, order: list[str], by: list[str], name: str = "tx_us") -> DataFrame:
    """Strictly increasing instants: the clock, or the last instant plus a microsecond.

    max(clock_i, last + 1) unrolls to i + max over j <= i of (clock_j - j): one running maximum.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    n = F.row_number().over(w)
    return rows.withColumn("_n", n).withColumn(name, F.max(F.col(clock) - F.col("_n")).over(w) + F.col("_n")).drop("_n")
