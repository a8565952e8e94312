"""Structural diffs and field histories. Documents are decoded in Arrow batches, numbers exactly."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import interval
from ..functions.jsonexact import ABSENT, Codec, canonical, encode, parse_pointer, value_at
from .read import get


def diffs(pairs: DataFrame, keys: list[str], codec: Codec = Codec()) -> DataFrame:
    """keys and (position, path, op, old, new) of pairs(keys, before, after); a null document is
    absent, and one that cannot be decoded is an error, never an empty diff."""
    fields = ", ".join(f"{k} {pairs.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches):
        for b in batches:
            rows = []
            for *key, x, y in zip(*(b.column(i).to_pylist() for i in range(b.num_columns))):
                rows += [(*key, n, *change) for n, change in enumerate(codec.changes(x, y))]
            types = [b.schema.field(k).type for k in keys] + [pa.int32()] + [pa.string()] * 4
            cols = list(zip(*rows)) if rows else [[]] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=[*keys, "position", "path", "op", "old", "new"])

    return pairs.select(*keys, "before", "after").mapInArrow(run, f"{fields}, position int, path string, op string, old string, new string")


def diff_points(records: DataFrame, entities: DataFrame, a: tuple, b: tuple) -> DataFrame:
    """The diff of every entity between two points (valid_at, tx_at); entities absent at both give nothing."""

    def at(point, name):
        probes = entities.select("kind", "entity_id", F.lit(point[0]).alias("valid_at"), F.lit(point[1]).alias("tx_at"))
        return get(records, probes).select("kind", "entity_id", F.col("data").alias(name))

    return diffs(at(a, "before").join(at(b, "after"), ["kind", "entity_id"], "full"), ["kind", "entity_id"])


def values_at(records: DataFrame, path: str, codec: Codec = Codec()) -> DataFrame:
    """records with present, value (as written) and canon of one JSON path."""
    tokens = parse_pointer(path)

    @F.udf("struct<present:boolean,value:string,canon:string>", useArrow=True)
    def one(data):
        v = value_at(codec.decode(data), tokens)
        return (False, None, None) if v is ABSENT else (True, encode(v), canonical(v))

    return records.withColumn("_v", one("data")).select(*records.columns, "_v.present", "_v.value", "_v.canon")


def field_history(records: DataFrame, path: str, valid_at=None, descending: bool = False, codec: Codec = Codec()) -> DataFrame:
    """Every change of one path at a valid instant (all records given if None) along transaction time, from absent on."""
    rows = values_at(records if valid_at is None else records.where(interval.contains("valid_from", "valid_to", valid_at)), path, codec)
    w = Window.partitionBy("kind", "entity_id").orderBy("tx_from", "valid_from", "id")
    rows = rows.withColumns({"from_present": F.coalesce(F.lag("present").over(w), F.lit(False)), "from_value": F.lag("value").over(w), "_c": F.lag("canon").over(w)})
    changed = (F.col("present") != F.col("from_present")) | (F.col("present") & ~F.col("canon").eqNullSafe(F.col("_c")))
    rows = rows.where(changed)
    at = Window.partitionBy("kind", "entity_id").orderBy(*[F.desc(c) if descending else F.asc(c) for c in ("tx_from", "valid_from", "id")])
    return rows.select("kind", "entity_id", F.row_number().over(at).alias("position"), "tx_from", "actor", "intent", "from_present", "from_value", F.col("present").alias("to_present"), F.col("value").alias("to_value"))
