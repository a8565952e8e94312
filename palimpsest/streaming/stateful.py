"""The merge as a stateful stream: the open tiles of each entity are its state, and no store is read.

Rows come out as soon as they are known: records, and closures of records that an earlier batch put
out. ``start`` writes both to a store; others may split them as they like. State grows with open
tiles, not with history. Needs the RocksDB state store (``PROVIDER``).
"""

from __future__ import annotations

import hashlib
import pickle
import threading
from collections.abc import Iterator
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import BooleanType, StringType, StructType

from ..operators.merge import BASE, Tiles, payload
from ..sources.store import Store

PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
_LOW, _HIGH = datetime.min, datetime.max  # within the state only


def _micros(t: datetime) -> int:
    return (t - datetime(1970, 1, 1)) // timedelta(microseconds=1)


def _id(start, born, k, mark) -> str:
    """As ``read.record_id``."""
    return f"{k:012d}-{_micros(born)}-{'min' if start == _LOW else _micros(start)}-{mark}"


class Merge(StatefulProcessor):
    def __init__(self, names: list[str], load: list[str]):
        self.names, self.load = names, load

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("tiles", "tiles binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:
        kind, entity = key
        mark = hashlib.sha256(f"{kind}\x1f{entity}".encode()).hexdigest()[:10]
        tiles = Tiles()
        if self.state.exists():
            tiles.tiles = pickle.loads(self.state.get()[0])
        none = lambda v: None if v is None or v is pd.NaT else v.to_pydatetime()
        made, closed = {}, []
        for r in pd.concat(list(rows)).sort_values(["k", "tx"]).itertuples(index=False):
            a, b, tx, k = none(r.valid_from), none(r.valid_to), none(r.tx), int(r.k)
            if a is not None and b is not None and a >= b:
                continue
            gone, new = tiles.write(a or _LOW, b or _HIGH, tx, k, int(r.intent), tuple(getattr(r, c) for c in self.load))
            for t in gone:
                name = _id(t[0], t[2], t[3], mark)
                if name in made:
                    made[name]["tx_to"] = tx
                else:
                    closed.append({"id": name, "kind": kind, "entity_id": entity, "tx_to": tx, "closure": True})
            for s, e, born, origin, intent, held in new:
                row = {"id": _id(s, born, origin, mark), "kind": kind, "entity_id": entity, "k": origin, "valid_from": None if s == _LOW else s, "valid_to": None if e == _HIGH else e, "tx_from": born, "tx_to": None, "intent": intent, "closure": False}
                made[row["id"]] = row | dict(zip(self.load, held))
        self.state.update((pickle.dumps(tiles.tiles),))
        yield pd.DataFrame([*made.values(), *closed], columns=self.names)

    def close(self) -> None:
        pass


def merged(writes: DataFrame) -> DataFrame:
    """(id, record columns, closure) of a streaming DataFrame of writes; of a closure only id, kind, entity_id and
    tx_to are set. Instants of an entity must grow from batch to batch, as ``write.instants`` makes them."""
    types, load = {f.name: f.dataType for f in writes.schema.fields}, payload(writes)
    schema = StructType().add("id", StringType())
    for c in [*BASE, *load]:
        schema = schema.add(c, types["tx"] if c.startswith("tx_") else types[c])
    schema = schema.add("closure", BooleanType())
    return writes.groupBy("kind", "entity_id").transformWithStateInPandas(statefulProcessor=Merge(schema.names, load), outputStructType=schema, outputMode="Append", timeMode="None")


def start(writes: DataFrame, store: Store, checkpoint: str, **trigger) -> StreamingQuery:
    """Put the merged stream into ``store``; a replayed batch is a no-op."""
    known, named = [], threading.Event()

    def publish(batch: DataFrame, number: int) -> None:
        named.wait(60)
        batch = batch.persist()
        try:
            records, closures = batch.where("not closure").drop("closure"), batch.where("closure").select("id", "tx_to")
            store.apply(lambda _: (records, closures), batch=(known[0], number))
        finally:
            batch.unpersist()

    query = merged(writes).writeStream.foreachBatch(publish).outputMode("append").option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    known.append(query.id)
    named.set()
    return query
