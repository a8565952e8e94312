"""The log's table in a relational database, read in parallel and written in the same shape."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import check_name

# The columns of such a table.
COLUMNS = [
    "id", "kind", "entity_id", "data", "valid_from", "valid_to", "tx_from", "tx_to",
    "actor_id", "actor_type", "actor_name", "reason", "intent", "meta",
]


def flat(records: DataFrame) -> DataFrame:
    """Records as rows of the table: the actor in three columns, metadata as a JSON text."""
    actor = [F.coalesce(f"actor.{c}", F.lit("")).alias(f"actor_{c}") for c in ("id", "type", "name")]
    meta = F.to_json(F.coalesce("meta", F.create_map().cast("map<string,string>"))).alias("meta")
    return records.select(*COLUMNS[:8], *actor, F.coalesce("reason", F.lit("")).alias("reason"), F.col("intent").cast("smallint").alias("intent"), meta)


def nested(rows: DataFrame) -> DataFrame:
    """Rows of the table as records; empty metadata is null."""
    meta = F.from_json("meta", "map<string,string>")
    actor = F.struct(*[F.col(f"actor_{c}").alias(c) for c in ("id", "type", "name")]).alias("actor")
    times = [F.col(c).cast("timestamp_ntz").alias(c) for c in COLUMNS[4:8]]
    return rows.select(*COLUMNS[:4], *times, actor, "reason", F.col("intent").cast("int").alias("intent"), F.when(F.size(meta) > 0, meta).alias("meta"))


def read(spark: SparkSession, url: str, table: str, partitions: int = 1, lower: str | None = None, upper: str | None = None, **options: str) -> DataFrame:
    """The records of a table; filters on its columns go to the database. With ``partitions``, ranges of
    tx_from between lower and upper are read side by side."""
    check_name(table.rsplit(".", 1)[-1])
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if partitions > 1:
        reader = reader.options(partitionColumn="tx_from", lowerBound=lower, upperBound=upper, numPartitions=str(partitions))
    rows = reader.load()
    return nested(rows.select(*[F.col(c).alias(c.lower()) for c in rows.columns]))


def write(records: DataFrame, url: str, table: str, **options: str) -> None:
    check_name(table.rsplit(".", 1)[-1])
    flat(records).write.format("jdbc").option("url", url).option("dbtable", table).options(**options).mode("append").save()


