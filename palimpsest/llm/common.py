"""Shared plumbing: settled intermediate tables, table loading, and the document key."""

from __future__ import annotations

import atexit
import copy
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor shares: ``spark.checkpoint.dir`` of the session.

    A session of one machine that names none (tests) gets a temporary folder, which is removed
    when Python ends; on a cluster that folder would be out of the executors' sight, so there
    it is an error to name none.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = tempfile.mkdtemp(prefix="palimpsest-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{own}")
    return f"file://{own}"


class Settled:
    """Intermediate tables written as Parquet in the shared folder.

    Writing a table and reading it again cuts the lineage: a lost executor costs the running
    stage only, and non-deterministic order upstream cannot change what later stages see.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/palimpsest/{name}-{uuid.uuid4().hex}"
        self.n = 0

    def __call__(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        # Nothing reads the shuffle files of a finished write again: they go with it, not with the driver's garbage.
        was = self.spark.conf.get(_CLEANUP, "false")
        self.spark.conf.set(_CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(_CLEANUP, was)
        return self.spark.read.schema(df.schema).parquet(path)

    def part(self) -> Settled:
        """The tables of one operator, apart from the caller's."""
        self.n += 1
        out = copy.copy(self)
        out.root, out.n = f"{self.root}/{self.n}", 0
        return out

    def last(self, df: DataFrame) -> DataFrame:
        """Write the result of this part; all that it settled before goes."""
        out = self(df)
        for n in range(1, self.n):
            self._remove(f"{self.root}/{n}")
        return out

    def drop(self, df: DataFrame) -> None:
        """Remove a settled table that no later plan reads."""
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            self._remove(folder)

    def _remove(self, folder: str) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(column: str, n: int):
    """crc32 of a value's decimal text, modulo n; null counts as the text ''."""
    return F.crc32(F.encode(F.coalesce(F.col(column).cast("string"), F.lit("")), "utf-8")) % n


HOT = 4096  # a group that holds more than so small a part of all rows is joined by broadcast


def meet(rows: DataFrame, groups: DataFrame, keys: list[str], total: int, hot: int = HOT) -> DataFrame:
    """rows joined to groups(keys, n, ...), where n counts the rows of a group, of ``total`` in all.

    A group of over total / hot rows would put them into one task. There are fewer than ``hot``
    such groups whatever the table, so they are broadcast; the others are merged.
    """
    large = groups.where(F.col("n") * hot > total)
    rest = rows.join(F.broadcast(large.select(*keys)), keys, "left_anti")
    cold = rest.hint("merge").join(groups.where(F.col("n") * hot <= total), keys)
    return rows.join(F.broadcast(large), keys).unionByName(cold)


BLOCK = 1024  # entries of one side of a comparison


def block_pairs(entries: DataFrame, group: str, settle: Settled, block: int = BLOCK) -> DataFrame:
    """Deal the entries(key, ...) of each key into pairs of blocks that cover all pairs of unlike groups.

    A group of more than ``block`` entries of a key gets blocks of its own, the rest share
    blocks; an entry goes only to pairs of blocks that can hold a pair it belongs to, so a large
    group is never compared with itself. Adds lo and hi (the pair of blocks) and side (0: the
    pair is one block with itself, 1: the entry is in lo, 2: in hi). Blocks hold about ``block``
    rows however large the key is: they are cut by a hash of the entry's ``id``.
    """
    sizes = entries.groupBy("key", group).agg(F.count(F.lit(1)).alias("m"))
    own = sizes.withColumn("g", F.when(F.col("m") > block, F.col(group)))  # null: shares blocks
    parts = own.groupBy("key", "g").agg(F.ceil(F.sum("m") / block).cast("int").alias("cuts"), F.count(F.lit(1)).alias("groups"))
    parts = parts.groupBy("key").agg(F.collect_list(F.struct("g", "cuts")).alias("parts"), F.sum("groups").alias("groups"))
    at = entries.join(settle(parts.where("groups > 1").drop("groups")), "key")
    mine = lambda g: F.filter("parts", lambda p: p["g"].eqNullSafe(g))
    at = at.withColumn("mine", F.coalesce(F.try_element_at(mine(F.col(group)), F.lit(1)), F.try_element_at(mine(F.lit(None).cast("long")), F.lit(1))))
    at = at.withColumn("me", F.struct(F.col("mine.g").alias("g"), F.pmod(F.xxhash64("id"), F.col("mine.cuts")).cast("int").alias("c")))
    others = F.filter("parts", lambda p: p["g"].isNull() | ~p["g"].eqNullSafe(F.col("mine.g")))
    blocks = F.flatten(F.transform(others, lambda p: F.transform(F.sequence(F.lit(0), p["cuts"] - 1), lambda c: F.struct(p["g"].alias("g"), c.alias("c")))))
    at = at.withColumn("you", F.explode(blocks))
    side = F.when(F.col("me").eqNullSafe(F.col("you")), 0).when(F.col("me") < F.col("you"), 1).otherwise(2)
    return at.select(*entries.columns, F.least("me", "you").alias("lo"), F.greatest("me", "you").alias("hi"), side.alias("side"))


def big_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes as well as rows, so long texts do not pile up."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
