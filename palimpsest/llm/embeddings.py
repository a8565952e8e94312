"""Near-duplicate embeddings: random-hyperplane hashing, exact cosines, connected components."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Settled, big_batches, block_pairs, meet
from .components import components
from .words import U64, mix

MISS = 0.01  # the share of pairs right at the threshold that meet in no table; above it fewer do
SMALL = 32  # entries up to which a bucket lists its pairs: their number stays in proportion
SKETCH = 128  # signs that sort listed pairs before any vector moves
BLOCK = 1024  # vectors of one side of a comparison
_TABLE = (1 << 10) - 1  # the low bits of a bucket's key hold its table


def shape(n: int, least: float) -> tuple[int, int]:
    """(tables, bits) for n vectors.

    A bit for each doubling of the table keeps buckets at about one unrelated vector, so
    comparisons grow with the number of entries and not with its square. A pair at ``least``
    agrees in all bits with probability (1 - angle / pi) ** bits; the tables are as many as it
    takes for one of them to hold it but for MISS. Their number grows as n to the power 0.22 at 0.9.
    """
    bits = min(40, max(8, math.ceil(math.log2(max(2, n)))))
    return min(_TABLE, math.ceil(math.log(MISS) / math.log1p(-((1 - math.acos(least) / math.pi) ** bits)))), bits


def planes(dim: int, bits: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).normal(size=(dim, bits))


def _units(column: pa.Array) -> np.ndarray:
    """The vectors of one length at unit length, in double precision."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # neither tiny nor huge components leave the range
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _packed(signs: np.ndarray) -> np.ndarray:
    return signs @ (1 << np.arange(signs.shape[-1], dtype=np.int64))


def _coded(tables: int, bits: int):
    table = np.arange(tables, dtype=np.uint64)

    def run(batches):
        for batch in batches:
            size = batch.column("vec").value_lengths().to_numpy()
            for dim in np.unique(size):  # vectors of unlike length are not compared
                part = batch.filter(pa.array(size == dim))
                x = _units(part.column("vec"))
                codes = _packed((x @ planes(dim, tables * bits, 17) > 0).reshape(len(x), tables, bits)).astype(np.uint64)
                keys = mix(mix(codes + (U64(dim) << U64(44))) + table) & ~U64(_TABLE) | table
                fine = mix(_packed(x @ planes(dim, bits + 4, 23) > 0).astype(np.uint64) + (U64(dim) << U64(44)))
                sketch = np.packbits(x @ planes(dim, SKETCH, 29) > 0, axis=1).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(x) * tables + 1, tables, dtype=np.int32)), pa.array(keys.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in ("rep", "n", "vec")), lists, pa.array(fine.view(np.int64)), pa.array(sketch[:, 0].copy()), pa.array(sketch[:, 1].copy())],
                    names=["rep", "n", "vec", "keys", "cell", "s1", "s2"],
                )

    return run


def _near(half: float):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                rep, first = batch.column("rep").to_numpy(), batch.column("first").to_numpy()
                ball = np.where(_cosines(batch.column("vec"), batch.column("lead")) >= half, first, rep)
                yield pa.RecordBatch.from_arrays([pa.array(rep), pa.array(ball)], names=["rep", "ball"])

    return run


def _cosines(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Of rows whose vectors have one length; -1 of others."""
    m, n = a.value_lengths().to_numpy(), b.value_lengths().to_numpy()
    out = np.full(len(m), -1.0)
    for dim in np.unique(m[m == n]):
        at = np.flatnonzero((m == dim) & (n == dim))
        x, y = (_units(c.take(pa.array(at))) for c in (a, b))
        out[at] = (x * y).sum(axis=1)
    return out


def _listed(least: float):
    """Pairs of small buckets whose sketches agree. Rows come sorted by key; many buckets are compared at once."""
    p = math.acos(least) / math.pi
    limit = SKETCH * p + 4.5 * math.sqrt(SKETCH * p * (1 - p))
    names = ["key", "id", "ball", "s1", "s2"]

    def pairs(cols):
        key, rep, ball, s1, s2 = *cols[:3], *(c.view(np.uint64) for c in cols[3:])  # signs, not a number's magnitude
        heads, tails = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for d in range(1, SMALL):
            i = np.flatnonzero(key[d:] == key[:-d])
            if not len(i):
                break
            i = i[ball[i] != ball[i + d]]
            i = i[np.bitwise_count(s1[i] ^ s1[i + d]).astype(int) + np.bitwise_count(s2[i] ^ s2[i + d]) <= limit]
            heads.append(rep[i])
            tails.append(rep[i + d])
        a, b = np.concatenate(heads), np.concatenate(tails)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["src", "dst"])

    def run(batches):
        rest = None
        for batch in batches:
            cols = [batch.column(c).to_numpy() for c in names]
            if rest is not None:
                cols = [np.concatenate(x) for x in zip(rest, cols)]
            if not len(cols[0]):
                continue
            cut = int(np.searchsorted(cols[0], cols[0][-1]))  # the last bucket may go on in the next batch
            rest = [c[cut:] for c in cols]
            if cut:
                yield pairs([c[:cut] for c in cols])
        if rest is not None:
            yield pairs(rest)

    return run


def _exact(least: float):
    """Both ends of each pair that is a link, with how many rows the other end stands for."""

    def run(batches):
        for batch in batches:
            ok = pa.array(_cosines(batch.column("a"), batch.column("b")) >= least)
            some = batch.filter(ok)
            ends = [pa.concat_arrays([some.column(x), some.column(y)]) for x, y in (("src", "dst"), ("dst", "src"), ("n_dst", "n_src"))]
            yield pa.RecordBatch.from_arrays(ends, names=["rep", "other", "links"])

    return run


def _compared(least: float):
    """Links of one pair of blocks of a large bucket, each counted once over all buckets.

    A pair that meets in a small bucket is listed there; any other counts in the first table
    where it meets in a large one. Counts and a spanning forest come back, not pairs.
    """

    def run(table: pa.Table) -> pa.Table:
        side, t = table.column("side").to_numpy(), int(table.column("key")[0].as_py()) & _TABLE
        x = _units(table.column("vec").combine_chunks())
        keys = table.column("keys").combine_chunks().flatten().to_numpy().reshape(len(x), -1)
        large = np.zeros(keys.shape, bool)
        hot = table.column("hot").combine_chunks()
        large[np.repeat(np.arange(len(x)), hot.value_lengths().to_numpy()), hot.flatten().to_numpy() & _TABLE] = True
        rep, n, ball = (table.column(c).to_numpy() for c in ("id", "n", "ball"))
        left, right = np.flatnonzero(side != 2), np.flatnonzero(side != 1)
        within = side[0] == 0
        heads, tails = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for at in range(0, len(left), 256):
            some = left[at : at + 256]
            near = (x[some] @ x[right].T >= least) & (ball[some][:, None] != ball[right][None, :])
            if within:
                near &= rep[some][:, None] < rep[right][None, :]
            i, j = np.nonzero(near)
            i, j = some[i], right[j]
            for k in range(keys.shape[1]):
                if k != t and len(i):
                    fresh = keys[i, k] != keys[j, k]
                    if k > t:
                        fresh |= large[i, k]
                    i, j = i[fresh], j[fresh]
            heads.append(i)
            tails.append(j)
        i, j = np.concatenate(heads), np.concatenate(tails)
        links = np.bincount(i, n[j], len(rep)) + np.bincount(j, n[i], len(rep))
        root = np.arange(len(rep))
        while True:  # the smallest row reachable within this pair of blocks
            low, was = np.minimum(root[i], root[j]), root.copy()
            np.minimum.at(root, i, low)
            np.minimum.at(root, j, low)
            root = root[root]
            if (root == was).all():
                break
        has = links > 0
        return pa.table({"rep": rep[has], "other": rep[root[has]], "links": links[has].astype(np.int64)})

    return run


def similar_embeddings(vectors: DataFrame, settle: Settled, least: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept): a row for each row of vectors.

    * Vectors that are null, empty, zero or hold a null or a non-finite component, and rows with
      a null id, link with nothing. Equal vectors are compared once, and count as often as they
      occur. An id that several rows repeat is no link between them: each row is a vector of
      its own, and a row's component_id is the smallest id among the rows that it reaches.
    * A vector within half the threshold's angle of the first of its fine cell belongs to that
      one's ball; all pairs of a ball are links whatever else they are, and none is compared.
      So a group of near copies, however large, costs one comparison each.
    * Vectors of unlike balls that share a bucket of some table are compared. A bucket of up to
      SMALL entries lists its pairs as ids; sketches of SKETCH signs sort out those that are
      far apart (a link goes with probability 1e-5), the rest are made distinct, and only then
      do vectors move, for the exact cosine in double precision.
    * Larger buckets are cut into blocks, and pairs of blocks go to tasks of their own, but for
      blocks of one ball; these return counts and a spanning forest, not pairs.
    """
    spark = vectors.sparkSession
    big_batches(spark)
    settle = settle.part()
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    fine = F.size("vec") > 0
    fine &= F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("vec", lambda v: v != 0)
    usable = F.col("id").isNotNull() & F.coalesce(fine, F.lit(False))
    rows = settle(rows.withColumn("vec", F.when(usable, F.transform("vec", lambda v: v + F.lit(0.0)))))
    classes = rows.where("vec is not null").groupBy("vec").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("n"))
    classes = settle(classes.withColumn("rep", F.monotonically_increasing_id()))  # a name of the vector's own; written once
    total = classes.count()
    tables, bits = shape(total, least)
    coded = settle(classes.select("rep", "n", "vec").mapInArrow(_coded(tables, bits), "rep long, n long, vec array<double>, keys array<long>, cell long, s1 long, s2 long"))
    cells = settle(coded.groupBy("cell").agg(F.min("rep").alias("first"), F.min_by("vec", "rep").alias("lead"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    half = math.sqrt((1 + least) / 2) + 1e-9
    balls = meet(coded.select("cell", "rep", "vec"), cells, ["cell"], total, hot=1024).select("rep", "first", "vec", "lead").mapInArrow(_near(half), "rep long, ball long")
    coded = settle(coded.drop("cell").join(balls, "rep", "left").withColumn("ball", F.coalesce("ball", "rep")))

    entry = coded.select(F.col("rep").alias("id"), "ball", "s1", "s2", F.explode("keys").alias("key"))
    sizes = entry.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("ball").alias("lo"), F.max("ball").alias("hi"))
    large = settle(sizes.where("size > " + str(SMALL)).select("key", (F.col("lo") < F.col("hi")).alias("mixed")))
    small = entry.join(large, "key", "left_anti").select("key", "id", "ball", "s1", "s2")
    pairs = small.repartition("key").sortWithinPartitions("key").mapInArrow(_listed(least), "src long, dst long").distinct()
    end = lambda e, v: coded.select(F.col("rep").alias(e), F.col("vec").alias(v), F.col("n").alias(f"n_{e}"))
    met = settle(pairs.join(end("src", "a"), "src").join(end("dst", "b"), "dst").mapInArrow(_exact(least), "rep long, other long, links long"))
    if not (mixed := large.where("mixed").drop("mixed")).isEmpty():
        hot = settle(entry.select("key", "id", "ball").join(mixed, "key"))
        full = coded.join(hot.groupBy("id").agg(F.collect_list("key").alias("hot")), F.col("rep") == F.col("id")).select("id", "n", "vec", "keys", "hot")
        blocks = block_pairs(hot, "ball", settle, BLOCK).join(full, "id")
        met = met.unionByName(settle(blocks.groupBy("key", "lo", "hi").applyInArrow(_compared(least), "rep long, other long, links long")))

    in_ball = coded.groupBy("ball").agg(F.sum("n").alias("ball_n"))
    found = components(met.select(F.col("rep").alias("src"), F.col("other").alias("dst")).union(coded.select("rep", "ball")), settle)
    crossed = met.groupBy("rep").agg(F.sum("links").alias("links"))
    known = coded.select("rep", "ball").join(in_ball, "ball").join(crossed, "rep", "left").join(found.withColumnRenamed("id", "rep"), "rep", "left")
    known = known.select("rep", (F.col("ball_n") - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"), F.coalesce("component", "rep").alias("component"))
    known = settle(known.join(classes.select("rep", "vec", "low"), "rep"))
    lowest = known.groupBy("component").agg(F.min("low").alias("component_id"))
    of = rows.where("vec is not null").join(known.join(lowest, "component").select("vec", "n_links", "component_id"), "vec").select("id", "n_links", "component_id")
    alone = rows.where("vec is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return settle.last(of.unionByName(alone)).select(F.col("id").alias("vec_id"), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
