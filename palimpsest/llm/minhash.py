"""Near-duplicate documents by ProbMinHash signatures, banding and exact verification."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Settled, big_batches, block_pairs, meet
from .components import components
from .words import U64, chunks, mix, ngrams, sequence_hash, words

REGISTERS, ROWS = 100, 5
BANDS = REGISTERS // ROWS
_ROUND = U64(0xD1342543DE82EF95)
_BAND = np.random.default_rng(7).integers(1, 1 << 63, (BANDS, ROWS), dtype=np.uint64) | U64(1)


def weighted(text: np.ndarray, gram: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, 48-bit shingle) with its number of occurrences, in order."""
    key = np.sort((text.astype(np.uint64) << U64(48)) | (gram >> U64(16)))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(new)
    return (key[at] >> U64(48)).astype(np.int64), key[at] & U64((1 << 48) - 1), np.diff(np.append(at, len(key)))


def signatures(text: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, m: int = REGISTERS) -> np.ndarray:
    """ProbMinHash registers of n weighted sets: the element whose arrival came first in each.

    Every element sends a Poisson process of rate ``weight`` into m registers, drawn from
    its own hash, so two sets agree in a register with the probability Jaccard of their
    weights. Arrivals after the time at which a set's registers are all filled cannot change
    anything: generation stops at a limit, and the few sets with a register still empty by
    then are run again with a later one, which yields the full process's signature exactly.
    An empty set has zeros.
    """
    out = np.zeros((n, m), np.uint64)
    total = np.bincount(text, weight, n)
    todo, factor = np.flatnonzero(total > 0), np.log(m) + 2.5
    picked, w = np.arange(len(text)), weight.astype(float)
    while len(todo):
        limit = np.zeros(n)
        limit[todo] = m * factor / total[todo]
        first = np.full(n * m, np.inf)
        at, clock, turn, step = picked, np.zeros(len(picked)), 0, 1
        flats, times, owners = [], [], []
        while len(at):
            draws = mix(element[at][:, None] + (np.arange(turn, turn + step, dtype=np.uint64) + U64(1)) * _ROUND)
            gap = -np.log(((draws >> U64(11)).astype(float) + 0.5) * 2.0**-53) / w[at][:, None]
            when = clock[:, None] + np.cumsum(gap, axis=1)
            early = when < limit[text[at]][:, None]
            row, col = np.nonzero(early)
            register = (mix(draws[row, col] ^ _ROUND) % U64(m)).astype(np.int64)
            flats.append(text[at][row] * m + register)
            times.append(when[row, col])
            owners.append(element[at][row])
            alive = early[:, -1]
            at, clock, turn = at[alive], when[alive, -1], turn + step
            step = 1 if len(at) > 4096 else 32
        flat, time, owner = np.concatenate(flats), np.concatenate(times), np.concatenate(owners)
        np.minimum.at(first, flat, time)
        won = time == first[flat]
        ids = np.zeros(n * m, np.uint64)
        ids[flat[won]] = owner[won] + U64(1)
        ids = ids.reshape(n, m)
        full = todo[(ids[todo] != 0).all(axis=1)]
        out[full] = ids[full]
        todo = np.setdiff1d(todo, full)
        again = np.zeros(n, bool)
        again[todo] = True
        picked, factor = picked[again[text[picked]]], factor * 2
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of each signature, unlike between bands."""
    parts = sig.reshape(len(sig), BANDS, ROWS) * _BAND[None]
    return mix(parts.sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * _ROUND)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Probability Jaccard of two weighted sets, each (sorted elements, weights).

    The sum over shared d of 1 / sum over e of max(a_e/a_d, b_e/b_d). Elements of one set only
    add their whole weight to one side; for those of both, sorting by the ratio a_e/b_e turns
    the maxima into two running sums. With equal weights it is the plain Jaccard index.
    """
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(i):
        return 0.0
    x, y = a[1][i].astype(float), b[1][j].astype(float)
    order = np.argsort(x / y, kind="stable")
    x, y = x[order], y[order]
    only_a, only_b = a[1].sum() - x.sum(), b[1].sum() - y.sum()
    upto_y = np.cumsum(y)
    after_x = x.sum() - np.cumsum(x)
    return float((1 / ((only_a + after_x) / x + (only_b + upto_y) / y)).sum())


def _signed(batches, n_words: int):
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        for lo, hi in chunks(texts):
            part = words(texts.slice(lo, hi - lo))
            text, element, weight = weighted(*ngrams(part, n_words, shorter=True), len(part))
            sig = signatures(text, element, weight, len(part))
            keys = band_keys(sig).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(lo, hi - lo),
                    pa.array(sequence_hash(part, 1).view(np.int64)),
                    pa.array(sequence_hash(part, 2).view(np.int64)),
                    pa.array(part.counts()),
                    pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), BANDS).cast(pa.list_(pa.int64())),
                    pa.array([r.tobytes() for r in (mix(sig) >> U64(48)).astype(np.uint16)], pa.binary()),
                ],
                names=["doc", "h1", "h2", "n", "keys", "prints"],
            )


def _sets(texts: pa.Array, n_words: int) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for lo, hi in chunks(texts):
        part = words(texts.slice(lo, hi - lo))
        text, element, weight = weighted(*ngrams(part, n_words, shorter=True), len(part))
        cut = np.searchsorted(text, np.arange(len(part) + 1))
        out += [(element[i:j], weight[i:j]) for i, j in zip(cut[:-1], cut[1:])]
    return out


def _verified(n_words: int, least: float):
    def run(batches):
        for batch in batches:
            a, b = (_sets(batch.column(k), n_words) for k in (2, 3))
            sim = np.array([similarity(x, y) for x, y in zip(a, b)])
            ok = sim >= least - 1e-12
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(ok)), batch.column(1).filter(pa.array(ok)), pa.array(sim[ok])], names=["src", "dst", "similarity"])

    return run


BLOCK = 512  # entries of one side of a comparison
SMALL = 64  # a bucket of up to so many entries may list its pairs: their number stays in proportion


def _packed(n_words: int):
    def run(batches):
        for batch in batches:
            sets = [e.tobytes() + w.astype(np.uint64).tobytes() for e, w in _sets(batch.column(1), n_words)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["doc", "set"])

    return run


def _across(margin: int, least: float | None):
    """Pairs of a block pair that lie in different components and agree in enough registers.

    With ``least`` the rows hold their shingles: pairs are verified here, in the first band
    where they meet and only while unconnected, and a spanning forest of the links comes back.
    """

    def run(table: pa.Table) -> pa.Table:
        side = np.asarray(table["side"])
        doc, comp = np.asarray(table["doc"]), np.asarray(table["component"])
        prints = np.frombuffer(b"".join(table["prints"].to_pylist()), np.uint16).reshape(len(doc), REGISTERS)
        left, right = np.flatnonzero(side != 2), np.flatnonzero(side != 1)
        root = {c: c for c in comp.tolist()}
        if least is not None:
            flat = [np.frombuffer(x, np.uint64) for x in table["set"].to_pylist()]
            sets = [(x[: len(x) // 2], x[len(x) // 2 :].astype(np.int64)) for x in flat]
            bands = np.array(table["keys"].to_pylist(), np.int64)
            here = int(np.flatnonzero(bands[0] == table["key"][0].as_py())[0])

        def top(c):
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        src, dst = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k in left:
            other = right[(comp[right] != comp[k]) & ((side[k] != 0) | (doc[right] > doc[k]))]
            if len(other):
                other = other[(prints[other] == prints[k]).sum(axis=1) >= margin]
            if least is not None and len(other):
                if here:
                    other = other[~(bands[other, :here] == bands[k, :here]).any(axis=1)]
                linked = []
                for j in other:
                    x, y = top(int(comp[k])), top(int(comp[j]))
                    if x != y and similarity(sets[k], sets[j]) >= least - 1e-12:
                        root[max(x, y)] = min(x, y)
                        linked.append(j)
                other = np.array(linked, np.int64)
            src.append(np.full(len(other), doc[k]))
            dst.append(doc[other])
        x, y = np.concatenate(src), np.concatenate(dst)
        return pa.table({"src": np.minimum(x, y), "dst": np.maximum(x, y)})

    return run


def near_duplicates(docs: DataFrame, settle: Settled, least: float = 0.8, n_words: int = 5) -> DataFrame:
    """(doc, component) of docs(doc long, text): the near-duplicate class of each document.

    * Words are lower-case runs of letters and digits. Documents of one word sequence are one
      text: a single representative stands for all of them from there on.
    * Representatives that share a band are linked first to the bucket's smallest, and links
      count only if the exact probability Jaccard of their weighted shingles reaches ``least``.
      A bucket whose members are still in several components after that is compared pair by
      pair in blocks, on signatures only, across components: a large component has blocks of its
      own, which meet those of others but not each other; pairs that agree in at least as
      many registers as a pair at ``least`` does but once in some ten thousand are verified too,
      in the comparing task itself if the bucket is large. So no link is lost to the star, and
      a group of thousands of copies costs one link each.
    * A document without words is alone; a text shorter than a shingle is one shingle.
      Null texts have no words. Rows of one ``doc`` are one row of the result, and if their
      texts differ they share its class; rows with a null ``doc`` have no name to report and are
      left out. An empty table gives an empty result.
    """
    big_batches(docs.sparkSession)
    settle = settle.part()
    source = docs.select(F.col("doc").cast("long").alias("doc"), F.col("text").cast("string").alias("text"))
    signed = settle(source.mapInArrow(lambda b: _signed(b, n_words), "doc long, h1 long, h2 long, n long, keys array<long>, prints binary"))
    known = signed.where("doc is not null")
    classes = settle(known.where("n > 0").groupBy("h1", "h2").agg(F.min("doc").alias("rep"), F.count(F.lit(1)).alias("size")))
    rep = known.where("n > 0").join(classes, ["h1", "h2"]).where("doc = rep")
    rep = settle(rep.dropDuplicates(["doc", "h1", "h2"]).select("doc", "keys", "prints"))
    entry = rep.select("doc", F.explode("keys").alias("key"))
    buckets = settle(entry.groupBy("key").agg(F.min("doc").alias("hub"), F.count(F.lit(1)).alias("size")).where("size > 1").select("key", "hub"))
    entry = settle(entry.join(buckets, "key"))

    def texts_of(needed: DataFrame) -> DataFrame:
        # A merge join at every size: what it moves is in proportion to the texts.
        chosen = source.hint("merge").join(needed, "doc", "left_semi")
        return chosen.select("doc", "text", F.xxhash64("text").alias("t")).dropDuplicates(["doc", "t"]).drop("t")

    def verify(pairs: DataFrame) -> DataFrame:
        texts = settle(texts_of(pairs.select(F.explode(F.array("src", "dst")).alias("doc")).distinct()))
        both = pairs.join(texts.withColumnsRenamed({"doc": "src", "text": "a"}), "src").join(texts.withColumnsRenamed({"doc": "dst", "text": "b"}), "dst")
        linked = settle(both.select("src", "dst", "a", "b").mapInArrow(_verified(n_words, least), "src long, dst long, similarity double"))
        settle.drop(texts)
        return linked

    stars = settle(entry.where("doc <> hub").select(F.col("hub").alias("src"), F.col("doc").alias("dst")).distinct())
    links = verify(stars).select("src", "dst")
    found = components(links, settle)
    with_comp = entry.join(found.withColumnRenamed("id", "doc"), "doc", "left").select("doc", "key", F.coalesce("component", "doc").alias("component"))
    mixed = with_comp.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("size"))
    mixed = settle(mixed.where("lo < hi").select("key", F.col("size").alias("n"), (F.col("size") > SMALL).alias("hot")))
    at = settle(meet(with_comp, mixed, ["key"], entry.count()).select("key", F.col("doc").alias("id"), "component", "hot"))
    pairs = block_pairs(at, "component", settle, BLOCK).withColumnRenamed("id", "doc")
    margin = int(REGISTERS * least - 4 * (REGISTERS * least * (1 - least)) ** 0.5)
    few = pairs.where("not hot").join(rep.select("doc", "prints"), "doc").groupBy("key", "lo", "hi").applyInArrow(_across(margin, None), "src long, dst long").distinct()
    few = settle(few.join(stars, ["src", "dst"], "left_anti"))
    more = [verify(few).select("src", "dst")]
    hot = at.where("hot").select(F.col("id").alias("doc")).distinct()
    if not hot.isEmpty():
        sets = settle(texts_of(hot).mapInArrow(_packed(n_words), "doc long, set binary"))
        full = pairs.where("hot").join(rep, "doc").join(sets, "doc")
        more.append(settle(full.groupBy("key", "lo", "hi").applyInArrow(_across(margin, least), "src long, dst long")))
        settle.drop(sets)
    for m in more:
        links = links.union(m)
    found = components(links, settle)
    member = known.select("doc", "h1", "h2", "n").join(classes.select("h1", "h2", "rep"), ["h1", "h2"], "left")
    own = member.select("doc", F.when(F.col("n") > 0, F.col("rep")).otherwise(F.col("doc")).alias("rep"))
    own = own.join(found.withColumnsRenamed({"id": "rep"}), "rep", "left").select("doc", F.coalesce("component", "rep").alias("component"))
    return settle.last(own.groupBy("doc").agg(F.min("component").alias("component")))
