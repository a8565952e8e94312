"""Document quality: logistic regression on hashed word n-grams, trained by FTRL-proximal."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import big_batches
from .words import RAW, U64, _PLACE, chunks, mix, span_hash, words

BITS = 18
SAMPLE = 12_000  # labelled documents that a fit reads at most
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[97:123] = _SHAPE[128:] = ord("a")
_SHAPE[65:91] = ord("A")
_SHAPE[48:58] = ord("0")
_REPEAT = U64(0xA5A5A5A55A5A5A5B)


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """(text, bucket) of every n-gram of one and two words, in two views: the words in lower
    case, and their shapes (letters, capitals and digits as runs; a word said again as such)."""
    part = words(texts, RAW, lower=False)
    if not len(part.starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), len(part)
    low = span_hash(_LOWER[part.data], part.starts, part.ends)
    form = _SHAPE[part.data]
    keep = np.ones(len(form), bool)
    keep[1:] = form[1:] != form[:-1]
    keep[part.starts] = True
    place = np.cumsum(keep)
    shape = span_hash(form[keep], place[part.starts] - 1, place[part.ends - 1])
    text = part.text_of()
    near = np.zeros(len(text), bool)
    near[1:] = text[1:] == text[:-1]
    again = near.copy()
    again[1:] &= low[1:] == low[:-1]
    shape[again] = _REPEAT
    ids, owners = [], []
    pair = np.flatnonzero(near)
    for view, seed in ((low, 11), (shape, 13)):
        ids += [mix(view + U64(seed)), mix(view[pair - 1] * _PLACE[0] + view[pair] * _PLACE[1] + U64(seed + 1))]
        owners += [text, text[pair]]
    return np.concatenate(owners), (np.concatenate(ids) >> U64(64 - BITS)).astype(np.int64), len(part)


def vectors(texts: pa.Array):
    """The sparse vector of each text: (buckets, shares of its n-grams), scaled."""
    for lo, hi in chunks(texts):
        text, bucket, n = features(texts.slice(lo, hi - lo))
        key, count = np.unique(text << BITS | bucket, return_counts=True)
        cut = np.searchsorted(key, np.arange(n + 1) << BITS)
        for i, j in zip(cut[:-1], cut[1:]):
            yield key[i:j] & ((1 << BITS) - 1), count[i:j] * (SCALE / max(1, count[i:j].sum()))


SCALE = 20.0


class FTRL:
    """Follow-the-regularised-leader, proximal form: a learning rate for each coordinate, L1 and L2."""

    def __init__(self, size: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.2, l2: float = 0.5):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(size), np.zeros(size)

    def weights(self, at=slice(None)) -> np.ndarray:
        z = self.z[at]
        w = (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, at: np.ndarray, x: np.ndarray, y: float) -> None:
        self.step(at, (sigmoid(self.weights(at) @ x) - y) * x)

    def step(self, at: np.ndarray, g) -> None:
        w = self.weights(at)
        more = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - more * w
        self.n[at] += g * g


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = 4) -> np.ndarray:
    """Weights, the last one for the constant 1."""
    model = FTRL((1 << BITS) + 1)
    order = np.random.default_rng(5)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            at, x, y = rows[k]
            model.learn(np.append(at, 1 << BITS), np.append(x, 1.0), y)
    return model.weights()


def sampled(docs: DataFrame, labels: DataFrame, label: str, keep, limit: int) -> DataFrame:
    """(text, y) of at most ``limit`` labelled documents, in one partition and in a fixed order.

    They are those of smallest hash among the label table's ids that ``keep`` admits, so which
    they are does not depend on partitions. Ids with unlike labels, null ids and null labels
    are left out. Only ids meet when they are chosen; texts of the chosen move once.
    """
    ids = labels.select(F.col("doc_id").alias("id"), F.col(label).cast("double").alias("y")).where(F.col("id").isNotNull() & F.col("y").isNotNull() & keep("id"))
    ids = ids.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("hi")).where("y = hi").select("id", "y", F.xxhash64("id").alias("rank"))
    ids = ids.orderBy("rank", "id").limit(limit)
    texts = docs.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text"))
    one = texts.join(F.broadcast(ids), "id")
    return one.repartition(1).sortWithinPartitions("rank", "id", "text").select("text", "y")


def train(docs: DataFrame, labels: DataFrame, label: str, keep, sample: int = SAMPLE) -> np.ndarray:
    """Weights fitted in one task on the bounded sample; a vector of fixed size comes back."""

    def run(batches):
        rows = []
        for batch in batches:
            rows += [(at, x, y) for (at, x), y in zip(vectors(batch.column(0)), batch.column(1).to_pylist())]
        yield pa.RecordBatch.from_arrays([pa.array([fit(rows).tobytes()])], names=["w"])

    big_batches(docs.sparkSession)
    got = sampled(docs, labels, label, keep, sample).mapInArrow(run, "w binary").first()
    return np.frombuffer(got[0]) if got else np.zeros((1 << BITS) + 1)


def score(docs: DataFrame, w: np.ndarray, id_col: str = "doc_id", text_col: str = "text", name: str = "score") -> DataFrame:
    """docs and ``name``: the probability that a text is good. Every row stays; a null or empty
    text has no n-grams and gets the constant's score. A column called ``name`` is replaced."""
    held = docs.sparkSession.sparkContext.broadcast(w)
    big_batches(docs.sparkSession)
    docs = docs.drop(name)
    schema = StructType([*docs.schema.fields, StructField(name, DoubleType())])

    def run(batches):
        w = held.value
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col)).cast(pa.string())
            parts = [np.zeros(0)]
            for lo, hi in chunks(texts):
                text, bucket, n = features(texts.slice(lo, hi - lo))
                total = np.bincount(text, w[bucket], n) * SCALE / np.maximum(1, np.bincount(text, minlength=n))
                parts.append(sigmoid(total + w[-1]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(parts))], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, schema)
