"""Document toxicity: a factorization machine over hashed terms.

score = sigmoid(b + sum w_i + sum over pairs <v_i, v_j>), over a text's distinct terms. The
pair term lets two terms count together (an insult and whom it is aimed at) though neither
decides alone; it costs as much as a sum, since the sum over pairs of <v_i, v_j> is half of
|sum v_i|^2 - sum |v_i|^2.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import big_batches
from .quality import FTRL, sampled, sigmoid
from .words import U64, chunks, distinct, words

BITS, FACTORS = 20, 8
SAMPLE = 12_000  # labelled documents that a fit reads at most
MIN_DOCS = 3  # a term of fewer sampled documents carries no weight


def terms(texts: pa.Array, active: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """Distinct (text, bucket) of the texts' terms; only those of ``active`` buckets if given."""
    part = words(texts)
    text, bucket = part.text_of(), (part.hashes >> U64(64 - BITS)).astype(np.int64)
    if active is not None:
        has = active[bucket]
        text, bucket = text[has], bucket[has]
    key = distinct(text << BITS | bucket)
    return key >> BITS, key & ((1 << BITS) - 1), len(part)


def fit(rows: list[tuple[np.ndarray, float]], epochs: int = 6, warm: int = 2, rate: float = 0.05, shrink: float = 0.05) -> dict[str, np.ndarray]:
    """Linear weights by follow-the-regularised-leader, factors by adaptive gradients.

    L1 keeps the linear weight of chance terms at zero. After ``warm`` rounds factors are
    learned for the terms that have a weight, and for frequent ones that are half way to one:
    random factors of thousands of other terms would only add noise to long texts. Errors on
    the rarer class count by the root of how much rarer it is.
    """
    seen = np.bincount(np.concatenate([np.zeros(0, np.int64), *[at for at, _ in rows]]), minlength=1 << BITS)
    used = np.flatnonzero(seen >= MIN_DOCS)
    place = np.full(1 << BITS, -1)
    place[used] = np.arange(len(used))
    rows = [(np.append(p[p >= 0], len(used)), y) for at, y in rows for p in [place[at]]]
    toxic = sum(y for _, y in rows)
    weight = (max(1, len(rows) - toxic) / max(1, toxic)) ** 0.5
    rng = np.random.default_rng(3)
    line = FTRL(len(used) + 1, alpha=2.0, beta=1.0, l1=4.0, l2=1.0)
    v, power = np.zeros((len(used) + 1, FACTORS)), np.ones((len(used) + 1, FACTORS))
    paired = np.zeros(len(used) + 1, bool)
    for epoch in range(epochs):
        if epoch == warm:
            paired[:-1] = (line.weights()[:-1] != 0) | ((seen[used] >= 50) & (np.abs(line.z[:-1]) > line.l1 / 2))
            v[paired] = rng.normal(0, 0.01, (paired.sum(), FACTORS))
        for k in rng.permutation(len(rows)):
            at, y = rows[k]
            vs = v[at]
            total = vs.sum(axis=0)
            g = sigmoid(line.weights(at).sum() + 0.5 * (total @ total - (vs * vs).sum())) - y
            g *= weight if y else 1
            line.step(at, g)
            has = at[paired[at]]
            if len(has) and abs(g) > 1e-3:
                d = g * (total - v[has]) + shrink * v[has]
                power[has] += d * d
                v[has] -= rate * d / np.sqrt(power[has])
    w = line.weights()
    strong = np.flatnonzero((w[:-1] != 0) | paired[:-1])
    return {"at": used[strong], "w": w[strong], "v": v[strong].astype(np.float32), "b": w[-1:]}


def train(docs: DataFrame, labels: DataFrame, label: str, keep, sample: int = SAMPLE) -> dict[str, np.ndarray]:
    """The model fitted in one task on a bounded sample of labelled documents."""

    def run(batches):
        rows = []
        for batch in batches:
            texts, ys = batch.column(0), batch.column(1).to_pylist()
            for lo, hi in chunks(texts):
                text, bucket, n = terms(texts.slice(lo, hi - lo))
                cut = np.searchsorted(text, np.arange(n + 1))
                rows += [(bucket[i:j], y) for i, j, y in zip(cut[:-1], cut[1:], ys[lo:hi])]
        np.savez_compressed(out := io.BytesIO(), **fit(rows))
        yield pa.RecordBatch.from_arrays([pa.array([out.getvalue()])], names=["model"])

    big_batches(docs.sparkSession)
    got = sampled(docs, labels, label, keep, sample).mapInArrow(run, "model binary").first()
    return dict(np.load(io.BytesIO(got[0]))) if got else fit([])


def score(docs: DataFrame, model: dict[str, np.ndarray], text_col: str = "text", name: str = "score") -> DataFrame:
    """docs and ``name``: the probability that a text is toxic. Every row stays; a null or empty
    text has no terms and gets the constant's score. A column called ``name`` is replaced."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    big_batches(docs.sparkSession)
    docs = docs.drop(name)
    schema = StructType([*docs.schema.fields, StructField(name, DoubleType())])

    def run(batches):
        m = held.value
        active, place = np.zeros(1 << BITS, bool), np.zeros(1 << BITS, np.int64)
        active[m["at"]] = True
        place[m["at"]] = np.arange(len(m["at"]))
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col)).cast(pa.string())
            parts = [np.zeros(0)]
            for lo, hi in chunks(texts):
                text, bucket, n = terms(texts.slice(lo, hi - lo), active)
                at = place[bucket]
                total = m["b"][0] + np.bincount(text, m["w"][at], n)
                for f in range(m["v"].shape[1]):
                    vf = m["v"][at, f]
                    total += 0.5 * (np.bincount(text, vf, n) ** 2 - np.bincount(text, vf * vf, n))
                parts.append(sigmoid(total))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(parts))], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, schema)
