"""Words and word shingles of whole Arrow batches as 64-bit hashes, without a Python loop.

A word hash is a polynomial over its bytes modulo 2**64, taken from one running sum over the
batch: the sum between two places, times the inverse power of the first, does not depend on
where in the batch the word lies.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
CHUNK_BYTES = 1 << 20  # arrays of eight bytes for each byte of text stay near the cache's size

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_PLACE = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) | U64(1)

_ascii = np.arange(256)
_ALNUM = ((_ascii >= 48) & (_ascii < 58)) | ((_ascii >= 65) & (_ascii < 91)) | ((_ascii >= 97) & (_ascii < 123)) | (_ascii >= 128)
_SPACE = np.isin(_ascii, [9, 10, 11, 12, 13, 28, 29, 30, 31, 32])
PLAIN, RAW = _ALNUM, ~_SPACE  # bytes of a word: letters and digits only, or all but white space
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (a splitmix64 finish)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def distinct(key: np.ndarray) -> np.ndarray:
    """The sorted distinct values; a plain sort is several times as fast as a hash table here."""
    key = np.sort(key)
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    return key[new]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers["p"]) < n:
        size = max(n, CHUNK_BYTES * 2)
        for name, base in (("p", _BASE), ("i", _INVERSE)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["p"][:n], _powers["i"][:n]


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each data[start:end]."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    p, inverse = _power(len(data))
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE[data] * p, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


@dataclass
class Words:
    """Of a run of texts: the hash of each word in order, and where each text's words begin."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray  # len(texts) + 1

    def __len__(self) -> int:
        return len(self.first) - 1

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), self.counts())


def words(texts: pa.Array, kind: np.ndarray = PLAIN, lower: bool = True) -> Words:
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    if lower:
        texts = pc.utf8_lower(texts)
    texts = pc.fill_null(texts, "")
    if len(texts) == 0:
        z = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint8), z, z, np.zeros(0, np.uint64), np.zeros(1, np.int64))
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    inside = kind[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    filled = offsets[:-1][np.diff(offsets) > 0]
    before[filled] = False
    after[filled[1:] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return Words(data, starts, ends, span_hash(data, starts, ends), np.searchsorted(starts, offsets))


def chunks(texts: pa.Array, size: int = CHUNK_BYTES):
    """(from, to) runs of texts of about that many bytes; a longer text stands alone."""
    n = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    place = np.cumsum(n)
    at = 0
    while at < len(n):
        before = place[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(place, before + size, "right")))
        to = min(to, at + 4096)
        yield at, to
        at = to


def ngrams(w: Words, n: int, shorter: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(text of each n-gram, its hash), in order. shorter: a text of 1 to n - 1 words is one n-gram."""
    last = np.repeat(w.first[1:], w.counts())
    at = np.flatnonzero(np.arange(len(w.hashes)) + n <= last)
    text = w.text_of()
    total = np.zeros(len(at), np.uint64)
    for i in range(n):
        total += w.hashes[at + i] * _PLACE[i]
    text_at = text[at]
    if shorter and n > 1:
        few = np.flatnonzero((w.counts() > 0) & (w.counts() < n))
        if len(few):
            rest = np.zeros(len(few), np.uint64)
            for i in range(n - 1):
                has = w.first[few] + i < w.first[few + 1]
                rest[has] += w.hashes[(w.first[few] + i)[has]] * _PLACE[i]
            text_at, total = np.concatenate([text_at, few]), np.concatenate([total, rest])
            order = np.argsort(text_at, kind="stable")
            text_at, total = text_at[order], total[order]
    return text_at, mix(total + U64(n))


def sequence_hash(w: Words, salt: int) -> np.ndarray:
    """A hash of each text's whole word sequence."""
    p, inverse = _power(len(w.hashes) + 1)
    sums = np.zeros(len(w.hashes) + 1, np.uint64)
    np.cumsum(mix(w.hashes + U64(salt)) * p[: len(w.hashes)], out=sums[1:])
    return mix((sums[w.first[1:]] - sums[w.first[:-1]]) * inverse[w.first[:-1]] + w.counts().astype(np.uint64))
