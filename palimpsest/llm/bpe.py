"""Byte-level BPE over whole texts: a minimal perfect hash for known pre-tokens, a heap for the rest."""

from __future__ import annotations

import base64
import gc
import hashlib
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType

from .common import big_batches
from .words import U64, chunks, mix, span_hash

KNOWN = 800_000  # pre-tokens, and units of text, that a worker remembers between texts


class PerfectHash:
    """Compress, hash and displace: n keys to 0..n-1 without gaps, and one number per bucket.

    Keys fall into n / 4 buckets; from the largest buckets on, each gets the first displacement
    that sends all its keys to free places. Buckets of one key take what is left directly.
    """

    def __init__(self, hashes: np.ndarray):
        n = self.n = len(hashes)
        self.buckets = max(1, n // 4)
        self.shift = np.zeros(self.buckets, np.int64)
        free = np.ones(max(n, 1), bool)
        bucket = (hashes % U64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        size = np.bincount(bucket, minlength=self.buckets)
        start = np.cumsum(size) - size
        for k in range(int(size.max(initial=0)), 1, -1):  # buckets of one size are tried together
            todo, d = np.flatnonzero(size == k), 0
            while len(todo):
                at = np.sort(self._at(hashes[order[start[todo][:, None] + np.arange(k)]], d), axis=1)
                good = np.flatnonzero(free[at].all(axis=1) & (np.diff(at, axis=1) > 0).all(axis=1))
                owner = np.full(n, -1)
                owner[at[good][::-1]] = good[::-1, None]  # of rows that want one place, the first gets it
                good = good[(owner[at[good]] == good[:, None]).all(axis=1)]
                free[at[good]] = False
                self.shift[todo[good]] = d
                todo, d = np.delete(todo, good), d + 1
        single = np.flatnonzero(size == 1)
        self.shift[single] = -1 - np.flatnonzero(free)[: len(single)]

    def _at(self, hashes: np.ndarray, d) -> np.ndarray:
        return (mix(hashes ^ (np.asarray(d, np.int64).astype(np.uint64) * U64(0x9E3779B97F4A7C15))) % U64(self.n)).astype(np.int64)

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """Of keys of the set: their own places. Of others: any place."""
        d = self.shift[(hashes % U64(self.buckets)).astype(np.int64)]
        return np.where(d < 0, -1 - d, self._at(hashes, np.maximum(d, 0)))


def _hashes(tokens: list[bytes]) -> np.ndarray:
    data = np.frombuffer(b"".join(tokens), np.uint8)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)))
    return span_hash(data, np.concatenate([np.zeros(1, np.int64), ends[:-1]]) if len(ends) else ends, ends)


class Vocabulary:
    """The ranks of a file of base64 tokens; ``pattern`` cuts texts into pre-tokens."""

    def __init__(self, lines: bytes, pattern: str):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines.splitlines() if x)}
        self.digits = {k: str(v) for k, v in self.ranks.items()}
        size = max(self.ranks.values(), default=-1) + 1
        by_rank: list[bytes | None] = [None] * size
        for token, rank in self.ranks.items():
            by_rank[rank] = token
        self.token = pa.array(by_rank, pa.large_binary())
        self.pair = [self.ranks.get(bytes((i >> 8, i & 255)), -1) for i in range(1 << 16)]
        self.cut = regex.compile(pattern).findall
        tokens = list(self.ranks)
        hashes = _hashes(tokens)
        self.perfect = PerfectHash(hashes)
        at = self.perfect.places(hashes)
        self.slot_hash = np.zeros(len(tokens), np.uint64)
        self.slot_hash[at] = hashes
        self.slot_token: list[bytes] = [b""] * len(tokens)
        self.slot_ids: list[str] = [""] * len(tokens)
        for k, token in zip(at.tolist(), tokens):
            self.slot_token[k], self.slot_ids[k] = token, self.digits[token]
        self.known: dict[str, str] = {}
        self.spaced: dict[str, str] = {}

    def merge(self, piece: bytes) -> str:
        """The ids of a pre-token by repeated merging of the pair of lowest rank, leftmost first.

        Parts are a linked list over the bytes; the heap holds each adjacent pair that is a
        token as one integer (rank, start, end of the pair); an entry whose parts have changed
        is stale.
        """
        get, pair, n = self.ranks.get, self.pair, len(piece)
        after, before = list(range(1, n + 1)), list(range(-1, n))
        low = 16 if n < 1 << 16 else 48  # bits of a place; small integers compare faster
        mask, high = (1 << low) - 1, 2 * low
        heap = [r << high | i << low | i + 2 for i, (a, b) in enumerate(zip(piece, piece[1:])) if (r := pair[a << 8 | b]) >= 0]
        heapify(heap)
        while heap:
            entry = heappop(heap)
            i, end = entry >> low & mask, entry & mask
            j = after[i]
            if not j or j == n or after[j] != end:
                continue
            after[j] = 0  # a part that was merged into the one before
            after[i] = end
            if end < n:
                before[end] = i
                to = after[end]
                if (r := get(piece[i:to])) is not None:
                    heappush(heap, r << high | i << low | to)
            if i and (r := get(piece[(h := before[i]) : end])) is not None:
                heappush(heap, r << high | h << low | end)
        digits = self.digits
        out, i = [], 0
        while i < n:
            j = after[i]
            out.append(digits[piece[i:j]])
            i = j
        return " ".join(out)

    def resolve(self, pieces: list[str]) -> list[str]:
        """The ids of pre-tokens, as decimal text joined by blanks: from its slot for a whole token,
        by merging for any other."""
        raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
        hashes = _hashes(raw)
        at = self.perfect.places(hashes)
        hit = (self.slot_hash[at] == hashes).tolist()
        slot, ids, merge = self.slot_token, self.slot_ids, self.merge
        return [ids[k] if same and slot[k] == data else merge(data) for data, k, same in zip(raw, at.tolist(), hit)]

    def _add(self, memory: dict[str, str], names: list[str], pieces: list[str]) -> None:
        memory.update(zip(names, self.resolve(pieces)))

    def encode(self, texts: list[str]) -> list[str]:
        """Each text's ids, decimal, joined by blanks.

        Where a blank has no white space beside it, a pre-token starts at the blank. Texts in
        which all blanks are such fall apart there, into units that recur and are remembered
        whole; other texts are cut by the pattern at once. That, and the words of letters that
        skip the pattern, hold for patterns that cut as the one in public_tokenizers does; use
        no other.
        """
        known, spaced = self.known, self.spaced
        for memory in (known, spaced):
            if len(memory) > KNOWN:
                memory.clear()
        parts = [t.split(" ") for t in texts]
        new: set[str] = set()
        for part in parts:
            new.update(part[1:])
        new = new.difference(spaced)
        bad = {u for u in new if not u or u[0].isspace() or u[-1].isspace()}
        new -= bad
        odd = [bool(bad) and not bad.isdisjoint(part[1:]) or len(part) > 1 and (not part[0] or part[0][-1].isspace()) for part in parts]
        # Letters only, or letters and one mark, need no pattern to be cut.
        words, marked, rest = [], [], []
        for u in new:
            if u.isalpha():
                words.append(u)
            elif u[-1] in MARKS and u[:-1].isalpha():
                marked.append(u)
            else:
                rest.append(u)
        words += {u[:-1] for u in marked}.difference(spaced, words)
        self._add(spaced, words, [" " + w for w in words])
        cuts = [(u, self.cut(" " + u)) for u in rest]
        heads = [self.cut(text if o else part[0]) for text, part, o in zip(texts, parts, odd)]
        need = {u[-1] for u in marked}
        need.update(*heads)
        need.update(*(cut for _, cut in cuts))
        need = list(need.difference(known))
        self._add(known, need, need)
        for u in marked:
            spaced[u] = f"{spaced[u[:-1]]} {known[u[-1]]}"
        for unit, cut in cuts:
            spaced[unit] = " ".join([known[p] for p in cut])
        out = []
        for part, head, o in zip(parts, heads, odd):
            ids = [known[p] for p in head]
            if not o:
                ids += map(spaced.__getitem__, part[1:])
            out.append(" ".join(ids))
        return out

    def decode(self, coded: list[str]) -> tuple[np.ndarray, np.ndarray, list[memoryview]]:
        """The ids of all texts in a row, where each text's begin and end, and the bytes of each text."""
        ends = np.cumsum([0, *(c.count(" ") + 1 if c else 0 for c in coded)])
        ids = np.array([], np.int32) if not ends[-1] else np.fromstring(" ".join(filter(None, coded)), np.int32, sep=" ")
        tokens = self.token.take(pa.array(ids))
        _, offsets, data = tokens.buffers()
        cut = np.frombuffer(offsets, np.int64)[ends].tolist() if len(ids) else [0] * len(ends)
        data = memoryview(data or b"")
        return ids, ends, [data[i:j] for i, j in zip(cut, cut[1:])]


MARKS = frozenset(".,;:!?|")
_loaded: dict[int, Vocabulary] = {}


def tokenize(docs: DataFrame, vocabulary: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = True) -> DataFrame:
    """(id_col, n_tokens, ids_sha256, decoded_sha256, and with ``ids`` also ids array<int>).

    vocabulary: the content of a rank file, bounded by its number of tokens. Whole texts are
    encoded, each pre-token by itself, and the ids decoded again. A null text counts as empty:
    no ids. Other columns of docs take no part. Each row gives a row.
    """
    spark = docs.sparkSession
    held, key = spark.sparkContext.broadcast((vocabulary, pattern)), hash((vocabulary, pattern))
    big_batches(spark)
    source = docs.select(docs[id_col].alias(id_col), docs[text_col].cast("string").alias("_text"))
    schema = source.drop("_text").schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    if ids:
        schema = schema.add("ids", ArrayType(IntegerType()))

    def run(batches):
        words = _loaded.get(key)  # a worker builds the tables once
        if words is None:
            _loaded.clear()
            words = _loaded[key] = Vocabulary(*held.value)
        sha = hashlib.sha256
        gc.disable()  # the memories hold millions of strings and no cycles
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            for lo, hi in chunks(texts):
                coded = words.encode(texts.slice(lo, hi - lo).to_pylist())
                numbers, ends, decoded = words.decode(coded)
                columns = [
                    batch.column(0).slice(lo, hi - lo),
                    pa.array(np.diff(ends)),
                    pa.array([sha(c.encode()).hexdigest() for c in coded], pa.string()),
                    pa.array([sha(d).hexdigest() for d in decoded], pa.string()),
                ]
                if ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(numbers)))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return source.mapInArrow(run, schema)
