"""Benchmark decontamination: BM25 retrieval by block-max WAND, then overlap checks.

The inverted index holds the benchmark: for each term its postings (item, impact) by item, cut
into blocks of which the last item and the largest impact are kept. The queries are the training
passages, windows of words over whole documents. Impacts are divided by an item's score for its
own text, so one threshold serves all items. Each passage has a cursor on each of its terms'
postings and walks them as WAND does: the pivot is the first item that the terms' largest impacts
could bring to the threshold; if the blocks around it cannot, all cursors before it skip to the
end of the nearest block; else the pivot is scored. Passages that no range of items could bring to
the threshold, by the maxima of a few wide blocks, do not set out. The walks of a batch of passages are taken
together, a step of each at a time, as array operations.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import big_batches
from .words import Words, chunks, distinct, ngrams, words

BLOCK = 8  # postings in a block
SHARD_BYTES = 16 << 20  # text of an index that is sent to executors, some 40 times which it takes in memory at most
RANGES = 32  # into which the items of an index are cut, however many they are
STRIDE = 64  # words between windows for items of up to so many words; longer items have classes of their own
K1, B = 1.2, 0.75


@dataclass
class Index:
    ids: np.ndarray
    terms: np.ndarray  # sorted hashes
    start: np.ndarray  # (terms + 1): where each term's postings begin
    item: np.ndarray
    impact: np.ndarray
    key: np.ndarray  # term * items + item of each posting, ascending
    top: np.ndarray  # the largest impact of each term
    coarse: np.ndarray  # the same in each of RANGES ranges of items
    block_of: np.ndarray  # the first block of each term
    last: np.ndarray  # of each block: its last item, and its largest impact
    peak: np.ndarray
    grams: list[np.ndarray]  # shingles of the whole item, of its question, and words of its answer
    question: list[np.ndarray]
    answer: list[np.ndarray]
    size: np.ndarray  # words in a shingle of the item
    stride: int


def build(items: list[tuple[int, str, int]], df: dict[int, int], n: int, mean: float, n_words: int = 5) -> Index:
    """The index of items (id, text, words in the answer) of like length. df, n, mean: of the whole benchmark."""
    part = words(pa.array([x[1] for x in items], pa.large_string()))
    many = len(items)
    # Short items have the large impacts: side by side, they leave the other blocks' maxima small.
    order = np.argsort(part.counts(), kind="stable")
    terms, at = np.unique(part.hashes, return_inverse=True)
    rank = np.empty(many, np.int64)
    rank[order] = np.arange(many)
    key, tf = np.unique(at.astype(np.int64) * many + rank[part.text_of()], return_counts=True)
    term, item = key // many, key % many
    d = np.array([df[t] for t in terms.tolist()], float)
    length = part.counts()[order][item]
    impact = np.log1p((n - d + 0.5) / (d + 0.5))[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))
    impact = impact / np.maximum(np.bincount(item, impact, many), 1e-12)[item]
    start = np.searchsorted(term, np.arange(len(terms) + 1))
    blocks = -(-np.diff(start) // BLOCK)
    block_of = np.cumsum(blocks) - blocks
    first = np.repeat(start[:-1] - block_of * BLOCK, blocks) + np.arange(blocks.sum()) * BLOCK
    ends = np.append(first[1:], len(item))
    coarse = np.zeros((len(terms), RANGES), np.float32)
    np.maximum.at(coarse, (term, item * RANGES // many), impact)
    out = Index(np.array([items[k][0] for k in order], np.int64), terms, start, item, impact, key, np.maximum.reduceat(impact, start[:-1]), coarse, block_of, item[ends - 1], np.maximum.reduceat(impact, first), [], [], [], np.zeros(many, np.int64), STRIDE)
    for place, k in enumerate(order):
        own = part.hashes[part.first[k] : part.first[k + 1]]
        size = max(1, min(n_words, len(own)))
        out.size[place] = size
        one = Words(part.data, part.starts, part.ends, own, np.array([0, len(own)]))
        cut = len(own) - items[k][2]
        lead = Words(part.data, part.starts, part.ends, own[:cut], np.array([0, cut]))
        out.grams.append(np.unique(ngrams(one, size)[1]))
        out.question.append(np.unique(ngrams(lead, min(size, max(cut, 1)))[1]) if cut >= size else np.zeros(0, np.uint64))
        out.answer.append(np.unique(own[cut:]))
        out.stride = max(out.stride, len(own))
    return out


def classes(items: list[tuple[int, str, int]]) -> list[list[tuple[int, str, int]]]:
    """Items by length: up to STRIDE words, up to twice as many, and so on, so that a long item
    widens the windows of its own class only. Items without words are left out."""
    out: dict[int, list] = {}
    for x in items:
        if n := len(words(pa.array([x[1]], pa.large_string())).hashes):
            out.setdefault(max(0, int(np.ceil(np.log2(n / STRIDE)))), []).append(x)
    return [out[k] for k in sorted(out)]


def answer_length(text: str) -> int:
    """How many of an item's last words are its answer: the last sentence or line, and the
    last third of an item that is a single one."""
    n = len(words(pa.array([text], pa.large_string())).hashes)
    cut = max(text.rstrip(" .!?\n").rfind(c) for c in ".!?\n") + 1
    m = len(words(pa.array([text[cut:]], pa.large_string())).hashes) if cut else 0
    return m if 0 < m < n else max(1, n // 3)


def search(index: Index, part: Words, threshold: float, at_once: int = 1 << 12):
    """(text, from word, to word, item, score) of each window and item of at least ``threshold``."""
    stride, counts = index.stride, part.counts()
    place = np.searchsorted(index.terms, part.hashes)
    place[place == len(index.terms)] = 0
    known = np.flatnonzero(index.terms[place] == part.hashes)
    text = part.text_of()[known]
    cell = (known - part.first[text]) // stride
    per = np.maximum(1, -(-counts // stride))
    base = np.concatenate([[0], np.cumsum(per)])
    # A window is two cells, so each cell belongs to the window that starts there and the one before.
    own = base[text] + cell
    window = np.concatenate([own, own[cell > 0] - 1])
    term = np.concatenate([place[known], place[known][cell > 0]])
    key = distinct(window * len(index.terms) + term)
    window, term = key // len(index.terms), key % len(index.terms)
    if not len(key):
        return
    cut = np.flatnonzero(np.diff(window, prepend=-1))
    size = np.diff(np.append(cut, len(key)))
    could = np.add.reduceat(index.top[term], cut) >= threshold - 1e-4  # no pivot at all in the others
    for lo in range(0, len(cut), at_once):  # nor one that a whole range of items could bring to the threshold
        hi = min(lo + at_once, len(cut))
        end = cut[hi] if hi < len(cut) else len(key)
        could[lo:hi] &= (np.add.reduceat(index.coarse[term[cut[lo] : end]], cut[lo:hi] - cut[lo], axis=0) >= threshold - 1e-4).any(axis=1)
    some = np.repeat(could, size)
    window, term, size = window[some], term[some], size[could]
    ends = np.cumsum(size)
    for lo in range(0, len(size), at_once):
        hi = min(lo + at_once, len(size))
        here = slice(ends[lo] - size[lo], ends[hi - 1])
        for w, k, score in _walk(index, window[here], term[here], threshold):
            t = int(np.searchsorted(base, w, "right")) - 1
            at = part.first[t] + (w - base[t]) * stride
            yield t, max(part.first[t], at - stride // 2), min(part.first[t + 1], at + 2 * stride + stride // 2), k, score


def _walk(index: Index, window: np.ndarray, term: np.ndarray, threshold: float):
    """Block-max WAND of all windows at once: (window, item, score) of at least ``threshold``.

    A cursor is a (window, term) and its place among the term's postings. Every turn moves each
    window past its pivot, or past the blocks around it.
    """
    many, least = len(index.ids), threshold - 1e-4
    pos, end = index.start[term], index.start[term + 1]
    while len(term):
        current = index.item[pos]
        order = np.argsort(window * many + current, kind="stable")
        window, term, pos, end, current = window[order], term[order], pos[order], end[order], current[order]
        head = np.flatnonzero(np.diff(window, prepend=-1))
        group = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(term))))
        upto = np.cumsum(index.top[term])
        upto -= (upto[head] - index.top[term[head]])[group]
        reach = np.flatnonzero(upto >= least)
        pivot = np.full(len(head), many)
        np.minimum.at(pivot, group[reach], current[reach])
        live = pivot[group] < many  # a window whose maxima cannot reach the threshold is done
        before = live & (current <= pivot[group])
        k = np.flatnonzero(before)
        g = group[k]
        at = np.searchsorted(index.key, term[k] * many + pivot[g])
        inside = at < end[k]
        block = index.block_of[term[k]] + (at - index.start[term[k]]) // BLOCK
        block[~inside] = 0
        bound = np.bincount(g, np.where(inside, index.peak[block], 0), len(head))
        # Where the blocks cannot reach it: on to the end of the nearest block, or the next cursor beyond.
        skip = np.full(len(head), many)
        np.minimum.at(skip, g[inside], index.last[block[inside]] + 1)
        beyond = live & ~before
        np.minimum.at(skip, group[beyond], current[beyond])
        good = bound >= least
        hit = inside & good[g]
        hit[hit] = index.item[at[hit]] == pivot[g[hit]]
        score = np.bincount(g[hit], index.impact[at[hit]], len(head))
        for q in np.flatnonzero(good & (score >= threshold)):
            yield int(window[head[q]]), int(pivot[q]), float(score[q])
        to = at + hit
        far = ~good[g]
        to[far] = np.searchsorted(index.key, term[k[far]] * many + np.minimum(skip[g[far]], many))
        pos[k] = to
        keep = live & (pos < end)
        window, term, pos, end = window[keep], term[keep], pos[keep], end[keep]


def _share(part: np.ndarray, of: np.ndarray) -> float:
    return float(np.isin(of, part).mean()) if len(of) else 1.0


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = 0.8, threshold: float = 0.6, n_words: int = 5) -> DataFrame:
    """(doc, item_id, score, overlap, question_overlap, answer_overlap) of docs(doc, text).

    A row for each document and item such that some passage of the document scores at least
    ``threshold`` of the item's own score, holds ``least`` of its shingles, half of its
    question's and half of its answer's words; the passage of highest score is reported.
    Passages are windows of twice the longest item of a class of lengths (64 words at least),
    half overlapping, so every run as long as an item lies whole within one; checks look half a
    step further. An item shorter than a shingle is one shingle; items without words, null ids
    of items and documents and null texts match nothing. Rows repeated in docs give one row; an
    item id with several texts is matched by each. The documents are read once for every
    SHARD_BYTES of benchmark, once in all for a benchmark of up to some 50,000 items.
    """
    spark = docs.sparkSession
    big_batches(spark)
    source = docs.select(F.col("doc").cast("long").alias("doc"), F.col("text").cast("string").alias("text")).where("doc is not null and text is not null")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null").distinct()
    schema = "doc long, item_id long, score double, overlap double, question_overlap double, answer_overlap double"

    def stats(batches):
        for batch in batches:
            part = words(batch.column(0))
            text, term = part.text_of(), part.hashes
            pair = np.unique(np.stack([text.astype(np.uint64), term], 1), axis=0) if len(term) else np.zeros((0, 2), np.uint64)
            t, n = np.unique(pair[:, 1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([*t.view(np.int64).tolist(), None]), pa.array([*n.tolist(), len(term)])], names=["term", "n"])

    # Terms of one shard of items at a time meet on the driver; df counts cover the whole benchmark.
    df = items.select("text").mapInArrow(stats, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).persist()
    total = df.where("term is null").first()
    n_items, n_bytes = items.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    if not n_items or not total or not total["n"]:
        df.unpersist()
        return spark.createDataFrame([], schema)
    shards = -(-n_bytes // SHARD_BYTES)
    found = None
    for s in range(shards):
        some = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)) == s) if shards > 1 else items
        rows = sorted((r[0], r[1], answer_length(r[1])) for r in some.collect())  # SHARD_BYTES of text, or one item
        mine = np.unique(words(pa.array([t for _, t, _ in rows], pa.large_string())).hashes).view(np.int64).tolist()
        counts = {int(np.int64(r[0]).view(np.uint64)): r[1] for r in (df if shards == 1 else df.join(F.broadcast(spark.createDataFrame([(t,) for t in mine], "term long")), "term")).where("term is not null").collect()}
        indexes = [build(x, counts, n_items, max(1.0, total["n"] / n_items), n_words) for x in classes(rows)]
        held = spark.sparkContext.broadcast(indexes)

        def run(batches, held=held):
            indexes = held.value
            for batch in batches:
                ids = batch.column(0)
                for lo, hi in chunks(batch.column(1)):
                    part = words(batch.column(1).slice(lo, hi - lo))
                    best: dict[tuple[int, int], tuple] = {}
                    for index, (t, a, z, k, score) in ((x, hit) for x in indexes for hit in search(x, part, threshold)):
                        view = Words(part.data, part.starts, part.ends, part.hashes[a:z], np.array([0, z - a]))
                        has = ngrams(view, int(index.size[k]))[1]
                        over = _share(has, index.grams[k])
                        if over < least:
                            continue
                        asked = _share(has, index.question[k])
                        told = _share(view.hashes, index.answer[k])
                        if asked >= 0.5 and told >= 0.5:
                            key = (t, int(index.ids[k]))
                            best[key] = max(best.get(key, ()), (score, over, asked, told))
                    if best:
                        doc = ids.slice(lo, hi - lo).to_pylist()
                        cols = zip(*[(doc[t], i, *v) for (t, i), v in sorted(best.items())])
                        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64() if n < 2 else pa.float64()) for n, c in enumerate(cols)], names=["doc", "item_id", "score", "overlap", "question_overlap", "answer_overlap"])

        got = source.mapInArrow(run, schema)
        found = got if found is None else found.unionByName(got)
    df.unpersist()
    best = F.max(F.struct("score", "overlap", "question_overlap", "answer_overlap")).alias("b")
    return found.groupBy("doc", "item_id").agg(best).select("doc", "item_id", "b.*")
