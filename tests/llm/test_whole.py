"""Operators and queries against brute force, empty tables, hot groups, and the pipeline stage by stage."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import common, decontaminate, embeddings, minhash, quality, queries, sharding, toxicity, warc
from palimpsest.llm.common import Settled, block_pairs, meet
from palimpsest.llm.decontaminate import contaminated
from palimpsest.llm.embeddings import similar_embeddings
from palimpsest.llm.linededup import line_dedup

SF = "/root/testdata/sf0.001"
RNG = random.Random(11)
VOCAB = ["".join(RNG.choice("abcdefgh") for _ in range(4)) for _ in range(1500)]
COMMON = ["the", "of", "to", "in", "and", "a", "is", "it"]


def prose(n, rng=RNG):
    return " ".join(rng.choice(COMMON) if rng.random() < 0.4 else rng.choice(VOCAB) for _ in range(n))


def settle(spark):
    return Settled(spark, "test")


def components_of(ids, linked):
    root = {i: i for i in ids}
    for a, b in linked:
        x, y = sorted((root[a], root[b]))
        if x != y:
            root = {k: x if v == y else v for k, v in root.items()}
    return root


@pytest.mark.parametrize("small", [32, 2])  # 2: nearly all buckets go through blocks
def test_every_link_of_2000_vectors(spark, monkeypatch, small):
    monkeypatch.setattr(embeddings, "SMALL", small)
    monkeypatch.setattr(embeddings, "BLOCK", 64)
    rng = np.random.default_rng(small)
    x = rng.normal(size=(2000, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    for k in range(400):  # planted links at 0.90 to 0.92
        d = rng.normal(size=32)
        d -= (d @ x[k]) * x[k]
        cos = rng.uniform(0.9005, 0.92)
        x[1000 + k] = cos * x[k] + math.sqrt(1 - cos * cos) * d / np.linalg.norm(d)
    x[1500:1700] = x[1500] + rng.normal(size=(200, 32)) * 0.03
    rows = [(i, (v * 3).tolist()) for i, v in enumerate(x)]
    got = {r.vec_id: r for r in similar_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), settle(spark)).collect()}
    link = x @ x.T >= 0.9 * np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None, :]
    np.fill_diagonal(link, False)
    n = link.sum(axis=1)
    wrong = [i for i in range(2000) if got[i].n_links != n[i]]
    assert sum(got[i].n_links for i in range(2000)) >= 0.98 * n.sum() and all(got[i].n_links <= n[i] for i in range(2000)) and len(wrong) <= 20
    root = components_of(range(2000), zip(*np.nonzero(np.triu(link))))
    off = [i for i in range(2000) if got[i].component_id != root[i]]
    assert len(off) <= 10 and all(got[i].kept == (got[i].component_id == i) for i in range(2000))


def test_rows_that_repeat_an_id_are_vectors_of_their_own(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [-1.0, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert [tuple(r) for r in similar_embeddings(df, settle(spark)).orderBy("vec_id").collect()] == [(1, 0, 1, True), (1, 0, 1, True), (2, 0, 2, True)]
    twice = df.unionByName(df).unionByName(spark.createDataFrame([(7, [2.0, 0.0])], df.schema))
    got = sorted(tuple(r) for r in similar_embeddings(twice, settle(spark)).collect())
    assert got == [(1, 1, 1, True)] * 2 + [(1, 2, 1, True)] * 2 + [(2, 1, 2, True)] * 2 + [(7, 2, 1, False)]


def test_blocks_are_bounded_and_cover_all_pairs_of_unlike_groups(spark):
    rows = [(1, i, 5) for i in range(3000)] + [(1, 5000 + i, 6) for i in range(700)] + [(1, 9000 + i, 9000 + i) for i in range(40)] + [(2, 1, 1), (2, 2, 1)]
    out = block_pairs(spark.createDataFrame(rows, "key long, id long, g long"), "g", settle(spark), 512).collect()
    blocks = collections.defaultdict(lambda: ([], []))
    for r in out:
        assert r.key == 1  # a key of one group has no pair of unlike groups
        for k in (0, 1):
            if r.side in (0, k + 1):
                blocks[r.lo, r.hi][k].append((r.id, r.g))
    assert max(len(side) for b in blocks.values() for side in b) <= 2 * 512 and len(out) < 12 * 3740
    met = collections.Counter(frozenset((a, b)) for left, right in blocks.values() for a, g in left for b, h in right if g != h)
    assert len(met) == 3000 * 700 + 3700 * 40 + 40 * 39 // 2


def test_hot_groups_are_joined_whole(spark):
    rows = spark.range(9000).select(F.when(F.col("id") < 3000, 0).otherwise(F.col("id") % 5000).alias("k"), "id")
    groups = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    assert meet(rows, groups, ["k"], 9000, hot=16).select("id").distinct().count() == 9000


def test_minhash_with_a_hot_bucket(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 32)
    base = prose(120).split()
    docs = [(i, " ".join([*base[:60], f"x{i}", *base[60:]])) for i in range(150)] + [(1000 + i, " ".join([*base[:100], *prose(45).split()])) for i in range(20)] + [(2000, prose(100))]
    got = {r.doc: r.component for r in minhash.near_duplicates(spark.createDataFrame(docs, "doc long, text string"), settle(spark)).collect()}

    def grams(t):
        w = t.split()
        return collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))

    sets = {i: grams(t) for i, t in docs}

    def jp(a, b):
        return sum(1 / sum(max(a[e] / a[d], b[e] / b[d]) for e in a.keys() | b.keys()) for d in a.keys() & b.keys())

    reps = [0, *range(1000, 1020), 2000]
    linked = [(0, i) for i in range(150)] + [(a, b) for k, a in enumerate(reps) for b in reps[k + 1 :] if jp(sets[a], sets[b]) >= 0.8]
    assert jp(sets[0], sets[1]) >= 0.8 and got == components_of(sets, linked)


def bm25(docs, items, least=0.8, threshold=0.6):
    """Every window against every item by plain BM25, then the overlaps."""
    cut = lambda t: re.findall(r"[a-z0-9]+", t.lower())
    its = {i: cut(t) for i, t in items}
    df = collections.Counter(w for ws in its.values() for w in set(ws))
    mean = sum(map(len, its.values())) / len(its)

    def weights(ws):
        tf = collections.Counter(ws)
        out = {w: math.log1p((len(its) - df[w] + 0.5) / (df[w] + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(ws) / mean)) for w, f in tf.items()}
        return {w: v / sum(out.values()) for w, v in out.items()}

    impact = {i: weights(ws) for i, ws in its.items()}
    five = lambda ws: {tuple(ws[k : k + 5]) for k in range(max(1, len(ws) - 4))}
    found = set()
    for d, text in docs:
        ws = cut(text)
        stride = max(64, max(map(len, its.values())))
        for at in range(0, max(1, len(ws)), stride):
            terms = set(ws[at : at + 2 * stride])
            view = ws[max(0, at - stride // 2) : at + 2 * stride + stride // 2]
            for i, own in its.items():
                if sum(v for w, v in impact[i].items() if w in terms) >= threshold and len(five(own) & five(view)) >= least * len(five(own)):
                    found.add((d, i))
    return found


def test_decontamination_against_plain_bm25_with_2000_items(spark):
    rng = random.Random(3)
    items = [(i, prose(rng.randint(15, 60), rng)) for i in range(2000)]
    docs = []
    for d in range(60):
        words = prose(rng.randint(50, 400), rng).split()
        for i in rng.sample(range(2000), 2):
            own = items[i][1].split()
            for _ in range(rng.choice([0, 0, 1, 4])):
                own[rng.randrange(len(own))] = "zzz"
            at = rng.randrange(len(words))
            words[at:at] = own
        docs.append((d, " ".join(words)))
    got = {(r.doc, r.item_id) for r in contaminated(spark.createDataFrame(docs, "doc long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = bm25(docs, items)
    assert len(want) > 60 and got <= want
    # The halves of question and answer may refuse what the overlap alone takes; exact copies they never do.
    exact = {(d, i) for d, t in docs for i, x in items if f" {x} " in f" {t} "}
    assert exact <= got and len(got) >= 0.97 * len(want)


def test_a_long_item_has_windows_of_its_own(spark):
    long = prose(900)
    items = [(1, long), (2, prose(30))]
    docs = [(1, prose(300) + " " + long + " " + prose(300)), (2, prose(500) + " " + items[1][1]), (3, prose(2000))]
    assert [len(c) for c in decontaminate.classes([(i, t, 5) for i, t in items])] == [1, 1]
    got = {(r.doc, r.item_id) for r in contaminated(spark.createDataFrame(docs, "doc long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(1, 1), (2, 2)}


def test_sharding_balances_repeated_rows_and_the_query_holds(spark):
    docs = spark.createDataFrame([(7, "same")] * 5000 + [(i, f"text {i}") for i in range(5000)], "doc_id long, text string")
    store = settle(spark)
    slotted = store(sharding.slots(docs))
    chart = sharding.SlotMap.fresh(sharding.slot_loads(slotted), 8)
    rows = sharding.placed(slotted, chart).groupBy("shard").agg(F.sum("size").alias("b"), F.min("slot").alias("lo"), F.max("slot").alias("hi"), F.countDistinct("slot").alias("d"), F.count(F.lit(1)).alias("n")).collect()
    assert max(r.b for r in rows) < 1.02 * min(r.b for r in rows) and all((r.lo, r.hi + 1, r.d) == (0, r.n, r.n) for r in rows)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op5_sharding(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        data = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "bytes", None) and 0 <= r.shard < 8


def test_warc_with_any_ids(spark, tmp_path):
    text = lambda: "".join(RNG.choice("abcdef") for _ in range(300))
    for n, rows in enumerate(([(-(2**63), text()), (2**63 - 1, text())] + [(i, text()) for i in range(300)], [(None, text()) for _ in range(300)], [(7, text()) for _ in range(300)] + [(2**60, "x")])):
        made = warc.write(spark.createDataFrame(rows, "page_id long, html string").withColumn("url", F.lit("u")), f"file://{tmp_path}/{n}", shard_bytes=40_000)
        assert max(f["records"] for f in made["files"]) < 80 and len(made["files"]) > 4
        back = warc.read(spark, f"file://{tmp_path}/{n}").collect()
        key = lambda r: (r[0] is not None, r[0] or 0, r[1])
        assert sorted(((r.page_id, r.payload_digest) for r in back), key=key) == sorted(((i, hashlib.sha1(t.encode()).hexdigest()) for i, t in rows), key=key)


def test_scores_against_plain_sums(spark):
    """FTRL and the factorization machine's score, term by term."""
    model = quality.FTRL(6, alpha=0.3, beta=1.0, l1=0.1, l2=0.2)
    z, n, rng = [0.0] * 6, [0.0] * 6, random.Random(1)

    def w(i):
        return 0.0 if abs(z[i]) <= 0.1 else -(z[i] - math.copysign(0.1, z[i])) / ((1.0 + math.sqrt(n[i])) / 0.3 + 0.2)

    for _ in range(200):
        at = sorted(rng.sample(range(6), 3))
        x, y = [rng.random() for _ in at], float(0 in at)
        p = 1 / (1 + math.exp(-sum(w(i) * v for i, v in zip(at, x))))
        model.learn(np.array(at), np.array(x), y)
        for i, v, before in [(i, v, w(i)) for i, v in zip(at, x)]:
            g = (p - y) * v
            z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / 0.3 * before
            n[i] += g * g
    assert np.allclose(model.weights(), [w(i) for i in range(6)])
    texts = ["aa bb cc", "aa", "", "bb cc dd aa aa"]
    import pyarrow as pa

    _, buckets, _ = toxicity.terms(pa.array(["aa bb cc dd"]))
    rng2 = np.random.default_rng(2)
    m = {"at": np.sort(buckets), "w": rng2.normal(size=4), "v": rng2.normal(size=(4, 8)).astype(np.float32), "b": np.array([0.3])}
    place = {b: k for k, b in enumerate(m["at"].tolist())}
    rows = toxicity.score(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), m).orderBy("doc_id").collect()
    for r in rows:
        ks = [place[b] for b in toxicity.terms(pa.array([r.text]))[1].tolist()]
        s = 0.3 + sum(m["w"][k] for k in ks) + sum(float(m["v"][i] @ m["v"][j]) for a, i in enumerate(ks) for j in ks[a + 1 :])
        assert abs(r.score - 1 / (1 + math.exp(-s))) < 1e-5


def test_only_a_pair_of_terms_decides(spark):
    rng, rows = random.Random(4), []
    for _ in range(3000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        terms = [1] * a + [2] * b + rng.sample(range(10, 40), 5)
        rows.append((np.array(sorted(terms)), float(a and b)))
    m = toxicity.fit(rows[:2500], epochs=10)
    place = {b: k for k, b in enumerate(m["at"].tolist())}
    right = 0
    for at, y in rows[2500:]:
        ks = [place[b] for b in at.tolist() if b in place]
        s = m["b"][0] + sum(m["w"][k] for k in ks) + sum(float(m["v"][i] @ m["v"][j]) for n, i in enumerate(ks) for j in ks[n + 1 :])
        right += (s >= 0) == bool(y)
    assert right >= 0.97 * 500


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    keep = lambda c: F.lit(True)
    assert quality.score(docs, quality.train(docs, labels, "quality", keep)).count() == 0
    assert toxicity.score(docs, toxicity.train(docs, labels, "toxic", keep)).count() == 0
    assert similar_embeddings(spark.createDataFrame([], "vec_id long, embedding array<float>"), settle(spark)).count() == 0
    assert minhash.near_duplicates(docs.withColumnRenamed("doc_id", "doc"), settle(spark)).count() == 0
    slotted = sharding.slots(docs)
    assert sharding.placed(slotted, sharding.SlotMap.fresh(sharding.slot_loads(slotted), 8)).count() == 0
    assert line_dedup(docs, settle(spark)).count() == 0
    assert contaminated(docs.withColumnRenamed("doc_id", "doc"), spark.createDataFrame([(1, "a b c")], "item_id long, text string")).count() == 0
    folder = f"{settle(spark).root}/empty"
    assert warc.write(spark.createDataFrame([], "page_id long, url string, html string"), folder) == {"files": []}
    assert warc.read(spark, folder).count() == 0


def test_the_pipeline_stage_by_stage(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, texts = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    stages = dict(p.STAGES)
    assert list(stages) == ["quality classifier", "line dedup", "MinHash near-dedup", "benchmark decontamination", "byte-level BPE"]
    # Quality: exactly the documents that the query predicts to be good.
    good = {r.doc_id for r in queries.op1_quality_classifier(spark, SF).where("predicted = 1").collect()}
    kept = stages["quality classifier"](spark, docs, SF)
    assert kept.columns == columns and {r.doc_id for r in kept.collect()} == good
    # Lines: as plain Python deletes them; what was only copies goes, n_chars follows the text.
    from test_ops import removed

    plain = removed(sorted((i, t) for i, t in texts.items() if t is not None), 50)
    rows = {r.doc_id: r for r in stages["line dedup"](spark, docs, SF).collect()}
    assert {i: r.text for i, r in rows.items() if texts[i] is not None} == {i: t for i, t in plain.items() if t or not texts[i]}
    assert all(r.n_chars == len(r.text) for i, r in rows.items() if r.text != texts[i])
    # MinHash: one document, the smallest id, of each class.
    classes = {r.doc_id: r.class_id for r in queries.op3_minhash_near_dedup(spark, SF).collect()}
    out = stages["MinHash near-dedup"](spark, docs, SF)
    assert out.columns == columns and {r.doc_id for r in out.collect()} == {min(i for i, c in classes.items() if c == k) for k in set(classes.values())}
    # Benchmark: no document that holds an item stays.
    hit = {r.doc_id for r in queries.op10_decontamination(spark, SF).collect()}
    out = stages["benchmark decontamination"](spark, docs, SF)
    assert out.columns == columns and {r.doc_id for r in out.collect()} == texts.keys() - hit
    # The whole run: every stage on what its predecessor kept.
    run = {r.doc_id: r for r in p.run(spark, SF).collect()}
    assert run and all(len(r.ids) == r.n_tokens and hashlib.sha256(" ".join(map(str, r.ids)).encode()).hexdigest() == r.ids_sha256 for r in run.values())
    assert run.keys() <= good


def test_a_cluster_without_a_shared_folder_is_refused(spark, monkeypatch):
    class Far:
        conf = type("C", (), {"get": staticmethod(lambda key, other=None: None)})
        sparkContext = type("S", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Far())


@pytest.mark.parametrize("name", ["op2_embedding_near_dedup", "op6_chat_formatting", "op7_warc", "op9_line_dedup"])
def test_queries_against_their_sql(spark, name):
    import duckdb

    from palimpsest.llm.sql import ORACLES

    c = duckdb.connect()
    for t in ("documents", "embeddings", "conversations", "pages"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    names = sorted(got.columns)
    want = c.sql(f"SELECT {', '.join(names)} FROM ({ORACLES[name]})").fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got.select(names).collect())
