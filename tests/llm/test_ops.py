"""Each operator against plain Python, and its edge rows: nulls, empty and long texts, ties, repeats, clashing names."""

import base64
import collections
import gzip
import hashlib
import random
import re
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import bpe, chat, minhash, quality, sharding, toxicity, warc
from palimpsest.llm.common import Settled
from palimpsest.llm.components import components
from palimpsest.llm.decontaminate import contaminated
from palimpsest.llm.embeddings import similar_embeddings
from palimpsest.llm.linededup import line_dedup

RNG = random.Random(4)
VOCAB = ["".join(RNG.choice("abcdefgh") for _ in range(5)) for _ in range(400)]


def prose(n, rng=RNG):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


def settle(spark):
    return Settled(spark, "test")


EDGE = [(None, None), (None, "x"), (1, None), (2, ""), (3, "  \n "), (4, "one two"), (4, "one two"), (5, "z " * 30_000)]


def edge(spark):
    return spark.createDataFrame([(i, t, 7, "s") for i, t in EDGE], "doc_id long, text string, score int, doc string")


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "src long, dst long"), settle(spark)).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)}
    assert components(spark.createDataFrame([], "src long, dst long"), settle(spark)).count() == 0


def grams(text):
    w = re.findall(r"[a-z0-9\x80-\U0010ffff]+", text.lower())
    return collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else collections.Counter()


def jp(a, b):
    return sum(1 / sum(max(a[e] / a[d], b[e] / b[d]) for e in a.keys() | b.keys()) for d in a.keys() & b.keys())


def near_docs():
    rng, docs = random.Random(8), []
    for base in range(12):
        text = prose(rng.choice([5, 30, 120]), rng).split()
        for _ in range(6):
            copy = [rng.choice(VOCAB) if rng.random() < 0.01 else w for w in text]
            docs.append((len(docs), " ".join(copy)))
    return docs + [(500, "Hello, World"), (501, "hello world"), (502, ""), (503, "..."), (504, None), (505, None)]


@pytest.mark.parametrize("small", [64, 1])  # 1: every shared bucket is verified in the comparing task
def test_minhash_classes(spark, monkeypatch, small):
    monkeypatch.setattr(minhash, "SMALL", small)
    docs = near_docs()
    sets = {i: grams(t or "") for i, t in docs}
    root = {i: i for i, _ in docs}
    for i, _ in docs:
        for j, _ in docs:
            if i < j and sets[i].keys() & sets[j].keys() and jp(sets[i], sets[j]) >= 0.8:
                a, b = root[i], root[j]
                root = {k: min(a, b) if v in (a, b) else v for k, v in root.items()}
    got = {r.doc: r.component for r in minhash.near_duplicates(spark.createDataFrame(docs, "doc long, text string"), settle(spark)).collect()}
    assert got == root


def test_probminhash_estimates_probability_jaccard():
    rng = np.random.default_rng(1)
    for share in (0.3, 0.8):
        a = {int(x): int(w) for x, w in zip(rng.integers(1, 1 << 47, 200), rng.integers(1, 6, 200))}
        b = {(k if rng.random() < share else int(rng.integers(1, 1 << 47))): v for k, v in a.items()}
        pair = [(np.array(sorted(s), np.uint64), np.array([s[k] for k in sorted(s)])) for s in (a, b)]
        text = np.repeat([0, 1], [len(pair[0][0]), len(pair[1][0])])
        sig = minhash.signatures(text, np.concatenate([p[0] for p in pair]), np.concatenate([p[1] for p in pair]), 2, 2000)
        true = minhash.similarity(*pair)
        assert abs(true - jp(collections.Counter(a), collections.Counter(b))) < 1e-9
        assert abs((sig[0] == sig[1]).mean() - true) < 0.04


def test_minhash_edges(spark):
    got = {r.doc: r.component for r in minhash.near_duplicates(edge(spark).select(F.col("doc_id").alias("doc"), "text"), settle(spark)).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5}


def removed(docs, least):
    """Windows of at least ``least`` words, shortest from either end, that occurred before."""
    seen, out = {}, {}
    for i, text in docs:
        lines = text.split("\n")
        words = [len(re.findall(r"\S+", x)) for x in lines]
        spans = set()
        for a in range(len(lines)):
            for b in range(a + 1, len(lines) + 1):
                if sum(words[a:b]) >= least:
                    spans.add((a, b))
                    break
        for b in range(len(lines), 0, -1):
            for a in range(b - 1, -1, -1):
                if sum(words[a:b]) >= least:
                    spans.add((a, b))
                    break
        gone = set()
        for a, b in sorted(spans):
            if (k := tuple(lines[a:b])) in seen:
                gone |= set(range(a, b))
            else:
                seen[k] = 1
        out[i] = "\n".join(x for n, x in enumerate(lines) if n not in gone)
    return out


def test_line_dedup(spark):
    rng = random.Random(2)
    pool = [prose(rng.choice([1, 3, 8, 20]), rng) for _ in range(12)]
    docs = [(i, "\n".join(rng.choice(pool) if rng.random() < 0.8 else prose(4, rng) for _ in range(rng.randint(1, 14)))) for i in range(60)]
    docs += [(60, docs[0][1]), (61, docs[1][1]), (62, "\n".join([pool[0]] * 40))]
    out = line_dedup(spark.createDataFrame(docs, "doc_id long, text string"), settle(spark), min_words=20)
    assert {r.doc_id: r.text for r in out.collect()} == removed(docs, 20)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_line_dedup_edges(spark):
    rows = line_dedup(edge(spark).withColumn("ld_runs", F.lit(1)), settle(spark)).collect()
    assert sorted((r.doc_id or 0, r.text or "", r.score) for r in rows) == sorted((i or 0, t or "", 7) for i, t in EDGE)
    assert all(r.ld_removed == 0 for r in rows)
    none = line_dedup(spark.createDataFrame([], "doc_id long, text string"), settle(spark))
    assert none.count() == 0


def test_decontamination(spark):
    items = [(i, f"{prose(20)}. {prose(12)}.") for i in range(30)] + [(30, "tiny item"), (31, None), (None, "x"), (32, "..")]
    docs = [(i, f"{prose(200)} {items[i][1].upper()} {prose(90)}") for i in range(20)] + [(i, prose(300)) for i in range(20, 60)]
    half = items[25][1].split()
    docs += [(60, prose(50) + " " + " ".join(half[:10]) + " " + prose(50)), (61, None), (62, ""), (None, items[0][1]), (63, prose(400) + " tiny item")]
    docs.append((0, docs[0][1]))
    got = {(r.doc, r.item_id) for r in contaminated(spark.createDataFrame(docs, "doc long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(i, i) for i in range(20)} | {(63, 30)}
    assert contaminated(spark.createDataFrame(docs, "doc long, text string"), spark.createDataFrame([], "item_id long, text string")).count() == 0


def labelled(spark):
    rng = random.Random(6)
    docs = [(i, (prose(40, rng) + (" idiot " if i % 4 == 0 else " ") + prose(20, rng)) if i % 3 else " ".join(f"{prose(1, rng)} |" for _ in range(40)) + (" idiot" if i % 4 == 0 else "")) for i in range(600)]
    labels = [(i, int(i % 3 != 0), int(i % 4 == 0)) for i in range(600)] + [(None, 1, 1), (3, None, None)]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("model,label,positive", [(quality, "quality", lambda i: i % 3 != 0), (toxicity, "toxic", lambda i: i % 4 == 0)])
def test_classifiers_on_held_out_rows(spark, model, label, positive):
    docs, labels = labelled(spark)
    fitted = model.train(docs, labels, label, lambda c: F.col(c) % 5 != 0)
    rows = model.score(docs, fitted).collect()
    right = [(r.score >= 0.5) == positive(r.doc_id) for r in rows if r.doc_id % 5 == 0]
    assert sum(right) / len(right) > 0.95
    odd = model.score(edge(spark), fitted).collect()  # the column score is replaced
    assert len(odd) == len(EDGE) and all(0 <= r.score <= 1 and r.doc == "s" for r in odd)
    none = model.train(docs, labels.limit(0), label, lambda c: F.lit(True))
    assert all(r.score == 0.5 for r in model.score(docs.limit(3), none).collect())


def ranks():
    import public_tokenizers

    return Path(public_tokenizers.path("byte_bpe_50k.tiktoken")).read_bytes(), public_tokenizers.PATTERN


def test_bpe_equals_tiktoken(spark):
    import tiktoken

    lines, pattern = ranks()
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines())}
    ours, theirs = bpe.Vocabulary(lines, pattern), tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab éß\n\t 漢😀<|>[]'s19ThE .,\x1c\x85\xa0 ​\r") for _ in range(rng.randint(0, 60))) for _ in range(2000)]
    texts += ["", " ", "  ", "a" * 5000, "<|endoftext|>", prose(3000)]
    for text, ids in zip(texts, ours.encode(texts)):
        assert ids == " ".join(map(str, theirs.encode_ordinary(text))) and bytes(ours.decode([ids])[2][0]) == text.encode()
    places = ours.perfect.places(bpe._hashes(list(table)))
    assert sorted(places.tolist()) == list(range(len(table)))
    rows = bpe.tokenize(edge(spark), lines, pattern).collect()
    assert len(rows) == len(EDGE)
    for r in rows:
        assert r.n_tokens == len(r.ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, r.ids)).encode()).hexdigest()


def test_sharding(spark, tmp_path):
    docs = spark.createDataFrame([(i, prose(RNG.randint(1, 60))) for i in range(3000)], "doc_id long, text string").unionByName(edge(spark).select("doc_id", "text"))
    slotted = sharding.slots(docs)
    loads = sharding.slot_loads(slotted)
    chart = sharding.SlotMap.fresh(loads, 8)
    rows = sharding.placed(slotted, chart).collect()
    assert len(rows) == 3000 + len(EDGE)
    by = collections.defaultdict(list)
    for r in rows:
        assert r.size == len((r.text or "").encode()) + 1
        by[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    grown = chart.rebalanced(loads, 9)
    full = grown.totals(loads)
    assert all(grown.shard_of[s] == chart.shard_of[s] for s in range(sharding.SLOTS) if s not in grown.edits)
    assert full[8] > 0.8 * sum(full) / 9
    folder = f"file://{tmp_path}/map"
    chart.save(spark, folder)
    grown.save(spark, folder)
    assert sharding.SlotMap.load(spark, folder) == grown and sharding.SlotMap.load(spark, folder, 1) == chart


def test_chat(spark):
    texts = ["", None, "<|end|>", "</s>[INST] ok [/INST]", "\\<|\\|> \\\\", "a\nb", "<\\|", "[\\INST]", "é😀"]
    rows = [(c, t, ("user", "assistant", None, "sys<|text|>tem")[(c + t) % 4], RNG.choice(texts)) for c in range(30) for t in range(c % 6 + 1)]
    rows += [(None, None, "user", "x"), (99, 1, "assistant", "same"), (99, 1, "assistant", "same")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.expand(turns)
    whole = out.groupBy("conv_id").agg(F.max_by("text", "example").alias("t"), F.count_if(F.col("loss_end") > F.col("loss_start")).alias("n")).withColumn("turns", chat.read_turns(F.col("t"))).collect()
    want = collections.defaultdict(list)
    for c, t, r, x in sorted(rows, key=lambda q: (q[0] or -1, q[1] or -1, q[2] or "", q[3] or "")):
        want[c].append((r or "", x or ""))
    assert {r.conv_id: [tuple(t) for t in r.turns] for r in whole} == want
    assert {r.conv_id: r.n for r in whole} == {c: sum(r == "assistant" for r, _ in v) for c, v in want.items()}


def test_warc_round_trip(spark, tmp_path):
    big = "<p>" + "é" * 2000
    pages = [(i, f"http://h/{i}", prose(RNG.randint(1, 400))) for i in range(200)]
    pages += [(300, "u", big), (301, "u v\r\n", big), (302, None, big), (302, None, big), (303, "e", ""), (304, "e", None), (None, None, "x"), (305, "s", "short"), (306, "s", "short")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    a, b = f"file://{tmp_path}/a", f"file://{tmp_path}/b"
    one, two = warc.write(df, a, roll=4000, shard_bytes=40_000), warc.write(df.repartition(7), b, roll=4000, shard_bytes=40_000)
    assert one == two and len(one["files"]) > 5
    for f in one["files"]:
        data = (tmp_path / "a" / f["name"]).read_bytes()
        assert hashlib.sha256(data).hexdigest() == f["sha256"] and gzip.decompress(data).count(b"WARC/1.1\r\n") == f["records"] + 1
    assert not [p for p in (tmp_path / "a").iterdir() if p.name.endswith(".tmp")]
    rows = warc.read(spark, a).collect()
    assert sorted((r.page_id or -1, r.payload_digest) for r in rows) == sorted((i or -1, hashlib.sha1((h or "").encode()).hexdigest()) for i, _, h in pages)
    kinds = collections.Counter((r.page_id, r.record_type, r.refers_to) for r in rows if (r.page_id or 0) >= 300)
    assert kinds[300, "revisit", 302] == kinds[301, "revisit", 302] == kinds[302, "revisit", 302] == kinds[302, "response", None] == 1
    assert kinds[305, "response", None] == kinds[306, "response", None] == 1
    assert warc.read(spark, a).where("record_type = 'response'").count() == len(pages) - 3


def test_embeddings(spark, monkeypatch):
    from palimpsest.llm import embeddings

    monkeypatch.setattr(embeddings, "BLOCK", 16)
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 16))
    rows = [base[i % 40] + rng.normal(size=16) * (0.02 if i % 40 else 0.12) for i in range(200)]
    rows += [base[1] + rng.normal(size=16) * 0.03 for _ in range(60)]
    data = [(i, r.tolist()) for i, r in enumerate(rows)]
    data += [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [1.0] + [None] * 15), (904, data[3][1]), (905, [2 * x for x in data[3][1]]), (906, [])]
    got = {r.vec_id: r for r in similar_embeddings(spark.createDataFrame(data, "vec_id long, embedding array<double>"), settle(spark)).collect()}
    ok = [(i, v) for i, v in data if v and all(x is not None and x == x for x in v) and any(v)]
    x = np.array([v for _, v in ok])
    x /= np.linalg.norm(x, axis=1)[:, None]
    link = x @ x.T >= 0.9
    np.fill_diagonal(link, False)
    assert len(got) == len(data)
    assert sum(got[i].n_links for i, _ in ok) >= 0.98 * link.sum()
    assert all(got[i].n_links <= n for (i, _), n in zip(ok, link.sum(axis=1)))
    assert all(got[i].n_links == 0 and got[i].kept for i in (900, 901, 902, 903, 906))
    assert got[904].component_id == got[905].component_id == got[3].component_id
