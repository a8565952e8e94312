import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from palimpsest.functions.errors import HistoryError
from palimpsest.operators import merge, read
from palimpsest.sources.store import Store
from palimpsest.streaming.merge import increment

T = [datetime(2026, m, 1) for m in range(1, 7)]
SCHEMA = "kind string, entity_id string, k long, tx timestamp_ntz, valid_from timestamp_ntz, valid_to timestamp_ntz, intent int, actor string, data string"
N = None


def relations():
    """Every relation of two intervals with ends among three months or none, and the tiling that follows from it."""
    low, high = -1, 9
    ivs = [(a, b) for a in (N, 0, 2, 4) for b in (1, 2, 4, N) if (low if a is N else a) < (high if b is N else b)]
    for old in ivs:
        for new in ivs:
            (a, b), (c, d) = ((low if x is N else x, high if y is N else y) for x, y in (old, new))
            rest = [("old", x, y) for x, y in ((a, min(b, c)), (max(a, d), b)) if x < y] if a < d and c < b else [("old", a, b)]
            yield old, new, [(w, N if x == low else x, N if y == high else y) for w, x, y in sorted([*rest, ("new", c, d)], key=lambda t: t[1])]


RELATIONS = list(relations())


def at(i):
    return None if i is None else T[i]


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("how", ["replay", "merge_set"])
def test_relations(spark, how):
    rows = []
    for n, (old, new, _) in enumerate(RELATIONS):
        for k, (who, iv) in enumerate((("old", old), ("new", new))):
            rows.append(("x", f"e{n}", k, datetime(2026, 1, 1, k), at(iv[0]), at(iv[1]), 0, "u", who))
    out = getattr(merge, how)(table(spark, rows)).where("tx_to is null").collect()
    for n, (_, _, want) in enumerate(RELATIONS):
        got = sorted(((r.data, r.valid_from, r.valid_to) for r in out if r.entity_id == f"e{n}"), key=lambda r: r[1] or datetime.min)
        assert got == [(w, at(a), at(b)) for w, a, b in want], n


def sequence(seed, steps=40):
    rng, rows = random.Random(seed), []
    grid = [datetime(2026, 1, 1) + timedelta(days=30 * i) for i in range(9)]
    for k in range(steps):
        a, b = (rng.choice(grid) if rng.random() > 0.2 else None for _ in range(2))
        rows.append(("x", f"e{rng.randrange(3)}", k, datetime(2027, 1, 1) + timedelta(hours=k), a, b, int(rng.random() < 0.25), "u", str(k)))
    return rows


def plain(rows):
    """Sequential supersede-and-split over lists."""
    lo, hi = datetime.min, datetime.max
    open_, out = [], []
    for _, e, k, tx, a, b, intent, actor, data in rows:
        a, b = a or lo, b or hi
        if a >= b:
            continue
        keep = []
        for t in open_:
            if t[0] == e and t[1] < b and a < t[2]:
                out.append((*t, tx))
                keep += [(e, x, y, t[3], tx, 2) for x, y in ((t[1], a), (b, t[2])) if x < y]
            else:
                keep.append(t)
        open_ = [*keep, (e, a, b, k, tx, intent)]
    out += [(*t, None) for t in open_]
    return {(e, k, None if a == lo else a, None if b == hi else b, tx, intent, to) for e, a, b, k, tx, intent, to in out}


@pytest.mark.parametrize("seed", range(4))
def test_against_sequential_replay(spark, seed):
    rows = sequence(seed)
    for how in (merge.replay, merge.merge_set):
        got = {(r.entity_id, r.k, r.valid_from, r.valid_to, r.tx_from, r.intent, r.tx_to) for r in how(table(spark, rows)).collect()}
        assert got == plain(rows)


def test_increments_and_store_equal_the_batch(spark, tmp_path):
    rows = sequence(9, 60)
    store = Store(spark, f"file://{tmp_path}/log")
    for n, lo in enumerate(range(0, 60, 20)):
        part = table(spark, rows[lo : lo + 20])
        for _ in range(2):  # the second time is a no-op
            store.apply(lambda cur, part=part: increment(cur, part), batch=f"b{n}")
    got = {(r.entity_id, r.k, r.valid_from, r.valid_to, r.tx_from, r.intent, r.tx_to) for r in store.read().collect()}
    assert got == plain(rows)
    ids = store.read().where("tx_to is null").select("id").limit(1)
    with pytest.raises(HistoryError, match="current_record"):
        store.delete(ids)
    closed = store.read().where("tx_to is not null").select("id")
    assert store.delete(closed) > 0 and store.read().where("tx_to is not null").count() == 0


def test_pages_walk_the_whole_order(spark):
    r = read.with_ids(merge.replay(table(spark, sequence(3, 25)))).cache()
    for descending in (False, True):
        whole = [x.id for x in read.query(r, read.Query(descending=descending)).collect()]
        seen, after = [], None
        while True:
            rows, after = read.page(r, read.Query(limit=7, descending=descending, after=after))
            seen += [x.id for x in rows]
            if after is None:
                break
        assert seen == whole
    rows, cursor = read.page(r, read.Query(limit=len(whole)))
    assert cursor is None
    with pytest.raises(HistoryError, match="invalid_cursor"):
        read.decode_cursor("AAAA")
    with pytest.raises(HistoryError, match="unknown_intent"):
        read.query(r, read.Query(intent=7))


@pytest.mark.parametrize("n", [0, 25])
def test_a_walk_in_ranges_gives_the_same_pages(spark, tmp_path, n):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several ranges of these few rows
    rows = [r[:3] + (T[0],) + r[4:] for r in sequence(3, n)]  # one instant: unbounded starts and ids decide
    read.in_ranges(read.with_ids(merge.replay(table(spark, rows)))).write.parquet(f"{tmp_path}/r")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    r = spark.read.parquet(f"{tmp_path}/r")
    assert n == 0 or r.select(read.RANGE).distinct().count() > 1
    for limit in (7, r.count(), 0):
        for descending in (False, True):
            q, seen, after, page = {"limit": limit, "descending": descending}, [], None, 0
            while page == 0 or after is not None:
                rows, after = read.page(r, read.Query(**q, after=after))
                assert read.page_end(r, read.Query(**q, after=seen and cursor or None)) == after
                seen += [(page, page * limit + i, x.id) for i, x in enumerate(rows)]
                page, cursor = page + 1, after
            got = read.walk(r, read.Query(**q)).select("page", "place", "id").collect()
            assert sorted(got) == seen


def test_entity_joins_are_equi_joins(spark):
    w = table(spark, sequence(1))
    probes = w.select("kind", "entity_id", F.col("tx").alias("valid_at"), F.col("tx").alias("tx_at"))
    plan = read.get(merge.replay(w), probes)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
