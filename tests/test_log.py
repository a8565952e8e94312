"""The log API: writes, reads, errors, upkeep, streams; three short stories told whole."""

import random
import threading
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from palimpsest.functions.errors import DEFAULT_LIMIT, HistoryError, answer, page_limit
from palimpsest.functions.jsonexact import Codec
from palimpsest.functions.scalars import META_CIPHER, META_SUBJECT, parse_duration, parse_rfc3339
from palimpsest.log import As, Clock, Log
from palimpsest.operators.merge import increment
from palimpsest.operators.read import Query
from palimpsest.sources import jdbc
from palimpsest.sources.keyring import Keyring, MemoryKeyring
from palimpsest.sources.store import MemoryStore, Store
from palimpsest.streaming import merge as stream
from palimpsest.streaming import stateful

from test_merge import SCHEMA, plain, sequence, table


def day(y, m, d=1):
    return datetime(y, m, d)


MANY = "kind string, entity_id string, data binary, valid_from timestamp_ntz, valid_to timestamp_ntz, actor struct<id:string,type:string,name:string>, reason string, meta map<string,string>, intent int, seq long"
HR = {"id": "u-9", "type": "user", "name": "Kim"}


def code(call, *args, **kw):
    with pytest.raises(HistoryError) as e:
        call(*args, **kw)
    return e.value.code


@pytest.fixture
def clock():
    return Clock(day(2025, 1))


@pytest.fixture
def store(spark, tmp_path, clock):
    return Store(spark, f"file://{tmp_path}/log", clock)


@pytest.fixture(params=["memory", "parquet"])
def either(request, spark, store, clock):
    return MemoryStore(spark, clock) if request.param == "memory" else store


def values(rows, *names):
    return [tuple(r[n] for n in names) for r in rows]


def test_a_retroactive_correction_keeps_both_beliefs(store, clock):
    log = Log(store, clock)
    clock.set(day(2024, 3, 15))
    log.put("employee", "ann", b'{"salary":100}', day(2024, 3), None, HR, reason="hired")
    clock.set(day(2024, 6, 10))
    log.put("employee", "ann", b'{"salary":120}', day(2024, 6), None, HR, reason="raise")
    clock.set(day(2024, 7, 5))
    done = log.correct("employee", "ann", b'{"salary":110}', day(2024, 3), day(2024, 6), {"id": "u-2"}, reason="typing error", meta={"ticket": "7", "": "dropped"})
    assert len(done.written) == 1 and len(done.superseded) == 1 and done.tx == day(2024, 7, 5)
    april = day(2024, 4)
    assert bytes(log.get("employee", "ann", As.valid(april)).data) == b'{"salary":110}'
    assert bytes(log.get("employee", "ann", As(april, day(2024, 7, 4))).data) == b'{"salary":100}'
    assert bytes(log.get("employee", "ann").data) == b'{"salary":120}'
    assert bytes(log.get("employee", "ann", As.of(day(2024, 6, 20))).data) == b'{"salary":120}'
    assert log.get("employee", "ann", As.valid(april)).meta == {"ticket": "7"} and log.get("employee", "ann").meta is None
    d = log.diff("employee", "ann", As(april, day(2024, 7, 4)), As.valid(april))
    assert [tuple(c) for c in d.changes] == [("/salary", "modified", "100", "110")] and d.paths() == ["/salary"] and not d.is_empty() and d.change("/x") is None
    steps = log.field_history("employee", "ann", "/salary", As.valid(april)).collect()
    # The raise in June left 100 standing for the spring, under a record of its own.
    assert values(steps, "from_present", "from_value", "to_value", "intent") == [(False, None, "100", 0), (True, "100", "110", 1)]
    back = log.field_history("employee", "ann", "/salary", As.valid(april), descending=True).collect()
    assert values(back, "from_value", "to_value") == [("100", "110"), (None, "100")]
    tiles = log.timeline("employee", "ann", As(april, day(2024, 7, 5))).collect()
    assert values(tiles, "valid_from", "valid_to") == [(day(2024, 3), day(2024, 6)), (day(2024, 6), None)]
    assert values(log.history("employee", "ann", intent=2).collect(), "reason") == [("hired",)]


def test_a_move_learned_late(store, clock):
    log = Log(store, clock)
    clock.set(day(2024, 2))
    log.put("person", "ben", b'{"city":"Oslo","zip":"1"}', day(2020, 1), None, HR)
    clock.set(day(2024, 9, 15))
    done = log.put("person", "ben", b'{"city":"Rome","zip":"2"}', day(2024, 9), None, HR)
    assert len(done.written) == 2 and len(done.superseded) == 1  # the new record first, then what is left of the old one
    assert values(log.timeline("person", "ben").collect(), "valid_from", "valid_to", "intent") == [(day(2020, 1), day(2024, 9), 2), (day(2024, 9), None, 0)]
    assert log.diff("person", "ben", As.valid(day(2024, 8)), As.valid(day(2024, 10))).paths() == ["/city", "/zip"]
    assert log.diff("person", "ben", As.valid(day(2019, 1)), As.valid(day(2024, 10))).changes[0].op == "added"
    assert log.diff("person", "ben", As.valid(day(2024, 10)), As.valid(day(2019, 1))).changes[0].op == "removed"
    assert code(log.diff, "person", "ben", As.valid(day(2019, 1)), As.valid(day(2018, 1))) == "not_found"
    assert bytes(log.get("person", "ben", As.believed(day(2024, 9, 1))).data) == b'{"city":"Oslo","zip":"1"}'


def test_a_field_recorded_in_error(store, clock):
    log = Log(store, clock)
    clock.set(day(2024, 4))
    log.put("employee", "cy", b'{"salary":90,"bonus":10}', day(2024, 1), None, HR)
    clock.set(day(2024, 5))
    log.correct("employee", "cy", b'{"salary":90}', day(2024, 1), None, HR)
    clock.set(day(2024, 6))
    log.correct("employee", "cy", b'{"salary":90.0,"bonus":null}', day(2024, 1), None, HR)
    log.put("employee", "cy", b"null", day(2024, 1), None, HR)  # the same instant on the clock: a later one in the log
    at = As.valid(day(2024, 6))
    assert values(log.field_history("employee", "cy", "/bonus", at).collect(), "from_present", "from_value", "to_present", "to_value") == [
        (False, None, True, "10"), (True, "10", False, None), (False, None, True, "null"), (True, "null", False, None),
    ]
    assert values(log.field_history("employee", "cy", "/salary", at).collect(), "to_value") == [("90",), (None,)]
    times = [r.tx_from for r in log.history("employee", "cy").collect()]
    assert times[-1] == times[-2] + timedelta(microseconds=1) and log.now() == times[-1]
    assert code(log.field_history, "employee", "cy", "bonus", at) == "invalid_path"
    log.put("employee", "cy", b"[1]", day(2024, 1), None, HR)
    with pytest.raises(Exception, match="codec"):
        log.diff("employee", "cy", at, As(day(2024, 6), day(2024, 4)))


def test_refused_writes_change_nothing(either, clock):
    log = Log(either, clock, kinds=["a"])
    put = lambda kind="a", entity="e", a=None, b=None, actor=HR, **o: code(log.put, kind, entity, b"{}", a, b, actor, **o)
    assert put("b") == put("") == put("b", entity="") == "unknown_kind"
    assert put(entity="", actor={}) == "missing_entity_id" and put(actor={}, a=day(2025, 1), b=day(2025, 1)) == "missing_actor"
    assert put(entity="e\0") == put(actor={"id": "x", "name": "\0"}) == put(reason="\0") == "invalid_field"
    assert put(a=day(2025, 2), b=day(2025, 1)) == put(a=day(2025, 1), b=day(2025, 1), reason="\0") == "invalid_interval"
    assert put(meta={"palimpsest:x": "y", "z": "\0"}) == "reserved_meta" and put(meta={"z": "\0"}) == "invalid_meta"
    assert put(subject="s") == "no_keyring"
    assert len(either) == 0 and log.query(Query()) == ([], None)
    assert code(log.get, "a", "e") == "not_found" and code(log.get, "a", "") == "missing_entity_id" and code(log.get, "z", "e") == "unknown_kind"
    assert code(log.query, Query(kind="z")) == "unknown_kind" and code(log.query, Query(intent=9)) == "unknown_intent"
    assert log.history("a", "e").count() == 0 and code(log.verify, "a", "e") == code(log.chain_head, "a", "e") == "no_chain"
    either.close()
    assert code(log.put, "a", "e", b"{}", None, None, HR) == "closed"


def test_many_writes_at_once(either, clock, spark):
    log, rows = Log(either, clock), []
    for n, (_, e, k, _, a, b, intent, _, data) in enumerate(sequence(5, 40)):
        rows.append(("x", e, bytearray(data.encode()), a, b, ("u", "", ""), "", {}, intent, n))
    for part in (rows[:25], rows[25:]):
        _, bad, _ = log.write_many(spark.createDataFrame(part, MANY))
        assert {r.error_code for r in bad.collect()} <= {"invalid_interval"}
    got = {(r.entity_id, bytes(r.data).decode(), r.valid_from, r.valid_to, r.intent, r.tx_to is None) for r in either.read().collect()}
    assert got == {(e, str(k), a, b, intent, to is None) for e, k, a, b, _, intent, to in plain(sequence(5, 40))}


def test_sealed_writes_and_destroyed_keys(store, clock, spark, tmp_path):
    ring = Keyring(spark, f"file://{tmp_path}/ring") if not isinstance(store, MemoryStore) else MemoryKeyring(spark)
    log = Log(store, clock, keyring=ring)
    for n, subject in enumerate(("s1", "s2", None)):
        log.put("p", f"e{n}", b'{"n":1}', None, None, HR, subject=subject, meta={"k": "v"})
    assert ring.key("s1") == ring.key("s1") != ring.key("s2") and len(ring.key("s1")) == 32
    stored = {r.entity_id: r for r in log.query(Query())[0]}
    assert bytes(stored["e0"].data) != b'{"n":1}' == bytes(stored["e2"].data)
    assert stored["e0"].meta == {"k": "v", META_SUBJECT: "s1", META_CIPHER: "aes-256-gcm-1"}
    assert bytes(log.get("p", "e0").data) == b'{"n":1}'
    ring.destroy("s1")
    ring.destroy("s1")
    ring.destroy("never seen")
    assert code(log.get, "p", "e0") == "shredded" and code(log.field_history, "p", "e0", "/n") == "shredded"
    assert code(log.put, "p", "e0", b"{}", None, None, HR, subject="s1") == code(ring.key, "s1") == code(ring.key, "never seen") == "key_destroyed"
    assert bytes(log.get("p", "e1").data) == b'{"n":1}'
    assert code(Log(store, clock).get, "p", "e1") == "no_keyring"
    assert {(r.entity_id, r.status) for r in log.decrypt(store.read()).collect()} == {("e0", "shredded"), ("e1", "open"), ("e2", "plain")}
    moved = store.read().withColumn("entity_id", F.when(F.col("entity_id") == "e1", "e9").otherwise(F.col("entity_id")))
    assert {r.status for r in log.decrypt(moved).where("entity_id = 'e9'").collect()} == {"codec"}  # bound to its entity
    assert ring.frame().where("destroyed_at is not null and key is null").count() == 2


def test_chains_holds_and_sweeps(spark, tmp_path, clock):
    store = Store(spark, f"file://{tmp_path}/log", clock)
    log = Log(store, clock, chaining=True)
    for n in range(6):
        rows = [(kind, entity, bytearray(b'{"n":%d}' % n), day(2024, 1), None, ("u", "", ""), "", {}, 0, i) for i, (kind, entity) in enumerate((("a", "x"), ("a", "y"), ("b", "z")))]
        log.write_many(spark.createDataFrame(rows, MANY))
        clock.advance(timedelta(days=1))
    assert values([log.verify("a", "x")], "status", "chained", "tombstones") == [("intact", 6, 0)]
    head = log.chain_head("a", "x")
    assert store.place_hold({"id": "h", "kind": "a", "entity_id": "y", "placed_by": HR})["placed_at"] == clock.at.isoformat()
    week = [("a", timedelta(days=2)), ("b", timedelta(days=30))]
    plan = log.plan_retention(week)
    assert len(store) == 18 and values(plan.kinds.orderBy("kind").collect(), "kind", "examined", "deleted", "withheld", "tombstones") == [("a", 8, 4, 4, 4), ("b", 0, 0, 0, 0)]
    kept = []
    done = log.execute_retention(week, archive=lambda df: kept.append(df.count()))
    assert kept == [4] and len(store) == 14 and done.withheld.count() == 4 and {r.hold_id for r in done.withheld.collect()} == {"h"}
    assert values(done.kinds.orderBy("kind").collect(), "examined", "deleted") == [(8, 4), (0, 0)]
    assert store.tombstones("a", "x").count() == 4 and store.tombstones("a", "y").count() == 0
    assert values([log.verify("a", "x")], "status", "chained", "tombstones") == [("intact", 2, 4)] and log.chain_head("a", "x") == head
    log.put("a", "x", b"{}", None, None, HR)
    assert log.verify("a", "x").status == "intact"
    assert log.execute_retention(week).kinds.where("kind = 'a'").first().deleted == 0
    store.release_hold("h", HR, "over")
    with pytest.raises(RuntimeError, match="no room"):
        log.execute_retention(week, archive=lambda df: (_ for _ in ()).throw(RuntimeError("no room")))
    assert store.tombstones("a", "y").count() == 0  # what was not archived stays
    assert log.execute_retention(week).kinds.where("kind = 'a'").first().deleted == 4
    assert code(log.plan_retention, []) == "no_policy"
    for bad in ([("", timedelta(1))], [("a", timedelta(0))], [("a", timedelta(1)), ("a", timedelta(2))]):
        assert code(log.plan_retention, bad) == "invalid_policy"
    current = store.current().select("id")
    assert code(store.delete, store.read().select("id")) == "current_record" and store.delete(current.limit(0)) == 0


def test_store_contract(either, spark):
    rows = sequence(2, 12)
    w = table(spark, rows)
    either.apply(lambda cur: increment(cur, w), batch="one")
    n, log = len(either), either.read()
    either.seed(log.withColumn("data", F.lit("other")))  # ids that are there keep their first record
    assert len(either) == n and either.read().where("data = 'other'").count() == 0
    nobody = spark.createDataFrame([("nobody", day(2030, 1))], "id string, tx_to timestamp_ntz")
    either.supersede(nobody)
    ids = either.current().select("id", F.lit(day(2030, 1)).cast("timestamp_ntz").alias("tx_to")).limit(1).collect()
    one = spark.createDataFrame(ids, nobody.schema)
    either.supersede(one)
    either.supersede(one.withColumn("tx_to", F.lit(day(2031, 1)).cast("timestamp_ntz")))
    assert either.read().where("tx_to >= timestamp_ntz'2030-01-01'").first().tx_to == day(2030, 1)
    extra = log.limit(1).withColumn("id", F.lit("new"))
    for close in (one, nobody):
        assert code(either.apply, lambda _, close=close: (extra, close)) == "conflict"
    assert len(either) == n
    seen = either.overlapping("x", "e0", day(2026, 2), day(2026, 3)).collect()
    assert all((r.valid_from or datetime.min) < day(2026, 3) and (r.valid_to or datetime.max) > day(2026, 2) for r in seen)
    before = {tuple(r) for r in either.read().select("id", "tx_to").collect()}
    either.compact()
    assert {tuple(r) for r in either.read().select("id", "tx_to").collect()} == before


def test_two_writers_lose_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    Store(spark, path)
    parts = [[("x", "e", 100 * who + n, day(2027, 1), day(2026, 1) + timedelta(days=300 * who + n), day(2026, 1) + timedelta(days=300 * who + n + 1), 0, "u", "d") for n in range(4)] for who in range(2)]
    failed = []

    def work(rows):
        try:
            mine = Store(spark, path)
            for r in rows:
                one = table(spark, [r])
                mine.apply(lambda cur, one=one: increment(cur, one))
        except Exception as e:
            failed.append(e)

    threads = [threading.Thread(target=work, args=(p,)) for p in parts]
    [t.start() for t in threads]
    [t.join() for t in threads]
    log = Store(spark, path).read()
    assert not failed and log.count() == 8 and log.select("id").distinct().count() == 8
    assert len(list((tmp_path / "log" / "records").iterdir())) == 8  # lost attempts leave nothing


@pytest.mark.parametrize("start", [stream.start, stateful.start])
def test_streams(spark, tmp_path, start):
    spark.conf.set(*stateful.PROVIDER)
    rows = sequence(9, 60)
    store = Store(spark, f"file://{tmp_path}/log")
    for lo in (0, 30):  # the second run goes on from the checkpoint
        table(spark, rows[lo : lo + 30]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        source = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
        assert start(source, store, f"{tmp_path}/check").awaitTermination(100)
    got = {(r.entity_id, r.k, r.valid_from, r.valid_to, r.tx_from, r.intent, r.tx_to) for r in store.read().collect()}
    assert got == plain(rows)
    # Another stream with a checkpoint of its own is not taken for the first one.
    other = [("y", *r[1:]) for r in rows[:10]]
    table(spark, other).write.parquet(f"{tmp_path}/other")
    start(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/other"), store, f"{tmp_path}/check2").awaitTermination(100)
    assert store.read().where("kind = 'y'").count() == len(plain(other)) > 0


def test_filters_reach_the_scan(spark):
    from palimpsest.plans import history

    for q in (history.query_current_only, history.history_filtered):
        plan = q(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "EqualTo(event_type," in plan


def test_jdbc_round_trip(spark, clock):
    log = Log(MemoryStore(spark, clock), clock)
    for n in range(5):
        log.put("k", f"e{n}", b"\xff\x00", None if n else day(2024, 1), None, HR, reason="r", meta={"a": "b"} if n % 2 else None)
    url = f"jdbc:derby:memory:t{random.randrange(10**9)};create=true"
    spark.createDataFrame([], "x int")  # the driver is on Spark's own path
    options = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    jdbc.write(log.frame().withColumnRenamed("k", "_k"), url, "log", **options)
    back = jdbc.read(spark, url, "log", **options)
    shown = [c for c in back.columns if c != "data"]
    assert sorted(map(str, back.select(shown).collect())) == sorted(map(str, log.frame().select(shown).collect()))
    assert {bytes(r.data) for r in back.collect()} == {b"\xff\x00"}


def test_texts():
    assert parse_rfc3339("2026-03-01T01:00:00.1234567+01:00") == datetime(2026, 3, 1, 0, 0, 0, 123456)
    for bad in ("2026-03-01", "2026-03-01T00:00:00", "0001-01-01T00:00:00Z", "2026-13-01T00:00:00Z"):
        assert code(parse_rfc3339, bad) == "invalid_argument"
    assert parse_duration("8760h") == timedelta(days=365) and parse_duration("-1h30m") == -timedelta(minutes=90) and parse_duration("1.5s2ms") == timedelta(milliseconds=1502)
    assert parse_duration("0") == timedelta(0)
    for bad in ("", "5", "h", "1d", "1h x"):
        assert code(parse_duration, bad) == "invalid_policy"
    assert page_limit(None) == DEFAULT_LIMIT and page_limit("1000") == 1000
    for bad in ("0", "1001", "-1", "x", ""):
        assert code(page_limit, bad) == "invalid_argument"
    assert answer(HistoryError("shredded")) == (410, "shredded") and answer(HistoryError("closed")) == (503, "unavailable") and answer(HistoryError("invalid_path")) == (400, "invalid_path") and answer(ValueError()) == (500, "internal")
    assert As(datetime(2026, 1, 1, 2, tzinfo=timezone(timedelta(hours=2)))).resolved(day(2027, 1)) == As(day(2026, 1), day(2027, 1))


def test_codecs_are_replaceable(either, clock):
    class Pairs(Codec):
        def decode(self, data):
            return dict(x.split("=") for x in bytes(data).decode().split(";"))

    log = Log(either, clock, codec=Pairs())
    log.put("a", "e", b"x=1;y=2", None, None, HR)
    clock.advance(timedelta(days=1))
    log.put("a", "e", b"x=1;y=3", None, None, HR)
    assert log.diff("a", "e", As.of(day(2025, 1)), As()).paths() == ["/y"]
