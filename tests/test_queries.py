"""Each engine query against its DuckDB statement on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from palimpsest.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


def plain(v):
    if pd.isna(v):
        return "-"
    return str(bool(v)) if type(v).__name__.startswith("bool") else repr(round(float(v), 6)) if isinstance(v, (int, float)) else str(v)


def rows(df):
    return sorted(tuple(map(plain, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_a_walk_gathers_no_pages(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    gathered, collect = [], DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda self: gathered.append(out := collect(self)) or out)
    out = QUERIES["last_page_empty"](spark, SF)
    most = max(map(len, gathered))
    assert out.where("page = 0 and not descending").count() > 50 and most <= 4  # ranges, as many as shuffle partitions


def test_length_prefixes_of_64_bits(spark, tmp_path):
    from pyspark.sql import functions as F

    from palimpsest.functions.scalars import uvarint

    def coded(n):  # as Go's binary.AppendUvarint
        return f"{n:02X}" if n < 128 else f"{n & 127 | 128:02X}" + coded(n >> 7)

    edges = [0, *(1 << 7 * k for k in range(1, 9)), *((1 << 7 * k) - 1 for k in range(1, 10)), 1 << 36, -1, -(1 << 63)]
    df = spark.createDataFrame([(n,) for n in edges], "n long").select("n", F.hex(uvarint(F.col("n"))))
    assert {n: x for n, x in df.collect()} == {n: coded(n % (1 << 64)) for n in edges}
    ids = [185363, 185364, 262143, 262144, 599999, 3037000499]  # squares around 2^35 and 2^36, and the last of 63 bits
    spark.createDataFrame([(i, "{}") for i in ids], "event_id long, props string").write.parquet(f"{tmp_path}/events.parquet")
    got = QUERIES["uvarint_prefix"](spark, str(tmp_path)).collect()
    assert {r.event_id: r["bytes"] for r in got} == {i: coded(i * i) for i in ids}
