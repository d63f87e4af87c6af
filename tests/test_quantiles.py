"""Exact quantiles and ranks against DuckDB and numpy, whether or not Spark reuses exchanges."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lumen.operators import quantiles, rows

LINES = "/root/testdata/sf0.1/lineitem.parquet"


@pytest.fixture(params=["true", "false"])
def reuse(request, spark):
    old = spark.conf.get("spark.sql.exchange.reuse")
    spark.conf.set("spark.sql.exchange.reuse", request.param)
    yield request.param
    spark.conf.set("spark.sql.exchange.reuse", old)


def test_large_columns_equal_duckdb(spark, reuse):
    cols, ps = ["l_extendedprice", "l_discount", "l_quantity"], [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0]
    got = {r["i"]: (r["count"], r["q"]) for r in quantiles.quantiles(spark.read.parquet(LINES), quantiles.numbers(cols), ps).collect()}
    for i, c in enumerate(cols):
        n, q = duckdb.sql(f"select count({c}), quantile_cont({c}, {ps}) from '{LINES}'").fetchall()[0]
        assert got[i][0] == n and np.allclose(got[i][1], q, rtol=1e-12, atol=0)


def test_ranks_and_steps_equal_duckdb(spark, reuse):
    df = spark.read.parquet(LINES).withColumn("k", F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    got = rows.average_ranks(df, "l_extendedprice").agg(F.sum(F.col("rank").cast("decimal(30,1)")), F.sum(F.col("rank").cast("decimal(30,1)") * F.col("k")), F.max("rank")).first()
    want = duckdb.sql(f"select sum(r::decimal(30,1)), sum(r::decimal(30,1) * k), max(r) from (select l_orderkey * 8 + l_linenumber as k, rank() over (order by l_extendedprice) + (count(*) over (partition by l_extendedprice) - 1) / 2.0 as r from '{LINES}')").fetchall()[0]
    assert [float(x) for x in got] == [float(x) for x in want]
    steps = rows.sequential_share(df, "k", "k").first()
    assert (steps["differences"], steps["ones"]) == duckdb.sql(f"select count(d), count(*) filter (where d = 1) from (select k - lag(k) over (order by k) as d from (select l_orderkey * 8 + l_linenumber as k from '{LINES}'))").fetchall()[0]


@pytest.mark.parametrize("accuracy", [1000, 50, 5])
def test_every_accuracy_gives_exact_values(spark, reuse, accuracy):
    r = np.random.default_rng(accuracy)
    ties = np.where(r.random(900) < 0.6, 7.0, r.normal(0, 100, 900))
    table = [(float(a), float(b), None if i % 3 else float(b), float("nan") if i % 2 else -float(a), None) for i, (a, b) in enumerate(zip(ties, r.integers(0, 3, 900)))]
    df = spark.createDataFrame(table, "a double, b double, c double, d double, e double")
    ps = [0.0, 0.1, 0.5, 0.9, 0.999, 1.0]
    got = {x["i"]: (x["count"], x["q"]) for x in quantiles.quantiles(df, quantiles.numbers(df.columns), ps, accuracy).collect()}
    for i in range(4):
        v = np.array([t[i] for t in table if t[i] is not None and t[i] == t[i]])
        assert got[i][0] == len(v) and np.allclose(got[i][1], np.quantile(v, ps), rtol=0, atol=1e-9)
    assert 4 not in got
    one = quantiles.quantile_row(df, quantiles.numbers(["e", "b"]), [0.5]).first()
    assert one["q0"] is None and one["count0"] == 0 and one["q1"] == [1.0]
    assert quantiles.quantiles(df.limit(0), quantiles.numbers(["a"]), [0.5]).count() == 0


def test_positions_rise_with_values(spark):
    df = spark.sql("select * from values ('', timestamp_ntz'2020-01-01 00:00:00', date'1969-12-31', false), ('Zebra', timestamp_ntz'2020-01-01 00:00:01', date'1970-01-01', false), ('apple', timestamp_ntz'2021-01-01 00:00:00', date'2020-01-01', true), ('é', timestamp_ntz'2022-01-01 00:00:00', date'2021-01-01', true) t(s, t, d, b)")
    for c, k in df.dtypes:
        got = [r[0] for r in df.orderBy(c).select(quantiles.position(F.col(c), k)).collect()]
        assert got == sorted(got)
    ranks = {r["s"]: r["rank"] for r in rows.average_ranks(df, "s").collect()}
    assert ranks == {"": 1.0, "Zebra": 2.0, "apple": 3.0, "é": 4.0}


@pytest.mark.parametrize("n", [1, 2, 3, 5, 19, 21])
def test_few_values(spark, n):
    v = [float((7 * i) % n) for i in range(n)]
    ps = [0.05, 0.25, 0.5, 0.75, 0.95]
    for accuracy in (1000, 5):
        got = quantiles.quantiles(spark.createDataFrame([(x,) for x in v], "a double"), quantiles.numbers(["a"]), ps, accuracy).first()
        assert np.allclose(got["q"], np.quantile(v, ps))


def test_ranks_of_frequent_values_are_not_joined_by_key(spark):
    from pyspark.sql import functions as F

    from lumen.operators import rows

    x = spark.range(30_000).select("id", F.when(F.col("id") % 3 == 0, 1.0).when(F.col("id") % 3 == 1, F.col("id") * 1.0).alias("v"))
    got = rows.average_ranks(x, "v").withColumn("p", F.spark_partition_id())
    assert "_s" in got._jdf.queryExecution().toString()
    r = {q["id"]: (q["rank"], q["_ties"]) for q in got.collect()}
    # 10,000 ones; 1.0 itself is also the value of id 1.
    assert r[0] == r[1] == (5001.0, 10_001) and r[4] == (10_002.0, 1) and r[2] == (None, None) and r[29_998] == (20_000.0, 1) and len(r) == 30_000
