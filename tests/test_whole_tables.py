"""Queries that must take in every row of their tables."""

from datetime import date

from lumen.operators import rows
from lumen.queries import QUERIES


def test_daily_counts_hold_every_event_and_empty_days(spark, small):
    n = spark.read.parquet(small + "/events.parquet").where("ts is not null").count()
    assert sum(r["n"] for r in QUERIES["win11_daily_counts"](spark, small).collect()) == n
    df = spark.sql("select timestamp(x) as ts from values ('2024-01-01 00:00:00'), ('2024-01-01 23:59:59'), ('2024-01-04 03:00:00'), (null) t(x)")
    assert sorted((r["day"], r["n"]) for r in rows.daily_counts(df, "ts").collect()) == [(date(2024, 1, 1), 2), (date(2024, 1, 2), 0), (date(2024, 1, 3), 0), (date(2024, 1, 4), 1)]


def test_key_overlap_sides_hold_every_order(spark, small):
    odd, even = set(), set()
    for r in spark.read.parquet(small + "/orders.parquet").select("o_orderkey", "o_custkey").collect():
        (odd if r["o_orderkey"] % 2 else even).add(r["o_custkey"])
    assert {r["o_custkey"] for r in QUERIES["jon03_key_overlap"](spark, small).collect()} == odd & even
