"""Connected components of an edge table, by alternating large-star and small-star rounds.

Every round is two aggregations by node and two joins, written to the shared
folder; no edges reach the driver, and a node of very many neighbours is
pre-aggregated before each shuffle and split by adaptive skew handling.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumen.llm.shared import shared_dir, stage


def _least(e: DataFrame) -> DataFrame:
    return e.groupBy("u").agg(F.min("v").alias("m"))


def _large(e: DataFrame) -> DataFrame:
    both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    m = _least(both).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(m, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small(e: DataFrame) -> DataFrame:
    m = _least(e)  # every edge leads from a node to a smaller one
    moved = e.join(m, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(m.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``node, root`` for each node of edges (a, b: long, no nulls): root is the smallest node that it reaches. Roots themselves are not listed."""
    root = shared_dir(edges.sparkSession)
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    e = stage(e, "edges", root)
    print_of = None
    for i in range(rounds):
        e = stage(_small(_large(e)), f"round{i}", root)
        row = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        now = (row["n"], row["h"])
        if now == print_of:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        print_of = now
    raise RuntimeError(f"components did not settle within {rounds} rounds")
