"""Mutual information of two columns by nearest neighbours, without bins.

For two columns of numbers the distance to the k-th neighbour in the plane sets,
for each row, how near values count as equal in either column; for a class and a
number, the distance to the k-th neighbour within the class does.  Neighbours in
the plane come from tiles; how many values lie within a distance comes from
ranks, counted over value ranges at fixed cut points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumen.functions.columns import finite, rounded
from lumen.operators.plane import kth_distance
from lumen.operators.quantiles import ranged
from lumen.session import shared_dir

#: Distances are taken this much shorter, so that the k-th neighbour itself lies outside whatever the rounding.
SHORTER = 1 - 1e-9


def digamma(n: Column) -> Column:
    """Of whole numbers from 1: six steps up, then the asymptotic series."""
    m = n.cast("double") + 6
    series = F.log(m) - 1 / (2 * m) - 1 / (12 * m**2) + 1 / (120 * m**4) - 1 / (252 * m**6)
    for i in range(6):
        series = series - 1 / (n.cast("double") + i)
    return series


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (range, side, value, id, before, n) sorted by range and side: of each probe (side 1: values below it; 2: values up to it) how many values there are, with those of the ranges before."""
    now, held = None, []
    values, sums = np.zeros(0), np.zeros(1, np.int64)
    for b in batches:
        r, side = b.column(0).to_numpy(), b.column(1).to_numpy()
        cuts = np.flatnonzero(np.append(True, (r[1:] != r[:-1]) | (side[1:] != side[:-1]))) if len(r) else []
        for i, j in zip(cuts, [*cuts[1:], len(r)]):
            if r[i] != now:
                now, held, values, sums = r[i], [], np.zeros(0), np.zeros(1, np.int64)
            v = b.column(2).to_numpy()[i:j]
            if side[i] == 0:
                held.append((v, b.column(5).to_numpy()[i:j]))
                continue
            if held:
                values, n = (np.concatenate(x) for x in zip(*held))
                order = np.argsort(values)
                values, sums, held = values[order], np.concatenate([[0], np.cumsum(n[order])]), []
            n = sums[np.searchsorted(values, v, "left" if side[i] == 1 else "right")] + b.column(4).to_numpy()[i:j]
            yield pa.RecordBatch.from_arrays([b.column(3).slice(i, j - i), pa.array(side[i:j].astype(np.int32)), pa.array(n.astype(np.int64))], ["id", "side", "n"])


def counts_within(values: DataFrame, probes: DataFrame) -> DataFrame:
    """``id, n``: how many values (column ``v``, each ``c`` times if there is such a column) lie from ``low`` to ``high`` of each of probes (id, low, high)."""
    parts = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = probes.select("id", F.explode(F.array(F.struct(F.lit(1).alias("side"), F.col("low").alias("v")), F.struct(F.lit(2).alias("side"), F.col("high").alias("v")))).alias("p")).select("id", "p.side", "p.v")
    distinct = values.groupBy("v").agg((F.sum("c") if "c" in values.columns else F.count("*")).alias("c"))  # so that a frequent value is one row
    both = distinct.select(F.lit(None).cast("long").alias("id"), F.lit(0).alias("side"), "v", "c").unionByName(asked.withColumn("c", F.lit(0).cast("long")))
    cut = ranged(both, "v", parts, "r")
    # Values of earlier ranges; ranges without values have none of their own, so every range that a probe is in is listed.
    w = Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    sizes = cut.groupBy("r").agg(F.sum("c").alias("c")).select(F.col("r").alias("_r"), F.coalesce(F.sum("c").over(w), F.lit(0)).alias("before"))
    met = cut.join(F.broadcast(sizes), F.col("r") == F.col("_r")).select("r", "side", "v", "id", "before", "c").repartition(parts, "r").sortWithinPartitions("r", "side")
    found = met.mapInArrow(_placed, "id long, side int, n long")
    return found.groupBy("id").agg((F.max(F.when(F.col("side") == 2, F.col("n"))) - F.max(F.when(F.col("side") == 1, F.col("n")))).alias("n"))


def _points(df: DataFrame, a: str, b: Column) -> DataFrame:
    """``id, x, y`` of the rows that have both, written once: ids must be the same wherever they are read. x is over its deviation."""
    x = finite(F.col(f"`{a}`").cast("double"))
    both = df.select(x.alias("x"), b.alias("y")).where("x is not null and y is not null").withColumn("id", F.monotonically_increasing_id())
    path = f"{shared_dir(df.sparkSession)}/points"
    both.write.parquet(path)
    out = df.sparkSession.read.parquet(path)
    sd = out.agg(F.stddev_pop("x")).first()[0] or 1.0
    return out.select("id", (F.col("x") / F.lit(sd)).alias("x"), "y")


def of_numbers(df: DataFrame, a: str, b: str, k: int = 3) -> DataFrame:
    """One row: ``nats, n`` of two columns of numbers; no less than 0, null for k rows or fewer."""
    p = _points(df, a, finite(F.col(f"`{b}`").cast("double")))
    sd = p.agg(F.stddev_pop("y")).first()[0] or 1.0
    places = p.withColumn("y", F.col("y") / F.lit(sd)).groupBy("x", "y").agg(F.min("id").alias("id"), F.count("*").alias("c"))  # rows of one place have one answer
    path = f"{shared_dir(df.sparkSession)}/places"
    places.write.parquet(path)
    p = df.sparkSession.read.parquet(path)
    near = kth_distance(p, k).select(F.col("id").alias("_id"), (F.col("r") * SHORTER).alias("r"))
    at = p.join(near, F.col("id") == F.col("_id"))
    n = p.select("id", "c")
    for c in ("x", "y"):
        m = counts_within(p.select(F.col(c).alias("v"), "c"), at.select("id", (F.col(c) - F.col("r")).alias("low"), (F.col(c) + F.col("r")).alias("high"))).withColumnRenamed("n", f"n{c}")
        n = n.join(m, "id")
    mean = lambda e: F.sum(F.col("c") * digamma(F.col(e))) / F.sum("c")
    means = n.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), mean("nx").alias("a"), mean("ny").alias("b"))
    nats = digamma(F.col("n")) + digamma(F.lit(k)) - F.col("a") - F.col("b")
    return means.select(F.when(F.col("n") > k, rounded(F.greatest(F.lit(0.0), nats))).alias("nats"), "n")


def of_classes(df: DataFrame, feature: str, target: str, k: int = 3) -> DataFrame:
    """One row: ``nats, n`` of a column of numbers and one of classes; classes of one row are left out, those of k rows or fewer take as many neighbours as they have."""
    p = _points(df, feature, F.col(f"`{target}`"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = p.groupBy(F.col("y").alias("_y")).agg(F.count("*").alias("size")).where("size > 1")
    p = p.join(F.broadcast(size) if size.limit(100_001).count() <= 100_000 else size, F.col("y") == F.col("_y")).drop("_y")
    # Each range of values takes the k nearest of its class from the ranges beside it: all of their ends, as far as they are filled.
    r = _in_class(p, k, parts)
    probes = r.select("id", (F.col("x") - F.col("r") * SHORTER).alias("low"), (F.col("x") + F.col("r") * SHORTER).alias("high"))
    m = counts_within(p.select(F.col("x").alias("v")), probes).withColumnRenamed("id", "_id")
    one = p.join(m, F.col("id") == F.col("_id"))
    own = F.least(F.lit(k), F.col("size") - 1)
    means = one.agg(F.count("*").alias("n"), F.avg(digamma(own)).alias("k"), F.avg(digamma(F.col("size"))).alias("c"), F.avg(digamma(F.col("n"))).alias("m"))
    nats = digamma(F.col("n")) + F.col("k") - F.col("c") - F.col("m")
    return means.select(F.when(F.col("n") > 0, rounded(F.greatest(F.lit(0.0), nats))).alias("nats"), "n")


def _in_class(p: DataFrame, k: int, parts: int) -> DataFrame:
    """``id, x, r``: the distance to the k-th nearest of the row's class (fewer in small classes), in order of values within range and class; ends of ranges lend their last k rows to those beside them."""
    cut = ranged(p, "x", parts, "g").select("id", "x", "y", "size", "g")
    lead = Window.partitionBy("y", "g").orderBy("x", "id")
    tail = Window.partitionBy("y", "g").orderBy(F.desc("x"), F.desc("id"))
    ends = cut.withColumn("a", F.row_number().over(lead)).withColumn("b", F.row_number().over(tail))
    # The first k of later ranges and the last k of earlier ones, of which the nearest k count.
    heads, tails = ends.where(F.col("a") <= k), ends.where(F.col("b") <= k)
    pick = lambda rows, w, c: rows.select("y", "g", "x").groupBy("y", "g").agg(F.sort_array(F.collect_list("x"), asc=w).alias(c))  # noqa: E731  k values
    firsts, lasts = pick(heads, True, "f"), pick(tails, False, "l")
    both = firsts.join(lasts, ["y", "g"])
    after = Window.partitionBy("y").orderBy("g").rowsBetween(1, k)
    before = Window.partitionBy("y").orderBy(F.desc("g")).rowsBetween(1, k)  # ranges of a class: as many as there are ranges
    lent = both.select(F.col("y").alias("_y"), F.col("g").alias("_g"), F.slice(F.flatten(F.collect_list("f").over(after)), 1, k).alias("up"), F.slice(F.flatten(F.collect_list("l").over(before)), 1, k).alias("down"))
    w = lead
    steps = [F.abs(F.lag("x", i).over(w) - F.col("x")) for i in range(1, k + 1)] + [F.abs(F.lead("x", i).over(w) - F.col("x")) for i in range(1, k + 1)]
    inner = cut.withColumn("d", F.array(*steps)).join(lent, (F.col("y") == F.col("_y")) & (F.col("g") == F.col("_g")))
    away = lambda c: F.transform(c, lambda v: F.abs(v - F.col("x")))
    all_ = F.array_sort(F.filter(F.concat("d", away("up"), away("down")), lambda v: v.isNotNull()))
    return inner.select("id", "x", F.get(all_, F.least(F.lit(k), F.col("size") - 1).cast("int") - 1).alias("r"))
