"""Kendall's tau-b by counting inversions in range partitions.

Distinct pairs of values are counted first.  x and y are cut into ranges at fixed
cut points, so every pair of points is of one of three kinds: in different ranges
of both, which the grid of range counts settles; in one range of x, which one
task counts; or in one range of y but different ones of x, likewise.  A range
that holds a single value has no discordant pairs inside and is not searched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumen.functions.columns import finite, rounded

#: Distinct pairs of values that a range holds, roughly, and the most ranges of a column.
RANGE, RANGES = 20_000, 1000


def inversions(y: np.ndarray, weight: np.ndarray) -> int:
    """Sum of weight[i] * weight[j] over i < j with y[i] > y[j], bit by bit from the highest: among values equal so far, ones before zeros."""
    _, code = np.unique(y, return_inverse=True)
    w = weight.astype(object) if float(weight.sum()) ** 2 > 2**62 else weight.astype(np.int64)
    total, group = 0, np.zeros(len(code), np.int64)
    for bit in range(int(code.max()).bit_length() - 1, -1, -1) if len(code) else ():
        one = (code >> bit) & 1
        ones = np.cumsum(w * one)
        before = ones - w * one
        start = np.append(True, group[1:] != group[:-1])
        base = before[np.maximum.accumulate(np.where(start, np.arange(len(code)), 0))]
        total += int(((before - base) * w * (1 - one)).sum())
        key = group * 2 + one
        order = np.argsort(key, kind="stable")
        code, w, group = code[order], w[order], key[order]
    return total


def _within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (range, first, second, n), sorted by range, first, second: discordant pairs of each range, equal firsts aside."""
    now, held = None, []

    def done():
        f, s, n = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((s, f))  # equal firsts ascend, so they count nothing
        return pa.RecordBatch.from_pydict({"d": pa.array([str(inversions(s[order], n[order]))])})

    for b in batches:
        r = b.column(0).to_numpy()
        cuts = np.flatnonzero(np.append(True, r[1:] != r[:-1])) if len(r) else []
        for i, j in zip(cuts, [*cuts[1:], len(r)]):
            if r[i] != now and held:
                yield done()
                held.clear()
            now = r[i]
            held.append(tuple(b.column(c).to_numpy()[i:j] for c in (1, 2, 3)))
    if held:
        yield done()


def _edges(df: DataFrame, column: str, ranges: int) -> list[float]:
    at = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
    q = df.agg(F.percentile_approx(column, at, F.lit(max(10_000, 10 * ranges))).alias("q")).first()["q"] if ranges > 1 else []
    return sorted(set(q or []))


def _range(column: str, edges: list[float]) -> Column:
    """The number of edges below a value, by halving."""
    at = np.array(edges, float)

    def find(values: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(at, values.to_numpy(zero_copy_only=False), "left").astype(np.int32))

    return F.arrow_udf(find, "int")(F.col(column)) if edges else F.lit(0)


def tau_b(df: DataFrame, a: str, b: str, digits: int | None = 6, per_range: int = RANGE) -> DataFrame:
    """One row: ``a, b, r, n``; rows with a null or infinite value on either side are left out, and r is null where a column has one value."""
    x, y = finite(F.col(f"`{a}`").cast("double")), finite(F.col(f"`{b}`").cast("double"))
    points = df.select(x.alias("x"), y.alias("y")).where("x is not null and y is not null").groupBy("x", "y").agg(F.count("*").alias("n"))
    points = points.persist()
    size = points.count()
    ranges = max(1, min(RANGES, size // per_range))
    ex, ey = _edges(points, "x", ranges), _edges(points, "y", ranges)
    placed = points.select("x", "y", "n", _range("x", ex).alias("i"), _range("y", ey).alias("j")).persist()

    def tied(c: str):
        return points.groupBy(c).agg(F.sum("n").cast("decimal(38,0)").alias("t")).agg(F.coalesce(F.sum(F.col("t") * (F.col("t") - 1) / 2).cast("decimal(38,0)"), F.lit(0))).first()[0]

    n = points.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    both = points.agg(F.coalesce(F.sum(F.col("n").cast("decimal(38,0)") * (F.col("n") - 1) / 2).cast("decimal(38,0)"), F.lit(0))).first()[0]
    tx, ty, all_ = int(tied("x")), int(tied("y")), n * (n - 1) // 2
    # Different ranges of both: the grid.
    grid = np.zeros((len(ex) + 1, len(ey) + 1), object)
    for r in placed.groupBy("i", "j").agg(F.sum("n").alias("n")).collect():  # RANGES squared at most
        grid[r["i"], r["j"]] = r["n"]
    discordant, above = 0, np.zeros(len(ey) + 1, object)
    for row in grid:
        greater = np.append(np.cumsum(above[::-1])[::-1][1:], 0)  # of earlier ranges of x, those in later ranges of y
        discordant += int((row * greater).sum())
        above = above + row
    # One range of x; then one range of y, with ranges of x for values, so that pairs of one range of x are not met again.
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), ranges)  # a range or a few in each
    for rows in (placed.select(F.col("i").alias("r"), "x", "y", "n"), placed.select(F.col("j").alias("r"), F.col("i").cast("double").alias("x"), "y", "n")):
        several = rows.groupBy("r").agg(F.min("x").alias("l"), F.max("x").alias("h"), F.min("y").alias("m"), F.max("y").alias("o")).where("l < h and m < o").select(F.col("r").alias("_r"))
        met = rows.join(F.broadcast(several), F.col("r") == F.col("_r"), "left_semi").select("r", "x", "y", "n").repartition(tasks, "r").sortWithinPartitions("r")  # RANGES rows at most
        found = met.mapInArrow(_within, "d string").agg(F.sum(F.col("d").cast("decimal(38,0)"))).first()[0]
        discordant += int(found or 0)
    placed.unpersist()
    points.unpersist()
    concordant = all_ - tx - ty + int(both) - discordant
    below = float(all_ - tx) ** 0.5 * float(all_ - ty) ** 0.5
    r = (concordant - discordant) / below if below else None
    out = df.sparkSession.createDataFrame([(a, b, r, n)], "a string, b string, r double, n long")
    return out if digits is None else out.withColumn("r", rounded(F.col("r"), digits))
