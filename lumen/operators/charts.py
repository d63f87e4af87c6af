"""Chart datasets: bins, bars, shares, lines, domains."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumen.functions.columns import finite, rounded, url_domain
from lumen.operators.quantiles import numbers, quantile_row
from lumen.operators.summaries import exact_mean


def histogram(df: DataFrame, column: str, bins: int | None = None) -> DataFrame:
    """Equal-width bins with their midpoints and counts, empty ones left out; the number of bins by the narrower of the Freedman-Diaconis and Sturges widths."""
    v = finite(F.col(f"`{column}`").cast("double"))
    q = quantile_row(df, numbers([column]), [0.25, 0.75]).select((F.col("q0")[1] - F.col("q0")[0]).alias("iqr"))
    s = df.agg(F.count(v).alias("n"), F.min(v).alias("a"), F.max(v).alias("b")).join(F.broadcast(q))  # one row each
    width = F.col("b") - F.col("a")
    sturges = width / (F.log2("n") + 1)
    fd = 2 * F.col("iqr") / F.pow(F.col("n").cast("double"), F.lit(1 / 3))
    k = F.lit(bins) if bins else F.when(width <= 0, 1).otherwise(F.ceil(width / F.when(F.col("iqr") > 0, F.least(fd, sturges)).otherwise(sturges)))
    s = s.where("n > 0").select("a", "b", k.cast("int").alias("k"))
    x = df.select(v.alias("v")).where("v is not null").join(F.broadcast(s))  # one row
    at = F.when(F.col("b") > F.col("a"), F.least(F.floor((F.col("v") - F.col("a")) * F.col("k") / (F.col("b") - F.col("a"))), F.col("k") - 1)).otherwise(0)
    g = x.groupBy(at.cast("int").alias("bin"), "a", "b", "k").agg(F.count("*").alias("n"))
    return g.select("bin", rounded(F.col("a") + (F.col("bin") + 0.5) * (F.col("b") - F.col("a")) / F.col("k")).alias("midpoint"), "n")


def bars(df: DataFrame, x: str, y: str | None = None) -> DataFrame:
    """Mean of y for each x, or counts."""
    g = df.where(F.col(x).isNotNull()).groupBy(F.col(x).alias("x"))
    return g.agg((rounded(F.avg(y)) if y else F.count("*")).alias("y"))


def shares(df: DataFrame, x: str, y: str | None = None) -> DataFrame:
    """Sum of y for each x, or counts."""
    g = df.where(F.col(x).isNotNull()).groupBy(F.col(x).alias("x"))
    return g.agg((rounded(F.sum(y), 2) if y else F.count("*")).alias("y"))


def line(df: DataFrame, x: str, y: str | None = None, unit: str = "day") -> DataFrame:
    """Mean of y, or counts, for each time unit."""
    g = df.where(F.col(x).isNotNull()).groupBy(F.date_trunc(unit, F.col(x)).alias("x"))
    return g.agg((F.round(exact_mean(finite(F.col(f"`{y}`").cast("double"))), 4).cast("double") if y else F.count("*")).alias("y"))


def scatter(df: DataFrame, x: str, y: str, points: int | None = None) -> DataFrame:
    """All points with both values, or about ``points`` of them chosen by hash: a bound on what is drawn."""
    out = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).alias("x"), F.col(y).alias("y"))
    return out if points is None else out.orderBy(F.xxhash64("x", "y")).limit(points)


def top_domains(df: DataFrame, by: str, url: str) -> DataFrame:
    """The most frequent domain of each group."""
    n = df.where(F.col(by).isNotNull()).select(F.col(by).alias("x"), url_domain(F.col(url)).alias("domain")).where("domain <> ''").groupBy("x", "domain").agg(F.count("*").alias("n"))
    w = Window.partitionBy("x").orderBy(F.desc("n"), "domain")
    return n.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def domains(df: DataFrame, url: str) -> DataFrame:
    return df.select(url_domain(F.col(url)).alias("domain")).where("domain <> ''").groupBy("domain").agg(F.count("*").alias("n"))


def box_order(df: DataFrame, by: str, value: str, limit: int = 100) -> DataFrame:
    """Groups by median descending, then name."""
    g = df.where(F.col(by).isNotNull()).groupBy(F.col(by).alias("group")).agg(rounded(F.percentile(value, F.lit(0.5))).alias("median"))
    return g.orderBy(F.desc_nulls_last("median"), "group").limit(limit)
