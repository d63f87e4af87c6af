"""Outlier evidence, flags and box statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumen import vocab
from lumen.functions.columns import finite, rounded
from lumen.operators.quantiles import numbers, quantile_row


def fences(df: DataFrame, columns: list[str], method: str = "iqr", k: float = 1.5) -> DataFrame:
    """One row: ``_rows``, and of the i-th column ``_n<i>``, the least and greatest value ``_l<i>`` and ``_h<i>``, ``_s<i>`` the spread, ``_m<i>`` the median, and the fences ``_a<i>`` and ``_b<i>`` beyond which values are outliers."""
    if method not in ("iqr", "zscore"):
        raise ValueError("method is iqr or zscore")
    values = numbers(columns)
    q = quantile_row(df, values, [0.25, 0.5, 0.75])
    means = [e for i, v in enumerate(values.values()) for e in (F.avg(v).alias(f"mean{i}"), F.stddev_samp(v).alias(f"sd{i}"))] if method == "zscore" else []
    ends = [e for i, v in enumerate(values.values()) for e in (F.min(v).alias(f"_l{i}"), F.max(v).alias(f"_h{i}"))]
    one = df.agg(F.count("*").alias("_rows"), *ends, *means).join(F.broadcast(q))  # one row each
    out = [F.col("_rows")]
    for i in range(len(columns)):
        x = F.col(f"q{i}")
        spread, low, high = (x[2] - x[0], x[0], x[2]) if method == "iqr" else (F.col(f"sd{i}"), F.col(f"mean{i}"), F.col(f"mean{i}"))
        out += [F.col(f"count{i}").alias(f"_n{i}"), F.col(f"_l{i}"), F.col(f"_h{i}"), spread.alias(f"_s{i}"), x[1].alias(f"_m{i}"), (low - k * spread).alias(f"_a{i}"), (high + k * spread).alias(f"_b{i}")]
    return one.select(*out)


def severity(pct: Column) -> Column:
    return F.when(pct >= vocab.OUTLIER_HIGH, "high").when(pct >= vocab.OUTLIER_MEDIUM, "medium").otherwise("low")


def outliers(df: DataFrame, columns: list[str], method: str = "iqr", k: float = 1.5) -> DataFrame:
    """A row a column: fences, outliers, share of all rows in percent, severity, extremes, and the share of them that also lie beyond 3.5 scaled median deviations.

    Columns of fewer than 8 values, of at most two distinct values or without
    spread give no row.  Three passes for all columns together: fences, median
    deviations, counts.
    """
    if not columns:
        return df.sparkSession.createDataFrame([], "column string")
    values = list(numbers(columns).values())
    x = df.join(F.broadcast(fences(df, columns, method, k)))  # one row
    mad = quantile_row(x, {c: F.abs(v - F.col(f"_m{i}")) for i, (c, v) in enumerate(zip(columns, values))}, [0.5])
    x = x.join(F.broadcast(mad.select(*[F.col(f"q{i}")[0].alias(f"_d{i}") for i in range(len(columns))])))  # one row
    counts = []
    for i, v in enumerate(values):
        hit = (v < F.col(f"_a{i}")) | (v > F.col(f"_b{i}"))
        far = (F.col(f"_d{i}") > 0) & (F.abs(v - F.col(f"_m{i}")) > 3.5 * 1.4826 * F.col(f"_d{i}"))
        counts += [F.count_if(hit).alias(f"o{i}"), F.min(F.when(hit, v)).alias(f"l{i}"), F.max(F.when(hit, v)).alias(f"h{i}"), F.count_if(hit & far).alias(f"f{i}")]
        counts.append(F.count_if((v > F.col(f"_l{i}")) & (v < F.col(f"_h{i}"))).alias(f"m{i}"))  # some if there are more than two values
        counts += [F.first(f"_{c}{i}").alias(f"_{c}{i}") for c in "nsab"]
    one = x.agg(F.first("_rows").alias("rows"), *counts)
    kinds = {"n": "_n", "inner": "m", "spread": "_s", "lower": "_a", "upper": "_b", "outliers": "o", "least": "l", "most": "h", "both": "f"}
    cells = F.array(*[F.struct(F.lit(c).alias("column"), *[F.col(f"{p}{i}").alias(n) for n, p in kinds.items()]) for i, c in enumerate(columns)])
    g = one.select("rows", F.explode(cells).alias("x")).select("rows", "x.*").where((F.col("n") >= vocab.OUTLIER_LEAST) & (F.col("inner") > 0) & (F.col("spread") > 0))
    pct = 100.0 * F.col("outliers") / F.col("rows")
    return g.select("column", rounded(F.col("lower")).alias("lower"), rounded(F.col("upper")).alias("upper"), "outliers", rounded(pct, 4).alias("percentage"), severity(pct).alias("severity"), rounded(F.col("least")).alias("min_outlier"), rounded(F.col("most")).alias("max_outlier"), rounded(F.when(F.col("outliers") > 0, F.col("both") / F.col("outliers"))).alias("mad_share"))


def with_flags(df: DataFrame, columns: list[str], method: str = "iqr", k: float = 1.5) -> DataFrame:
    """df with a 0/1 column ``<c>_OutlierFlag`` for each column, from the fences of all."""
    if not columns:
        return df
    both = df.join(F.broadcast(fences(df, columns, method, k)))  # one row
    hits = {f"{c}_OutlierFlag": F.coalesce((v < F.col(f"_a{i}")) | (v > F.col(f"_b{i}")), F.lit(False)).cast("tinyint") for i, (c, v) in enumerate(numbers(columns).items())}
    return both.withColumns(hits).select(*[F.col(f"`{c}`") for c in df.columns if c not in hits], *hits)


def target_severity(df: DataFrame, target: str, k: float = 1.5) -> DataFrame:
    """One row: the target's outliers, their share of rows in percent, and how grave that is: above 15 high, above 5 moderate, else low."""
    x = df.join(F.broadcast(fences(df, [target], "iqr", k)))  # one row
    v = numbers([target])[target]
    n = F.count_if((v < F.col("_a0")) | (v > F.col("_b0")))
    pct = F.when(F.count("*") > 0, 100.0 * n / F.count("*"))
    return x.agg(n.alias("outliers"), rounded(pct, 4).alias("percentage"), F.when(pct > 15, "high").when(pct > 5, "moderate").otherwise("low").alias("severity"))


def box_statistics(df: DataFrame, by: str, value: str, k: float = 1.5) -> DataFrame:
    """For each group: quartiles, whiskers (the extreme values within the fences) and the number of outliers."""
    v = finite(F.col(value).cast("double"))
    base = df.where(F.col(by).isNotNull()).select(F.col(by).alias("group"), v.alias("v")).where("v is not null")
    q = base.groupBy("group").agg(F.percentile("v", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    q = q.select("group", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
    x = base.join(q, "group")
    iqr = F.col("q3") - F.col("q1")
    ok = (F.col("v") >= F.col("q1") - k * iqr) & (F.col("v") <= F.col("q3") + k * iqr)
    g = x.groupBy("group", "q1", "median", "q3").agg(F.min(F.when(ok, F.col("v"))).alias("low"), F.max(F.when(ok, F.col("v"))).alias("high"), F.count_if(~ok).alias("outliers"), F.count("*").alias("n"))
    return g.select("group", rounded(F.col("q1")).alias("q1"), rounded(F.col("median")).alias("median"), rounded(F.col("q3")).alias("q3"), rounded(F.col("low")).alias("whisker_low"), rounded(F.col("high")).alias("whisker_high"), "outliers", "n")
