"""Univariate summaries and grouped aggregates, each from one fused aggregation where it can be."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumen.functions.columns import entropy_of, finite, iso_weekday, kurtosis_adjusted, parse_datetime, rounded, skew_adjusted, span_days, word_count
from lumen.operators.quantiles import distinct_counts, numbers, quantile_row, quantiles
from lumen.operators.select import by_type

PERCENTILES = [0.05, 0.25, 0.5, 0.75, 0.95]


def exact_mean(c: Column) -> Column:
    """The mean from an exact decimal sum, so that it does not depend on the order of rows; of values too large for it, the plain mean."""
    return F.coalesce(F.round(F.avg(c.cast("decimal(38,12)")), 9).cast("decimal(38,9)"), F.avg(c).cast("decimal(38,9)"))


def numeric_measures(name: str) -> dict[str, Column]:
    """The numeric summary of a column as aggregate expressions, without quantiles and distinct counts; NaN counts as missing."""
    c = finite(F.col(f"`{name}`").cast("double"))
    n, mean, std = F.count(c), F.avg(c), F.stddev_samp(c)
    return {
        "rows": F.count("*"), "count": n, "nulls": F.count("*") - n, "null_pct": rounded(F.when(F.count("*") > 0, 100.0 * (F.count("*") - n) / F.count("*"))),
        "zeros": F.count_if(c == 0), "negatives": F.count_if(c < 0), "sum": rounded(F.sum(c), 2), "mean": F.coalesce(F.round(exact_mean(c), 6).cast("double"), rounded(mean)),
        "min": rounded(F.min(c)), "max": rounded(F.max(c)), "range": rounded(F.max(c) - F.min(c)), "std": rounded(std), "variance": rounded(F.var_samp(c), 2), "skewness": rounded(skew_adjusted(c), 4),
        "kurtosis": rounded(kurtosis_adjusted(c), 4), "cv": rounded(F.when((n > 1) & (mean != 0), std / F.abs(mean))), "sem": rounded(std / F.sqrt(n)), "constant": (n > 0) & (F.min(c) == F.max(c)),
    }


NUMERIC = ["column", "rows", "count", "nulls", "null_pct", "unique", "zeros", "negatives", "sum", "mean", "median", "min", "max", "range", "q1", "q3", "iqr", "p5", "p95", "std", "variance", "skewness", "kurtosis", "cv", "sem", "constant"]


def numeric_summary(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row a column: all columns' measures in one pass, their quantiles and distinct counts from counts of values."""
    columns = by_type(df)["numeric"] if columns is None else columns
    all_ = [(i, c, k, e) for i, c in enumerate(columns) for k, e in numeric_measures(c).items()]
    one = df.agg(*[e.alias(f"{k}_{i}") for i, _, k, e in all_])
    cells = [F.struct(F.lit(i).alias("i"), F.lit(c).alias("column"), *[F.col(f"{k}_{i}").alias(k) for j, _, k, _ in all_ if j == i]) for i, c in enumerate(columns)]
    rows = one.select(F.explode(F.array(*cells)).alias("x")).select("x.*")
    q, u = quantiles(df, numbers(columns), PERCENTILES).select("i", "q"), distinct_counts(df, numbers(columns))
    both = rows.join(F.broadcast(q), "i", "left").join(F.broadcast(u), "i", "left").withColumn("unique", F.coalesce("unique", F.lit(0)))  # a row a column
    at = dict(zip(("p5", "q1", "median", "q3", "p95"), range(5)))
    return both.withColumns({k: rounded(F.col("q")[i]) for k, i in at.items()} | {"iqr": rounded(F.col("q")[3] - F.col("q")[1])}).select(*NUMERIC)


def top_values(df: DataFrame, column: str, n: int | None = 10, missing: str | None = None) -> DataFrame:
    """The most frequent values with their share of all rows in percent; ties by value. missing: a label under which nulls count."""
    c = F.col(f"`{column}`").cast("string")
    total = df.agg(F.count("*").alias("_total"))
    base = df.select((F.coalesce(c, F.lit(missing)) if missing is not None else c).alias("value")).where(F.col("value").isNotNull())
    out = base.groupBy("value").agg(F.count("*").alias("count")).join(F.broadcast(total))  # one row
    out = out.select("value", "count", rounded(100.0 * F.col("count") / F.col("_total"), 2).alias("percentage")).orderBy(F.desc("count"), "value")
    return out if n is None else out.limit(n)


def categorical_summary(df: DataFrame, column: str, epsilon: float = 0.0) -> DataFrame:
    """One row: count, nulls, unique, the top value and its count, entropy in bits, constant."""
    counts = df.groupBy(F.col(f"`{column}`").alias("value")).agg(F.count("*").alias("n"))
    total = F.sum(F.when(F.col("value").isNotNull(), F.col("n")))
    own = counts.agg(F.coalesce(total, F.lit(0)).alias("t"), F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("nulls"))
    both = counts.where(F.col("value").isNotNull()).join(F.broadcast(own), how="right")  # one row
    s = both.agg(F.max("t").alias("count"), F.max("nulls").alias("nulls"), F.count("value").alias("unique"), F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("top"), F.max("n").alias("top_count"), rounded(entropy_of(F.col("n"), F.col("t"), epsilon), 4).alias("entropy"))
    return s.withColumn("constant", F.col("unique") == 1)


def boolean_summary(df: DataFrame, column: str) -> DataFrame:
    c = F.col(f"`{column}`")
    return df.agg(F.count(c).alias("count"), F.count_if(c.isNull()).alias("nulls"), F.count_if(c).alias("true_count"), F.count_if(~c).alias("false_count"), F.round(F.when(F.count(c) > 0, 100.0 * F.count_if(c) / F.count(c)), 2).alias("true_pct"))


def datetime_summary(df: DataFrame, column: str) -> DataFrame:
    c = F.col(f"`{column}`")
    midnight = F.bool_and(F.date_trunc("day", c) == c)
    return df.agg(F.count(c).alias("count"), F.count_if(c.isNull()).alias("nulls"), F.min(c).alias("first"), F.max(c).alias("last"), span_days(F.min(c), F.max(c)).alias("span_days"), midnight.alias("dates_only"), F.count_distinct(F.to_date(c)).alias("days"))


def month_histogram(df: DataFrame, column: str) -> DataFrame:
    """Rows of each month of the year, and whether it is the peak (ties: the earliest)."""
    n = df.where(F.col(column).isNotNull()).groupBy(F.month(column).alias("month")).agg(F.count("*").alias("count"))
    peak = n.agg(F.min_by("month", F.struct(-F.col("count"), F.col("month"))).alias("_peak"))
    return n.join(F.broadcast(peak)).select("month", "count", (F.col("month") == F.col("_peak")).alias("peak"))  # one row


def text_summary(df: DataFrame, column: str) -> DataFrame:
    c = F.col(f"`{column}`").cast("string")
    n = F.char_length(c)
    return df.agg(F.count(c).alias("count"), F.count_distinct(c).alias("unique"), F.round(F.avg(n), 2).alias("avg_length"), F.min(n).alias("min_length"), F.max(n).alias("max_length"), F.count_if(F.trim(c) == "").alias("blanks"), F.sum(word_count(c)).alias("words"))


def profile_columns(df: DataFrame) -> DataFrame:
    """One row a column: type, nulls, exact distinct values, ratio over non-null rows; values are counted by the text that stands for them, each column's once."""
    one = df.agg(F.count("*").alias("_n"), *[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(df.columns)])
    u = distinct_counts(df, {c: F.hex(F.col(f"`{c}`")) if t == "binary" else F.col(f"`{c}`").cast("string") for c, t in df.dtypes})
    cells = [F.struct(F.lit(i).alias("i"), F.lit(c).alias("column"), F.lit(t).alias("type"), F.col(f"c{i}").alias("count"), (F.col("_n") - F.col(f"c{i}")).alias("nulls")) for i, (c, t) in enumerate(df.dtypes)]
    x = one.select(F.explode(F.array(*cells)).alias("x")).select("x.*").join(F.broadcast(u), "i", "left").withColumn("unique", F.coalesce("unique", F.lit(0)))  # a row a column
    return x.select("column", "type", "count", "nulls", "unique", rounded(F.when(F.col("count") > 0, F.col("unique") / F.col("count"))).alias("unique_ratio"))


def group_statistics(df: DataFrame, by: str, value: str, limit: int | None = 12) -> DataFrame:
    """Mean, median, std and count of value for each non-null group, by mean descending, nulls last, then name."""
    c = finite(F.col(value).cast("double"))
    g = df.where(F.col(by).isNotNull()).groupBy(F.col(by).alias("group")).agg(rounded(F.avg(c)).alias("mean"), rounded(F.percentile(c, F.lit(0.5))).alias("median"), rounded(F.stddev_samp(c)).alias("std"), F.count(c).alias("count"))
    g = g.orderBy(F.desc_nulls_last("mean"), "group")
    return g if limit is None else g.limit(limit)


def top_group_means(df: DataFrame, by: str, value: str, n: int = 5, digits: int = 2) -> DataFrame:
    g = df.where(F.col(by).isNotNull()).groupBy(F.col(by).alias("group")).agg(F.round(F.avg(value), digits).alias("mean"), F.round(F.percentile(value, F.lit(0.5)), digits).alias("median"), F.count(value).alias("count"))
    return g.orderBy(F.desc("mean"), "group").limit(n)


def segments(df: DataFrame, by: str, value: str) -> DataFrame:
    """Each segment against the mean of the segments' means: difference in percent, effect size, and the gap between the extremes (at most 200 %).

    No rows unless there are two segments and each has five rows.
    """
    g = df.where(F.col(by).isNotNull() & F.col(value).isNotNull()).groupBy(F.col(by).alias("segment")).agg(F.avg(value).alias("m"), F.percentile(value, F.lit(0.5)).alias("d"), F.stddev_samp(value).alias("s"), F.count(value).alias("count"))
    base = g.agg(F.avg("m").alias("base"), F.max("m").alias("top"), F.min("m").alias("low"), F.count("*").alias("k"), F.min("count").alias("least"))
    x = g.join(F.broadcast(base)).where("k >= 2 and least >= 5")  # one row
    gap = F.when(F.abs(F.col("low")) > 1e-9, F.least((F.col("top") - F.col("low")) / F.abs("low") * 100, F.lit(200.0))).otherwise(200.0)
    return x.select("segment", rounded(F.col("m")).alias("mean"), rounded(F.col("d")).alias("median"), rounded(F.col("s")).alias("std"), "count", rounded(F.when(F.col("base") != 0, (F.col("m") - F.col("base")) / F.abs("base") * 100), 2).alias("diff_pct"), rounded((F.col("m") - F.col("base")) / F.greatest(F.col("s"), F.lit(0.01)), 4).alias("effect_size"), rounded(gap, 2).alias("gap_pct"))


def missing_by_group(df: DataFrame, by: str, value: str) -> DataFrame:
    g = df.where(F.col(by).isNotNull()).groupBy(F.col(by).alias("group"))
    return g.agg(F.count("*").alias("rows"), F.count_if(F.col(value).isNull()).alias("missing"), F.round(100.0 * F.avg(F.col(value).isNull().cast("int")), 2).alias("missing_pct"))


def class_balance(df: DataFrame, target: str) -> DataFrame:
    """One row: classes, smallest and largest, their ratio, entropy, and whether it is imbalanced (ratio below 0.2)."""
    n = df.where(F.col(target).isNotNull()).groupBy(target).agg(F.count("*").alias("n"))
    t = n.agg(F.sum("n").alias("t"))
    x = n.join(F.broadcast(t))  # one row
    s = x.agg(F.count("*").alias("classes"), F.min("n").alias("smallest"), F.max("n").alias("largest"), rounded(entropy_of(F.col("n"), F.col("t"), 1e-9), 4).alias("entropy"))
    ratio = F.col("smallest") / F.col("largest")
    return s.withColumn("ratio", rounded(ratio)).withColumn("balanced", ratio > 0.5).withColumn("imbalanced", ratio < 0.2)


def lift(df: DataFrame, a: str, b: str) -> DataFrame:
    """Observed over expected share of each pair of values; marginals come from the pair counts."""
    n = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).agg(F.count("*").alias("n"))
    na, nb, t = n.groupBy("a").agg(F.sum("n").alias("na")), n.groupBy("b").agg(F.sum("n").alias("nb")), n.agg(F.sum("n").alias("t"))
    return n.join(na, "a").join(nb, "b").join(F.broadcast(t)).select("a", "b", "n", rounded(F.col("n") * F.col("t") / (F.col("na") * F.col("nb")), 4).alias("lift"))  # t: one row


def over_representation(df: DataFrame, by: str, value: str, quantile: float = 0.9) -> DataFrame:
    """Share of each category among rows at or above the quantile over its share among the rest; ratios above 1.25."""
    cut = quantile_row(df, numbers([value]), [quantile]).select(F.col("q0")[0].alias("_cut"))
    x = df.where(F.col(by).isNotNull() & F.col(value).isNotNull()).join(F.broadcast(cut)).withColumn("_top", F.col(value) >= F.col("_cut"))  # one row
    g = x.groupBy(F.col(by).alias("group")).agg(F.count_if("_top").alias("top"), F.count_if(~F.col("_top")).alias("rest"))
    t = g.agg(F.sum("top").alias("tt"), F.sum("rest").alias("tr"))
    y = g.join(F.broadcast(t)).withColumn("r", (F.col("top") / F.col("tt")) / (F.col("rest") / F.col("tr")))  # one row
    return y.where("r > 1.25").select("group", "top", "rest", rounded(F.col("r"), 4).alias("ratio"))


def text_length_by_class(df: DataFrame, target: str, text: str) -> DataFrame:
    n = F.char_length(text)
    g = df.where(F.col(target).isNotNull()).groupBy(F.col(target).alias("class"))
    return g.agg(F.count(text).alias("count"), F.round(F.avg(n), 2).alias("avg_length"), F.round(F.percentile(n, F.lit(0.5)), 2).alias("median_length"), F.max(n).alias("max_length"), F.round(F.avg(word_count(F.col(text))), 2).alias("avg_words"))


def missing_summary(df: DataFrame) -> DataFrame:
    """One row: cells, missing cells and share, columns with any and with only missing, rows with any."""
    null = [F.col(f"`{c}`").isNull().cast("int") for c in df.columns]
    total = sum(null[1:], null[0])
    n = [F.sum(x) for x in null]
    some = sum([F.when(x > 0, 1).otherwise(0) for x in n[1:]], F.when(n[0] > 0, 1).otherwise(0))
    full = sum([F.when(x == F.count("*"), 1).otherwise(0) for x in n[1:]], F.when(n[0] == F.count("*"), 1).otherwise(0))
    return df.agg((F.count("*") * len(df.columns)).alias("cells"), F.sum(total).alias("missing"), rounded(100.0 * F.sum(total) / (F.count("*") * len(df.columns)), 4).alias("missing_pct"), some.cast("long").alias("columns_with_missing"), full.cast("long").alias("columns_all_missing"), F.count_if(total > 0).alias("rows_with_missing"))


def quality_score(missing_pct: float, duplicate_pct: float, outlier_pct: float) -> dict:
    """Completeness, uniqueness and consistency (floor 0), their mean, and a rating."""
    parts = {"completeness": max(0.0, 100 - 2 * missing_pct), "uniqueness": max(0.0, 100 - 5 * duplicate_pct), "consistency": max(0.0, 100 - 3 * outlier_pct)}
    score = sum(parts.values()) / 3
    return {**parts, "score": round(score, 2), "rating": "excellent" if score >= 90 else "good" if score >= 75 else "fair" if score >= 60 else "poor"}


def target_thresholds(df: DataFrame, target: str) -> DataFrame:
    c = finite(F.col(target).cast("double"))
    one = df.agg(rounded(F.avg(c)).alias("mean"), rounded(F.stddev_samp(c)).alias("std"), rounded(F.min(c)).alias("min"), rounded(F.max(c)).alias("max"), rounded(skew_adjusted(c), 4).alias("skewness"), F.count_if(c == 0).alias("zeros"))
    q = quantile_row(df, numbers([target]), [0.25, 0.5, 0.75, 0.9, 0.95])
    both = one.join(F.broadcast(q))  # one row each
    return both.select("mean", rounded(F.col("q0")[1]).alias("median"), "std", "min", "max", *[rounded(F.col("q0")[i]).alias(k) for i, k in ((0, "q25"), (2, "q75"), (3, "q90"), (4, "q95"))], "skewness", "zeros")


def shape(skew: Column) -> Column:
    return F.when(skew > 1, "right_skewed").when(skew < -1, "left_skewed").otherwise("normal_like")


def top_values_map(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    """One row: the top values as a map from value to count."""
    top = top_values(df, column, n)
    return top.agg(F.map_from_entries(F.collect_list(F.struct("value", "count"))).alias("top"))


def value_classes(df: DataFrame, column: str) -> DataFrame:
    from lumen.functions.columns import classify_scalar

    return df.where(F.col(column).isNotNull()).groupBy(classify_scalar(F.col(column)).alias("class")).agg(F.count("*").alias("n"))


def weekday_histogram(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy(iso_weekday(F.col(column)).alias("weekday")).agg(F.count("*").alias("n"))


def parseable_dates(df: DataFrame, column: str) -> DataFrame:
    c = F.col(column)
    return df.agg(F.count(c).alias("count"), F.count(parse_datetime(c)).alias("dates"), F.min(parse_datetime(c)).alias("first"), F.max(parse_datetime(c)).alias("last"))


def ranked(df: DataFrame, by: str, score: str, name: str = "rank") -> DataFrame:
    """Few rows (a row a column or feature) numbered by score descending, then name."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(F.desc_nulls_last(score), by)))


def class_distribution(df: DataFrame, target: str, n: int = 10) -> DataFrame:
    """The n most frequent classes of a categorical target with their shares of its values in percent."""
    return top_values(df.where(F.col(f"`{target}`").isNotNull()), target, n)


def categorical_target(df: DataFrame, target: str, columns: list[str], least: int = 20) -> DataFrame:
    """feature, method, score, n: how much each feature of at most 20 values, or each number, differs between the target's classes."""
    from lumen.operators import pairs

    kinds, out = by_type(df), []
    for c in columns:
        if c in kinds["numeric"]:
            x = pairs.kruskal(df, target, c).select(F.lit("kruskal").alias("method"), "score", "n")
        else:
            x = pairs.chi_square(df, target, c).select(F.lit("cramers_v").alias("method"), F.col("cramers_v").alias("score"), "n")
        out.append(x.where(F.col("n") >= least).select(F.lit(c).alias("feature"), "method", "score", "n"))
    return reduce(DataFrame.unionByName, out)


def target_evidence(df: DataFrame, target: str, by: str) -> DataFrame:
    """One row for each category over-represented at the target's top tenth, beside the target's thresholds."""
    return over_representation(df, by, target).join(F.broadcast(target_thresholds(df, target).select("mean", "median", "q90", "q95")))  # one row
