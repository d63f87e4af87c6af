"""Exact quantiles of many columns together, without shuffling the table.

One pass of mergeable sketches gives two values for each wanted rank between
which it must lie.  A second pass counts what is below them, a third groups only
the few values between, in which the rank is then found exactly.  A rank that
should lie outside, against the sketches' promise, is an error, not a wrong
number.  Distinct values are counted apart, where they are asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumen.functions.columns import finite

#: Accuracy of the sketches: ranks are off by a share of 1 / ACCURACY at most.
ACCURACY = 1000


def numbers(columns: list[str]) -> dict[str, Column]:
    """Columns as finite doubles, by name."""
    return {c: finite(F.col(f"`{c}`").cast("double")) for c in columns}


def value_counts(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """``i, v, n``: how often the i-th of values is v; nulls are left out."""
    cells = F.array(*[F.struct(F.lit(i).alias("i"), e.alias("v")) for i, e in enumerate(values.values())])
    return df.select(F.explode(cells).alias("x")).where("x.v is not null").groupBy(F.col("x.i").alias("i"), F.col("x.v").alias("v")).agg(F.count("*").alias("n"))


def distinct_counts(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """``i, unique``: exact numbers of distinct values, of all columns in one shuffle."""
    return value_counts(df, values).groupBy("i").agg(F.count("*").alias("unique"))


def quantiles(df: DataFrame, values: dict[str, Column], probabilities: list[float], accuracy: int = ACCURACY) -> DataFrame:
    """One row for each of values that has any: ``i, count, q``; q are the quantiles by linear interpolation."""
    n, slack = len(probabilities), 2.0 / accuracy
    x = df.select(*[e.alias(f"v{i}") for i, e in enumerate(values.values())])
    edges = F.array(*[F.lit(max(p - slack, 0.0)) for p in probabilities], *[F.lit(min(p + slack, 1.0)) for p in probabilities])
    sketch = x.agg(*[e for i in range(len(values)) for e in (F.percentile_approx(f"v{i}", edges, F.lit(accuracy)).alias(f"s{i}"), F.count(f"v{i}").alias(f"c{i}"))]).first()  # two numbers a quantile
    # Below a and above b no wanted rank lies; at the ends of the scale there is no such value, and few values are all looked at, as a rank is too large a share of them.
    cut = {}
    for i in range(len(values)):
        for k, p in enumerate(probabilities if sketch[f"s{i}"] else []):
            many = sketch[f"c{i}"] >= 4 * accuracy
            cut[i, k] = (sketch[f"s{i}"][k] if many and p - slack > 0 else None, sketch[f"s{i}"][n + k] if many and p + slack < 1 else None)
    if not cut:
        return df.sparkSession.createDataFrame([], "i int, count long, q array<double>")

    def between(i: int, k: int) -> Column:
        (a, b), v = cut[i, k], F.col(f"v{i}")
        own = v >= a if a is not None else v.isNotNull()
        return own & (v <= b) if b is not None else own

    below = [F.count_if(F.col(f"v{i}") < a).alias(f"n{i}_{k}") for (i, k), (a, _) in cut.items() if a is not None]
    counts = x.agg(*[F.count(f"v{i}").alias(f"c{i}") for i in range(len(values))], *below)
    wanted = [
        F.struct(
            F.lit(i).alias("i"), F.lit(k).alias("k"), F.col(f"c{i}").alias("count"), (F.col(f"n{i}_{k}") if a is not None else F.lit(0).cast("long")).alias("below"),
            F.lit(a).cast("double").alias("lo"), F.lit(b).cast("double").alias("hi"), (F.lit(float(probabilities[k])) * (F.col(f"c{i}") - 1)).alias("exact"),
        )
        for (i, k), (a, b) in cut.items()
    ]
    ranks = counts.select(F.explode(F.array(*wanted)).alias("w")).select("w.*").where("count > 0").withColumns({"low": F.floor("exact"), "high": F.ceil("exact")})

    def any_of(i: int) -> Column:
        out = between(i, 0)
        for k in range(1, n):
            out = out | between(i, k)
        return out

    near = F.array(*[F.struct(F.lit(i).alias("i"), F.when(any_of(i), F.col(f"v{i}")).alias("v")) for i in sorted({i for i, _ in cut})])
    grouped = x.select(F.explode(near).alias("x")).where("x.v is not null").groupBy(F.col("x.i").alias("_i"), F.col("x.v").alias("v")).agg(F.count("*").alias("n"))
    inside = (F.col("_i") == F.col("i")) & (F.col("lo").isNull() | (F.col("v") >= F.col("lo"))) & (F.col("hi").isNull() | (F.col("v") <= F.col("hi")))
    found = grouped.join(F.broadcast(ranks), inside)  # a row a quantile
    run = F.sum("n").over(Window.partitionBy("i", "k").orderBy("v"))
    placed = found.withColumn("end", F.col("below") + run)
    has = lambda rank: F.max(F.when((F.col(rank) >= F.col("end") - F.col("n")) & (F.col(rank) < F.col("end")), F.col("v")))
    one = placed.groupBy("i", "k").agg(F.max("count").alias("count"), has("low").alias("a"), has("high").alias("b"), F.max(F.col("exact") - F.col("low")).alias("part"))
    value = F.when(F.col("a").isNull() | F.col("b").isNull(), F.raise_error(F.lit("a rank lies outside its bracket")).cast("double")).otherwise(F.col("a") + (F.col("b") - F.col("a")) * F.col("part"))
    out = one.groupBy("i").agg(F.max("count").alias("count"), F.array_sort(F.collect_list(F.struct("k", value.alias("v")))).alias("all"))
    whole = F.when(F.size("all") < n, F.raise_error(F.lit("a rank lies outside its bracket")).cast("array<double>")).otherwise(F.transform("all", lambda e: e["v"]))
    return out.select("i", "count", whole.alias("q"))


def quantile_row(df: DataFrame, values: dict[str, Column], probabilities: list[float], accuracy: int = ACCURACY) -> DataFrame:
    """The same as one row: ``q<i>`` and ``count<i>`` for each of values; null and zero where there are none."""
    q = quantiles(df, values, probabilities, accuracy)
    pick = lambda c, i: F.max(F.when(F.col("i") == i, F.col(c)))
    return q.agg(*[e for i in range(len(values)) for e in (pick("q", i).alias(f"q{i}"), F.coalesce(pick("count", i), F.lit(0)).alias(f"count{i}"))])


def position(column: Column, kind: str) -> Column:
    """A double that rises with the column's order, for cutting it into ranges; unequal values may share one."""
    if kind == "string":
        return F.conv(F.rpad(F.hex(F.substring(column.cast("binary"), 1, 6)), 12, "0"), 16, 10).cast("double")
    if kind.startswith("timestamp") or kind == "date":
        return F.unix_micros(column.cast("timestamp")).cast("double")
    return column.cast("int").cast("double") if kind == "boolean" else column.cast("double")


def ranged(df: DataFrame, column: str, parts: int, name: str) -> DataFrame:
    """df with the number of the range that column is in, by cut points that one sketch gives; an expression of the value, so it is the same wherever it is computed."""
    at = position(F.col(f"`{column}`"), dict(df.dtypes)[column])
    if parts < 2:
        return df.withColumn(name, F.lit(0))
    cuts = df.agg(F.percentile_approx(at, F.array(*[F.lit(i / parts) for i in range(1, parts)]), F.lit(1000)).alias(f"{name}_cuts"))
    both = df.join(F.broadcast(cuts))  # one row
    return both.withColumn(name, F.coalesce(F.size(F.filter(f"{name}_cuts", lambda e: e < at)), F.lit(0))).drop(f"{name}_cuts")
