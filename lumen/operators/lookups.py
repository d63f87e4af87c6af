"""Answers about one column or a few rows: kind-specific statistics, samples, records, sizes and an overview."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumen.functions.columns import finite, rounded
from lumen.operators.quantiles import numbers, quantile_row
from lumen.operators.select import by_type, column
from lumen.operators.summaries import top_values

#: Fixed value: the share of values that make a column one of addresses.
URL_SHARE = 0.50
#: Tokens of a description's frame, of a column, of a numeric column's statistics and of a category; categories that count, and characters of data that make one token.
BASE, COLUMN, NUMBER, VALUE, MOST_VALUES, SAMPLE = 500, 50, 100, 10, 20, 40


def column_stats(df: DataFrame, name: str) -> DataFrame:
    """measure, value: what is known of a column by its type. Counts for all; moments and quantiles of numbers, days of dates, lengths of text."""
    c = column(df, name)
    t = df.schema[name].dataType
    n = {"rows": F.count("*"), "count": F.count(c), "nulls": F.count_if(c.isNull()), "null_pct": F.when(F.count("*") > 0, 100.0 * F.count_if(c.isNull()) / F.count("*")), "unique": F.count_distinct(c)}
    if isinstance(t, T.NumericType):
        v = finite(c.cast("double"))
        n |= {"min": F.min(v), "max": F.max(v), "mean": F.avg(v), "std": F.stddev_samp(v), "zeros": F.count_if(v == 0)}
        one = df.agg(*[e.cast("double").alias(k) for k, e in n.items()]).join(F.broadcast(quantile_row(df, numbers([name]), [0.25, 0.5, 0.75])))  # one row each
        one = one.select(*n, *[F.col("q0")[i].alias(k) for i, k in enumerate(("q1", "median", "q3"))])
    elif isinstance(t, T.BooleanType):
        one = df.agg(*[e.cast("double").alias(k) for k, e in n.items()], F.count_if(c).cast("double").alias("true_count"))
    elif isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        one = df.agg(*[e.cast("double").alias(k) for k, e in n.items()], F.date_diff(F.max(c), F.min(c)).cast("double").alias("span_days"))
    else:
        size = F.char_length(c.cast("string"))
        one = df.agg(*[e.cast("double").alias(k) for k, e in n.items()], F.min(size).cast("double").alias("min_length"), F.max(size).cast("double").alias("max_length"), F.avg(size).alias("mean_length"))
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), rounded(F.col(k), 4).alias("value")) for k in one.columns])).alias("x")).select("x.*")


def top_coverage(df: DataFrame, name: str, top: int = 10) -> DataFrame:
    """The most frequent values with their share, and the share that these and those before them cover together."""
    x = top_values(df, name, top)
    w = Window.orderBy(F.desc("count"), "value").rowsBetween(Window.unboundedPreceding, 0)  # ``top`` rows
    return x.withColumn("coverage", F.round(F.sum("percentage").over(w), 2))


def row_sample(df: DataFrame, order: str, n: int = 100) -> DataFrame:
    """The first n row labels, by order: what a finding shows of the rows that it is about."""
    return df.select(F.col(order)).orderBy(order).limit(n)


def samples_by(df: DataFrame, by: str, order: str, n: int = 100) -> DataFrame:
    """For each group the first n row labels and the number of its rows; a group's rows are cut in the map tasks already."""
    w = Window.partitionBy(by).orderBy(order)
    first = df.select(by, order).withColumn("_nth", F.row_number().over(w)).where(F.col("_nth") <= n).groupBy(by).agg(F.array_sort(F.collect_list(order)).alias("rows"))
    return df.groupBy(by).agg(F.count("*").alias("count")).join(first, by)


def records(df: DataFrame, order: str | None = None, n: int = 20) -> DataFrame:
    """Rows as JSON texts without NaN, at most n of them."""
    plain = [finite(F.col(f"`{c}`")).alias(c) if t in ("double", "float") else F.col(f"`{c}`") for c, t in df.dtypes]
    return (df.orderBy(order) if order else df).limit(n).select(F.to_json(F.struct(*plain), {"ignoreNullFields": "false"}).alias("record"))


def size_estimate(df: DataFrame) -> DataFrame:
    """One row: rows, and bytes of the values: fixed widths, and lengths of text."""
    width = {"byte": 1, "tinyint": 1, "smallint": 2, "int": 4, "bigint": 8, "float": 4, "double": 8, "boolean": 1, "date": 4}
    fixed = sum(width.get(t, 8) for _, t in df.dtypes if t != "string")
    text = [F.coalesce(F.sum(F.octet_length(f"`{c}`")), F.lit(0)) for c, t in df.dtypes if t == "string"]
    return df.agg(F.count("*").alias("rows"), (F.count("*") * fixed + sum(text, F.lit(0))).cast("long").alias("bytes"))


def is_url_column(df: DataFrame, name: str) -> DataFrame:
    """One row: values, those that begin as a web address, and whether they are more than half."""
    c = column(df, name).cast("string")
    n = F.count_if(c.rlike("^https?://"))
    return df.agg(F.count(c).alias("count"), n.alias("urls"), F.coalesce(n > URL_SHARE * F.count(c), F.lit(False)).alias("is_url"))


def is_boolean_like(df: DataFrame, name: str) -> DataFrame:
    """One row: whether a column's values are all yes-or-no words, if it has any."""
    c = F.lower(F.trim(column(df, name).cast("string")))
    words = F.count_if(c.isin("true", "false"))
    return df.agg(F.count(c).alias("count"), words.alias("booleans"), ((F.count(c) > 0) & (words == F.count(c))).alias("is_boolean"))


def token_budget(df: DataFrame, most: int = 4000) -> DataFrame:
    """One row: the tokens that a description of the table would take, whether ``most`` are enough, and by how much in percent they are not."""
    kinds = by_type(df)
    chars = sum((F.coalesce(F.char_length(F.col(f"`{c}`").cast("string")), F.lit(0)) for c in df.columns), F.lit(0))
    values = sum((F.least(F.count_distinct(f"`{c}`"), F.lit(MOST_VALUES)) * VALUE for c in kinds["categorical"]), F.lit(0))
    need = (BASE + COLUMN * len(df.columns) + NUMBER * len(kinds["numeric"]) + F.coalesce(F.sum(chars), F.lit(0)) / SAMPLE + values).cast("long")
    one = df.agg(need.alias("estimated"))
    return one.select("estimated", (F.col("estimated") <= most).alias("within"), F.round(F.greatest(F.lit(0), F.col("estimated") - most) * 100.0 / most, 2).alias("overflow_pct"))


def overview(df: DataFrame) -> DataFrame:
    """One row: the table as a short text of rows, columns and what is missing, for questions that nothing else answers."""
    n = F.count("*")
    gaps = [F.when(F.count_if(F.col(f"`{c}`").isNull()) > 0, F.concat(F.lit(f"{c}: "), F.count_if(F.col(f"`{c}`").isNull()).cast("string"))) for c in df.columns]
    missing = F.concat_ws(", ", *gaps)
    return df.agg(F.concat(n.cast("string"), F.lit(f" rows, {len(df.columns)} columns ({', '.join(df.columns)}); missing: "), F.when(missing == "", "nothing").otherwise(missing)).alias("answer"))
