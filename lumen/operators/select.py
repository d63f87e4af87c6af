"""Ad-hoc row queries: filters, shares, distinct values, row lookups, metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumen.functions.columns import rounded

RID = "_rid"
NUMERIC = (T.NumericType,)
OPERATORS = ["==", "!=", ">", "<", ">=", "<=", "contains", "startswith", "endswith"]


def column(df: DataFrame, name: str) -> Column:
    """The column, or ValueError with the names that exist."""
    if name not in df.columns:
        raise ValueError(f"no column {name!r}; columns are {', '.join(df.columns)}")
    return F.col(f"`{name}`")


def by_type(df: DataFrame) -> dict[str, list[str]]:
    """Column names by kind of type."""
    out: dict[str, list[str]] = {"numeric": [], "categorical": [], "datetime": [], "boolean": []}
    for f in df.schema:
        t = f.dataType
        kind = "numeric" if isinstance(t, T.NumericType) else "boolean" if isinstance(t, T.BooleanType) else "datetime" if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)) else "categorical" if isinstance(t, T.StringType) else ""
        if kind:
            out[kind].append(f.name)
    return out


def coerce(df: DataFrame, name: str, value: object) -> Column:
    """value as a literal of the column's type; ValueError if it is not one."""
    column(df, name)
    t = df.schema[name].dataType
    if isinstance(t, T.BooleanType):
        return F.lit(str(value).strip().lower() in ("true", "1", "yes", "on"))
    try:
        if isinstance(t, T.IntegralType):
            return F.lit(int(float(value))) if float(value) == int(float(value)) else F.lit(float(value))
        if isinstance(t, T.NumericType):
            return F.lit(float(value))
    except (TypeError, ValueError) as e:
        raise ValueError(f"{value!r} is no value of the numeric column {name}") from e
    return F.lit(str(value)).cast(t)


def predicate(df: DataFrame, name: str, op: str, value: object, case_sensitive: bool = False) -> Column:
    """The condition of a filter.

    ``!=`` holds for nulls; the other operators do not.  ``contains`` is a
    regular expression; ``startswith`` and ``endswith`` are literal.
    """
    c = column(df, name)
    if op not in OPERATORS:
        raise ValueError(f"no operator {op!r}; operators are {', '.join(OPERATORS)}")
    if op in (">", "<", ">=", "<="):
        if not isinstance(df.schema[name].dataType, T.NumericType):
            raise ValueError(f"{op} needs a numeric column; {name} is {df.schema[name].dataType.simpleString()}")
        v = coerce(df, name, value)
        return {">": c > v, "<": c < v, ">=": c >= v, "<=": c <= v}[op]
    if op == "==":
        return c == coerce(df, name, value)
    if op == "!=":
        return ~c.eqNullSafe(coerce(df, name, value))
    s, v = c.cast("string"), str(value)
    if op == "contains":
        return s.rlike(v if case_sensitive else f"(?i){v}")
    if not case_sensitive:
        s, v = F.lower(s), v.lower()
    return s.startswith(v) if op == "startswith" else s.endswith(v)


def filter_rows(df: DataFrame, name: str, op: str, value: object, case_sensitive: bool = False, order: str | None = RID, limit: int | None = 20) -> DataFrame:
    """Matching rows; the first ``limit`` (1 to 100) by ``order``, or all of them if limit is None."""
    out = df.where(predicate(df, name, op, value, case_sensitive))
    if limit is None:
        return out
    return (out.orderBy(order) if order in df.columns else out).limit(max(1, min(100, limit)))


def percentage(df: DataFrame, name: str, op: str, value: object, case_sensitive: bool = False) -> DataFrame:
    """One row: matching and total rows, their share in percent and its complement."""
    if op not in ("==", "!=", "contains", "startswith", "endswith"):
        raise ValueError(f"no percentage for {op!r}")
    hit = F.count_if(predicate(df, name, op, value, case_sensitive))
    share = F.when(F.count("*") > 0, 100.0 * hit / F.count("*"))
    return df.agg(hit.alias("matching"), F.count("*").alias("total"), F.round(share, 2).alias("percentage"), F.round(100 - share, 2).alias("inverse"))


def with_rid(df: DataFrame, *order: str | Column) -> DataFrame:
    """df with a contiguous row number from 0 in the given order.

    Numbers within range partitions are shifted by the sizes of those before, so
    that no task sees more than its own rows.
    """
    if not order:
        raise ValueError("a row number needs an order")
    cols = [F.col(o) if isinstance(o, str) else o for o in order]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number of its own keeps the ranges as they are
    ranged = df.repartitionByRange(parts, *cols).withColumn("_part", F.spark_partition_id())
    ranged = ranged.withColumn("_nth", F.row_number().over(Window.partitionBy("_part").orderBy(*cols)).cast("long"))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("n"))
    before = sizes.select("_part", F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row a partition
    return ranged.join(F.broadcast(before), "_part").withColumn(RID, F.col("_before") + F.col("_nth") - 1).drop("_part", "_nth", "_before")


def row(df: DataFrame, number: int, columns: list[str] | None = None) -> DataFrame:
    """Row ``number`` (from 1) by the row number column."""
    if number < 1:
        raise ValueError("rows are numbered from 1")
    out = df.where(F.col(RID) == number - 1)
    return out.select(*[column(df, c) for c in columns]) if columns else out


def rows(df: DataFrame, start: int, end: int, columns: list[str] | None = None) -> DataFrame:
    """Rows start (from 1, included) to end (excluded), in order."""
    if start < 1 or end <= start:
        raise ValueError("need 1 <= start < end")
    out = df.where(F.col(RID).between(start - 1, end - 2)).orderBy(RID)
    return out.select(*[column(df, c) for c in columns]) if columns else out


def unique_values(df: DataFrame, name: str, limit: int | None = 50, sort: str = "frequency", search: str | None = None, counts: bool = True) -> DataFrame:
    """Distinct non-null values with counts and shares of non-null rows; ties by value."""
    c = column(df, name)
    base = df.where(c.isNotNull()).select(c.alias("value"))
    if not counts:
        out = base.distinct()
    else:
        total = base.agg(F.count("*").alias("_total"))
        out = base.groupBy("value").agg(F.count("*").alias("count")).join(F.broadcast(total)).withColumn("percentage", F.round(100.0 * F.col("count") / F.col("_total"), 2)).drop("_total")  # one row
    if search is not None:
        out = out.where(F.lower(F.col("value").cast("string")).contains(search.lower()))
    if sort == "frequency" and counts:
        out = out.orderBy(F.desc("count"), "value")
    elif sort in ("value", "frequency"):
        out = out.orderBy("value")
    return out if limit is None else out.limit(max(1, min(100, limit)))


def missing_by_column(df: DataFrame) -> DataFrame:
    """column, missing, percentage for every column, from one pass."""
    n = F.count("*")
    one = df.agg(n.alias("_n"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"m{i}") for i, c in enumerate(df.columns)])
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("missing")) for i, c in enumerate(df.columns)])
    x = one.select("_n", F.explode(cells).alias("x"))
    return x.select("x.column", "x.missing", rounded(F.when(F.col("_n") > 0, 100.0 * F.col("x.missing") / F.col("_n")).otherwise(0.0), 2).alias("percentage"))


def dataset_info(df: DataFrame) -> DataFrame:
    """One row a numeric column: count, min, max, mean, std."""
    out = None
    kinds = by_type(df)["numeric"]
    one = df.agg(*[f(F.col(f"`{c}`").cast("double")).alias(f"{k}{i}") for i, c in enumerate(kinds) for k, f in (("n", F.count), ("a", F.min), ("b", F.max), ("m", F.avg), ("s", F.stddev_samp))])
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("count"), rounded(F.col(f"a{i}")).alias("min"), rounded(F.col(f"b{i}")).alias("max"), rounded(F.col(f"m{i}")).alias("mean"), rounded(F.col(f"s{i}")).alias("std")) for i, c in enumerate(kinds)])
    out = one.select(F.explode(cells).alias("x")).select("x.*")
    return out


def duplicate_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row: rows, rows beyond the first of each group equal on columns, and the largest group."""
    cols = [F.col(f"`{c}`") for c in columns or df.columns]
    g = df.groupBy(*cols).agg(F.count("*").alias("_n"))
    return g.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicates"), F.coalesce(F.max("_n"), F.lit(0)).alias("largest_group"))


#: Words that hint at a tool, in order; the first that a question holds wins.
ROUTES = [("percentage", ["percent", "%", "proportion", "share of"]), ("unique_values", ["unique", "distinct", "categories", "values of"]), ("rows", ["rows from", "row range", "rows between"]), ("row", ["row number", "row "]), ("filter_rows", ["filter", "where", "rows with", "find", "show me"]), ("column_stats", ["average", "mean", "median", "statistic", "std", "max", "min"]), ("dataset_info", ["columns", "dataset", "overview", "shape", "missing"])]


def route(question: str) -> str | None:
    """The tool that a question asks for."""
    q = question.lower()
    return next((tool for tool, words in ROUTES if any(w in q for w in words)), None)
