"""Operators over rows: duplicates, ranks, bins, joins that check rows, set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumen.functions.columns import collapse, fold_case, missing_like, rounded
from lumen.operators.quantiles import numbers, quantile_row, ranged


#: A value with more than one in so many of the rows is frequent, and the rows of a partition that meet the ranks of the others.
FREQUENT, JOINED = 10_000, 500_000


def _cols(columns: list[str]) -> list[Column]:
    return [F.col(f"`{c}`") for c in columns]


def keep_first(df: DataFrame, columns: list[str], order: str) -> DataFrame:
    """df without rows that equal an earlier one on columns (nulls equal each other)."""
    first = df.groupBy(*_cols(columns)).agg(F.min(F.col(order)).alias("_first"))
    same = reduce(lambda a, b: a & b, [F.col(f"l.`{c}`").eqNullSafe(F.col(f"r.`{c}`")) for c in columns])
    return df.alias("l").join(first.alias("r"), same & (F.col(f"l.`{order}`") == F.col("r._first")), "left_semi")


def duplicate_flags(df: DataFrame, columns: list[str], order: str) -> DataFrame:
    """df with ``is_duplicate``: an earlier row is equal on columns. Rows of the same order value are ordered by a hash of all their columns.

    The first of each group comes from an aggregation and is joined back, so that a large group is split.
    """
    place = F.struct(F.col(f"`{order}`").alias("a"), F.xxhash64(*_cols(df.columns)).alias("b"))
    first = df.groupBy(*_cols(columns)).agg(F.min(place).alias("_first"))
    same = reduce(lambda a, b: a & b, [F.col(f"l.`{c}`").eqNullSafe(F.col(f"r.`{c}`")) for c in columns])
    both = df.withColumn("_place", place).alias("l").join(first.alias("r"), same, "left")
    return both.select(*[F.col(f"l.`{c}`") for c in df.columns], (F.col("l._place") > F.col("r._first")).alias("is_duplicate"))


def normalised(df: DataFrame, columns: list[str]) -> DataFrame:
    """String columns trimmed, lower case, white space collapsed."""
    kinds = dict(df.dtypes)
    return df.select(*[fold_case(collapse(F.col(f"`{c}`"))).alias(c) if kinds[c] == "string" else F.col(f"`{c}`") for c in columns])


def near_duplicates(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: exact duplicates, duplicates after normalising text, the extra ones and their share of rows."""

    def beyond_first(x: DataFrame) -> DataFrame:
        return x.groupBy(*_cols(columns)).agg(F.count("*").alias("n")).agg(F.sum(F.col("n") - 1).alias("d"), F.sum("n").alias("rows"))

    a, b = beyond_first(df.select(*_cols(columns))), beyond_first(normalised(df, columns))
    both = a.select(F.col("d").alias("exact"), "rows").join(F.broadcast(b.select(F.col("d").alias("normalised"))))  # one row each
    extra = F.col("normalised") - F.col("exact")
    return both.select("exact", "normalised", extra.alias("extra"), rounded(extra / F.col("rows")).alias("share"))


def average_ranks(df: DataFrame, value: str, by: list[str] | None = None, name: str = "rank") -> DataFrame:
    """df with the mean rank of its non-null values, ascending.

    Ranks come from the counts of distinct values, not from one sorted
    partition: cumulative counts run over value ranges at fixed cut points.
    Ranks of frequent values, of which there are few, go to all tasks; rows of
    the others meet their ranks in partitions of about ``JOINED`` rows.
    """
    by = by or []
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = ranged(counts, value, parts, "_p")
    totals = cut.groupBy(*by, "_p").agg(F.sum("_n").alias("_t"))
    before = totals.withColumn("_b", F.coalesce(F.sum("_t").over(Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_t")
    within = F.coalesce(F.sum("_n").over(Window.partitionBy(*by, "_p").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = cut.withColumn("_w", within).join(before, [*by, "_p"]).select(*by, value, (F.col("_b") + F.col("_w") + (F.col("_n") + 1) / 2.0).alias(name), F.col("_n").alias("_ties"))
    keys = [*by, value]
    size = counts.agg(F.sum("_n")).first()[0] or 0
    often = ranked.where(F.col("_ties") > max(1, size // FREQUENT)).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(name).alias("_r"), F.col("_ties").alias("_c"))  # FREQUENT rows at most
    own = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_k{i}") for i, k in enumerate(keys)])
    known = df.join(F.broadcast(often), own, "left").drop(*[f"_k{i}" for i in range(len(keys))])
    # Rows that are done, or have no value, are spread by a number that no rank has.
    open_ = known.withColumn("_s", F.when(F.col("_r").isNull() & F.col(value).isNotNull(), F.lit(0).cast("long")).otherwise(F.monotonically_increasing_id() + 1))
    n = max(parts, size // JOINED)
    rest = ranked.where(F.col("_ties") <= max(1, size // FREQUENT)).withColumn("_s", F.lit(0).cast("long"))
    met = open_.repartition(n, *keys, "_s").join(rest.repartition(n, *keys, "_s"), [*keys, "_s"], "left")
    return met.select(*[F.col(f"`{c}`") for c in [*keys, *[c for c in df.columns if c not in keys]]], F.coalesce("_r", name).alias(name), F.coalesce("_c", "_ties").alias("_ties"))


def quartile_bins(df: DataFrame, value: str) -> DataFrame:
    """df with ``bin`` 0 to 3 by right-closed bins at interpolated quartiles (the lowest edge included); equal edges merge."""
    q = quantile_row(df, numbers([value]), [0.0, 0.25, 0.5, 0.75, 1.0]).select(F.col("q0").alias("_q"))
    edges = F.array_sort(F.array_distinct("_q"))
    inner = F.slice(edges, 2, F.greatest(F.size(edges) - 2, F.lit(0)))
    both = df.join(F.broadcast(q.select(inner.alias("_edges"))))  # one row
    nth = F.size(F.filter("_edges", lambda e: e < F.col(value)))
    return both.withColumn("bin", F.when(F.col(value).isNotNull(), nth)).drop("_edges")


def median_split(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with a 0/1 column ``<c>_high`` for each c: at or above its median."""
    m = quantile_row(df, numbers(columns), [0.5]).select(*[F.col(f"q{i}")[0].alias(f"_m{i}") for i in range(len(columns))])
    both = df.join(F.broadcast(m))  # one row
    return both.withColumns({f"{c}_high": (F.col(c) >= F.col(f"_m{i}")).cast("int") for i, c in enumerate(columns)}).drop(*[f"_m{i}" for i in range(len(columns))])


def daily_counts(df: DataFrame, ts: str) -> DataFrame:
    """Rows of each calendar day from the first to the last, days without rows included."""
    n = df.where(F.col(ts).isNotNull()).groupBy(F.to_date(ts).alias("day")).agg(F.count("*").alias("n"))
    days = n.agg(F.min("day").alias("a"), F.max("day").alias("b")).where("a is not null").select(F.explode(F.sequence("a", "b")).alias("day"))
    return days.join(n, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


def sequential_share(df: DataFrame, value: str, order: str) -> DataFrame:
    """One row: successive differences of one, in row order, their number and share."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = ranged(df.where(F.col(value).isNotNull()).select(value, *([order] if order != value else [])), order, parts, "_p")
    w = Window.partitionBy("_p").orderBy(order)
    inner = counted.withColumn("_d", F.col(value) - F.lag(value).over(w))
    ends = counted.groupBy("_p").agg(F.min_by(value, order).alias("first"), F.max_by(value, order).alias("last"))
    across = ends.select((F.col("first") - F.lag("last").over(Window.orderBy("_p"))).alias("_d"))  # a row a partition
    d = inner.select("_d").union(across).where(F.col("_d").isNotNull())
    return d.agg(F.count("*").alias("differences"), F.count_if(F.col("_d") == 1).alias("ones")).withColumn("share", rounded(F.when(F.col("differences") > 0, F.col("ones") / F.col("differences"))))


def top_one(df: DataFrame, by: str, value: str) -> DataFrame:
    """The most frequent value of each group with its count; ties to the smaller value."""
    n = df.where(F.col(value).isNotNull() & F.col(by).isNotNull()).groupBy(by, value).agg(F.count("*").alias("count"))
    return n.groupBy(by).agg(F.max("count").alias("count"), F.min_by(F.col(value), F.struct(-F.col("count"), F.col(value))).alias(value))


def newest(df: DataFrame, by: str, order: str, id: str) -> DataFrame:
    """For each group the row of the largest ``order`` (ties: the larger id): group, ``latest``, id; rows without an order count only where a group has no other. Combined in the map tasks."""
    place = F.struct(F.col(order), F.col(id))
    return df.groupBy(by).agg(F.max(place).alias("_top")).select(by, F.col(f"_top.{order}").alias("latest"), F.col(f"_top.{id}").alias(id))


def frequencies(df: DataFrame, column: str, name: str = "frequency") -> DataFrame:
    """df with the share of rows that have the row's value."""
    total = df.agg(F.count("*").alias("_total"))
    n = df.groupBy(column).agg(F.count("*").alias("_n")).join(F.broadcast(total)).select(F.col(column).alias("_v"), (F.col("_n") / F.col("_total")).alias(name))  # one row
    return df.join(n, F.col(column).eqNullSafe(F.col("_v")), "left").drop("_v")


def apply_mapping(df: DataFrame, column: str, mapping: dict[str, str] | DataFrame) -> DataFrame:
    """column with variants replaced by their canonical spelling: by a dict, or by a frame of (v, best) with a row for each variant."""
    if isinstance(mapping, DataFrame):
        m = mapping.select(F.col("v").alias("_v"), F.col("best").alias("_best"))
        return df.join(m, F.col(f"`{column}`") == F.col("_v"), "left").withColumn(column, F.coalesce("_best", F.col(f"`{column}`"))).drop("_v", "_best")
    if not mapping:
        return df
    table = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return df.withColumn(column, F.coalesce(F.try_element_at(table, F.col(column)), F.col(column)))


def contamination(train: DataFrame, test: DataFrame, columns: list[str]) -> DataFrame:
    """One row: test rows, those whose values on columns occur in train, and their share."""
    same = reduce(lambda a, b: a & b, [F.col(f"l.`{c}`").eqNullSafe(F.col(f"r.`{c}`")) for c in columns])
    known = train.select(*_cols(columns)).distinct().withColumn("_hit", F.lit(1))
    both = test.alias("l").join(known.alias("r"), same, "left")
    return both.agg(F.count("*").alias("rows"), F.count("_hit").alias("contaminated")).withColumn("share", rounded(F.when(F.col("rows") > 0, F.col("contaminated") / F.col("rows")).otherwise(0.0)))


def key_overlap(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """Values that both have."""
    return a.select(column).where(F.col(column).isNotNull()).intersect(b.select(column))


def rows_not_in(after: DataFrame, before: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of after that equal no row of before on columns: none if after was made by dropping rows."""
    same = reduce(lambda a, b: a & b, [F.col(f"l.`{c}`").eqNullSafe(F.col(f"r.`{c}`")) for c in columns])
    return after.alias("l").join(before.select(*_cols(columns)).alias("r"), same, "left_anti")


def same_frame(a: DataFrame, b: DataFrame) -> bool:
    """Whether two frames have the same columns, types and rows with repeats."""
    if a.dtypes != b.dtypes:
        return False
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def union_all(frames: list[DataFrame]) -> DataFrame:
    """All rows under all columns; missing ones are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def null_where_in(df: DataFrame, column: str, values: list) -> DataFrame:
    return df.withColumn(column, F.when(~F.coalesce(F.col(column).isin(values), F.lit(False)), F.col(column)))


def contained(df: DataFrame, column: str, allowed: list) -> DataFrame:
    """One row: distinct values, and those outside allowed."""
    v = df.where(F.col(column).isNotNull()).select(column).distinct()
    return v.agg(F.count("*").alias("distinct"), F.count_if(~F.col(column).isin(allowed)).alias("outside"))


def token_hits(df: DataFrame, column: str, tokens: list[str]) -> DataFrame:
    """Lower-case distinct values that are among tokens."""
    return df.select(fold_case(F.col(column)).alias("token")).where(F.col("token").isin(tokens)).distinct()


def canonical_spellings(df: DataFrame, column: str, key, order: str) -> DataFrame:
    """For each key(column) with more than one spelling: the most frequent one (ties: first seen) and each variant."""
    n = df.where(F.col(column).isNotNull()).groupBy(key(F.col(column)).alias("fold"), F.col(column).alias("variant")).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    best = n.groupBy("fold").agg(F.min_by("variant", F.struct(-F.col("n"), F.col("first"))).alias("canonical"), F.count("*").alias("spellings"), F.max("n").alias("top"), F.sum("n").alias("rows")).where("spellings > 1")
    return n.join(best, "fold").select("fold", "variant", "n", "canonical", (F.col("top") / F.col("rows")).alias("dominance"))


def missing_mask_counts(df: DataFrame, column: str) -> DataFrame:
    """One row: nulls, blanks and tokens of a column, and rows."""
    c = F.col(f"`{column}`")
    blank = c.isNotNull() & (F.trim(c) == "")
    return df.agg(F.count("*").alias("rows"), F.count_if(c.isNull()).alias("nulls"), F.count_if(blank).alias("blanks"), F.count_if(missing_like(c) & c.isNotNull() & ~blank).alias("tokens"))
