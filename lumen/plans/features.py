"""Feature preparation: parts of dates, filling, one-hot or frequency encoding, scaling, and features of known domains."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumen import vocab
from lumen.functions import columns as C
from lumen.operators import rows
from lumen.operators.quantiles import numbers, quantile_row, ranged
from lumen.plans.profile import profile


def date_parts(df: DataFrame, columns: list[str]) -> DataFrame:
    for c in columns:
        df = df.withColumns({f"{c}_year": F.year(c), f"{c}_month": F.month(c), f"{c}_day": F.dayofmonth(c)}).drop(c)
    return df


def one_hot(df: DataFrame, column: str, values: list) -> DataFrame:
    """A 0/1 column for each value."""
    return df.withColumns({f"{column}_{v}": F.coalesce(F.col(f"`{column}`") == F.lit(v), F.lit(False)).cast("int") for v in values}).drop(column)


def label_codes(df: DataFrame, column: str) -> DataFrame:
    """column as its values' places in sorted order, counted within ranges of values."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    values = ranged(df.where(F.col(f"`{column}`").isNotNull()).select(F.col(f"`{column}`").alias("_v")).distinct(), "_v", parts, "_p")
    sizes = values.groupBy("_p").agg(F.count("*").alias("_n"))
    before = sizes.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))  # a row a range
    place = F.col("_b") + F.row_number().over(Window.partitionBy("_p").orderBy("_v")) - 1
    codes = values.join(before, "_p").select("_v", place.cast("int").alias("_c"))
    return df.join(codes, F.col(f"`{column}`") == F.col("_v"), "left").drop(column, "_v").withColumnRenamed("_c", column)


def scale(df: DataFrame, columns: list[str]) -> DataFrame:
    """columns less their mean over their population deviation."""
    if not columns:
        return df
    m = df.agg(*[e for i, c in enumerate(columns) for e in (F.avg(f"`{c}`").alias(f"_m{i}"), F.stddev_pop(f"`{c}`").alias(f"_s{i}"))])
    both = df.join(F.broadcast(m))  # one row
    out = both.withColumns({c: F.when(F.col(f"_s{i}") > 0, (F.col(f"`{c}`") - F.col(f"_m{i}")) / F.col(f"_s{i}")).otherwise(0.0) for i, c in enumerate(columns)})
    return out.drop(*[x for i in range(len(columns)) for x in (f"_m{i}", f"_s{i}")])


def prepare(df: DataFrame, target: str | None = None, encoding: str = "onehot", scaled: bool = True) -> DataFrame:
    """A numeric frame: dates to parts, gaps filled, categories encoded, spread-out columns scaled; the target stays."""
    if encoding not in ("onehot", "label"):
        raise ValueError("encoding is onehot or label")
    ps = profile(df)
    dates = [c for c, p in ps.items() if p.kind == "datetime" and c != target]
    df = date_parts(df, dates)
    ps = profile(df)
    nums = [c for c, p in ps.items() if p.numeric and c != target]
    if nums:
        med = quantile_row(df, numbers(nums), [0.5]).first()  # a number a column
        df = df.withColumns({c: F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(float(med[f"q{i}"][0] if med[f"q{i}"] else 0.0))) for i, c in enumerate(nums)})
    for c, p in ps.items():
        if c == target or p.numeric:
            continue
        if p.type == "boolean":
            df = df.withColumn(c, F.coalesce(F.col(c), F.lit(False)).cast("int"))
            continue
        df = df.withColumn(c, F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(vocab.UNKNOWN)))
        if encoding == "label":
            df = label_codes(df, c)
        elif p.unique <= 30 and p.ratio <= 0.10:
            df = one_hot(df, c, sorted(r[0] for r in df.select(c).distinct().collect()))  # at most 31 values
        else:
            df = rows.frequencies(df, c, "_f").drop(c).withColumnRenamed("_f", c)
    return scale(df, [c for c in nums if ps[c].unique > 2]) if scaled else df


def domain_features(df: DataFrame) -> DataFrame:
    """Titles, families, decks and tickets where columns of these names are there."""
    cols = {c.lower(): c for c in df.columns}
    if "name" in cols:
        title = C.name_title(F.col(cols["name"]))
        if (df.agg(F.avg((title != "").cast("int")).alias("s")).first()["s"] or 0) >= 0.30:
            df = df.withColumn("Title", F.nullif(title, F.lit(""))).withColumn("TitleGrouped", C.title_group(title))
    if "sibsp" in cols and "parch" in cols:
        size = F.col(cols["sibsp"]) + F.col(cols["parch"]) + 1
        df = df.withColumn("FamilySize", size).withColumn("IsAlone", (size == 1).cast("int")).withColumn("IsFamily", (size > 1).cast("int"))
    if "cabin" in cols:
        df = df.withColumn("Deck", C.deck(F.col(cols["cabin"]))).withColumn("CabinCount", F.coalesce(C.word_count(F.col(cols["cabin"])), F.lit(0)))
    if "ticket" in cols:
        t = F.col(cols["ticket"])
        key = F.upper(C.trim_all(t))
        n = df.groupBy(key.alias("_k")).agg(F.count("*").alias("TicketCount"))
        df = df.withColumn("TicketPrefix", C.ticket_prefix(t)).withColumn("TicketNumber", C.ticket_number(t)).withColumn("_key", key).join(n, F.col("_key").eqNullSafe(F.col("_k")), "left").drop("_key", "_k")
    return df
