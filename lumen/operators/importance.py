"""Which columns speak about a target: correlations, tests and their ranking."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumen import vocab
from lumen.functions.columns import finite, rounded, segments
from lumen.operators import information, pairs, rows
from lumen.operators.quantiles import numbers
from lumen.operators.select import by_type

#: Features that rankings hold, share of missing values and of distinct ones beyond which a feature is left out, and the rows that a score needs.
TOP, MISSING, RATIO, ROWS, ROWS_CATEGORICAL, FEW_VALUES = 5, 0.30, 0.20, 10, 20, 20


def ranked_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """``r0, r1, ..``: the mean ranks of columns without missing values, row by row; all columns share two exchanges."""
    named = df.select(F.monotonically_increasing_id().alias("row"), *[v.alias(f"c{i}") for i, v in enumerate(numbers(columns).values())])
    long = named.select("row", F.posexplode(F.array(*[f"c{i}" for i in range(len(columns))])).alias("i", "v"))
    ranks = rows.average_ranks(long, "v", ["i"]).select("row", "i", "rank")
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.count() * len(columns) // rows.JOINED)
    ranked = ranks.repartition(tasks, "row").groupBy("row").agg(*[F.max(F.when(F.col("i") == i, F.col("rank"))).alias(f"r{i}") for i in range(len(columns))])
    return ranked.drop("row")


def spearman_pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, r, n of all pairs. Columns without missing values are ranked once for all their pairs; ranks of others depend on the pair."""
    missing = df.agg(*[F.count_if(v.isNull()).alias(f"m{i}") for i, v in enumerate(numbers(columns).values())]).first()
    full = [c for i, c in enumerate(columns) if not missing[f"m{i}"]]
    out = []
    if len(full) > 1:
        r, place = ranked_columns(df, full), {c: f"r{i}" for i, c in enumerate(full)}
        both = list(combinations(full, 2))
        for at in range(0, len(both), 400):  # pairs of one pass
            part = both[at : at + 400]
            one = r.agg(F.count("*").alias("n"), *[F.corr(place[a], place[b]).alias(f"x{i}") for i, (a, b) in enumerate(part)])
            cells = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), rounded(F.col(f"x{i}")).alias("r"), F.col("n")) for i, (a, b) in enumerate(part)])
            out.append(one.select(F.explode(cells).alias("x")).select("x.*"))
    out += [pairs.spearman(df, a, b) for a, b in combinations(columns, 2) if not (a in full and b in full)]
    return reduce(DataFrame.unionByName, out) if out else df.sparkSession.createDataFrame([], "a string, b string, r double, n long")


def correlation_table(df: DataFrame, columns: list[str] | None = None, method: str = "spearman", least_variance: float = 0.0, top: int | None = None) -> DataFrame:
    """Pairs by |r| (three digits) among columns whose variance is above ``least_variance``; ``top``: the first 1 to 50 of them."""
    columns = by_type(df)["numeric"] if columns is None else columns
    if columns:
        spread = df.agg(*[F.var_samp(v).alias(f"v{i}") for i, v in enumerate(numbers(columns).values())]).first()
        columns = [c for i, c in enumerate(columns) if spread[f"v{i}"] is not None and spread[f"v{i}"] > least_variance]
    found = pairs.pearson_pairs(df, columns) if method == "pearson" else spearman_pairs(df, columns)
    out = pairs.ranked_pairs(found.withColumn("r", F.round("r", 3)))
    return out if top is None else out.limit(max(1, min(50, top)))


def features(df: DataFrame, target: str) -> list[str]:
    """Columns but the target whose names do not mark an identifier, a date or an annotation."""
    return [c for c in df.columns if c != target and not set(segments(c)) & set(vocab.NEGATIVE) and not c.lower().endswith("outlierflag")]


def target_correlations(df: DataFrame, target: str) -> DataFrame:
    """feature, r (three digits), n: rank correlations of the numeric features with a numeric target, by |r|."""
    numeric = by_type(df)["numeric"]
    use = [c for c in features(df, target) if c in numeric]
    if target not in numeric or not use:
        return df.sparkSession.createDataFrame([], "feature string, r double, n long")
    found = reduce(DataFrame.unionByName, [pairs.spearman(df, c, target) for c in use]) if len(use) < 3 else spearman_pairs(df, [*use, target])
    out = found.where((F.col("a") == target) | (F.col("b") == target)).select(F.when(F.col("a") == target, F.col("b")).otherwise(F.col("a")).alias("feature"), F.round("r", 3).alias("r"), "n")
    return out.where("r is not null").orderBy(F.desc(F.abs("r")), "feature")


def importance_proxy(df: DataFrame, target: str, top: int = TOP) -> DataFrame:
    """The features of largest |rank correlation| with a numeric target."""
    x = target_correlations(df, target).where(F.col("n") >= ROWS)
    return x.select("feature", F.abs("r").alias("importance")).orderBy(F.desc("importance"), "feature").limit(top)


def numeric_importance(df: DataFrame, target: str, top: int = TOP) -> DataFrame:
    """As the proxy, of features that miss at most 30 % of their values."""
    x = df.agg(*[F.avg(F.col(f"`{c}`").isNull().cast("int")).alias(f"m{i}") for i, c in enumerate(df.columns)]).first()
    use = [c for i, c in enumerate(df.columns) if c == target or (x[f"m{i}"] or 0) <= MISSING]
    return importance_proxy(df.select(*[F.col(f"`{c}`") for c in use]), target, top).withColumn("type", F.lit("numeric"))


def categorical_importance(df: DataFrame, target: str, top: int = TOP) -> DataFrame:
    """Features of few values by their ANOVA score against a numeric target, or by Cramér's V."""
    kinds = by_type(df)
    one = df.agg(F.count("*").alias("n"), *[e for i, c in enumerate(df.columns) for e in (F.avg(F.col(f"`{c}`").isNull().cast("int")).alias(f"m{i}"), F.approx_count_distinct(f"`{c}`", 0.02).alias(f"u{i}"))]).first()
    out = []
    for i, c in enumerate(df.columns):
        text = df.schema[c].dataType.simpleString() == "string"
        if c not in features(df, target) or c in kinds["datetime"] or (one[f"m{i}"] or 0) > MISSING or one[f"u{i}"] > RATIO * one["n"] or not (text or one[f"u{i}"] <= FEW_VALUES):
            continue
        if target in kinds["numeric"]:
            x = pairs.anova(df, c, target, vocab.GROUP_ROWS).where(F.col("n") >= ROWS_CATEGORICAL).select(F.lit(c).alias("feature"), F.round(F.least(F.lit(1.0), "score"), 3).alias("importance"), F.lit("anova").alias("method"))
        else:
            x = pairs.chi_square(df, target, c).where(F.col("n") >= ROWS_CATEGORICAL).select(F.lit(c).alias("feature"), F.round(F.least(F.lit(1.0), "cramers_v"), 3).alias("importance"), F.lit("cramers_v").alias("method"))
        out.append(x)
    if not out:
        return df.sparkSession.createDataFrame([], "feature string, importance double, method string")
    return reduce(DataFrame.unionByName, out).where("importance > 0").orderBy(F.desc("importance"), "feature").limit(top)


def mutual_information(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: the mutual information in bits of two columns of numbers, each in quartile bins."""
    x = rows.quartile_bins(rows.quartile_bins(df.select(*[v.alias(c) for c, v in numbers([a, b]).items()]), a).withColumnRenamed("bin", "x"), b).withColumnRenamed("bin", "y")
    n = x.where("x is not null and y is not null").groupBy("x", "y").agg(F.count("*").alias("n"))
    nx, ny, t = n.groupBy("x").agg(F.sum("n").alias("nx")), n.groupBy("y").agg(F.sum("n").alias("ny")), n.agg(F.sum("n").alias("t"))
    both = n.join(F.broadcast(nx), "x").join(F.broadcast(ny), "y").join(F.broadcast(t))  # at most 16 rows
    return both.agg(rounded(F.sum(F.col("n") / F.col("t") * F.log2(F.col("n") * F.col("t") / (F.col("nx") * F.col("ny"))))).alias("bits"))


#: Distinct values up to which a target of numbers counts as classes.
CLASSES = 20


def ensemble_importance(df: DataFrame, target: str) -> DataFrame:
    """feature, importance: the mean of |r|, the mutual information by neighbours, the F value, each at most 1, and the say of a forest of this feature alone, which is 1 whenever it spreads.

    Targets of at most ``CLASSES`` distinct values are taken as classes. Features
    without spread, or with fewer than ``ROWS`` pairs, have no importance.
    """
    numeric = by_type(df)["numeric"]
    use = [c for c in features(df, target) if c in numeric]
    if target not in numeric or not use:
        return df.sparkSession.createDataFrame([], "feature string, importance double")
    classes = df.where(F.col(f"`{target}`").isNotNull()).select(F.col(f"`{target}`")).distinct().limit(CLASSES + 1).count() <= CLASSES
    out = []
    for c in use:
        x, y = finite(F.col(f"`{c}`").cast("double")), finite(F.col(f"`{target}`").cast("double"))
        both = df.where(x.isNotNull() & y.isNotNull())
        r = both.agg(F.try_divide(F.abs(F.covar_pop(x, y)), F.stddev_pop(x) * F.stddev_pop(y)).alias("r"), F.count("*").alias("n"), F.stddev_pop(x).alias("sx"), F.stddev_pop(y).alias("sy")).where((F.col("n") >= ROWS) & (F.col("sx") > 0) & (F.col("sy") > 0))
        nats = (information.of_classes if classes else information.of_numbers)(both, c, target).select("nats")
        if classes:
            r = r.join(F.broadcast(pairs.anova(both, target, c).select("f")), how="left")  # one row
        else:
            r = r.withColumn("f", F.try_divide(F.col("r") ** 2 * (F.col("n") - 2), 1 - F.col("r") ** 2))
        parts = [F.least(F.lit(1.0), F.coalesce(F.col(k), F.lit(1.0 if k == "f" else 0.0))) for k in ("r", "nats", "f")] + [F.lit(1.0)]
        out.append(r.join(F.broadcast(nats)).select(F.lit(c).alias("feature"), rounded(sum(parts[1:], parts[0]) / 4, 4).alias("importance")))  # one row each
    return reduce(DataFrame.unionByName, out).orderBy(F.desc("importance"), "feature")
