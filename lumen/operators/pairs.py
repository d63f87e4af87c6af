"""Bivariate statistics: correlations, contingency, tests between groups."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumen import vocab
from lumen.functions import special
from lumen.functions.columns import finite, rounded, strength
from lumen.operators.concordance import tau_b
from lumen.operators.rows import average_ranks
from lumen.operators.select import by_type


def _both(a: str, b: str):
    """Two columns as doubles, null unless both are there."""
    x, y = finite(F.col(f"`{a}`").cast("double")), finite(F.col(f"`{b}`").cast("double"))
    ok = x.isNotNull() & y.isNotNull()
    return F.when(ok, x), F.when(ok, y)


def pearson_pairs(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """r and n of every pair of columns over the rows that have both, 400 pairs a pass."""
    columns = by_type(df)["numeric"] if columns is None else columns
    pairs = list(combinations(columns, 2))
    if len(pairs) > 400:
        return reduce(DataFrame.union, [_pearson(df, pairs[i : i + 400]) for i in range(0, len(pairs), 400)])
    return _pearson(df, pairs)


def _pearson(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    if not pairs:
        return df.sparkSession.createDataFrame([], "a string, b string, r double, n long")
    one = df.agg(*[e for i, (a, b) in enumerate(pairs) for x, y in [_both(a, b)] for e in (F.corr(x, y).alias(f"r{i}"), F.count(x).alias(f"n{i}"))])
    cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), rounded(F.col(f"r{i}")).alias("r"), F.col(f"n{i}").alias("n")) for i, (a, b) in enumerate(pairs)]
    return one.select(F.explode(F.array(*cells)).alias("x")).select("x.*")


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: a, b, r, n; ranks are taken among the rows that have both."""
    x, y = _both(a, b)
    d = df.select(x.alias("x"), y.alias("y")).where("x is not null").withColumn("_i", F.monotonically_increasing_id())
    d = average_ranks(average_ranks(d, "x", name="rx").drop("_ties"), "y", name="ry")
    return d.agg(F.lit(a).alias("a"), F.lit(b).alias("b"), rounded(F.corr("rx", "ry")).alias("r"), F.count("*").alias("n"))


def kendall(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: a, b, r, n by tau-b, exact for any number of values."""
    return tau_b(df, a, b)


def ranked_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs with strength and direction, by |r| descending."""
    d = F.when(F.col("r") > 0, "positive").when(F.col("r") < 0, "negative").otherwise("none")
    return pairs.where(F.col("r").isNotNull()).withColumn("strength", strength(F.col("r"))).withColumn("direction", d).orderBy(F.desc(F.abs("r")), "a", "b")


def significant_pairs(df: DataFrame, columns: list[str] | None = None, least: int = 4) -> list[dict]:
    """Pearson pairs of at least ``least`` rows and |r| < 1 with two-sided p; a few dozen rows on the driver."""
    out = []
    for r in pearson_pairs(df, columns).collect():
        if r["r"] is not None and r["n"] >= least and abs(r["r"]) < 1:
            p = special.correlation_p(r["r"], r["n"])
            out.append({"a": r["a"], "b": r["b"], "r": r["r"], "n": r["n"], "p": round(p, 6), "significant": p < 0.05})
    return sorted(out, key=lambda x: (-abs(x["r"]), x["a"], x["b"]))


def anova(df: DataFrame, by: str, value: str, least: int = 1) -> DataFrame:
    """One row: groups, n, F and the score F / (F + n - k); p by :func:`anova_p`."""
    g = df.where(F.col(by).isNotNull() & F.col(value).isNotNull()).groupBy(by).agg(F.count("*").alias("n"), F.avg(value).alias("m"), F.coalesce(F.var_samp(value), F.lit(0.0)).alias("v")).where(F.col("n") >= least)
    t = g.agg(F.count("*").alias("k"), F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean"), F.sum((F.col("n") - 1) * F.col("v")).alias("ssw"))
    ssb = g.join(F.broadcast(t.select("mean"))).agg(F.sum(F.col("n") * (F.col("m") - F.col("mean")) ** 2).alias("ssb"))  # one row
    x = t.join(F.broadcast(ssb)).where("k >= 2 and n > k")  # one row
    f = F.try_divide(F.col("ssb") / (F.col("k") - 1), F.col("ssw") / (F.col("n") - F.col("k")))  # null where groups do not vary inside
    return x.select("k", "n", rounded(f, 4).alias("f"), rounded(f / (f + F.col("n") - F.col("k"))).alias("score"), rounded(F.try_divide(F.col("ssb"), F.col("ssb") + F.col("ssw"))).alias("eta_squared"))


def anova_p(f: float, k: int, n: int) -> float:
    return special.f_upper(f, k - 1, n - k)


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).agg(F.count("*").alias("n"))


def chi_square(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: rows, columns, n, chi-square (with Yates' correction at one degree of freedom) and Cramér's V; cells without rows count."""
    n = contingency(df, a, b)
    ra, rb = n.groupBy("a").agg(F.sum("n").alias("ra")), n.groupBy("b").agg(F.sum("n").alias("rb"))
    t = n.agg(F.sum("n").alias("t"), F.count_distinct("a").alias("r"), F.count_distinct("b").alias("c"))
    # Cells with rows; those without add their expected counts, which sum to t less the expected counts of the rest.
    x = n.join(ra, "a").join(rb, "b").join(F.broadcast(t))  # t: one row
    e = F.col("ra") * F.col("rb") / F.col("t")
    yates = (F.col("r") == 2) & (F.col("c") == 2)
    d = F.abs(F.col("n") - e)
    d = F.when(yates, d - F.least(F.lit(0.5), d)).otherwise(d)
    s = x.agg(F.max("t").alias("n"), F.max("r").alias("rows"), F.max("c").alias("columns"), F.sum(d * d / e).alias("chi"), F.sum(e).alias("seen"), F.count("*").alias("cells"))
    empty = F.col("n") - F.col("seen")
    # At 2 x 2 an empty cell's share under Yates needs its own expected count: with one empty cell that is what is left.
    left = F.when((F.col("rows") == 2) & (F.col("columns") == 2) & (F.col("cells") == 3), (empty - F.least(F.lit(0.5), empty)) ** 2 / empty).otherwise(empty)
    chi = F.col("chi") + F.when(F.col("cells") < F.col("rows") * F.col("columns"), left).otherwise(0.0)
    v = F.sqrt(chi / (F.col("n") * (F.least("rows", "columns") - 1)))
    return s.where("rows >= 2 and columns >= 2").select("n", "rows", "columns", rounded(chi, 4).alias("chi2"), rounded(v).alias("cramers_v"))


def chi_square_p(chi2: float, rows: int, columns: int) -> float:
    return special.chi2_upper(chi2, (rows - 1) * (columns - 1))


def welch(df: DataFrame, by: str, value: str, first: object, second: object) -> DataFrame:
    """One row: t and degrees of freedom for two groups of at least two rows."""
    c = F.col(value)
    pick = lambda g, f: f(F.when(F.col(by) == F.lit(g), c))
    m1, m2, v1, v2, n1, n2 = (pick(g, f) for f in (F.avg, F.var_samp, F.count) for g in (first, second))
    a, b = v1 / n1, v2 / n2
    one = df.agg(n1.alias("n1"), n2.alias("n2"), rounded((m1 - m2) / F.sqrt(a + b)).alias("t"), rounded((a + b) ** 2 / (a * a / (n1 - 1) + b * b / (n2 - 1)), 4).alias("df"))
    return one.where("n1 >= 2 and n2 >= 2")


def rank_sums(df: DataFrame, by: str, value: str) -> DataFrame:
    """For each group: count and rank sum of value among all rows, and the tie term sum(t^3 - t) of all."""
    d = df.where(F.col(by).isNotNull() & F.col(value).isNotNull()).select(F.col(by).alias("group"), F.col(value).cast("double").alias("v"))
    counts = d.groupBy("v").agg(F.count("*").alias("t")).agg(F.sum(F.col("t") ** 3 - F.col("t")).alias("ties"))
    return average_ranks(d, "v").groupBy("group").agg(F.count("*").alias("n"), F.sum("rank").alias("rank_sum")).join(F.broadcast(counts))  # one row


def mann_whitney(df: DataFrame, by: str, value: str, first: object, second: object) -> DataFrame:
    """One row: n1, n2, U of the first group, ties, and the rank-biserial |1 - 2U / (n1 n2)|."""
    g = rank_sums(df.where(F.col(by).isin(first, second)), by, value)
    one = g.agg(*[F.max(F.when(F.col("group") == F.lit(x), F.col(c))).alias(f"{c}{i}") for i, x in ((1, first), (2, second)) for c in ("n", "rank_sum")], F.max("ties").alias("ties"))
    u = F.col("rank_sum1") - F.col("n1") * (F.col("n1") + 1) / 2
    return one.select("n1", "n2", rounded(u, 2).alias("u"), rounded(F.col("ties"), 2).alias("ties"), rounded(F.abs(1 - 2 * u / (F.col("n1") * F.col("n2")))).alias("effect"))


def kruskal(df: DataFrame, by: str, value: str) -> DataFrame:
    """One row: groups, n, tie-corrected H and H / (n - 1)."""
    g = rank_sums(df, by, value)
    s = g.agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.col("rank_sum") ** 2 / F.col("n")).alias("s"), F.max("ties").alias("ties"))
    n = F.col("n")
    h = (12 / (n * (n + 1)) * F.col("s") - 3 * (n + 1)) / (1 - F.col("ties") / (n**3 - n))
    return s.where("k >= 2").select("k", "n", rounded(h, 4).alias("h"), rounded(h / (n - 1)).alias("score"))


def target_associations(df: DataFrame, target: str, columns: list[str]) -> DataFrame:
    """a row a feature: method and score; numeric targets by |Spearman| and ANOVA score, others by Cramér's V and H / (n - 1)."""
    kinds = by_type(df)
    numeric_target = target in kinds["numeric"]
    out = None
    for c in columns:
        numeric = c in kinds["numeric"]
        if numeric and numeric_target:
            x = spearman(df, c, target).where(F.col("n") >= vocab.PAIR_ROWS).select(F.lit("spearman").alias("method"), F.abs("r").alias("score"))
        elif numeric_target:
            x = anova(df, c, target, vocab.GROUP_ROWS).where(F.col("n") >= vocab.PAIR_ROWS).select(F.lit("anova").alias("method"), "score")
        elif numeric:
            x = kruskal(df, target, c).where(F.col("n") >= vocab.PAIR_ROWS_CATEGORICAL).select(F.lit("kruskal").alias("method"), "score")
        else:
            x = chi_square(df, target, c).where(F.col("n") >= vocab.PAIR_ROWS_CATEGORICAL).select(F.lit("cramers_v").alias("method"), F.col("cramers_v").alias("score"))
        x = x.select(F.lit(c).alias("feature"), "method", "score")
        out = x if out is None else out.union(x)
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc_nulls_last("score"), "feature")))  # a row a feature
