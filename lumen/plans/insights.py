"""Insights: candidates from evidence, tests of each, ranking with caps, and a text report."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumen.functions import special
from lumen.functions.columns import rounded
from lumen.operators import importance, outliers, pairs, rows, select, summaries
from lumen.operators.quantiles import numbers, quantile_row
from lumen.operators.select import by_type
from lumen.plans.profile import Profile, profile

#: Rows of a group, difference in percent, correlation, and the caps and priorities of kinds.
GROUP, DIFFERENCE, CORRELATION = 15, 10.0, 0.15
CAPS = {"group_difference": 2, "risk_segment": 2, "segment": 2, "interaction": 2, "outlier": 1, "correlation": 1, "feature_importance": 3, "distribution": 2}
PRIORITY = {"group_difference": 5, "risk_segment": 4, "interaction": 3, "outlier": 3, "segment": 3, "correlation": 2, "feature_importance": 2, "distribution": 2}
LIMITS = {"group_difference": 0.10, "risk_segment": 0.15, "interaction": 0.20, "correlation": 0.05, "segment": 0.10, "feature_importance": 0.05}
MOST, PER_FEATURE = 8, 2
#: Gaps in percent of interactions and of quartiles, rows of a test's group and of a test, a group's share over that of others, and the least that a kind must show.
INTERACTION_GAP, QUARTILE_GAP, TEST_GROUP, TEST_ROWS, OVER = 15.0, 15.0, 5, 20, 1.1
ACTIONABLE = {"feature_importance": 0.05, "correlation": 0.15, "group_difference": 0.10, "outlier": 0.02, "segment": 0.15, "risk_segment": 0.10, "interaction": 0.15}
#: Kinds of which one is enough for a feature, columns whose importance is told and the least of it, and what tells the outcome: the most frequent target's share of rows that have, and that lack, a value.
REDUNDANT = [{"group_difference", "risk_segment"}, {"group_difference", "segment"}, {"risk_segment", "segment"}, {"correlation", "feature_importance"}, {"group_difference", "interaction"}, {"group_difference", "feature_importance"}, {"risk_segment", "feature_importance"}, {"segment", "feature_importance"}]
IMPORTANT, LEAST_IMPORTANT, TELLING_PRESENT, TELLING_MISSING = 5, 0.15, 0.95, 0.85
#: How much longer texts of one class must be, and by how many points of percent it must lack more values.
LONGER, LACKING = 1.15, 10.0
#: What counts as the lift of a category that is found among the highest values only.
ONLY = 10.0
#: What a kind weighs in business.
WEIGHTS = {"outlier": 0.75, "risk_segment": 0.75, "group_difference": 1.0, "segment": 0.85, "interaction": 0.90, "distribution": 0.75, "correlation": 0.65, "feature_importance": 0.65, "data_quality": 0.05}


@dataclass
class Insight:
    kind: str
    feature: str
    finding: str
    importance: float
    effect: float
    p: float | None = None
    n: int = 0
    confidence: float = 0.0
    facts: dict = field(default_factory=dict)


def confidence(n: int, effect: float, p: float | None, missing_pct: float) -> float:
    c = 0.25 * min(1.0, n / 200) + 0.30 * min(1.0, abs(effect)) + 0.30 * (1 - p if p is not None else 0.6) + 0.15 * (1 - min(missing_pct, 20.0) / 20)
    return round(min(0.95, c), 4)


def quartile_means(df: DataFrame, column: str, target: str) -> DataFrame:
    """bin, n, low, high, mean: the target's mean in each quartile bin of a column."""
    x = rows.quartile_bins(df.select(*[v.alias(c) for c, v in numbers([column, target]).items()]).where(F.col(f"`{target}`").isNotNull()), column).where("bin is not null")
    return x.groupBy("bin").agg(F.count("*").alias("n"), rounded(F.min(f"`{column}`")).alias("low"), rounded(F.max(f"`{column}`")).alias("high"), rounded(F.avg(f"`{target}`")).alias("mean"))


def quartile_gap(df: DataFrame, column: str, target: str) -> DataFrame:
    """One row: the best and worst quartile's mean and their gap in percent of the worst; none unless there are two bins."""
    q = quartile_means(df, column, target)
    one = q.agg(F.max("mean").alias("best"), F.min("mean").alias("worst"), F.max_by("bin", F.struct("mean", "bin")).alias("best_bin"), F.min_by("bin", F.struct("mean", "bin")).alias("worst_bin"), F.sum("n").alias("n"), F.count("*").alias("bins"))
    return one.where("bins >= 2").select("best_bin", "worst_bin", "best", "worst", "n", rounded(F.when(F.col("worst") != 0, (F.col("best") - F.col("worst")) / F.abs("worst") * 100), 4).alias("gap_pct"))


def interaction_groups(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """A row for each combination of halves (at or above the median, or below) of the columns: n, mean and variance of the target, of rows that have all of them."""
    use = df.select(*[v.alias(c) for c, v in numbers([*columns, target]).items()]).dropna()
    keys = [f"{c}_high" for c in columns]
    return rows.median_split(use, columns).groupBy(*keys).agg(F.count("*").alias("n"), rounded(F.avg(f"`{target}`")).alias("mean"), rounded(F.var_samp(f"`{target}`"), 4).alias("variance"))


def interaction_test(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """One row: the one-way analysis of variance of the target over the halves' combinations of at least five rows."""
    use = df.select(*[v.alias(c) for c, v in numbers([*columns, target]).items()]).dropna()
    x = rows.median_split(use, columns).withColumn("_group", F.concat_ws("-", *[F.col(f"{c}_high").cast("string") for c in columns]))
    return pairs.anova(x, "_group", target, TEST_GROUP)


def risk_split(df: DataFrame, column: str, target: str, quantile: float = 0.75) -> DataFrame:
    """df's rows with both values, and ``risk``: whether the target is above its quantile (as the test's bins are closed on the right)."""
    cut = quantile_row(df, numbers([target]), [quantile]).select(F.col("q0")[0].alias("_cut"))
    return df.where(F.col(f"`{column}`").isNotNull() & F.col(f"`{target}`").isNotNull()).join(F.broadcast(cut)).withColumn("risk", F.col(f"`{target}`") > F.col("_cut")).drop("_cut")  # one row


def risk_shares(df: DataFrame, column: str, target: str) -> DataFrame:
    """Categories whose share among the risky rows is more than 1.1 times that among the rest, with three such rows or more; by lift."""
    g = risk_split(df, column, target).groupBy(F.col(f"`{column}`").cast("string").alias("category")).agg(F.count_if("risk").alias("risky"), F.count_if(~F.col("risk")).alias("others"))
    t = g.agg(F.sum("risky").alias("tr"), F.sum("others").alias("to"))
    x = g.join(F.broadcast(t)).withColumns({"a": F.col("risky") / F.col("tr"), "b": F.col("others") / F.col("to")})  # one row
    return x.where((F.col("a") > OVER * F.col("b")) & (F.col("risky") >= 3)).select("category", "risky", "others", F.round(100 * F.col("a"), 2).alias("risk_pct"), F.round(100 * F.col("b"), 2).alias("other_pct"), rounded(F.when(F.col("b") > 0, F.col("a") / F.col("b")), 4).alias("lift")).orderBy(F.desc_nulls_first("lift"), "category")


def tested_risk_segment(df: DataFrame, column: str, target: str) -> dict | None:
    """Whether a column depends on being above the target's third quartile: chi-square for categories, Welch's test for numbers."""
    x = risk_split(df, column, target)
    numeric = column in by_type(df)["numeric"]
    few = df.agg(F.count_distinct(f"`{column}`")).first()[0] <= 10
    if not numeric or few:
        r = pairs.chi_square(x, "risk", column).first()
        return r and {"method": "chi_square", "n": r["n"], "p": pairs.chi_square_p(r["chi2"], r["rows"], r["columns"]), "effect": r["cramers_v"]}
    r = pairs.welch(x, "risk", column, True, False).first()
    return r and r["t"] is not None and {"method": "welch", "n": r["n1"] + r["n2"], "p": special.t_two_sided(r["t"], r["df"]), "effect": min(1.0, abs(r["t"]) / 10)} or None


def tested_segment(df: DataFrame, column: str, target: str) -> dict | None:
    """Welch's test of the target between the highest and the lowest quartile bin of a column."""
    x = rows.quartile_bins(df.select(*[v.alias(c) for c, v in numbers([column, target]).items()]).dropna(), column)
    top = x.agg(F.max("bin")).first()[0]
    r = pairs.welch(x, "bin", target, top, 0).first() if top else None
    return r and r["t"] is not None and {"method": "welch", "n": r["n1"] + r["n2"], "p": special.t_two_sided(r["t"], r["df"])} or None


def tested_feature(df: DataFrame, column: str, target: str) -> dict | None:
    """Chi-square of two columns of categories, the rank correlation's p of two of numbers; none for one of each."""
    kinds = by_type(df)
    numbers_ = [c in kinds["numeric"] for c in (column, target)]
    if all(numbers_):
        r = pairs.spearman(df, column, target).first()
        return r and r["r"] is not None and {"method": "spearman", "n": r["n"], "p": special.correlation_p(r["r"], r["n"]), "effect": abs(r["r"])} or None
    if any(numbers_):
        return None
    r = pairs.chi_square(df, target, column).first()
    return r and {"method": "chi_square", "n": r["n"], "p": pairs.chi_square_p(r["chi2"], r["rows"], r["columns"]), "effect": r["cramers_v"]}


def merged_importance(df: DataFrame, target: str, top: int = IMPORTANT) -> DataFrame:
    """feature, importance, relative: the ``top`` features by rank correlation or by their categories' score, each by the larger, and as a share of the largest; none of importance 0."""
    both = importance.numeric_importance(df, target).select("feature", "importance").unionByName(importance.categorical_importance(df, target).select("feature", "importance"))
    best = both.where("importance > 0").groupBy("feature").agg(F.max("importance").alias("importance")).orderBy(F.desc("importance"), "feature").limit(top)
    largest = best.agg(F.max("importance").alias("_m"))
    return best.join(F.broadcast(largest)).select("feature", "importance", rounded(F.when(F.col("_m") > 0, F.col("importance") / F.col("_m")), 4).alias("relative"))  # one row


def telling(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """column, present, missing: the most frequent target's share of the rows that have a value, and of those that lack one; null below ten rows of that sort.

    One aggregation by target for all columns, which is combined in the map tasks.
    """
    has = [F.col(f"`{c}`").isNotNull() for c in columns]
    g = df.groupBy(F.col(f"`{target}`").alias("_t")).agg(*[e for i, h in enumerate(has) for e in (F.count_if(h).alias(f"p{i}"), F.count_if(~h).alias(f"m{i}"))])

    def share(k: str):
        known = F.when(F.col("_t").isNotNull(), F.col(k))
        return rounded(F.when(F.sum(k) >= 10, F.try_divide(F.max(known), F.sum(known))))

    one = g.agg(*[e for i in range(len(columns)) for e in (share(f"p{i}").alias(f"p{i}"), share(f"m{i}").alias(f"m{i}"))])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"p{i}").alias("present"), F.col(f"m{i}").alias("missing")) for i, c in enumerate(columns)])).alias("x")).select("x.*")


def important(df: DataFrame, target: str, ps: dict[str, Profile]) -> list[Insight]:
    """The most important features of a target, with their test, but for those whose being there or not tells the target."""
    found = [r for r in merged_importance(df, target).collect() if r["feature"] in ps and r["importance"] >= LEAST_IMPORTANT]  # at most IMPORTANT rows
    gaps = [r["feature"] for r in found if ps[r["feature"]].missing > 0.05]
    shares = {r["column"]: r for r in telling(df, gaps, target).collect()} if gaps else {}
    out = []
    for r in found:
        c, s = r["feature"], shares.get(r["feature"])
        if s and ((s["present"] or 0) > TELLING_PRESENT or (s["missing"] or 0) > TELLING_MISSING):
            continue
        t = tested_feature(df, c, target)
        p, n, word = t["p"] if t else None, t["n"] if t else ps[c].count, "strong" if r["relative"] >= 0.5 else "moderate" if r["relative"] >= 0.2 else "weak"
        out.append(Insight("feature_importance", c, f"{c} bears {word} signal for {target} (importance {r['importance']:.2f})", r["relative"], r["relative"], p, n, initial_confidence(r["importance"], n, r["relative"], p), {"importance": r["importance"]}))
    return out


def class_gaps(df: DataFrame, target: str, texts: list[str], gaps: list[str]) -> DataFrame:
    """kind, column, most, least, high, low: for each text the classes of the longest and shortest mean length, for each column with gaps those that lack most and least of it in percent. Classes of no text do not count."""
    e = {f"l{i}": F.avg(F.char_length(f"`{c}`")) for i, c in enumerate(texts)} | {f"m{i}": 100 * F.avg(F.col(f"`{c}`").isNull().cast("int")) for i, c in enumerate(gaps)}
    g = df.where(F.col(f"`{target}`").isNotNull()).groupBy(F.col(f"`{target}`").cast("string").alias("_t")).agg(*[v.alias(k) for k, v in e.items()])
    place = lambda k, sign: F.struct(sign * F.col(k), "_t")
    one = g.agg(*[x for k in e for x in (F.min_by("_t", F.when(F.col(k).isNotNull(), place(k, -1))).alias(f"{k}_a"), F.min_by("_t", F.when(F.col(k).isNotNull(), place(k, 1))).alias(f"{k}_b"), F.max(k).alias(f"{k}_h"), F.min(k).alias(f"{k}_l"))])
    names = {f"l{i}": ("length", c) for i, c in enumerate(texts)} | {f"m{i}": ("missing", c) for i, c in enumerate(gaps)}
    rows_ = [F.struct(F.lit(kind).alias("kind"), F.lit(c).alias("column"), F.col(f"{k}_a").alias("most"), F.col(f"{k}_b").alias("least"), rounded(F.col(f"{k}_h"), 4).alias("high"), rounded(F.col(f"{k}_l"), 4).alias("low")) for k, (kind, c) in names.items()]
    return one.select(F.explode(F.array(*rows_)).alias("x")).select("x.*")


def of_classes(df: DataFrame, target: str, ps: dict[str, Profile]) -> list[Insight]:
    """What stands out between the classes of a target of categories: the leading class, and classes of longer texts or more gaps."""
    t, out = ps[target], []
    top = summaries.class_distribution(df, target, 1).first()
    if top:
        out.append(Insight("distribution", target, f"{target} has {t.unique} classes; {top['value']} leads with {100 * top['count'] / t.count:.1f} %", 0.60, top["count"] / t.count, None, t.count, 0.90))
    texts = [c for c, p in ps.items() if c != target and p.type == "string" and p.kind == "text"]
    gaps = [c for c, p in ps.items() if c != target and p.nulls]
    for r in class_gaps(df, target, texts, gaps).collect() if texts or gaps else []:  # a row a column
        c = r["column"]
        if r["kind"] == "length" and r["high"] is not None and r["high"] > LONGER * r["low"]:
            gap = 100 * (r["high"] - r["low"]) / max(r["low"], 1.0)
            out.append(Insight("segment", c, f"{c} has {r['high']:.0f} letters on average for {target} = {r['most']}, {r['low']:.0f} for {r['least']}", 0.55, min(1.0, gap / 100), None, ps[c].count, 0.75, {"gap_pct": gap}))
        if r["kind"] == "missing" and r["high"] is not None and r["high"] > r["low"] + LACKING:
            out.append(Insight("data_quality", c, f"{r['high']:.1f} % of {c} is missing for {target} = {r['most']}, {r['low']:.1f} % for {r['least']}", 0.50, (r["high"] - r["low"]) / 100, None, ps[c].rows, 0.85))
    return out


def tested_interaction(df: DataFrame, columns: list[str], target: str) -> dict | None:
    r = interaction_test(df, columns, target).first()
    return r and r["n"] >= TEST_ROWS and r["f"] is not None and {"method": "anova", "n": r["n"], "p": pairs.anova_p(r["f"], r["k"], r["n"]), "effect": r["eta_squared"]} or None


def interactions(df: DataFrame, target: str, columns: list[str]) -> list[Insight]:
    """Columns that say little by rank correlation, but whose quartiles differ: with the column of largest correlation as a partner, and the test of both."""
    r = {x["a"] if x["b"] == target else x["b"]: x["r"] or 0.0 for x in importance.spearman_pairs(df, [*columns, target]).where((F.col("a") == target) | (F.col("b") == target)).collect()}  # a row a column
    out = []
    for c in [c for c in columns if abs(r.get(c, 0.0)) < CORRELATION]:
        g = quartile_gap(df, c, target).first()
        if g and g["gap_pct"] is not None and g["gap_pct"] > INTERACTION_GAP:
            partner = max((x for x in columns if x != c), key=lambda x: abs(r.get(x, 0.0)), default=None)
            t = tested_interaction(df, [c, partner], target) if partner else None
            out.append(Insight("interaction", c, f"{target} differs by {g['gap_pct']:.0f} % between parts of {c}, though their rank correlation is {r.get(c, 0.0):.2f}", 0.60, t["effect"] if t else 0.0, t["p"] if t else None, g["n"], facts={"partner": partner, "gap_pct": g["gap_pct"], "correlation": r.get(c, 0.0)}))
    return out


def quartile_segments(df: DataFrame, target: str, columns: list[str]) -> list[Insight]:
    """Columns between whose quartiles the target's mean differs by 15 % or more."""
    out = []
    for c in columns:
        g = quartile_gap(df, c, target).first()
        if g and g["gap_pct"] is not None and g["gap_pct"] >= QUARTILE_GAP:
            t = tested_segment(df, c, target)
            out.append(Insight("segment", c, f"{target} averages {g['best']:.4g} in quartile {g['best_bin'] + 1} of {c} and {g['worst']:.4g} in quartile {g['worst_bin'] + 1}", min(1.0, g["gap_pct"] / 80), min(1.0, g["gap_pct"] / 100), t["p"] if t else None, g["n"], facts={"gap_pct": g["gap_pct"]}))
    return out


def candidates(df: DataFrame, target: str, ps: dict[str, Profile]) -> list[Insight]:
    """What stands out around a target; every frame read here has a row a group, pair or column."""
    out: list[Insight] = []
    t = ps[target]
    nums = [c for c, p in ps.items() if c != target and p.kind == "numeric" and p.sd]
    cats = [c for c, p in ps.items() if c != target and p.kind == "categorical" and 2 <= p.unique <= 50]
    if t.numeric and t.kind == "numeric":
        for c in nums:
            r = pairs.spearman(df, c, target).first()
            if r["r"] is not None and abs(r["r"]) >= CORRELATION:
                out.append(Insight("correlation", c, f"{target} {'rises' if r['r'] > 0 else 'falls'} with {c} (rank correlation {r['r']:.2f})", abs(r["r"]), r["r"], special.correlation_p(r["r"], r["n"]), r["n"]))
        for c in cats:
            g = [r for r in summaries.group_statistics(df, c, target, None).collect() if r["count"] >= GROUP and r["mean"] is not None]
            if len(g) >= 2 and g[-1]["mean"]:
                gap = (g[0]["mean"] - g[-1]["mean"]) / abs(g[-1]["mean"]) * 100
                a = pairs.anova(df, c, target, GROUP).first()
                if gap >= DIFFERENCE and a:
                    out.append(Insight("group_difference", c, f"{target} is {gap:.0f} % higher for {c} = {g[0]['group']} than for {g[-1]['group']}", min(1.0, gap / 100), a["score"] or 0.0, pairs.anova_p(a["f"], a["k"], a["n"]) if a["f"] is not None else None, a["n"]))
            for r in risk_shares(df, c, target).limit(1).collect():
                done = tested_risk_segment(df, c, target)
                lift = r["lift"] or ONLY  # no other row has the category
                out.append(Insight("risk_segment", c, f"{c} = {r['category']} is {f'{lift:.1f} times as frequent' if r['lift'] else 'found only'} among the highest quarter of {target}", min(1.0, lift / 3), min(1.0, lift - 1), done["p"] if done else None, r["risky"] + r["others"], facts={"lift": lift}))
        out += interactions(df, target, nums) + quartile_segments(df, target, nums) if nums else []
        o = outliers.outliers(df, [target]).first()
        if o and o["outliers"] >= 5 and o["percentage"] >= 2:
            out.append(Insight("outlier", target, f"{o['outliers']} values of {target} ({o['percentage']:.1f} %) are outliers", o["percentage"] / 100, o["mad_share"] or 0.0, None, t.count))
        out += important(df, target, ps)
        s = summaries.target_thresholds(df, target).first()
        if s["median"] and abs(s["mean"] - s["median"]) >= 0.2 * abs(s["median"]):
            out.append(Insight("distribution", target, f"the mean of {target} ({s['mean']:.4g}) is far from its median ({s['median']:.4g})", 0.3, 0.3, None, t.count))
    else:
        for c in cats:
            x = pairs.chi_square(df, target, c).first()
            if x and x["cramers_v"] is not None and x["cramers_v"] >= CORRELATION:
                most = summaries.lift(df, target, c).orderBy(F.desc("lift"), F.desc("n"), "a", "b").first()
                out.append(Insight("group_difference", c, f"{c} = {most['b']} is {most['lift']:.1f} times as frequent for {target} = {most['a']} as overall (Cramér's V {x['cramers_v']:.2f})", min(0.95, 2.5 * x["cramers_v"] + 0.1 * (most["lift"] - 1)), x["cramers_v"], pairs.chi_square_p(x["chi2"], x["rows"], x["columns"]), x["n"], facts={"lift": most["lift"]}))
        for c in nums:
            k = pairs.kruskal(df, target, c).first()
            if k and k["score"] is not None and k["score"] >= 0.02:
                out.append(Insight("feature_importance", c, f"{c} differs between classes of {target}", min(1.0, k["score"] * 2), k["score"], special.chi2_upper(k["h"], k["k"] - 1), k["n"]))
        out += of_classes(df, target, ps)
    for c, p in ps.items():
        if p.missing > 0.05:
            out.append(Insight("distribution", c, f"{p.missing:.0%} of {c} is missing", p.missing, p.missing, None, p.rows))
    return out


def actionable(x: Insight) -> bool:
    """Whether an insight shows as much as its kind must."""
    shown = {"segment": x.facts.get("gap_pct", 0.0) / 100, "interaction": x.facts.get("gap_pct", 0.0) / 100}.get(x.kind, abs(x.importance))
    return shown >= ACTIONABLE.get(x.kind, 0.0)


def initial_confidence(statistic: float, n: int, effect: float, p: float | None = None) -> float:
    """Confidence before any test: half of the statistic's own, more for rows and effect, less where p speaks against it; 0.10 to 0.90."""
    c = 0.5 * statistic + (0.25 if n >= 1000 else 0.15 if n >= 100 else 0.05) + 0.20 * min(1.0, abs(effect))
    return round(min(0.90, max(0.10, c * (0.6 if p is not None and p > 0.05 else 1.0))), 4)


def severity(x: Insight) -> str:
    """critical, strong, moderate or weak, from the gap, the effect and the test."""
    gap, effect = abs(x.facts.get("gap_pct", 0.0)), min(1.0, max(abs(x.effect), abs(x.facts.get("gap_pct", 0.0)) / 100))
    if x.kind == "interaction":
        return "moderate" if x.p is not None and x.p < 0.05 else "weak"
    if x.kind == "feature_importance":
        tested = x.p is not None and x.p >= 0.05
        return ("moderate" if effect >= 0.5 else "weak") if tested else "strong" if effect >= 0.5 else "moderate" if effect >= 0.2 else "weak"
    if gap >= 100 and (x.p is None or x.p < 0.01):
        return "critical"
    if x.p is not None and x.p < 0.01 and effect >= 0.4:
        return "strong"
    return "moderate" if x.p is not None and x.p < 0.05 or effect >= 0.2 else "weak"


def composite(x: Insight) -> float:
    """Significance, effect, confidence and weight in one number, by which an alternate ranking sorts."""
    sure = 0.5 if x.p is None else 1.0 - min(1.0, x.p)
    return round(0.35 * sure + 0.30 * min(1.0, abs(x.effect)) + 0.20 * x.confidence + 0.15 * WEIGHTS.get(x.kind, 0.50), 4)


def by_severity(found: list[Insight], most: int | None = None) -> list[Insight]:
    """The alternate ranking: by severity, then by the composite."""
    order = ["critical", "strong", "moderate", "weak"]
    return sorted(found, key=lambda x: (order.index(severity(x)), -composite(x), x.kind, x.feature))[:most]


def strict(x: Insight) -> bool:
    """The stricter rule of keeping: correlations and importances of 0.35, differences of 30 %, and no test against it."""
    least = {"correlation": 0.35, "feature_importance": 0.35, "group_difference": 0.30, "segment": 0.30, "risk_segment": 0.30}.get(x.kind, 0.0)
    return (x.p is None or x.p < 0.05) and max(abs(x.effect), abs(x.importance)) >= least


def triggers(df: DataFrame, target: str | None = None) -> DataFrame:
    """kind, column, value: skewed columns, correlated pairs, columns with gaps, and an imbalanced target; what is worth a closer look."""
    kinds = by_type(df)
    out = [df.sparkSession.createDataFrame([], "kind string, column string, value double")]
    if kinds["numeric"]:
        s = summaries.numeric_summary(df, kinds["numeric"])
        out.append(s.where(F.abs("skewness") > 1).select(F.lit("skewed").alias("kind"), "column", F.col("skewness").alias("value")))
        out.append(pairs.pearson_pairs(df, kinds["numeric"]).where(F.abs("r") >= 0.4).select(F.lit("correlated").alias("kind"), F.concat_ws(" x ", "a", "b").alias("column"), F.col("r").alias("value")))
    out.append(select.missing_by_column(df).where("missing > 0").select(F.lit("missing").alias("kind"), "column", F.col("percentage").alias("value")))
    if target is not None and target not in kinds["numeric"]:
        out.append(summaries.class_balance(df, target).where("imbalanced").select(F.lit("imbalanced").alias("kind"), F.lit(target).alias("column"), F.col("ratio").alias("value")))
    return reduce(DataFrame.unionByName, out)


def serialise(x: Insight) -> dict:
    """An insight as plain values, its confidence also in a word."""
    word = "high" if x.confidence >= 0.75 else "medium" if x.confidence >= 0.45 else "low"
    return {"kind": x.kind, "feature": x.feature, "finding": x.finding, "confidence": x.confidence, "confidence_label": word, "severity": severity(x), "p": x.p, "effect": x.effect, "n": x.n, "facts": x.facts}


def parse_sections(text: str) -> list[dict[str, str]]:
    """Headings of a Markdown or plain text with what stands below each: lines of #, bold lines, or lines that end in a colon."""
    out: list[dict[str, str]] = []
    for line in text.splitlines():
        m = re.fullmatch(r"#+\s+(.+?)\s*#*|\*\*(.+?)\*\*:?|([A-Z][^.:]{1,60}):", line.strip())
        if m:
            out.append({"title": next(g for g in m.groups() if g), "body": ""})
        elif out:
            out[-1]["body"] = f"{out[-1]['body']}\n{line}".strip("\n")
    return out


def summary(found: list[Insight], target: str | None, model=None) -> str:
    """Two or three sentences: how many insights, the first of them, and how the model did."""
    if not found:
        return "No pattern stands out."
    first = f"{len(found)} insight{'s' * (len(found) > 1)}{f' on {target}' if target else ''}; the first: {found[0].finding}."
    name = next(iter(model.metrics), None) if model is not None and model.status == "trained" else None
    return first + (f" A {model.model} model has {name} {model.metrics[name]}." if name else "")


def model_evidence(df: DataFrame, model, target: str, top: int = 5) -> list[tuple[str, float]]:
    """A model's strongest columns, without identifiers, what leaks, and what is known only for one class; importances shrink where values are missing."""
    ps = profile(df)
    weights: dict[str, float] = {}
    for name, w in model.importance:
        c = next((c for c in sorted(ps, key=len, reverse=True) if name == c or name.startswith(f"{c}_")), None)
        if c and c not in model.left_out and ps[c].kind != "identifier":
            weights[c] = weights.get(c, 0.0) + w
    out = []
    if weights:
        known = list(weights)
        one = df.where(F.col(f"`{target}`").isNotNull()).groupBy(F.col(f"`{target}`").cast("string")).agg(*[F.avg(F.col(f"`{c}`").isNotNull().cast("int")).alias(f"k{i}") for i, c in enumerate(known)])
        spread = one.agg(*[F.max(f"k{i}").alias(f"a{i}") for i in range(len(known))], *[F.min(f"k{i}").alias(f"b{i}") for i in range(len(known))]).first() if ps[target].unique <= 20 else None
        for i, c in enumerate(known):
            if spread is not None and spread[f"a{i}"] >= 0.95 and spread[f"b{i}"] <= 0.15:
                continue  # there or not there with the class: it tells the outcome
            out.append((c, round(weights[c] * (0.25 if ps[c].missing > 0.5 else 0.5 if ps[c].missing > 0.3 else 1.0), 6)))
    return sorted(out, key=lambda x: (-x[1], x[0]))[:top]


def validated(found: list[Insight], ps: dict[str, Profile]) -> list[Insight]:
    """Insights whose test does not speak against them, with their confidence; what was never tested keeps the one that it came with."""
    kept = []
    for x in found:
        x.confidence = x.confidence if x.p is None and x.confidence else confidence(x.n, x.effect, x.p, 100 * ps[x.feature].missing)
        if actionable(x) and (x.p is None or x.kind not in LIMITS or x.p <= LIMITS[x.kind]):
            kept.append(x)
    return kept


def ranked(found: list[Insight]) -> list[Insight]:
    """The best by importance, confidence and priority, with caps on kinds and features; of kinds that say the same of a feature the better one."""
    score = lambda x: x.importance * x.confidence * max(0.5, PRIORITY.get(x.kind, 0) / 5) * 1.05
    said = lambda x: any(y.feature == x.feature and (y.kind == x.kind or {x.kind, y.kind} in REDUNDANT) for y in out)
    out: list[Insight] = []
    for x in sorted(found, key=lambda x: (-score(x), x.kind, x.feature)):
        if score(x) >= 0.05 and not said(x) and sum(y.kind == x.kind for y in out) < CAPS.get(x.kind, MOST) and sum(y.feature == x.feature for y in out) < PER_FEATURE and len(out) < MOST:
            out.append(x)
    return out


def insights(df: DataFrame, target: str) -> list[Insight]:
    """The insights of df, whose rows are kept by the executors meanwhile: each test reads them, and a join below them would be made, and its small sides sent through the driver, for each anew."""
    kept = df.storageLevel.useMemory or df.storageLevel.useDisk
    if not kept:
        df = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        ps = profile(df)
        found = ranked(validated(candidates(df, target, ps), ps))
    finally:
        if not kept:
            df.unpersist()
    if not found:
        n = ps[target]
        found = [Insight("distribution", target, f"{target} has {n.unique} values in {n.count} rows", 0.1, 0.0, None, n.count)]
    return found


def report(title: str, ps: dict[str, Profile], found: list[Insight]) -> str:
    """Markdown."""
    lines = [f"# {title}", "", "## Columns", "", "| column | kind | rows | missing | distinct |", "|-|-|-|-|-|"]
    lines += [f"| {p.name} | {p.kind} | {p.rows} | {p.missing:.1%} | {p.unique} |" for p in ps.values()]
    lines += ["", "## Insights", ""] + [f"- {x.finding} (confidence {x.confidence:.2f})" for x in found]
    return "\n".join(lines) + "\n"
