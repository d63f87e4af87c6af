"""Charts: which ones a table asks for, whether one can be drawn, and its data as a frame.

A plan is a list of small descriptions made from column profiles; the data of a
chart is a lazy frame with a row a mark, so nothing is drawn or collected here.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumen.functions.columns import finite, rounded
from lumen.operators import charts, outliers, pairs
from lumen.operators.select import by_type
from lumen.plans.ml import Outcome
from lumen.plans.profile import Profile, profile

#: Categories that a chart of a kind takes, distinct values from which a column is continuous, and the share of missing values beyond which a chart is left out.
MOST_CATEGORIES = {"box": 100, "bar": 100, "pie": 20}
CATEGORIES, DISCRETE, CONTINUOUS, MISSING, GAP = 35, 5, 15, 0.50, 0.05
#: Marks of a model's charts.
IMPORTANT, POINTS, RESIDUAL_BINS = 15, 500, 30


@dataclass(frozen=True)
class Chart:
    kind: str
    x: str
    y: str | None = None
    title: str = ""
    #: What y stands for: its values, its missing rate, the length of its text, or its web addresses' domains.
    of: str = "values"


def annotation(name: str) -> bool:
    """Columns that cleaning added."""
    n = name.lower()
    return n.endswith(("_outlierflag", "_outlier_flag")) or n.endswith("_flag") and any(w in n for w in ("outlier", "missing", "anomaly"))


def is_text(p: Profile) -> bool:
    """Strings of more than a twentieth distinct values."""
    return p.type == "string" and p.ratio > 0.05


def plan(df: DataFrame, target: str | None, ps: dict[str, Profile] | None = None, model: Outcome | None = None) -> list[Chart]:
    """Charts of the target, of what it may depend on, of gaps, of time and of a model; each (kind, x, y) once."""
    ps = ps or profile(df)
    of = lambda *kinds: [c for c, p in ps.items() if p.content in kinds and c != target and not annotation(c)]
    numeric, money, percent, dates, links = of("numeric"), of("currency"), of("percentage"), of("date"), of("url")
    cats = [c for c in of("categorical") if ps[c].unique <= CATEGORIES]
    out: list[Chart] = []
    if target in ps:
        t = ps[target]
        classes = not t.numeric
        out.append(Chart("bar" if classes else "histogram", target, None, f"Distribution of {target}"))
        if classes:
            out += [Chart("bar", target, c, f"Sources by {target}", "domain") for c in links[:1]]
            out += [Chart("bar", c, None, f"Distribution of {c}") for c in cats[:2]]
            out += [Chart("box", target, c, f"{c} by {target}") for c in [*numeric[:2], *money[:1], *percent[:1]]]
            gaps = [p for c, p in ps.items() if p.nulls and c != target]
            if gaps and (worst := max(gaps, key=lambda p: p.nulls)).missing > GAP:
                out.append(Chart("bar", target, worst.name, f"Missing {worst.name} by {target}", "missing"))
            out += [Chart("line", c, None, f"Rows over time by {target}") for c in dates[:1]]
        else:
            out += [Chart("scatter", c, target, f"{target} against {c}") for c in money[:1]]
            out += [Chart("line", c, target, f"{target} over time") for c in dates[:1]]
            if len(numeric) >= 2:
                out += [Chart("box" if ps[c].unique <= DISCRETE else "scatter", c, target, f"{target} against {c}") for c in numeric[:3]]
            out += [Chart("bar" if t.unique <= DISCRETE else "box", c, target, f"{target} by {c}") for c in cats[:5]]
    if model is not None and model.status == "trained":
        out += [Chart("bar", "feature", "importance", f"What {model.model} looks at", "model")] if model.importance else []
        if model.predictions is not None:
            out += [Chart("heatmap", "predicted", "actual", "Confusion", "model")] if model.task == "classification" else [Chart("scatter", "actual", "predicted", "Actual against predicted", "model"), Chart("histogram", "residual", None, "Residuals", "model")]
    return list({(c.kind, c.x, c.y): c for c in reversed(out)}.values())[::-1] or fallback(df)


def fallback(df: DataFrame) -> list[Chart]:
    """One chart by what types there are."""
    kinds = by_type(df)
    num, day, cat = kinds["numeric"], kinds["datetime"], kinds["categorical"]
    if day and num:
        return [Chart("line", day[0], num[0], f"{num[0]} over time")]
    if cat:
        return [Chart("bar", cat[0], num[0] if num else None, f"Distribution of {cat[0]}")]
    return [Chart("histogram", num[0], None, f"Distribution of {num[0]}")] if num else []


def problems(df: DataFrame, c: Chart, ps: dict[str, Profile] | None = None) -> list[str]:
    """Why a chart cannot be drawn; nothing if it can. Distinct values are counted only where a kind bounds them."""
    if c.of == "model":
        return []
    kinds, bad = by_type(df), [f"no column {x}" for x in (c.x, c.y) if x is not None and x not in df.columns]
    if bad:
        return bad
    x_number, y_number = c.x in kinds["numeric"], c.y is None or c.of != "values" or c.y in kinds["numeric"]
    if c.kind in ("histogram", "heatmap"):
        return []
    if c.kind not in ("box", "pie", "scatter", "line", "bar"):
        return [f"no such kind: {c.kind}"]
    if c.kind in MOST_CATEGORIES:
        n = ps[c.x].unique if ps else df.agg(F.count_distinct(f"`{c.x}`")).first()[0]
        if n > MOST_CATEGORIES[c.kind]:
            bad.append(f"{n} categories are more than {MOST_CATEGORIES[c.kind]}")
    if c.kind in ("pie", "scatter") and c.y is None:
        bad.append(f"a {c.kind} chart needs y")
    if c.kind == "scatter" and not x_number or c.kind == "line" and not (x_number or c.x in kinds["datetime"]):
        bad.append("x does not fit the kind")
    if not y_number:
        bad.append("y is not numeric")
    return bad


def missing_rates(df: DataFrame, by: str, column: str) -> DataFrame:
    """x, y: the share of rows of each group that miss the column, in percent."""
    g = df.where(F.col(f"`{by}`").isNotNull()).groupBy(F.col(f"`{by}`").cast("string").alias("x"))
    return g.agg(F.round(100.0 * F.avg(F.col(f"`{column}`").isNull().cast("int")), 2).alias("y"))


def heatmap(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """x, y, r: the whole Pearson matrix of the numeric columns, both halves and the diagonal; what is not defined is 0."""
    columns = by_type(df)["numeric"] if columns is None else columns
    half = pairs.pearson_pairs(df, columns).select(F.col("a").alias("x"), F.col("b").alias("y"), F.coalesce("r", F.lit(0.0)).alias("r"))
    own = df.sparkSession.createDataFrame([(c, c, 1.0) for c in columns], "x string, y string, r double")
    return half.union(half.select("y", "x", "r")).union(own)


def text_lengths(df: DataFrame, column: str) -> DataFrame:
    """df with ``<column>_length`` in characters: what a text column is drawn as."""
    return df.withColumn(f"{column}_length", F.char_length(F.col(f"`{column}`").cast("string")))


def model_data(model: Outcome, c: Chart, spark) -> DataFrame:
    """Marks of a model's chart: its strongest features, its confusion counts, some of its predictions by hash, or its residuals in bins."""
    if c.x == "feature":
        return spark.createDataFrame([(n, float(w)) for n, w in model.importance[:IMPORTANT]], "x string, y double")
    p = model.predictions
    if c.kind == "heatmap":
        return p.groupBy(F.col("prediction").alias("x"), F.col("label").alias("y")).agg(F.count("*").alias("n"))
    if c.kind == "scatter":
        return charts.scatter(p, "label", "prediction", POINTS)
    return charts.histogram(p.select((F.col("label") - F.col("prediction")).alias("residual")), "residual", RESIDUAL_BINS)


def data(df: DataFrame, c: Chart, model: Outcome | None = None) -> DataFrame | None:
    """The marks of a chart, or None where more than half of an axis is missing. Text on y is drawn by its length."""
    if c.of == "model":
        return model_data(model, c, df.sparkSession)
    axes = [x for x in (c.x, c.y) if x is not None]
    if c.of != "missing":
        gone = df.agg(*[F.avg(F.col(f"`{x}`").isNull().cast("int")).alias(f"m{i}") for i, x in enumerate(axes)]).first()
        if any((gone[f"m{i}"] or 0) > MISSING for i in range(len(axes))):
            return None
    if c.of == "domain":
        return charts.top_domains(df, c.x, c.y)
    if c.of == "missing":
        return missing_rates(df, c.x, c.y)
    y = c.y
    if y is not None and df.schema[y].dataType.simpleString() == "string":
        df, y = text_lengths(df, y), f"{y}_length"
    if c.kind == "histogram":
        v = finite(F.col(f"`{c.x}`").try_cast("double"))
        s = df.agg(F.count(f"`{c.x}`").alias("n"), F.count(v).alias("numbers"), F.approx_count_distinct(v).alias("u")).first()
        if s["numbers"] >= 0.9 * s["n"] and s["u"] > CONTINUOUS:
            return charts.histogram(df.withColumn(c.x, v), c.x)
        return charts.bars(df, c.x).orderBy(F.desc("y"), "x").limit(MOST_CATEGORIES["bar"])
    if c.kind == "box":
        return outliers.box_statistics(df, c.x, y) if y else None
    if c.kind == "heatmap":
        return heatmap(df)
    if c.kind == "line" and c.x in by_type(df)["datetime"]:
        return charts.line(df, c.x, y)
    return {"bar": charts.bars, "pie": charts.shares, "scatter": charts.scatter, "line": charts.bars}[c.kind](df, c.x, y)


def draw(df: DataFrame, c: Chart) -> DataFrame:
    """One chart on demand; ValueError with what is wrong with it."""
    if bad := problems(df, c):
        raise ValueError("; ".join(bad))
    out = data(df, c)
    if out is None:
        raise ValueError("more than half of an axis is missing")
    return out


def as_rows(df: DataFrame, plans: list[Chart], model: Outcome | None = None) -> DataFrame | None:
    """All charts' marks in one frame: chart, its description and each mark as JSON; charts that cannot be drawn are left out."""
    out = []
    for i, c in enumerate(plans):
        if not problems(df, c) and (d := data(df, c, model)) is not None:
            out.append(d.select(F.lit(i).alias("chart"), F.lit(json.dumps(asdict(c), sort_keys=True)).alias("description"), F.to_json(F.struct("*")).alias("mark")))
    return reduce(DataFrame.union, out) if out else None


def store(df: DataFrame, plans: list[Chart], path: str, model: Outcome | None = None) -> None:
    """Writes the charts' marks, a folder for each chart."""
    if (out := as_rows(df, plans, model)) is not None:
        out.write.mode("overwrite").partitionBy("chart").parquet(path)


def stored(spark, path: str, chart: int | None = None) -> DataFrame:
    """The marks of all stored charts or of one, which reads its folder alone."""
    out = spark.read.parquet(path)
    return out if chart is None else out.where(F.col("chart") == chart)


def missing_share(df: DataFrame, column: str) -> DataFrame:
    """One row: distinct values over values, and the share of rows that miss the column: what decides whether it is drawn."""
    c = F.col(f"`{column}`")
    return df.agg(rounded(F.when(F.count(c) > 0, F.count_distinct(c) / F.count(c))).alias("ratio"), rounded(F.avg(c.isNull().cast("int"))).alias("missing"))
