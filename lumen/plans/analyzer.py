"""The statistical engine: overview, summaries, correlations, outliers, groups and associations of a frame."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame

from lumen.functions import special
from lumen.operators import importance, outliers, pairs, select, summaries
from lumen.plans.profile import Profile, profile


@dataclass
class Analysis:
    """Results as frames, lazy until read, except for the profiles."""

    profiles: dict[str, Profile]
    overview: DataFrame
    numeric: DataFrame | None = None
    categorical: dict[str, DataFrame] = field(default_factory=dict)
    datetime: dict[str, DataFrame] = field(default_factory=dict)
    text: dict[str, DataFrame] = field(default_factory=dict)
    boolean: dict[str, DataFrame] = field(default_factory=dict)
    correlations: DataFrame | None = None
    outliers: DataFrame | None = None
    groups: dict[str, DataFrame] = field(default_factory=dict)
    associations: DataFrame | None = None


class Analyzer:
    """Statistics of one frame; methods are validated here, defaults are spearman, iqr and 1.5."""

    def __init__(self, df: DataFrame, correlation: str = "spearman", outlier: str = "iqr", threshold: float = 1.5):
        if correlation not in ("pearson", "spearman", "kendall"):
            raise ValueError("correlation is pearson, spearman or kendall")
        if outlier not in ("iqr", "zscore"):
            raise ValueError("outlier is iqr or zscore")
        self.df, self.correlation, self.outlier, self.threshold = df, correlation, outlier, threshold
        self.profiles = profile(df)

    def columns(self, kind: str) -> list[str]:
        return [c for c, p in self.profiles.items() if p.kind == kind]

    def measures(self) -> list[str]:
        """Numeric columns that spread and are neither identifiers nor codes."""
        return [c for c in self.columns("numeric") if self.profiles[c].sd and not self.profiles[c].ordinal]

    def correlations(self) -> DataFrame | None:
        cols = self.measures()
        if len(cols) < 2:
            return None
        if self.correlation == "pearson":
            return pairs.ranked_pairs(pairs.pearson_pairs(self.df, cols))
        if self.correlation == "spearman":
            return pairs.ranked_pairs(importance.spearman_pairs(self.df, cols))
        return pairs.ranked_pairs(reduce(DataFrame.unionByName, [pairs.kendall(self.df, a, b) for a, b in combinations(cols, 2)]))

    def distribution(self, column: str, most: int = 5000) -> dict:
        """Shape by skewness; Shapiro-Wilk where there are at most ``most`` values, as the test is defined for no more."""
        row = summaries.numeric_summary(self.df, [column]).first()
        if row["count"] < 3 or row["constant"]:
            return {"shape": "unknown"}
        skew = row["skewness"] or 0.0
        out = {"shape": "right_skewed" if skew > 1 else "left_skewed" if skew < -1 else "normal_like", "skewness": skew}
        if row["count"] <= most:
            values = [float(r[0]) for r in self.df.select(column).where(f"`{column}` is not null").collect()]
            if got := special.shapiro_wilk(values):
                out |= {"w": round(got[0], 6), "p": round(got[1], 6), "normal": got[1] > 0.05}
        return out

    def analyze(self, target: str | None = None, by: str | None = None) -> Analysis:
        df = self.df
        out = Analysis(self.profiles, select.duplicate_rows(df))
        if cols := self.columns("numeric"):
            out.numeric = summaries.numeric_summary(df, cols)
        out.categorical = {c: summaries.categorical_summary(df, c) for c in self.columns("categorical") + self.columns("identifier")}
        out.datetime = {c: summaries.datetime_summary(df, c) for c in self.columns("datetime")}
        out.text = {c: summaries.text_summary(df, c) for c in self.columns("text")}
        out.boolean = {c: summaries.boolean_summary(df, c) for c in self.columns("boolean")}
        out.correlations = self.correlations()
        if cols := self.measures():
            out.outliers = outliers.outliers(df, cols, self.outlier, self.threshold)
        value = target if target in self.columns("numeric") else next(iter(self.measures()), None)
        for g in [by] if by else self.columns("categorical"):
            if value and g != value:
                out.groups[g] = summaries.group_statistics(df, g, value)
        if target:
            others = [c for c, p in self.profiles.items() if c != target and p.kind in ("numeric", "categorical") and p.missing <= 0.30 and (p.numeric or p.unique <= 20 or p.ratio <= 0.20) and p.unique > 1]
            out.associations = pairs.target_associations(df, target, others) if others else None
        return out
