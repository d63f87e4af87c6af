"""Finding a likely target column, and leaving out what must not predict it."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumen import vocab
from lumen.functions.columns import named, segments
from lumen.operators import pairs
from lumen.plans.profile import Profile, profile


@dataclass
class Target:
    column: str | None
    confidence: float
    method: str
    task: str | None


STOP = {"data", "dataset", "train", "test", "final", "clean", "cleaned", "raw", "csv", "file", "sample", "the", "of", "and"}


def filename_hints(filename: str | None) -> list[str]:
    """Telling words of a file's name."""
    if not filename:
        return []
    stem = re.sub(r"\.[A-Za-z0-9]+$", "", filename.replace("\\", "/").rsplit("/", 1)[-1])
    return [s for s in segments(stem) if s not in STOP and not s.isdigit() and len(s) > 2]


def eligible(p: Profile) -> bool:
    """Whether a column may be a target: no identifier, date or flag; text only with few values."""
    if p.kind in ("identifier", "datetime", "text") or p.name.lower().endswith("outlierflag") or p.unique < 2:
        return False
    return p.numeric or p.type == "boolean" or p.ratio < 0.2


def task_of(p: Profile) -> str:
    return "regression" if p.numeric and p.unique > 20 else "classification"


#: What speaks for or against a column as the target, in points.
POINTS = {
    "text": -15, "third missing": -5, "target name": 5, "part of a target name": 4, "categorical target name": 6, "name of the file": 12, "last": 7, "last but one": 5, "third last": 1,
    "numeric": 3, "numbers that all differ": -5, "numbers that repeat": 2, "word of another role": -5, "part of such a word": -1, "two to twenty values": 1, "one value": -10,
}


def score(p: Profile, nth: int, columns: int, hints: list[str]) -> int:
    """Additive evidence that a column is the target, by POINTS."""
    words, name = segments(p.name), p.name.lower()
    negative = any(w in words for w in vocab.NEGATIVE)
    holds = {
        "text": p.kind == "text", "third missing": p.missing > 0.3,
        "target name": (known := name in vocab.STRONG_TARGETS + vocab.TARGETS), "part of a target name": not known and named(p.name, vocab.ALL_TARGETS), "categorical target name": named(p.name, vocab.CATEGORICAL_TARGETS),
        "name of the file": any(h in words for h in hints), "last": nth == columns - 1, "last but one": nth == columns - 2, "third last": nth == columns - 3,
        "numeric": p.numeric, "numbers that all differ": p.numeric and p.ratio > 0.95, "numbers that repeat": p.numeric and p.ratio <= 0.95,
        "word of another role": negative, "part of such a word": not negative and any(n in name for n in vocab.NEGATIVE), "two to twenty values": 2 <= p.unique <= 20, "one value": p.unique < 2,
    }
    return sum(POINTS[k] for k, yes in holds.items() if yes)


def detect_target(df: DataFrame, filename: str | None = None, profiles: dict[str, Profile] | None = None) -> Target:
    """By exact names, then name parts, the file's name, scores, spread, and at last the first column."""
    ps = profiles or profile(df)
    ok = [c for c in ps if eligible(ps[c])]
    done = lambda c, conf, how: Target(c, conf, how, task_of(ps[c]))
    for words, conf, how in ((vocab.STRONG_TARGETS, 0.95, "strong name"), (vocab.ALL_TARGETS, 0.94, "name")):
        for c in ok:
            if c.lower() in words:
                return done(c, conf, how)
    for c in ok:
        if ps[c].numeric and named(c, vocab.ALL_TARGETS):
            return done(c, 0.90, "part of the name")
    for c in ok:
        if named(c, vocab.CATEGORICAL_TARGETS):
            return done(c, 0.90, "part of the name")
    hints = filename_hints(filename)
    last = list(ps)[-1] if ps else None
    if last in ok and any(h in segments(last) for h in hints):
        return done(last, 0.95, "name of the file")
    names = list(ps)
    scored = sorted(((score(ps[c], names.index(c), len(names), hints), -names.index(c), c) for c in ok), reverse=True)
    if scored and scored[0][0] > 0:
        s = scored[0][0]
        return done(scored[0][2], 0.95 if s >= 8 else 0.85 if s >= 5 else 0.70 if s >= 3 else 0.50, "score")
    spread = [(ps[c].sd / abs((ps[c].low + ps[c].high) / 2 or 1), c) for c in ok if ps[c].sd]
    if spread:
        return done(max(spread)[1], 0.50, "spread")
    return Target(names[0], 0.30, "first column", task_of(ps[names[0]])) if names else Target(None, 0.0, "none", None)


TWINS = [{"alive", "survived", "dead", "died"}, {"class", "pclass"}, {"total", "sum"}, {"outcome", "result"}]


def leaks(df: DataFrame, target: str, profiles: dict[str, Profile] | None = None) -> dict[str, str]:
    """Columns that give the target away, with the reason: equal or twin columns, near-perfect correlation, and flags that split the classes."""
    ps = profiles or profile(df)
    t = ps[target]
    out: dict[str, str] = {}
    others = [c for c in ps if c != target]
    if not others:
        return out
    same = df.agg(*[F.bool_and(F.col(f"`{c}`").cast("string").eqNullSafe(F.col(f"`{target}`").cast("string"))).alias(f"e{i}") for i, c in enumerate(others)]).first()
    for i, c in enumerate(others):
        if same[f"e{i}"]:
            out[c] = "equal to the target"
        elif any(c.lower() in w and target.lower() in w for w in TWINS):
            out[c] = "another form of the target"
    num = [c for c in others if ps[c].numeric and ps[c].unique > 20 and c not in out]
    if t.numeric and num:
        for r in pairs.pearson_pairs(df, [target, *num]).where((F.col("a") == target) | (F.col("b") == target)).collect():  # a row a column
            if r["r"] is not None and abs(r["r"]) >= 0.999:
                out[r["b"] if r["a"] == target else r["a"]] = "correlated with the target at 0.999 or more"
    for c in [c for c in others if 2 <= ps[c].unique <= 3 and c not in out and t.unique <= 20]:
        x = purity(df, c, target).first()
        if x["n"] >= 50 and x["purity"] >= 0.98 and ps[c].unique >= t.unique:
            out[c] = "its values decide the target"
    return out


def purity(df: DataFrame, flag: str, target: str) -> DataFrame:
    """One row: rows with both, and the share that has the most frequent target of its flag."""
    n = df.where(F.col(f"`{flag}`").isNotNull() & F.col(f"`{target}`").isNotNull()).groupBy(F.col(f"`{flag}`").alias("f"), F.col(f"`{target}`").alias("t")).agg(F.count("*").alias("n"))
    g = n.groupBy("f").agg(F.max("n").alias("top"), F.sum("n").alias("all"))
    return g.agg(F.sum("all").alias("n"), (F.sum("top") / F.sum("all")).alias("purity"))
