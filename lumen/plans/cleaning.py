"""Cleaning: evidence, decisions, actions, validation, and a hash-chained log.

Detectors only read and give evidence; a decision names an action; an action is
a function from frame to frame; validation compares the frame after it with the
one before, and a frame that fails is dropped.  Row counts and null counts come
from one aggregation a step; frames are lazy.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timedelta
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumen import vocab
from lumen.functions import columns as C
from lumen.operators import outliers, rows, select
from lumen.operators.quantiles import numbers, quantile_row, value_counts
from lumen.plans import relations
from lumen.plans.profile import Profile, profile


@dataclass
class Evidence:
    detector: str
    column: str | None
    problem: str
    count: int
    ratio: float
    severity: str = "low"
    facts: dict = field(default_factory=dict)


@dataclass
class Decision:
    evidence: Evidence
    verdict: str  # apply, flag or skip
    action: str | None = None
    params: dict = field(default_factory=dict)
    reason: str = ""


@dataclass
class Policy:
    least_confidence: float = 0.0
    dry_run: bool = False
    impute: bool = True
    remove_duplicates: bool = True
    outlier_flags: bool = True
    threshold: float = 1.5
    content_changes_per_column: int = 1


#: Fixed value: rows from which a table's pair searches are bounded unless a strategy is asked for.
SCALE_ROWS = 100_000


@dataclass(frozen=True)
class Strategy:
    """How far detection goes; None: without bound."""

    name: str = "standard"
    detection: bool = True
    pair_columns: int | None = None
    correlation_rows: int | None = None


def strategy_for(asked: str | Strategy | None, n_rows: int, n_columns: int) -> Strategy:
    """The strategy asked for; without one, ``standard``, or ``scale_guarded`` for tables of many rows."""
    if isinstance(asked, Strategy):
        return asked
    name = asked or ("scale_guarded" if n_rows >= SCALE_ROWS else "standard")
    if name == "standard":
        return Strategy()
    if name == "structure_only":
        return Strategy(name, False, 0, 0)
    if name == "scale_guarded":
        return Strategy(name, True, max(8, min(24, n_columns)), min(n_rows, 5000))
    raise ValueError("strategy is standard, structure_only or scale_guarded")


@dataclass
class Rules:
    """What a caller declares of a table."""

    kinds: dict[str, str] = field(default_factory=dict)
    ranges: dict[str, tuple[float | None, float | None]] = field(default_factory=dict)
    allowed: dict[str, list] = field(default_factory=dict)
    keep_tokens: dict[str, list[str]] = field(default_factory=dict)
    formulas: dict[str, dict] = field(default_factory=dict)
    ordered: list[tuple[str, str]] = field(default_factory=list)


def _level(ratio: float, high: float = 0.5, medium: float = 0.05) -> str:
    return "high" if ratio >= high else "medium" if ratio >= medium else "low"


def _one(df: DataFrame, exprs: dict[str, Column]) -> dict:
    return df.agg(F.count("*").alias("_n"), *[e.alias(k) for k, e in exprs.items()]).first().asDict()


def _strings(ps: dict[str, Profile]) -> list[str]:
    return [c for c, p in ps.items() if p.type == "string"]


# Detectors: (df, profiles, rules) -> evidence.


def detect_missing(df, ps, rules) -> list[Evidence]:
    """Nulls, blanks and tokens of every column, one pass; suppression tokens apart."""
    e = {}
    for i, (c, p) in enumerate(ps.items()):
        col = F.col(f"`{c}`")
        if p.type == "string":
            e[f"m{i}"] = F.count_if(C.missing_like(col, rules.keep_tokens.get(c)))
            e[f"b{i}"] = F.count_if(col.isNotNull() & (C.trim_all(col) == ""))
            e[f"s{i}"] = F.count_if(C.fold_case(col).isin(vocab.SUPPRESSION_TOKENS))
        else:
            e[f"m{i}"] = F.count_if(col.isNull())
    r = _one(df, e)
    n, out = max(r["_n"], 1), []
    for i, (c, p) in enumerate(ps.items()):
        if m := r[f"m{i}"]:
            out.append(Evidence("missing", c, "missing_values", m, m / n, _level(m / n), {"nulls": p.nulls, "blanks": r.get(f"b{i}", 0), "tokens": m - p.nulls - r.get(f"b{i}", 0)}))
        if 0.02 <= r.get(f"s{i}", 0) / n <= 0.35:
            out.append(Evidence("missing", c, "suppressed_values", r[f"s{i}"], r[f"s{i}"] / n, "low"))
    return out


def detect_duplicates(df, ps, rules) -> list[Evidence]:
    cols = [c for c, p in ps.items() if p.semantic != "identifier"]
    if not cols:
        return []
    r = select.duplicate_rows(df, cols).first()
    out = []
    if r["duplicates"]:
        share = r["duplicates"] / r["rows"]
        out.append(Evidence("duplicates", None, "exact_duplicates", r["duplicates"], share, _level(share), {"columns": cols, "largest_group": r["largest_group"]}))
    if _strings({c: ps[c] for c in cols}):
        x = rows.near_duplicates(df, cols).first()
        if x["share"] and x["share"] >= vocab.NEAR_DUPLICATE:
            out.append(Evidence("near_duplicates", None, "near_duplicates", x["extra"], x["share"], "high" if x["share"] >= vocab.NEAR_DUPLICATE_HIGH else "medium"))
    return out


def range_of(name: str) -> tuple[float | None, float | None] | None:
    """The values that a column of this name may have."""
    for words, low, high in (
        (vocab.AGE_NAMES, *vocab.AGE_RANGE), (vocab.PERCENTAGE_NAMES, 0, 100), (vocab.PROBABILITY_NAMES, 0, 1), (vocab.LATITUDE_NAMES, -90, 90), (vocab.LONGITUDE_NAMES, -180, 180),
        (vocab.COUNT_NAMES, 0, None), (vocab.PRICE_NAMES, 0, None),
    ):
        if C.named(name, words):
            return low, high
    return None


def detect_invalid(df, ps, rules) -> list[Evidence]:
    e, why = {}, {}
    for i, (c, p) in enumerate(ps.items()):
        bounds = rules.ranges.get(c) or (range_of(c) if p.numeric and p.semantic != "identifier" else None)
        col, bad = F.col(f"`{c}`"), F.lit(False)
        if bounds and p.numeric:
            bad = bad | (col < bounds[0] if bounds[0] is not None else F.lit(False)) | (col > bounds[1] if bounds[1] is not None else F.lit(False))
        if c in rules.allowed:
            bad = bad | ~col.isin(rules.allowed[c])
        if (bounds and p.numeric) or c in rules.allowed:
            e[f"i{i}"], why[c] = F.count_if(F.coalesce(bad, F.lit(False))), (f"i{i}", {"range": bounds, "allowed": rules.allowed.get(c)})
    r = _one(df, e)
    return [Evidence("invalid", c, "invalid_values", r[k], r[k] / max(r["_n"], 1), _level(r[k] / max(r["_n"], 1)), f) for c, (k, f) in why.items() if r[k]]


def detect_types(df, ps, rules) -> list[Evidence]:
    """Strings that are numbers, amounts or dates, and columns of mixed classes; each distinct value is classified once."""
    use = [c for c in _strings(ps) if ps[c].count and ps[c].semantic != "identifier"]
    if not use:
        return []
    v, kind = F.col("v"), F.col("kind")
    rows_if = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    classes = value_counts(df, {c: F.col(f"`{c}`") for c in use}).withColumn("kind", C.classify_scalar(v)).groupBy("i")
    found = classes.agg(*[rows_if(kind == k).alias(k) for k in ("numeric", "date", "text")], rows_if(C.accounting_number(v).isNotNull()).alias("amounts"), rows_if(C.to_number(v).isNotNull()).alias("plain"))
    seen = {r["i"]: r for r in found.collect()}  # a row a column
    out = []
    for i, c in enumerate(use):
        p, r = ps[c], seen[i]
        n = p.count
        num, date, text = r["numeric"], r["date"], r["text"]
        if r["plain"] == n or r["amounts"] == n and num >= 0.95 * n:
            out.append(Evidence("types", c, "numbers_as_text", n, 1.0, "medium", {"target": "number"}))
        elif date >= 0.95 * n and p.length >= 6:
            out.append(Evidence("types", c, "dates_as_text", date, date / n, "medium", {"target": "date"}))
        else:
            first, second = sorted((num, date, text), reverse=True)[:2]
            if first >= vocab.DOMINANT * n and second and (first >= 0.85 * n or second >= 0.10 * n):
                out.append(Evidence("types", c, "mixed_types", second, second / n, _level(second / n)))
    return out


def detect_formatting(df, ps, rules) -> list[Evidence]:
    e = {}
    for c in _strings(ps):
        col, i = F.col(f"`{c}`"), list(ps).index(c)
        e |= {f"w{i}": F.count_if(col.rlike(r"^\s|\s$|\s{2,}") & (C.trim_all(col) != "")), f"h{i}": F.count_if(col.rlike(C.ENTITY)), f"g{i}": F.count_if(col.rlike(C.TAG)), f"j{i}": F.count_if(col.rlike(C.MOJIBAKE))}
    r = _one(df, e)
    out = []
    for c in _strings(ps):
        i = list(ps).index(c)
        for key, problem in (("w", "whitespace"), ("h", "html_entities"), ("g", "markup"), ("j", "mojibake")):
            if k := r[f"{key}{i}"]:
                out.append(Evidence("formatting" if key == "w" else "encoding", c, problem, k, k / max(r["_n"], 1), "low"))
    return out


#: Variants up to which a mapping of spellings is held as a dict; a larger one stays a frame.
SPELLINGS = 1_000


def detect_spellings(df, ps, rules) -> list[Evidence]:
    """Spellings of categories that differ in case or blanks, or in separators with one that prevails; their ``mapping`` is a frame (v, best) where there are more than ``SPELLINGS``."""
    out = []
    for c in _strings(ps):
        if ps[c].kind != "categorical" or not ps[c].count:
            continue
        v = F.col("v")
        n = df.where(F.col(f"`{c}`").isNotNull()).groupBy(F.col(f"`{c}`").alias("v")).agg(F.count("*").alias("n")).withColumns({"key": C.separator_key(v), "fold": F.lower(C.trim_all(v))})
        g = n.groupBy("key").agg(F.count("*").alias("k"), F.min_by("v", F.struct(-F.col("n"), v)).alias("best"), F.max("n").alias("top"), F.sum("n").alias("all"), (F.min("fold") == F.max("fold")).alias("same")).where("k > 1")
        g = g.where(F.col("same") | (F.col("top") >= vocab.SEPARATOR_DOMINANCE * F.col("all")))
        r = g.agg(F.sum(F.col("k") - 1).alias("variants"), F.sum(F.col("all") - F.col("top")).alias("rows")).first()
        if r["variants"]:
            table = n.join(g.select("key", "best"), "key").where("v <> best").select("v", "best")
            mapping = {x["v"]: x["best"] for x in table.collect()} if r["variants"] <= SPELLINGS else table
            out.append(Evidence("spellings", c, "spelling_variants", r["rows"], r["rows"] / ps[c].count, "low", {"mapping": mapping}))
    return out


def detect_missing_patterns(df, ps, rules) -> list[Evidence]:
    """Columns missing together, and columns missing far more in some category."""
    gaps = [c for c, p in ps.items() if 0 < p.nulls < p.rows]
    pairs = list(combinations(gaps, 2))
    out = []
    if pairs:
        r = _one(df, {f"x{i}": F.count_if(F.col(f"`{a}`").isNull() & F.col(f"`{b}`").isNull()) for i, (a, b) in enumerate(pairs)})
        for i, (a, b) in enumerate(pairs):
            together, n = r[f"x{i}"], r["_n"]
            if together >= vocab.MISSING_SUPPORT and together * n >= vocab.CO_MISSING_LIFT * ps[a].nulls * ps[b].nulls:
                out.append(Evidence("missing_patterns", a, "missing_together", together, together / n, "low", {"with": b}))
    for by in [c for c in _strings(ps) if ps[c].kind == "categorical" and 1 < ps[c].unique <= 50]:
        own = [g for g in gaps if g != by]
        if own:
            x = df.where(F.col(f"`{by}`").isNotNull()).groupBy(F.col(f"`{by}`").alias("g")).agg(F.count("*").alias("n"), *[F.avg(F.col(f"`{g}`").isNull().cast("int")).alias(f"r{i}") for i, g in enumerate(own)])
            for r in x.collect():  # at most 50 categories
                for i, g in enumerate(own):
                    if r["n"] >= vocab.MISSING_SUPPORT and abs(r[f"r{i}"] - ps[g].missing) >= vocab.MISSING_GAP:
                        out.append(Evidence("missing_patterns", g, "missing_by_category", int(r["n"] * r[f"r{i}"]), r[f"r{i}"], "medium", {"by": by, "value": r["g"]}))
    return out


def detect_derived(df, ps, rules) -> list[Evidence]:
    """Columns that are a sum with offset, a product, a text's length or a date's weekday, with the rows that break it; the best relation a column. A vote of sampled rows says which are worth an exact pass."""
    num = [c for c, p in ps.items() if p.numeric and p.semantic != "identifier" and p.sd]
    tried: dict[str, tuple[str, str, dict, Column]] = {}
    for t, kind, of, k in relations.possible(df, num, _strings(ps), vocab.DERIVED_OFFSETS, vocab.DERIVED_SUSPECT):
        own = F.col(f"`{t}`")
        if kind == "length":
            tried[f"l{len(tried)}"] = (t, kind, {"op": "string_length", "source": of[0]}, own == F.char_length(f"`{of[0]}`"))
            continue
        a, b = (F.col(f"`{c}`") for c in of)
        if kind == "product":
            tried[f"p{len(tried)}"] = (t, kind, {"op": kind, "sources": of}, F.abs(own - a * b) <= 1e-6)
        elif sum(ps[c].low for c in of) + k <= ps[t].high and sum(ps[c].high for c in of) + k >= ps[t].low:
            tried[f"s{len(tried)}"] = (t, kind, {"op": "sum_offset", "sources": of, "offset": k}, F.abs(own - (a + b + k)) <= 1e-9)
    for t in [c for c in ps if C.named(c, vocab.WEEKDAY_NAMES)]:
        for c in [c for c, p in ps.items() if p.type.startswith(("timestamp", "date"))]:
            numbers = ps[t].numeric
            tried[f"w{len(tried)}"] = (t, "weekday", {"op": "day_of_week", "source": c, "numbers": numbers}, F.col(f"`{t}`") == (C.iso_weekday(F.col(f"`{c}`")) if numbers else C.day_name(F.col(f"`{c}`"))))
    for t, p in rules.formulas.items():
        tried[f"f{len(tried)}"] = (t, "declared", p, F.col(f"`{t}`") == C.derived(p["op"], **{k: v for k, v in p.items() if k != "op"}))
    best: dict[str, Evidence] = {}
    names = list(tried)
    for at in range(0, len(names), 200):  # expressions of one pass
        part = names[at : at + 200]
        r = _one(df, {f"{k}_ok": F.count_if(F.coalesce(tried[k][3], F.lit(False))) for k in part} | {f"{k}_n": F.count(tried[k][3]) for k in part} | {f"{k}_z": F.count_if(F.col(f"`{tried[k][0]}`").cast("double") != 0) for k in part})
        for k in part:
            t, kind, p, _ = tried[k]
            ok, n = r[f"{k}_ok"], r[f"{k}_n"]
            if n < vocab.DERIVED_ROWS or ok < vocab.DERIVED_SUSPECT * n or ok == n and kind != "declared" and t in best:
                continue
            if kind == "product" and (ok < vocab.PRODUCT_SHARE * n or r[f"{k}_z"] < vocab.PRODUCT_NONZERO * n):
                continue
            if t not in best or ok / n > best[t].facts["coverage"]:
                best[t] = Evidence("derived", t, "derived_violations", n - ok, (n - ok) / n, "medium" if ok >= vocab.DERIVED_SURE * n else "low", {"coverage": ok / n, "formula": p})
    return [e for e in best.values() if e.count]


def detect_constraints(df, ps, rules) -> list[Evidence]:
    """Pairs that should be in order, and ages that do not fit a count of children."""
    pairs = list(rules.ordered)
    for low, high in vocab.ORDERED_PAIRS:
        for a in ps:
            b = next((x for x in ps if x != a and C.segments(x) == [s.replace(low, high) if s == low else s for s in C.segments(a)] and low in C.segments(a)), None)
            if b and ps[a].type == ps[b].type and (a, b) not in pairs:
                pairs.append((a, b))
    if not pairs:
        return []
    r = _one(df, {f"x{i}": F.count_if(F.col(f"`{a}`") > F.col(f"`{b}`")) for i, (a, b) in enumerate(pairs)})
    return [Evidence("constraints", a, "order_violations", r[f"x{i}"], r[f"x{i}"] / max(r["_n"], 1), "high" if r[f"x{i}"] > 0.02 * r["_n"] else "medium", {"not_after": b}) for i, (a, b) in enumerate(pairs) if r[f"x{i}"]]


def detect_plausibility(df, ps, rules) -> list[Evidence]:
    """Ages below 16 together with counts of three or more: rare, not wrong."""
    ages = [c for c, p in ps.items() if p.numeric and p.semantic != "identifier" and C.named(c, vocab.AGE_NAMES)]
    counts = [c for c, p in ps.items() if p.numeric and p.semantic != "identifier" and C.named(c, vocab.COUNT_NAMES)]
    both = [(a, b) for a in ages for b in counts if a != b]
    r = _one(df, {f"x{i}": F.count_if((F.col(f"`{a}`") < vocab.PLAUSIBLE_AGE) & (F.col(f"`{b}`") >= vocab.PLAUSIBLE_COUNT)) for i, (a, b) in enumerate(both)})
    return [Evidence("plausibility", a, "age_and_count", r[f"x{i}"], r[f"x{i}"] / max(r["_n"], 1), "low", {"with": b}) for i, (a, b) in enumerate(both) if r[f"x{i}"]]


def detect_disconnected(df, ps, rules) -> list[Evidence]:
    """A score or index that has no rank correlation with any column of its own prefix, while these have some with each other; over the rows that have all of them."""
    from lumen.operators.importance import spearman_pairs

    tokens = {c: C.segments(c) for c, p in ps.items() if p.numeric and p.kind == "numeric"}
    out = []
    for c, words in tokens.items():
        parts = [x for x, w in tokens.items() if x != c and len(w) >= len(words) and w[: len(words) - 1] == words[:-1]]
        if len(words) < 2 or words[-1] not in vocab.AGGREGATE_NAMES or len(parts) < 2:
            continue
        whole = df.select(*[F.col(f"`{x}`").cast("double").alias(x) for x in [c, *parts]]).dropna()
        found = spearman_pairs(whole, [c, *parts]).collect()  # a row a pair of the prefix's columns
        n = found[0]["n"] if found else 0
        own = [abs(r["r"]) if r["r"] is not None else None for r in found if c in (r["a"], r["b"])]
        among = [abs(r["r"]) for r in found if c not in (r["a"], r["b"]) and r["r"] is not None]
        if n >= vocab.SEMANTIC_ROWS and None not in own and among and max(own) < max(vocab.NO_RELATION, 2 / n**0.5) and sum(among) / len(among) >= vocab.MUTUAL:
            out.append(Evidence("disconnected", c, "unrelated_to_its_parts", n, 1.0, "medium", {"parts": parts, "largest": round(max(own), 4), "mutual": round(sum(among) / len(among), 4)}))
    return out


def detect_bleed(df, ps, rules) -> list[Evidence]:
    """Field delimiters within text that is otherwise numbers: columns may have shifted. Two in a hundred block; prose with commas is a flag only."""
    cols = [c for c in _strings(ps) if ps[c].semantic in ("numeric", "categorical", "boolean") and ps[c].count]
    e = {}
    for i, c in enumerate(cols):
        col = F.col(f"`{c}`")
        hit = col.rlike(r"[,;|\t]")
        e |= {f"b{i}": F.count_if(hit), f"n{i}": F.count_if(~hit & col.rlike(r"^[+-]?\d+(\.\d+)?$"))}
    r = _one(df, e)
    out = []
    for i, c in enumerate(cols):
        if k := r[f"b{i}"]:
            share, rest = k / ps[c].count, ps[c].count - k
            numbers = ps[c].semantic in ("numeric", "boolean") or rest and r[f"n{i}"] >= 0.90 * rest
            out.append(Evidence("structure", c, "delimiter_bleed", k, share, "block" if numbers and share >= 0.02 else "low", {"numbers": bool(numbers)}))
    return out


def detect_times(df, ps, rules, now: datetime | None = None) -> list[Evidence]:
    late = (now or datetime.now()) + timedelta(days=1)
    cols = [c for c, p in ps.items() if p.type.startswith(("timestamp", "date"))]
    r = _one(df, {f"x{i}": F.count_if((F.col(f"`{c}`") > F.lit(late)) | (F.year(f"`{c}`") < 1900)) for i, c in enumerate(cols)})
    return [Evidence("times", c, "implausible_times", r[f"x{i}"], r[f"x{i}"] / max(r["_n"], 1)) for i, c in enumerate(cols) if r[f"x{i}"]]


def detect_units(df, ps, rules) -> list[Evidence]:
    """Positive values in two clusters two orders of magnitude apart."""
    out = []
    for c in [c for c, p in ps.items() if p.numeric and p.kind == "numeric" and not p.ordinal and (p.high or 0) > 0 and p.low is not None and p.high / max(p.low, 1e-12) >= 100]:
        v = df.where(F.col(f"`{c}`") > 0).select(F.log10(F.col(f"`{c}`").cast("double")).alias("v"))
        m = quantile_row(v, numbers(["v"]), [0.5]).select(F.col("q0")[0].alias("m"))
        r = v.join(F.broadcast(m)).agg(F.max(F.when(F.col("v") <= F.col("m"), F.col("v"))).alias("a"), F.min(F.when(F.col("v") > F.col("m"), F.col("v"))).alias("b"), F.count_if(F.col("v") > F.col("m")).alias("up"), F.count("*").alias("n")).first()  # one row
        few = min(r["up"], r["n"] - r["up"])
        if r["b"] is not None and r["b"] - r["a"] >= vocab.UNIT_GAP and few >= vocab.UNIT_LEAST and few >= vocab.UNIT_SHARE * r["n"]:
            out.append(Evidence("units", c, "mixed_units", few, few / r["n"], "medium", {"orders": r["b"] - r["a"]}))
    return out


def detect_outliers(df, ps, rules, k: float = 1.5) -> list[Evidence]:
    cols = [c for c, p in ps.items() if p.kind == "numeric" and not p.ordinal and p.sd]
    found = outliers.outliers(df, cols, k=k).collect() if cols else []
    return [Evidence("outliers", r["column"], "outliers", r["outliers"], r["percentage"] / 100, r["severity"], {"lower": r["lower"], "upper": r["upper"], "mad_share": r["mad_share"]}) for r in found if r["outliers"] and r["percentage"] <= 20]


def detect_repeats(df, ps, rules) -> list[Evidence]:
    """A text column where one value makes up half of the rows."""
    out = []
    for c in [c for c in _strings(ps) if ps[c].unique >= 10]:
        r = df.where(F.col(f"`{c}`").isNotNull()).groupBy(C.fold_case(C.collapse(F.col(f"`{c}`"))).alias("v")).agg(F.count("*").alias("n")).agg(F.max("n").alias("top")).first()
        if r["top"] >= 0.5 * ps[c].count:
            out.append(Evidence("repeats", c, "repeated_text", r["top"], r["top"] / ps[c].count))
    return out


def detect_lists(df, ps, rules) -> list[Evidence]:
    """Cells that hold several values; not among the default detectors."""
    e = {f"{d}{i}": F.count_if(F.size(C.split_values(F.col(f"`{c}`"), d)) > 1) for i, c in enumerate(_strings(ps)) for d in ";|,/"}
    r = _one(df, e)
    out = []
    for i, c in enumerate(_strings(ps)):
        d = max(";|,/", key=lambda d: r[f"{d}{i}"])  # noqa: B023
        if ps[c].count and r[f"{d}{i}"] >= 0.10 * ps[c].count:
            out.append(Evidence("lists", c, "several_values", r[f"{d}{i}"], r[f"{d}{i}"] / ps[c].count, "low", {"delimiter": d}))
    return out


def detect_structure(df, ps, rules) -> list[Evidence]:
    """Faults of the table itself: unnamed and empty columns, sentinels as text, cut-off values, damaged identifiers."""
    out = []
    unnamed = [c for c in ps if not c.strip() or c.lower().startswith("unnamed")]
    if unnamed:
        share = len(unnamed) / len(ps)
        out.append(Evidence("structure", None, "unnamed_columns", len(unnamed), share, "block" if share >= 0.25 else "low", {"columns": unnamed}))
    out += [Evidence("structure", c, "empty_column", p.rows, 1.0) for c, p in ps.items() if p.rows and not p.count]
    out += [Evidence("structure", c, "constant_column", p.count, 1.0) for c, p in ps.items() if p.constant]
    e = {}
    for i, c in enumerate(_strings(ps)):
        col = F.col(f"`{c}`")
        e |= {f"s{i}": F.count_if(C.fold_case(col).isin(vocab.SENTINELS)), f"x{i}": F.max(F.char_length(col)), f"q{i}": F.count_if(col.rlike(r"[,;|\t\"]|\s{2,}")), f"f{i}": F.count_if(col.rlike("^[0-9]+$"))}
    r = _one(df, e)
    longest = _one(df, {f"t{i}": F.count_if(F.char_length(f"`{c}`") == (r[f"x{i}"] or -1)) for i, c in enumerate(_strings(ps))})
    for i, c in enumerate(_strings(ps)):
        p = ps[c]
        if not p.count:
            continue
        if r[f"s{i}"] >= 0.05 * p.count and p.unique > 5:
            out.append(Evidence("structure", c, "sentinels", r[f"s{i}"], r[f"s{i}"] / p.count))
        if (r[f"x{i}"] or 0) >= 8 and p.count >= 20 and p.unique >= 10 and longest[f"t{i}"] >= 0.15 * p.count and p.semantic != "identifier":
            out.append(Evidence("structure", c, "cut_off", longest[f"t{i}"], longest[f"t{i}"] / p.count))
        if p.semantic == "identifier" and p.subtype is None:
            odd = p.count - r[f"f{i}"] if r[f"f{i}"] >= 0.95 * p.count else r[f"q{i}"]
            if odd >= 3 or odd and odd >= 0.02 * p.count:
                out.append(Evidence("structure", c, "damaged_identifiers", odd, odd / p.count, "block"))
    return out


DETECTORS: dict[str, Callable] = {
    "structure": detect_structure, "missing": detect_missing, "duplicates": detect_duplicates, "invalid": detect_invalid, "types": detect_types, "formatting": detect_formatting, "spellings": detect_spellings,
    "missing_patterns": detect_missing_patterns, "derived": detect_derived, "constraints": detect_constraints, "plausibility": detect_plausibility, "disconnected": detect_disconnected, "bleed": detect_bleed, "times": detect_times, "units": detect_units, "repeats": detect_repeats, "outliers": detect_outliers,
}


# Decisions.


def decide(e: Evidence, df: DataFrame, ps: dict[str, Profile], policy: Policy) -> Decision:
    """What to do about evidence; changes that lose information or rest on a guess are flags."""
    p = ps.get(e.column) if e.column else None
    flag = lambda why: Decision(e, "flag", None, {}, why)
    do = lambda action, why, **params: Decision(e, "apply", action, params, why)
    if e.problem == "missing_values":
        if not policy.impute or p.kind in ("identifier", "text") or p.semantic in ("identifier", "datetime", "boolean", "text"):
            return flag("no fill for this kind")
        present = p.rows - e.count
        if p.numeric:
            if p.unique == 1 and present:
                return do("fill", "only one value", value=p.low)
            if e.ratio <= vocab.FILL_LIMIT and present >= vocab.FILL_LEAST:
                median = quantile_row(df, numbers([e.column]), [0.5]).first()["q0"][0]
                return do("fill", "median of a mostly present column", value=median)
            return flag("too much is missing")
        if e.ratio >= vocab.DROP_SHARE:
            return do("drop_column", "half or more is missing")
        top = df.where(~C.missing_like(F.col(f"`{e.column}`"))).groupBy(F.col(f"`{e.column}`").alias("v")).count().orderBy(F.desc("count"), "v").first()
        if e.facts["tokens"] * 2 >= e.count:
            return do("fill", "mostly tokens", value=vocab.UNKNOWN)
        if top and (e.ratio <= vocab.FILL_LIMIT or top["count"] >= vocab.DOMINANT * present):
            return do("fill", "most frequent value", value=top["v"])
        return flag("no value prevails")
    if e.problem == "exact_duplicates":
        return do("remove_duplicates", "equal rows", columns=e.facts["columns"]) if policy.remove_duplicates else flag("duplicates are kept")
    if e.problem == "outliers":
        return do("flag_outliers", "annotation only", lower=e.facts["lower"], upper=e.facts["upper"]) if policy.outlier_flags else flag("outliers")
    if e.problem == "numbers_as_text":
        return do("to_number", "no value is lost")
    if e.problem == "dates_as_text":
        return do("to_date", "almost all parse")
    if e.problem == "spelling_variants":
        return do("map_values", "same words", mapping=e.facts["mapping"])
    if e.problem == "whitespace":
        if p.kind == "categorical" and not p.constant:
            return Decision(e, "skip", None, {}, "left to the spellings")
        return do("trim", "blanks only")
    if e.problem == "html_entities" and p.kind in ("text", "categorical"):
        return do("unescape", "entities")
    if e.problem == "derived_violations" and e.facts["coverage"] >= vocab.DERIVED_SURE:
        return do("recompute", "the formula holds nearly everywhere", formula=e.facts["formula"])
    return flag("for a person to judge")


# Actions: (df, column, params, order) -> df.


def _fill(df, c, p, order):
    value = F.lit(p["value"])
    if not isinstance(df.schema[c].dataType, T.StringType):
        df = df.withColumn(c, F.col(f"`{c}`").cast("double")) if isinstance(df.schema[c].dataType, T.IntegralType) else df
        return df.withColumn(c, F.when(F.col(f"`{c}`").isNull(), value.cast(df.schema[c].dataType)).otherwise(F.col(f"`{c}`")))
    return df.withColumn(c, F.when(C.missing_like(F.col(f"`{c}`")), value).otherwise(F.col(f"`{c}`")))


def _flag_outliers(df, c, p, order):
    hit = (F.col(f"`{c}`") < p["lower"]) | (F.col(f"`{c}`") > p["upper"])
    return df.withColumn(f"{c}_OutlierFlag", F.coalesce(hit, F.lit(False)).cast("tinyint"))


def _recompute(df, c, p, order):
    f = p["formula"]
    v = C.derived(f["op"], **{k: x for k, x in f.items() if k != "op"})
    return df.withColumn(c, F.when(v.isNotNull(), v.cast(df.schema[c].dataType)).otherwise(F.col(f"`{c}`")))


ACTIONS: dict[str, Callable] = {
    "fill": _fill,
    "drop_column": lambda df, c, p, order: df.drop(c),
    "remove_duplicates": lambda df, c, p, order: rows.keep_first(df, p["columns"], order),
    "flag_outliers": _flag_outliers,
    "to_number": lambda df, c, p, order: df.withColumn(c, C.accounting_number(F.col(f"`{c}`"))),
    "to_date": lambda df, c, p, order: df.withColumn(c, C.parse_datetime(F.col(f"`{c}`"))),
    "map_values": lambda df, c, p, order: rows.apply_mapping(df, c, p["mapping"]),
    "trim": lambda df, c, p, order: df.withColumn(c, C.collapse(C.trim_all(F.col(f"`{c}`")))),
    "unescape": lambda df, c, p, order: df.withColumn(c, C.html_unescape(F.col(f"`{c}`"))),
    "recompute": _recompute,
    "null_values": lambda df, c, p, order: rows.null_where_in(df, c, p["values"]),
}
def null_island(df: DataFrame, latitude: str, longitude: str, values: list[float] | None = None) -> DataFrame:
    """df with null coordinates where both are zero, or where one is a declared value that stands for none."""
    a, b = F.col(f"`{latitude}`"), F.col(f"`{longitude}`")
    gone = F.coalesce((a == 0) & (b == 0), F.lit(False))
    for v in values or []:
        gone = gone | F.coalesce((a == v) | (b == v), F.lit(False))
    return df.withColumns({latitude: F.when(~gone, a), longitude: F.when(~gone, b)})


@dataclass(frozen=True)
class Spec:
    """What an action may do: change content, annotate, remove rows, or change the schema."""

    kind: str
    scope: str = "column"


SPECS = {
    **{k: Spec("content") for k in ("fill", "to_number", "to_date", "map_values", "trim", "unescape", "recompute", "null_values")},
    "drop_column": Spec("schema"), "remove_duplicates": Spec("row_removal", "table"), "flag_outliers": Spec("annotation"),
}


CONTENT = {"fill", "to_number", "to_date", "map_values", "trim", "unescape", "recompute", "null_values"}


def register_action(name: str, f: Callable, content: bool = True, spec: Spec | None = None) -> None:
    """Makes f(df, column, params, order) available to decisions."""
    ACTIONS[name] = f
    SPECS[name] = spec or Spec("content" if content else "annotation")
    if content:
        CONTENT.add(name)


# Expectations: what an action's column should be, written apart from the action: (column, params) -> SQL, or a function from frame to frame.


def _text(v: object) -> str:
    return "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"


def _expected_fill(df, c, p, order):
    number = not isinstance(df.schema[c].dataType, T.StringType)
    tokens = ", ".join(_text(x) for x in vocab.MISSING_TOKENS)
    gap = f"`{c}` is null" if number else f"`{c}` is null or trim(regexp_replace(`{c}`, '\\\\s+', ' ')) = '' or lower(trim(regexp_replace(`{c}`, '\\\\s+', ' '))) in ({tokens})"
    kind = "double" if isinstance(df.schema[c].dataType, T.IntegralType) else df.schema[c].dataType.simpleString()
    return df.withColumn(c, F.expr(f"cast(if({gap}, {repr(float(p['value'])) + 'D' if number else _text(p['value'])}, `{c}`) as {kind})"))


def _expected_map(df, c, p, order):
    if isinstance(p["mapping"], DataFrame):
        m = p["mapping"].select(F.col("v").alias("_v"), F.col("best").alias("_best"))
        hit = df.join(m, F.col(f"`{c}`") == F.col("_v")).withColumn(c, F.col("_best")).drop("_v", "_best")
        return hit.unionByName(df.join(m, F.col(f"`{c}`") == F.col("_v"), "left_anti"))
    if not p["mapping"]:
        return df
    whens = " ".join(f"when {_text(k)} then {_text(v)}" for k, v in p["mapping"].items())
    return df.withColumn(c, F.expr(f"case `{c}` {whens} else `{c}` end"))


def _expected_recompute(df, c, p, order):
    f = p["formula"]
    if f["op"] == "string_length":
        v = f"length(`{f['source']}`)"
    elif f["op"] == "day_of_week":
        v = f"weekday(`{f['source']}`) + 1" if f.get("numbers") else f"date_format(`{f['source']}`, 'EEEE')"
    else:
        v = (" * " if f["op"] == "product" else " + ").join(f"`{x}`" for x in f["sources"]) + (f" + {f.get('offset', 0)}" if f["op"] == "sum_offset" else "")
    return df.withColumn(c, F.expr(f"cast(coalesce({v}, `{c}`) as {df.schema[c].dataType.simpleString()})"))


def _expected_number(df, c, p, order):
    bare = rf"regexp_replace(`{c}`, '[$€£¥,%\\s]', '')"
    value = rf"if({bare} like '(%)', '-' || substring({bare}, 2, length({bare}) - 2), {bare})"
    return df.withColumn(c, F.expr(f"nullif(try_cast({value} as double), double('NaN'))"))


def _expected_date(df, c, p, order):
    from lumen.functions.columns import DATE_FORMATS

    text = rf"regexp_replace(`{c}`, '^\\s+|\\s+$', '')"
    ways = " ".join(f"when try_to_timestamp({text}, {_text(f)}) is not null then try_to_timestamp({text}, {_text(f)})" for f in DATE_FORMATS)
    return df.withColumn(c, F.expr(f"case {ways} end"))


def _expected_rows(df, c, p, order):
    firsts = df.groupBy(*[F.col(f"`{x}`") for x in p["columns"]]).agg(F.min(f"`{order}`").alias("_first")).select("_first")
    return df.join(firsts, F.col(f"`{order}`") == F.col("_first"), "left_semi")


EXPECTED: dict[str, Callable] = {
    "remove_duplicates": _expected_rows,
    "to_number": _expected_number,
    "to_date": _expected_date,
    "fill": _expected_fill,
    "map_values": _expected_map,
    "recompute": _expected_recompute,
    "trim": lambda df, c, p, order: df.withColumn(c, F.expr(rf"regexp_replace(regexp_replace(`{c}`, '^\\s+|\\s+$', ''), '\\s+', ' ')")),
    "drop_column": lambda df, c, p, order: df.select(*[F.col(f"`{x}`") for x in df.columns if x != c]),
    "flag_outliers": lambda df, c, p, order: df.withColumn(f"{c}_OutlierFlag", F.expr(f"cast(if(`{c}` not between {p['lower']!r}D and {p['upper']!r}D, 1, 0) as tinyint)")),
    "null_values": lambda df, c, p, order: df.withColumn(c, F.when(~F.coalesce(F.col(f"`{c}`").isin(p["values"]), F.lit(False)), F.col(f"`{c}`"))),
}


def register_expectation(name: str, f: Callable) -> None:
    """Makes f(df, column, params, order), the frame that an action should give, part of validation."""
    EXPECTED[name] = f


def digests(df: DataFrame, order: str) -> dict:
    """Of each column a digest of its cells with their rows' keys, one pass; equal frames have equal ones whatever the order of rows."""
    cells = [F.sum(F.xxhash64(F.col(f"`{order}`").cast("string"), F.lit(c), F.col(f"`{c}`").isNull(), F.col(f"`{c}`").cast("string")).cast("decimal(38,0)")).alias(f"d{i}") for i, c in enumerate(df.columns)]
    r = df.agg(F.count("*").alias("n"), *cells).first()
    return {"": r["n"]} | {c: r[f"d{i}"] for i, c in enumerate(df.columns)}


def unexpected(before: DataFrame, after: DataFrame, d: Decision, order: str) -> list[str]:
    """Columns of ``after`` that are not what the action's expectation makes of ``before``; without an expectation, columns other than its own that changed."""
    c = d.evidence.column
    f = EXPECTED.get(d.action)
    if f is None and SPECS.get(d.action, Spec("content")).kind == "row_removal":
        return []
    want, got = digests(f(before, c, d.params, order) if f else before, order), digests(after, order)
    free = set() if f else {c, f"{c}_OutlierFlag"}
    return [f"cells of {x or 'the table'} are not as expected" for x in {**want, **got} if x not in free and want.get(x) != got.get(x)]


def ledger(before: DataFrame, after: DataFrame, column: str, order: str, n: int = 100) -> DataFrame:
    """The first n changed cells of a column by row key: key, before, after."""
    a = before.select(F.col(f"`{order}`").alias("key"), F.col(f"`{column}`").cast("string").alias("before"))
    b = after.select(F.col(f"`{order}`").alias("_key"), F.col(f"`{column}`").cast("string").alias("after"))
    return a.join(b, F.col("key") == F.col("_key")).where(~F.col("before").eqNullSafe(F.col("after"))).select("key", "before", "after").orderBy("key").limit(n)


def cut(df: DataFrame) -> DataFrame:
    """df from a checkpoint, so that plans stay short; df itself where the session names no folder for them."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df


def state(df: DataFrame) -> dict:
    """Rows and nulls of each column, one pass."""
    r = df.agg(F.count("*").alias("_n"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"m{i}") for i, c in enumerate(df.columns)]).first()
    return {"rows": r["_n"], "columns": list(df.columns), "nulls": {c: r[f"m{i}"] for i, c in enumerate(df.columns)}}


def validate(before: dict, after: dict, d: Decision) -> list[str]:
    """What is wrong with the state after a decision's action; nothing if it did what it should and no more."""
    c, bad = d.evidence.column, []
    want = [x for x in before["columns"] if not (d.action == "drop_column" and x == c)] + ([f"{c}_OutlierFlag"] if d.action == "flag_outliers" else [])
    if sorted(want) != sorted(after["columns"]):
        bad.append("columns changed otherwise than meant")
    if d.action == "remove_duplicates":
        if before["rows"] - after["rows"] != d.evidence.count:
            bad.append("not as many rows went as were found")
    elif before["rows"] != after["rows"]:
        bad.append("rows changed")
    else:
        for x in before["columns"]:
            if x != c and x in after["nulls"] and after["nulls"][x] != before["nulls"][x]:
                bad.append(f"nulls of {x} changed")
        if d.action == "fill" and after["nulls"].get(c, 0):
            bad.append("gaps are left")
        if d.action in ("to_number", "to_date", "map_values", "trim", "unescape") and after["nulls"].get(c, 0) > before["nulls"][c]:
            bad.append("values were lost")
    return bad


def chain(entries: list[dict]) -> list[dict]:
    """Entries with the hash of each over itself and the hash before; 64 zeros at the start."""
    last, out = "0" * 64, []
    for e in entries:
        body = {**e, "prev_hash": last}
        last = hashlib.sha256(json.dumps(body, sort_keys=True, default=str).encode()).hexdigest()
        out.append({**body, "entry_hash": last})
    return out


def verify(entries: list[dict]) -> bool:
    return chain([{k: v for k, v in e.items() if k not in ("prev_hash", "entry_hash")} for e in entries]) == entries


@dataclass
class Result:
    df: DataFrame
    assessment: str
    decisions: list[Decision]
    log: list[dict]
    warnings: list[str]
    before: dict
    after: dict


class Cleaner:
    """Runs detectors, decisions and actions over a frame that has a unique ``order`` column."""

    def __init__(self, rules: Rules | None = None, policy: Policy | None = None, detectors: dict[str, Callable] | None = None, strategy: str | Strategy | None = "standard"):
        self.rules, self.policy, self.detectors, self.strategy = rules or Rules(), policy or Policy(), detectors or DETECTORS, strategy

    def evidence(self, df: DataFrame) -> tuple[dict[str, Profile], list[Evidence]]:
        """Profiles and findings; a strategy that bounds pairs leaves the later columns out of their search, and says which."""
        ps = profile(df)
        n = max((p.rows for p in ps.values()), default=0)
        s = strategy_for(self.strategy, n, len(ps))
        found = []
        for name, f in self.detectors.items():
            if not s.detection and name not in ("structure", "bleed"):
                continue
            use = ps
            if s.pair_columns is not None and name in ("derived", "missing_patterns"):
                use = dict(list(ps.items())[: s.pair_columns])
                if left := [c for c in ps if c not in use]:
                    found.append(Evidence(name, None, "columns_left_out", len(left), len(left) / len(ps), "low", {"columns": left}))
            found += f(df, use, self.rules)
        return ps, found

    def run(self, df: DataFrame, order: str) -> Result:
        body = [c for c in df.columns if c != order]
        if len({c.lower() for c in df.columns}) != len(df.columns):
            raise ValueError("column names repeat")
        ps, found = self.evidence(df.select(*[F.col(f"`{c}`") for c in body]))
        first = now = state(df)
        decisions, log, warnings, changed = [], [], [], {}
        if any(e.severity == "block" for e in found):
            flags = [Decision(e, "flag", None, {}, "the table is damaged") for e in found]
            return Result(df, "BLOCKED", flags, [], [e.problem for e in found if e.severity == "block"], first, first)
        rank = {"remove_duplicates": 0, "drop_column": 1, "to_number": 2, "to_date": 2, "unescape": 3, "trim": 3, "map_values": 4, "recompute": 5, "fill": 6, "flag_outliers": 7}
        for d in sorted((decide(e, df, ps, self.policy) for e in found), key=lambda d: rank.get(d.action or "", 9)):
            c = d.evidence.column
            if d.verdict == "apply" and d.action in CONTENT:
                if changed.get(c, 0) >= self.policy.content_changes_per_column and d.action != "fill":
                    d.verdict, d.reason = "flag", "the column was changed before"
                changed[c] = changed.get(c, 0) + 1
            if d.verdict == "apply" and not self.policy.dry_run and (c is None or c in df.columns):
                after_df = cut(ACTIONS[d.action](df, c, d.params, order))  # read twice by its validation
                after = state(after_df)
                wrong = validate(now, after, d) + unexpected(df, after_df, d, order)
                log.append({"action": d.action, "column": c, "count": d.evidence.count, "valid": not wrong, "rows_before": now["rows"], "rows_after": after["rows"]})
                if wrong:
                    warnings += wrong
                    d.verdict = "rolled_back"
                else:
                    if d.action == "fill" and d.evidence.ratio >= 0.20:
                        warnings.append(f"{c}: a fifth or more of the values are filled in")
                    df, now = after_df, after
            decisions.append(d)
        applied = any(d.verdict == "apply" for d in decisions)
        verdict = "CLEANED_WITH_WARNINGS" if warnings else "CLEANED" if applied else "FLAGGED" if decisions else "CLEAN"
        return Result(df, verdict, decisions, chain(log), warnings, first, now)


#: Fixed value: names of columns of counts that are whole numbers by nature.
WHOLE = ["age", "sibsp", "parch", "family_size", "ticket_count", "cabincount"]


def optimise_types(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """df with columns of whole numbers by name as longs and text that is numbers (98 % or more, none lost) as doubles; and what changed."""
    kinds = {f.name: f.dataType for f in df.schema}
    floats = [c for c, t in kinds.items() if isinstance(t, (T.DoubleType, T.FloatType)) and c.lower().replace(" ", "_") in WHOLE]
    texts = [c for c, t in kinds.items() if isinstance(t, T.StringType)]
    r = _one(df, {f"f{i}": F.bool_and(C.integer_like(F.col(f"`{c}`"))) for i, c in enumerate(floats)} | {f"t{i}": F.count(f"`{c}`") for i, c in enumerate(texts)} | {f"n{i}": F.count(C.to_number(F.col(f"`{c}`"))) for i, c in enumerate(texts)})
    to = {c: "bigint" for i, c in enumerate(floats) if r[f"f{i}"]} | {c: "double" for i, c in enumerate(texts) if r[f"t{i}"] and r[f"n{i}"] == r[f"t{i}"]}
    return df.withColumns({c: C.to_number(F.col(f"`{c}`")) if k == "double" else F.col(f"`{c}`").cast(k) for c, k in to.items()}) if to else df, to


@dataclass
class Cleaned:
    df: DataFrame
    result: Result
    types: dict[str, str]
    report: dict


def clean_table(df: DataFrame, order: str, rules: Rules | None = None, impute: bool = True, outlier_flags: bool = True, types: bool = True, threshold: float = 1.5, strategy: str | None = "standard") -> Cleaned:
    """Cleaning as one call: detection, decisions and validated actions, then narrower types, and a report of plain values."""
    policy = Policy(impute=impute, outlier_flags=outlier_flags, threshold=threshold)
    r = Cleaner(rules, policy, strategy=strategy).run(df, order)
    out, to = optimise_types(r.df) if types and r.assessment != "BLOCKED" else (r.df, {})
    applied = [{"action": d.action, "column": d.evidence.column, "count": d.evidence.count, "reason": d.reason} for d in r.decisions if d.verdict == "apply"]
    flagged = [{"problem": d.evidence.problem, "column": d.evidence.column, "count": d.evidence.count} for d in r.decisions if d.verdict == "flag"]
    return Cleaned(out, r, to, {"assessment": r.assessment, "rows": (r.before["rows"], r.after["rows"]), "applied": applied, "flagged": flagged, "types": to, "warnings": r.warnings})
