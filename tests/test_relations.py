import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumen import vocab
from lumen.plans import cleaning, features, insights, relations
from lumen.plans.profile import profile


def plain(x, numeric, t, least):
    """All relations of column t, one by one, over all rows."""
    out = []
    for a, b in combinations([c for c in range(numeric) if c != t], 2):
        cols = x[:, [t, a, b]]
        cols = cols[~np.isnan(cols).any(axis=1)]
        for k, offset in enumerate(vocab.DERIVED_OFFSETS):
            if (abs(cols[:, 0] - cols[:, 1] - cols[:, 2] - offset) <= 1e-9).sum() >= least * len(cols):
                out.append((t, a, b, 0, k))
        if (abs(cols[:, 0] - cols[:, 1] * cols[:, 2]) <= 1e-6).sum() >= least * len(cols):
            out.append((t, a, b, 1, 0))
    for c in range(numeric, x.shape[1]):
        cols = x[:, [t, c]]
        cols = cols[~np.isnan(cols).any(axis=1)]
        if (cols[:, 0] == cols[:, 1]).sum() >= least * len(cols):
            out.append((t, c, -1, 2, 0))
    return sorted(out)


def table(rows, seed):
    r = np.random.default_rng(seed)
    x = r.integers(0, 50, (rows, 7)).astype("float64") / 4
    x[:, 4] = x[:, 0] + x[:, 1] + 2
    x[:, 5] = x[:, 2] * x[:, 3]
    x[:, 6] = x[:, 3]
    x[r.random(rows) < 0.08, 4] = 999
    x[r.random((rows, 7)) < 0.05] = np.nan
    return x


@pytest.mark.parametrize("rows", [0, 1, 40, 700, 3000])
def test_the_vote_of_a_whole_table_is_exact(rows):
    x = table(rows, rows)
    for t in range(6):
        assert relations.for_target(x, 6, t, vocab.DERIVED_OFFSETS, 0.9) == plain(x, 6, t, 0.9)


def test_a_sample_rules_out_nothing_that_counts():
    for seed in range(5):
        x = table(60_000, seed)
        want = {r for t in range(6) for r in plain(x, 6, t, 0.9)}
        pick = np.random.default_rng(seed).permutation(len(x))[: relations.ROWS]
        got = {r for t in range(6) for r in relations.for_target(x[pick], 6, t, vocab.DERIVED_OFFSETS, 0.9)}
        assert want <= got and len(got) <= len(want) + 4


def test_many_columns_take_few_passes(spark, monkeypatch):
    cols = [((F.xxhash64("id", F.lit(i)) % 100_000) / 8).alias(f"c{i}") for i in range(60)]
    df = spark.range(6000).select(*cols).withColumn("total", F.col("c3") + F.col("c41") + F.when(F.col("c0") < -11_000, 5.0).otherwise(1.0)).cache()
    passes, one = [], cleaning._one
    monkeypatch.setattr(cleaning, "_one", lambda *a: passes.append(1) or one(*a))
    found = {e.column: e for e in cleaning.detect_derived(df, profile(df), cleaning.Rules())}
    bad = df.where("c0 < -11000").count()
    assert bad and found["total"].count == bad and found["total"].facts["formula"] == {"op": "sum_offset", "sources": ["c3", "c41"], "offset": 1}
    assert len(passes) == 1
    assert cleaning.detect_derived(df.limit(0), profile(df.limit(0)), cleaning.Rules()) == []


def test_spellings_beyond_a_dict(spark, monkeypatch):
    words = [w for i in range(30) for w in [f"Word {i}"] * 5 + [f"word {i}", f" Word {i} "]] + [None]
    df = spark.createDataFrame(list(enumerate(words)), "k long, c string")
    ps = profile(df)
    few = cleaning.detect_spellings(df, ps, cleaning.Rules())[0]
    monkeypatch.setattr(cleaning, "SPELLINGS", 3)
    many = cleaning.detect_spellings(df, ps, cleaning.Rules())[0]
    assert isinstance(few.facts["mapping"], dict) and few.count == many.count == 60
    a, b = (cleaning.ACTIONS["map_values"](df, "c", e.facts, "k") for e in (few, many))
    assert sorted(a.collect()) == sorted(b.collect()) and b.columns == df.columns
    assert {r["c"] for r in b.collect()} == {None, *(f"Word {i}" for i in range(30))}
    d = cleaning.Decision(many, "apply", "map_values", many.facts)
    assert cleaning.unexpected(df, b, d, "k") == [] != cleaning.unexpected(df, b.withColumn("c", F.upper("c")), d, "k")


def test_wrong_results_of_more_actions_are_seen(spark):
    rows = [(i, ["(1,200.50)", "$3", " 7 % ", None, "x"][i % 5], ["2024-01-05", "03/04/2024", None, " 2024-02-03 10:11:12"][i % 4], i % 3) for i in range(24)]
    df = spark.createDataFrame(rows, "k long, n string, d string, g long")
    for action, c, p in (("to_number", "n", {}), ("to_date", "d", {}), ("remove_duplicates", None, {"columns": ["n", "g"]})):
        after = cleaning.ACTIONS[action](df, c, p, "k")
        d = cleaning.Decision(cleaning.Evidence("t", c, "p", 1, 0.1), "apply", action, p)
        assert cleaning.unexpected(df, after, d, "k") == [], action
        wrong = after.withColumn(c, F.when(F.col("k") != 1, F.col(c))) if c else df.where("k >= 9")
        assert cleaning.unexpected(df, wrong, d, "k"), action


def test_codes_of_values_in_order(spark):
    r = random.Random(4)
    words = [r.choice([None, "ä", "b", "ba", "common prefix 1", "common prefix 2", "", "z"]) for _ in range(200)]
    known = sorted({w for w in words if w is not None}, key=lambda w: w.encode())
    df = spark.createDataFrame(list(enumerate(words)), "k long, c string")
    got = {x["k"]: x["c"] for x in features.label_codes(df, "c").collect()}
    assert got == {k: None if w is None else known.index(w) for k, w in enumerate(words)}


def test_insights_of_classes_and_importances(spark):
    r = random.Random(6)
    rows = []
    for i in range(400):
        g = r.choice("aab")
        rows.append((g, "red" if (g == "a") == (r.random() < 0.9) else "blue", "w" * (30 if g == "a" else 80) + str(i), None if g == "b" and r.random() < 0.4 else 1.5, r.random()))
    df = spark.createDataFrame(rows, "label string, colour string, note string, extra double, noise double")
    ps = profile(df)
    found = {(x.kind, x.feature): x for x in insights.candidates(df, "label", ps)}
    assert found["group_difference", "colour"].facts["lift"] > 1.5 and found["distribution", "label"].confidence == 0.9
    assert found["segment", "note"].facts["gap_pct"] > 100 and "label = b" in found["data_quality", "extra"].finding
    x = spark.createDataFrame([(v := r.random(), v + r.random() / 5, r.random(), (g := r.choice("ab")), 10 * v + (g == "a"), 10 * v if i % 2 else None) for i in range(300)], "v double, near double, noise double, g string, y double, tells double")
    done = {i.feature: i for i in insights.important(x, "y", profile(x))}
    assert "noise" not in done and done["v"].p < 1e-9 and done["v"].importance == 1.0 and 0.1 <= done["v"].confidence <= 0.9
    z = spark.createDataFrame([(1.0 if i % 4 == 0 else None, i % 4 == 0 and "yes" or "no") for i in range(100)], "m double, t string")
    assert insights.telling(z, ["m"], "t").first()[1:] == (1.0, 1.0)
    one = [insights.Insight(k, "f", "", 0.9, 0.9, 0.001, 500, 0.9) for k in ("correlation", "feature_importance", "outlier")]
    assert {i.kind for i in insights.ranked(one)} == {"outlier", "correlation"}


def test_merged_importance_leaves_out_features_of_importance_zero(spark):
    from lumen.plans import insights

    x = spark.createDataFrame([(float(a), float(b)) for a in range(10) for b in range(10)], "a double, y double")
    assert insights.merged_importance(x, "y").collect() == []
