import random

import pytest
from pyspark.sql import functions as F

from lumen.plans import analyzer, cleaning, features, insights, ml, target
from lumen.plans.profile import profile


@pytest.fixture(scope="module")
def dirty(spark):
    rows = []
    for i in range(150):
        rows.append((i, None if i % 10 == 0 else 20 + i % 40, None if i % 15 == 0 else 1000.0 + 37 * (i % 50), [" north", "North", "south", "South "][i % 4], f"{i % 7}.5", "2024-01-%02d" % (1 + i % 28)))
    return spark.createDataFrame(rows, "rid long, age int, income double, region string, amount string, day string").cache()


def test_profile_kinds(spark, dirty):
    p = profile(dirty)
    assert p["rid"].kind == "identifier" and p["age"].kind == "numeric" and p["region"].kind == "categorical"
    assert p["age"].nulls == 15 and p["rid"].sequential
    assert profile(spark.createDataFrame([("a@b.org",), ("c@d.net",)], "contact string"))["contact"].subtype == "email"


def test_cleaning_end_to_end(dirty):
    r = cleaning.Cleaner().run(dirty, "rid")
    assert r.assessment in ("CLEANED", "CLEANED_WITH_WARNINGS")
    assert r.after["nulls"]["age"] == 0 and r.after["nulls"]["income"] == 0
    assert dict(r.df.dtypes)["amount"] == "double" and dict(r.df.dtypes)["day"] == "timestamp"
    assert {x["region"] for x in r.df.select("region").distinct().collect()} <= {" north", "North", "south", "South "} and r.df.select("region").distinct().count() == 2
    assert cleaning.verify(r.log) and all(e["valid"] for e in r.log)
    r.log[0]["count"] = -1
    assert not cleaning.verify(r.log)
    dry = cleaning.Cleaner(policy=cleaning.Policy(dry_run=True)).run(dirty, "rid")
    assert dry.log == [] and dry.df.columns == dirty.columns


def test_duplicates_go_and_the_first_stays(spark):
    df = spark.createDataFrame([(i, i % 19, i % 2) for i in range(40)], "id long, age int, target int")
    r = cleaning.Cleaner().run(df, "id")
    assert r.after["rows"] == 38 and sorted(x["id"] for x in r.df.collect())[:3] == [0, 1, 2]


def test_damaged_identifiers_block(spark):
    df = spark.createDataFrame([(i, str(1000 + i) if i % 20 else "10,0\"x") for i in range(100)], "rid long, order_id string")
    assert cleaning.Cleaner().run(df, "rid").assessment == "BLOCKED"


def test_detectors(spark):
    rows = [(1.5 * i, 2.5 * i * i, 1.5 * i + 2.5 * i * i + (5 if i in (7, 9) else 0), 10.0 ** (3 * (i % 2)) * (1 + i % 9), f"w{'x' * (i % 5)}", len(f"w{'x' * (i % 5)}")) for i in range(1, 201)]
    df = spark.createDataFrame(rows, "a double, b double, total double, weight double, name string, name_len int")
    ps = profile(df)
    found = {e.column: e for e in cleaning.detect_derived(df, ps, cleaning.Rules())}
    assert found["total"].count == 2
    assert [e.column for e in cleaning.detect_units(df, ps, cleaning.Rules())] == ["weight"]
    assert cleaning.detect_times(df, ps, cleaning.Rules()) == []
    register = dict(cleaning.ACTIONS)
    cleaning.register_action("noop", lambda d, c, p, o: d)
    assert set(cleaning.ACTIONS) - set(register) == {"noop"}


def test_target_and_leaks(spark):
    r = random.Random(0)
    rows = [(i, r.random(), (x := r.random()), x * 2 + 1e-9, int(x > 0.5), int(x > 0.5)) for i in range(300)]
    df = spark.createDataFrame(rows, "rid long, a double, price double, twice double, churn int, copy int")
    assert target.detect_target(df).column == "price"
    assert target.detect_target(df.drop("price", "twice", "copy")).column == "churn"
    assert set(target.leaks(df, "price")) == {"twice"}
    assert "copy" in target.leaks(df.select("a", "churn", "copy"), "churn")
    assert target.filename_hints("trainTitanic_survival-2020.csv") == ["titanic", "survival"]


def test_models(spark):
    r = random.Random(0)
    rows = [(x := r.random(), r.random(), r.choice("ab"), "yes" if x + 0.1 * r.random() > 0.5 else "no", 3 * x + 0.4 * r.random()) for _ in range(400)]
    df = spark.createDataFrame(rows, "x double, z double, g string, label string, price double")
    o = ml.train(df.drop("price"), "label", "decision_tree")
    assert o.status == "trained" and o.metrics["accuracy"] > 0.85 and o.importance[0][0] == "x"
    o = ml.train(df.drop("label"), "price", "linear_regression")
    assert o.status == "trained" and o.metrics["r2"] > 0.95
    assert ml.train(df.limit(20), "label").status == "skipped"


def test_features(spark, dirty):
    out = features.prepare(dirty.drop("rid", "day", "amount"), "income")
    assert out.count() == 150 and all(t != "string" for _, t in out.dtypes)
    assert out.select(F.avg("age")).first()[0] == pytest.approx(0, abs=1e-9)
    people = spark.createDataFrame([("Braund, Mr. Owen", 1, 0, "C85 C86", "PC 17599"), ("Heikkinen, Miss. Laina", 0, 0, None, "PC 17599")], "Name string, SibSp int, Parch int, Cabin string, Ticket string")
    r = features.domain_features(people).orderBy("Name").collect()
    assert [(x["TitleGrouped"], x["FamilySize"], x["Deck"], x["CabinCount"], x["TicketCount"], x["TicketPrefix"]) for x in r] == [("Mr", 2, "C", 2, 2, "PC"), ("Miss", 1, "Unknown", 0, 2, "PC")]


def test_analysis_and_insights(spark):
    r = random.Random(1)
    rows = [(x := r.random() * 10, 5 * x + r.random(), (g := r.choice("ab")), x + (20 if g == "a" else 0)) for _ in range(200)]
    df = spark.createDataFrame(rows, "x double, y double, g string, sales double")
    a = analyzer.Analyzer(df, "pearson")
    assert a.analyze("sales").correlations.first()["strength"] == "strong"
    assert a.distribution("x")["shape"] == "normal_like"
    with pytest.raises(ValueError):
        analyzer.Analyzer(df, "other")
    found = insights.insights(df, "sales")
    assert found and found[0].kind == "group_difference" and found[0].p < 0.01
    assert "sales" in insights.report("t", a.profiles, found)


def test_stream_matches_batch(spark, small, tmp_path):
    from lumen.streaming.windows import windowed_counts

    e = spark.read.parquet(f"{small}/events.parquet").select("ts", "event_type", "value")
    e.write.parquet(f"{tmp_path}/in")
    s = windowed_counts(spark.readStream.schema(e.schema).parquet(f"{tmp_path}/in"), "ts", "event_type", "value")
    q = s.writeStream.format("memory").queryName("w").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c").start()
    try:
        q.processAllAvailable()
        assert spark.table("w").agg(F.sum("n")).first()[0] == e.count()
    finally:
        q.stop()


def test_derived_beyond_the_twelfth_column(spark):
    rows = []
    for i in range(1, 61):
        a, b = 1.5 * (i * 7 % 13 + 1), 0.25 * (i * 5 % 17 + 1)
        rows.append((a, b, *[10.0 ** (j + 3) + (i * (j + 3) % 13) for j in range(10)], a + b + (9 if i == 7 else 0)))
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in ["a", "b", *(f"f{j}" for j in range(10)), "total"])).cache()
    found = {e.column: e for e in cleaning.detect_derived(df, profile(df), cleaning.Rules())}
    assert found["total"].count == 1 and found["total"].facts["formula"] == {"op": "sum_offset", "sources": ["a", "b"], "offset": 0}


def test_an_action_that_changes_a_wrong_cell_is_rolled_back(spark, monkeypatch):
    from lumen.plans import cleaning

    rows = [(i, None if i == 3 else float(i % 7), f"v{i}") for i in range(40)]
    df = spark.createDataFrame(rows, "k long, amount double, word string")
    good = cleaning.Cleaner().run(df, "k")
    assert [r["amount"] for r in good.df.where("k = 3").collect()] == [3.0] and good.assessment.startswith("CLEANED")

    def wrong_column(df, c, p, order):
        from pyspark.sql import functions as F

        return cleaning._fill(df, c, p, order).withColumn("word", F.when(F.col("k") == 5, "changed").otherwise(F.col("word")))

    def wrong_value(df, c, p, order):
        return cleaning._fill(df, c, {**p, "value": p["value"] + 1}, order)

    for f in (wrong_column, wrong_value):
        monkeypatch.setitem(cleaning.ACTIONS, "fill", f)
        bad = cleaning.Cleaner().run(df, "k")
        assert any(d.verdict == "rolled_back" for d in bad.decisions)
        assert any("not as expected" in w for w in bad.warnings)
        assert {r["word"] for r in bad.df.where("k = 5").collect()} == {"v5"} and bad.df.where("k = 3").first()["amount"] is None


def test_every_expectation_agrees_with_its_action(spark):
    from lumen.plans import cleaning

    df = spark.createDataFrame([(1, " a  b ", 2, 3, 5.0, "x'y"), (2, "N/A", None, 4, 9.0, "p"), (3, None, 6, 1, 7.5, "q\\z")], "k long, t string, a int, b int, s double, m string")
    cases = [
        ("fill", "t", {"value": "it's"}), ("fill", "a", {"value": 4.0}), ("map_values", "m", {"mapping": {"x'y": "o'k", "q\\z": "w\\v"}}), ("trim", "t", {}), ("drop_column", "t", {}),
        ("flag_outliers", "s", {"lower": 6.0, "upper": 8.0}), ("null_values", "m", {"values": ["p"]}), ("recompute", "s", {"formula": {"op": "sum_offset", "sources": ["a", "b"], "offset": 2}}),
        ("recompute", "s", {"formula": {"op": "product", "sources": ["a", "b"]}}), ("recompute", "b", {"formula": {"op": "string_length", "source": "m"}}),
    ]
    for action, c, p in cases:
        d = cleaning.Decision(cleaning.Evidence("x", c, "x", 1, 1.0), "apply", action, p)
        assert cleaning.unexpected(df, cleaning.ACTIONS[action](df, c, p, "k"), d, "k") == [], action


def test_strategies(spark):
    from lumen.plans import cleaning

    assert cleaning.strategy_for(None, 99_999, 50) == cleaning.Strategy()
    assert cleaning.strategy_for(None, 100_000, 50) == cleaning.Strategy("scale_guarded", True, 24, 5000)
    assert cleaning.strategy_for("scale_guarded", 10, 3).pair_columns == 8
    df = spark.createDataFrame([tuple(range(10))], ", ".join(f"c{j} long" for j in range(10)))
    seen = []
    look = {"derived": lambda df, ps, rules: seen.append(list(ps)) or []}
    found = cleaning.Cleaner(detectors=look, strategy=cleaning.Strategy("own", True, 8)).evidence(df)[1]
    assert [e.facts["columns"] for e in found] == [["c8", "c9"]] and seen == [[f"c{j}" for j in range(8)]]
    assert cleaning.Cleaner(detectors=look, strategy="structure_only").evidence(df)[1] == [] and len(seen) == 1


def test_scores_without_relation_to_their_parts(spark):
    import random

    from lumen.plans import cleaning
    from lumen.plans.profile import profile

    r = random.Random(3)
    rows = [(x := r.random(), x + r.random() / 5, r.random()) for _ in range(3000)]
    df = spark.createDataFrame(rows, "life_size double, life_weight double, life_score double")
    (e,) = cleaning.detect_disconnected(df, profile(df), cleaning.Rules())
    assert e.column == "life_score" and e.facts["mutual"] > 0.9
    tied = df.withColumn("life_score", df.life_size * 2)
    assert cleaning.detect_disconnected(tied, profile(tied), cleaning.Rules()) == []


def test_clean_table(spark):
    from lumen.plans import cleaning

    df = spark.createDataFrame([(i, float(i % 50), str(i % 9), None if i == 4 else float(i % 5)) for i in range(60)], "k long, age double, code_text string, x double")
    got = cleaning.clean_table(df, "k")
    assert dict(got.df.dtypes)["age"] == "bigint" and got.report["rows"][0] == 60 and got.df.where("x is null").count() == 0


def test_charts_of_a_plan(spark, tmp_path):
    from lumen.plans import charts as p

    df = spark.createDataFrame([(f"g{i % 3}", float(i * i % 97), float(i % 13), "t" * (i % 40), "http://a.b/c" if i % 2 else "https://www.x.y") for i in range(400)], "kind string, amount double, size double, words string, url string")
    plans = p.plan(df, "kind")
    assert plans[0] == p.Chart("bar", "kind", None, "Distribution of kind") and all(not p.problems(df, c) for c in plans)
    assert p.problems(df, p.Chart("scatter", "kind", "amount")) and p.problems(df, p.Chart("pie", "words")) and p.problems(df, p.Chart("no", "kind")) and p.problems(df, p.Chart("bar", "nothing"))
    path = f"file://{tmp_path}/charts"
    p.store(df, plans, path)
    assert p.stored(spark, path).select("chart").distinct().count() == len(plans) and p.stored(spark, path, 0).count() == 3
    assert p.data(df.selectExpr("cast(null as double) as amount", "kind"), p.Chart("bar", "kind", "amount")) is None


def test_insight_kinds(spark):
    import random

    from lumen.plans import insights as m

    r = random.Random(1)
    rows = [(x := r.uniform(-1, 1), r.random(), 10 + 50 * x * x + r.random(), "hot" if x * x > 0.6 and r.random() < 0.8 else r.choice(["a", "b"])) for _ in range(2000)]
    df = spark.createDataFrame(rows, "wave double, noise double, value double, kind string")
    found = m.candidates(df, "value", m.profile(df))
    kinds = {(x.kind, x.feature) for x in found}
    assert ("interaction", "wave") in kinds and ("segment", "wave") in kinds and ("risk_segment", "kind") in kinds and ("segment", "noise") not in kinds
    x = next(x for x in found if x.kind == "segment")
    assert x.p is not None and m.severity(x) in ("critical", "strong", "moderate") and m.actionable(x)
    assert m.tested_risk_segment(df, "kind", "value")["p"] < 1e-6 and m.tested_risk_segment(df, "noise", "value")["p"] > 1e-4
    assert m.tested_feature(df, "noise", "value")["p"] > 1e-4 and m.tested_segment(df, "wave", "value")["method"] == "welch"
    s = m.serialise(x)
    assert s["confidence_label"] in ("low", "medium", "high") and m.by_severity(found)[0].kind
    assert m.parse_sections("# One\nbody\n**Two**\nmore\nlines\nThree things:\nend") == [{"title": "One", "body": "body"}, {"title": "Two", "body": "more\nlines"}, {"title": "Three things", "body": "end"}]
    assert m.summary(found, "value").startswith(str(len(found))) and m.initial_confidence(1.0, 5000, 1.0) == 0.9 and 0 < m.composite(x) <= 1 and isinstance(m.strict(x), bool)


def test_texts_are_classified_once_a_distinct_value(spark, monkeypatch):
    from pyspark.sql import types as T

    from lumen.functions import columns
    from lumen.plans import profile as profiles

    values = ["2024-01-05", "12.5", "plain words", " 2024-02-06 ", None]
    df = spark.createDataFrame([(i, values[i % 5], "$7" if i % 2 else "8") for i in range(500)], "k long, a string, b string")
    p = profiles.profile(df)
    assert (p["a"].count, p["a"].unique, p["a"].length, p["a"].numbers, p["a"].dates) == (400, 4, 9.25, 0.25, 0.5)
    assert (p["b"].count, p["b"].unique, p["b"].numbers, p["b"].dates) == (500, 2, 0.5, 0.0)
    assert [(e.problem, e.count) for e in cleaning.detect_types(df, p, cleaning.Rules()) if e.column == "b"] == [("mixed_types", 250)]
    calls = spark.sparkContext.accumulator(0)

    def parse(c):
        return F.udf(lambda v: calls.add(1), T.TimestampType())(c)

    monkeypatch.setattr(columns, "parse_datetime", parse)
    monkeypatch.setattr(profiles, "parse_datetime", parse)
    p = profiles.profile(df.select("a", "b"))
    cleaning.detect_types(df, p, cleaning.Rules())
    assert 0 < calls.value <= 50  # before: a call or more a row


def test_insights_make_a_join_below_them_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def named(i):
        seen.add(1)
        return "abc"[i]

    sizes = spark.createDataFrame([(i,) for i in range(3)], "key long").withColumn("kind", F.udf(named)("key"))
    df = spark.createDataFrame([(i % 3, 100.0 * (i % 3 + 1) + i % 7) for i in range(240)], "k long, sales double").join(sizes, F.col("k") == F.col("key")).select("sales", "kind")
    kept = spark.sparkContext._jsc.getPersistentRDDs().size()
    found = insights.insights(df, "sales")
    assert ("group_difference", "kind") in {(x.kind, x.feature) for x in found}
    assert seen.value == 3  # before: for every test anew
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == kept and not df.storageLevel.useMemory
