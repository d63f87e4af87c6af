"""Learners, neighbours, text features and rank correlation against plain versions."""

import math
import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from lumen.operators import concordance, importance, information, neighbours, ngrams
from lumen.plans import learners, ml


def vectors(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "id long, features array<double>")


def nearest_of(rows, queries, k, itself=False):
    out = []
    for i, q in queries:
        d = sorted((math.sqrt(float(((np.array(v) - np.array(q)) ** 2).sum())), j) for j, v in rows if itself or j != i)[:k]
        out += [(i, r + 1, j) for r, (_, j) in enumerate(d)]
    return sorted(out)


@pytest.mark.parametrize(("block", "rings", "queries_of"), [(20_000, 16, 100_000), (30, 4, 15), (7, 1, 100_000)])
def test_neighbours_equal_brute_force(spark, block, rings, queries_of):
    r = np.random.default_rng(block)
    x = np.concatenate([r.normal(0, 1, (200, 4)), r.normal(6, 0.3, (150, 4)), np.tile([[9.0, 9, 9, 9]], (60, 1))])
    rows = list(enumerate(x.tolist()))
    queries = rows[::7]
    got = neighbours.nearest(vectors(spark, rows), vectors(spark, queries), 5, pivots=20, rings=rings, block=block, queries_of=queries_of)
    assert sorted((a["id"], a["rank"], a["neighbour"]) for a in got.collect()) == nearest_of(rows, queries, 5)


def test_neighbours_look_at_few_rows(spark):
    r = np.random.default_rng(1)
    centres = r.normal(0, 20, (40, 6))
    rows = list(enumerate((centres[r.integers(0, 40, 4000)] + r.normal(0, 1, (4000, 6))).tolist()))
    got = neighbours.nearest(vectors(spark, rows), vectors(spark, rows[:200]), 3, pivots=64, block=40)
    seen = got.groupBy("id").agg(F.max("seen").alias("n")).agg(F.avg("n")).first()[0]
    assert seen < 0.2 * len(rows)
    assert sorted((a["id"], a["rank"], a["neighbour"]) for a in got.collect()) == nearest_of(rows, rows[:200], 3)


def test_neighbours_of_odd_vectors_and_few_rows(spark):
    odd = spark.createDataFrame([(1, [0.0, 1.0]), (2, None), (3, [float("nan"), 0.0]), (4, [1.0]), (None, [0.0, 0.0]), (5, [0.0, 1.0]), (6, [3.0, 5.0])], "id long, features array<double>")
    got = sorted((r["id"], r["rank"], r["neighbour"], r["distance"]) for r in neighbours.nearest(odd, odd, 5, dim=2).collect())
    assert got == [(1, 1, 5, 0.0), (1, 2, 6, 5.0), (5, 1, 1, 0.0), (5, 2, 6, 5.0), (6, 1, 1, 5.0), (6, 2, 5, 5.0)]
    assert neighbours.nearest(odd.limit(0), odd, 2, dim=2).count() == 0


def ring(spark, n=600, seed=3):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        a, inner = r.uniform(0, 2 * math.pi), i % 2 == 0
        d = r.uniform(0, 1) if inner else r.uniform(1.6, 2.4)
        rows.append((i, float(inner), [d * math.cos(a), d * math.sin(a)]))
    return spark.createDataFrame(rows, "i long, label double, v array<double>").select("i", "label", array_to_vector("v").alias("features"))


def share(df):
    return df.agg(F.avg((F.col("label") == F.col("prediction")).cast("int"))).first()[0]


def test_fourier_features_approximate_the_kernel(spark):
    r = np.random.default_rng(2)
    x = r.normal(0, 1, (60, 5))
    w, b = learners.fourier_map(5, 4096, 0.3)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "i long, v array<double>")
    z = np.array([q["z"] for q in df.select("i", learners.fourier_features(F.col("v"), w, b).alias("z")).orderBy("i").collect()])
    exact = np.exp(-0.3 * ((x[:, None] - x[None]) ** 2).sum(2))
    # Hoeffding: each product of 4,096 terms in [-2, 2] / 4,096 strays over 0.13 with a chance below 2e-3; 1,770 pairs stay far below in the mean.
    assert np.abs(z @ z.T - exact).max() < 0.13 and np.abs(z @ z.T - exact).mean() < 0.02


def test_kernel_and_neighbours_beat_a_line_on_a_ring(spark):
    df = ring(spark)
    train, test = df.where("i % 3 > 0"), df.where("i % 3 = 0")
    line = share(LogisticRegression().fit(train).transform(test))
    assert share(learners.Kernel(size=256).fit(train).transform(test)) > max(0.95, line + 0.2)
    assert share(learners.Neighbours(5).fit(train).transform(test)) > max(0.95, line + 0.2)
    far = df.withColumn("label", F.col("label") * 2 + 1)
    mean = learners.Neighbours(5, mean=True).fit(far.where("i % 3 > 0")).transform(far.where("i % 3 = 0"))
    assert mean.agg(F.avg(F.abs(F.col("label") - F.col("prediction")))).first()[0] < 0.3


def test_boosting_weights_equal_a_plain_version(spark):
    r = random.Random(4)
    rows = [(i, r.randrange(3), *[r.randrange(3) for _ in range(3)]) for i in range(300)]
    rows = [(i, y, *[y if r.random() < 0.5 else p for p in ps]) for i, y, *ps in rows]
    df = spark.createDataFrame(rows, "i long, y int, p0 int, p1 int, p2 int").withColumn("w", F.lit(1.0 / len(rows)))
    w = [1.0 / len(rows)] * len(rows)
    for k in range(3):
        df, say = learners.reweighted(df, "y", f"p{k}", "w", 3)
        wrong = [row[2 + k] != row[1] for row in rows]
        e = sum(a for a, b in zip(w, wrong) if b) / sum(w)
        want = math.log((1 - e) / e) + math.log(2)
        w = [a * math.exp(want) if b else a for a, b in zip(w, wrong)]
        w = [a / sum(w) for a in w]
        assert abs(say - want) < 1e-9
    assert [round(q["w"], 12) for q in df.orderBy("i").collect()] == [round(a, 12) for a in w]
    same, say = learners.reweighted(df.withColumn("q", F.col("y")), "y", "q", "w", 3)
    assert say is None


def test_boosting_three_classes(spark):
    r = random.Random(5)
    rows = [(float(c), [c + r.gauss(0, 0.4), (c * 7) % 3 + r.gauss(0, 0.4)]) for c in (0, 1, 2) for _ in range(120)]
    df = spark.createDataFrame(rows, "label double, v array<double>").select("label", array_to_vector("v").alias("features"))
    one = learners.Boosted(1).fit(df)
    many = learners.Boosted(12).fit(df)
    assert len(many.models) > 3 and share(many.transform(df)) > max(0.85, share(one.transform(df)))
    clear = df.where("label < 2").withColumn("features", array_to_vector(F.array("label", "label")))
    assert share(learners.Boosted(5).fit(clear).transform(clear)) == 1.0


def test_split_has_its_share_of_each_class(spark):
    sizes = {"a": 1003, "b": 57, "c": 2, "d": 1, "e": 10}
    rows = [(f"{c}{i}", c) for c, n in sizes.items() for i in range(n)] + [("x", None)]
    df = spark.createDataFrame(rows, "k string, y string")
    train, test = learners.stratified_split(df, "y", ["k"], buckets=16)
    n = Counter(r["y"] for r in test.collect())
    assert n == {"a": 201, "b": 11, "c": 1, "e": 2}
    assert {r["k"] for r in train.collect()} | {r["k"] for r in test.collect()} == {k for k, c in rows if c not in ("d", None)}
    assert train.count() + test.count() == 1072


def plain_terms(texts, n, stop):
    import regex

    out = []
    for s in texts:
        w = [x for x in regex.findall(r"[\p{L}\p{N}_]{2,}", (s or "").lower()) if x not in stop]
        out.append(Counter(t for k in range(1, n + 1) for t in (" ".join(w[i : i + k]) for i in range(len(w) - k + 1))))
    return out


@pytest.mark.parametrize("table", [200_000, 600, 6])
def test_vocabulary_is_exact_whatever_a_task_holds(spark, table):
    r = random.Random(6)
    own = [f"w{i}" for i in range(80)]
    texts = [" ".join(r.choices(own, [1 / (i + 1) ** 1.2 for i in range(80)], k=r.randint(0, 40))) for _ in range(300)] + [None, "", "x", "Ünï cöde_1 the"]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, s string")
    each = plain_terms(texts, 2, ["w3"])
    n, docs = Counter(), Counter()
    for c in each:
        n.update(c)
        docs.update(c.keys())
    top = sorted(n, key=lambda t: (-n[t], t))[:25]
    got = ngrams.vocabulary(df, "s", 25, stop=["w3"], table=table)
    assert sorted(tuple(q) for q in got.collect()) == sorted((t, sorted(top).index(t), n[t], docs[t]) for t in top)
    tally = df.select(ngrams.tally(F.col("s"), 2, ["w3"]).alias("terms"))
    near = ngrams.candidates(tally, 25, table)
    assert (near is None) == (table == 6) and (near is None or set(top) <= {q["term"] for q in near.collect()})
    weights = {(q["id"], q["place"]): q["weight"] for q in ngrams.tfidf(df, "i", "s", got, stop=["w3"]).collect()}
    i = max(range(300), key=lambda k: len(each[k]))
    raw = {sorted(top).index(t): c * (math.log((1 + len(texts)) / (1 + docs[t])) + 1) for t, c in each[i].items() if t in top}
    norm = math.sqrt(sum(v * v for v in raw.values()))
    assert {p: round(v, 9) for (k, p), v in weights.items() if k == i} == {p: round(v / norm, 9) for p, v in raw.items()}


def test_inversions():
    r = np.random.default_rng(7)
    for n in (0, 1, 2, 50, 300):
        y, w = r.integers(0, 12, n).astype(float), r.integers(1, 4, n)
        assert concordance.inversions(y, w) == sum(int(w[i] * w[j]) for i in range(n) for j in range(i + 1, n) if y[i] > y[j])


@pytest.mark.parametrize("per_range", [20_000, 40, 7])
def test_kendall_equals_all_pairs(spark, per_range):
    r = random.Random(per_range)
    rows = [(float(r.choice([5, 5, 5, r.randint(0, 40)])), r.choice([None, float("nan"), float(r.randint(0, 30))]) if i % 9 == 0 else float(r.randint(0, 30))) for i in range(400)]
    pts = [(x, y) for x, y in rows if y is not None and not math.isnan(y)]
    s = tx = ty = 0
    for i, (a, b) in enumerate(pts):
        for c, d in pts[:i]:
            s += (a > c) * (b > d) + (a < c) * (b < d) - (a > c) * (b < d) - (a < c) * (b > d)
            tx, ty = tx + (a == c), ty + (b == d)
    n0 = len(pts) * (len(pts) - 1) / 2
    got = concordance.tau_b(spark.createDataFrame(rows, "x double, y double"), "x", "y", None, per_range).first()
    assert got["n"] == len(pts) and abs(got["r"] - s / math.sqrt((n0 - tx) * (n0 - ty))) < 1e-12
    flat = concordance.tau_b(spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double"), "x", "y").first()
    assert flat["r"] is None and flat["n"] == 2


@pytest.mark.parametrize("name", ["knn", "adaboost"])
def test_models_by_name(spark, monkeypatch, name):
    monkeypatch.setitem(ml.CLASSIFIERS, "adaboost", lambda: learners.Boosted(9))
    r = random.Random(8)
    rows = [(str(c), c + r.gauss(0, 0.3), r.gauss(0, 1)) for c in (0, 1, 2) for _ in range(60)]
    df = spark.createDataFrame([(y, a, b + i / 1e6) for i, (y, a, b) in enumerate(rows)], "label string, a double, b double")
    o = ml.train(df, "label", name)
    assert o.status == "trained" and not o.warnings and o.metrics["accuracy"] > 0.7, o.warnings


def test_boosted_trees_of_three_classes(spark):
    r = random.Random(9)
    rows = [(float(c), [c + r.gauss(0, 0.3), r.gauss(0, 1)]) for c in (0, 1, 2) for _ in range(40)]
    df = spark.createDataFrame(rows, "label double, v array<double>").select("label", array_to_vector("v").alias("features"))
    made = ml.CLASSIFIERS["boosted_trees_of_classes"]()
    made.getClassifier().setMaxIter(3)
    assert share(made.fit(df).transform(df)) > 0.9


def psi(n):
    return sum(1 / i for i in range(1, n)) - 0.57721566490153286


@pytest.mark.parametrize("seed", [1, 2])
def test_information_equals_all_pairs(spark, seed):
    r = random.Random(seed)
    rows = [(float(r.choice([3, r.gauss(0, 1)])), r.gauss(0, 1), r.choice("aab" if i else "z")) for i in range(150)]
    rows = [(x, y + (x if seed == 1 else 0), c) for x, y, c in rows]
    df = spark.createDataFrame(rows + [(None, 1.0, "a"), (float("nan"), 2.0, "b")], "x double, y double, c string")
    xs, ys = (np.array([q[i] for q in rows]) for i in (0, 1))
    xs, ys = xs / xs.std(), ys / ys.std()
    total = 0.0
    for i in range(len(xs)):
        d = np.sort(np.delete(np.maximum(abs(xs - xs[i]), abs(ys - ys[i])), i))[2] * (1 - 1e-9)
        total += psi(int((abs(xs - xs[i]) <= d).sum())) + psi(int((abs(ys - ys[i]) <= d).sum()))
    got = information.of_numbers(df, "x", "y").first()
    assert got["n"] == 150 and abs(got["nats"] - max(0.0, psi(150) + psi(3) - total / 150)) < 2e-6
    cs = np.array([q[2] for q in rows])
    keep = np.array([(cs == c).sum() > 1 for c in cs])
    parts = []
    for i in np.flatnonzero(keep):
        mine = np.flatnonzero((cs == cs[i]) & (np.arange(len(cs)) != i))
        k = min(3, len(mine))
        d = np.sort(abs(xs[mine] - xs[i]))[k - 1] * (1 - 1e-9)
        parts.append(psi(k) - psi(len(mine) + 1) - psi(int((abs(xs[keep] - xs[i]) <= d).sum())))
    got = information.of_classes(df, "x", "c").first()
    assert got["n"] == keep.sum() and abs(got["nats"] - max(0.0, psi(int(keep.sum())) + float(np.mean(parts)))) < 2e-6


def test_ensemble_of_classes_and_flat_features(spark):
    r = random.Random(3)
    rows = [(float(i % 3), i % 3 + r.gauss(0, 0.2), r.gauss(0, 1), 1.0) for i in range(90)]
    got = {q["feature"]: q["importance"] for q in importance.ensemble_importance(spark.createDataFrame(rows, "label double, near double, noise double, flat double"), "label").collect()}
    assert set(got) == {"near", "noise"} and got["near"] > 0.95 and got["near"] > got["noise"]


def test_terms_of_few_texts_are_in_memory_together(spark):
    r = random.Random(5)
    texts = [" ".join(f"w{r.randrange(10**6)}" for _ in range(400)) for _ in range(4000)] + [None, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    tracemalloc.start()
    n = sum(sum(b.column(1).to_pylist()) for b in ngrams._counted(2, [], None)(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 4000 * 799 and peak < 120e6  # 3.2 million terms
    df = spark.createDataFrame([(i, s) for i, s in enumerate([*texts[:50], None, ""])], "i long, s string")
    assert [sum(t["n"] for t in q["t"]) for q in df.orderBy("i").select(ngrams.tally(F.col("s"), 2, []).alias("t")).collect()] == [799] * 50 + [0, 0]
