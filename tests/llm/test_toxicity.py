import math
import re

import numpy as np
from helpers import EDGES, clashing, frame

from lumen.llm import toxicity as m


def plain_score(model, text):
    """A fitted model's score, by plain Python."""
    low = re.sub("[A-Z]", lambda x: x[0].lower(), text or "")
    words = re.findall(r"[a-z'\u0080-\U0010ffff]+", low)
    x = [float(w.decode() in words) for w in model.lexicon]
    hits = [w.decode() for w, y in zip(model.lexicon, x) if y]
    letters = re.findall("[A-Za-z]", text or "")
    loud = len(letters) >= 20 and 2 * sum(c.isupper() for c in letters) > len(letters) or (text or "").count("!") > 2
    x += [len(hits) >= 2, bool(hits) and any(w in words for w in m.ADDRESS), bool(hits) and loud, any(words.count(w) > 1 for w in hits), not hits, not hits and len(words) > 50]
    z = sum(a * float(b) for a, b in zip(x, model.weights)) + model.weights[-1]
    return 1 / (1 + math.exp(-z))


def test_scores_against_brute_force(spark, small):
    docs = spark.read.parquet(small + "/documents.parquet").select("doc_id", "text")
    model = m.fit(docs, spark.read.parquet(small + "/labels.parquet"))
    long = "idiot " + "word " * 100_000 + "MORON moron scum you"
    for d in (docs, frame(spark, [*EDGES, long, "YOU STUPID STUPID IDIOT!!! GET OUT NOW", "you're é idiot"])):
        for r in m.score(d, model).collect():
            t = r["text"]
            assert abs(r["score"] - plain_score(model, t)) < 1e-9


def test_held_out_quality(spark, small):
    sf = small.replace("sf0.001", "sf0.1")
    got = m.query(spark, sf).join(spark.read.parquet(sf + "/labels.parquet").select("doc_id", "toxic"), "doc_id").where("held_out").collect()
    hit = sum(r["predicted"] == 1 and r["toxic"] == 1 for r in got)
    assert hit / sum(r["toxic"] == 1 for r in got) > 0.75  # the rest carry no toxic word: noisy labels
    assert hit / max(1, sum(r["predicted"] == 1 for r in got)) > 0.9


def test_label_model_finds_accuracies_and_correlation():
    r = np.random.default_rng(0)
    y = r.random(4000) < 0.3
    good, poor = np.where(r.random(4000) < 0.9, y, ~y), np.where(r.random(4000) < 0.6, y, ~y)
    other = np.where(r.random(4000) < 0.8, y, ~y)
    votes = np.stack([good, poor, poor, other], 1).astype(float)
    label = np.where(r.random(4000) < 0.2, y, -1).astype(int)
    q, accuracy, rho = m.label_model(votes, label, np.ones(4))
    assert ((q > 0.5) == y).mean() > 0.88
    assert accuracy[0] > accuracy[3] > accuracy[1]
    assert rho[1, 2] > 0.9 > abs(rho[0, 3])


def test_edges_clashing_columns_and_nothing_to_learn(spark):
    docs = frame(spark, [*EDGES, "you idiot scum"])
    none = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    model = m.fit(docs, none)
    got = sorted(m.score(docs, model).collect())
    assert all(0 <= r["score"] <= 1 for r in got) and got[-1]["score"] > 0.5 > got[0]["score"]
    assert got[0]["score"] == got[1]["score"]
    assert isinstance(m.score(clashing(spark, ["x"]), model).first()["score"], float)
    assert m.score(docs.limit(0), model).count() == 0
