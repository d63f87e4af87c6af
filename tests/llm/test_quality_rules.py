import re
from collections import Counter

import numpy as np
from helpers import EDGES, clashing, frame, sentences

from lumen.llm import quality_rules as m

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(t):
    t = t or ""
    w = WORD.findall(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    c = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    return [len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), dup, len(covered)]


def test_statistics_against_brute_force(spark):
    texts = [*EDGES, *sentences(40, words=40, vocabulary=4), "a\na\n b\na\r\na\n\n", "x|y <z> #1 **", "one two three four five " * 3, "é\né\n", "last\nlast"]
    got = sorted(m.assess(frame(spark, texts), []).collect())
    assert [[r[c] for c in m.COUNTS[:5]] for r in got] == [brute(t) for t in texts]
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])


def test_learns_a_threshold():
    r = np.random.default_rng(0)
    x = r.random((600, len(m.FEATURES)))
    y = (x[:, 2] > 0.8) | ((x[:, 4] > 0.7) & (x[:, 0] < 0.5))
    rules = m.learn(x, y)
    hit = np.zeros(len(x), bool)
    for rule in rules:
        hit |= m.covers(rule, x)
    assert (hit & ~y).sum() <= 0.05 * hit.sum() and (hit & y).sum() >= 0.8 * y.sum()
    assert m.learn(x, np.zeros(600, bool)) == []


def test_a_learned_list_against_row_by_row_evaluation(spark, small):
    sf = small.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(sf + "/documents.parquet").select("doc_id", "text")
    rules = m.fit(docs, spark.read.parquet(sf + "/labels.parquet"))
    assert rules
    for r in m.assess(docs, rules).collect():
        share = lambda a, b, r=r: r[a] / r[b] if r[b] else 0.0
        x = {"n_words": r["n_words"], "mean_word": share("word_chars", "n_words"), "symbol_share": share("n_symbols", "n_words"), "dup_line_share": share("n_dup_lines", "n_lines"), "repeat_share": share("n_repeat_words", "n_words"),
             "upper_share": share("n_upper", "word_chars"), "digit_share": share("n_digits", "word_chars"), "short_share": share("n_short", "n_words"), "words_per_line": share("n_words", "n_lines")}
        first = next((i + 1 for i, rule in enumerate(rules) if all((x[t.feature] >= t.threshold) if t.above else (x[t.feature] <= t.threshold) for t in rule)), 0)
        assert r["rule"] == first and r["kept"] == (not r["base_failed"] and not first)


def test_a_very_long_text(spark):
    text = "one two\n" * 100_000 + "three four five six seven\n" * 2
    r = m.assess(frame(spark, [text]), []).first()
    assert [r[c] for c in m.COUNTS[:5]] == brute(text)


def test_keeps_clean_documents(spark, small):
    sf = small.replace("sf0.001", "sf0.1")
    got = m.query(spark, sf).join(spark.read.parquet(sf + "/labels.parquet").select("doc_id", "quality"), "doc_id").where("not base_failed").collect()
    good, bad = [r for r in got if r["quality"] == 1], [r for r in got if r["quality"] == 0]
    assert sum(r["kept"] for r in good) / len(good) > 0.99 and sum(not r["kept"] for r in bad) / len(bad) > 0.9


def test_clashing_columns_empty_table_no_labels(spark):
    x = m.assess(clashing(spark, ["a b c", None]), [[m.Test("n_words", True, 2.0)]]).collect()
    assert sorted((r["n_words"], r["kept"], r["rule"]) for r in x) == [(0, False, 0), (3, False, 1)]
    assert m.assess(frame(spark, ["x"]).limit(0), []).count() == 0
    assert m.fit(frame(spark, ["x"]), spark.createDataFrame([], "doc_id long, quality int")) == []
