import random
import re
from collections import Counter

from helpers import clashing, frame, sentences

from lumen.llm import decontaminate as m

WORD = re.compile(r"[^\W_]+")


def grams(w, k):
    return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def brute(docs, items, least=0.8):
    out = {}
    for i, t in docs:
        w = WORD.findall((t or "").lower())
        for n, x in items:
            own = WORD.findall((x or "").lower())
            k = min(5, len(own))
            size = min(len(own), len(w))
            if not own or size < k:
                continue
            c = grams(own, k)
            for s in range(len(w) - size + 1):
                d = grams(w[s : s + size], k)
                v = sum((c & d).values()) / sum((c | d).values())
                if v >= least and v > out.get((i, n), (0, 0))[0] + 1e-12:
                    out[i, n] = (v, s)
    return {k: (round(v, 9), s) for k, (v, s) in out.items()}


def test_against_brute_force(spark):
    r = random.Random(2)
    items = list(enumerate(sentences(10, 7, 50, 500))) + [(50, "two words"), (51, None), (52, "!!"), (53, "One")]
    docs = sentences(20, 8, 60, 500)
    for _ in range(60):
        w = r.choice(items[:10])[1].split()
        for _ in range(r.randint(0, 2)):
            p = r.randrange(len(w))
            r.choice([lambda: w.__setitem__(p, "zz"), lambda: w.insert(p, "ins"), lambda: w.pop(p) if len(w) > 1 else None])()
        docs.append(" ".join([*r.choice(docs).split()[:9], *w, "tail"]).title())
    docs += ["Two words", "one", None, "", items[0][1] + " " + items[0][1], " ".join(items[1][1].split()[:-1])]
    rows = list(enumerate(docs))
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]): (round(x["similarity"], 9), x["start_word"]) for x in m.decontaminate(frame(spark, docs), b).collect()}
    assert got == brute(rows, items)


def test_null_ids_empty_tables_clashing_columns_plan(spark, small):
    text = "one two three four five six seven eight"
    b = spark.createDataFrame([(1, text)], "item_id long, text string")
    docs = spark.createDataFrame([(None, text), (7, text), (7, text)], "doc_id long, text string")
    assert sorted(((r["doc_id"] or -1), r["n_windows"]) for r in m.decontaminate(docs, b).collect()) == [(-1, 1), (7, 1)]
    assert m.decontaminate(docs.limit(0), b).count() == 0 == m.decontaminate(docs, b.limit(0)).count()
    assert m.decontaminate(clashing(spark, [text]), b).count() == 1
    assert not re.search("Python|Pandas|Arrow", m.query(spark, small)._jdf.queryExecution().executedPlan().toString())


def test_blocks_find_all_within_the_radius(spark):
    r = random.Random(3)
    pairs = []
    for _ in range(200):
        a = r.getrandbits(64)
        b = a
        for bit in r.sample(range(64), r.randint(0, m.RADIUS)):
            b ^= 1 << bit
        pairs.append(tuple(x - (1 << 64) if x >> 63 else x for x in (a, b)))
    df = spark.createDataFrame(pairs, "a long, b long")
    from pyspark.sql import functions as F

    met = df.where(F.arrays_overlap(m.blocks(F.col("a")), m.blocks(F.col("b"))))
    assert met.count() == 200


def test_repeated_words_and_far_fingerprints(spark):
    r = random.Random(5)
    items = [(n, " ".join(f"w{n}x{i}" for i in range(length))) for n, length in enumerate([60, 100, 200, 400])] + [(9, "la la la la la la la ti la la la la la la la la la do")]
    docs = []
    for _, x in items:
        for share in (12, 10.5):
            w = x.split()
            n = int(len(w) / share)
            at = r.randrange(len(w) - n)
            docs.append(" ".join(["head", *w[:at], *["same"] * n, *w[at + n :], "tail"]))
    b = spark.createDataFrame(items, "item_id long, text string")
    want = brute(list(enumerate(docs)), items)
    assert {(6, 3), (7, 3)} <= set(want)
    got = {(x["doc_id"], x["item_id"]): (round(x["similarity"], 9), x["start_word"]) for x in m.decontaminate(frame(spark, docs), b).collect()}
    assert got == want
    near = {(x["doc_id"], x["item_id"]) for x in m.decontaminate(frame(spark, docs), b, radius=1).collect()}
    assert near == set(want)


def test_fingerprints_against_brute_force(spark):
    r = random.Random(8)
    rows = [[r.getrandbits(64) - (1 << 63) for _ in range(r.randint(0, 40))] for _ in range(60)]
    df = spark.createDataFrame([(x,) for x in rows], "a array<long>")
    for x in m.with_simhash(df, "a", "p").collect():
        want = sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in x["a"]) >= len(x["a"]))
        assert x["p"] % (1 << 64) == want


def test_a_very_long_text(spark):
    r = random.Random(9)
    item = sentences(1, 3, 60, 300)[0] + " " + sentences(1, 4, 60, 300)[0]
    words = [f"w{r.randrange(5000)}" for _ in range(200_000)]
    text = " ".join([*words[:150_000], item, *words[150_000:]])
    b = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = m.decontaminate(frame(spark, [text]), b).first()
    assert (got["similarity"], got["start_word"]) == (1.0, 150_000)
