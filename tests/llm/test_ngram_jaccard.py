import random
import re

import numpy as np
import pytest
from helpers import EDGES, clashing, frame, sentences

from lumen.llm import ngram_jaccard as m

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(t, k=3):
    w = WORD.findall(re.sub("[A-Z]", lambda x: x[0].lower(), t or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


def brute(rows, num=9, den=10):
    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, (i, s) in enumerate(sets):
        for j, u in sets[:a]:
            if s and u and den * len(s & u) >= num * len(s | u):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return sorted((i, len(s), find(i)) for i, s in sets)


def edited(seed, n=160):
    r = random.Random(seed)
    base = sentences(12, seed, 120, 300) + sentences(12, seed + 1, 16, 300)
    out = []
    for _ in range(n):
        w = r.choice(base).split()
        for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
            p = r.randrange(len(w))
            r.choice([lambda: w.__setitem__(p, "new%d" % r.randrange(9)), lambda: w.insert(p, "ins"), lambda: w.pop(p) if len(w) > 1 else None])()
        out.append(" ".join(w).upper() if r.random() < 0.1 else " ".join(w))
    return out + EDGES


@pytest.mark.parametrize(("num", "den", "block"), [(9, 10, 4096), (9, 10, 7), (4, 5, 4096)])
def test_against_brute_force(spark, num, den, block):
    rows = list(enumerate(edited(num + block)))
    got = m.jaccard_components(frame(spark, [t for _, t in rows]), num=num, den=den, block=block)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, num, den)


def test_light_keys_meet_whenever_linked():
    r = random.Random(5)
    for _ in range(300):
        n = r.randint(1, 22)
        a = np.unique(np.array([r.getrandbits(63) for _ in range(n)], np.uint64))
        b = a.copy()
        for _ in range(r.randint(0, 3)):
            b = np.delete(b, r.randrange(len(b))) if r.random() < 0.5 and len(b) > 1 else np.append(b, np.uint64(r.getrandbits(63)))
        b = np.unique(b)
        o = len(np.intersect1d(a, b))
        linked = 10 * o >= 9 * (len(a) + len(b) - o)
        meet = bool(set(m.light_keys(a, 9, 10).tolist()) & set(m.light_keys(b, 9, 10).tolist()))
        assert meet or not linked
        assert not meet or 10 * o >= 8 * (len(a) + len(b) - o)  # and seldom otherwise


def test_heavy_keys_meet_whenever_linked():
    r = random.Random(6)
    for _ in range(300):
        n = r.randint(1, 200)
        a = np.unique(np.array([r.getrandbits(63) for _ in range(n)], np.uint64))
        d = (n // 9) if r.random() < 0.5 else r.randint(0, n // 9)
        gone = r.randint(0, d)
        b = np.unique(np.concatenate([a[: len(a) - gone] if gone else a, np.array([r.getrandbits(63) for _ in range(d - gone)], np.uint64)]))
        o = len(np.intersect1d(a, b))
        if b.size and 10 * o >= 9 * (len(a) + len(b) - o):
            both = np.concatenate([a, b])
            owner, key = m.heavy_keys(both, np.array([0, len(a), len(both)]), 9, 10)
            assert set(key[owner == 0].tolist()) & set(key[owner == 1].tolist())


def test_boundary_follows_cost():
    assert m.boundary({}, 9, 10) >= 9
    assert m.boundary({30: 1_000_000}, 9, 10) < 30


def test_null_and_repeated_ids_clashing_columns_empty_table(spark):
    rows = [(4, "a b c d"), (4, "a b c d"), (None, "a b c d"), (9, "A b c d"), (1, None)]
    got = m.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None) == [(1, 0, 1), (4, 2, 4), (4, 2, 4), (9, 2, 4)]
    assert [(r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is None] == [(2, None)]
    assert m.jaccard_components(clashing(spark, ["q r s", "q r s"])).where("component_id = 0").count() == 2
    assert m.jaccard_components(frame(spark, ["x"]).limit(0)).count() == 0


def test_components_of_long_chains(spark):
    from lumen.llm.graph import components

    edges = spark.createDataFrame([(i, i + 1) for i in range(200) if i != 99], "a long, b long")
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    assert got == {i: 0 for i in range(1, 100)} | {i: 100 for i in range(101, 201)}


def test_a_list_over_batches_and_ranges():
    import pyarrow as pa

    def batch(*rows):
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int64()), pa.array([r for _, r in rows], pa.int64())], ["key", "rep"])

    got = [tuple(x.values()) for b in m._star([batch((1, 5)), batch((1, 7), (2, 1)), batch(), batch((2, 3), (4, 9))]) for x in b.to_pylist()]
    assert sorted(x for x in got if x[1] is not None) == [(1, 7, 5), (2, 3, 1)]
    assert [x for x in got if x[1] is None] == [(1, None, 5), (4, None, 9)]


def test_a_hot_list_is_split_and_connected(spark):
    lists = spark.createDataFrame([(i, 42) for i in range(1000)] + [(i, 7) for i in (3, 2000)], "rep long, key long")
    from lumen.llm.graph import components

    edges = m._stars(lists)
    assert edges.count() <= 1010
    assert {r["root"] for r in components(edges).collect()} == {0} and components(edges).count() == 1000
