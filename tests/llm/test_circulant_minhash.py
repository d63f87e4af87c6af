import numpy as np
import pytest
from helpers import EDGES, clashing, frame
from test_ngram_jaccard import edited, shingles

from lumen.llm import circulant_minhash as m


def brute(rows, k=5, num=17, den=20):
    sets = [(i, shingles(t, k)) for i, t in rows]
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
    return sorted((i, len(s), find(i), i == find(i)) for i, s in sets)


@pytest.mark.parametrize(("num", "den", "block"), [(17, 20, 4096), (17, 20, 6), (4, 5, 4096)])
def test_against_brute_force(spark, num, den, block):
    rows = list(enumerate(edited(num + block)))
    got = m.near_duplicates(frame(spark, [t for _, t in rows]), num=num, den=den, block=block)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 5, num, den)


def test_both_steps_permute():
    x = np.arange(1 << 16, dtype=np.uint32) << np.uint32(16)
    assert len(np.unique(m.scatter(x.copy().astype(np.uint64)))) == len(x)
    assert len(np.unique(m.permute(x.copy(), 0x2C1B3C6D, 0x297A2D39))) == len(x)


def test_coordinates_are_shifts_of_one_permutation():
    items = np.random.default_rng(1).integers(0, 1 << 63, 50, np.uint64)
    got = m.signatures(items, np.array([0, 20, 20, 50]), 7)
    x = m.scatter(items)
    for i, (a, b) in enumerate([(0, 20), (20, 50)]):
        want = [min(int(m.permute(np.array([(int(v) - k - 1) % (1 << 32)], np.uint32), 0x2C1B3C6D, 0x297A2D39)[0]) for v in x[a:b]) for k in range(7)]
        assert got[2 * i].tolist() == want
    assert set(got[1].tolist()) == {0xFFFFFFFF}


@pytest.mark.parametrize(("n", "jaccard"), [(12, 0.5), (400, 0.5), (400, 0.85), (3000, 0.2)])
def test_agreement_estimates_jaccard(n, jaccard):
    r = np.random.default_rng(n)
    both = round(2 * n * jaccard / (1 + jaccard))
    shares = []
    for _ in range(60):
        u = r.integers(0, 1 << 63, 2 * n - both, np.uint64)
        s = m.signatures(np.concatenate([u[:n], u[n - both :]]), np.array([0, n, 2 * n]), 200)
        shares.append((s[0] == s[1]).mean())
    exact = both / (2 * n - both)
    assert abs(np.mean(shares) - exact) < 0.02
    assert np.var(shares) < 1.6 * exact * (1 - exact) / 200  # no more than of independent permutations


def test_linked_sets_meet_in_a_band():
    r = np.random.default_rng(9)
    for _ in range(400):
        n = int(r.integers(7, 300))
        d = (3 * n) // 37  # of both sizes, so that the share is 0.85 at least
        u = r.integers(0, 1 << 63, n + d, np.uint64)
        a, b = np.unique(u[:n]), np.unique(u[d:])
        assert len(np.intersect1d(a, b)) / len(np.union1d(a, b)) >= 0.85
        keys = m.band_keys(m.signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), m.BANDS * m.ROWS), m.BANDS, m.ROWS)
        assert (keys[0] == keys[1]).any()


def test_without_bands_nothing_links(spark):
    rows = ["a b c d e f g h i j k l m n o p q r s t u v w x y z" + x for x in ("", " more")]
    assert {r["component_id"] for r in m.near_duplicates(frame(spark, rows)).collect()} == {0}
    assert {r["component_id"] for r in m.near_duplicates(frame(spark, rows), bands=0).collect()} == {0, 1}


def test_null_and_repeated_ids_clashing_columns_long_text_empty_table(spark):
    long = " ".join(f"w{i}" for i in range(200_000))
    rows = [(4, "a b c d e f"), (4, "a b c d e f"), (None, "a b c d e f"), (9, "A b c d e f"), (1, None), (20, long), (21, long + " end"), (22, "a")]
    got = m.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    named = sorted(tuple(r) for r in got if r["doc_id"] is not None)
    assert named == [(1, 0, 1, True), (4, 2, 4, True), (4, 2, 4, True), (9, 2, 4, False), (20, 199_996, 20, True), (21, 199_997, 20, False), (22, 1, 22, True)]
    assert [tuple(r) for r in got if r["doc_id"] is None] == [(None, 2, None, None)]
    assert m.near_duplicates(clashing(spark, ["q r s", "q r s"])).where("component_id = 0").count() == 2
    assert m.near_duplicates(frame(spark, ["x"]).limit(0)).count() == 0
    assert sorted(tuple(r) for r in m.near_duplicates(frame(spark, EDGES)).collect()) == brute(list(enumerate(EDGES)))
