import hashlib
import math
import random

import numpy as np
import pytest

from lumen.llm import ball_kmeans as m


def brute(rows, k, rounds, dim, scale=256):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(scale * float(np.float32(x))) for x in v]))
    start = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    c = [v for _, v in start]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, x)), j) for j, x in enumerate(c))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for j in range(len(c)):
            mine = [v for (_, v), o in zip(kept, own) if o == j]
            if mine:
                c[j] = [sum(x) // len(mine) for x in zip(*mine)]
    found = [(i, *reversed(nearest(v))) for i, v in kept]
    total = sum(d for _, _, d in found)
    by = {j: sum(d for _, o, d in found if o == j) for j in range(len(c))}
    return sorted(((i, j, d, by[j], total) for i, j, d in found), key=repr), c


def table(spark, rows, more=""):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>" + more)


def got(df):
    return sorted((tuple(r) for r in df.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia").collect()), key=repr)


def clouds(n, dim, seed, centres=6):
    r = random.Random(seed)
    middle = [[r.uniform(-1, 1) for _ in range(dim)] for _ in range(centres)]
    return [(i, [x + r.gauss(0, 0.1) for x in r.choice(middle)]) for i in range(n)]


@pytest.mark.parametrize(("k", "dim", "n"), [(7, 5, 300), (40, 3, 200), (1, 4, 30)])
def test_against_brute_force(spark, k, dim, n):
    rows = clouds(n, dim, k)
    out, centroids = m.ball_kmeans(table(spark, rows), k=k, dim=dim)
    want, c = brute(rows, k, 5, dim)
    assert got(out) == want and centroids == c


def test_ties_repeated_vectors_and_empty_clusters(spark):
    # A lattice of few points: many equal distances, equal centroids (of which the larger numbers stay empty), repeated ids.
    r = random.Random(8)
    rows = [(i % 90, [float(r.randint(0, 2)), float(r.randint(0, 2))]) for i in range(240)]
    out, centroids = m.ball_kmeans(table(spark, rows), k=20, dim=2, scale=1)
    want, c = brute(rows, 20, 5, 2, 1)
    assert got(out) == want and centroids == c


def test_nulls_odd_vectors_clashing_columns_empty_table(spark):
    ok = clouds(50, 3, 2)
    odd = [(100, None), (101, [1.0, None, 2.0]), (102, [1.0, 2.0]), (103, [1.0, float("nan"), 0.0]), (104, [float("inf"), 0.0, 0.0]), (105, []), (None, [0.5, 0.5, 0.5])]
    out, _ = m.ball_kmeans(table(spark, ok + odd), k=4, dim=3)
    assert got(out) == brute(ok + odd, 4, 5, 3)[0]
    few, c = m.ball_kmeans(table(spark, ok[:2]), k=9, dim=3)
    assert few.count() == 2 and len(c) == 2
    clash = table(spark, [(*x, 1, 2, 3) for x in ok], ", cluster int, distance int, v int")
    assert got(m.ball_kmeans(clash, k=4, dim=3)[0]) == brute(ok, 4, 5, 3)[0]
    none, c = m.ball_kmeans(table(spark, ok).limit(0), dim=3)
    assert none.count() == 0 and c == [] and none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia"]
    huge, _ = m.ball_kmeans(table(spark, [(1, [3e38, 0.0]), (2, [-3e38, 0.0])]), k=1, dim=2)
    assert huge.count() == 2 and all(r["distance"] > 0 for r in huge.collect())


def test_balls_compare_only_relevant_neighbours():
    r = np.random.default_rng(4)
    centres = r.integers(-4000, 4000, (30, 8))
    own = r.integers(0, 30, 5000)
    x = centres[own] + r.integers(-400, 400, (5000, 8))
    d = ((x[:, None, :] - centres[None]) ** 2).sum(2)
    radii = np.array([math.sqrt(d[own == i, i].max()) for i in range(30)])
    balls = m.Balls(centres, radii)
    to, best, taken = balls.assign(x, own)
    assert (to == d.argmin(1)).all() and (best == d.min(1)).all()
    assert sum(len(n) for n in balls.near) < 0.2 * 30 * 29  # most centroids are no neighbours
    assert taken < 0.1 * d.size  # and most members are in the stable core
    far, _, _ = balls.assign(x[:500], own[:500])
    assert (far == to[:500]).all()


def test_query_against_its_sql(spark, small):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{small}/embeddings.parquet'")
    cols = "vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256"
    assert sorted(tuple(r) for r in m.query(spark, small).select(*cols.split(", ")).collect()) == sorted(con.sql(f"select {cols} from ({m.ORACLE})").fetchall())
