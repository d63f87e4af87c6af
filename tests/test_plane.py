"""Neighbours in the plane against brute force."""

import numpy as np
import pytest

from lumen.operators import plane


@pytest.mark.parametrize(("tile", "k"), [(5000, 3), (40, 3), (7, 1), (40, 5)])
def test_kth_distance_equals_brute_force(spark, monkeypatch, tile, k):
    r = np.random.default_rng(tile + k)
    x = np.concatenate([r.normal(0, 1, 400), r.integers(0, 4, 300), np.full(100, 9.0), r.integers(0, 2, 60), r.uniform(-50, 50, 100)])
    y = np.concatenate([r.normal(0, 1, 400), r.normal(0, 1, 300), r.integers(0, 90, 100), np.full(60, 7.0), np.full(100, 3.0)])
    xy, c = np.unique(np.stack([x, y], 1), axis=0, return_counts=True)
    all_ = np.repeat(xy, c, 0)
    want = {i: float(np.sort(np.abs(all_ - p).max(1))[k]) for i, p in enumerate(xy)}
    points = spark.createDataFrame([(i, float(a), float(b), int(m)) for i, ((a, b), m) in enumerate(zip(xy, c))], "id long, x double, y double, c long")
    assert {q["id"]: q["r"] for q in plane.kth_distance(points, k, tile).collect()} == want


def test_a_point_is_compared_with_few(monkeypatch):
    r = np.random.default_rng(1)
    seen = []
    whole = plane.Tile._nearest
    monkeypatch.setattr(plane.Tile, "_nearest", lambda self, q, a, b, k, own: seen.append(len(q[0]) * (b - a)) or whole(self, q, a, b, k, own))
    plane.Tile(r.uniform(0, 1, 5000), r.uniform(0, 1, 5000), np.ones(5000, int)).among(3)
    assert sum(seen) < 5000 * 1500


def test_fewer_points_than_neighbours():
    assert np.isinf(plane.Tile(np.array([1.0, 2]), np.array([0.0, 0]), np.array([1, 1])).among(3)[:, 1:]).all()
