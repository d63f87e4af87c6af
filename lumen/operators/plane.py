"""Distances to the k-th neighbour of weighted points in the plane, by tiles.

The plane is cut into strips of x at quantiles, and each strip into tiles of y,
of about ``TILE`` points.  A tile first searches its own points; that bounds each
point's distance from above, and so tells which other tiles can hold a nearer
one.  Only points near a border ask there.  Cut points are fixed numbers, so a
point's tile is the same wherever it is computed.

Scale: the driver holds the cut points, one a tile.  A task holds one tile at a
time and compares each point with those of a window along one axis; points that
ask in a tile stream past it.  Where many points share x and y cannot be cut, or
the reverse, a tile is larger.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumen.session import shared_dir

#: Points of a tile, roughly, and points that are searched together.
TILE, TOGETHER = 5_000, 256


class Tiles:
    """Strips by ascending edges of x, and of each strip the edges of y; a value is in the range of its number of smaller edges."""

    def __init__(self, x: list[float], y: list[list[float]]):
        self.x, self.y = np.array(x, float), [np.array(e, float) for e in y]
        self.first = np.concatenate([[0], np.cumsum([len(e) + 1 for e in y])])

    def of(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        strip = np.searchsorted(self.x, x, "left")
        out = np.empty(len(x), np.int64)
        for s in np.unique(strip):
            at = strip == s
            out[at] = self.first[s] + np.searchsorted(self.y[s], y[at], "left")
        return out

    def met(self, x: np.ndarray, y: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (point, tile) of the tiles that can hold points within r, with room for rounding."""
        r = r + 1e-9 * (np.abs(x) + np.abs(y) + r)
        low, high = np.searchsorted(self.x, x - r, "left"), np.searchsorted(self.x, x + r, "left")
        rows, tiles = [], []
        for s in range(int(low.min()), int(high.max()) + 1) if len(x) else ():
            at = np.flatnonzero((low <= s) & (s <= high))
            a, b = (np.searchsorted(self.y[s], v, "left") for v in (y[at] - r[at], y[at] + r[at]))
            n = b - a + 1
            rows.append(np.repeat(at, n))
            tiles.append(self.first[s] + np.repeat(a, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
        return (np.concatenate(rows), np.concatenate(tiles)) if rows else (np.zeros(0, int), np.zeros(0, int))


class Tile:
    """Points of a tile in order of the axis that has more distinct values."""

    def __init__(self, x: np.ndarray, y: np.ndarray, c: np.ndarray):
        self.axis = int(len(np.unique(y)) > len(np.unique(x)))
        self.order = np.argsort((x, y)[self.axis], kind="stable")
        self.v = [x[self.order], y[self.order]]
        self.c = c[self.order]

    def _nearest(self, q: list[np.ndarray], a: int, b: int, k: int, own: np.ndarray | None) -> np.ndarray:
        """The k least distances to the points a to b, each as often as its point counts; own is the place of each query's own point, of which one less counts."""
        d = np.maximum(np.abs(q[0][:, None] - self.v[0][None, a:b]), np.abs(q[1][:, None] - self.v[1][None, a:b]))
        c = self.c[a:b]
        row = np.arange(len(d))
        if own is not None:
            d[row, own - a] = np.where(c[own - a] > 1, 0.0, np.inf)
        few = min(k + 1, b - a)
        at = np.argpartition(d, few - 1, 1)[:, :few] if few < b - a else np.broadcast_to(np.arange(b - a), d.shape)
        near = np.take_along_axis(d, at, 1)
        order = np.argsort(near, 1, kind="stable")
        near, at = np.take_along_axis(near, order, 1), np.take_along_axis(at, order, 1)
        n = c[at] - (at == (own - a)[:, None] if own is not None else 0)
        run = np.cumsum(np.where(np.isfinite(near), n, 0), 1)
        out = np.full((len(d), k), np.inf)
        for j in range(k):
            has = run[:, -1] > j
            out[has, j] = near[has, (run[has] > j).argmax(1)]
        return out

    def among(self, k: int) -> np.ndarray:
        """Of each point, in the tile's order, the k least distances to the others (infinite where there are fewer)."""
        n, t = len(self.c), self.v[self.axis]
        out = np.empty((n, k))
        for i in range(0, n, TOGETHER):
            j = min(n, i + TOGETHER)
            a, b = max(0, i - TOGETHER // 4), min(n, j + TOGETHER // 4)
            q = [v[i:j] for v in self.v]
            while True:
                found = self._nearest(q, a, b, k, np.arange(i, j))
                r = found[:, -1]
                if np.isfinite(r).all():
                    # What lies beyond the window is farther along the axis alone.
                    low, high = np.searchsorted(t, (t[i:j] - r * (1 + 1e-9)).min(), "left"), np.searchsorted(t, (t[i:j] + r * (1 + 1e-9)).max(), "right")
                else:
                    low, high = max(0, a - 2 * (b - a)), min(n, b + 2 * (b - a))
                if a <= low and high <= b:
                    break
                a, b = min(a, low), max(b, high)
            out[i:j] = found
        return out

    def near(self, x: np.ndarray, y: np.ndarray, r: np.ndarray, k: int) -> np.ndarray:
        """Of points elsewhere, with bounds r, the k least distances to this tile's; those beyond a bound may be left out."""
        q = [x, y]
        order = np.argsort(q[self.axis], kind="stable")
        out = np.full((len(x), k), np.inf)
        t = self.v[self.axis]
        for i in range(0, len(x), TOGETHER):
            at = order[i : i + TOGETHER]
            own = q[self.axis][at]
            reach = r[at] + 1e-9 * (np.abs(own) + r[at])
            a, b = np.searchsorted(t, (own - reach).min(), "left"), np.searchsorted(t, (own + reach).max(), "right")
            for s in range(a, b, 65_536):  # a far bound meets the whole tile
                found = self._nearest([v[at] for v in q], s, min(b, s + 65_536), k, None)
                out[at] = np.sort(np.concatenate([out[at], found], 1), 1)[:, :k]
        return out


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[np.ndarray]]]:
    """Parts of batches with equal first ``keys`` columns, as (key, other columns)."""
    for b in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        if not len(b):
            continue
        new = np.append(True, np.any([c[1:] != c[:-1] for c in cols[:keys]], 0))
        cuts = np.flatnonzero(new)
        for i, j in zip(cuts, [*cuts[1:], len(b)]):
            yield tuple(c[i] for c in cols[:keys]), [c[i:j] for c in cols[keys:]]


def _own(tiles: Tiles, k: int):
    """Rows (tile, id, x, y, c) sorted by tile: each point's least distances in its tile, a row for its own tile and one for each other tile that it must ask in."""

    def done(now: int, held: list) -> Iterator[pa.RecordBatch]:
        ids, x, y, c = (np.concatenate(v) for v in zip(*held))
        t = Tile(x, y, c)
        d, ids = t.among(k), ids[t.order]
        for i in range(0, len(ids), 4096):
            p = slice(i, i + 4096)
            row, to = tiles.met(t.v[0][p], t.v[1][p], d[p, -1])
            own = to == now
            row, to = np.concatenate([np.arange(len(ids[p])), row[~own]]), np.concatenate([np.full(len(ids[p]), -1), to[~own]])
            yield pa.RecordBatch.from_arrays([pa.array(to), *(pa.array(v[p][row]) for v in (ids, *t.v)), pa.array(list(d[p][row]), pa.list_(pa.float64()))], ["tile", "id", "x", "y", "d"])

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for (tile,), cols in _runs(batches, 1):
            if tile != now and held:
                yield from done(now, held)
                held = []
            now = tile
            held.append(cols)
        if held:
            yield from done(now, held)

    return f


def _asked(k: int):
    """Rows (tile, side, id, x, y, c, r) sorted by tile and side: of those that ask (side 1) the least distances to the tile's points (side 0)."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, tile = None, [], None
        for (key, side), (ids, x, y, c, r) in _runs(batches, 2):
            if key != now:
                now, held, tile = key, [], None
            if side == 0:
                held.append((x, y, c))
            elif held:
                tile = tile or Tile(*(np.concatenate(v) for v in zip(*held)))
                d = tile.near(x, y, r, k)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(list(d), pa.list_(pa.float64()))], ["id", "d"])

    return f


def tiles_of(points: DataFrame, size: int, tile: int = TILE) -> Tiles:
    """Tiles of about ``tile`` of size points."""
    strips = max(1, round((size / tile) ** 0.5))
    levels = lambda n: F.array(*[F.lit(i / n) for i in range(1, n)])
    ex = sorted(set(points.agg(F.percentile_approx("x", levels(strips), F.lit(10_000)).alias("q")).first()["q"] or [])) if strips > 1 else []
    own = F.size(F.filter(F.array(*map(F.lit, ex)), lambda e: e < F.col("x"))) if ex else F.lit(0)
    placed = points.select(own.alias("s"), "y")
    counts = {r["s"]: r["n"] for r in placed.groupBy("s").agg(F.count("*").alias("n")).collect()}  # a row a strip
    most = -(-max(counts.values(), default=0) // tile)
    ey: list[list[float]] = [[] for _ in range(len(ex) + 1)]
    if most > 1:
        for r in placed.groupBy("s").agg(F.percentile_approx("y", levels(most), F.lit(max(10_000, 10 * most))).alias("q")).collect():  # a number a tile
            m = -(-counts[r["s"]] // tile)
            ey[r["s"]] = sorted({r["q"][round(i * most / m) - 1] for i in range(1, m)})
    return Tiles(ex, ey)


def kth_distance(points: DataFrame, k: int, tile: int = TILE) -> DataFrame:
    """``id, r``: the largest-coordinate distance from each of points (id, x, y, and c, how many rows stand there) to its k-th nearest other row; rows of the same place are at distance 0. Infinite where there are fewer."""
    spark = points.sparkSession
    p = points.select("id", F.col("x").cast("double"), F.col("y").cast("double"), F.col("c").cast("long"))
    tiles = tiles_of(p, p.count(), tile)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(tiles.of(b.column(1).to_numpy(), b.column(2).to_numpy())), *b.columns], ["tile", "id", "x", "y", "c"])

    path = shared_dir(spark)
    p.mapInArrow(place, "tile long, id long, x double, y double, c long").write.parquet(f"{path}/tiles")
    placed = spark.read.parquet(f"{path}/tiles")
    placed.repartition(tasks, "tile").sortWithinPartitions("tile").mapInArrow(_own(tiles, k), "tile long, id long, x double, y double, d array<double>").write.parquet(f"{path}/own")
    found = spark.read.parquet(f"{path}/own")
    asks = found.where("tile >= 0").select("tile", F.lit(1).alias("side"), "id", "x", "y", F.lit(0).cast("long").alias("c"), F.get("d", F.lit(k - 1)).alias("r"))
    there = placed.select("tile", F.lit(0).alias("side"), "id", "x", "y", "c", F.lit(0.0).alias("r"))
    met = there.union(asks).repartition(tasks, "tile").sortWithinPartitions("tile", "side")
    more = met.mapInArrow(_asked(k), "id long, d array<double>")
    alone = found.where("tile < 0").select("id", "d").union(more)
    return alone.groupBy("id").agg(F.get(F.array_sort(F.flatten(F.collect_list("d"))), F.lit(k - 1)).alias("r"))  # k distances of each tile that was asked
