"""Exact nearest neighbours by pivots and triangle inequalities.

Rows go to the cell of their nearest pivot, and within it to rings of distance.
For a query, the distances from the pivots to their nearest rows bound the
distance of the k-th neighbour from above; the ring's inner and outer distance
and the plane between two pivots bound what a ring can hold from below.  A query
visits only rings that can hold a neighbour, takes the k nearest rows of each,
and these short lists are merged.

Scale: the driver holds the pivots and one line of bounds a ring.  Rings of more
than ``block`` rows are cut further by a hash, so that no task holds more than a
block of rows; queries stream past it.  A ring that more than ``QUERIES`` of them
visit is searched in as many copies as they fill that number.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Pivots, rings of a cell, and rows of a block.
PIVOTS, RINGS, BLOCK = 64, 16, 20_000
#: Queries that pass one copy of a ring's blocks.
QUERIES = 100_000


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _to(x: np.ndarray, y: np.ndarray, metric: str) -> np.ndarray:
    """Distances of each row of x to y, from differences, so that equal pairs give equal numbers."""
    return np.abs(x - y).max(1) if metric == "chebyshev" else np.sqrt(((x - y) ** 2).sum(1))


def _apart(x: np.ndarray, y: np.ndarray, metric: str) -> np.ndarray:
    out = np.empty((len(x), len(y)))
    for j in range(len(y)):
        out[:, j] = _to(x, y[j], metric)
    return out


def _cells(pivots: np.ndarray, metric: str):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = _apart(_matrix(b.column(1), pivots.shape[1]), pivots, metric)
            cell = d.argmin(1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])], ["id", "v", "cell", "d"])

    return f


@dataclass
class Bounds:
    """Rings: cell, number, rows, blocks, least and greatest distance to the pivot; and the ascending distances of each cell's first rows."""

    pivots: np.ndarray
    cell: np.ndarray
    ring: np.ndarray
    blocks: np.ndarray
    low: np.ndarray
    high: np.ndarray
    first: list[np.ndarray]
    metric: str = "euclidean"

    def visits(self, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Which rings (columns) each query (row) visits, and the bound on its k-th neighbour's distance."""
        d = _apart(q, self.pivots, self.metric)
        near = np.concatenate([d[:, [i]] + x[None, :] for i, x in enumerate(self.first) if len(x)], 1)
        bound = np.partition(near, k - 1, 1)[:, k - 1] if near.shape[1] >= k else np.full(len(q), np.inf)
        to = d[:, self.cell]
        least = np.maximum(0, np.maximum(to - self.high, self.low - to))
        if self.metric == "euclidean":
            own = d.argmin(1)
            between = _apart(self.pivots, self.pivots, self.metric)[own][:, self.cell]
            with np.errstate(divide="ignore", invalid="ignore"):
                plane = (to**2 - d[np.arange(len(q)), own][:, None] ** 2) / (2 * between)
            least = np.maximum(least, np.where(between > 0, plane, 0))
        slack = 1e-9 * (1 + bound + d.max(1))  # rounding of distances
        return least <= (bound + slack)[:, None], bound


def _deal(bounds: Bounds, k: int):
    """A row for each block that a query visits."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            goes, _ = bounds.visits(_matrix(b.column(1), bounds.pivots.shape[1]), k)
            row, ring = np.nonzero(goes)
            n = bounds.blocks[ring]
            row, ring = np.repeat(row, n), np.repeat(ring, n)
            part = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            for i in range(0, len(row), 4096):  # vectors are repeated, so batches stay small
                r = pa.array(row[i : i + 4096])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(r), b.column(1).take(r), pa.array(bounds.cell[ring[i : i + 4096]].astype(np.int32)), pa.array(bounds.ring[ring[i : i + 4096]].astype(np.int32)), pa.array(part[i : i + 4096].astype(np.int32))],
                    ["id", "v", "cell", "ring", "part"],
                )

    return f


def _visits(bounds: Bounds, k: int):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(bounds.cell), np.int64)
        for b in batches:
            n += bounds.visits(_matrix(b.column(1), bounds.pivots.shape[1]), k)[0].sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(bounds.cell.astype(np.int32)), pa.array(bounds.ring.astype(np.int32)), pa.array(n)], ["cell", "ring", "n"])

    return f


def _search(k: int, dim: int, itself: bool, metric: str):
    """Rows come sorted by block, the block's own rows (side 0) first; queries pass by in batches."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, rows = None, [], []
        held: tuple[np.ndarray, np.ndarray] | None = None
        for b in batches:
            key = list(zip(*(b.column(i).to_pylist() for i in range(5))))  # cell, ring, part, copy, side
            i = 0
            while i < len(key):
                j = i + 1
                while j < len(key) and key[j] == key[i]:
                    j += 1
                part = b.slice(i, j - i)
                if key[i][:4] != now:
                    now, ids, rows, held = key[i][:4], [], [], None
                v, own = _matrix(part.column(6), dim), part.column(5).to_numpy()
                if key[i][4] == 0:
                    ids.append(own)
                    rows.append(v)
                elif ids:
                    held = held or (np.concatenate(ids), np.concatenate(rows))
                    yield from _nearest(own, v, *held)
                i = j

    def _nearest(qid, q, ids, x):
        for s in range(0, len(q), 256):
            at, out_q, out_n, out_d = qid[s : s + 256], [], [], []
            for i, d in zip(at, (_to(x, y, metric) for y in q[s : s + 256])):
                use = np.flatnonzero(ids != i) if not itself else np.arange(len(ids))
                if len(use) > k:
                    cut = np.partition(d[use], k - 1)[k - 1]
                    use = use[d[use] <= cut]  # ties included
                use = use[np.lexsort((ids[use], d[use]))][:k]
                out_q.append(np.full(len(use), i))
                out_n.append(ids[use])
                out_d.append(d[use])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_q)), pa.array(np.concatenate(out_n)), pa.array(np.concatenate(out_d)), pa.array(np.concatenate([np.append(len(ids), np.zeros(len(o) - 1)) if len(o) else o for o in out_q]).astype(np.int64))], ["id", "neighbour", "distance", "seen"])

    return f


def _vectors(df: DataFrame, id: str, vector: str, dim: int) -> DataFrame:
    """``id, v`` of the vectors with dim components, none null or not finite."""
    x = F.col(vector)
    return df.where(x.isNotNull() & (F.size(x) == dim)).where(F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))).select(F.col(id).cast("long").alias("id"), F.transform(x, lambda e: e.cast("double")).alias("v")).where("id is not null")


def bounds_of(celled: DataFrame, pivots: np.ndarray, k: int, rings: int = RINGS, block: int = BLOCK, metric: str = "euclidean") -> tuple[Bounds, DataFrame]:
    """Bounds of celled rows (id, v, cell, d), and these with their ``ring`` and ``part``."""
    edges = celled.groupBy("cell").agg(F.count("*").alias("n"), F.percentile_approx("d", F.array(*[F.lit(i / rings) for i in range(1, rings)]) if rings > 1 else F.array(F.lit(0.5)), F.lit(2000)).alias("edges")).collect()  # a row a pivot
    cut = {r["cell"]: sorted(set(r["edges"])) if r["n"] > block else [] for r in edges}
    table = F.create_map(*[x for c, e in cut.items() for x in (F.lit(c), F.array(*map(F.lit, e)) if e else F.array().cast("array<double>"))]) if cut else None
    ringed = celled.withColumn("ring", F.size(F.filter(F.element_at(table, F.col("cell")), lambda e: e < F.col("d")))) if cut else celled.withColumn("ring", F.lit(0))
    found = ringed.groupBy("cell", "ring").agg(F.count("*").alias("n"), F.min("d").alias("low"), F.max("d").alias("high")).orderBy("cell", "ring").collect()  # a row a ring
    w = Window.partitionBy("cell").orderBy("d")
    near = [np.zeros(0)] * len(pivots)
    # The first k of each cell: partial heaps by task, so that a large cell is not sorted.
    least = celled.select("cell", "d").mapInArrow(_first(k), "cell int, d double").withColumn("i", F.row_number().over(w)).where(F.col("i") <= k).groupBy("cell").agg(F.collect_list("d").alias("d")).collect()
    for r in least:
        near[r["cell"]] = np.sort(np.array(r["d"]))
    blocks = np.array([-(-r["n"] // block) for r in found], np.int64)
    made = Bounds(pivots, *(np.array([r[c] for r in found]) for c in ("cell", "ring")), blocks, *(np.array([r[c] for r in found], float) for c in ("low", "high")), near, metric)
    parts = F.create_map(*[x for r, n in zip(found, blocks) for x in (F.lit(r["cell"] * 4096 + r["ring"]), F.lit(int(n)))]) if found else None
    part = F.pmod(F.xxhash64("id"), F.element_at(parts, F.col("cell") * 4096 + F.col("ring"))).cast("int") if found else F.lit(0)
    return made, ringed.withColumn("part", part)


def _first(k: int):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, np.ndarray] = {}
        for b in batches:
            cell, d = b.column(0).to_numpy(), b.column(1).to_numpy()
            for c in np.unique(cell):
                x = np.concatenate([best.get(c, np.zeros(0)), d[cell == c]])
                best[c] = np.sort(x)[:k]
        for c, x in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), c, np.int32)), pa.array(x)], ["cell", "d"])

    return f


def nearest(base: DataFrame, queries: DataFrame, k: int = 5, id: str = "id", vector: str = "features", dim: int | None = None, itself: bool = False, pivots: int = PIVOTS, rings: int = RINGS, block: int = BLOCK, queries_of: int = QUERIES, metric: str = "euclidean") -> DataFrame:
    """``id, neighbour, rank, distance, seen`` of the k nearest rows of base (ties: smaller id; metric: euclidean or chebyshev) for each query.

    Rows of base with the query's own id count only if ``itself``.  Vectors of
    another length than ``dim`` (by default the first query's), with null or
    infinite components or a null id are left out.  ``seen`` is the number of
    rows that the query was compared with.  Ids of base must be unique.
    """
    spark = base.sparkSession
    if dim is None:
        head = queries.where(F.col(vector).isNotNull()).select(F.size(vector).alias("n")).first()
        dim = head["n"] if head else 1
    b, q = _vectors(base, id, vector, dim), _vectors(queries, id, vector, dim)
    taken = b.orderBy(F.xxhash64("id"), "id").limit(pivots).collect()  # pivots rows
    schema = "id long, neighbour long, rank int, distance double, seen long"
    if not taken:
        return spark.createDataFrame([], schema)
    middle = np.unique(np.array([r["v"] for r in taken], float), axis=0)
    celled = b.mapInArrow(_cells(middle, metric), "id long, v array<double>, cell int, d double")
    reach = k if itself else k + 1  # one of the rows that bound the distance may be the query itself
    bounds, dealt = bounds_of(celled, middle, reach, rings, block, metric)
    asked = q.mapInArrow(_deal(bounds, reach), "id long, v array<double>, cell int, ring int, part int")
    copies = {(r["cell"], r["ring"]): -(-r["n"] // queries_of) for r in q.mapInArrow(_visits(bounds, reach), "cell int, ring int, n long").groupBy("cell", "ring").agg(F.sum("n").alias("n")).collect() if r["n"] > queries_of}
    often = F.lit(1)
    if copies:
        often = F.coalesce(F.try_element_at(F.create_map(*[x for (c, r), n in copies.items() for x in (F.lit(c * 4096 + r), F.lit(n))]), F.col("cell") * 4096 + F.col("ring")), F.lit(1))
    mine = dealt.withColumn("copy", F.explode(F.sequence(F.lit(0), often - 1))).withColumn("side", F.lit(0))
    theirs = asked.withColumn("copy", F.pmod(F.xxhash64("id"), often).cast("int")).withColumn("side", F.lit(1))
    order = ["cell", "ring", "part", "copy", "side"]
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = mine.select(*order, "id", "v").union(theirs.select(*order, "id", "v")).repartition(tasks, *order[:4]).sortWithinPartitions(*order)
    lists = met.mapInArrow(_search(k, dim, itself, metric), "id long, neighbour long, distance double, seen long")
    # Of each list only the first row carries what was seen there.
    best = lists.groupBy("id").agg(F.slice(F.array_sort(F.collect_list(F.struct("distance", "neighbour"))), 1, k).alias("n"), F.sum(F.col("seen")).alias("seen"))
    return best.select("id", F.posexplode("n").alias("rank", "n"), "seen").select("id", F.col("n.neighbour").alias("neighbour"), (F.col("rank") + 1).alias("rank"), F.col("n.distance").alias("distance"), "seen")


def vote(neighbours: DataFrame, labels: DataFrame, id: str = "id", label: str = "label", weighted: bool = True) -> DataFrame:
    """``id, prediction``: the label of most weight among each query's neighbours (ties: the smaller); weights are 1 / distance, or only neighbours at distance 0 where there are any."""
    n = _weighted(neighbours, labels, id, label, weighted)
    return n.groupBy("id", "y").agg(F.sum("w").alias("w")).groupBy("id").agg(F.min_by("y", F.struct(-F.col("w"), "y")).alias("prediction"))


def mean(neighbours: DataFrame, labels: DataFrame, id: str = "id", label: str = "label", weighted: bool = True) -> DataFrame:
    """``id, prediction``: the weighted mean of the neighbours' labels."""
    return _weighted(neighbours, labels, id, label, weighted).groupBy("id").agg((F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("prediction"))


def _weighted(neighbours: DataFrame, labels: DataFrame, id: str, label: str, weighted: bool) -> DataFrame:
    y = labels.select(F.col(id).alias("_i"), F.col(label).alias("y")).where("y is not null")
    n = neighbours.join(y, F.col("neighbour") == F.col("_i")).select("id", "distance", "y")
    if not weighted:
        return n.withColumn("w", F.lit(1.0))
    zero = F.max(F.col("distance") == 0).over(Window.partitionBy("id"))  # k rows
    return n.withColumn("w", F.when(zero, F.when(F.col("distance") == 0, 1.0).otherwise(0.0)).otherwise(1.0 / F.nullif(F.col("distance"), F.lit(0.0))))
