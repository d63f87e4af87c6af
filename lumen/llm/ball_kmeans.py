"""Centroid clustering by ball k-means on integer vectors.

Each cluster is a ball: a centroid, and a radius that no member exceeds.  After
the centroids have moved, only centroids within twice the radius can take a
member; these are the cluster's neighbours, in order of distance.  A member that
is nearer to its centroid than half the way to the first neighbour is in the
stable core and keeps its cluster unseen; one between half the ways to the m-th
and the next neighbour lies in the m-th annulus and is compared exactly with the
first m neighbours only.

Scale: a round is one pass over the vectors without a shuffle, written to the
shared folder with each vector's cluster (the round before is dropped then), and
one aggregation of sums, which are pre-aggregated by task.  The driver holds k
centroids and the k * k distances between them.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumen.llm.shared import drop, prepare, shared_dir, stage

#: A component beyond this counts as this, so that distances of up to 64 components fit 64 bits.
LARGEST = 1 << 27
_SCHEMA = "vec_id long, v array<long>, cluster int, distance long"


def integers(vectors: DataFrame, dim: int, scale: int, id: str, column: str) -> DataFrame:
    """``vec_id, v`` of the vectors with dim components, none null or not finite; v is floor(scale * x) of each."""
    x = F.col(column)
    whole = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < float("inf")))
    scaled = F.transform(x, lambda e: F.greatest(F.least(F.floor(F.lit(float(scale)) * F.greatest(F.least(e.cast("double"), F.lit(1e12)), F.lit(-1e12))), F.lit(LARGEST)), F.lit(-LARGEST)))
    return vectors.where(x.isNotNull() & (F.size(x) == dim) & whole).select(F.col(id).cast("long").alias("vec_id"), scaled.alias("v"))


class Balls:
    """Centroids with, for each, its neighbours in order of distance and the squared distances to them."""

    def __init__(self, centroids: np.ndarray, radii: np.ndarray | None = None):
        self.centroids = centroids
        apart = ((centroids[:, None, :] - centroids[None, :, :]) ** 2).sum(2)
        self.near: list[np.ndarray] = []
        self.apart: list[np.ndarray] = []
        for i in range(len(centroids)):
            j = np.array([x for x in range(len(centroids)) if x != i], np.int64)
            if radii is not None:
                j = j[apart[i, j] <= 4 * radii[i] ** 2 * (1 + 1e-9) + 1]
            j = j[np.lexsort((j, apart[i, j]))]
            self.near.append(j)
            self.apart.append(apart[i, j])

    def assign(self, x: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Nearest centroid of each row of x, the squared distance, and the number of distances taken; own: the balls that the rows are in."""
        c = self.centroids
        best, to = ((x - c[own]) ** 2).sum(1), own.copy()
        taken = len(x)
        for i in np.unique(own):
            rows = np.flatnonzero(own == i)
            ring = np.searchsorted(self.apart[i], 4 * best[rows], "right")  # 0: stable core
            rows, ring = rows[ring > 0], ring[ring > 0]
            for m in range(int(ring.max()) if len(ring) else 0):
                j, at = int(self.near[i][m]), rows[ring > m]
                d = ((x[at] - c[j]) ** 2).sum(1)
                taken += len(at)
                wins = (d < best[at]) | ((d == best[at]) & (j < to[at]))
                best[at[wins]], to[at[wins]] = d[wins], j
        return to, best, taken


def _pass(balls: Balls, dim: int):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)
            to, d, _ = balls.assign(x, b.column(2).to_numpy().astype(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(to.astype(np.int32)), pa.array(d)], ["vec_id", "v", "cluster", "distance"])

    return f


def ball_kmeans(vectors: DataFrame, k: int = 40, rounds: int = 5, dim: int = 64, scale: int = 256, seed: int = 2, id: str = "vec_id", column: str = "embedding") -> tuple[DataFrame, list[list[int]]]:
    """``vec_id, cluster, distance, cluster_inertia, inertia`` of each vector kept, and the centroids.

    Centroids start as the k vectors with the smallest SHA-256 of
    ``<seed>:<id>`` (a null id counts as the empty one; equal ids: the smaller
    vector first; fewer vectors than k: all).  ``rounds`` times each vector goes
    to its nearest centroid (ties: the smaller number) and each centroid with
    vectors to their floored mean; then vectors are assigned once more.  Vectors
    of another length or with components null or not finite are left out,
    components beyond ``LARGEST`` count as that.  No vectors: no rows.
    """
    spark = vectors.sparkSession
    prepare(spark)
    root = shared_dir(spark)
    ready = integers(vectors, dim, scale, id, column)
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    centroids = [[int(x) for x in r["v"]] for r in ready.select("v", hashed.alias("h")).orderBy("h", "v").limit(k).collect()]
    if not centroids:
        return ready.select("vec_id", F.lit(0).alias("cluster"), *[F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")]).where(F.lit(False)), []

    now = ready.select("vec_id", "v", F.lit(0).alias("cluster"))
    balls, last = Balls(np.array(centroids, np.int64)), None
    for i in range(rounds + 1):
        path = f"round{i}"
        now = stage(now.select("vec_id", "v", "cluster").mapInArrow(_pass(balls, dim), _SCHEMA), path, root)
        if last:
            drop(spark, f"{root}/{last}")  # read for the last time
        last = path
        if i == rounds:
            break
        sums = now.groupBy("cluster").agg(F.count("*").alias("n"), F.max("distance").alias("far"), *[F.sum(F.col("v")[j]).alias(f"s{j}") for j in range(dim)]).collect()
        old = np.array(centroids, np.int64)
        radii = np.zeros(len(centroids))
        for r in sums:
            centroids[r["cluster"]] = [r[f"s{j}"] // r["n"] for j in range(dim)]
            radii[r["cluster"]] = math.sqrt(r["far"])
        new = np.array(centroids, np.int64)
        balls = Balls(new, radii + np.sqrt(((new - old) ** 2).sum(1).astype(float)))  # a ball about the new centroid that still holds all members
    total = now.groupBy("cluster").agg(F.try_sum("distance").alias("cluster_inertia"))
    both = total.join(F.broadcast(total.agg(F.try_sum("cluster_inertia").alias("inertia"))))  # one row
    both = both.withColumnRenamed("cluster", "_cluster")
    out = now.join(F.broadcast(both), F.col("cluster") == F.col("_cluster"))  # k rows
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia"), centroids


def centroid_digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def query(spark, sf_dir: str) -> DataFrame:
    """op13: the clusters of all embeddings."""
    from lumen.llm.shared import read

    out, centroids = ball_kmeans(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    names = F.array(*[F.lit(centroid_digest(c)) for c in centroids]) if centroids else F.array(F.lit(""))
    return out.withColumn("centroid_sha256", F.get(names, F.col("cluster")))


def _oracle(k: int = 40, rounds: int = 5, dim: int = 64) -> str:
    near = "select w.vec_id, min({{'d': w.q - 2 * list_inner_product(w.f, c.f) + list_inner_product(c.f, c.f), 'c': c.c}}) as m from w, c{i} c group by w.vec_id"
    moved = (
        "select o.c, coalesce(m.f, o.f) as f from c{i} o left join (select c, list(x order by p) as f from (select c, p, floor(sum(x) / count(*)) as x "
        f"from (select a.m.c as c, unnest(w.f) as x, unnest(range({dim})) as p from a{{i}} a join w using (vec_id)) group by c, p) group by c) m using (c)"
    )
    ctes = [
        f"v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as f from embeddings where len(embedding) = {dim} and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {dim})",
        "w as materialized (select vec_id, f, list_inner_product(f, f) as q from v)",
        f"c0 as materialized (select c, f from (select row_number() over (order by sha256('2:' || vec_id)) - 1 as c, f from w) where c < {k})",
    ]
    for i in range(rounds):
        ctes.append(f"a{i} as materialized ({near.format(i=i)})")
        ctes.append(f"c{i + 1} as materialized ({moved.format(i=i)})")
    ctes.append(f"a{rounds} as materialized ({near.format(i=rounds)})")
    ctes.append(f"s as (select c, sha256(array_to_string(list_transform(f, lambda x: x::bigint), ',')) as h from c{rounds})")
    return (
        "with " + ",\n".join(ctes) + f"\nselect vec_id, m.c::int as cluster, m.d::bigint as distance, (sum(m.d::bigint) over (partition by m.c))::bigint as cluster_inertia, "
        f"(sum(m.d::bigint) over ())::bigint as inertia, h as centroid_sha256 from a{rounds} join s on s.c = m.c"
    )


ORACLE = _oracle()
