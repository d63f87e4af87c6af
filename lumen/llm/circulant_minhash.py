"""Near-duplicate classes by circulant MinHash, banding, and exact Jaccard verification.

Two permutations of the 32-bit universe make the whole signature: the first
scatters a text's shingles once, the second, shifted circularly by k, gives the
k-th coordinate as its least value over them.  Coordinates go in bands; texts
that agree on a band meet in a bucket, and what is linked among them is found
from their full sets.

Two texts at the limit of 0.85 agree on none of 40 bands of 5 with a chance of
6e-11.  Texts with equal sets are one class before anything is compared.
Buckets give one edge a member, to their smallest (a hot bucket is split by
ranges), and the buckets' connected components are families.  A family of up to
``BLOCK`` classes and ``BYTES`` bytes is searched whole by one task, with
inverted lists of each set's rarest shingles and exact counts.  In larger ones
first one edge of each member is verified, then the other edges of members in
buckets that are not yet connected; only what such buckets still leave apart is
searched in pairs of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumen.llm import ngram_jaccard as sets
from lumen.llm.graph import components
from lumen.llm.shared import prepare, shared_dir, stage
from lumen.llm.words import U, mix, slices

#: Classes, and bytes of their sets, of one block of a family.
BLOCK, BYTES = 4096, 16 << 20
BANDS, ROWS = 40, 5

_V = np.uint32


def permute(x: np.ndarray, a: int, b: int) -> np.ndarray:
    """A permutation of the 32-bit numbers: xor-shifts and two odd factors; x is overwritten."""
    t = np.empty_like(x)
    for shift, factor in ((16, a), (15, b), (16, None)):
        np.right_shift(x, _V(shift), out=t)
        np.bitwise_xor(x, t, out=x)
        if factor:
            np.multiply(x, _V(factor), out=x)
    return x


def scatter(items: np.ndarray) -> np.ndarray:
    """The first permutation, of the lower half of 64-bit shingle hashes."""
    return permute(items.astype(_V), 0x7FEB352D, 0x846CA68B)


def signatures(items: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """``size`` coordinates (columns) of each set items[at[i]:at[i+1]]; empty sets have the largest number throughout."""
    out = np.full((len(at) - 1, size), 0xFFFFFFFF, _V)
    full = np.flatnonzero(np.diff(at) > 0)
    if len(full):
        x, begin = scatter(items), at[:-1][full]
        for k in range(size):
            shifted = x - _V(k + 1)  # the second permutation, k + 1 places on
            out[full, k] = np.minimum.reduceat(permute(shifted, 0x2C1B3C6D, 0x297A2D39), begin)
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band (column) of each signature."""
    s = signature.reshape(len(signature), bands, rows).astype(U)
    key = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=U) * U(0x9E3779B97F4A7C15)), s.shape[:2]).copy()
    for r in range(rows):
        key = mix(key ^ (s[:, :, r] + U(r << 32)))
    return key


def _index(k: int, bands: int, rows: int):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in slices(batch, 1, 1 << 20):
                items, at = sets.sets_of(data, offsets, k)
                n, d = np.diff(at), sets.digests(items, at)
                keys = band_keys(signatures(items, at, bands * rows), bands, rows)
                off = np.concatenate([[0], np.cumsum(np.where(n > 0, bands, 0))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n.astype(np.int64)), pa.array(d[:, 0].view(np.int64)), pa.array(d[:, 1].view(np.int64)), pa.ListArray.from_arrays(pa.array(off), pa.array(keys[n > 0].ravel().view(np.int64)))],
                    ["doc_id", "n", "d1", "d2", "keys"],
                )

    return f


def _blocks(reps: DataFrame, block: int, size: int) -> DataFrame:
    """reps (family, n, ..) with the number of ``blocks`` of their family."""
    shape = reps.groupBy("family").agg(F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("n") * 8 / size)).cast("int").alias("blocks"))
    return reps.join(shape, "family")


def _pairs(pairs: DataFrame, held: DataFrame, num: int, den: int) -> DataFrame:
    """Those of pairs (a, b) whose sets in held (rep, items) link."""
    left = pairs.join(held.select(F.col("rep").alias("_a"), F.col("items").alias("x")), F.col("a") == F.col("_a")).select("a", "b", "x")
    both = left.join(held.select(F.col("rep").alias("_b"), F.col("items").alias("y")), F.col("b") == F.col("_b")).select("a", "b", "x", "y")
    return both.mapInArrow(sets._verify(num, den), "a long, b long")


def _open(lists: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows (rep, key, at) of the buckets whose members have more than one root so far."""
    at = lists.join(roots.select(F.col("node").alias("_n"), "root"), F.col("rep") == F.col("_n"), "left").select("rep", "key", F.coalesce("root", "rep").alias("at"))
    apart = at.groupBy("key").agg(F.min("at").alias("x"), F.max("at").alias("y")).where("x < y").select(F.col("key").alias("_k"))
    return at.join(apart, F.col("key") == F.col("_k"), "left_semi")


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 17, den: int = 20, bands: int = BANDS, rows: int = ROWS, id: str = "doc_id", text: str = "text", block: int = BLOCK, size: int = BYTES) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each row of docs; links where intersection / union >= num / den.

    Words are runs of bytes other than space and 09-0D after A-Z become a-z; a
    text of fewer than k words is one shingle.  Null and texts without words
    have the empty set and link to nothing.  Rows with a null id keep their size
    and have a null component, and ``kept`` is null.  Rows that repeat an id are
    compared like any rows, each by its own text.  An empty table gives no rows;
    other columns of docs play no part.
    """
    spark = docs.sparkSession
    prepare(spark)
    root = shared_dir(spark)
    src = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    members = stage(src.mapInArrow(_index(k, bands, rows), "doc_id long, n long, d1 long, d2 long, keys array<long>"), "members", root)
    full = members.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    classes = stage(full.groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep"), F.first("keys").alias("keys")), "classes", root)
    lists = classes.select("rep", F.explode("keys").alias("key"))
    stars = stage(sets._stars(lists), "stars", root)
    families = stage(sets._families(stars), "families", root)

    reps = families.withColumnRenamed("rep", "_r").join(full.select("doc_id", "n", "d1"), F.col("_r") == F.col("doc_id")).select(F.col("doc_id").alias("rep"), "family", "n", "d1").distinct()
    shaped = stage(_blocks(reps, block, size), "reps", root)

    def held(some: DataFrame) -> DataFrame:
        # Texts are shuffled at every size, so that small inputs show what large ones cost.
        found = src.join(some.select("rep", "d1", "family", "blocks").hint("merge"), F.col("doc_id") == F.col("rep"))
        found = found.select("doc_id", "text", "d1", "family", "blocks", F.lit(None).cast("long").alias("star"))
        return found.mapInArrow(sets._sets(k), "rep long, family long, blocks int, star long, items binary").drop("star").dropDuplicates(["rep"])

    whole = sets._join_blocks(held(shaped.where("blocks = 1")), num, den)
    large = shaped.where("blocks > 1")
    if large.isEmpty():  # each family is searched whole
        roots = stage(whole, "joined", root).select(F.col("a").alias("node"), F.col("b").alias("root"))
    else:
        big = stage(held(large), "sets", root)
        spokes = stars.join(large.select(F.col("rep").alias("_l")), F.col("a") == F.col("_l"), "left_semi")
        first = spokes.groupBy("a").agg(F.min("b").alias("b"))
        links = stage(_pairs(first, big, num, den).union(whole), "links", root)
        mine = lists.join(large.select(F.col("rep").alias("_l")), F.col("rep") == F.col("_l"), "left_semi")
        # Every other edge of the members of buckets that are not yet connected.
        near = stage(components(links), "near", root)
        ask = stage(_open(mine, near).select(F.col("rep").alias("_o"), F.col("at").alias("_at")).distinct(), "open", root)
        other = spokes.join(ask, F.col("a") == F.col("_o")).join(ask.select(F.col("_o").alias("_p"), F.col("_at").alias("_bt")), F.col("b") == F.col("_p")).where("_at <> _bt").select("a", "b")
        more = stage(_pairs(other, big, num, den).union(links), "more", root)
        rest = sets._families(sets._stars(_open(mine, stage(components(more), "nearer", root)))).distinct()
        rest = rest.withColumnRenamed("rep", "_rep").join(large.select("rep", "n"), F.col("_rep") == F.col("rep")).select("_rep", F.col("family").alias("_family"), F.col("n"))
        rest = _blocks(rest.withColumnRenamed("_family", "family"), block, size).select("_rep", F.col("family").alias("_family"), F.col("blocks").alias("_blocks"))
        again = big.join(stage(rest, "rest", root), F.col("rep") == F.col("_rep")).select("rep", F.col("_family").alias("family"), F.col("_blocks").alias("blocks"), "items")
        roots = components(stage(sets._join_blocks(again, num, den).union(more), "joined", root))

    named = classes.select("n", "d1", "d2", "rep").join(roots, F.col("rep") == F.col("node"), "left").select(F.col("n").alias("_n"), F.col("d1").alias("_d1"), F.col("d2").alias("_d2"), F.coalesce("root", "rep").alias("component"))
    named = stage(named, "named", root)  # a plain scan, so that a hot class's join is split
    out = members.drop("keys").join(named, (F.col("n") == F.col("_n")) & (F.col("d1") == F.col("_d1")) & (F.col("d2") == F.col("_d2")), "left")
    own = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), (F.col("doc_id") == own).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    """op11: classes of near duplicates of documents by 5-word shingles at 0.85."""
    from lumen.llm.shared import read

    return near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE = r"""
with recursive d as (select doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) as w from documents),
s as (select distinct doc_id, array_to_string(w[i:i + 4], ' ') as g from (select doc_id, w, unnest(case when len(w) = 0 then [] else range(1, greatest(len(w) - 3, 2)) end) as i from d)),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as x, b.doc_id as y, count(*) as o from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
e as (select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where 100 * o >= 85 * (a.n + b.n - o)),
r as (select x as doc_id, x as c from e union select r.doc_id, e.y from r join e on e.x = r.c),
f as (select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, least(d.doc_id, coalesce(m.c, d.doc_id)) as component_id
from d left join n using (doc_id) left join (select doc_id, min(c) as c from r group by doc_id) m using (doc_id))
select *, doc_id = component_id as kept from f
"""
