"""N-gram Jaccard join by a size-aware heavy-light split.

Documents with equal shingle sets are one class.  Small sets (light) enumerate
the subsets of the fixed size that a link demands for each partner size, so two
light sets that link share such a subset.  Large sets (heavy) are cut by
shingle hash into one part more than a link may leave differing, so that two
linked sets agree on a whole part; a part's inverted list holds the sets that
have it.  The boundary minimises the cost of the two, from the sizes of all
sets.  Sets that meet in any list form families; within a family the exact join
scans inverted lists of shingles, rarest first.

Scale and skew: lists yield one edge per member, never pairs.  They are dealt by
ranges of list and member, so that a hot list is split; a range links its members
to their smallest, and the smallest of a list's ranges are linked in turn.
Classes take exact copies out before anything is compared.  Families of up to
``BLOCK`` classes and ``BYTES`` bytes are joined whole in one task.  Of larger
ones, one edge of each member to a list's smallest is verified first: a list
whose members are thereby connected is done, so a large group of near copies
costs one check a member.  Only what meets in the other lists is joined in pairs of blocks, of
which there are as many as the square of its blocks.  Shingles are compared as
64-bit hashes of hashes of their words, sets as 128-bit digests with their size.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumen.llm.graph import components
from lumen.llm.shared import prepare, release, shared_dir, stage
from lumen.llm.words import LOWER, U, Words, inside, mix, ranges, slices, window_hashes

#: Classes, and bytes of their sets, of one block of a family; a task joins two blocks at most, and takes about six times their bytes.
BLOCK, BYTES = 4096, 64 << 20
#: Bytes of text that a worker makes into sets at once; it gives its memory back after each partition.
SLICE = 1 << 20
#: Sizes from which subsets are never enumerated.
MOST_LIGHT = 40
#: Levels of parts; a set that has an empty part on one is cut anew on the next.
LEVELS = 5


def overlap(n: int, m: int, num: int, den: int) -> int:
    """Least intersection of sets of n and m elements for num / den of the union."""
    return -(-num * (n + m) // (num + den))


def sets_of(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, and where each text's begin."""
    w = Words(LOWER[data], offsets)
    h, n = w.hashes(), w.counts()
    starts = inside(w.first, k, len(w))
    shingle = window_hashes(h, k)[starts] if len(starts) else np.zeros(0, U)
    full = np.maximum(n - k + 1, 0)
    bounds = np.concatenate([[0], np.cumsum(full)])
    out = []
    for i in range(len(n)):
        if full[i]:
            out.append(np.unique(shingle[bounds[i] : bounds[i + 1]]))
        elif n[i]:
            out.append(window_hashes(h[w.first[i] : w.first[i + 1]], int(n[i])) ^ U(int(n[i])))
        else:
            out.append(np.zeros(0, U))
    return np.concatenate(out) if out else np.zeros(0, U), np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int64)


def digests(items: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Two order-free 64-bit sums for each set."""
    out = np.zeros((len(at) - 1, 2), U)
    for j, salt in enumerate((0x51ED270B, 0xA0761D64)):
        total = np.concatenate([np.zeros(1, U), np.cumsum(mix(items ^ U(salt)), dtype=U)])
        out[:, j] = mix(total[at[1:]] - total[at[:-1]])
    return out


@lru_cache(maxsize=4096)
def _subsets(n: int, c: int) -> np.ndarray:
    return np.array(list(itertools.combinations(range(n), c)), np.int64).reshape(-1, c)


def partners(n: int, num: int, den: int) -> range:
    return range(-(-n * num // den), n * den // num + 1)


def light_keys(items: np.ndarray, num: int, den: int) -> np.ndarray:
    """One key for each subset of the size that a link to a set of each size demands."""
    n, x, out = len(items), mix(items ^ U(0x2545F491)), []
    for m in partners(n, num, den):
        c = overlap(n, m, num, den)
        if c <= min(n, m):
            total = np.array([x[s].sum(dtype=U) for s in _subsets(n, c)], U) if c else np.zeros(1, U)
            out.append(mix(total ^ mix(np.array([min(n, m) << 32 | max(n, m)], U))))
    return np.unique(np.concatenate(out)) if out else np.zeros(0, U)


def light_cost(n: int, num: int, den: int) -> int:
    return sum(math.comb(n, c) for m in partners(n, num, den) if (c := overlap(n, m, num, den)) <= min(n, m))


def band_of(n: np.ndarray) -> np.ndarray:
    return np.floor(np.log(np.maximum(n, 1)) / math.log(1.5) + 1e-9).astype(np.int64)


def parts_of(band: np.ndarray, num: int, den: int) -> np.ndarray:
    """Parts for sets of a band: one more than the elements by which linked sets differ there."""
    top = np.floor(1.5 ** (band + 1.0)).astype(np.int64) + 1
    return top * (den - num) // num + 1


def heavy_keys(items: np.ndarray, at: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(set, key) of the parts of each set, in its own band and in the next where a partner may be."""
    n = np.diff(at)
    sets, keys = [], []
    own = band_of(n)
    up = band_of(n * den // num)
    for shift in (0, 1):
        todo = np.flatnonzero((n > 0) & (own + shift <= up))
        band = own[todo] + shift
        for level in range(LEVELS):
            if not len(todo):
                break
            p = parts_of(band, num, den)
            base = np.concatenate([[0], np.cumsum(p)])
            x = items[ranges(at[todo], n[todo])]
            y = mix(x ^ U(0x1000193 * (level + 1)))
            slot = (y % np.repeat(p, n[todo]).astype(U)).astype(np.int64) + np.repeat(base[:-1], n[todo])
            z = mix(x ^ U(0xC2B2AE35))
            lo = np.bincount(slot, (z & U(0xFFFFFFFF)).astype(np.float64), base[-1])
            hi = np.bincount(slot, (z >> U(32)).astype(np.float64), base[-1])
            full = np.bincount(slot, minlength=base[-1])
            place = ranges(np.zeros(len(p), np.int64), p).astype(U)
            key = mix(mix(lo.astype(U)) ^ hi.astype(U) ^ mix((np.repeat(band, p).astype(U) << U(40)) | (U(level) << U(32)) | place))
            owner = np.repeat(todo, p)
            use = full > 0 if level < LEVELS - 1 else np.ones(len(full), bool)
            sets.append(owner[use])
            keys.append(key[use])
            empty = np.unique(owner[full == 0])
            stay = np.isin(todo, empty)
            todo, band = todo[stay], band[stay]
    if not sets:
        return np.zeros(0, np.int64), np.zeros(0, U)
    return np.concatenate(sets), np.concatenate(keys)


def boundary(sizes: dict[int, int], num: int, den: int) -> int:
    """The size up to which enumerating subsets costs fewer list entries than parts and scans."""
    best, cost, least = 0, 0.0, 0.0
    for n in range(1, MOST_LIGHT + 1):
        heavy = 2 * int(parts_of(band_of(np.array([n])), num, den)[0]) + n / 8
        cost += sizes.get(n, 0) * (light_cost(n, num, den) - heavy)
        if cost <= least and light_cost(n, num, den) <= 4096:
            best, least = n, cost
    return best


def _sizes(k: int):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offsets in slices(batch, 0, SLICE):
                _, at = sets_of(data, offsets, k)
                n, c = np.unique(np.diff(at), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(n.astype(np.int64)), pa.array(c.astype(np.int64))], ["n", "c"])
        release()

    return f


def _index(k: int, num: int, den: int, light: int):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in slices(batch, 1, SLICE):
                items, at = sets_of(data, offsets, k)
                n, d = np.diff(at), digests(items, at)
                few = (n <= light) & (n > 0)
                also = few & (n * den // num > light)
                keep = np.flatnonzero(~few | also)
                sub = np.concatenate([[0], np.cumsum(n[keep])])
                owner, key = heavy_keys(items[ranges(at[keep], n[keep])], sub, num, den)
                owners, keys = [keep[owner] if len(owner) else owner], [key]
                for i in np.flatnonzero(few):
                    x = light_keys(items[at[i] : at[i + 1]], num, den)
                    owners.append(np.full(len(x), i))
                    keys.append(x)
                owner, key = np.concatenate(owners), np.concatenate(keys)
                order = np.argsort(owner, kind="stable")
                off = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(n)))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n.astype(np.int64)), pa.array(d[:, 0].view(np.int64)), pa.array(d[:, 1].view(np.int64)), pa.ListArray.from_arrays(pa.array(off), pa.array(key[order].view(np.int64)))],
                    ["doc_id", "n", "d1", "d2", "keys"],
                )
        release()

    return f


def _sets(k: int):
    """Sets of the documents that represent a class: rows (rep, family, blocks, star, items) from (doc_id, text, d1, family, blocks, star)."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in slices(batch, 1, SLICE):
                items, at = sets_of(data, offsets, k)
                d = digests(items, at)
                ok = pa.array(d[:, 0].view(np.int64) == part.column(2).to_numpy())
                blob = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at * 8), pa.py_buffer(items.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), *(part.column(i) for i in (3, 4, 5)), blob], ["rep", "family", "blocks", "star", "items"]).filter(ok)
        release()

    return f


def _verify(num: int, den: int):
    """Of rows (a, b, items, items) the pairs that link."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, U), np.frombuffer(y, U)
                ok.append(len(np.intersect1d(x, y, assume_unique=True)) >= overlap(len(x), len(y), num, den))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))
        release()

    return f


def links_within(ids: np.ndarray, sets: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """The smallest id that each set reaches by links among these sets: inverted lists of each set's rarest shingles, then exact counts."""
    n = np.array([len(s) for s in sets], np.int64)
    order = np.lexsort((ids, n))
    flat = np.concatenate([sets[i] for i in order])
    n = n[order]
    at = np.concatenate([[0], np.cumsum(n)])
    _, code, df = np.unique(flat, return_inverse=True, return_counts=True)
    parent = np.arange(len(n))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    lists: dict[int, list[int]] = {}
    flag = np.zeros(len(df), bool)
    for i in range(len(n)):
        own = code[at[i] : at[i + 1]]
        rare = own[np.lexsort((own, df[own]))][: n[i] - (-(-int(n[i]) * num // den)) + 1]
        rare = rare[df[rare] > 1]
        near: set[int] = set()
        for c in rare.tolist():
            got = lists.setdefault(c, [])
            near.update(got)
            got.append(i)
        if not near:
            continue
        flag[own] = True
        for j in sorted(near, reverse=True):
            if n[j] * den < n[i] * num:
                break
            a, b = find(i), find(j)
            if a != b and flag[code[at[j] : at[j + 1]]].sum() >= overlap(int(n[i]), int(n[j]), num, den):
                parent[max(a, b)] = min(a, b)
        flag[own] = False
    root = np.array([find(i) for i in range(len(n))])
    least = np.full(len(n), np.iinfo(np.int64).max)
    np.minimum.at(least, root, ids[order])
    out = np.empty(len(n), np.int64)
    out[order] = least[root]
    return out


def _join(num: int, den: int):
    """Rows come sorted by task; each task's sets are joined when they are complete."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(ids, sets):
            ids = np.array(ids, np.int64)
            root = links_within(ids, sets, num, den)
            x = root != ids
            return pa.RecordBatch.from_arrays([pa.array(ids[x]), pa.array(root[x])], ["a", "b"])

        now, ids, sets = None, [], []
        for batch in batches:
            for task, i, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if task != now and ids:
                    yield done(ids, sets)
                    ids, sets = [], []
                now = task
                ids.append(i)
                sets.append(np.frombuffer(blob, U))
        if ids:
            yield done(ids, sets)
            release()

    return f


def _families(edges: DataFrame) -> DataFrame:
    """``rep, family`` of every end of edges (a, b)."""
    found = components(edges)
    return found.select(F.col("node").alias("rep"), F.col("root").alias("family")).union(found.select(F.col("root").alias("rep"), F.col("root").alias("family")).distinct())


def _star(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (key, rep) sorted by both: each member with the smallest of its list here (b), and the smallest of the first and the last list, which may go on elsewhere (a null)."""
    key = least = None
    begun = False

    def out(k, a, b):
        return pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["key", "a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        k, r = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        new = np.append(key is None or k[0] != key, k[1:] != k[:-1])
        start = np.maximum.accumulate(np.where(new, np.arange(len(k)), -1))
        low = np.where(start >= 0, r[start], least if least is not None else 0)
        if not begun:
            yield out(k[:1], [None], r[:1])
            begun = True
        x = r != low
        yield out(k[x], r[x], low[x])
        key, least = k[-1], low[-1]
    if begun:
        yield out([key], [None], [least])


def _stars(lists: DataFrame) -> DataFrame:
    """Distinct ``a, b`` that connect the members of each list (key, rep)."""
    parts = int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = lists.select("key", "rep").repartitionByRange(parts, "key", "rep").sortWithinPartitions("key", "rep").mapInArrow(_star, "key long, a long, b long")
    near = stage(near, "stars")
    ends = near.where("a is null").select("key", "b").distinct()  # two a range at most
    least = ends.groupBy("key").agg(F.min("b").alias("m"))
    across = ends.join(least, "key").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return near.where("a is not null").select("a", "b").union(across).distinct()


def _verified(sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs of a set (rep, star, items) and the one that its star names that link."""
    one = sets.where("star is not null").select(F.col("rep").alias("a"), F.col("star").alias("b"), F.col("items").alias("x"))
    both = one.join(sets.select(F.col("rep").alias("_b"), F.col("items").alias("y")), F.col("b") == F.col("_b")).select("a", "b", "x", "y")
    return both.mapInArrow(_verify(num, den), "a long, b long")


def _with_blocks(reps: DataFrame, block: int) -> DataFrame:
    """reps (family, n, ..) with the number of ``blocks`` of their family."""
    shape = reps.groupBy("family").agg(F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("n") * 8 / BYTES)).cast("int").alias("blocks"))
    return reps.join(shape, "family")


def _join_blocks(sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) that connect what links within each family of sets (rep, family, blocks, items). Families of several blocks go in pairs of blocks."""
    parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = sets.withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tasks = tasks.select(F.struct("family", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y")).alias("key"), "rep", "items")
    tasks = tasks.select(F.to_json("key").alias("task"), "rep", "items").repartition(parts, "task").sortWithinPartitions("task")
    return tasks.mapInArrow(_join(num, den), "a long, b long")


def jaccard_components(docs: DataFrame, k: int = 3, num: int = 9, den: int = 10, id: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each row of docs; links where intersection / union >= num / den.

    Words are runs of bytes other than space and 09-0D after A-Z become a-z.
    Null and texts without words have the empty set and link to nothing.  Rows
    with a null id keep their size and have a null component.  Rows that repeat
    an id are compared like any rows, each by its own text.
    """
    spark = docs.sparkSession
    prepare(spark)
    root = shared_dir(spark)
    src = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sizes = src.select("text").mapInArrow(_sizes(k), "n long, c long").where(F.col("n") <= MOST_LIGHT).groupBy("n").agg(F.sum("c").alias("c"))
    light = boundary({r["n"]: r["c"] for r in sizes.collect()}, num, den)  # MOST_LIGHT rows at most

    members = stage(src.mapInArrow(_index(k, num, den, light), "doc_id long, n long, d1 long, d2 long, keys array<long>"), "members", root)
    full = members.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    classes = full.groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep"), F.first("keys").alias("keys"))
    lists = classes.select("rep", F.explode("keys").alias("key"))
    stars = stage(_stars(lists), "edges", root)
    families = stage(_families(stars), "families", root)

    reps = stage(families.join(full.select("doc_id", "n", "d1"), F.col("rep") == F.col("doc_id")).select("rep", "family", "n", "d1").distinct(), "reps", root)
    big = reps.groupBy("family").agg(F.count("*").alias("c"), F.sum("n").alias("s")).where((F.col("c") > block) | (F.col("s") * 8 > BYTES))
    big = stage(big.select(F.col("family").alias("_f")), "big", root)
    is_big, schema = F.col("family") == F.col("_f"), "rep long, family long, blocks int, star long, items binary"

    def sets_of_reps(some: DataFrame) -> DataFrame:
        # Texts are shuffled at every size, so that small inputs show what large ones cost.
        found = src.join(some.hint("merge"), F.col("doc_id") == F.col("rep"))
        return found.select("doc_id", "text", "d1", "family", "blocks", "star").mapInArrow(_sets(k), schema)

    small = _with_blocks(reps.join(big, is_big, "left_anti"), block)
    whole = _join_blocks(sets_of_reps(small.withColumn("star", F.lit(None).cast("long"))), num, den)
    if big.isEmpty():  # each family is joined whole
        roots = stage(whole, "joined", root).select(F.col("a").alias("node"), F.col("b").alias("root"))
    else:
        large = reps.join(big, is_big, "left_semi")
        spokes = stars.groupBy("a").agg(F.min("b").alias("star"))  # one of each member's, as sets are large
        large_sets = stage(sets_of_reps(large.join(spokes, F.col("rep") == F.col("a"), "left").select("rep", "family", "d1", F.lit(1).alias("blocks"), "star")), "sets", root)
        links = stage(_verified(large_sets, num, den).union(whole), "links", root)
        # Lists of large families whose members are not yet connected.
        near = components(links).select(F.col("node").alias("_n"), F.col("root").alias("_r"))
        theirs = lists.join(large.select(F.col("rep").alias("_rep")), F.col("rep") == F.col("_rep"), "left_semi").join(near, F.col("rep") == F.col("_n"), "left").select("rep", "key", F.coalesce("_r", "rep").alias("at"))
        open_ = theirs.groupBy("key").agg(F.min("at").alias("x"), F.max("at").alias("y")).where("x < y").select(F.col("key").alias("_k"))
        rest = _families(_stars(theirs.join(open_, F.col("key") == F.col("_k"), "left_semi"))).distinct().withColumnsRenamed({"rep": "_rep"})
        rest = _with_blocks(rest.join(large.select("rep", "n"), F.col("rep") == F.col("_rep")).select("_rep", "family", "n"), block)
        rest = stage(rest.select("_rep", F.col("family").alias("_family"), F.col("blocks").alias("_blocks")), "rest", root)
        again = large_sets.join(rest, F.col("rep") == F.col("_rep")).select("rep", F.col("_family").alias("family"), F.col("_blocks").alias("blocks"), "items")
        roots = components(stage(_join_blocks(again, num, den).union(links), "joined", root))

    named = classes.select("n", "d1", "d2", "rep").join(roots, F.col("rep") == F.col("node"), "left").select("n", "d1", "d2", F.coalesce("root", "rep").alias("component_id"))
    named = stage(named, "named", root)  # a plain scan, so that a hot class's join is split
    out = members.drop("keys").join(named, ["n", "d1", "d2"], "left")
    own_id = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own_id.alias("component_id"))


def query(spark, sf_dir: str) -> DataFrame:
    """op4: components of documents by 3-word shingles at 0.9."""
    from lumen.llm.shared import read

    return jaccard_components(read(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE = r"""
with recursive d as (select doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) as w from documents),
s as (select distinct doc_id, array_to_string(w[i:i + 2], ' ') as g from (select doc_id, w, unnest(case when len(w) = 0 then [] else range(1, greatest(len(w) - 1, 2)) end) as i from d)),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as x, b.doc_id as y, count(*) as o from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
e as (select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where 100 * o >= 90 * (a.n + b.n - o)),
r as (select x as doc_id, x as c from e union select r.doc_id, e.y from r join e on e.x = r.c)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, least(d.doc_id, coalesce(m.c, d.doc_id)) as component_id
from d left join n using (doc_id) left join (select doc_id, min(c) as c from r group by doc_id) m using (doc_id)
"""
