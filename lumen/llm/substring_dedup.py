"""Substring dedup over windows of consecutive words, by super-k-mer partitioning.

A window's minimiser is its longest word (ties by hash), which spreads windows
over buckets far more evenly than a plain hash order would, as long words are
rare.  Consecutive windows of a text that share a minimiser form a super-k-mer
and travel to the minimiser's bucket as one packed string: words with one space
after each, compressed together with the others that one map task sends there.
A bucket interns words, sorts its windows by hash, compares neighbours word by
word, and marks each window that also starts in a document of smaller id.  The
marks of a document, as ranges, are joined to its text, and the covered words go.

Scale and skew: the windows of all data are counted, and the minimisers that
hold many of them: each map task passes on those that hold more than ``SHARE``
of its own windows, so what is gathered is bounded whatever the input.  A
minimiser with more than ``HOT`` windows (or 2 ``SHARE`` of all, if that is
more) is split by the window's second minimiser, and its windows still travel
packed.  Windows of a pair of minimisers that is hot too (a passage or line that
very many documents share) go through an aggregation by the window's 128-bit
digest, combined on the map side, and a join back that adaptive skew handling
can split.  A partition holds many buckets, in order, beyond ``PARTITIONS`` of
them; a bucket of many windows is sorted in passes by parts of the hash, so its
memory is bounded.  Results do not depend on any of these choices.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumen.llm.shared import free, prepare, release, stage
from lumen.llm.words import SPACE, U, Words, inside, mix, ranges, slices, window_hashes

#: Windows that one bucket holds on average, and from which a minimiser counts as hot; windows that a bucket sorts at a time.
BUCKET, HOT, PASS = 1_000_000, 250_000, 4_000_000
#: Part of all windows that a minimiser may hold without being hot, at least: 1 / SHARE minimisers at most are listed.
SHARE = 2.0**-17
#: Partitions of buckets at most.
PARTITIONS = 20_000
#: Windows of one super-k-mer at most, so that one string stays bounded.
RUN = 4096


def _min13(x: np.ndarray, k: int) -> np.ndarray:
    """Minimum of every k consecutive entries."""
    n, size = len(x) - k + 1, 1
    if n <= 0:
        return x[:0]
    while size * 2 <= k:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[:n], x[k - size : k - size + n]) if size < k else x[:n]


def minimisers(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows of k words, and the value of each one's minimiser."""
    size = np.minimum(w.end - w.start, 255).astype(U)
    value = ((U(255) - size) << U(56)) | (mix(w.hashes()) >> U(8))
    starts = inside(w.first, k, len(w))
    return starts, mix(_min13(value, k)[starts]) if len(starts) else np.zeros(0, U)


def second(w: Words, starts: np.ndarray, k: int) -> np.ndarray:
    """The values of the windows' second minimisers: the next by the same order, or the first again in a window of one word over and over."""
    size = np.minimum(w.end - w.start, 255).astype(U)
    value = ((U(255) - size) << U(56)) | (mix(w.hashes()) >> U(8))
    out = np.zeros(len(starts), U)
    for i in range(0, len(starts), 1 << 16):
        at = starts[i : i + (1 << 16)]
        x = np.sort(value[at[:, None] + np.arange(k)], 1)
        differs = x != x[:, :1]
        out[i : i + len(at)] = x[np.arange(len(at)), np.argmax(differs, 1)]
    return out


def within(x: np.ndarray, sorted_: np.ndarray) -> np.ndarray:
    """Which of x are in a sorted array."""
    if not len(sorted_):
        return np.zeros(len(x), bool)
    return sorted_[np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)] == x


def dealt_by(w: Words, k: int, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of windows, what each is dealt by, and whether that is a pair of minimisers."""
    starts, m = minimisers(w, k)
    pair = within(m, hot)
    if pair.any():
        m = m.copy()
        m[pair] = mix(m[pair] ^ mix(second(w, starts[pair], k)))
    return starts, m, pair


def _counts(k: int, hot: np.ndarray):
    """Rows (value, n): the number of windows under null, and of each value that holds more than SHARE of this task's windows. Values are minimisers, or if hot is given pairs of which it has the first."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, counts, total, held, some = np.zeros(0, U), np.zeros(0, np.int64), 0, [], 0

        def merge() -> tuple[np.ndarray, np.ndarray]:
            v, i = np.unique(np.concatenate([values, *[x for x, _ in held]]), return_inverse=True)
            return v, np.bincount(i, np.concatenate([counts, *[c for _, c in held]]), len(v)).astype(np.int64)

        for batch in batches:
            for _, data, offsets in slices(batch, 0):
                _, m, pair = dealt_by(Words(data, offsets), k, hot)
                total += len(m)
                x = np.unique(m[pair] if len(hot) else m, return_counts=True)
                held.append(x)
                some += len(x[0])
                if some > 1 << 20:
                    values, counts = merge()
                    held, some = [], 0
        if total:
            values, counts = merge()
            many = counts > SHARE * total
            v = np.concatenate([np.zeros(1, U), values[many]])
            yield pa.RecordBatch.from_arrays([pa.array(v.view(np.int64), mask=np.arange(len(v)) == 0), pa.array(np.append(total, counts[many]))], ["value", "n"])

    return f


def _hot(texts: DataFrame, k: int, hot: int, first: np.ndarray) -> tuple[int, np.ndarray]:
    """The number of windows, and the sorted values that hold too many of them."""
    got = texts.mapInArrow(_counts(k, first), "value long, n long").groupBy("value").agg(F.sum("n").alias("n"))
    total = got.where("value is null").first()
    total = total["n"] if total else 0
    many = got.where(F.col("value").isNotNull() & (F.col("n") > max(hot, SHARE * total))).select("value").collect()  # 1 / SHARE values at most
    return total, np.sort(np.array([r["value"] for r in many], np.int64).view(U))


def _strings(data: np.ndarray, at: np.ndarray, size: np.ndarray) -> pa.Array:
    """Slices of data as an array of bytes."""
    off = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(off), pa.py_buffer(data[ranges(at, size)].tobytes())])


def _window_bytes(w: Words, starts: np.ndarray, k: int) -> pa.Array:
    """Windows as words with one space between."""
    packed, at = w.packed()
    stop = at[starts + k - 1] + (w.end - w.start)[starts + k - 1]
    return _strings(packed, at[starts], stop - at[starts])


def _shared(k: int, hot: np.ndarray, pairs: np.ndarray):
    """Rows (w1, w2, doc_id, crc, start) of the windows of hot pairs; (w1, w2) is a window's digest."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in slices(batch, 2):
                w = Words(data, offsets)
                starts, m, pair = dealt_by(w, k, hot)
                starts = starts[pair & within(m, pairs)]
                if len(starts):
                    text = w.text_of()[starts]
                    ids, crc = (part.column(i).to_numpy(zero_copy_only=False).astype(np.int64)[text] for i in (0, 1))
                    h = [window_hashes(w.hashes(seed), k)[starts].view(np.int64) for seed in (0, 77)]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, (*h, ids, crc, (starts - w.first[text]).astype(np.int32)))], ["w1", "w2", "doc_id", "crc", "start"])

    return f


def _deal(k: int, buckets: int, hot: np.ndarray, pairs: np.ndarray):
    """Super-k-mers by bucket: rows (bucket, n, payload)."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for part, data, offsets in slices(batch, 2):
                w = Words(data, offsets)
                starts, m, pair = dealt_by(w, k, hot)
                if len(pairs):
                    stay = ~(pair & within(m, pairs))
                    starts, m = starts[stay], m[stay]
                if not len(starts):
                    continue
                ids = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                crc = part.column(1).to_numpy(zero_copy_only=False).astype(np.uint32)
                text = w.text_of()
                bucket = (m % U(buckets)).astype(np.int64)
                new = np.ones(len(starts), bool)
                new[1:] = (m[1:] != m[:-1]) | (starts[1:] != starts[:-1] + 1)
                run = np.flatnonzero(new)
                size = np.diff(np.append(run, len(starts)))
                if len(size) and size.max() > RUN:  # cut long runs
                    parts = -(-size // RUN)
                    at = ranges(np.zeros(len(size), np.int64), parts) * RUN
                    run, size = np.repeat(run, parts) + at, np.minimum(np.repeat(size, parts) - at, RUN)
                order = np.argsort(bucket[run], kind="stable")
                run, size = run[order], size[order]
                b, s = bucket[run], starts[run]
                packed, at = w.packed()
                nbytes = (w.end - w.start)[s + size + k - 2] + at[s + size + k - 2] + 1 - at[s]
                cut = np.flatnonzero(np.append(True, b[1:] != b[:-1]))
                out, counts = [], []
                for x, y in zip(cut, np.append(cut[1:], len(b))):
                    t = text[s[x:y]]
                    out.append(pack.compress(b"".join(z.tobytes() for z in (np.diff(ids[t], prepend=0), crc[t], (s[x:y] - w.first[t]).astype(np.int32), size[x:y].astype(np.int32), packed[ranges(at[s[x:y]], nbytes[x:y])]))))
                    counts.append(y - x)
                yield pa.RecordBatch.from_arrays([pa.array(b[cut], pa.int64()), pa.array(counts, pa.int32()), pa.array(out, pa.binary())], ["bucket", "n", "payload"])

    return f


def _fields(n: int, raw: bytes) -> list[np.ndarray]:
    a = np.frombuffer(raw, np.int64, n)
    b = [np.frombuffer(raw, t, n, n * (8 + 4 * i)) for i, t in enumerate((np.uint32, np.int32, np.int32))]
    return [a, *b, np.frombuffer(raw, np.uint8, offset=20 * n)]


def mark_windows(ids: np.ndarray, size: np.ndarray, data: np.ndarray, k: int, most: int = PASS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For super-k-mers (document, number of windows, packed words): index of super-k-mer and offset of each window that also starts in a document of smaller id; in passes of about ``most`` windows, by parts of the hash."""
    w = Words(data, np.array([0, len(data)]))
    words = pa.Array.from_buffers(pa.large_binary(), len(w), [None, pa.py_buffer(np.append(w.start, len(data)).astype(np.int64)), pa.py_buffer(data.tobytes())])
    code = words.dictionary_encode().indices.to_numpy()
    first = np.concatenate([[0], np.cumsum(size + k - 1)])
    every = ranges(first[:-1], size)
    hashes = window_hashes(mix(code.astype(U) + U(1)), k)[every]
    passes = -(-len(every) // most)
    for i in range(passes):
        mine = np.flatnonzero((hashes >> U(32)) % U(passes) == U(i)) if passes > 1 else np.arange(len(every))
        if not len(mine):
            continue
        starts, h = every[mine], hashes[mine]
        order = np.argsort(h, kind="stable")
        o = starts[order]
        same = h[order][1:] == h[order][:-1]
        at = np.flatnonzero(same)
        for j in range(k):
            if not np.array_equal(code[o[at] + j], code[o[at + 1] + j]):  # a collision: group by the words themselves
                _, h = np.unique(np.stack([code[starts + i] for i in range(k)], 1), axis=0, return_inverse=True)
                h = h.reshape(-1)
                order = np.argsort(h, kind="stable")
                same = h[order][1:] == h[order][:-1]
                break
        group = np.flatnonzero(np.append(True, ~same))
        owner = np.searchsorted(first, starts, "right") - 1
        doc = ids[owner[order]]
        least = np.repeat(np.minimum.reduceat(doc, group), np.diff(np.append(group, len(doc))))
        marked = np.sort(order[doc > least])
        yield owner[marked], starts[marked] - first[owner[marked]]


def _mark(k: int, most: int):
    """Rows come sorted by bucket; each bucket is done when it is complete."""

    def done(held):
        ids, crc, pos, size, data = (np.concatenate(z) for z in zip(*held))
        held.clear()
        for owner, at in mark_windows(ids, size, data, k, most):
            if len(owner):
                new = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (at[1:] != at[:-1] + 1)))
                o = owner[new]
                n = np.diff(np.append(new, len(owner)))
                yield pa.RecordBatch.from_arrays([pa.array(ids[o]), pa.array(crc[o].astype(np.int64)), pa.array((pos[o] + at[new]).astype(np.int32)), pa.array(n.astype(np.int32))], ["doc_id", "crc", "start", "n"])

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        held, now = [], None
        for batch in batches:
            for bucket, n, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if bucket != now and held:
                    yield from done(held)
                now = bucket
                x = _fields(n, unpack.decompress(payload))
                held.append([np.cumsum(x[0]), *x[1:]])
        if held:
            yield from done(held)
        release()

    return f


def _apply(k: int, keep: int, names: list[str], full: bool):
    """Remove the covered words; the last two columns are the text and the ranges."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in slices(batch, keep):
                w = Words(data, offsets)
                n = w.counts()
                r = part.column(keep + 1)
                size = np.diff(np.array(r.offsets)) if len(r) else np.zeros(0, np.int64)
                size[np.array(r.is_null())] = 0
                flat = r.flatten()
                at = np.array(flat.field(0), np.int64) + np.repeat(w.first[:-1], size)
                stop = at + np.array(flat.field(1), np.int64) + k - 1
                delta = np.zeros(len(w) + 1, np.int64)
                np.add.at(delta, at, 1)
                np.add.at(delta, stop, -1)
                keeps = np.cumsum(delta)[:-1] == 0
                before = np.concatenate([[0], np.cumsum(keeps)])
                kept = before[w.first[1:]] - before[w.first[:-1]]
                packed, _ = w.packed()
                nbytes = w.end - w.start + 1
                out = packed[np.repeat(keeps, nbytes)].tobytes()
                ends = np.concatenate([[0], np.cumsum(np.where(keeps, nbytes, 0))])[w.first]
                texts = [out[a : max(a, b - 1)] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
                cols = [pa.array(n.astype(np.int64)), pa.array((n - kept).astype(np.int64)), pa.array([hashlib.sha256(x).hexdigest() for x in texts])]
                if full:
                    cols.append(pa.array([x.decode("utf-8") for x in texts]))
                yield pa.RecordBatch.from_arrays([part.column(i) for i in range(keep)] + cols, names)

    return f


def dedup_substrings(docs: DataFrame, k: int = 13, id: str = "doc_id", text: str = "text", keep: list[str] | None = None, full: bool = True, bucket: int = BUCKET, hot: int = HOT, most: int = PASS) -> DataFrame:
    """The columns ``keep`` of docs with ``n_words``, ``n_removed``, ``kept_sha256`` and, if full, ``kept_text`` (kept words, one space between).

    Words are runs of bytes other than space and 09-0D.  A word goes if a window
    of k words covers it whose sequence also starts in a document with a smaller
    id.  Null and empty texts have no words.  Rows with a null id neither remove
    nor lose words.  Rows that repeat an id are one document as to order: they
    remove nothing from each other, and each keeps its row.  Columns of docs
    with a new column's name are replaced.
    """
    spark = docs.sparkSession
    prepare(spark)
    new = [("n_words", "long"), ("n_removed", "long"), ("kept_sha256", "string")] + [("kept_text", "string")] * full
    keep = [c for c in (docs.columns if keep is None else keep) if c not in dict(new)]
    crc = F.crc32(F.col(text).cast("binary"))
    src = docs.where(F.col(id).isNotNull() & F.col(text).isNotNull()).select(F.col(id).cast("long").alias("doc_id"), crc.alias("crc"), F.col(text).alias("text"))

    none = np.zeros(0, U)
    total, first = _hot(src.select("text"), k, hot, none)
    pairs = _hot(src.select("text"), k, hot, first)[1] if len(first) else none
    buckets = max(1, math.ceil(total / bucket))
    parts = min(buckets, PARTITIONS)
    dealt = src.mapInArrow(_deal(k, buckets, first, pairs), "bucket long, n int, payload binary")
    target = F.pmod("bucket", F.lit(parts)).cast("int")
    dealt = dealt.repartitionById(parts, target) if hasattr(dealt, "repartitionById") else dealt.repartition(parts, target)
    marks = dealt.sortWithinPartitions("bucket").mapInArrow(_mark(k, most), "doc_id long, crc long, start int, n int")
    if len(pairs):
        shared = src.mapInArrow(_shared(k, first, pairs), "w1 long, w2 long, doc_id long, crc long, start int")
        least = shared.groupBy("w1", "w2").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("w1", "w2", "a")
        least = stage(least, "shared")  # a plain scan, so that a hot window's join is split
        marks = marks.union(shared.join(least, ["w1", "w2"]).where("doc_id > a").select("doc_id", "crc", "start", F.lit(1).alias("n")))
    marks = marks.groupBy("doc_id", "crc").agg(F.collect_list(F.struct("start", "n")).alias("_ranges"))

    cols = [F.col(f"`{c}`") for c in keep]
    mine, check, content, found = (free(c, docs) for c in ("id", "crc", "text", "ranges"))
    left = docs.select(*cols, F.col(id).cast("long").alias(mine), crc.alias(check), F.col(f"`{text}`").alias(content))
    marks = marks.withColumnsRenamed({"doc_id": free("doc", left), "crc": free("sum", left), "_ranges": found})
    both = left.join(marks, (F.col(mine) == marks[marks.columns[0]]) & (F.col(check) == marks[marks.columns[1]]), "left").select(*[left[f"`{c}`"] for c in keep], content, found)
    schema = left.select(*cols).schema
    for c, t in new:
        schema = schema.add(c, t)
    return both.mapInArrow(_apply(k, len(keep), keep + [c for c, _ in new], full), schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op2: repeated 13-word windows removed from every document."""
    from lumen.llm.shared import read

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_substrings(docs, keep=["doc_id"], full=False)


ORACLE = r"""
with d as (select doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) as w from documents),
s as (select doc_id, w, unnest(range(1, len(w) - 11)) as i from d),
x as (select doc_id, i, array_to_string(w[i:i + 12], ' ') as g from s),
f as (select *, min(doc_id) over (partition by g) as least from x),
c as (select distinct doc_id, i + j as p from (select doc_id, i from f where doc_id > least), range(0, 13) t(j)),
a as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as p from d),
k as (select a.doc_id, count(*) as n, string_agg(word, ' ' order by a.p) as kept from a anti join c on a.doc_id = c.doc_id and a.p = c.p group by a.doc_id)
select d.doc_id, len(w)::bigint as n_words, (len(w) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from d left join k using (doc_id)
"""
