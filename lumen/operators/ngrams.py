"""Text features of words and word pairs: an exact vocabulary of the most frequent terms, and their weights.

The vocabulary takes two passes.  The first counts with a bounded table a task,
which drops counts evenly when it is full and remembers how much; summed up, that
bounds every term's true count from above.  The second counts exactly those terms
that can be among the most frequent.  Where the bound does not exclude unseen
terms, all terms are counted.

Texts go through a worker a few at a time: whatever a batch holds, the terms of
about ``AT_ONCE`` characters (or of one longer text) are in memory together.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
import regex
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Terms that a task counts at once, and candidates that go to all tasks.
TABLE, CANDIDATES = 200_000, 200_000
#: Characters of text whose terms are listed together.
AT_ONCE = 1 << 20


TALLY = "array<struct<term:string,n:bigint>>"


def _counter(n: int, stop: list[str] | None) -> Callable[[str | None], Counter]:
    """How often each term stands in a text."""
    word, leave = regex.compile(r"[\p{L}\p{N}_]{2,}"), frozenset(stop or ())

    def f(s: str | None) -> Counter:
        words = [w for w in word.findall((s or "").lower()) if w not in leave]
        c = Counter(words)
        for k in range(2, n + 1):
            c.update(map(" ".join, zip(*(words[i:] for i in range(k)))))
        return c

    return f


def _parts(texts: pa.Array, most: int) -> Iterator[tuple[int, list[str | None]]]:
    """Texts from their first to their last, as (place of the first, texts) of about ``most`` characters; one text at least."""
    start, held, size = 0, [], 0
    for i, s in enumerate(texts):
        held.append(s.as_py())
        size += len(held[-1] or "")
        if size >= most:
            yield start, held
            start, held, size = i + 1, [], 0
    if held:
        yield start, held


def tally(text: Column, n: int = 2, stop: list[str] | None = None) -> Column:
    """``term, n`` of each text: how often the sequences of 1 to n of its words, joined by a space, stand in it.

    Words are lower-case runs of two or more letters, digits and underscores
    that are no stop words; null has none.
    """
    kind = pa.list_(pa.struct([("term", pa.string()), ("n", pa.int64())]))

    def f(texts: pa.Array) -> pa.Array:
        counter, out = _counter(n, stop), []
        for _, few in _parts(texts, AT_ONCE):
            counts = [counter(s) for s in few]
            ends = pa.array([0, *accumulate(map(len, counts))], pa.int32())
            flat = pa.StructArray.from_arrays([pa.array([w for c in counts for w in c], pa.string()), pa.array([m for c in counts for m in c.values()], pa.int64())], ["term", "n"])
            out.append(pa.ListArray.from_arrays(ends, flat))
        return pa.concat_arrays([x.cast(kind) for x in out]) if out else pa.array([], kind)

    return F.arrow_udf(f, TALLY)(text)


def terms(text: Column, n: int = 2, stop: list[str] | None = None) -> Column:
    """The same as a list of terms with their repeats."""
    return F.flatten(F.transform(tally(text, n, stop), lambda t: F.array_repeat(t["term"], t["n"].cast("int"))))


def default_stop_words() -> list[str]:
    return StopWordsRemover.loadDefaultStopWords("english")


class _Bounded:
    """Counts of at most about ``table`` terms; ``dropped`` bounds what any term has lost."""

    def __init__(self, table: int):
        self.table, self.counts, self.dropped = table, Counter(), 0

    def cut(self) -> None:
        if len(self.counts) > self.table:
            least = sorted(self.counts.values())[len(self.counts) // 2]  # half of the terms at least go
            self.dropped += least
            self.counts = Counter({w: c - least for w, c in self.counts.items() if c > least})

    def batches(self) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([None, *self.counts], pa.string()), pa.array([self.dropped, *self.counts.values()], pa.int64())], ["term", "n"])


def _bounded(table: int):
    """Of batches of tallies."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Bounded(table)
        for b in batches:
            flat = b.column(0).flatten()
            for i in range(0, len(flat), 4096):
                part = flat.slice(i, 4096)
                for term, n in zip(part.field(0).to_pylist(), part.field(1).to_pylist()):
                    held.counts[term] += n
                    held.cut()
        yield from held.batches()

    return f


def _bounded_texts(table: int, n: int, stop: list[str]):
    """Of batches of texts."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, held = _counter(n, stop), _Bounded(table)
        for b in batches:
            for _, few in _parts(b.column(0), AT_ONCE):
                for s in few:
                    held.counts.update(counter(s))
                    held.cut()
        yield from held.batches()

    return f


def _counted(n: int, stop: list[str], near: frozenset[str] | None):
    """``term, n, documents`` of batches of texts, summed over a few texts; of the terms near, or of all."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(n, stop)
        for b in batches:
            for _, few in _parts(b.column(0), AT_ONCE):
                total, docs = Counter(), Counter()
                for s in few:
                    c = counter(s)
                    own = c if near is None else {w: m for w, m in c.items() if w in near}
                    total.update(own)
                    docs.update(own.keys())
                yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64()), pa.array([docs[w] for w in total], pa.int64())], ["term", "n", "documents"])

    return f


def _placed(n: int, stop: list[str], place: dict[str, int]):
    """``id, place, n`` of batches of ids and texts."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(n, stop)
        for b in batches:
            for start, few in _parts(b.column(1), AT_ONCE):
                row, at, times = [], [], []
                for i, s in enumerate(few, start):
                    own = [(place[w], m) for w, m in counter(s).items() if w in place]
                    row += [i] * len(own)
                    at += [p for p, _ in own]
                    times += [m for _, m in own]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), pa.array(at, pa.int32()), pa.array(times, pa.int64())], ["id", "place", "n"])

    return f


def candidates(listed: DataFrame, size: int, table: int = TABLE) -> DataFrame | None:
    """Terms (column ``term``) that can be among the size most frequent of listed (column ``terms``, see ``tally``); None if bounded counts cannot tell."""
    return _likely(listed.select("terms").mapInArrow(_bounded(table), "term string, n long"), size)


def _likely(counted: DataFrame, size: int) -> DataFrame | None:
    seen = counted.groupBy("term").agg(F.sum("n").alias("n"))
    seen = seen.persist()
    slack = (seen.where("term is null").first() or {"n": 0})["n"]
    known = seen.where("term is not null")
    last = known.orderBy(F.desc("n")).limit(size).agg(F.min("n").alias("n"), F.count("*").alias("c")).first()
    if not slack:
        return known.select("term")
    if last["c"] < size or last["n"] <= slack:
        seen.unpersist()
        return None
    return known.where(F.col("n") + slack >= last["n"]).select("term")


def vocabulary(df: DataFrame, text: str, size: int = 5000, n: int = 2, stop: list[str] | None = None, table: int = TABLE) -> DataFrame:
    """``term, place, n, documents`` of the size most frequent terms (ties: alphabetical); place is their alphabetical number from 0.

    Null texts have no terms.  ``stop`` is the list of stop words, Spark's own
    by default; an empty list keeps all.
    """
    stop = default_stop_words() if stop is None else stop
    texts = df.select(F.col(text).alias("text"))
    near = _likely(texts.mapInArrow(_bounded_texts(table, n, stop), "term string, n long"), size)
    few = near.limit(CANDIDATES + 1).collect() if near is not None else []  # CANDIDATES rows at most are used
    known = frozenset(r["term"] for r in few) if near is not None and len(few) <= CANDIDATES else None
    each = texts.mapInArrow(_counted(n, stop, known), "term string, n long, documents long")
    if near is not None and known is None:
        each = each.join(near.select(F.col("term").alias("_t")), F.col("term") == F.col("_t"), "left_semi")
    top = each.groupBy("term").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents")).orderBy(F.desc("n"), "term").limit(size)
    place = F.row_number().over(Window.orderBy("term")) - 1  # size terms
    return top.select("term", place.cast("int").alias("place"), "n", "documents")


def tfidf(df: DataFrame, id: str, text: str, known: DataFrame, n: int = 2, stop: list[str] | None = None) -> DataFrame:
    """``id, place, weight`` of the terms of each text that are in a vocabulary: count * (ln((1 + texts) / (1 + documents)) + 1), scaled to length one."""
    stop = default_stop_words() if stop is None else stop
    terms_ = {r["term"]: r for r in known.collect()}  # the vocabulary has a set size
    words = df.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInArrow(_placed(n, stop, {w: r["place"] for w, r in terms_.items()}), T.StructType([T.StructField("id", df.select(F.col(id)).schema[0].dataType), T.StructField("place", T.IntegerType()), T.StructField("n", T.LongType())]))
    rows = df.sparkSession.createDataFrame([(r["place"], r["documents"]) for r in terms_.values()], "_p int, documents long")
    idf = rows.join(F.broadcast(df.agg(F.count("*").alias("texts")))).select("_p", (F.log((1 + F.col("texts")) / (1 + F.col("documents"))) + 1).alias("idf"))
    raw = words.join(F.broadcast(idf), F.col("place") == F.col("_p")).select("id", "place", (F.col("n") * F.col("idf")).alias("w"))
    each = raw.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.collect_list(F.struct("place", "w")).alias("all"))
    return each.select("id", F.explode("all").alias("x"), "norm").select("id", "x.place", (F.col("x.w") / F.col("norm")).alias("weight"))
