"""Fill-in-middle transformation over an index of distinct texts.

Identical texts are one entry of the index: they are grouped by the SHA-256 of
their bytes, and the contents themselves are compared as they are grouped, so
that a digest that stands for two contents gives two entries.  Each entry has
the byte offsets of its code points as one Elias-Fano list, made once.  A
document meets its entry by digest and selects its two seeded cuts in the list.

Scale and skew: texts are shuffled once, pre-aggregated by digest before that,
and the ids of a digest's documents travel with it.  Digests that more than
``share`` of all rows have (and more than ``PIECE`` rows) are hot: there are at
most 1 / share of them, so they are broadcast; their documents are joined to the
index, in which a hot text stands in as many copies as its documents fill
pieces.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumen.llm.shared import prepare, stage

MARKS = ("<P>", "<S>", "<M>")
#: Documents of one text that go to a task together, where there are more of it.
PIECE = 256
#: Bits between two entries of a list's directory of ranks.
BLOCK = 512

LIST = "n long, low_bits int, low binary, high binary, ranks binary"


def encode_boundaries(data: np.ndarray) -> tuple[int, int, bytes, bytes, bytes]:
    """The ascending byte offsets of a UTF-8 text's code points, and its length, as an Elias-Fano list: n, low_bits, low, high, ranks.

    ``low_bits`` bits of each offset stand in ``low``; the rest is in ``high``,
    a one for each offset after as many zeros as its upper part counts.
    ``ranks`` has the ones before each block of ``high``.
    """
    at = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data)).astype(np.int64)
    m = len(at)
    bits = max(0, int(math.floor(math.log2((len(data) + 1) / m))))
    ones = (at >> bits) + np.arange(m)
    high = np.zeros((int(ones[-1]) // BLOCK + 1) * BLOCK, np.uint8)
    high[ones] = 1
    ranks = np.concatenate([[0], np.cumsum(high.reshape(-1, BLOCK).sum(1, dtype=np.int64))[:-1]])
    low = ((at[:, None] >> np.arange(bits)) & 1).astype(np.uint8) if bits else np.zeros(0, np.uint8)
    return m - 1, bits, np.packbits(low.ravel()).tobytes(), np.packbits(high).tobytes(), ranks.tobytes()


def select(i: int, bits: int, low: bytes, high: bytes, ranks: bytes) -> int:
    """The i-th offset of a list."""
    r = np.frombuffer(ranks, np.int64)
    b = int(np.searchsorted(r, i, "right")) - 1
    ones = np.flatnonzero(np.unpackbits(np.frombuffer(high, np.uint8, BLOCK // 8, b * (BLOCK // 8))))
    upper = b * BLOCK + int(ones[i - int(r[b])]) - i
    lower = 0
    for j in range(bits):
        p = i * bits + j
        lower |= (low[p >> 3] >> (7 - (p & 7)) & 1) << j
    return upper << bits | lower


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    texts = texts.cast(pa.large_string())
    _, off, data = texts.buffers()
    off = np.frombuffer(off, np.int64)[texts.offset : texts.offset + len(texts) + 1] if off is not None else np.zeros(1, np.int64)
    return off, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def _lists(texts: pa.Array) -> pa.Array:
    off, data = _bytes_of(texts)
    rows = [encode_boundaries(data[off[i] : off[i + 1]]) for i in range(len(texts))]
    n, bits, low, high, ranks = zip(*rows) if rows else ([],) * 5
    return pa.StructArray.from_arrays(
        [pa.array(n, pa.int64()), pa.array(bits, pa.int32()), pa.array(low, pa.binary()), pa.array(high, pa.binary()), pa.array(ranks, pa.binary())],
        ["n", "low_bits", "low", "high", "ranks"],
    )


def _arrange(marks: tuple[str, str, str]):
    p, s, m = (x.encode() for x in marks)

    def f(texts: pa.Array, form: pa.Array, a: pa.Array, b: pa.Array, lists: pa.Array) -> pa.Array:
        off, data = _bytes_of(texts)
        out = []
        for i, (kind, x, y, e) in enumerate(zip(form.to_pylist(), a.to_pylist(), b.to_pylist(), lists)):
            t = data[off[i] : off[i + 1]].tobytes()
            if kind != "plain":
                own = [e[c].as_py() for c in ("low_bits", "low", "high", "ranks")]
                x, y = select(x, *own), select(y, *own)
                head, middle, tail = t[:x], t[x:y], t[y:]
                t = b"".join([p, head, s, tail, m, middle] if kind == "psm" else [s, tail, p, head, m, middle])
            out.append(t)
        return pa.array(out, pa.binary()).cast(pa.string())

    return f


def restore(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that was cut, from what came of it and its form alone; a text with marks of its own is never cut."""
    p, s, m = (F.lit(x) for x in marks)
    k = [len(x) for x in marks]
    first = F.when(form == "psm", F.instr(output, s)).otherwise(F.instr(output, p))  # where the second part's mark stands
    last = F.instr(output, m)
    one = lambda mark: F.substring(output, F.lit(mark + 1), first - mark - 1)
    two = lambda mark: F.substring(output, first + mark, last - first - mark)
    middle = F.substring(output, last + k[2], F.length(output))
    return F.when(form == "psm", F.concat(one(k[0]), middle, two(k[1]))).when(form == "spm", F.concat(two(k[0]), middle, one(k[1]))).otherwise(output)


def distinct_texts(rows: DataFrame, *riders: Column) -> DataFrame:
    """``digest, text, check`` and riders (aggregates of a digest's rows) for each distinct content of rows (digest, text).

    The contents of a digest are compared with each other as they are grouped;
    two that share even digest and check are an error, never mixed up.
    """
    names = [f"_r{i}" for i in range(len(riders))]
    one = rows.groupBy("digest").agg(F.collect_set("text").alias("texts"), *[r.alias(n) for r, n in zip(riders, names)])  # one text, or as many as the digest stands for
    apart = F.size(F.array_distinct(F.transform("texts", _check))) == F.size("texts")
    one = one.select("digest", *names, F.explode(F.when(apart, F.col("texts")).otherwise(F.raise_error(F.lit("contents that neither digest nor check tells apart")))).alias("text"))
    return one.withColumn("check", _check(F.col("text")))


def _check(text: Column) -> Column:
    return F.xxhash64(text, F.octet_length(text))


def fill_in_middle(docs: DataFrame, seed: int = 1, percent: int = 90, spm: int = 20, marks: tuple[str, str, str] = MARKS, id: str = "doc_id", text: str = "text", share: float = 1e-4, piece: int = PIECE, digest=None) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` for each row of docs.

    h1 to h4 are the first four groups of 8 digits of the SHA-256 of
    ``<seed>:<id>``.  Of n code points the prefix ends after the smaller of
    h1 % (n + 1) and h2 % (n + 1), the middle after the larger.  ``percent`` of
    the texts are cut (by h3), ``spm`` percent of them with the suffix first
    (by h4); empty texts and those that hold a mark stay plain, with null
    lengths.  Null texts are empty, a null id counts as the empty one, rows that
    repeat an id are cut each by its own text, other columns of docs play no
    part.  ``digest`` (a function of the text's column) may replace SHA-256.
    """
    spark = docs.sparkSession
    prepare(spark)
    body = F.coalesce(F.col(text), F.lit(""))
    src = docs.select(F.col(id).alias("doc_id"), body.alias("text"))
    src = src.withColumn("digest", (digest or (lambda c: F.unhex(F.sha2(c, 256))))(F.col("text"))).withColumn("check", _check(F.col("text")))

    least = max(piece, math.ceil(src.count() * share))
    hot = stage(src.groupBy("digest").agg(F.count("*").alias("c")).where(F.col("c") > least).select(F.col("digest").alias("_d"), F.ceil(F.col("c") / least).cast("int").alias("pieces")), "hot")
    ids, on = src.select("doc_id", "digest", "check"), F.col("digest") == F.col("_d")
    lists, has = F.arrow_udf(_lists, LIST), F.lit(False)
    for m in marks:
        has = has | F.col("text").contains(m)

    def cold(rows: DataFrame) -> DataFrame:
        """Documents ride with their digest to the index (``least`` of them at most), so that texts are shuffled once."""
        own = distinct_texts(rows, F.collect_list(F.struct("doc_id", F.col("check").alias("c"))))
        mine = F.filter("_r0", lambda d: d["c"] == F.col("check"))
        entry = own.select("text", has.alias("marked"), mine.alias("mine"), lists(F.col("text")).alias("list"))
        return entry.select(F.explode("mine").alias("d"), "text", "marked", "list").select("d.doc_id", "text", "marked", "list")

    if hot.isEmpty():
        both = cold(src)
    else:
        few = F.broadcast(hot)  # 1 / share rows at most
        deal = F.pmod(F.xxhash64("doc_id"), F.col("pieces")).cast("int")
        theirs = ids.join(few, on).withColumn("piece", deal).drop("_d", "pieces")
        entry = distinct_texts(src.join(few, on, "left_semi").select("digest", "text"))
        entry = entry.select(F.col("digest").alias("_digest"), F.col("check").alias("_check"), "text", has.alias("marked"), lists(F.col("text")).alias("list"))
        copies = entry.join(few, F.col("_digest") == F.col("_d")).withColumn("_piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
        same = (F.col("digest") == F.col("_digest")) & (F.col("check") == F.col("_check")) & (F.col("piece") == F.col("_piece"))
        both = theirs.join(copies, same).select("doc_id", "text", "marked", "list").unionByName(cold(src.join(few, on, "left_anti")))

    seeded = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring("_h", 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]
    n = F.col("list.n")
    form = F.when((n == 0) | F.col("marked") | (h[2] % 100 >= percent), "plain").when(h[3] % 100 < spm, "spm").otherwise("psm")
    cut = both.withColumn("_h", seeded).select("doc_id", "text", "list", n.alias("n"), form.alias("form"), (h[0] % (n + 1)).alias("x"), (h[1] % (n + 1)).alias("y"))
    whole = F.col("form") != "plain"
    cut = cut.select("doc_id", "n", "form", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "text", "list")
    out = F.arrow_udf(_arrange(marks), "string")(F.col("text"), F.col("form"), F.col("a"), F.col("b"), F.col("list"))
    return cut.select("doc_id", "n", "form", F.when(whole, F.col("a")).alias("prefix_chars"), F.when(whole, F.col("b") - F.col("a")).alias("middle_chars"), out.alias("output"))


def query(spark, sf_dir: str) -> DataFrame:
    """op12: every document cut for filling in its middle, with the round trip."""
    from lumen.llm.shared import read

    out = fill_in_middle(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


ORACLE = r"""
with d as (select doc_id, coalesce(text, '') as t, sha256('1:' || coalesce(doc_id::varchar, '')) as h from documents),
g as (select doc_id, t, length(t)::bigint as n, ('0x' || substr(h, 1, 8))::bigint as h1, ('0x' || substr(h, 9, 8))::bigint as h2, ('0x' || substr(h, 17, 8))::bigint as h3, ('0x' || substr(h, 25, 8))::bigint as h4 from d),
c as (select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
  case when n = 0 or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form from g),
p as (select *, substring(t, 1, a) as p, substring(t, a + 1, b - a) as m, substring(t, b + 1) as s from c)
select doc_id, n, form, case when form <> 'plain' then a end as prefix_chars, case when form <> 'plain' then b - a end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256, sha256(t) as restored_sha256 from p
"""
