"""Records of delimited files whose quoted fields may go on over line ends, read in file splits.

A split does not tell whether it begins inside a quoted field.  So every split
is first read under both assumptions, which gives the state at its end for each;
an aggregation of these in file order tells which assumption held.  Then each
split is cut into records, the parts of records that go over a border are joined,
and no task needs a whole file.

Splits are those of Spark's text source (a line belongs to the split in which it
begins), under whatever ``spark.sql.files.maxPartitionBytes`` is set.  Encodings
must keep quote, separator and line feed as single bytes; UTF-16 does not.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

QUOTE = b'"'
#: Cells and characters of each in which quotes are looked for in very wide records.
CELLS, CHARACTERS = 8, 200
RECORD = "file long, block long, seq long, record string, fields int, quoted boolean, error string, chars long, replaced long, nuls long"
_ARROW = pa.schema([("file", pa.int64()), ("block", pa.int64()), ("seq", pa.int64()), ("record", pa.string()), ("fields", pa.int32()), ("quoted", pa.bool_()), ("error", pa.string()), ("chars", pa.int64()), ("replaced", pa.int64()), ("nuls", pa.int64())])


def state_after(line: bytes, inside: bool, sep: bytes) -> bool:
    """Whether a quoted field is open at the end of a line that begins in that state. A quote opens a field at its start only, and two within one stand for one."""
    at, n = 0, len(line)
    while True:
        if inside:
            at = line.find(QUOTE, at)
            while 0 <= at < n - 1 and line[at + 1 : at + 2] == QUOTE:
                at = line.find(QUOTE, at + 2)
            if at < 0:
                return True
            inside, at = False, at + 1
        at = line.find(QUOTE, at)
        while at > 0 and line[at - 1 : at] != sep:
            at = line.find(QUOTE, at + 1)
        if at < 0:
            return False
        inside, at = True, at + 1


def lines(spark: SparkSession, path: str, end: str = "\n") -> DataFrame:
    """``file, block, line`` (bytes, without the line end) in the order of each split; file is a hash of the path, block where the split begins."""
    raw = spark.read.option("lineSep", end).text(path)
    return raw.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("line"))


def _states(sep: bytes):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out = None, None
        for b in batches:
            for key, line in zip(zip(b.column(0).to_pylist(), b.column(1).to_pylist()), b.column(2).to_pylist()):
                if key != now:
                    if now:
                        yield _row(*now, *out)
                    now, out = key, (False, True)
                out = tuple(state_after(line, s, sep) for s in out) if out[0] != out[1] else (state_after(line, out[0], sep),) * 2
        if now:
            yield _row(*now, *out)

    def _row(file, block, a, b):
        return pa.RecordBatch.from_pylist([{"file": file, "block": block, "out0": a, "out1": b}])

    return f


def split_states(whole: DataFrame, sep: str) -> DataFrame:
    """``file, block, inside, after`` of the splits that hold quotes: whether a quoted field is open at their beginning and end.

    A split either sets the state whatever it was, or keeps or turns it; so the
    state before it is the last one set, turned as often as was asked since.
    """
    with_quotes = whole.where(F.contains("line", F.lit(bytearray(QUOTE))))
    ends = with_quotes.mapInArrow(_states(sep.encode()), "file long, block long, out0 boolean, out1 boolean")
    w = Window.partitionBy("file").orderBy("block")  # a row a split
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    turns = F.sum(F.when(F.col("out0") & ~F.col("out1"), 1).otherwise(0))
    sets = ends.withColumn("turned", turns.over(w)).withColumn("set", F.when(F.col("out0") == F.col("out1"), F.struct(F.col("out0").alias("state"), "turned")))
    last = F.coalesce(F.last("set", True).over(before), F.struct(F.lit(False).alias("state"), F.lit(0).cast("long").alias("turned")))
    known = sets.withColumn("last", last).withColumn("so_far", F.coalesce(F.sum(F.when(F.col("out0") & ~F.col("out1"), 1).otherwise(0)).over(before), F.lit(0)))
    inside = (F.col("last.state").cast("int") + F.col("so_far") - F.col("last.turned")) % 2 == 1
    return known.withColumn("inside", inside).select("file", "block", "inside", F.when(F.col("inside"), F.col("out1")).otherwise(F.col("out0")).alias("after"))


def _parse(text: str, sep: str) -> tuple[int, bool, str | None]:
    """Fields of a record, whether its first ones hold quotes, and what a strict parser says against it."""
    if '"' not in text:
        return (text.count(sep) + 1 if text else 0), "'" in text and any("'" in c[:CHARACTERS] for c in text.split(sep, CELLS)[:CELLS]), None
    csv.field_size_limit(1 << 30)
    for strict in (True, False):
        try:
            cells = next(csv.reader([text], delimiter=sep, strict=strict), [])
            return len(cells), any(q in c[:CHARACTERS] for c in cells[:CELLS] for q in "\"'"), None if strict else error
        except csv.Error as e:
            error = str(e)
    return 0, True, error


def _row(text: bytes, sep: str, encoding: str) -> tuple:
    s = text.decode(encoding, "replace")
    s = s[:-1] if s.endswith("\r") else s
    nuls = s.count("\0")
    s = s.replace("\0", "") if nuls else s
    return s, *_parse(s, sep), len(s), s.count("\ufffd"), nuls


def _cut(sep: str, encoding: str, parts: bool, rows: int = 2000, size: int = 4 << 20):
    """The records that lie within a split, numbered; or only the parts of those that a border cuts: 1 ends here what began before, 2 goes on, 3 begins here and goes on."""
    mark = sep.encode()
    schema = pa.schema([*list(_ARROW)[:3], ("part", pa.int32()), ("bytes", pa.binary())]) if parts else _ARROW

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, inside, began, seq = None, False, False, 0
        open_: list[bytes] = []
        out: list[tuple] = []
        held = 0

        def add(part: int) -> None:
            nonlocal seq, held
            if parts == (part > 0):
                text = b"\n".join(open_)
                out.append((*key, seq, part, text) if parts else (*key, seq, *_row(text, sep, encoding)))
                held += len(text)
            open_.clear()
            seq += 1

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*out), schema)], schema=schema)

        for b in batches:
            for file, block, line, start in zip(*(b.column(i).to_pylist() for i in range(4))):
                if (file, block) != key:
                    if open_:
                        add(2 if began else 3)
                    key, inside, seq = (file, block), bool(start), 0
                    began = inside  # the first record began in an earlier split
                open_.append(line)
                if QUOTE in line:
                    inside = state_after(line, inside, mark)
                if not inside:
                    add(1 if began else 0)
                    began = False
                    if len(out) >= rows or held >= size:
                        yield batch()
                        out.clear()
                        held = 0
        if open_:
            add(2 if began else 3)
        if out:
            yield batch()

    return f


def _joined(sep: str, encoding: str):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, block, seq, parts, ended in zip(*(b.column(i).to_pylist() for i in range(5))):
                text, fields, quoted, error, *counts = _row(b"\n".join(parts), sep, encoding)
                row = (file, block, seq, text, fields, quoted, error if ended else "unexpected end of data", *counts)
                yield pa.RecordBatch.from_pylist([dict(zip(_ARROW.names, row))], schema=_ARROW)

    return f


def read_records(spark: SparkSession, path: str, sep: str = ",", encoding: str = "utf-8", end: str = "\n") -> DataFrame:
    """One row for each record of a file or folder, in several tasks, whether or not quoted fields hold line ends.

    ``file, block, seq`` order the records of a file.  ``fields`` is their number
    (0 for an empty line), ``quoted`` whether the first cells hold quotes,
    ``error`` what a strict parser says against the record, ``chars``,
    ``replaced`` and ``nuls`` its characters, those that could not be decoded and
    NULs.  NULs and a carriage return at the end are left out of ``record``.  The
    last record of a file is an error if its quotes stay open.
    """
    whole = lines(spark, path, end)
    w = Window.partitionBy("file").orderBy("block")  # a row a split
    states = split_states(whole, sep)
    # What is open after a split stays so up to the next one with quotes.
    spans = states.withColumn("_to", F.coalesce(F.lead("block").over(w), F.lit((1 << 63) - 1))).where("after").select(F.col("file").alias("_file"), F.col("block").alias("_from"), "_to")
    near = (F.col("file") == F.col("_file")) & (F.col("block") > F.col("_from")) & (F.col("block") <= F.col("_to"))
    inside = whole.select("file", "block").distinct().join(F.broadcast(spans), near).select(F.col("file").alias("_f"), F.col("block").alias("_b"), F.lit(True).alias("start"))
    # Only splits that begin inside a field are named, so this has a row a split at most.
    dealt = whole.join(F.broadcast(inside), (F.col("file") == F.col("_f")) & (F.col("block") == F.col("_b")), "left").select("file", "block", "line", "start")
    complete = dealt.mapInArrow(_cut(sep, encoding, False), RECORD)
    parts = dealt.mapInArrow(_cut(sep, encoding, True), "file long, block long, seq long, part int, bytes binary")
    chain = F.last(F.when(F.col("part") == 3, F.struct("block", "seq")), True).over(Window.partitionBy("file").orderBy("block", "seq"))  # two rows a split at most
    found = parts.withColumn("_c", chain).groupBy("file", "_c").agg(F.array_sort(F.collect_list(F.struct("block", "seq", "bytes"))).alias("p"), F.max(F.col("part") == 1).alias("ended"))
    across = found.select("file", F.col("_c.block").alias("block"), F.col("_c.seq").alias("seq"), F.col("p.bytes").alias("parts"), "ended").mapInArrow(_joined(sep, encoding), RECORD)
    return complete.unionByName(across)
