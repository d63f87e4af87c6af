"""File readers: type, encoding and delimiter detection on a sample, then Spark's own sources.

Sniffing reads the first bytes of one file through Spark, so any path works
that Spark can open; the data itself is always read by Spark.
"""

from __future__ import annotations

import csv
import io
import os
import re
import unicodedata
import warnings
import zlib
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumen.session import shared_dir
from lumen.sources.records import read_records

EXTENSIONS = {".csv": "csv", ".tsv": "tsv", ".txt": "txt", ".json": "json", ".jsonl": "json", ".ndjson": "json", ".parquet": "parquet", ".pq": "parquet", ".orc": "orc", ".xlsx": "excel", ".xls": "excel"}
SAMPLE = 256 << 10
DELIMITERS = [",", "\t", ";", "|", "~", "^"]


def head(spark: SparkSession, path: str, size: int = SAMPLE) -> bytes:
    """The first bytes of a file, or of the first file in a folder."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(conf)
    if not fs.exists(p):
        raise FileNotFoundError(path)
    if fs.getFileStatus(p).isDirectory():
        files = sorted(str(s.getPath()) for s in fs.listStatus(p) if not s.isDirectory() and not s.getPath().getName().startswith(("_", ".")))
        if not files:
            raise ValueError(f"no file in {path}")
        p = jvm.org.apache.hadoop.fs.Path(files[0])
    n = min(size, fs.getFileStatus(p).getLen())
    if not n:
        return b""
    stream = fs.open(p)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, int(n)))
    finally:
        stream.close()


def file_type(path: str, start: bytes = b"") -> str:
    """By extension, else by the first bytes; csv if nothing tells."""
    kind = EXTENSIONS.get(os.path.splitext(path.rstrip("/"))[1].lower())
    if start.startswith(b"SQLite format 3"):
        raise ValueError("a SQLite database is not a table")
    if kind:
        return kind
    if start.startswith(b"PAR1"):
        return "parquet"
    if start.startswith(b"ORC"):
        return "orc"
    if start.startswith(b"PK"):
        return "excel"
    return "json" if start.lstrip(b"\xef\xbb\xbf \t\r\n")[:1] in (b"{", b"[") else "csv"


#: Code pages that are tried, the likelier first; Python and Java know these names.
CODE_PAGES = ["windows-1252", "windows-1256", "windows-1251", "koi8-r", "windows-1253", "windows-1255", "gb18030", "big5", "shift_jis", "euc-kr"]
#: Share of likely pairs below which no code page is believed.
CONFIDENCE = 0.6


@lru_cache(maxsize=4096)
def _script(c: str) -> str:
    """The script of a letter, the first word of its name; nothing for other characters."""
    if not c.isalpha():
        return ""
    word = unicodedata.name(c, "").split(" ")[0].split("-")[0]
    return "CJK" if word in ("HIRAGANA", "KATAKANA") else word


#: Frequent letters of scripts, and signs of Chinese; of kana and Hangul any counts.
FREQUENT = {
    "LATIN": "éèàçùâêîôûëïœäöüßñáíóúãõåøæ", "CYRILLIC": "оеаинтсрвл", "GREEK": "αοιετσνηρυ", "HEBREW": "יוהלאמרתבשםכ", "ARABIC": "اليمنوترهب",
    "CJK": "的一是不了人我在有他这這中大来來上国國个個和地出你好",
}


def frequency(text: str) -> float:
    """The share of letters beyond ASCII that are frequent small ones of their script."""
    high = [c for c in text if c >= "\x80" and c.isalpha()]
    return sum(c in FREQUENT.get(_script(c), "") or "\u3040" <= c <= "\u30ff" or _script(c) == "HANGUL" for c in high) / len(high) if high else 0.0


def likelihood(text: str) -> float:
    """The share of neighbouring characters, at least one of them beyond ASCII, that text would hold: letters of one script, small after any or capital after capital, or a letter beside a blank or a mark."""
    good = all_ = 0
    for x, y in zip(text, text[1:]):
        if x < "\x80" and y < "\x80":
            continue
        all_ += 1
        p, q = _script(x), _script(y)
        if p and q:
            good += p == q and (y == y.lower() or x != x.lower()) and not (p == "LATIN" and min(x, y) >= "\x80")  # accented letters seldom meet
        else:
            other = y if p else x
            good += bool(p or q) and other < "\x80" and not other.isalnum() or other in "\u2018\u2019\u201c\u201d\u2013\u2014\u3002\u3001\uff0c\u060c"
    return good / all_ if all_ else 0.0


def encoding_of(start: bytes) -> str:
    """By byte order mark, else UTF-8 if it decodes, else the code page under which pairs of characters are likeliest; Windows-1252 where none is likely."""
    for mark, name in ((b"\xff\xfe", "UTF-16"), (b"\xfe\xff", "UTF-16"), (b"\xef\xbb\xbf", "UTF-8")):
        if start.startswith(mark):
            return name
    for cut in range(4 if len(start) >= SAMPLE else 1):  # a full sample may end within a character
        try:
            start[: len(start) - cut].decode("utf-8")
            return "UTF-8"
        except UnicodeDecodeError:
            continue
    high = next(i for i, b in enumerate(start) if b >= 0x80)
    part = start[max(0, high - 100) : high + 16_384]
    part = part[: part.rfind(b"\n")] if b"\n" in part[200:] else part
    best, found = 0.0, "windows-1252"
    for name in CODE_PAGES:
        for cut in range(4):
            try:
                text = part[: len(part) - cut].decode(name)
            except UnicodeDecodeError:
                continue
            pairs = likelihood(text)
            score = pairs + 0.2 * frequency(text)  # letters decide among code pages whose pairs are alike
            if score > best + 1e-9 and pairs >= CONFIDENCE:
                best, found = score, name
            break
    return found


def delimiter_of(text: str, candidates: list[str] | None = None) -> str:
    """The candidate that stands most evenly outside quotes on the first lines; a comma if none stands more than five times."""
    text = text[:8192].replace("\r\n", "\n").replace("\r", "\n")
    lines = list(csv.reader(io.StringIO(text), delimiter="\0"))[:50]
    plain = re.sub(r'"[^"]*"', "", text)
    counts = {d: plain.count(d) for d in candidates or DELIMITERS}
    rows = [re.sub(r'"[^"]*"', "", line[0]) if line else "" for line in lines]
    even = {d: len({r.count(d) for r in rows[:-1] if r}) == 1 and rows[0].count(d) > 0 for d in counts} if len(rows) > 2 else {}
    best = [d for d in counts if even.get(d)] or [d for d in counts if counts[d] > 5]
    return max(best, key=lambda d: counts[d]) if best else ","


def clean_name(name: str) -> str:
    """A column name without control characters and separators; empty ones get a number from their bytes."""
    s = re.sub(r"[﻿\x00-\x1f\x7f]", "", name).strip()
    s = re.sub(r"[-\s]+", "_", re.sub(r"[^\w\s-]", "_", s))
    s = re.sub(r"_+", "_", s).strip("_")
    return s or f"column_{zlib.crc32(name.encode('utf-8', 'surrogatepass')) % 10000}"


def clean_names(df: DataFrame) -> DataFrame:
    """Clean names; those that would repeat get a number."""
    out: list[str] = []
    for c in df.columns:
        n = base = clean_name(c)
        i = 2
        while n in out:
            n, i = f"{base}_{i}", i + 1
        out.append(n)
    return df.toDF(*out)


def drop_empty(df: DataFrame) -> DataFrame:
    """Without rows, then columns, that hold only nulls; one pass decides on the columns."""
    df = df.dropna("all")
    if not df.columns:
        return df
    n = df.agg(*[F.count(F.col(f"`{c}`")).alias(str(i)) for i, c in enumerate(df.columns)]).first()
    return df.select(*[F.col(f"`{c}`") for i, c in enumerate(df.columns) if n[str(i)]])


def nan_to_null(df: DataFrame) -> DataFrame:
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(F.col(f"`{c}`")), F.col(f"`{c}`")) for c in floats}) if floats else df


def line_end(start: bytes) -> str:
    """What ends lines: a line feed, or a carriage return where there are only these."""
    return "\r" if b"\r" in start and b"\n" not in start else "\n"


def narrow(spark: SparkSession, path: str, encoding: str) -> str:
    """path, or for UTF-16, whose line ends are no single bytes, a copy as UTF-8 in the shared folder; each file is decoded by one task."""
    if not encoding.startswith("UTF-16"):
        return path
    to = f"{shared_dir(spark)}/utf8"
    text = F.decode(F.col("content"), "UTF-16")
    spark.read.format("binaryFile").load(path).select(F.regexp_replace(text, "\r?\n$", "").alias("value")).write.text(to)
    return to


def _records_as_csv(records: DataFrame):
    """The records' text as a data set that Spark's CSV parser takes."""
    jvm = records.sparkSession._jvm
    return getattr(records.select("record")._jdf, "as")(jvm.org.apache.spark.sql.Encoders.STRING())


def _csv(spark: SparkSession, path: str, sep: str | None, encoding: str | None, infer: bool) -> tuple[DataFrame, str]:
    """Rows of a delimited file with a column that holds the text of records that cannot be parsed, and its name.

    A file in UTF-8 without quoted line ends is Spark's own to read; otherwise
    records are found and decoded split by split, and its parser gets them one
    by one.
    """
    start = head(spark, path)
    encoding = encoding or encoding_of(start)
    sep = sep or delimiter_of(start.decode(encoding, "replace"))
    path, encoding = narrow(spark, path, encoding), "UTF-8" if encoding.startswith("UTF-16") else encoding
    how = {"header": True, "sep": sep, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "nullValue": ""}
    # Whether a record is at fault must not depend on which columns a query reads.
    how |= {"columnPruning": False, "maxCharsPerColumn": -1}
    odd = F.length(F.regexp_replace("value", '[^"]', "")) % 2 == 1
    many = encoding.upper() != "UTF-8" or not spark.read.option("lineSep", line_end(start)).text(path).where(odd).isEmpty()
    if many:
        records = read_records(spark, path, sep, encoding, line_end(start)).withColumn("record", F.regexp_replace("record", "^\ufeff", ""))
        plain = spark.read.options(inferSchema=infer, **how)
        names = DataFrame(plain._jreader.csv(_records_as_csv(records)), spark)
    else:
        how |= {"encoding": encoding, "lineSep": line_end(start)}
        names = spark.read.options(inferSchema=infer, **how).csv(path)
    corrupt = "_corrupt"
    while corrupt in names.columns:
        corrupt = f"_{corrupt}"
    schema = T.StructType([*names.schema.fields, T.StructField(corrupt, T.StringType())])
    reader = spark.read.schema(schema).options(mode="PERMISSIVE", columnNameOfCorruptRecord=corrupt, **how)
    if not many:
        return reader.csv(path), corrupt
    body = records.where(~((F.col("block") == 0) & (F.col("seq") == 0)) & (F.trim("record") != ""))  # each file begins with a header
    return DataFrame(reader.option("header", False)._jreader.csv(_records_as_csv(body)), spark), corrupt


def malformed(spark: SparkSession, path: str, sep: str | None = None, encoding: str | None = None) -> int:
    """Records of a delimited file that cannot be parsed."""
    df, corrupt = _csv(spark, path, sep, encoding, True)
    return df.agg(*[F.count(F.col(f"`{c}`")) for c in df.columns]).first()[-1] if len(df.columns) > 1 else 0


def read_csv(spark: SparkSession, path: str, sep: str | None = None, encoding: str | None = None, infer: bool = True, warn: bool = False) -> DataFrame:
    """A delimited file with a header; records that cannot be parsed are left out, and if warn, counted in a warning."""
    df, corrupt = _csv(spark, path, sep, encoding, infer)
    if warn and (n := malformed(spark, path, sep, encoding)):
        warnings.warn(f"{path}: {n} records cannot be parsed and are left out", stacklevel=2)
    if len(df.columns) == 1:
        return df.drop(corrupt)
    # A query may not read the column of bad records alone, so the condition, always true, names another one.
    return df.where(F.col(corrupt).isNull() & (F.hash(F.col(f"`{df.columns[0]}`")) >= -(1 << 31))).drop(corrupt)


def flatten(df: DataFrame) -> DataFrame:
    """Struct columns as dotted columns, to any depth."""
    while any(isinstance(f.dataType, T.StructType) for f in df.schema):
        cols = []
        for f in df.schema:
            if isinstance(f.dataType, T.StructType):
                cols += [F.col(f"`{f.name}`").getField(g.name).alias(f"{f.name}.{g.name}") for g in f.dataType]
            else:
                cols.append(F.col(f"`{f.name}`"))
        df = df.select(*cols)
    return df


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A list of records, lines of records, or an object whose longest list of records is the table."""
    start = head(spark, path).lstrip(b"\xef\xbb\xbf \t\r\n")
    many = start[:1] == b"[" or not re.match(rb"\{[^\n]*\}\s*(\n|$)", start)
    df = spark.read.json(path, multiLine=many)
    lists = [f.name for f in df.schema if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType)]
    if many and start[:1] == b"{" and lists:
        n = df.agg(*[F.max(F.size(f"`{c}`")).alias(str(i)) for i, c in enumerate(lists)]).first()
        longest = max(range(len(lists)), key=lambda i: n[i] or 0)
        df = df.select(F.explode(F.col(f"`{lists[longest]}`")).alias("r")).select("r.*")
    return flatten(df)


def read_fixed_width(spark: SparkSession, path: str) -> DataFrame:
    """Columns where the first lines have blanks in common; the first line holds names."""
    lines = head(spark, path).decode("utf-8", "replace").splitlines()[:100]
    width = max(map(len, lines), default=0)
    used = [any(i < len(s) and not s[i].isspace() for s in lines) for i in range(width)]
    spans = [(m.start(), m.end()) for m in re.finditer("1+", "".join("01"[u] for u in used))]
    first = lines[0] if lines else ""
    names = [first[a:b].strip() for a, b in spans]
    # The reader takes the first line of each file as a header; no separator, so one column.
    text = spark.read.csv(path, header=True, sep="\x01", quote="", inferSchema=False).toDF("value") if first.strip() else spark.read.text(path)
    cols = [F.nullif(F.trim(F.substring("value", a + 1, b - a)), F.lit("")).alias(f"c{i}") for i, (a, b) in enumerate(spans)]
    return clean_names(text.select(*cols).toDF(*names)) if spans else text


def read_excel(spark: SparkSession, path: str) -> DataFrame:
    """All sheets one under another, with ``__sheet_name__`` if there are several; needs a workbook library on the driver."""
    import pandas as pd

    try:
        sheets = pd.read_excel(path, sheet_name=None)
    except ImportError as e:
        raise ValueError("no workbook library is installed; save the sheets as CSV") from e
    frames = [f.assign(__sheet_name__=n) if len(sheets) > 1 else f for n, f in sheets.items() if len(f)]
    return spark.createDataFrame(pd.concat(frames, ignore_index=True))


def read_any(spark: SparkSession, path: str, limit: int | None = None, check: bool = True) -> DataFrame:
    """A table from a file of any known type: gate for delimited text, clean names, no empty rows or columns.

    Raises FileNotFoundError, or ValueError for empty and blocked files.
    """
    from lumen.sources.integrity import check_csv

    start = head(spark, path)
    if not start:
        raise ValueError(f"{path} is empty")
    kind = file_type(path, start)
    if check and kind in ("csv", "tsv", "txt"):
        report = check_csv(spark, path)
        if report["status"] == "blocked":
            raise ValueError(f"{path} is blocked: {'; '.join(f['message'] for f in report['findings'])}")
    if kind in ("parquet", "orc"):
        df = spark.read.format(kind).load(path)
    elif kind == "json":
        df = read_json(spark, path)
    elif kind == "excel":
        df = read_excel(spark, path)
    elif kind == "tsv":
        df = read_csv(spark, path, "\t", warn=True)
    else:
        df = read_csv(spark, path, warn=True)
        if kind == "txt" and len(df.columns) == 1:
            for sep in ("|", ";", "\t", ",", "~"):
                if sep in df.columns[0]:
                    df = read_csv(spark, path, sep, warn=True)
                    break
            else:
                df = read_fixed_width(spark, path)
    df = drop_empty(nan_to_null(clean_names(df)))
    if not df.columns or df.isEmpty():
        raise ValueError(f"{path} has no rows")
    return df if limit is None else df.limit(limit)


def preview(df: DataFrame, order: str | None = None, n: int = 20) -> DataFrame:
    return (df.orderBy(order) if order else df).limit(n)
