"""Checks of a delimited file before it is parsed as a table: all of its records, in file splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumen.sources.readers import delimiter_of, encoding_of, head, line_end, narrow
from lumen.sources.records import read_records

#: Share of ragged records that blocks, multiple of the usual fields and number of records that tell joined ones, share of replacement characters that flags.
RAGGED, MULTIPLE, WIDE, REPLACED = 0.10, 2, 3, 0.01


def record_counts(records: DataFrame) -> DataFrame:
    """``fields, quoted, n, errors, chars, replaced, nuls, first, error`` of records (see ``read_records``) by their number of fields."""
    return records.groupBy("fields", "quoted").agg(
        F.count("*").alias("n"), F.count("error").alias("errors"), F.sum("chars").alias("chars"), F.sum("replaced").alias("replaced"), F.sum("nuls").alias("nuls"),
        F.min(F.struct("file", "block", "seq")).alias("first"), F.min(F.when(F.col("error").isNotNull(), F.struct("file", "block", "seq", "error"))).alias("error"),
    )


def check_csv(spark: SparkSession, path: str, encoding: str | None = None, delimiter: str | None = None) -> dict:
    """status (ok, flagged or blocked), findings, encoding, delimiter, records and the usual number of fields of a delimited file or folder.

    Every record is looked at, the header included; an empty line is a record
    without fields.  Of numbers of fields that are equally frequent the one seen
    first counts as usual.
    """
    start = head(spark, path)
    encoding = encoding or encoding_of(start)
    delimiter = delimiter or delimiter_of(start.decode(encoding, "replace"))
    path = narrow(spark, path, encoding)
    encoding = "UTF-8" if encoding.startswith("UTF-16") else encoding
    counts = record_counts(read_records(spark, path, delimiter, encoding, line_end(start))).collect()  # a row for each number of fields
    findings: list[dict] = []

    def add(kind: str, action: str, affected: int, message: str) -> None:
        findings.append({"kind": kind, "action": action, "affected": affected, "message": message})

    records, total = sum(r["n"] for r in counts), lambda c: sum(r[c] or 0 for r in counts)
    if total("nuls"):
        add("nul_bytes", "flag", total("nuls"), f"{total('nuls')} NUL bytes")
    if errors := total("errors"):
        first = min(r["error"] for r in counts if r["error"])
        add("parse_error", "block", errors, f"{errors} records: {first['error']}")
    usual = 0
    if records <= 1 and not errors:
        add("no_records", "flag", 0, "no data records")
    elif counts:
        by: dict[int, list] = {}
        for r in counts:
            n, first = by.get(r["fields"], (0, r["first"]))
            by[r["fields"]] = [n + r["n"], min(first, r["first"])]
        usual = min(by, key=lambda k: (-by[k][0], by[k][1]))
        ragged = records - by[usual][0]
        if ragged:
            add("ragged", "block" if ragged / records >= RAGGED else "flag", ragged, f"{ragged / records:.2%} of the records do not have {usual} fields")
        wide = sum(r["n"] for r in counts if r["quoted"] and usual and r["fields"] >= MULTIPLE * usual)
        if wide >= WIDE:
            add("concatenated", "block", wide, f"{wide} records hold two or more records")
    if total("chars") and total("replaced") / total("chars") >= REPLACED:
        add("replacement_characters", "flag", total("replaced"), f"{total('replaced')} characters could not be decoded")
    status = "blocked" if any(f["action"] == "block" for f in findings) else "flagged" if findings else "ok"
    return {"status": status, "encoding": encoding, "delimiter": delimiter, "records": records, "fields": usual, "findings": findings}
