"""Sinks: quoted CSV, Parquet, result tables with a manifest, fingerprints."""

from __future__ import annotations

import hashlib
import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save_csv(df: DataFrame, path: str) -> None:
    """UTF-8, all fields quoted, a header in each part."""
    df.write.mode("overwrite").csv(path, header=True, quoteAll=True, escape='"', lineSep="\n")


def save_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


class Catalog:
    """Results under one folder: a Parquet table for each name, and ``manifest`` as JSON lines, one for each state of an analysis."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _put(self, analysis: str, state: str, **more) -> None:
        row = json.dumps({"analysis": analysis, "state": state, "at": time.time(), **more}, sort_keys=True)
        self.spark.createDataFrame([(row,)], "value string").coalesce(1).write.mode("append").text(f"{self.root}/manifest")

    def create(self, analysis: str, **more) -> None:
        self._put(analysis, "created", **more)

    def save(self, analysis: str, name: str, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(f"{self.root}/{analysis}/{name}")

    def load(self, analysis: str, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{analysis}/{name}")

    def complete(self, analysis: str, **more) -> None:
        self._put(analysis, "completed", **more)

    def fail(self, analysis: str, error: str) -> None:
        self._put(analysis, "failed", error=error)

    def delete(self, analysis: str) -> None:
        self._put(analysis, "deleted")

    def states(self) -> dict[str, dict]:
        """The latest state of each analysis that is not deleted; one small row a state."""
        rows = [json.loads(r["value"]) for r in self.spark.read.text(f"{self.root}/manifest").collect()]
        latest: dict[str, dict] = {}
        for r in sorted(rows, key=lambda r: r["at"]):
            latest[r["analysis"]] = r
        return {k: v for k, v in latest.items() if v["state"] != "deleted"}


def frame_digest(df: DataFrame) -> str:
    """SHA-256 over shape, names, types and order-free sums of hashes of every column; equal for equal frames in any row order."""
    cols = [F.sum(F.xxhash64(F.lit(c), F.col(f"`{c}`")).cast("decimal(38,0)")).alias(f"h{i}") for i, c in enumerate(df.columns)]
    row = F.sum(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).cast("decimal(38,0)")).alias("row")
    one = df.agg(F.count("*").alias("n"), row, *cols).first()
    return hashlib.sha256(json.dumps([df.dtypes, [str(x) for x in one]]).encode()).hexdigest()


def schema_fingerprint(df: DataFrame) -> str:
    return hashlib.sha256(json.dumps(sorted(df.columns)).encode()).hexdigest()
