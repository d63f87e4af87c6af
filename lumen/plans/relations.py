"""Sums and products of columns, and lengths of texts, that may make up another column: a vote of sampled rows rules out the rest.

A relation that counts holds on a share ``least`` or more of the rows in which
its columns are present.  Among rows drawn at random it then holds on fewer
than ``least`` - sqrt(ln(1 / RISK) / 2n) with a chance below RISK (Hoeffding's
inequality), whatever the data, so that what falls below is ruled out.  What
is left is for exact passes over all rows to decide: the sample only says what
need not be tried.  Of a table of at most ``ROWS`` rows the sample is the table,
and no chance is left.

The relations grow with the cube of the columns, their votes with a bounded
number of rows; targets are dealt to tasks.  Relations whose columns are
present together in too few sampled rows to be ruled out are left in.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumen.session import workers_import

#: Rows that vote, and how many of them do at first and then, of relations that are left.
ROWS = 4096
STEPS = (64, 512, ROWS)
#: The chance that a relation that counts is ruled out at a step.
RISK = 1e-15
#: Differences up to which a sum and a product hold, and what doubles may add to them as a share of the numbers.
SUM, PRODUCT, FLOAT = 1e-9, 1e-6, 1e-12
KINDS = ("sum", "product", "length")
SEED = 11


def votes_needed(n, least: float, whole: bool = False):
    """Of n present rows, how many must agree for a relation not to be ruled out; ``whole``: there are no other rows."""
    slack = 0.0 if whole else np.sqrt(math.log(1 / RISK) / (2 * np.maximum(n, 1)))
    return n * (least - slack) - 1e-9


def _agree(kind: str, own, a, b, offset):
    """Where a relation holds: arrays of equal shape, or that widen to one."""
    with np.errstate(invalid="ignore", over="ignore"):
        if kind == "sum":
            return np.abs(own - a - b - offset) <= SUM + FLOAT * (np.abs(own) + np.abs(a) + np.abs(b))
        if kind == "product":
            return np.abs(own - a * b) <= PRODUCT + FLOAT * (np.abs(own) + np.abs(a * b))
        return own == a


def for_target(x: np.ndarray, numeric: int, t: int, offsets: list, least: float) -> list[tuple[int, int, int, int, int]]:
    """(t, a, b, kind, offset's place) of the relations for column t of the sample x that are not ruled out; columns from ``numeric`` on are lengths."""
    rows, whole = len(x), len(x) < ROWS
    sizes = sorted({min(s, rows) for s in STEPS})
    head, last = x[: sizes[0]], whole and len(sizes) == 1
    own, there = head[:, t, None], ~np.isnan(head)
    left = [(t, c, -1, 2, 0) for c in range(numeric, x.shape[1])]
    others = np.array([c for c in range(numeric) if c != t], dtype=int)
    for i, a in enumerate(others):
        bs = others[i + 1 :]
        one, two = head[:, a, None], head[:, bs]
        need = votes_needed((there[:, t, None] & there[:, a, None] & there[:, bs]).sum(0), least, last)
        for kind, places in ((0, range(len(offsets))), (1, range(1))):
            for k in places:
                held = _agree(KINDS[kind], own, one, two, offsets[k] if kind == 0 else 0).sum(0) >= need
                left += [(t, int(a), int(b), kind, k) for b in bs[held]]
    for n in sizes:
        part, done = x[:n], whole and n == rows

        def holds(r: tuple) -> bool:
            _, a, b, kind, k = r
            cols = [part[:, c] for c in (t, a, b) if c >= 0]
            seen = ~np.isnan(cols[0] + cols[1] + cols[-1])
            return _agree(KINDS[kind], cols[0], cols[1], cols[-1], offsets[k])[seen].sum() >= votes_needed(int(seen.sum()), least, done)

        left = [r for r in left if holds(r)]
    return sorted(left)


def possible(df: DataFrame, numeric: list[str], texts: list[str], offsets: list, least: float) -> list[tuple[str, str, list[str], float]]:
    """(target, kind, sources, offset) of every relation that may hold on a share ``least`` of rows, in the order of targets, sources, kinds and offsets."""
    if not numeric or len(numeric) < 3 and not texts:
        return []
    values = [F.col(f"`{c}`").cast("double").alias(f"v{i}") for i, c in enumerate(numeric)] + [F.char_length(f"`{c}`").cast("double").alias(f"l{i}") for i, c in enumerate(texts)]
    x = df.select(*values).orderBy(F.rand(SEED)).limit(ROWS).toPandas().to_numpy(dtype="float64", na_value=np.nan)  # at most ROWS rows
    n = len(numeric)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [r for t in batch["id"] for r in for_target(x, n, int(t), offsets, least)]
            yield pd.DataFrame(found, columns=["t", "a", "b", "kind", "k"])

    spark = workers_import(df.sparkSession)
    targets = spark.range(0, n, 1, min(n, spark.sparkContext.defaultParallelism))
    found = targets.mapInPandas(run, "t int, a int, b int, kind int, k int").collect()  # what the vote leaves
    names = [*numeric, *texts]
    return [(names[r["t"]], KINDS[r["kind"]], [names[c] for c in (r["a"], r["b"]) if c >= 0], offsets[r["k"]]) for r in sorted(found, key=tuple)]
