import hashlib
import random
import re

import numpy as np
import pytest
from helpers import EDGES, clashing, frame, sentences

from lumen.llm import substring_dedup as m

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, k):
    first = {}
    words = [(i, WORD.findall(t or "")) for i, t in rows]
    for i, w in words:
        for j in range(len(w) - k + 1):
            g = tuple(w[j : j + k])
            if i is not None:
                first[g] = min(first.get(g, i), i)
    out = []
    for i, w in words:
        gone = set()
        for j in range(len(w) - k + 1):
            if i is not None and first[tuple(w[j : j + k])] < i:
                gone |= set(range(j, j + k))
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[0] is None, r))


def mixed(seed):
    r = random.Random(seed)
    base = sentences(40, seed, 80, 60)
    out = list(base)
    for _ in range(40):
        w = random.Random(r.random()).choice(base).split()
        a = r.randrange(len(w))
        out.append(" ".join([*base[r.randrange(40)].split()[:5], *w[a:], "\n", *base[r.randrange(40)].split()[:20]]))
    return out + ["same " * 500, "same " * 30 + "other", *EDGES, base[0], base[0]]


@pytest.mark.parametrize(("k", "bucket", "hot", "most", "parts"), [(13, 1_000_000, 250_000, 4_000_000, 20_000), (13, 500, 40, 100, 20_000), (3, 300, 5, 60, 3), (13, 20, 400, 1000, 4)])
def test_against_brute_force(spark, monkeypatch, k, bucket, hot, most, parts):
    monkeypatch.setattr(m, "PARTITIONS", parts)
    monkeypatch.setattr(m, "SHARE", 1e-9)
    rows = list(enumerate(mixed(k)))
    got = m.dedup_substrings(frame(spark, [t for _, t in rows]), k, keep=["doc_id"], bucket=bucket, hot=hot, most=most)
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got.collect()) == brute(rows, k)


def test_null_and_repeated_ids_clashing_columns_empty_table(spark):
    text = " ".join(f"w{i}" for i in range(20))
    rows = [(5, text), (5, text), (None, text), (9, text), (2, "short")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = m.dedup_substrings(df, keep=["doc_id"], full=False)
    found = sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got.collect()), key=lambda r: (r[0] is None, r))
    assert found == brute(rows, 13)
    x = m.dedup_substrings(clashing(spark, [text, text]))
    assert sorted((r["doc_id"], r["n_words"], r["kept_text"], r["key"]) for r in x.collect()) == [(0, 20, text, "x"), (1, 20, "", "x")]
    assert m.dedup_substrings(df.limit(0)).count() == 0


def test_windows_of_hot_minimisers_travel_packed():
    """A hot minimiser's windows are dealt by their second one, and few rows and bytes come of it."""
    import pyarrow as pa

    texts = [" ".join([*t.split()[:20], "internationally", *t.split()[20:]]) for t in sentences(300, 5, 80, 3000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(300)), pa.array([1] * 300), pa.array(texts)], ["doc_id", "crc", "text"])
    none = np.zeros(0, np.uint64)
    hot = next(iter(m._counts(13, none)([batch.select(["text"])])))
    values = np.sort(np.array([v for v, n in zip(hot.column(0).to_pylist(), hot.column(1).to_pylist()) if v is not None and n > 1000], np.int64).view(np.uint64))
    assert len(values) >= 1
    plain, split = (sum(len(p) for b in m._deal(13, 50, h, none)([batch]) for p in b.column(2).to_pylist()) for h in (none, values))
    assert split < 1.5 * plain


def test_sql_agrees(spark, small):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{small}/documents.parquet'")
    want = sorted(con.sql(f"select doc_id, n_words, n_removed, kept_sha256 from ({m.ORACLE})").fetchall())
    assert sorted(tuple(r) for r in m.query(spark, small).collect()) == want
