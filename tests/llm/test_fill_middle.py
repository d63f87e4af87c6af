import hashlib
import random

import numpy as np
import pytest
from helpers import EDGES, clashing, frame, sentences
from pyspark.sql import functions as F

from lumen.llm import fill_middle as m


def brute(i, t, seed=1):
    t = t or ""
    h = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * j : 8 * j + 8], 16) for j in range(4))
    n = len(t)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not t or any(x in t for x in m.MARKS) or h3 % 100 >= 90:
        return n, "plain", None, None, t
    p, mid, s = t[:a], t[a:b], t[b:]
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{mid}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{mid}"


def texts(seed=1):
    r = random.Random(seed)
    wide = ["é中文😀 a" * r.randint(1, 40) for _ in range(20)]
    odd = ["<P> in it", "a<S", "<", "S>", "x<M>y", "<P", "<M", "<S<S", "ends with <"]
    return sentences(60, seed) + wide + odd * 4 + EDGES + ["the same text"] * 50 + [None, ""] * 5


def rows_of(df):
    return sorted(((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in df.collect()), key=repr)


def test_lists_select_every_boundary():
    r = random.Random(3)
    for t in ["", "a", "é", "😀" * 700, "a" * 5000, "é" * 3000, *["".join(r.choices("aé中😀", k=r.randint(0, 900))) for _ in range(60)]]:
        n, *own = m.encode_boundaries(np.frombuffer(t.encode(), np.uint8))
        assert n == len(t)
        for i in {0, n, n // 2, *r.choices(range(n + 1), k=20)}:
            assert m.select(i, *own) == len(t[:i].encode())
    bits = sum(8 * len(x) for x in m.encode_boundaries(np.frombuffer(("aé" * 50_000).encode(), np.uint8))[2:4])
    assert bits < 3.1 * 100_000  # two to three bits for each code point


def test_against_brute_force(spark):
    t = texts()
    df = m.fill_in_middle(frame(spark, t))
    assert rows_of(df) == sorted(((i, *brute(i, x)) for i, x in enumerate(t)), key=repr)
    assert {r["form"] for r in df.select("form").distinct().collect()} == {"plain", "psm", "spm"}
    back = df.select("doc_id", m.restore(F.col("output"), F.col("form")).alias("t")).collect()
    assert all(r["t"] == (t[r["doc_id"]] or "") for r in back)


@pytest.mark.parametrize("digest", [lambda c: F.length(c), lambda c: F.lit(1)])
def test_texts_that_share_a_digest_are_told_apart(spark, digest):
    t = texts(2)
    got = m.fill_in_middle(frame(spark, t), digest=digest, piece=20)
    assert rows_of(got) == sorted(((i, *brute(i, x)) for i, x in enumerate(t)), key=repr)


def test_hot_texts_go_in_pieces(spark):
    t = ["one very common text é"] * 400 + sentences(100, 4) + [None] * 90
    got = m.fill_in_middle(frame(spark, t), piece=32, share=0.0)
    assert rows_of(got) == sorted(((i, *brute(i, x)) for i, x in enumerate(t)), key=repr)


def test_other_seed_and_shares(spark):
    t = sentences(200, 5)
    got = rows_of(m.fill_in_middle(frame(spark, t), seed=7))
    assert got == sorted(((i, *brute(i, x, 7)) for i, x in enumerate(t)), key=repr)
    assert m.fill_in_middle(frame(spark, t), percent=0).where("form <> 'plain'").count() == 0
    assert m.fill_in_middle(frame(spark, t), percent=100, spm=100).where("form <> 'spm'").count() == 0


def test_long_text_null_and_repeated_ids_clashing_columns_empty_table(spark):
    long = "wörd 中文 " * 300_000
    rows = [(3, long), (3, "another"), (None, "no id"), (None, None), (5, "x" * 3_000_000)]
    got = m.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string"))
    assert rows_of(got) == sorted(((i, *brute(i, t)) for i, t in rows), key=repr)
    assert m.fill_in_middle(clashing(spark, ["q r s", "q r s"])).count() == 2
    assert m.fill_in_middle(frame(spark, ["x"]).limit(0)).count() == 0


def test_query_against_its_sql(spark, small):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{small}/documents.parquet'")
    cols = "doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256"
    got = sorted(tuple(r) for r in m.query(spark, small).select(*cols.split(", ")).collect())
    assert got == sorted(con.sql(f"select {cols} from ({m.ORACLE})").fetchall())
