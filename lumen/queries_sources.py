"""Registered queries of sources: tables written as files, checked and read again."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumen.queries import query, t
from lumen.session import shared_dir
from lumen.sources import integrity, readers, records, sinks


@query("src05_quoted_csv", "select doc_id, source, n_chars, length(text) as length, md5(text) as digest from documents")
def _(spark, d):
    path = f"{shared_dir(spark)}/documents"
    sinks.save_csv(t(spark, d, "documents").select("doc_id", "source", "n_chars", "text"), path)
    df = readers.read_csv(spark, path)
    return df.select(F.col("doc_id").cast("long"), "source", F.col("n_chars").cast("long"), F.length("text").cast("long").alias("length"), F.md5(F.col("text").cast("binary")).alias("digest"))


# Orders as lines: every 50th has one field too many, every 7th a quoted line end, every 90th text after its closing quote, every 1000th a NUL; one in 400 is two records in one, with quotes.


def _lines(spark, d):
    k = F.col("o_orderkey")
    plain = F.concat_ws(",", k, "o_custkey", "o_orderstatus")
    quoted = F.concat(k.cast("string"), F.lit(","), F.col("o_custkey").cast("string"), F.lit(',"'), F.col("o_orderstatus"), F.lit('\n""x"", ""\n"'))
    line = (
        F.when(k % 400 == 0, F.concat_ws(",", plain, F.lit("'a'"), plain)).when(k % 90 == 0, F.concat(k.cast("string"), F.lit(',"b"c,'), F.col("o_orderstatus")))
        .when(k % 50 == 0, F.concat(plain, F.lit(",more"))).when(k % 7 == 0, quoted).when(k % 1000 == 1, F.concat(plain, F.lit("\0"))).otherwise(plain)
    )
    path = f"{shared_dir(spark)}/orders"
    t(spark, d, "orders").select(line.alias("value")).write.text(path)
    return path


_FIELDS = "case when o_orderkey % 400 = 0 then 7 when o_orderkey % 90 <> 0 and o_orderkey % 50 = 0 then 4 else 3 end"
_ERROR = "o_orderkey % 400 <> 0 and o_orderkey % 90 = 0"
_NUL = "o_orderkey % 400 <> 0 and o_orderkey % 90 <> 0 and o_orderkey % 50 <> 0 and o_orderkey % 7 <> 0 and o_orderkey % 1000 = 1"


@query("src12_record_widths", f"select {_FIELDS} as fields, count(*) as n, count(*) filter (where {_ERROR}) as errors, (count(*) filter (where {_NUL}))::bigint as nuls from orders group by 1")
def _(spark, d):
    found = integrity.record_counts(records.read_records(spark, _lines(spark, d)))
    return found.groupBy("fields").agg(F.sum("n").alias("n"), F.sum("errors").alias("errors"), F.sum("nuls").alias("nuls"))


@query(
    "src12_integrity",
    f"""with x as (select {_FIELDS} as fields, {_ERROR} as bad, {_NUL} as nul from orders), u as (select fields from x group by 1 order by count(*) desc limit 1)
    select * from (select 'parse_error' as kind, 'block' as action, count(*) filter (where bad) as affected from x union all select 'nul_bytes', 'flag', count(*) filter (where nul) from x
    union all select 'ragged', case when count(*) filter (where fields <> (from u)) >= 0.1 * count(*) then 'block' else 'flag' end, count(*) filter (where fields <> (from u)) from x
    union all select 'concatenated', 'block', count(*) filter (where fields >= 2 * (from u)) from x) where affected >= case kind when 'concatenated' then 3 else 1 end""",
)
def _(spark, d):
    report = integrity.check_csv(spark, _lines(spark, d), delimiter=",")
    return spark.createDataFrame([(f["kind"], f["action"], f["affected"]) for f in report["findings"]], "kind string, action string, affected long")
