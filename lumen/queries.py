"""Registered queries of the engine's operators, each with the SQL that it must agree with.

Names begin with the operator's id of the inventory.  Cleaning operators run on
projections that are dirtied the same way on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumen import vocab
from lumen.functions import columns as C
from lumen.operators import charts, importance, lookups, outliers, pairs, rows, select, summaries
from lumen.session import workers_import

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return workers_import(spark).read.parquet(f"{d}/{name}.parquet")


# Projections with faults, the same on both sides.

DIRTY_ORDERS = """select o_orderkey, o_orderdate, case when o_orderkey % 17 = 0 then null else o_totalprice end as price,
 case when o_orderkey % 23 = 0 then null when o_orderkey % 11 = 0 then concat(' ', lower(o_orderpriority)) when o_orderkey % 29 = 0 then 'N/A' else o_orderpriority end as priority,
 case when o_orderkey % 13 = 0 then null else o_orderstatus end as status, case when o_orderkey % 97 = 0 then o_totalprice * 100 else o_totalprice end as amount from orders"""
DIRTY_LINES = """select l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_tax, case when l_orderkey % 201 = 0 then l_quantity + l_tax + 1 else l_quantity + l_tax end as total,
 case when l_orderkey % 19 = 0 then -l_quantity else l_quantity end as item_count, case when l_orderkey % 31 = 0 then 150.0 else l_quantity end as age,
 l_shipdate as start_date, case when l_orderkey % 37 = 0 then l_shipdate - interval '3' day else l_shipdate + interval '3' day end as end_date from lineitem"""


def dirty(spark: SparkSession, d: str, sql: str) -> DataFrame:
    for name in ("orders", "lineitem"):
        if f"from {name}" in sql:
            t(spark, d, name).createOrReplaceTempView(name)
    return spark.sql(sql)


# Sources.


@query("src08_parquet_scan", "select n_nationkey, n_name, n_regionkey from nation")
def _(spark, d):
    from lumen.sources.readers import read_any

    return read_any(spark, f"{d}/nation.parquet").select("n_nationkey", "n_name", "n_regionkey")


# Row queries.

for _name, _args, _where in [
    ("eq", ("o_orderstatus", "==", "F"), "o_orderstatus = 'F'"),
    ("ne", ("o_orderstatus", "!=", "F"), "o_orderstatus is distinct from 'F'"),
    ("gt", ("o_totalprice", ">", 400000), "o_totalprice > 400000"),
    ("le", ("o_totalprice", "<=", 2000), "o_totalprice <= 2000"),
    ("contains", ("o_orderpriority", "contains", "^[12]-"), "regexp_matches(o_orderpriority, '^[12]-', 'i')"),
    ("startswith", ("o_orderpriority", "startswith", "3-m"), "starts_with(lower(o_orderpriority), '3-m')"),
    ("endswith", ("o_orderpriority", "endswith", "LOW"), "suffix(lower(o_orderpriority), 'low')"),
]:
    QUERIES[f"sel01_filter_{_name}"] = lambda spark, d, a=_args: select.filter_rows(t(spark, d, "orders"), *a, limit=None).select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    SQL[f"sel01_filter_{_name}"] = f"select o_orderkey, o_orderstatus, o_totalprice, o_orderpriority from orders where {_where}"


@query("sel01_filter_first_rows", "select o_orderkey, o_totalprice from orders where o_totalprice > 300000 order by o_orderkey limit 20")
def _(spark, d):
    return select.filter_rows(t(spark, d, "orders"), "o_totalprice", ">", 300000, order="o_orderkey", limit=20).select("o_orderkey", "o_totalprice")


@query("sel06_percentage", "select count(*) filter (where o_orderstatus = 'O') as matching, count(*) as total, round(100.0 * count(*) filter (where o_orderstatus = 'O') / count(*), 2) as percentage, round(100 - 100.0 * count(*) filter (where o_orderstatus = 'O') / count(*), 2) as inverse from orders")
def _(spark, d):
    return select.percentage(t(spark, d, "orders"), "o_orderstatus", "==", "o".upper())


@query("sel10_row", "select n_name, n_regionkey from nation where n_nationkey = 6")
def _(spark, d):
    return select.row(select.with_rid(t(spark, d, "nation"), "n_nationkey"), 7, ["n_name", "n_regionkey"])


@query("sel11_row_range", "select n_nationkey, n_name from nation where n_nationkey between 4 and 8")
def _(spark, d):
    return select.rows(select.with_rid(t(spark, d, "nation"), "n_nationkey"), 5, 10, ["n_nationkey", "n_name"])


@query("sel12_unique_values", "select p_brand as value, count(*) as count, round(100.0 * count(*) / (select count(p_brand) from part), 2) as percentage from part where contains(lower(p_brand), '#1') group by 1")
def _(spark, d):
    return select.unique_values(t(spark, d, "part"), "p_brand", search="#1", limit=100)


@query("sel13_dataset_info", " union all ".join(f"select '{c}' as \"column\", count({c}) as count, round(min({c})::double, 6) as min, round(max({c})::double, 6) as max, round(avg({c}), 6) as mean, round(stddev_samp({c}), 6) as std from part" for c in ("p_partkey", "p_size", "p_retailprice")))
def _(spark, d):
    return select.dataset_info(t(spark, d, "part"))


@query("agg14_missing_by_column", "with d as (" + DIRTY_ORDERS + ") " + " union all ".join(f"select '{c}' as \"column\", count(*) - count({c}) as missing, round(100.0 * (count(*) - count({c})) / count(*), 2) as percentage from d" for c in ("o_orderkey", "o_orderdate", "price", "priority", "status", "amount")))
def _(spark, d):
    return select.missing_by_column(dirty(spark, d, DIRTY_ORDERS))


@query("sel17_missing_mask", "with d as (" + DIRTY_ORDERS + ") select count(*) as rows, count(*) filter (where priority is null) as nulls, count(*) filter (where trim(priority) = '') as blanks, count(*) filter (where lower(trim(priority)) in ('?','na','n/a','nan','null','missing','not applicable','n.a.','n.a')) as tokens from d")
def _(spark, d):
    return rows.missing_mask_counts(dirty(spark, d, DIRTY_ORDERS), "priority")


# Joins.

_STAR = "select o_orderkey, o_totalprice, o_orderstatus, o_orderpriority, c_mktsegment, n_name, r_name from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey"


def star(spark: SparkSession, d: str) -> DataFrame:
    o, c, n, r = (t(spark, d, x) for x in ("orders", "customer", "nation", "region"))
    return o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority", "c_mktsegment", "n_name", "r_name")


@query("jon00_star", _STAR)
def _(spark, d):
    return star(spark, d)


@query("jon01_row_integrity", "select count(*) as foreign_rows from (select o_orderkey, o_custkey + (o_orderkey % 50 = 0)::int as o_custkey from orders) a where not exists (select 1 from orders b where b.o_orderkey = a.o_orderkey and b.o_custkey = a.o_custkey)")
def _(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", "o_custkey")
    changed = o.withColumn("o_custkey", F.col("o_custkey") + (F.col("o_orderkey") % 50 == 0).cast("int"))
    return rows.rows_not_in(changed, o, ["o_orderkey", "o_custkey"]).agg(F.count("*").alias("foreign_rows"))


@query("jon02_split_contamination", "with x as (select l_orderkey % 5 = 0 as test, l_quantity, l_discount, l_returnflag from lineitem), k as (select distinct l_quantity, l_discount, l_returnflag from x where not test) select count(*) as rows, count(k.l_quantity) as contaminated, round(count(k.l_quantity) / count(*), 6) as share from (select * from x where test) a left join k using (l_quantity, l_discount, l_returnflag)")
def _(spark, d):
    x = t(spark, d, "lineitem").select((F.col("l_orderkey") % 5 == 0).alias("test"), "l_quantity", "l_discount", "l_returnflag")
    return rows.contamination(x.where("not test"), x.where("test"), ["l_quantity", "l_discount", "l_returnflag"])


@query("jon03_key_overlap", "select distinct o_custkey from orders where o_orderkey % 2 = 0 and o_custkey in (select o_custkey from orders where o_orderkey % 2 <> 0)")
def _(spark, d):
    o = t(spark, d, "orders")  # two sides that together hold every order
    return rows.key_overlap(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 <> 0"), "o_custkey")


@query("jon04_mapping", "select o_orderkey, case o_orderstatus when 'F' then 'finished' when 'O' then 'open' else o_orderstatus end as o_orderstatus from orders")
def _(spark, d):
    return rows.apply_mapping(t(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", {"F": "finished", "O": "open"})


@query("jon05_frequency_encode", "select p_partkey, round(count(*) over (partition by p_type) / count(*) over (), 6) as frequency from part")
def _(spark, d):
    return rows.frequencies(t(spark, d, "part"), "p_type").select("p_partkey", C.rounded(F.col("frequency")).alias("frequency"))


@query("jon08_newest", "select o_custkey, max(o_orderdate) as latest, arg_max(o_orderkey, (o_orderdate, o_orderkey)) as o_orderkey from orders group by 1")
def _(spark, d):
    return rows.newest(t(spark, d, "orders"), "o_custkey", "o_orderdate", "o_orderkey")


# Summaries.


def _numeric_sql(table: str, columns: list[str]) -> str:
    return " union all ".join(
        f"""select '{c}' as "column", count(*) as rows, count({c}) as count, count(*) - count({c}) as nulls, round(100.0 * (count(*) - count({c})) / count(*), 6) as null_pct, count(distinct {c}) as "unique",
 count(*) filter (where {c} = 0) as zeros, count(*) filter (where {c} < 0) as negatives, round(sum({c})::double, 2) as sum, round((sum({c}::decimal(38,12)) / count({c}))::decimal(38,9), 6)::double as mean, round(quantile_cont({c}, 0.5)::double, 6) as median,
 round(min({c})::double, 6) as min, round(max({c})::double, 6) as max, round((max({c}) - min({c}))::double, 6) as range, round(quantile_cont({c}, 0.25)::double, 6) as q1, round(quantile_cont({c}, 0.75)::double, 6) as q3,
 round((quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25))::double, 6) as iqr, round(quantile_cont({c}, 0.05)::double, 6) as p5, round(quantile_cont({c}, 0.95)::double, 6) as p95, round(stddev_samp({c}), 6) as std, round(var_samp({c}), 2) as variance,
 round(skewness({c}), 4) as skewness, round(kurtosis({c}), 4) as kurtosis, round(case when count({c}) > 1 and avg({c}) <> 0 then stddev_samp({c}) / abs(avg({c})) end, 6) as cv, round(stddev_samp({c}) / sqrt(count({c})), 6) as sem, min({c}) = max({c}) as constant from {table}"""
        for c in columns
    )


@query("sta04_numeric_summary", _numeric_sql("lineitem", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]))
def _(spark, d):
    return summaries.numeric_summary(t(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])


@query("sta04_numeric_summary_events", _numeric_sql("events", ["value"]))
def _(spark, d):
    return summaries.numeric_summary(t(spark, d, "events"), ["value"])


@query("srt01_top_values", "select l_returnflag as value, count(*) as count, round(100.0 * count(*) / (select count(*) from lineitem), 2) as percentage from lineitem group by 1")
def _(spark, d):
    return summaries.top_values(t(spark, d, "lineitem"), "l_returnflag")


@query("sta05_categorical_summary", "with d as (" + DIRTY_ORDERS + "), c as (select status as value, count(*) as n from d group by 1), s as (select coalesce(sum(n) filter (where value is not null), 0) as t, coalesce(sum(n) filter (where value is null), 0) as nulls from c) select (select t from s)::bigint as count, (select nulls from s)::bigint as nulls, count(value) as \"unique\", arg_min(value, (-n, value)) as top, max(n) as top_count, round(-sum(n / (select t from s) * log2(n / (select t from s))), 4) as entropy, count(value) = 1 as constant from c where value is not null")
def _(spark, d):
    return summaries.categorical_summary(dirty(spark, d, DIRTY_ORDERS), "status")


@query("agg15_entropy_epsilon", "with c as (select c_mktsegment as v, count(*) as n from customer group by 1), s as (select sum(n) as t from c) select count(*) as classes, min(n) as smallest, max(n) as largest, round(-sum(n / t * log2(n / t + 1e-9)), 4) as entropy, round(min(n) / max(n), 6) as ratio, min(n) / max(n) > 0.5 as balanced, min(n) / max(n) < 0.2 as imbalanced from c, s")
def _(spark, d):
    return summaries.class_balance(t(spark, d, "customer"), "c_mktsegment")


@query("agg27_imbalance", "with c as (select toxic as v, count(*) as n from labels where toxic is not null group by 1), s as (select sum(n) as t from c) select count(*) as classes, min(n) as smallest, max(n) as largest, round(-sum(n / t * log2(n / t + 1e-9)), 4) as entropy, round(min(n) / max(n), 6) as ratio, min(n) / max(n) > 0.5 as balanced, min(n) / max(n) < 0.2 as imbalanced from c, s")
def _(spark, d):
    return summaries.class_balance(t(spark, d, "labels"), "toxic")


@query("sta06_boolean_summary", "select count(*) as count, 0::bigint as nulls, count(*) filter (where quality = 1) as true_count, count(*) filter (where quality <> 1) as false_count, round(100.0 * count(*) filter (where quality = 1) / count(*), 2) as true_pct from labels")
def _(spark, d):
    return summaries.boolean_summary(t(spark, d, "labels").select((F.col("quality") == 1).alias("good")), "good")


@query("sta07_datetime_summary", "select count(ts) as count, count(*) - count(ts) as nulls, min(ts) as first, max(ts) as last, floor(date_part('epoch', max(ts) - min(ts)) / 86400)::bigint + 1 as span_days, bool_and(date_trunc('day', ts) = ts) as dates_only, count(distinct ts::date) as days from events")
def _(spark, d):
    return summaries.datetime_summary(t(spark, d, "events"), "ts")


@query("dat04_month_histogram", "with c as (select month(o_orderdate)::int as month, count(*) as count from orders group by 1) select month, count, month = (select arg_min(month, (-count, month)) from c) as peak from c")
def _(spark, d):
    return summaries.month_histogram(t(spark, d, "orders"), "o_orderdate")


@query("sta08_text_summary", "select count(text) as count, count(distinct text) as \"unique\", round(avg(length(text)), 2) as avg_length, min(length(text))::int as min_length, max(length(text))::int as max_length, count(*) filter (where trim(text) = '') as blanks, sum(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')))::bigint as words from documents")
def _(spark, d):
    return summaries.text_summary(t(spark, d, "documents"), "text")


@query("agg03_profile_columns", " union all ".join(f"select '{c}' as \"column\", '{k}' as type, count({c}) as count, count(*) - count({c}) as nulls, count(distinct {c}) as \"unique\", round(count(distinct {c}) / count({c}), 6) as unique_ratio from orders" for c, k in [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"), ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string")]))
def _(spark, d):
    return summaries.profile_columns(t(spark, d, "orders"))


@query("agg04_group_statistics", f"with s as ({_STAR}) select c_mktsegment as \"group\", round(avg(o_totalprice), 6) as mean, round(quantile_cont(o_totalprice, 0.5), 6) as median, round(stddev_samp(o_totalprice), 6) as std, count(*) as count from s group by 1 order by 2 desc limit 12")
def _(spark, d):
    return summaries.group_statistics(star(spark, d), "c_mktsegment", "o_totalprice")


@query("agg05_top_group_means", f"with s as ({_STAR}) select n_name as \"group\", round(avg(o_totalprice), 6) as mean, round(quantile_cont(o_totalprice, 0.5), 6) as median, count(*) as count from s group by 1 order by 2 desc, 1 limit 5")
def _(spark, d):
    return summaries.top_group_means(star(spark, d), "n_name", "o_totalprice", digits=6)


@query("agg06_segments", f"with s as ({_STAR}), g as (select r_name as segment, avg(o_totalprice) as m, quantile_cont(o_totalprice, 0.5) as d, stddev_samp(o_totalprice) as s, count(*) as count from s group by 1), b as (select avg(m) as base, max(m) as top, min(m) as low, count(*) as k, min(count) as least from g) select segment, round(m, 6) as mean, round(d, 6) as median, round(s, 6) as std, count, round((m - base) / abs(base) * 100, 2) as diff_pct, round((m - base) / greatest(s, 0.01), 4) as effect_size, round(least((top - low) / abs(low) * 100, 200), 2) as gap_pct from g, b where k >= 2 and least >= 5")
def _(spark, d):
    return summaries.segments(star(spark, d), "r_name", "o_totalprice")


@query("agg08_lift", f"with s as ({_STAR}), n as (select o_orderstatus as a, o_orderpriority as b, count(*) as n from s group by 1, 2) select a, b, n, round(n * sum(n) over () / (sum(n) over (partition by a) * sum(n) over (partition by b)), 4) as lift from n")
def _(spark, d):
    return summaries.lift(star(spark, d), "o_orderstatus", "o_orderpriority")


@query("agg09_text_length_by_class", "select quality as class, count(text) as count, round(avg(length(text)), 2) as avg_length, round(quantile_cont(length(text), 0.5), 2) as median_length, max(length(text))::int as max_length, round(avg(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''))), 2) as avg_words from documents join labels using (doc_id) group by 1")
def _(spark, d):
    return summaries.text_length_by_class(t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id"), "quality", "text")


@query("agg10_missing_by_class", "with d as (" + DIRTY_ORDERS + ") select status as \"group\", count(*) as rows, count(*) - count(price) as missing, round(100.0 * (count(*) - count(price)) / count(*), 2) as missing_pct from d where status is not null group by 1")
def _(spark, d):
    return summaries.missing_by_group(dirty(spark, d, DIRTY_ORDERS), "status", "price")


@query("agg12_target_thresholds", "select round(avg(value), 6) as mean, round(quantile_cont(value, 0.5), 6) as median, round(stddev_samp(value), 6) as std, round(min(value), 6) as min, round(max(value), 6) as max, round(quantile_cont(value, 0.25), 6) as q25, round(quantile_cont(value, 0.75), 6) as q75, round(quantile_cont(value, 0.9), 6) as q90, round(quantile_cont(value, 0.95), 6) as q95, round(skewness(value), 4) as skewness, count(*) filter (where value = 0) as zeros from events")
def _(spark, d):
    return summaries.target_thresholds(t(spark, d, "events"), "value")


@query("agg13_over_representation", "with c as (select quantile_cont(value, 0.9) as cut from events), x as (select event_type || '-' || (user_id % 7) as g, value >= cut as top from events, c), n as (select g, count(*) filter (where top) as top, count(*) filter (where not top) as rest from x group by 1), s as (select *, (top / sum(top) over ()) / (rest / sum(rest) over ()) as r from n) select g as \"group\", top, rest, round(r, 4) as ratio from s where r > 1.25")
def _(spark, d):
    e = t(spark, d, "events").withColumn("g", F.concat_ws("-", "event_type", (F.col("user_id") % 7).cast("string")))
    return summaries.over_representation(e, "g", "value")


@query("agg14_missing_summary", "with d as (" + DIRTY_ORDERS + "), x as (select (price is null)::int as a, (priority is null)::int as b, (status is null)::int as c from d) select count(*) * 6 as cells, sum(a + b + c)::bigint as missing, round(100.0 * sum(a + b + c) / (count(*) * 6), 4) as missing_pct, ((sum(a) > 0)::int + (sum(b) > 0)::int + (sum(c) > 0)::int)::bigint as columns_with_missing, 0::bigint as columns_all_missing, count(*) filter (where a + b + c > 0) as rows_with_missing from x")
def _(spark, d):
    return summaries.missing_summary(dirty(spark, d, DIRTY_ORDERS))


@query("agg28_duplicate_rows", "with g as (select l_quantity, l_discount, l_tax, l_returnflag, count(*) as n from lineitem group by 1, 2, 3, 4) select sum(n)::bigint as rows, sum(n - 1)::bigint as duplicates, max(n) as largest_group from g")
def _(spark, d):
    return select.duplicate_rows(t(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax", "l_returnflag"])


# Values of all columns of orders as text, told apart by their form.
_MIXED = "select unnest([o_orderstatus, o_orderpriority, o_totalprice::varchar, strftime(o_orderdate, '%Y-%m-%d'), (o_totalprice > 100000)::varchar]) as x from orders"


@query("agg22_value_classes", f"with s as ({_MIXED}) select case when regexp_full_match(x, '[0-9]+([.][0-9]+)?') then 'numeric' when x in ('true', 'false') then 'boolean' when try_cast(x as date) is not null then 'date' else 'text' end as class, count(*) as n from s where x is not null group by 1")
def _(spark, d):
    o = t(spark, d, "orders")
    x = F.array("o_orderstatus", "o_orderpriority", F.col("o_totalprice").cast("string"), F.date_format("o_orderdate", "yyyy-MM-dd"), (F.col("o_totalprice") > 100000).cast("string"))
    return summaries.value_classes(o.select(F.explode(x).alias("x")), "x")


# Rows in order.


@query("win01_duplicate_flags", "select l_orderkey, l_linenumber, row_number() over (partition by l_quantity, l_discount, l_tax order by l_orderkey * 10 + l_linenumber) > 1 as is_duplicate from lineitem")
def _(spark, d):
    x = t(spark, d, "lineitem").withColumn("o", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return rows.duplicate_flags(x, ["l_quantity", "l_discount", "l_tax"], "o").select("l_orderkey", "l_linenumber", "is_duplicate")


@query("win03_sequential_share", "with x as (select o_orderkey - lag(o_orderkey) over (order by o_orderkey) as d from orders) select count(d) as differences, count(*) filter (where d = 1) as ones, round(count(*) filter (where d = 1) / count(d), 6) as share from x")
def _(spark, d):
    return rows.sequential_share(t(spark, d, "orders"), "o_orderkey", "o_orderkey")


@query("win05_average_ranks", "select p_partkey, rank() over (order by p_size) + (count(*) over (partition by p_size) - 1) / 2.0 as rank from part")
def _(spark, d):
    return rows.average_ranks(t(spark, d, "part"), "p_size").select("p_partkey", "rank")


@query("win06_quartile_bins", "with q as (select quantile_cont(value, 0.25) as a, quantile_cont(value, 0.5) as b, quantile_cont(value, 0.75) as c from events) select (value > a)::int + (value > b)::int + (value > c)::int as bin, count(*) as n, round(avg(value), 6) as mean from events, q group by 1")
def _(spark, d):
    return rows.quartile_bins(t(spark, d, "events"), "value").groupBy("bin").agg(F.count("*").alias("n"), C.rounded(F.avg("value")).alias("mean"))


@query("win07_median_split", "with m as (select quantile_cont(l_quantity, 0.5) as a, quantile_cont(l_discount, 0.5) as b from lineitem) select (l_quantity >= a)::int as l_quantity_high, (l_discount >= b)::int as l_discount_high, count(*) as n, round(avg(l_extendedprice), 4) as mean from lineitem, m group by 1, 2")
def _(spark, d):
    x = rows.median_split(t(spark, d, "lineitem"), ["l_quantity", "l_discount"])
    return x.groupBy("l_quantity_high", "l_discount_high").agg(F.count("*").alias("n"), C.rounded(F.avg("l_extendedprice"), 4).alias("mean"))


@query("win08_top_one", "with n as (select c_nationkey, c_mktsegment, count(*) as count from customer group by 1, 2) select c_nationkey, max(count) as count, arg_min(c_mktsegment, (-count, c_mktsegment)) as c_mktsegment from n group by 1")
def _(spark, d):
    return rows.top_one(t(spark, d, "customer"), "c_nationkey", "c_mktsegment")


@query("win09_canonical_spellings", "with d as (" + DIRTY_ORDERS + "), n as (select lower(trim(priority)) as fold, priority as variant, count(*) as n, min(o_orderkey) as first from d where priority is not null group by 1, 2), b as (select fold, arg_min(variant, (-n, first)) as canonical, count(*) as k, max(n) / sum(n) as dominance from n group by 1 having count(*) > 1) select n.fold, variant, n, canonical, round(dominance, 6) as dominance from n join b using (fold)")
def _(spark, d):
    x = rows.canonical_spellings(dirty(spark, d, DIRTY_ORDERS), "priority", C.fold_case, "o_orderkey")
    return x.withColumn("dominance", C.rounded(F.col("dominance")))


@query("win11_daily_counts", "with n as (select ts::date as day, count(*) as n from events where ts is not null group by 1), r as (select unnest(generate_series(min(day)::timestamp, max(day)::timestamp, interval 1 day))::date as day from n) select r.day, coalesce(n.n, 0) as n from r left join n using (day)")
def _(spark, d):
    return rows.daily_counts(t(spark, d, "events"), "ts")


# Sets.


@query("set01_union", "select r_regionkey::bigint as key, r_name as name, null::int as region from region union all select n_nationkey, n_name, n_regionkey from nation")
def _(spark, d):
    r = t(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("key"), F.col("r_name").alias("name"))
    n = t(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("key"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    return rows.union_all([r, n])


@query("set02_keep_first", "select doc_id, lang, source from documents where doc_id in (select min(doc_id) from documents group by text)")
def _(spark, d):
    return rows.keep_first(t(spark, d, "documents"), ["text"], "doc_id").select("doc_id", "lang", "source")


@query("set03_null_where_in", "select o_orderkey, case when o_orderpriority not in ('5-LOW', '1-URGENT') then o_orderpriority end as o_orderpriority from orders")
def _(spark, d):
    return rows.null_where_in(t(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", ["5-LOW", "1-URGENT"])


@query("set04_containment", "select count(*) as distinct, count(*) filter (where x not in ('Monday','Tuesday','Wednesday','Thursday','Friday')) as outside from (select distinct dayname(o_orderdate) as x from orders)")
def _(spark, d):
    return rows.contained(t(spark, d, "orders").select(C.day_name(F.col("o_orderdate")).alias("x")), "x", vocab.WEEKDAYS[:5])


@query("set05_token_hits", "with d as (" + DIRTY_ORDERS + ") select distinct lower(trim(priority)) as token from d where lower(trim(priority)) in ('n/a', 'null')")
def _(spark, d):
    return rows.token_hits(dirty(spark, d, DIRTY_ORDERS), "priority", ["n/a", "null"])


# Scalars.


@query("str01_trim_collapse", "with d as (" + DIRTY_ORDERS + ") select o_orderkey, regexp_replace(regexp_replace(priority, '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g') as priority from d")
def _(spark, d):
    return dirty(spark, d, DIRTY_ORDERS).select("o_orderkey", C.collapse(C.trim_all(F.col("priority"))).alias("priority"))


@query("str04_separator_key", "select o_orderkey, lower(regexp_replace(trim(o_orderpriority), '[\\s_-]+', '', 'g')) as key from orders")
def _(spark, d):
    return t(spark, d, "orders").select("o_orderkey", C.separator_key(F.col("o_orderpriority")).alias("key"))


@query("str06_regex_extract", "select c_custkey, try_cast(nullif(regexp_extract(trim(c_name), '[0-9]+$'), '') as bigint) as number from customer")
def _(spark, d):
    return t(spark, d, "customer").select("c_custkey", C.ticket_number(F.col("c_name")).alias("number"))


@query("str08_word_count", "select doc_id, length(text)::int as chars, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''))::int as words from documents")
def _(spark, d):
    return t(spark, d, "documents").select("doc_id", F.char_length("text").alias("chars"), C.word_count(F.col("text")).alias("words"))


@query("str12_url_domain", "select page_id, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]+)', 1)), '^www\\.', '') as domain from pages")
def _(spark, d):
    return t(spark, d, "pages").select("page_id", C.url_domain(F.col("url")).alias("domain"))


@query("str14_accounting_number", "select p_partkey, case when p_partkey % 2 = 0 then -p_retailprice else p_retailprice end as price from part")
def _(spark, d):
    p = F.col("p_retailprice").cast("string")
    shown = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("("), p, F.lit(")"))).otherwise(F.concat(F.lit("$ "), p))
    return t(spark, d, "part").select("p_partkey", C.accounting_number(shown).alias("price"))


@query("str16_split_values", "select p_partkey, len(string_split(p_type, ' '))::int as parts from part")
def _(spark, d):
    return t(spark, d, "part").select("p_partkey", F.size(C.split_values(F.col("p_type"), " ")).alias("parts"))


@query("str09_pattern_signature", "select distinct 'a8s1d' || length(regexp_extract(c_name, '[0-9]+$')) as signature from customer")
def _(spark, d):
    return t(spark, d, "customer").select(C.pattern_signature(F.col("c_name")).alias("signature")).distinct()


@query("dat01_parse_datetime", "select o_orderkey, o_orderdate::date as day from orders")
def _(spark, d):
    m = F.col("o_orderkey") % 3
    shown = F.when(m == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(m == 1, F.date_format("o_orderdate", "MM/dd/yyyy")).otherwise(F.date_format("o_orderdate", "dd.MM.yyyy"))
    return t(spark, d, "orders").select("o_orderkey", F.to_date(C.parse_datetime(shown)).alias("day"))


@query("dat02_weekday", "select o_orderkey, dayname(o_orderdate) as day, isodow(o_orderdate)::int as number, year(o_orderdate)::int as y, month(o_orderdate)::int as m, day(o_orderdate)::int as dd from orders")
def _(spark, d):
    c = F.col("o_orderdate")
    return t(spark, d, "orders").select("o_orderkey", C.day_name(c).alias("day"), C.iso_weekday(c).alias("number"), F.year(c).alias("y"), F.month(c).alias("m"), F.dayofmonth(c).alias("dd"))


@query("mth02_zscore", "select event_id, round((value - avg(value) over ()) / stddev_samp(value) over (), 6) as z from events")
def _(spark, d):
    e = t(spark, d, "events")
    m = e.agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s"))
    return e.join(F.broadcast(m)).select("event_id", C.rounded((F.col("value") - F.col("m")) / F.col("s")).alias("z"))  # one row


@query("mth09_derived", "select l_orderkey, l_linenumber, l_quantity * l_extendedprice as product, l_quantity + l_tax + 2 as total from lineitem")
def _(spark, d):
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", C.derived("product", sources=["l_quantity", "l_extendedprice"]).alias("product"), C.derived("sum_offset", sources=["l_quantity", "l_tax"], offset=2).alias("total"))


@query("arr01_five_numbers", "with x as (select vec_id, list_transform(embedding, lambda e: e::double) as e from embeddings) select vec_id, round(list_aggregate(e, 'quantile_cont', 0.25), 6) as q1, round(list_aggregate(e, 'quantile_cont', 0.5), 6) as median, round(list_aggregate(e, 'quantile_cont', 0.75), 6) as q3 from x")
def _(spark, d):
    e = t(spark, d, "embeddings").select("vec_id", C.five_numbers(F.transform("embedding", lambda x: x.cast("double"))).alias("f"))
    return e.select("vec_id", *[C.rounded(F.col(f"f.{k}")).alias(k) for k in ("q1", "median", "q3")])


# Pairs.

_LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("biv03_pearson_pairs", " union all ".join(f"select '{a}' as a, '{b}' as b, round(corr({a}, {b}), 6) as r, count(*) as n from lineitem" for i, a in enumerate(_LINE) for b in _LINE[i + 1 :]))
def _(spark, d):
    return pairs.pearson_pairs(t(spark, d, "lineitem"), _LINE)


@query("biv01_spearman", "with x as (select rank() over (order by p_size) + (count(*) over (partition by p_size) - 1) / 2.0 as a, rank() over (order by p_retailprice) + (count(*) over (partition by p_retailprice) - 1) / 2.0 as b from part) select 'p_size' as a, 'p_retailprice' as b, round(corr(a, b), 6) as r, count(*) as n from x")
def _(spark, d):
    return pairs.spearman(t(spark, d, "part"), "p_size", "p_retailprice")


@query("biv04_kendall", "with x as (select a.p_size as x1, b.p_size as x2, (a.p_partkey % 13) as y1, (b.p_partkey % 13) as y2 from part a join part b on a.p_partkey < b.p_partkey) select 'p_size' as a, 'y' as b, round(sum(sign(x1 - x2) * sign(y1 - y2)) / sqrt(count(*) filter (where x1 <> x2)::double * count(*) filter (where y1 <> y2)), 6) as r, (select count(*) from part) as n from x")
def _(spark, d):
    return pairs.kendall(t(spark, d, "part").withColumn("y", F.col("p_partkey") % 13), "p_size", "y")


@query("biv08_anova", f"with s as ({_STAR}), g as (select r_name, count(*) as n, avg(o_totalprice) as m, var_samp(o_totalprice) as v from s group by 1), u as (select count(*) as k, sum(n) as n, sum(n * m) / sum(n) as mean, sum((n - 1) * v) as ssw from g), b as (select sum(g.n * (m - mean) ** 2) as ssb from g, u), f as (select k, n, ssb, ssw, (ssb / (k - 1)) / (ssw / (n - k)) as f from u, b) select k, n::bigint as n, round(f, 4) as f, round(f / (f + n - k), 6) as score, round(ssb / (ssb + ssw), 6) as eta_squared from f")
def _(spark, d):
    return pairs.anova(star(spark, d), "r_name", "o_totalprice")


_CHI = """with s as (select {a} as a, {b} as b from {t}), o as (select a, b, count(*) as n from s group by 1, 2), ra as (select a, sum(n) as ra from o group by 1), rb as (select b, sum(n) as rb from o group by 1),
 c as (select coalesce(o.n, 0) as n, ra * rb / (select sum(n) from o) as e, (select count(*) from ra) as r, (select count(*) from rb) as k from ra cross join rb left join o using (a, b)),
 x as (select max(r) as rows, max(k) as columns, sum(n)::bigint as n, sum(case when r = 2 and k = 2 then (abs(n - e) - least(0.5, abs(n - e))) ** 2 / e else (n - e) ** 2 / e end) as chi from c)
 select n, rows, columns, round(chi, 4) as chi2, round(sqrt(chi / (n * (least(rows, columns) - 1))), 6) as cramers_v from x"""


@query("biv09_chi_square", _CHI.format(a="o_orderstatus", b="o_orderpriority", t="orders"))
def _(spark, d):
    return pairs.chi_square(t(spark, d, "orders"), "o_orderstatus", "o_orderpriority")


@query("biv09_chi_square_yates", _CHI.format(a="quality", b="toxic", t="labels"))
def _(spark, d):
    return pairs.chi_square(t(spark, d, "labels"), "quality", "toxic")


@query("biv10_welch", "with g as (select l_returnflag as g, avg(l_extendedprice) as m, var_samp(l_extendedprice) as v, count(*) as n from lineitem group by 1), x as (select a.n as n1, b.n as n2, a.m as m1, b.m as m2, a.v / a.n as p, b.v / b.n as q from g a, g b where a.g = 'A' and b.g = 'R') select n1, n2, round((m1 - m2) / sqrt(p + q), 6) as t, round((p + q) ** 2 / (p * p / (n1 - 1) + q * q / (n2 - 1)), 4) as df from x")
def _(spark, d):
    return pairs.welch(t(spark, d, "lineitem"), "l_returnflag", "l_extendedprice", "A", "R")


_RANKS = "with x as (select {g} as g, rank() over (order by {v}) + (count(*) over (partition by {v}) - 1) / 2.0 as r, {v} as v from {t} where {w}), t as (select sum(n ** 3 - n) as ties from (select count(*) as n from x group by v))"


@query("biv11_mann_whitney", _RANKS.format(g="toxic", v="length(text)", t="documents join labels using (doc_id)", w="toxic in (0, 1)") + ", u as (select count(*) filter (where g = 1) as n1, count(*) filter (where g = 0) as n2, sum(r) filter (where g = 1) as s from x) select n1, n2, round(s - n1 * (n1 + 1) / 2, 2) as u, round(ties, 2) as ties, round(abs(1 - 2 * (s - n1 * (n1 + 1) / 2) / (n1 * n2)), 6) as effect from u, t")
def _(spark, d):
    x = t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id").withColumn("n", F.char_length("text"))
    return pairs.mann_whitney(x, "toxic", "n", 1, 0)


@query("biv12_kruskal", _RANKS.format(g="event_type", v="value", t="events", w="value is not null") + ", s as (select g, count(*) as n, sum(r) as s from x group by 1), y as (select count(*) as k, sum(n) as n, sum(s * s / n) as s from s), h as (select k, n, (12 / (n * (n + 1)) * s - 3 * (n + 1)) / (1 - ties / (n ** 3 - n)) as h from y, t) select k, n::bigint as n, round(h, 4) as h, round(h / (n - 1), 6) as score from h")
def _(spark, d):
    return pairs.kruskal(t(spark, d, "events"), "event_type", "value")


@query("agg21_contingency", "select l_returnflag as a, l_linestatus as b, count(*) as n from lineitem group by 1, 2")
def _(spark, d):
    return pairs.contingency(t(spark, d, "lineitem"), "l_returnflag", "l_linestatus")


_ASSOC = "with x as (select toxic::varchar as g, quality as q, n_chars as v, rank() over (order by quality) + (count(*) over (partition by quality) - 1) / 2.0 as rq, rank() over (order by n_chars) + (count(*) over (partition by n_chars) - 1) / 2.0 as rv, lang from documents join labels using (doc_id))"


def _kruskal_sql(rank: str, value: str) -> str:
    return f"(select round((12 / (n * (n + 1)) * s - 3 * (n + 1)) / (1 - t / (n ** 3 - n)) , 4) as h, n from (select sum(n)::double as n, sum(s * s / n) as s from (select g, count(*) as n, sum({rank}) as s from x group by 1)), (select sum(n::double ** 3 - n) as t from (select count(*) as n from x group by {value})))"


@query(
    "biv13_target_associations",
    _ASSOC + ", c as (select g, lang, count(*) as n from x group by 1, 2), e as (select coalesce(c.n, 0) as n, ra * rb / (select sum(n) from c) as e, (select count(distinct g) from c) as r, (select count(distinct lang) from c) as k from (select g, sum(n) as ra from c group by 1) cross join (select lang, sum(n) as rb from c group by 1) left join c using (g, lang)), v as (select round(sqrt(round(sum((n - e) ** 2 / e), 20) / (sum(n) * (least(max(r), max(k)) - 1))), 6) as score from e),"
    + f" s as (select 'quality' as feature, 'kruskal' as method, round((select (12 / (n * (n + 1)) * s - 3 * (n + 1)) / (1 - t / (n ** 3 - n)) / (n - 1) from {_kruskal_sql('rq', 'q').replace('round((12 / (n * (n + 1)) * s - 3 * (n + 1)) / (1 - t / (n ** 3 - n)) , 4) as h, n', '*')}), 6) as score union all select 'n_chars', 'kruskal', round((select (12 / (n * (n + 1)) * s - 3 * (n + 1)) / (1 - t / (n ** 3 - n)) / (n - 1) from {_kruskal_sql('rv', 'v').replace('round((12 / (n * (n + 1)) * s - 3 * (n + 1)) / (1 - t / (n ** 3 - n)) , 4) as h, n', '*')}), 6) union all select 'lang', 'cramers_v', score from v)"
    + " select feature, method, score, row_number() over (order by score desc nulls last, feature)::int as rank from s",
)
def _(spark, d):
    x = t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id").select("quality", "toxic", "lang", "n_chars")
    return pairs.target_associations(x.withColumn("toxic", F.col("toxic").cast("string")), "toxic", ["quality", "lang", "n_chars"])


# Outliers.

_OUT = """with f as (select quantile_cont(value, 0.25) as a, quantile_cont(value, 0.75) as b, quantile_cont(value, 0.5) as m from events), g as (select a - 1.5 * (b - a) as lower, b + 1.5 * (b - a) as upper, m from f),
 d as (select quantile_cont(abs(value - m), 0.5) as mad from events, g)"""


@query("out01_outliers", _OUT + " select 'value' as \"column\", round(lower, 6) as lower, round(upper, 6) as upper, count(*) filter (where value < lower or value > upper) as outliers, round(100.0 * count(*) filter (where value < lower or value > upper) / count(*), 4) as percentage, case when 100.0 * count(*) filter (where value < lower or value > upper) / count(*) >= 10 then 'high' when 100.0 * count(*) filter (where value < lower or value > upper) / count(*) >= 1 then 'medium' else 'low' end as severity, round(min(value) filter (where value < lower or value > upper), 6) as min_outlier, round(max(value) filter (where value < lower or value > upper), 6) as max_outlier, round(count(*) filter (where (value < lower or value > upper) and abs(value - m) > 3.5 * 1.4826 * mad) / count(*) filter (where value < lower or value > upper), 6) as mad_share from events, g, d group by lower, upper")
def _(spark, d):
    return outliers.outliers(t(spark, d, "events"), ["value"])


@query("out04_flags", _OUT + " select event_id, (value < lower or value > upper)::tinyint as \"value_OutlierFlag\" from events, g")
def _(spark, d):
    return outliers.with_flags(t(spark, d, "events"), ["value"]).select("event_id", "value_OutlierFlag")


@query("out01_zscore_outliers", "with f as (select avg(value) as m, stddev_samp(value) as s from events) select event_id, (value < m - 1.5 * s or value > m + 1.5 * s)::tinyint as \"value_OutlierFlag\" from events, f")
def _(spark, d):
    return outliers.with_flags(t(spark, d, "events"), ["value"], "zscore").select("event_id", "value_OutlierFlag")


@query("out06_box_statistics", "with q as (select event_type as g, quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.5) as m, quantile_cont(value, 0.75) as q3 from events group by 1), x as (select q.*, value, value between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1) as ok from events join q on g = event_type) select g as \"group\", round(q1, 6) as q1, round(m, 6) as median, round(q3, 6) as q3, round(min(value) filter (where ok), 6) as whisker_low, round(max(value) filter (where ok), 6) as whisker_high, count(*) filter (where not ok) as outliers, count(*) as n from x group by g, q1, m, q3")
def _(spark, d):
    return outliers.box_statistics(t(spark, d, "events"), "event_type", "value")


# Charts.


@query("cht04_histogram", "with s as (select count(value) as n, min(value) as a, max(value) as b, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) as iqr from events), k as (select a, b, ceil((b - a) / least(2 * iqr / n ** (1 / 3), (b - a) / (log2(n) + 1)))::int as k from s), x as (select least(floor((value - a) * k / (b - a)), k - 1)::int as bin, a, b, k from events, k) select bin, round(a + (bin + 0.5) * (b - a) / k, 6) as midpoint, count(*) as n from x group by bin, a, b, k")
def _(spark, d):
    return charts.histogram(t(spark, d, "events"), "value")


@query("agg25_bars", "select event_type as x, round(avg(value), 6) as y from events group by 1")
def _(spark, d):
    return charts.bars(t(spark, d, "events"), "event_type", "value")


@query("agg26_shares", "select event_type as x, round(sum(value), 2) as y from events group by 1")
def _(spark, d):
    return charts.shares(t(spark, d, "events"), "event_type", "value")


@query("cht05_line", "select date_trunc('month', o_orderdate)::timestamp as x, round(avg(o_totalprice), 4) as y from orders group by 1")
def _(spark, d):
    return charts.line(t(spark, d, "orders"), "o_orderdate", "o_totalprice", "month").withColumn("x", F.col("x").cast("timestamp_ntz"))


@query("cht06_scatter", "select l_quantity as x, l_extendedprice as y from lineitem")
def _(spark, d):
    return charts.scatter(t(spark, d, "lineitem"), "l_quantity", "l_extendedprice")


@query("cht10_top_domains", "with n as (select page_id % 5 as x, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]+)', 1)), '^www\\.', '') as domain, count(*) as n from pages group by 1, 2) select x, arg_min(domain, (-n, domain)) as domain, max(n) as n from n where domain <> '' group by 1")
def _(spark, d):
    return charts.top_domains(t(spark, d, "pages").withColumn("g", F.col("page_id") % 5), "g", "url")


@query("srt07_box_order", "select event_type as \"group\", round(quantile_cont(value, 0.5), 6) as median from events group by 1")
def _(spark, d):
    return charts.box_order(t(spark, d, "events"), "event_type", "value")


# Detectors on dirtied rows.


@query("det04_near_duplicates", "with d as (" + DIRTY_ORDERS + "), a as (select sum(n - 1) as e, sum(n) as r from (select count(*) as n from d group by priority, status)), b as (select sum(n - 1) as e from (select count(*) as n from d group by lower(trim(priority)), lower(trim(status)))) select a.e::bigint as exact, b.e::bigint as normalised, (b.e - a.e)::bigint as extra, round((b.e - a.e) / r, 6) as share from a, b")
def _(spark, d):
    return rows.near_duplicates(dirty(spark, d, DIRTY_ORDERS), ["priority", "status"])


@query("det01_missing_together", "with d as (" + DIRTY_ORDERS + ") select count(*) filter (where price is null and status is null) as together, count(*) - count(price) as a, count(*) - count(status) as b, count(*) as n from d")
def _(spark, d):
    x = dirty(spark, d, DIRTY_ORDERS)
    p, s = F.col("price").isNull(), F.col("status").isNull()
    return x.agg(F.count_if(p & s).alias("together"), F.count_if(p).alias("a"), F.count_if(s).alias("b"), F.count("*").alias("n"))


def _evidence(spark, d, sql, detectors, columns=None):
    """Evidence of detectors as rows."""
    from lumen.plans import cleaning, profile

    x = dirty(spark, d, sql)
    x = x.select(*columns) if columns else x
    ps = profile.profile(x)
    found = [e for f in detectors for e in f(x, ps, cleaning.Rules())]
    return spark.createDataFrame([(e.column, e.problem, int(e.count), round(float(e.ratio), 6)) for e in found], "column string, problem string, n long, ratio double")


@query("det01_missing_values", "with d as (" + DIRTY_ORDERS + "), x as (select count(*) filter (where price is null) as a, count(*) filter (where priority is null or trim(priority) = '' or lower(trim(priority)) in ('?','na','n/a','nan','null','missing','not applicable','n.a.','n.a')) as b, count(*) filter (where status is null or trim(status) = '') as c, count(*) as n from d) select 'price' as \"column\", 'missing_values' as problem, a as n, round(a / n, 6) as ratio from x union all select 'priority', 'missing_values', b, round(b / n, 6) from x union all select 'status', 'missing_values', c, round(c / n, 6) from x")
def _(spark, d):
    from lumen.plans import cleaning

    return _evidence(spark, d, DIRTY_ORDERS, [cleaning.detect_missing]).where("problem = 'missing_values'")


@query("det05_invalid_values", "with d as (" + DIRTY_LINES + "), x as (select count(*) filter (where item_count < 0) as a, count(*) filter (where age < 0 or age > 130) as b, count(*) as n from d) select 'item_count' as \"column\", 'invalid_values' as problem, a as n, round(a / n, 6) as ratio from x union all select 'age', 'invalid_values', b, round(b / n, 6) from x")
def _(spark, d):
    from lumen.plans import cleaning

    return _evidence(spark, d, DIRTY_LINES, [cleaning.detect_invalid], ["item_count", "age"])


@query("det17_order_violations", "with d as (" + DIRTY_LINES + ") select 'start_date' as \"column\", 'order_violations' as problem, count(*) filter (where start_date > end_date) as n, round(count(*) filter (where start_date > end_date) / count(*), 6) as ratio from d")
def _(spark, d):
    from lumen.plans import cleaning

    return _evidence(spark, d, DIRTY_LINES, [cleaning.detect_constraints], ["start_date", "end_date"])


@query("det13_derived_sum", "with d as (" + DIRTY_LINES + ") select 'total' as \"column\", 'derived_violations' as problem, count(*) filter (where abs(total - (l_quantity + l_tax)) > 1e-9) as n, round(count(*) filter (where abs(total - (l_quantity + l_tax)) > 1e-9) / count(*), 6) as ratio from d")
def _(spark, d):
    from lumen.plans import cleaning

    return _evidence(spark, d, DIRTY_LINES, [cleaning.detect_derived], ["l_quantity", "l_tax", "total"]).where("column = 'total'")


@query("det14_derived_length", "with d as (select case when doc_id % 61 = 0 then n_chars + 3 else n_chars end as n, text from documents) select 'n_chars' as \"column\", 'derived_violations' as problem, count(*) filter (where n <> length(text)) as n, round(count(*) filter (where n <> length(text)) / count(n - length(text)), 6) as ratio from d")
def _(spark, d):
    from lumen.plans import cleaning, profile

    x = t(spark, d, "documents").select(F.when(F.col("doc_id") % 61 == 0, F.col("n_chars") + 3).otherwise(F.col("n_chars")).alias("n_chars"), "text")
    found = cleaning.detect_derived(x, profile.profile(x), cleaning.Rules())
    return spark.createDataFrame([(e.column, e.problem, int(e.count), round(float(e.ratio), 6)) for e in found], "column string, problem string, n long, ratio double")


@query("det09_encoding_artifacts", "select count(*) filter (where regexp_matches(html, '&(#[0-9]+|#x[0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);')) as entities, count(*) filter (where regexp_matches(html, '</?[a-zA-Z][^>]*>')) as tags, count(*) as n from pages")
def _(spark, d):
    return t(spark, d, "pages").agg(F.count_if(F.col("html").rlike(C.ENTITY)).alias("entities"), F.count_if(F.col("html").rlike(C.TAG)).alias("tags"), F.count("*").alias("n"))


@query("det19_implausible_times", "select count(*) filter (where o_orderdate > timestamp '1998-01-01' or year(o_orderdate) < 1900) as n from orders")
def _(spark, d):
    from datetime import datetime

    from lumen.plans import cleaning, profile

    x = t(spark, d, "orders").select("o_orderdate")
    e = cleaning.detect_times(x, profile.profile(x), cleaning.Rules(), datetime(1997, 12, 31))
    return spark.createDataFrame([(sum(k.count for k in e),)], "n long")


@query("act01_fill_median", "with d as (" + DIRTY_ORDERS + "), m as (select quantile_cont(price, 0.5) as m from d) select o_orderkey, coalesce(price, m) as price from d, m")
def _(spark, d):
    from lumen.plans import cleaning, profile

    x = dirty(spark, d, DIRTY_ORDERS).select("o_orderkey", "price")
    ps = profile.profile(x)
    e = cleaning.detect_missing(x, ps, cleaning.Rules())[0]
    choice = cleaning.decide(e, x, ps, cleaning.Policy())
    return cleaning.ACTIONS[choice.action](x, "price", choice.params, "o_orderkey")


@query("act04_map_spellings", "with d as (" + DIRTY_ORDERS + ") select o_orderkey, case when priority is null or priority = 'N/A' then priority else upper(trim(priority)) end as priority from d")
def _(spark, d):
    from lumen.plans import cleaning, profile

    x = dirty(spark, d, DIRTY_ORDERS).select("o_orderkey", "priority")
    e = cleaning.detect_spellings(x, profile.profile(x), cleaning.Rules())[0]
    return cleaning.ACTIONS["map_values"](x, "priority", e.facts, "o_orderkey")


@query("act07_recompute", "with d as (" + DIRTY_LINES + ") select l_orderkey, l_linenumber, l_quantity + l_tax as total from d")
def _(spark, d):
    from lumen.plans import cleaning

    x = dirty(spark, d, DIRTY_LINES)
    y = cleaning.ACTIONS["recompute"](x, "total", {"formula": {"op": "sum_offset", "sources": ["l_quantity", "l_tax"], "offset": 0}}, "l_orderkey")
    return y.select("l_orderkey", "l_linenumber", "total")


@query("cln01_clean")
def _(spark, d):
    from lumen.plans import cleaning

    return cleaning.Cleaner().run(dirty(spark, d, DIRTY_ORDERS), "o_orderkey").df


@query("act09_html_unescape")
def _(spark, d):
    return t(spark, d, "pages").select("page_id", C.html_unescape(F.col("html")).alias("html"))


@query("fea02_one_hot", "select o_orderkey, " + ", ".join(f"(o_orderstatus = '{v}')::int as \"o_orderstatus_{v}\"" for v in "FOP") + " from orders")
def _(spark, d):
    from lumen.plans import features

    return features.one_hot(t(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", ["F", "O", "P"])


@query("fea02_scale", "select p_partkey, round((p_retailprice - avg(p_retailprice) over ()) / stddev_pop(p_retailprice) over (), 6) as p_retailprice from part")
def _(spark, d):
    from lumen.plans import features

    return features.scale(t(spark, d, "part").select("p_partkey", "p_retailprice"), ["p_retailprice"]).withColumn("p_retailprice", C.rounded(F.col("p_retailprice")))


@query("fea02_model_ready")
def _(spark, d):
    from lumen.plans import features

    return features.prepare(t(spark, d, "orders").select("o_totalprice", "o_orderstatus", "o_orderpriority", "o_orderdate"), "o_totalprice")


@query("mln04_purity", "with n as (select quality as f, toxic as t, count(*) as n from labels group by 1, 2), g as (select f, max(n) as top, sum(n) as a from n group by 1) select sum(a)::bigint as n, round(sum(top) / sum(a), 6) as purity from g")
def _(spark, d):
    from lumen.plans import target

    return target.purity(t(spark, d, "labels"), "quality", "toxic").withColumn("purity", C.rounded(F.col("purity")))


@query("mln07_classification_metrics", "with x as (select (l_returnflag = 'R')::int as y, (l_quantity > 40)::int as p from lineitem), n as (select y, p, count(*) as n from x group by 1, 2), a as (select y, sum(n) as s from n group by 1), c as (select p as y, sum(n) as c from n group by 1), k as (select y, n as tp from n where y = p), m as (select a.y, s, coalesce(tp, 0) as tp, coalesce(c, 0) as c from a left join k using (y) left join c using (y)), z as (select s, tp, case when c > 0 then tp / c else 0 end as pr, tp / s as rc from m), f as (select *, case when pr + rc > 0 then 2 * pr * rc / (pr + rc) else 0 end as f1 from z) select round(sum(tp) / sum(s), 4) as accuracy, round(sum(pr * s) / sum(s), 4) as precision, round(sum(rc * s) / sum(s), 4) as recall, round(sum(f1 * s) / sum(s), 4) as f1 from f")
def _(spark, d):
    from lumen.plans import ml

    x = t(spark, d, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("label"), (F.col("l_quantity") > 40).cast("int").alias("prediction"))
    return ml.classification_metrics(x)


@query("mln07_auc", "with x as (select (l_returnflag = 'R')::int as y, rank() over (order by l_quantity) + (count(*) over (partition by l_quantity) - 1) / 2.0 as r from lineitem) select round((sum(r) filter (where y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y)::double * (count(*) - sum(y))), 4) as auc from x")
def _(spark, d):
    from lumen.plans import ml

    return ml.auc(t(spark, d, "lineitem").withColumn("y", (F.col("l_returnflag") == "R").cast("int")), "y", "l_quantity")


@query("mln08_regression_metrics", "with x as (select p_retailprice as y, 900 + p_size * 10.0 as p from part), m as (select avg((y - p) ** 2) as mse, avg(abs(y - p)) as mae, var_pop(y) as v from x) select round(mse, 4) as mse, round(sqrt(round(mse, 4)), 4) as rmse, round(mae, 4) as mae, round(1 - mse / v, 4) as r2 from m")
def _(spark, d):
    from lumen.plans import ml

    x = t(spark, d, "part").select(F.col("p_retailprice").alias("label"), (900 + F.col("p_size") * 10.0).alias("prediction"))
    return ml.regression_metrics(x)


@query("mln03_train_regressor")
def _(spark, d):
    from lumen.plans import ml

    x = t(spark, d, "lineitem").select("l_quantity", "l_discount", "l_returnflag", "l_extendedprice")
    o = ml.train(x, "l_extendedprice", "linear_regression")
    return spark.createDataFrame([(o.status, o.model, float(o.metrics.get("r2", 0.0)))], "status string, model string, r2 double")


@query("prf03_target")
def _(spark, d):
    from lumen.plans import target

    x = target.detect_target(t(spark, d, "orders"), "orders_totalprice.csv")
    return spark.createDataFrame([(x.column, x.confidence, x.method, x.task)], "column string, confidence double, method string, task string")


@query("ins03_insights")
def _(spark, d):
    from lumen.plans import insights

    x = star(spark, d).select("o_totalprice", "o_orderstatus", "o_orderpriority", "c_mktsegment", "r_name")
    found = insights.insights(x, "o_totalprice")
    return spark.createDataFrame([(i.kind, i.feature, i.finding, float(i.confidence)) for i in found], "kind string, feature string, finding string, confidence double")


@query("ext01_windowed_counts", "select date_trunc('hour', ts)::timestamp as start, event_type, count(*) as n, round(avg(value), 6) as mean, min(value) as min, max(value) as max from events group by 1, 2")
def _(spark, d):
    from lumen.streaming.windows import windowed_counts

    x = windowed_counts(t(spark, d, "events"), "ts", "event_type", "value")
    return x.withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("mean", C.rounded(F.col("mean")))


# Lookups.


@query("sel14_column_stats", "with s as (select count(*)::double as rows, count(value)::double as count, (count(*) - count(value))::double as nulls, 100.0 * (count(*) - count(value)) / count(*) as null_pct, count(distinct value)::double as \"unique\", min(value) as min, max(value) as max, avg(value) as mean, stddev_samp(value) as std, count(*) filter (where value = 0)::double as zeros, quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.5) as median, quantile_cont(value, 0.75) as q3 from events) select measure, round(value, 4) as value from (unpivot s on columns(*) into name measure value value)")
def _(spark, d):
    return lookups.column_stats(t(spark, d, "events"), "value")


@query("sel14_column_stats_text", "with s as (select count(*)::double as rows, count(text)::double as count, (count(*) - count(text))::double as nulls, 100.0 * (count(*) - count(text)) / count(*) as null_pct, count(distinct text)::double as \"unique\", min(length(text))::double as min_length, max(length(text))::double as max_length, avg(length(text)) as mean_length from documents) select measure, round(value, 4) as value from (unpivot s on columns(*) into name measure value value)")
def _(spark, d):
    return lookups.column_stats(t(spark, d, "documents"), "text")


@query("sel14_top_coverage", "with n as (select o_orderpriority as value, count(*) as count, round(100.0 * count(*) / (select count(*) from orders), 2) as percentage from orders group by 1) select *, round(sum(percentage) over (order by count desc, value rows unbounded preceding), 2) as coverage from n order by count desc, value limit 10")
def _(spark, d):
    return lookups.top_coverage(t(spark, d, "orders"), "o_orderpriority")


@query("sel15_records", "select json_object('n_nationkey', n_nationkey, 'n_name', n_name, 'n_regionkey', n_regionkey)::varchar as record from nation order by n_nationkey limit 20")
def _(spark, d):
    return lookups.records(t(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), "n_nationkey")


@query("sel16_size_estimate", "select count(*) as rows, (count(*) * 16 + sum(strlen(o_orderpriority) + strlen(o_orderstatus)))::bigint as bytes from orders")
def _(spark, d):
    return lookups.size_estimate(t(spark, d, "orders").select(F.col("o_orderkey").cast("long").alias("k"), "o_totalprice", "o_orderpriority", "o_orderstatus"))


@query("sel21_overview", "with d as (" + DIRTY_ORDERS + ") select count(*) || ' rows, 3 columns (o_orderkey, price, status); missing: price: ' || (count(*) - count(price)) || ', status: ' || (count(*) - count(status)) as answer from d")
def _(spark, d):
    return lookups.overview(dirty(spark, d, DIRTY_ORDERS).select("o_orderkey", "price", "status"))


@query("agg20_token_budget", "with e as (select (500 + 50 * 3 + 100 * 2 + sum(length(n_nationkey::varchar) + length(n_name) + length(n_regionkey::varchar)) / 40 + least(count(distinct n_name), 20) * 10)::double as x from nation) select floor(x)::bigint as estimated, floor(x) <= 1000 as within, round(greatest(0, floor(x) - 1000) * 100.0 / 1000, 2) as overflow_pct from e")
def _(spark, d):
    return lookups.token_budget(t(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), 1000)


@query("win12_samples_by", "with x as (select o_orderstatus, o_orderkey, row_number() over (partition by o_orderstatus order by o_orderkey) as r, count(*) over (partition by o_orderstatus) as c from orders) select o_orderstatus, c as count, len(list(o_orderkey))::int as shown, min(o_orderkey) as first, max(o_orderkey) as last from x where r <= 100 group by 1, 2")
def _(spark, d):
    x = lookups.samples_by(t(spark, d, "orders"), "o_orderstatus", "o_orderkey")
    return x.select("o_orderstatus", "count", F.size("rows").alias("shown"), F.array_min("rows").alias("first"), F.array_max("rows").alias("last"))


@query("str13_is_url", "select count(url) as count, count(*) filter (where regexp_matches(url, '^https?://')) as urls, count(*) filter (where regexp_matches(url, '^https?://')) > 0.5 * count(url) as is_url from pages")
def _(spark, d):
    return lookups.is_url_column(t(spark, d, "pages"), "url")


@query("sta13_boolean_like", "with d as (select case when o_orderstatus = 'P' then 'pending' else ' ' || upper((o_totalprice > 100000)::varchar) end as x from orders) select count(x) as count, count(*) filter (where lower(trim(x)) in ('true', 'false')) as booleans, count(x) > 0 and count(x) = count(*) filter (where lower(trim(x)) in ('true', 'false')) as is_boolean from d")
def _(spark, d):
    x = F.when(F.col("o_orderstatus") == "P", "pending").otherwise(F.concat(F.lit(" "), F.upper((F.col("o_totalprice") > 100000).cast("string"))))
    return lookups.is_boolean_like(t(spark, d, "orders").select(x.alias("x")), "x")


# Importance.

_LINE_RANKS = "with r as (select " + ", ".join(f"rank() over (order by {c}) + (count(*) over (partition by {c}) - 1) / 2.0 as {c}" for c in _LINE) + " from lineitem)"


@query("biv15_correlation_table", _LINE_RANKS + ", c as (" + " union all ".join(f"select '{a}' as a, '{b}' as b, round(round(corr({a}, {b}), 6), 3) as r, count(*) as n from r" for i, a in enumerate(_LINE) for b in _LINE[i + 1 :]) + ") select a, b, r, n, case when abs(r) >= 0.7 then 'strong' when abs(r) >= 0.3 then 'moderate' else 'weak' end as strength, case when r > 0 then 'positive' when r < 0 then 'negative' else 'none' end as direction from c")
def _(spark, d):
    return importance.correlation_table(t(spark, d, "lineitem"), _LINE)


@query("biv16_target_correlations", _LINE_RANKS + " " + " union all ".join(f"select '{c}' as feature, round(round(corr({c}, l_extendedprice), 6), 3) as r, count(*) as n from r" for c in _LINE if c != "l_extendedprice"))
def _(spark, d):
    return importance.target_correlations(t(spark, d, "lineitem").select(*_LINE), "l_extendedprice")


@query("biv17_importance_proxy", _LINE_RANKS + " " + " union all ".join(f"select '{c}' as feature, abs(round(round(corr({c}, l_extendedprice), 6), 3)) as importance from r" for c in _LINE if c != "l_extendedprice"))
def _(spark, d):
    return importance.importance_proxy(t(spark, d, "lineitem").select(*_LINE), "l_extendedprice")


@query("biv18_numeric_importance", _LINE_RANKS + " " + " union all ".join(f"select '{c}' as feature, abs(round(round(corr({c}, l_extendedprice), 6), 3)) as importance, 'numeric' as type from r" for c in _LINE if c not in ("l_extendedprice", "l_tax")))
def _(spark, d):
    x = t(spark, d, "lineitem").select(*_LINE).withColumn("l_tax", F.when(F.xxhash64("l_extendedprice", "l_quantity") % 2 == 0, F.col("l_tax")))  # half of a column is missing
    return importance.numeric_importance(x, "l_extendedprice")


@query("biv19_categorical_importance", f"with s as ({_STAR}), " + ", ".join(f"g{i} as (select {c}, count(*) as n, avg(o_totalprice) as m, var_samp(o_totalprice) as v from s group by 1), f{i} as (select '{c.replace('r_name', 'region')}' as feature, (sum(n * (m - (select avg(o_totalprice) from s)) ** 2) / (count(*) - 1)) / (sum((n - 1) * v) / (sum(n) - count(*))) as f, sum(n) - count(*) as d from g{i})" for i, c in enumerate(("o_orderstatus", "c_mktsegment", "r_name"))) + " select * from (" + " union all ".join(f"select feature, round(round(f / (f + d), 6), 3) as importance, 'anova' as method from f{i}" for i in range(3)) + ") where importance > 0")
def _(spark, d):
    return importance.categorical_importance(star(spark, d).select("o_totalprice", "o_orderstatus", "c_mktsegment", F.col("r_name").alias("region")), "o_totalprice")


@query("biv20_mutual_information", "with q as (select " + ", ".join(f"quantile_cont({c}, {p}) as {c}_{i}" for c in ("l_quantity", "l_extendedprice") for i, p in enumerate((0.25, 0.5, 0.75))) + " from lineitem), x as (select " + ", ".join(f"({c} > {c}_0)::int + ({c} > {c}_1)::int + ({c} > {c}_2)::int as {n}" for c, n in (("l_quantity", "x"), ("l_extendedprice", "y"))) + " from lineitem, q), n as (select x, y, count(*) as n from x group by 1, 2) select round(sum(n / (select sum(n) from n) * log2(n * (select sum(n) from n) / (nx * ny))), 6) as bits from (select *, sum(n) over (partition by x) as nx, sum(n) over (partition by y) as ny from n)")
def _(spark, d):
    return importance.mutual_information(t(spark, d, "lineitem"), "l_quantity", "l_extendedprice")


@query("out07_target_severity", _OUT + ", o as (select count(*) filter (where value < lower or value > upper) as n, count(*) as t from events, g) select n as outliers, round(100.0 * n / t, 4) as percentage, case when 100.0 * n / t > 15 then 'high' when 100.0 * n / t > 5 then 'moderate' else 'low' end as severity from o")
def _(spark, d):
    return outliers.target_severity(t(spark, d, "events"), "value")


@query("agg07_class_distribution", "select c_mktsegment as value, count(*) as count, round(100.0 * count(*) / (select count(*) from customer), 2) as percentage from customer group by 1 order by 2 desc, 1 limit 10")
def _(spark, d):
    return summaries.class_distribution(t(spark, d, "customer"), "c_mktsegment")


@query("agg35_target_evidence", SQL["agg13_over_representation"].replace("select g as", "select x.*, e.* from (select g as", 1) + ") x, (select round(avg(value), 6) as mean, round(quantile_cont(value, 0.5), 6) as median, round(quantile_cont(value, 0.9), 6) as q90, round(quantile_cont(value, 0.95), 6) as q95 from events) e")
def _(spark, d):
    e = t(spark, d, "events").withColumn("g", F.concat_ws("-", "event_type", (F.col("user_id") % 7).cast("string")))
    return summaries.target_evidence(e, "value", "g")


# Charts of a plan.


@query("cht01_plan")
def _(spark, d):
    from lumen.plans import charts as plans

    x = star(spark, d).select("o_totalprice", "o_orderstatus", "c_mktsegment", "r_name").withColumn("half", F.col("o_totalprice") / 2)
    return spark.createDataFrame([(c.kind, c.x, c.y, c.of, not plans.problems(x, c)) for c in plans.plan(x, "o_totalprice")], "kind string, x string, y string, of string, valid boolean")


@query("cht03_missing_rates", "with d as (" + DIRTY_ORDERS + ") select status as x, round(100.0 * (count(*) - count(price)) / count(*), 2) as y from d where status is not null group by 1")
def _(spark, d):
    from lumen.plans import charts as plans

    return plans.draw(dirty(spark, d, DIRTY_ORDERS), plans.Chart("bar", "status", "price", of="missing"))


@query("cht08_heatmap", " union all ".join(f"select '{a}' as x, '{b}' as y, " + (f"round(corr({a}, {b}), 6)" if a != b else "1.0::double") + " as r" + (" from lineitem" if a != b else "") for a in _LINE for b in _LINE))
def _(spark, d):
    from lumen.plans import charts as plans

    return plans.heatmap(t(spark, d, "lineitem"), _LINE)


_BOX = "with s as ({src}), q as (select g, quantile_cont(v, 0.25) as q1, quantile_cont(v, 0.5) as m, quantile_cont(v, 0.75) as q3 from s group by 1), x as (select q.*, v, v between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1) as ok from s join q using (g)) select g as \"group\", round(q1, 6) as q1, round(m, 6) as median, round(q3, 6) as q3, round(min(v) filter (where ok), 6) as whisker_low, round(max(v) filter (where ok), 6) as whisker_high, count(*) filter (where not ok) as outliers, count(*) as n from x group by g, q1, m, q3"


@query("cht11_text_length_box", _BOX.format(src="select quality as g, length(text)::double as v from documents join labels using (doc_id) where text is not null and quality is not null"))
def _(spark, d):
    from lumen.plans import charts as plans

    return plans.draw(t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id"), plans.Chart("box", "quality", "text", of="text"))


@query("cht12_fallback_line", "select date_trunc('day', o_orderdate)::timestamp as x, round((sum(o_totalprice::decimal(38,12)) / count(o_totalprice))::decimal(38,9), 4)::double as y from orders group by 1")
def _(spark, d):
    from lumen.plans import charts as plans

    x = t(spark, d, "orders").select("o_orderdate", "o_totalprice", "o_orderstatus")
    return plans.data(x, plans.fallback(x)[0]).withColumn("x", F.col("x").cast("timestamp_ntz"))


@query("cht13_draw_pie", "select o_orderstatus as x, round(sum(o_totalprice), 2) as y from orders group by 1")
def _(spark, d):
    from lumen.plans import charts as plans

    return plans.draw(t(spark, d, "orders"), plans.Chart("pie", "o_orderstatus", "o_totalprice"))


@query("cht15_missing_share", "with d as (" + DIRTY_ORDERS + ") select round(count(distinct priority) / count(priority), 6) as ratio, round((count(*) - count(priority)) / count(*), 6) as missing from d")
def _(spark, d):
    from lumen.plans import charts as plans

    return plans.missing_share(dirty(spark, d, DIRTY_ORDERS), "priority")


@query("cht16_text_lengths", "select doc_id, length(text)::int as text_length from documents")
def _(spark, d):
    from lumen.plans import charts as plans

    return plans.text_lengths(t(spark, d, "documents"), "text").select("doc_id", "text_length")


# Insights' numbers.

_HALVES = "with m as (select quantile_cont(l_quantity, 0.5) as a, quantile_cont(l_discount, 0.5) as b from lineitem), x as (select (l_quantity >= a)::int as l_quantity_high, (l_discount >= b)::int as l_discount_high, l_extendedprice as v from lineitem, m)"


@query("ins09_interaction_groups", _HALVES + " select l_quantity_high, l_discount_high, count(*) as n, round(avg(v), 6) as mean, round(var_samp(v), 4) as variance from x group by 1, 2")
def _(spark, d):
    from lumen.plans import insights

    return insights.interaction_groups(t(spark, d, "lineitem"), ["l_quantity", "l_discount"], "l_extendedprice")


@query("ins17_interaction_test", _HALVES + ", g as (select count(*) as n, avg(v) as m, var_samp(v) as s from x group by l_quantity_high, l_discount_high having count(*) >= 5), u as (select count(*) as k, sum(n)::bigint as n, sum(n * m) / sum(n) as mean, sum((n - 1) * s) as w from g), b as (select sum(g.n * (m - mean) ** 2) as b from g, u) select k, n, round((b / (k - 1)) / (w / (n - k)), 4) as f, round(((b / (k - 1)) / (w / (n - k))) / ((b / (k - 1)) / (w / (n - k)) + n - k), 6) as score, round(b / (b + w), 6) as eta_squared from u, b")
def _(spark, d):
    from lumen.plans import insights

    return insights.interaction_test(t(spark, d, "lineitem"), ["l_quantity", "l_discount"], "l_extendedprice")


_QUARTILES = "with q as (select quantile_cont(l_quantity, 0.25) as a, quantile_cont(l_quantity, 0.5) as b, quantile_cont(l_quantity, 0.75) as c from lineitem), x as (select (l_quantity > a)::int + (l_quantity > b)::int + (l_quantity > c)::int as bin, l_quantity as x, l_extendedprice as v from lineitem, q), g as (select bin, count(*) as n, round(min(x)::double, 6) as low, round(max(x)::double, 6) as high, round(avg(v), 6) as mean from x group by 1)"


@query("ins10_quartile_means", _QUARTILES + " select * from g")
def _(spark, d):
    from lumen.plans import insights

    return insights.quartile_means(t(spark, d, "lineitem"), "l_quantity", "l_extendedprice")


@query("ins19_quartile_gap", _QUARTILES + " select arg_max(bin, mean) as best_bin, arg_min(bin, mean) as worst_bin, max(mean) as best, min(mean) as worst, sum(n)::bigint as n, round((max(mean) - min(mean)) / abs(min(mean)) * 100, 4) as gap_pct from g")
def _(spark, d):
    from lumen.plans import insights

    return insights.quartile_gap(t(spark, d, "lineitem"), "l_quantity", "l_extendedprice")


@query("ins16_risk_shares", "with c as (select quantile_cont(value, 0.75) as cut from events), x as (select event_type || '-' || (user_id % 11) as category, value > cut as risk from events, c where value is not null), g as (select category, count(*) filter (where risk) as risky, count(*) filter (where not risk) as others from x group by 1), s as (select *, risky / sum(risky) over () as a, others / sum(others) over () as b from g) select category, risky, others, round(100 * a, 2) as risk_pct, round(100 * b, 2) as other_pct, round(a / b, 4) as lift from s where a > 1.1 * b and risky >= 3")
def _(spark, d):
    from lumen.plans import insights

    e = t(spark, d, "events").withColumn("g", F.concat_ws("-", "event_type", (F.col("user_id") % 11).cast("string")))
    return insights.risk_shares(e, "g", "value")


@query("ins24_triggers", "with d as (" + DIRTY_ORDERS + ") select 'correlated' as kind, 'price x amount' as \"column\", round(corr(price, amount), 6) as value from d where price is not null having abs(corr(price, amount)) >= 0.4 union all select 'missing', 'price', round(100.0 * (count(*) - count(price)) / count(*), 2) from d union all select 'skewed', 'amount', round(skewness(amount), 4) from d having abs(skewness(amount)) > 1 union all select 'skewed', 'price', round(skewness(price), 4) from d having abs(skewness(price)) > 1")
def _(spark, d):
    from lumen.plans import insights

    return insights.triggers(dirty(spark, d, DIRTY_ORDERS).select("price", "amount"))


# Further detectors and actions.


@query("det18_plausibility", "with d as (" + DIRTY_LINES + "), y as (select l_quantity % 40 as age, l_linenumber as item_count from d) select 'age' as \"column\", 'age_and_count' as problem, count(*) filter (where age < 16 and item_count >= 3) as n, round(count(*) filter (where age < 16 and item_count >= 3) / count(*), 6) as ratio from y")
def _(spark, d):
    from lumen.plans import cleaning, profile

    x = dirty(spark, d, DIRTY_LINES).select((F.col("l_quantity") % 40).alias("age"), F.col("l_linenumber").alias("item_count"))
    found = cleaning.detect_plausibility(x, profile.profile(x), cleaning.Rules())
    return spark.createDataFrame([(e.column, e.problem, int(e.count), round(float(e.ratio), 6)) for e in found], "column string, problem string, n long, ratio double")


@query("cln05_delimiter_bleed", "with d as (select case when o_orderkey % 41 = 0 then o_custkey || ',' || o_orderkey else o_custkey::varchar end as amount from orders) select 'amount' as \"column\", 'delimiter_bleed' as problem, count(*) filter (where contains(amount, ',')) as n, round(count(*) filter (where contains(amount, ',')) / count(*), 6) as ratio from d")
def _(spark, d):
    from lumen.plans import cleaning, profile

    o = t(spark, d, "orders")
    x = o.select(F.when(F.col("o_orderkey") % 41 == 0, F.concat_ws(",", F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string"))).otherwise(F.col("o_custkey").cast("string")).alias("amount"))
    found = cleaning.detect_bleed(x, profile.profile(x), cleaning.Rules())
    return spark.createDataFrame([(e.column, e.problem, int(e.count), round(float(e.ratio), 6)) for e in found], "column string, problem string, n long, ratio double")


@query("act10_null_island", "with d as (select event_id, case when event_id % 3 = 0 then 0 when event_id % 5 = 0 then -999 else value end as lat, case when event_id % 3 = 0 then 0 else value + 1 end as lon from events) select event_id, case when not (lat = 0 and lon = 0 or lat = -999 or lon = -999) then lat end as lat, case when not (lat = 0 and lon = 0 or lat = -999 or lon = -999) then lon end as lon from d")
def _(spark, d):
    from lumen.plans import cleaning

    k, v = F.col("event_id"), F.col("value")
    x = t(spark, d, "events").select("event_id", F.when(k % 3 == 0, 0.0).when(k % 5 == 0, -999.0).otherwise(v).alias("lat"), F.when(k % 3 == 0, 0.0).otherwise(v + 1).alias("lon"))
    return cleaning.null_island(x, "lat", "lon", [-999.0])


@query("act11_ledger", "with d as (" + DIRTY_ORDERS + "), x as (select o_orderkey as key, priority as before, upper(trim(priority)) as after from d) select * from x where before is distinct from after order by key limit 100")
def _(spark, d):
    from lumen.plans import cleaning

    x = dirty(spark, d, DIRTY_ORDERS).select("o_orderkey", "priority")
    return cleaning.ledger(x, x.withColumn("priority", F.upper(F.trim("priority"))), "priority", "o_orderkey")


@query("clt03_optimise_types", "select o_orderkey, o_custkey::double as custkey, (o_orderkey % 90)::bigint as age from orders")
def _(spark, d):
    from lumen.plans import cleaning

    x = t(spark, d, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("custkey"), (F.col("o_orderkey") % 90).cast("double").alias("age"))
    return cleaning.optimise_types(x)[0]


# Further queries stand in modules of their own, which use what is above.
from lumen import queries_models, queries_sources  # noqa: E402, F401
