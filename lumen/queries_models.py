"""Registered queries of models: neighbours, kernel features, boosting, splits, text features, rank correlation."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumen.operators import concordance, importance, information, neighbours, ngrams
from lumen.plans import insights, learners
from lumen.queries import query, t

# Neighbours of every twentieth vector among all.

_NEAR = """q as (select vec_id as id, embedding::double[] as v from embeddings where vec_id % 20 = 0), b as (select vec_id as neighbour, label, embedding::double[] as v from embeddings),
 p as (select id, neighbour, label, list_distance(q.v, b.v) as distance from q join b on q.id <> b.neighbour),
 n as (select id, neighbour, label, distance, row_number() over (partition by id order by distance, neighbour)::int as rank from p qualify rank <= 5)"""


def _near(spark, d):
    e = t(spark, d, "embeddings")
    return neighbours.nearest(e, e.where("vec_id % 20 = 0"), 5, "vec_id", "embedding")


@query("mln06_neighbours", f"with {_NEAR} select id, neighbour, rank, round(distance, 6) as distance from n")
def _(spark, d):
    return _near(spark, d).select("id", "neighbour", "rank", F.round("distance", 6).alias("distance"))


@query("mln06_neighbour_vote", f"with {_NEAR}, w as (select id, label, sum(1 / distance) as w from n group by 1, 2) select id, label as prediction from w qualify row_number() over (partition by id order by round(w, 9) desc, label) = 1")
def _(spark, d):
    return neighbours.vote(_near(spark, d), t(spark, d, "embeddings"), "vec_id", "label")


@query("mln06_neighbour_mean", f"with {_NEAR} select id, round(sum(label / distance) / sum(1 / distance), 6) as prediction from n group by 1")
def _(spark, d):
    return neighbours.mean(_near(spark, d), t(spark, d, "embeddings"), "vec_id", "label").select("id", F.round("prediction", 6).alias("prediction"))


_W, _B = learners.fourier_map(2, 6, 0.5)


@query(
    "mln06_fourier_features",
    "select p_partkey, " + ", ".join(f"round(sqrt(2.0 / 6) * cos(p_size / 50.0 * ({_W[0, j]!r}) + p_retailprice / 2000.0 * ({_W[1, j]!r}) + {_B[j]!r}), 6) as f{j}" for j in range(6)).replace("np.float64", "") + " from part",
)
def _(spark, d):
    x = t(spark, d, "part").select("p_partkey", F.array(F.col("p_size") / 50.0, F.col("p_retailprice") / 2000.0).alias("v"))
    z = x.select("p_partkey", learners.fourier_features(F.col("v"), _W, _B).alias("z"))
    return z.select("p_partkey", *[F.round(F.col("z")[j], 6).alias(f"f{j}") for j in range(6)])


# Three rounds of boosting with given rules for the three return flags, each right on a part of the rows.

_LABEL = "case l_returnflag when 'A' then 0 when 'N' then 1 else 2 end"
_RULES = [f"case when l_quantity > 25 then {_LABEL} else 0 end", f"case when l_discount > 0.04 then {_LABEL} else 1 end", f"case when l_linenumber < 3 then {_LABEL} else 2 end"]


def _samme(rounds: int) -> str:
    ctes = [f"x as (select l_orderkey, l_linenumber, {_LABEL} as y, " + ", ".join(f"{r} as p{i}" for i, r in enumerate(_RULES)) + " from lineitem)", "w0 as materialized (select *, 1.0::double / count(*) over () as w from x)"]
    for i in range(rounds):
        ctes.append(f"e{i} as materialized (select sum(w) filter (where y <> p{i}) / sum(w) as e from w{i})")
        ctes.append(f"r{i} as materialized (select w{i}.* exclude (w), w * case when y <> p{i} then (1 - e) / e * 2 else 1 end as w from w{i}, e{i})")
        ctes.append(f"w{i + 1} as materialized (select * exclude (w), w / sum(w) over () as w from r{i})")
    return "with " + ",\n".join(ctes) + f"\nselect y, p0, p1, p2, count(*) as n, round(avg(w) * 1e6, 4) as weight from w{rounds} group by 1, 2, 3, 4"


@query("mln06_boosting_weights", _samme(3))
def _(spark, d):
    df = t(spark, d, "lineitem").select(F.expr(_LABEL).alias("y"), *[F.expr(r).alias(f"p{i}") for i, r in enumerate(_RULES)])
    df = df.withColumn("w", F.lit(1.0) / df.count())
    for i in range(3):
        df, _ = learners.reweighted(df, "y", f"p{i}", "w", 3)
    return df.groupBy("y", "p0", "p1", "p2").agg(F.count("*").alias("n"), F.round(F.avg("w") * 1e6, 4).alias("weight"))


@query(
    "mln03_stratified_split",
    """with x as (select event_id, event_type, ('0x' || substr(sha256(event_id::varchar), 1, 12))::bigint as h from events where event_type is not null),
    r as (select *, row_number() over (partition by event_type order by h, event_id) as r, count(*) over (partition by event_type) as n from x)
    select event_id, event_type, r <= greatest(least(floor(n * 0.2 + 0.5), n - 1), 1) as test from r where n >= 2""",
)
def _(spark, d):
    train, test = learners.stratified_split(t(spark, d, "events").select("event_id", "event_type"), "event_type", ["event_id"])
    return train.withColumn("test", F.lit(False)).union(test.withColumn("test", F.lit(True)))


_STOP = ["the", "and", "of"]
_TERMS = """w as (select doc_id, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]{2,}'), lambda x: x not in ('the', 'and', 'of')) as w from documents),
 g as (select doc_id, unnest(w) as term from w union all select doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) from w),
 c as (select doc_id, term, count(*) as n from g group by 1, 2), a as (select term, sum(n)::bigint as n, count(*) as documents from c group by 1),
 v as (select term, (row_number() over (order by term) - 1)::int as place, n, documents from (select * from a order by n desc, term limit 1000))"""


@query("mln05_vocabulary", f"with {_TERMS} select * from v")
def _(spark, d):
    return ngrams.vocabulary(t(spark, d, "documents"), "text", 1000, stop=_STOP)


@query(
    "mln05_tfidf",
    f"with {_TERMS}, r as (select doc_id, place, c.n * (ln((1 + (select count(*) from documents)) / (1 + documents)) + 1) as w from c join v using (term)) select doc_id as id, place, round(w / sqrt(sum(w * w) over (partition by doc_id)), 6) as weight from r",
)
def _(spark, d):
    docs = t(spark, d, "documents")
    known = ngrams.vocabulary(docs, "text", 1000, stop=_STOP)
    return ngrams.tfidf(docs, "doc_id", "text", known, stop=_STOP).select("id", "place", F.round("weight", 6).alias("weight"))


@query(
    "biv04_kendall_lines",
    """with r as (select l_extendedprice as x, l_discount as y from lineitem), g as (select x, y, count(*) as n from r group by 1, 2),
    f as (select a.x, b.y, coalesce(n, 0) as n from (select distinct x from r) a cross join (select distinct y from r) b left join g on g.x = a.x and g.y = b.y),
    c as (select *, coalesce(sum(n) over (partition by y order by x rows between unbounded preceding and 1 preceding), 0) as below from f),
    p as (select n, coalesce(sum(below) over (partition by x order by y rows between unbounded preceding and 1 preceding), 0) as up, coalesce(sum(below) over (partition by x order by y rows between 1 following and unbounded following), 0) as down from c),
    s as (select sum(n * (up - down))::double as s, sum(n)::double as n from p), tx as (select sum(k * (k - 1.0) / 2) as t from (select count(*) as k from r group by x)), ty as (select sum(k * (k - 1.0) / 2) as t from (select count(*) as k from r group by y))
    select 'l_extendedprice' as a, 'l_discount' as b, round(s / (sqrt(n * (n - 1) / 2 - tx.t) * sqrt(n * (n - 1) / 2 - ty.t)), 6) as r, n::bigint as n from s, tx, ty""",
)
def _(spark, d):
    return concordance.tau_b(t(spark, d, "lineitem"), "l_extendedprice", "l_discount")


# Information by neighbours. psi(n) of whole numbers is the (n - 1)-th harmonic number less Euler's constant.

_PSI = "psi as (select i as n, coalesce(sum(1.0::double / i) over (order by i rows between unbounded preceding and 1 preceding), 0) - 0.57721566490153286 as psi from range(1, (select count(*) + 2 from part)) t(i))"


_OF_NUMBERS = f"""{_PSI}, p as (select p_partkey as id, p_size / stddev_pop(p_size) over () as x, p_retailprice / stddev_pop(p_retailprice) over () as y from part),
    d as (select a.id, a.x, a.y, list_sort(list(greatest(abs(a.x - b.x), abs(a.y - b.y))))[3] * (1 - 1e-9) as r from p a join p b on a.id <> b.id group by 1, 2, 3),
    n as (select d.id, count(*) filter (where abs(p.x - d.x) <= r) as nx, count(*) filter (where abs(p.y - d.y) <= r) as ny from d cross join p group by 1),
    i as (select greatest(0, (select psi from psi where n = (select count(*) from p)) + (select psi from psi where n = 3) - avg(a.psi) - avg(b.psi)) as nats, count(*) as n from n join psi a on a.n = nx join psi b on b.n = ny)"""


@query("biv20_information_of_numbers", f"with {_OF_NUMBERS} select round(nats, 6) as nats, n from i")
def _(spark, d):
    return information.of_numbers(t(spark, d, "part"), "p_size", "p_retailprice")


@query(
    "biv20_ensemble_importance",
    f"with {_OF_NUMBERS}, r as (select abs(corr(p_size, p_retailprice)) as r, count(*) as m from part) select 'p_size' as feature, round((r + least(1, nats) + least(1, r * r * (m - 2) / (1 - r * r)) + 1) / 4, 4) as importance from r, i",
)
def _(spark, d):
    return importance.ensemble_importance(t(spark, d, "part").select("p_size", "p_retailprice"), "p_retailprice")


@query(
    "biv20_information_of_classes",
    f"""with {_PSI}, p as (select p_partkey as id, p_retailprice / stddev_pop(p_retailprice) over () as x, p_brand as y, count(*) over (partition by p_brand) as size from part),
    d as (select a.id, a.x, a.size, least(3, a.size - 1) as k, list_sort(list(abs(a.x - b.x)))[least(3, a.size - 1)] * (1 - 1e-9) as r from p a join p b on a.id <> b.id and a.y = b.y group by 1, 2, 3),
    n as (select d.id, d.size, d.k, count(*) filter (where abs(p.x - d.x) <= r) as m from d cross join (select * from p where size > 1) p group by 1, 2, 3)
    select round(greatest(0, (select psi from psi where n = (select count(*) from d)) + avg(a.psi) - avg(b.psi) - avg(c.psi)), 6) as nats, count(*) as n from n join psi a on a.n = k join psi b on b.n = size join psi c on c.n = m""",
)
def _(spark, d):
    return information.of_classes(t(spark, d, "part"), "p_retailprice", "p_brand")


# Numbers behind insights.

_TOLD = "with d as (select doc_id, lang, quality, case when quality > 0.5 and doc_id % 3 > 0 then null else text end as text, case when lang = 'en' then null else source end as source from documents join labels using (doc_id))"


def _told(spark, d):
    x = t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id")
    return x.select("doc_id", "lang", "quality", F.when(~((F.col("quality") > 0.5) & (F.col("doc_id") % 3 > 0)), F.col("text")).alias("text"), F.when(F.coalesce(F.col("lang") != "en", F.lit(True)), F.col("source")).alias("source"))


@query("ins12_class_gaps", f"{_TOLD}, g as (select lang, avg(length(text)) as l, 100.0 * avg((text is null)::int) as m, 100.0 * avg((source is null)::int) as s from d where lang is not null group by 1), u as (select lang, 'length' as kind, 'text' as c, l as v from g union all select lang, 'missing', 'text', m from g union all select lang, 'missing', 'source', s from g) select kind, c as \"column\", arg_min(lang, (-v, lang)) as most, arg_min(lang, (v, lang)) as least, round(max(v), 4) as high, round(min(v), 4) as low from u where v is not null group by 1, 2")
def _(spark, d):
    return insights.class_gaps(_told(spark, d), "lang", ["text"], ["text", "source"])


_SHARE = "round((case when sum({k}) >= 10 then max({k}) filter (where lang is not null) / sum({k}) filter (where lang is not null) end)::double, 6)"


@query("ins18_telling_gaps", f"{_TOLD}, g as (select lang, count(text) as pt, count(*) - count(text) as mt, count(source) as ps, count(*) - count(source) as ms from d group by 1) " + " union all ".join(f"select '{c}' as \"column\", {_SHARE.format(k='p' + c[0])} as present, {_SHARE.format(k='m' + c[0])} as missing from g" for c in ("text", "source")))
def _(spark, d):
    return insights.telling(_told(spark, d), ["text", "source"], "lang")


_RANKED = "select rank() over (order by l_quantity) + (count(*) over (partition by l_quantity) - 1) / 2.0 as x, rank() over (order by l_extendedprice) + (count(*) over (partition by l_extendedprice) - 1) / 2.0 as y from lineitem"
_SPREAD = "select l_returnflag, count(*) as n, avg(l_extendedprice) as m, var_samp(l_extendedprice) as v from lineitem group by 1"


@query("ins06_merged_importance", f"with r as ({_RANKED}), g as ({_SPREAD}), x as (select sum(n) as n, count(*) as k, sum((n - 1) * v) as w, sum(n * (m - (select avg(l_extendedprice) from lineitem)) ** 2) as b from g), f as (select n - k as d, b / (k - 1) / (w / (n - k)) as f from x), u as (select 'l_quantity' as feature, abs(round(round(corr(x, y), 6), 3)) as importance from r union all select 'l_returnflag', round(round(f / (f + d), 6), 3) from f) select feature, importance, round(importance / max(importance) over (), 4) as relative from u where importance > 0")
def _(spark, d):
    return insights.merged_importance(t(spark, d, "lineitem").select("l_quantity", "l_returnflag", "l_extendedprice"), "l_extendedprice")
