"""Secret scans through a trigram inverted index, in DataFrame functions only.

Each rule's regular expression yields a Boolean trigram query.  Of every text,
the trigrams that some query names become postings: for each block of texts and
each trigram, the keys of the texts that have it.  A rule's candidates are
unions of intersections of its postings; candidates are joined to their texts
and verified by the expression itself.  Rules without mandatory trigrams scan
every text.

Scale: postings are keys of 8 bytes for a fixed vocabulary of trigrams; a block
is what one task reads, so a posting list is bounded by the size of an input
partition.  Texts are shuffled once, for the join of candidates.  Nothing runs
in Python.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumen.llm.shared import free
from lumen.llm.trigrams import ALWAYS, query_of



#: Entries that running sums copy at a time.
CHUNK = 256


@dataclass(frozen=True)
class Rule:
    """Matches of pattern whose group has ``least`` characters or more; scan: an equivalent pattern that skips shorter ones by itself."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    scan: str | None = None

    @property
    def regex(self) -> str:
        return self.scan or self.pattern


#: The base rules, in their order.
BASE = [
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18, r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]+", 0, 16, r"[0-9a-f]{16,}"),
]

KEY = r"(?:RSA |EC |DSA |OPENSSH |ENCRYPTED )?PRIVATE KEY-----"
#: Rules of the method's own: published formats of credentials.
MORE = [
    # With the lines of the key, to the END line if there is one.
    Rule("private_key", rf"-----BEGIN {KEY}(?:\s{{1,2}}[A-Za-z0-9+/]{{40,76}}(?![A-Za-z0-9+/]))*+(?:\s{{1,2}}[A-Za-z0-9+/]{{0,76}}={{0,2}}\s{{1,2}}-----END {KEY})?"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"[sr]k_live_[0-9A-Za-z]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
]
RULES = BASE + MORE


def running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """The running combination, from 0, of an array of ints; in chunks, as an array that grows by one is copied each time."""
    none = F.array().cast("array<int>")

    def step(acc: Column, x: Column) -> Column:
        at = combine(acc["at"], x)
        return F.struct(at.alias("at"), F.concat(acc["out"], F.array(at)).alias("out"))

    def chunk(acc: Column, xs: Column) -> Column:
        done = F.aggregate(xs, F.struct(acc["at"].alias("at"), none.alias("out")), step)
        return F.get(F.transform(F.array(done), lambda r: F.struct(r["at"].alias("at"), F.concat(acc["out"], F.array(r["out"])).alias("out"))), F.lit(0))

    def chunks(v: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor(F.size(v) / CHUNK).cast("int")), lambda i: F.slice(v, i * CHUNK + 1, CHUNK))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<int>>").alias("out"))
    whole = F.get(F.transform(F.array(values), chunks), F.lit(0))  # names the array, so that it is computed once
    return F.flatten(F.aggregate(whole, start, chunk, lambda acc: acc["out"]))


def spans_of(text: Column, rule: Rule, nth: int) -> Column:
    """All matches of a rule in text as array<struct<start, kind, end>> in code points; kind is nth."""
    pieces = F.split(text, rule.regex, -1)
    whole = F.regexp_extract_all(text, F.lit(rule.regex), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(rule.regex), F.lit(rule.group)) if rule.group else whole
    rows = F.arrays_zip(F.transform(F.slice(pieces, 1, F.size(whole)), F.length).alias("a"), F.transform(whole, F.length).alias("b"), F.transform(part, F.length).alias("c"))

    def spans(rows: Column) -> Column:
        ends = running(F.transform(rows, lambda x: x["a"] + x["b"]), lambda x, y: x + y)
        made = F.zip_with(rows, ends, lambda x, end: F.struct((end - x["b"]).alias("start"), F.lit(nth).alias("kind"), end.alias("end"), x["c"].alias("c")))
        return F.transform(F.filter(made, lambda x: x["c"] >= rule.least), lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))

    empty = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return F.when(text.rlike(rule.regex), F.get(F.transform(F.array(rows), spans), F.lit(0))).otherwise(empty)


def _tagged(rule: int):
    return lambda key: F.struct(key.alias("key"), F.lit(rule).alias("rule"))


def _is_kind(kind: int):
    return lambda span: span["kind"] == kind


def candidates(texts: DataFrame, rules: list[Rule]) -> DataFrame:
    """``key, rules``: for each text (columns ``key``, ``content``) that satisfies some rule's query, the numbers of these rules."""
    queries = {i: query_of(r.pattern) for i, r in enumerate(rules)}
    queries = {i: q for i, q in queries.items() if q != ALWAYS}
    grams = sorted({g for q in queries.values() for t in q for g in t})
    low = F.lower("content")
    present = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(g)), F.lit(g)) for g in grams])) if grams else F.array().cast("array<string>")
    postings = texts.select("key", F.spark_partition_id().alias("block"), F.explode(present).alias("gram")).groupBy("block", "gram").agg(F.collect_set("key").alias("keys"))
    index = postings.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("gram", "keys"))).alias("index"))
    none = F.array().cast("array<bigint>")

    def keys(g: str) -> Column:
        return F.coalesce(F.try_element_at("index", F.lit(g)), none)

    found = []
    for i, q in queries.items():
        terms = [reduce(F.array_intersect, [keys(g) for g in sorted(t)]) for t in sorted(q, key=sorted)]
        found.append(F.transform(reduce(F.array_union, terms), _tagged(i)))
    if not found:
        return texts.select("key", F.array().cast("array<int>").alias("rules")).limit(0)
    return index.select(F.explode(F.concat(*found)).alias("x")).groupBy(F.col("x.key").alias("key")).agg(F.collect_set("x.rule").alias("rules"))


def find_secrets(docs: DataFrame, rules: list[Rule] | None = None, text: str = "text") -> DataFrame:
    """docs with ``spans``: array<struct<start, kind, end>> sorted, kind the number of the rule, end exclusive, in code points.

    Null texts count as empty: no spans.  Texts that repeat share a key, and
    every row keeps its own spans.  A column ``spans`` of docs is replaced.
    """
    rules = RULES if rules is None else rules
    keep = [c for c in docs.columns if c.lower() != "spans"]
    content = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    # Keys are over content: texts of one key are equal or, if two hashes collide, share candidates, which are verified.
    mine, key, theirs, named = (free(c, docs) for c in ("content", "key", "theirs", "rules"))
    texts = docs.select(*[F.col(f"`{c}`") for c in keep], content.alias(mine), F.xxhash64(content).alias(key))
    hits = candidates(docs.select(content.alias("content"), F.xxhash64(content).alias("key")), rules)
    both = texts.join(hits.withColumnsRenamed({"key": theirs, "rules": named}), F.col(key) == F.col(theirs), "left")
    empty = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    parts = []
    for i, r in enumerate(rules):
        spans = spans_of(F.col(mine), r, i)
        parts.append(spans if query_of(r.pattern) == ALWAYS else F.when(F.array_contains(named, i), spans).otherwise(empty))
    return both.select(*[F.col(f"`{c}`") for c in keep], F.array_sort(F.concat(*parts)).alias("spans"))


def as_text(spans: Column, rules: list[Rule] | None = None) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(r.kind) for r in (RULES if rules is None else rules)])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column, by: str = "[secret]") -> Column:
    """text with every stretch that spans cover replaced."""

    def cut(ends: Column) -> Column:
        def piece(s: Column, i: Column) -> Column:
            at = F.when(i > 0, F.get(ends, i - 1)).otherwise(F.lit(0))  # how far the spans before it reach
            return F.when(s["start"] >= at, F.concat(F.substring(text, at + 1, s["start"] - at), F.lit(by))).otherwise(F.lit(""))

        return F.concat(F.array_join(F.transform(spans, piece), ""), F.substring(text, F.element_at(ends, -1) + 1, F.length(text)))

    ends = running(F.transform(spans, lambda s: s["end"]), F.greatest)
    return F.when(F.size(spans) > 0, F.get(F.transform(F.array(ends), cut), F.lit(0))).otherwise(text)


def query(spark, sf_dir: str) -> DataFrame:
    """op6: secrets of every document."""
    from lumen.llm.shared import read

    found = find_secrets(read(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.size(F.filter("spans", _is_kind(i))).cast("long").alias(f"n_{r.kind}") for i, r in enumerate(BASE)]
    base = F.filter("spans", lambda s: s["kind"] < len(BASE))
    return found.select("doc_id", *counts, F.sha2(as_text(base).cast("binary"), 256).alias("base_sha256"), as_text(F.col("spans")).alias("spans"))
