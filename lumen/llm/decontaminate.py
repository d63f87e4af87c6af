"""Benchmark decontamination with SimHash over item-sized windows, in DataFrame functions only.

Words are runs of letters and digits, lower case.  A window has as many words
as some benchmark item and is the multiset of its 5-word shingles, kept as the
set of shingles numbered by occurrence: the Jaccard similarity of these sets is
the weighted one of the multisets.  Windows are fingerprinted if they hold
enough shingles of an item to be able to reach the similarity at all; the item
stays with the window.  A fingerprint is cut into ``RADIUS`` + 1 blocks, so that
two fingerprints within the radius agree on a block.  A block of a radius that
covers this similarity is short however long the fingerprint (the bits differ
with a chance of 15 %, so a block has 6 bits at most) and cannot select among
many items by itself.  The index is therefore keyed by item and block: a window
meets its own few items only, under each block on which they agree.  Pairs
beyond the radius meet under the item alone.  All pairs are verified by the
exact similarity, so none is missed whatever the fingerprints.

Scale: the scan of texts joins to the items' shingles, which are broadcast only
if their counted number is at most ``SMALL`` and shuffled otherwise; items are
treated alike.  Positions are kept per document and item, so the work on a
passage that very many documents share is dealt by document.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumen.llm.shared import free

#: Bits of a fingerprint, and the Hamming radius within which windows are verified.
BITS, RADIUS = 64, 20
#: The key under which a window meets its items whatever their blocks.
FAR = -1
#: Rows of the benchmark's side of a join up to which it is broadcast (about 40 bytes each).
SMALL = 200_000
#: Words of a shingle.
K = 5


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles(w: str, k: int) -> Column:
    """Hashes of every k consecutive entries of the array column w, in order."""
    n = F.size(w)
    return F.when(n >= k, F.transform(F.sequence(F.lit(0), n - k), lambda i: F.xxhash64(*[F.get(F.col(w), i + j) for j in range(k)]))).otherwise(F.array().cast("array<bigint>"))


def with_simhash(df: DataFrame, shingle: str, name: str) -> DataFrame:
    """df with the fingerprint of its array column of hashes: each bit by majority; a tie is a 1. One long counts two bits at once, in 32 bits each."""
    n, half = F.size(shingle), BITS // 2
    sums = [free(f"sum{i}", df) for i in range(half)]
    lanes = F.lit((1 << half) | 1)

    def count(i: int) -> Column:
        return F.aggregate(shingle, F.lit(0).cast("bigint"), lambda a, h: a + F.shiftrightunsigned(h, i).bitwiseAND(lanes))

    def bit(j: int) -> Column:
        votes = F.shiftrightunsigned(sums[j % half], half * (j // half)).bitwiseAND(F.lit((1 << half) - 1))
        return F.when(2 * votes >= n, F.lit((1 << j) - (1 << BITS if j == BITS - 1 else 0))).otherwise(F.lit(0)).cast("bigint")

    out = df.withColumns({c: count(i) for i, c in enumerate(sums)})
    return out.withColumn(name, reduce(Column.bitwiseOR, [bit(j) for j in range(BITS)])).drop(*sums)


def blocks(fingerprint: Column, radius: int = RADIUS) -> Column:
    """(number, bits) of each of radius + 1 blocks as one array of longs."""
    cuts = [BITS * i // (radius + 1) for i in range(radius + 2)]
    out = []
    for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
        out.append(F.shiftrightunsigned(fingerprint, a).bitwiseAND(F.lit((1 << (b - a)) - 1)) + F.lit(i << 32))
    return F.array(*[x.cast("bigint") for x in out])


def keys(fingerprint: Column, radius: int = RADIUS) -> Column:
    """What a fingerprint is indexed under: its blocks, and FAR."""
    return F.concat(blocks(fingerprint, radius), F.array(F.lit(FAR).cast("bigint")))


def numbered(x: str) -> Column:
    """The sorted array column x as a set: entries after the first of their kind are hashed with their occurrence number."""
    a = F.col(x)

    def one(h: Column, i: Column) -> Column:
        nth = i + 1 - F.array_position(a, h)
        return F.when(nth == 0, h).otherwise(F.xxhash64(h, nth))

    return F.when(F.size(F.array_distinct(a)) == F.size(a), a).otherwise(F.transform(a, one))


def _small(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= SMALL else df


def decontaminate(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, radius: int = RADIUS, id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document and item of which the document has a window of at least ``similarity``: ids, ``similarity``, ``start_word`` of the best window (the first if tied) and ``n_windows``.

    Items of fewer than 5 words are one shingle of all their words; a document
    shorter than an item is one window.  Null and empty texts, and items without
    words, match nothing.  Rows with a null id are searched and reported under
    null.  Repeated rows are reported once; an empty table gives none.
    """
    spark = docs.sparkSession
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    items = benchmark.select(F.col(item).alias("item_id"), words(F.col(item_text)).alias("w")).where(F.size("w") > 0)
    items = items.select("item_id", F.size("w").alias("m"), F.when(F.size("w") < K, F.size("w")).otherwise(K).alias("k"), "w")
    sizes = sorted(r["k"] for r in items.select("k").distinct().collect())  # at most K rows
    cut = F.lit(None).cast("array<bigint>")
    for k in sizes:
        cut = F.when(F.col("k") == k, shingles("w", k)).otherwise(cut)
    items = items.select("item_id", "m", "k", cut.alias("own")).dropDuplicates()
    posts = items.select("item_id", "m", "k", F.size("own").alias("s"), F.explode("own").alias("h")).distinct()
    n_posts = posts.count()
    items = items.withColumn("own", F.sort_array("own")).withColumn("own", numbered("own"))
    named = F.xxhash64("item_id", "m", "k")

    texts = docs.select(F.col(id).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("key"), F.col(text).alias("text"))
    split_ = texts.select("doc_id", "key", words(F.col("text")).alias("w"))
    places = None
    for k in sizes:
        one = split_.select("doc_id", "key", F.size("w").alias("len"), F.posexplode(shingles("w", k)).alias("pos", "h"))
        one = one.join(_small(posts.where(F.col("k") == k).withColumnRenamed("h", "_h"), n_posts), F.col("h") == F.col("_h")).select("doc_id", "key", "len", "pos", "item_id", "m", "k", "s")
        places = one if places is None else places.union(one)
    schema = "doc_id {}, item_id {}, similarity double, start_word long, n_windows long".format(docs.schema[id].dataType.simpleString(), benchmark.schema[item].dataType.simpleString())
    if places is None:
        return spark.createDataFrame([], schema)

    # Window starts at which enough of the item's shingles stand close enough together.
    have = F.least(F.col("s"), F.col("len") - F.col("k") + 1)  # shingles of the window
    need = F.greatest(F.lit(1), F.ceil(F.lit(similarity) * (have + F.col("s")) / F.lit(1 + similarity) - 1e-9).cast("int"))
    held = places.groupBy("doc_id", "key", "len", "item_id", "m", "k", "s").agg(F.sort_array(F.collect_set("pos")).alias("at"))
    held = held.select("*", have.alias("have"), need.alias("need")).where(F.size("at") >= F.col("need"))
    at = F.posexplode(F.expr("slice(at, 1, size(at) - need + 1)")).alias("i", "low")
    held = held.select("doc_id", "key", "len", named.alias("item"), "m", "k", "have", "at", "need", at).withColumn("high", F.expr("at[i + need - 1]")).where(F.col("high") - F.col("low") < F.col("have"))
    first, last = F.greatest(F.lit(0), F.col("high") - F.col("have") + 1), F.least(F.col("low"), F.col("len") - F.least("m", "len"))
    starts = held.select("doc_id", "key", "item", "m", "k", "have", first.alias("first"), last.alias("last")).where("first <= last")
    windows = starts.select("doc_id", "key", "item", "m", "k", "have", F.explode(F.sequence("first", "last")).alias("start"))
    windows = windows.groupBy("doc_id", "key", "m", "k", "have", "start").agg(F.collect_set("item").alias("known"))
    per_doc = windows.groupBy("doc_id", "key").agg(F.collect_list(F.struct("m", "k", "have", "start", "known")).alias("windows"))

    # The windows' own shingles, from the texts that have any.
    t = texts.withColumnsRenamed({"doc_id": "_d", "key": "_k"})
    found = per_doc.join(t, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("key") == F.col("_k"))).select("doc_id", "windows", words(F.col("text")).alias("w"))
    found = found.select("doc_id", "windows", *[shingles("w", k).alias(f"h{k}") for k in sizes])
    one = found.select("doc_id", *[f"h{k}" for k in sizes], F.explode("windows").alias("x"))
    mine = F.lit(None).cast("array<bigint>")
    for k in sizes:
        mine = F.when(F.col("x.k") == k, F.slice(F.col(f"h{k}"), F.col("x.start") + 1, F.col("x.have"))).otherwise(mine)
    prints = one.select("doc_id", F.col("x.start").alias("start"), F.col("x.known").alias("known"), mine.alias("have")).repartition(int(parts))
    prints = with_simhash(prints.withColumn("have", F.sort_array("have")).withColumn("have", numbered("have")), "have", "print")

    # The index: an item under its own key and under each of its blocks.
    theirs = with_simhash(items.withColumn("_item", named).repartition(int(parts), "_item"), "own", "_print")
    theirs = theirs.select("item_id", "own", "_print", "_item", F.explode(keys(F.col("_print"), radius)).alias("_block"))
    pairs = prints.select("doc_id", "start", "have", "print", F.explode("known").alias("item")).withColumn("block", F.explode(keys(F.col("print"), radius)))
    pairs = pairs.join(_small(theirs, n_posts), (F.col("item") == F.col("_item")) & (F.col("block") == F.col("_block")))
    apart = F.bit_count(F.col("print").bitwiseXOR(F.col("_print")))
    agreed = F.array_position(F.zip_with(blocks(F.col("print"), radius), blocks(F.col("_print"), radius), lambda a, b: a == b), True) - 1
    near = (apart <= radius) & (agreed == F.shiftright("block", 32))  # under the first shared block only
    pairs = pairs.where(near | (apart > radius) & (F.col("block") == FAR))
    o = F.size(F.array_intersect("own", "have"))
    checked = pairs.select("doc_id", "item_id", "start", (o / (F.size("have") + F.size("own") - o)).alias("similarity")).where(F.col("similarity") >= similarity)
    best = F.max(F.struct("similarity", (-F.col("start")).alias("s")))
    out = checked.groupBy("doc_id", "item_id").agg(best.alias("b"), F.count_distinct("start").alias("n_windows"))
    return out.select("doc_id", "item_id", F.col("b.similarity").alias("similarity"), (-F.col("b.s")).cast("long").alias("start_word"), "n_windows")


def query(spark, sf_dir: str) -> DataFrame:
    """op9: documents that hold benchmark items, by 5-word shingles at 0.8."""
    from lumen.llm.shared import read

    return decontaminate(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
