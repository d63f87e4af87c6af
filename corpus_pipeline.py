"""A corpus pipeline of five stages; each one's rows are written and read again as the next one's.

toxicity: documents that score 0.5 or more go.  ngram_jaccard: of each
component of near copies (3-word shingles, 0.9) the smallest doc_id stays; rows
that repeat an id count as one document, of which the text of smallest digest
stays (of equal texts, the row of smallest other values).
decontamination: documents that hold a benchmark item go.  secrets: secrets are replaced in the text.  byte_bpe: every document
with its token ids, their number, and the digests of ids and round trip.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumen.llm import byte_bpe, decontaminate, ngram_jaccard, secret_scan, toxicity
from lumen.llm.shared import fold, free, read, shared_dir

#: The first stage is a learned model, which SQL does not express; tests hold run() against a brute-force version.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose score is below 0.5; the model is learned from the labels' folds for learning."""
    model = toxicity.fit(docs, read(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0))
    name = free("toxicity", docs)
    return toxicity.score(docs, model, name=name).where(F.col(name) < 0.5).drop(name)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of smallest doc_id of each component; rows without words or id stay, rows that repeat an id become one."""
    keep, digest = free("keep", docs), free("digest", docs)
    ids = ngram_jaccard.jaccard_components(docs.select("doc_id", "text")).where("doc_id = component_id").select(F.col("doc_id").alias(keep)).distinct()
    kept = docs.where(F.col("doc_id").isNotNull()).join(ids, F.col("doc_id") == F.col(keep), "left_semi")
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    first = F.struct(F.sha2(F.coalesce("text", F.lit("")), 256).alias(digest), F.col("text"), *[F.col(f"`{c}`") for c in rest])
    one = kept.groupBy("doc_id").agg(F.min(first).alias("_row")).select("doc_id", F.col("_row.text").alias("text"), *[F.col(f"_row.`{c}`").alias(c) for c in rest])
    return one.select(*docs.columns).unionByName(docs.where(F.col("doc_id").isNull()))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of documents that hold no benchmark item."""
    name = free("found", docs)
    found = decontaminate.decontaminate(docs.select("doc_id", "text"), read(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(found, F.col("doc_id").eqNullSafe(F.col(name)), "left_anti")


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, their secrets replaced; n_chars follows the text where that changed."""
    found = secret_scan.find_secrets(docs)
    hit = F.size("spans") > 0
    out = found.withColumn("text", secret_scan.redact(F.col("text"), F.col("spans")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(hit, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its ids and the digests of the round trip."""
    import public_tokenizers

    return byte_bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), keep=[c for c in docs.columns if c != "text"], full=True).drop("decoded")


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("secrets", hide_secrets),
    ("byte_bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = shared_dir(spark)
    docs = read(spark, sf_dir, "documents")
    for i, (name, f) in enumerate(STAGES):
        path = f"{root}/{i}_{name}"
        f(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
