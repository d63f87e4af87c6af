"""Token counts through a digest cache.

The cache is a Parquet table ``tokenizer, digest, n_tokens`` partitioned by
``tokenizer`` (SHA-256 of the tokenizer file and of the normalisation's
version).  A run joins the digests of its texts to the stored counts, encodes
only the distinct texts that are missing, appends their counts, and joins
every row to its count.

Scale: texts are reduced to one per digest within each map task before the
only exchange that carries text, so that a third of all rows being copies of
one text costs one text per task.  The join of counts to rows carries 32-byte
digests against a written table of one row per digest, so that adaptive skew
handling can split a hot digest.  Appending twice (a re-run, two writers) is harmless: counts
are a function of the key, and reads take one row per key.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumen.llm.shared import exists, free, prepare, shared_dir, stage

NORMALISATION = "null-to-empty/1"
_loaded: dict[str, object] = {}


def normalise(text: Column) -> Column:
    """The normalisation under which equal content has equal counts for every tokenizer: null is the empty text."""
    return F.coalesce(text, F.lit(""))


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(NORMALISATION.encode() + b"\0" + f.read()).hexdigest()


def _encoder(path: str) -> Callable[[list[str]], list[int]]:
    """A function from texts to token counts, kept for the life of a Python worker."""
    if path not in _loaded:
        if path.endswith(".model"):
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_file=path)
            _loaded[path] = lambda texts: [len(x) for x in sp.encode(texts, num_threads=1)]
        else:
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(path)
            t.no_truncation()
            t.no_padding()
            run = getattr(t, "encode_batch_fast", t.encode_batch)
            _loaded[path] = lambda texts: [len(x) for x in run(texts, add_special_tokens=False)]
    return _loaded[path]


def _count(path: str):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode = _encoder(path)
        for b in batches:
            texts = b.column(1).to_pylist()
            counts = [n for i in range(0, len(texts), 64) for n in encode(texts[i : i + 64])]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64())], ["digest", "n_tokens"])

    return f


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str | None = None, text: str = "text") -> DataFrame:
    """docs with two columns added, ``n_bytes`` (UTF-8) and ``n_tokens``; replaces columns of these names.

    Null texts count as empty (0 bytes; the tokenizer's count of the empty
    text).  Repeated rows are kept and share one encoding; an empty table gives
    an empty table.  ``cache_path`` None: a new cache in the shared folder.
    """
    spark = docs.sparkSession
    prepare(spark)
    cache_path = cache_path or f"{shared_dir(spark)}/token_counts"
    version = tokenizer_digest(tokenizer_path)
    content = normalise(F.col(f"`{text}`"))
    digest = F.unhex(F.sha2(content.cast("binary"), 256))

    def cached() -> DataFrame:
        return spark.read.schema("digest binary, n_tokens long, tokenizer string").parquet(cache_path).where(F.col("tokenizer") == version).groupBy("digest").agg(F.min("n_tokens").alias("_n_tokens"))

    distinct = docs.select(digest.alias("digest"), content.alias("content")).dropDuplicates(["digest"])
    missing = distinct.join(cached(), "digest", "left_anti") if exists(spark, cache_path) else distinct
    counts = missing.mapInArrow(_count(tokenizer_path), "digest binary, n_tokens long")
    counts.withColumn("tokenizer", F.lit(version)).write.mode("append").partitionBy("tokenizer").parquet(cache_path)

    keep = [c for c in docs.columns if c.lower() not in ("n_bytes", "n_tokens")]
    mine, theirs, count = free("mine", docs), free("theirs", docs), free("count", docs)
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.octet_length(content).cast("long").alias("n_bytes"), digest.alias(mine))
    known = stage(cached(), "counts").withColumnsRenamed({"digest": theirs, "_n_tokens": count})
    out = rows.join(known, F.col(mine) == F.col(theirs), "left")
    return out.select(*[F.col(f"`{c}`") for c in keep], "n_bytes", F.col(count).alias("n_tokens"))


def query(spark, sf_dir: str) -> DataFrame:
    """op1: token counts of every document under byte_bpe_50k.json."""
    import public_tokenizers

    from lumen.llm.shared import read

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))
