"""Language identification by compression with per-language zstandard dictionaries.

For each language the words of a bounded sample of its labelled texts, lower
case and shuffled, are a raw-content dictionary; shuffling keeps a passage that
many documents share from deciding for the language whose sample has it.  A
text's letters are cut into pieces, every piece is compressed with every
language's dictionary, and the language with the smallest total wins; a text
whose two smallest totals are nearly equal is rejected.  Pieces keep a long
text from becoming its own dictionary: each piece meets the languages afresh,
and every piece of the text counts.

Scale: dictionaries are at most ``DICTIONARY`` bytes a language and travel with
the tasks; predicting is a narrow pass, whose work grows with the number of
languages.  The sample is chosen per language by the smallest hashes; map tasks
pass on at most ``SAMPLE`` rows a language.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumen.llm.shared import fold, free, prepare

#: Texts a language that learning takes at most (those of SHORTEST characters or more first), words of one text, and bytes of a dictionary.
SAMPLE, SHORTEST, WORDS, DICTIONARY = 96, 200, 1200, 32 << 10
#: Bytes of a piece, and the compression level.
PIECE, LEVEL = 4096, 6
#: The relative margin of sizes below which a prediction is rejected.
MARGIN = 0.01

_BLANK = re.compile(r"[\W\d_]+")
_worker: dict[tuple[int, str], object] = {}


def letters(text: str) -> str:
    """Lower-case letters of text, one space around each run."""
    return f" {_BLANK.sub(' ', text.lower()).strip()} "


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """At most WORDS words of each text, evenly from the whole of it."""
    for b in batches:
        words = [letters(t).split() for t in b.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([w[:: -(-len(w) // WORDS) or 1] for w in words], pa.list_(pa.string()))], ["lang", "nth", "words"])


def fit(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE, size: int = DICTIONARY) -> dict[str, bytes]:
    """A raw-content dictionary for each non-null lang that has a text with a letter; ids only order the sample by their hash. Languages come by the number of their texts, most first."""
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(id).alias("h"), F.col(id).alias("id"))
    fits = F.length("text") >= SHORTEST
    w = Window.partitionBy("lang").orderBy(fits.desc(), "h", "id", F.xxhash64("text"))
    chosen = rows.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= sample)
    got: dict[str, list[tuple[int, list[str]]]] = {}
    for r in chosen.select("lang", "nth", "text").mapInArrow(_words, "lang string, nth int, words array<string>").collect():  # languages x sample rows at most, WORDS words each
        got.setdefault(r["lang"], []).append((r["nth"], r["words"]))
    seen = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    words = {k: [w for _, t in sorted(got[k]) for w in t] for k in got}
    out = {}
    for k in sorted(words, key=lambda k: (-seen[k], k)):
        random.Random(0).shuffle(words[k])
        out[k] = f" {' '.join(words[k])} ".encode("utf-8", "surrogatepass")
    even = min([size, *(max(4096, len(x)) for x in out.values())])
    return {k: x[-even:] for k, x in out.items()}  # equal sizes: a larger dictionary must not win by size


class Classifier:
    """Compressors with the dictionaries; the sizes of a text under each."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.langs = list(dictionaries)
        self.compress = []
        for k in self.langs:
            d = zstandard.ZstdCompressionDict(dictionaries[k], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.compress.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress)

    def sizes(self, text: str) -> list[int]:
        raw = letters(text).encode("utf-8", "surrogatepass")
        pieces = [raw[i : i + PIECE] for i in range(0, len(raw), PIECE)]
        return [sum(len(c(p)) for p in pieces) for c in self.compress]

    def predict(self, text: str | None, least: float = MARGIN) -> tuple[str, float, bool]:
        """Language, score and whether the margin is too narrow; ``und`` without a letter or a language."""
        if not self.langs or text is None or not any(map(str.isalpha, text)):
            return "und", 0.0, True
        sizes = self.sizes(text)
        order = sorted(range(len(sizes)), key=lambda i: (sizes[i], i))
        best = sizes[order[0]]
        second = sizes[order[1]] if len(order) > 1 else best * 2
        margin = (second - best) / second if second else 0.0
        # Twice the margin's part of the text's compressed size, from 0.5 (a tie) to 1.
        return self.langs[order[0]], round(min(1.0, 0.5 + 2.0 * margin), 6), margin < least


def classify(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text", margin: float = MARGIN, reject: bool = True) -> DataFrame:
    """docs with ``lang_pred``, ``score`` and ``rejected``; columns of these names are replaced.

    ``lang_pred`` is ``und``, with score 0, where text is null or has no letter,
    and, if reject, where the margin is below ``margin``.  Ties go to the language
    with more labelled texts.  Repeated rows repeat; an empty table gives an empty table.
    """
    prepare(docs.sparkSession)
    new = ["lang_pred", "score", "rejected"]
    keep = [c for c in docs.columns if c not in new]
    src = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias(free("text", docs)))
    schema = src.select(*[f"`{c}`" for c in keep]).schema.add("lang_pred", "string").add("score", "double").add("rejected", "boolean")
    key = (zlib.crc32(repr(list(dictionaries.items())).encode()), "classifier")

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _worker:
            _worker.clear()
            _worker[key] = Classifier(dictionaries)
        c = _worker[key]
        for b in batches:
            got = [c.predict(t, margin) for t in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(len(keep))] + [pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64()), pa.array([x[2] for x in got], pa.bool_())], keep + new)

    out = src.mapInArrow(f, schema)
    return out.withColumn("lang_pred", F.when(F.col("rejected"), "und").otherwise(F.col("lang_pred"))) if reject else out


def query(spark, sf_dir: str) -> DataFrame:
    """op3: language of every document, learned from two of three id folds; ``rejected`` marks narrow margins."""
    from lumen.llm.shared import read

    docs = read(spark, sf_dir, "documents")
    held = fold("doc_id", 3) == 1
    dictionaries = fit(docs.where(~held).select("doc_id", "text", "lang"))
    out = classify(docs.select("doc_id", held.alias("held_out"), "text"), dictionaries, reject=False)
    return out.select("doc_id", "held_out", "lang_pred", "score", "rejected")
