"""Quality rules: learned decision lists over document statistics.

Statistics of every document come from one vectorised pass over its bytes.
Sequential covering learns, from labelled statistics, an ordered list of
conjunctions of thresholds: each rule is grown by information gain on two
thirds of the rows, pruned on the rest, and accepted only if it is right often
enough on both; the rows it covers go, and the next rule is learned.  The list
becomes one ordered Spark conditional expression, evaluated without Python.

Scale: the pass is narrow.  Learning takes at most ``SAMPLE`` labelled rows
(those of smallest hash), whose few numbers each go to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumen.llm.shared import free, prepare
from lumen.llm.words import SPACE, U, Words, hash_slices, inside, mix, slices, window_hashes

#: Labelled rows that learning takes at most.
SAMPLE = 20_000
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_short"]
#: n_short: words of at most three bytes.
#: What rules are made of; per-word shares, so that length alone does not decide.
FEATURES = ["n_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share", "short_share", "words_per_line"]
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True


def _sums(flag: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flag)])
    return total[offsets[1:]] - total[offsets[:-1]]


def statistics(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """COUNTS of each text."""
    texts = len(offsets) - 1
    w = Words(data, offsets)
    n = w.counts()
    in_word = ~SPACE[data]
    word_chars = _sums(in_word & ((data & 0xC0) != 0x80), offsets)
    symbols = _sums(SYMBOLS[data], offsets)
    # Lines: cut at \n and at the texts' borders.
    cuts = np.union1d(np.flatnonzero(data == 10) + 1, offsets)
    starts = cuts[cuts < len(data)] if len(data) else cuts[:0]
    ends = np.append(starts[1:], len(data))
    ends = ends - ((ends > starts) & (data[np.maximum(ends - 1, 0)] == 10)) if len(data) else ends
    text = np.searchsorted(offsets, starts, "right") - 1
    words_before = np.concatenate([[0], np.cumsum(in_word)])
    has = words_before[ends] > words_before[starts]
    starts, ends, text = starts[has], ends[has], text[has]
    a, b = hash_slices(data, starts, ends - starts), hash_slices(data, starts, ends - starts, 77)
    order = np.lexsort((b, a, text))
    same = (text[order][1:] == text[order][:-1]) & (a[order][1:] == a[order][:-1]) & (b[order][1:] == b[order][:-1])
    dup = np.bincount(text[order][1:][same], minlength=texts)
    lines = np.bincount(text, minlength=texts)
    # Words in 5-word windows that the text has twice or more.
    h = w.hashes()
    owner = w.text_of()
    at = inside(w.first, 5, len(w))
    repeat = np.zeros(texts, np.int64)
    if len(at):
        x = mix(window_hashes(h, 5)[at] ^ mix(owner[at].astype(U) + U(1)))
        order = np.argsort(x, kind="stable")
        y = x[order]
        twin = np.zeros(len(y), bool)
        twin[1:] = y[1:] == y[:-1]
        twin[:-1] |= y[1:] == y[:-1]
        delta = np.zeros(len(w) + 1, np.int64)
        hit = at[order[twin]]
        np.add.at(delta, hit, 1)
        np.add.at(delta, hit + 5, -1)
        repeat = np.bincount(owner[np.cumsum(delta)[:-1] > 0], minlength=texts)
    short = np.bincount(owner[(w.end - w.start) <= 3], minlength=texts)
    return [n, word_chars, symbols, dup, repeat, lines, _sums(UPPER[data], offsets), _sums(DIGIT[data], offsets), short]


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with COUNTS added as longs (null texts: zeros); columns of these names are replaced."""
    prepare(docs.sparkSession)
    keep = [c for c in docs.columns if c not in COUNTS]
    src = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias(free("text", docs)))
    schema = src.select(*[f"`{c}`" for c in keep]).schema
    for c in COUNTS:
        schema = schema.add(c, "long")

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in slices(batch, len(keep)):
                got = statistics(data, offsets)
                yield pa.RecordBatch.from_arrays([part.column(i) for i in range(len(keep))] + [pa.array(x.astype(np.int64)) for x in got], keep + COUNTS)

    return src.mapInArrow(f, schema)


def features() -> dict[str, Column]:
    """FEATURES over COUNTS; each is 0 where its divisor is."""

    def share(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))

    return {
        "n_words": F.col("n_words").cast("double"), "mean_word": share("word_chars", "n_words"), "symbol_share": share("n_symbols", "n_words"), "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"), "upper_share": share("n_upper", "word_chars"), "digit_share": share("n_digits", "word_chars"), "short_share": share("n_short", "n_words"), "words_per_line": share("n_words", "n_lines"),
    }


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool  # feature >= threshold, else feature <= threshold
    threshold: float

    def column(self) -> Column:
        c = features()[self.feature]
        return c >= self.threshold if self.above else c <= self.threshold

    def holds(self, x: np.ndarray) -> np.ndarray:
        v = x[:, FEATURES.index(self.feature)]
        return v >= self.threshold if self.above else v <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<='} {self.threshold:.6g}"


def covers(rule: list[Test], x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for t in rule:
        out &= t.holds(x)
    return out


def _grow(x: np.ndarray, y: np.ndarray, longest: int) -> list[Test]:
    """Adds the test of largest information gain until the rule covers no negatives or gains nothing."""
    rule: list[Test] = []
    inside_ = np.ones(len(x), bool)
    while len(rule) < longest:
        p0, n0 = (y & inside_).sum(), (~y & inside_).sum()
        if not n0 or not p0:
            break
        best, gain = None, 1e-9
        for j, name in enumerate(FEATURES):
            v = x[inside_, j]
            order = np.argsort(v, kind="stable")
            v, z = v[order], y[inside_][order]
            cut = np.flatnonzero(v[1:] != v[:-1])
            if not len(cut):
                continue
            p, n = np.cumsum(z)[cut], np.cumsum(~z)[cut]
            mid = (v[cut] + v[cut + 1]) / 2
            for above, pp, nn in ((False, p, n), (True, p0 - p, n0 - n)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    g = np.where(pp > 0, pp * (np.log2(pp / (pp + nn)) - np.log2(p0 / (p0 + n0))), 0)
                i = int(np.argmax(g))
                if g[i] > gain:
                    best, gain = Test(name, above, float(mid[i])), float(g[i])
        if best is None:
            break
        rule.append(best)
        inside_ &= best.holds(x)
    return rule


def _prune(rule: list[Test], x: np.ndarray, y: np.ndarray) -> list[Test]:
    """Drops final tests while (p - n) / (p + n) on rows not grown on does not fall."""

    def worth(r: list[Test]) -> float:
        c = covers(r, x)
        p, n = (y & c).sum(), (~y & c).sum()
        return (p - n) / (p + n) if p + n else -1.0

    while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
        rule = rule[:-1]
    return rule


def learn(x: np.ndarray, y: np.ndarray, precision: float = 0.95, support: int = 5, longest: int = 4, most: int = 16) -> list[list[Test]]:
    """Rules for y, in order, by sequential covering; rows in any order, but the same order gives the same rules."""
    rules: list[list[Test]] = []
    left = np.ones(len(x), bool)
    third = np.arange(len(x)) % 3 == 2
    while len(rules) < most and (y & left).sum() >= support:
        rule = _prune(_grow(x[left & ~third], y[left & ~third], longest), x[left & third], y[left & third])
        if not rule:
            break
        c = covers(rule, x) & left
        p, n = (y & c).sum(), (~y & c).sum()
        held = c & third
        if p < support or p < precision * (p + n) or (held.any() and (y & held).sum() < precision * held.sum() - 1):
            break
        rules.append(rule)
        left &= ~c
    return rules


def expression(rules: list[list[Test]]) -> Column:
    """The number (from 1) of the first rule that holds, or 0, as one ordered conditional expression."""
    out = None
    for i, rule in enumerate(rules):
        cond = rule[0].column()
        for t in rule[1:]:
            cond &= t.column()
        out = F.when(cond, i + 1) if out is None else out.when(cond, i + 1)
    return F.lit(0) if out is None else out.otherwise(0)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id: str = "doc_id", label: str = "quality", **how) -> list[list[Test]]:
    """Rules for low quality (label 0) from at most ``sample`` labelled rows, those of smallest hash of id."""
    rows = labels.where(F.col(label).isNotNull() & F.col(id).isNotNull()).select(F.col(id).alias("_id"), F.col(label).alias("_y"), F.xxhash64(id).alias("_h")).orderBy("_h", "_id", "_y").limit(sample)
    both = docs.select(F.col(id).alias("_doc"), F.col("text").alias("text")).join(F.broadcast(rows), F.col("_doc") == F.col("_id"))  # at most ``sample`` rows of three numbers
    stats = with_statistics(both.select("_h", "_y", "text"))
    got = stats.select("_h", "_y", *[c.alias(f"f_{n}") for n, c in features().items()]).toPandas()
    got = got.sort_values(list(got.columns))
    return learn(got[[f"f_{n}" for n in FEATURES]].to_numpy(float), got["_y"].to_numpy() == 0, **how)


def assess(docs: DataFrame, rules: list[list[Test]], text: str = "text") -> DataFrame:
    """docs with COUNTS, ``base_failed``, ``rule`` (first learned rule that holds, 0: none) and ``kept``.

    base_failed: fewer than 10 words, or over a fifth of the words repeated.
    Null and empty texts have zeros everywhere, so they fail the base rules.
    Repeated rows repeat; an empty table gives an empty table.
    """
    out = with_statistics(docs, text)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("rule", expression(rules)).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def query(spark, sf_dir: str) -> DataFrame:
    """op10: statistics and verdict for every document; rules learned from labels.quality."""
    from lumen.llm.shared import read

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    rules = fit(docs, read(spark, sf_dir, "labels"))
    return assess(docs, rules).select("doc_id", *COUNTS[:5], "base_failed", "kept", "rule")
