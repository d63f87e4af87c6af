"""Toxicity by weak supervision.

Many voters look at a text: each word of a lexicon induced from labelled rows,
each word of a small seed lexicon, patterns of address and shouting, and voters
for the absence of all of these.  A generative model of the votes given a
hidden label is fitted by expectation-maximisation; it estimates each voter's
accuracy, and from what the votes of two voters still share once the label is
known, their correlation, by which correlated voters are discounted.  The
observed label is one more, strong voter.  A linear classifier is trained on
the posterior labels and scores every text.

Scale: learning takes at most ``SAMPLE`` labelled rows, those of smallest hash;
their words are counted by Spark, once for each distinct text, and their votes
(a few bytes each) go to the driver.  Scoring is a narrow pass over whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumen.llm.shared import fold, free, prepare

#: Labelled rows that learning takes at most, words of the induced lexicon at most (a bound on the classifier's size), and standard errors by which a word's shares must differ.
SAMPLE, LEXICON, SURE = 20_000, 512, 6.0
#: Chance that an observed label is right.
TRUST = 0.95

#: Seed lexicon.
SEEDS = ["idiot", "moron", "stupid", "dumb", "scum", "trash", "garbage", "pathetic", "worthless", "disgusting", "loser", "clown", "fool", "filth", "vermin", "imbecile", "hate", "despise"]
ADDRESS = ["you", "your", "you're", "yourself"]

_SPACED = bytes(b + 32 if 65 <= b <= 90 else b if b >= 0x80 or chr(b).isalpha() or b == 39 else 32 for b in range(256))
_UPPER = bytes(range(65, 91))
_LETTERS = bytes([*range(65, 91), *range(97, 123)])


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(_SPACED).split()


@dataclass
class Model:
    """Lexicon, the label model's estimates, and the linear classifier."""

    lexicon: list[bytes]
    accuracy: np.ndarray | None = None  # of each voter: chance that a vote it casts is right
    correlation: np.ndarray | None = None  # between voters, given the label
    weights: np.ndarray | None = None

    @cached_property
    def index(self) -> dict[bytes, int]:
        return {w: i for i, w in enumerate(self.lexicon)}

    @property
    def voters(self) -> list[str]:
        return [w.decode("utf-8", "replace") for w in self.lexicon] + ["several", "addressed", "shouted", "repeated", "none", "long_none"]

    def look(self, raw: bytes) -> np.ndarray:
        """What the voters look at: presence of each lexicon word, then pattern features between 0 and 1."""
        words = words_of(raw)
        distinct = set(words)
        out = np.zeros(len(self.lexicon) + 6)
        hits = sorted(self.index[w] for w in distinct & self.index.keys())
        out[hits] = 1
        n, k = len(self.lexicon), len(hits)
        out[n] = k >= 2
        letters = len(raw) - len(raw.translate(None, _LETTERS))
        shouting = letters >= 20 and 2 * (len(raw) - len(raw.translate(None, _UPPER))) > letters
        out[n + 1] = k > 0 and any(w.encode() in distinct for w in ADDRESS)
        out[n + 2] = k > 0 and (shouting or raw.count(b"!") > 2)
        out[n + 3] = k > 0 and any(words.count(self.lexicon[i]) > 1 for i in hits)
        out[n + 4] = k == 0
        out[n + 5] = k == 0 and len(words) > 50
        return out

    def score(self, looks: np.ndarray) -> np.ndarray:
        z = looks @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def label_model(votes: np.ndarray, label: np.ndarray, sign: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of label 1 for each row, each voter's accuracy, and the voters' correlations given the label.

    votes: 1 where a voter votes, else it abstains; sign: 1 if its vote says 1, 0 if it says 0; label: 0, 1, or -1 if not observed.
    """
    n, m = votes.shape
    hint = np.where(label >= 0, np.where(label == 1, TRUST, 1 - TRUST), 0.5)
    q = np.where(label >= 0, hint, np.clip((votes @ sign) / np.maximum(votes.sum(1), 1), 0.05, 0.95))
    weight, rho = np.ones(m), np.zeros((m, m))
    logit = lambda p: np.log(p / (1 - p))
    for again in range(2):
        for _ in range(rounds):
            prior = np.clip(q.mean(), 1e-4, 1 - 1e-4)
            p1 = (votes.T @ q + 0.5 * prior) / (q.sum() + 1)
            p0 = (votes.T @ (1 - q) + 0.5 * (1 - prior)) / ((1 - q).sum() + 1)
            p1, p0 = np.clip(p1, 1e-5, 1 - 1e-5), np.clip(p0, 1e-5, 1 - 1e-5)
            z = logit(prior) + votes @ (weight * np.log(p1 / p0)) + (1 - votes) @ (weight * np.log((1 - p1) / (1 - p0))) + logit(hint)
            new = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            done = np.abs(new - q).max() < 1e-6
            q = new
            if done:
                break
        if not again:
            rest = votes - (q[:, None] * p1 + (1 - q)[:, None] * p0)
            sd = np.sqrt((rest**2).mean(0)) + 1e-9
            rho = (rest.T @ rest) / n / np.outer(sd, sd)
            np.fill_diagonal(rho, 0)
            weight = 1 / (1 + np.clip(np.abs(rho) - 2 / np.sqrt(max(n, 4)), 0, None).sum(1))
    right = np.where(sign == 1, votes.T @ q, votes.T @ (1 - q))
    return q, (right + 0.5) / (votes.sum(0) + 1), rho


def linear(x: np.ndarray, q: np.ndarray, ridge: float = 1.0, rounds: int = 40) -> np.ndarray:
    """Logistic regression on soft labels by Newton steps; the last weight is the intercept, not shrunk."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, r = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    r[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(r), x.T @ (q - p) - r * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        words, label = [], []
        for y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            got = set(words_of((t or "").encode("utf-8", "surrogatepass")))
            words += got
            label += [y] * len(got)
        t = pa.table({"w": pa.array(words, pa.binary()), "y": pa.array(label, pa.int64())}).group_by("w").aggregate([("y", "sum"), ("y", "count")])
        yield from pa.table({"w": t["w"], "y": t["y_sum"], "n": t["y_count"]}).to_batches()


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """A model from at most ``sample`` rows of labels (those of smallest hash of id; others than 0 and 1 are left out)."""
    spark = docs.sparkSession
    prepare(spark)
    rows = labels.where(F.col(label).isin(0, 1) & F.col(id).isNotNull()).select(F.col(id).alias("_id"), F.col(label).cast("long").alias("_y"), F.xxhash64(id).alias("_h")).orderBy("_h", "_id", "_y").limit(sample)
    texts = docs.select(F.col(id).alias("_doc"), F.col(text).alias("_text"))
    chosen = texts.join(F.broadcast(rows), F.col("_doc") == F.col("_id")).select("_h", "_y", "_text")  # at most ``sample`` rows of three numbers
    # Copies and most near copies of a text, which share their least 5-word shingle, count once.
    w = F.split(F.lower("_text"), r"\s+")
    least = F.array_min(F.transform(F.sequence(F.lit(0), F.greatest(F.size("_w") - 5, F.lit(0))), lambda i: F.xxhash64(F.slice("_w", i + 1, 5))))
    once = chosen.withColumn("_w", w).groupBy("_y", least.alias("_copy")).agg(F.min("_text").alias("_text"))
    n = {r["_y"]: r["count"] for r in once.groupBy("_y").count().collect()}
    n0, n1 = n.get(0, 0), n.get(1, 0)
    counts = once.select("_y", "_text").mapInArrow(_words, "w binary, y long, n long").groupBy("w").agg(F.sum("y").alias("a"), F.sum("n").alias("n"))
    odds = F.log((F.col("a") + 0.5) / (n1 + 1)) - F.log((F.col("n") - F.col("a") + 0.5) / (n0 + 1))
    share = F.col("n") / max(1, n0 + n1)
    z = (F.col("a") / max(1, n1) - (F.col("n") - F.col("a")) / max(1, n0)) / F.sqrt(share * (1 - share) * (1 / max(1, n0) + 1 / max(1, n1)))
    telling = counts.where(F.col("a") >= 5).withColumns({"odds": odds, "z": z}).where((F.col("odds") > F.log(F.lit(4.0))) & (F.col("z") >= SURE)).orderBy(F.desc("z"), "w").limit(LEXICON)
    induced = [bytes(r["w"]) for r in telling.collect()]
    model = Model(induced + [s.encode() for s in SEEDS if s.encode() not in induced])
    lexicon = model.lexicon

    def looks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(lexicon)
        for b in batches:
            x = [own.look((t or "").encode("utf-8", "surrogatepass")).astype(np.int8).tobytes() for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(x, pa.binary())], ["h", "y", "x"])

    got = sorted((r["h"], r["y"], bytes(r["x"])) for r in chosen.mapInArrow(looks, "h long, y long, x binary").collect())  # ``sample`` rows at most
    x = np.array([np.frombuffer(g[2], np.int8) for g in got], float).reshape(len(got), len(lexicon) + 6)
    y = np.array([g[1] for g in got], int)
    if not len(got):  # nothing to learn from: the seed lexicon alone
        x = np.array([model.look(w) for w in lexicon] + [model.look(b"plain words")] * len(lexicon))
        y = np.full(len(x), -1)
    sign = np.ones(x.shape[1])
    sign[-2:] = 0
    q, model.accuracy, model.correlation = label_model(x, y, sign)
    model.weights = linear(x, q)
    return model


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """docs with the column ``name`` added (replaced if present): 0 to 1, higher if label 1 is likelier.

    Null and empty texts get the score of a text without any word.  Repeated
    rows repeat; an empty table gives an empty table.
    """
    prepare(docs.sparkSession)
    keep = [c for c in docs.columns if c != name]
    src = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias(free("text", docs)))

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([model.look((t or "").encode("utf-8", "surrogatepass")) for t in b.column(len(keep)).to_pylist()]).reshape(b.num_rows, len(model.lexicon) + 6)
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(len(keep))] + [pa.array(model.score(x))], keep + [name])

    return src.mapInArrow(f, src.select(*[f"`{c}`" for c in keep]).schema.add(name, "double"))


def query(spark, sf_dir: str) -> DataFrame:
    """op7: toxicity of every document, learned from four of five id folds of labels."""
    from lumen.llm.shared import read

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, read(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0))
    out = score(docs.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "text"), model)
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
