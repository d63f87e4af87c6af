"""Learners that MLlib lacks, as its estimators: nearest neighbours, kernel machines on random features, boosting of several classes; and an exact stratified split."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.classification import DecisionTreeClassifier, LinearSVC, OneVsRest
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumen.operators import neighbours, ngrams
from lumen.session import shared_dir


class _Columns:
    """Names of the columns that MLlib's learners call features, label and prediction."""

    features, label, prediction = "features", "label", "prediction"

    def setFeaturesCol(self, name: str):
        self.features = name
        return self

    def setLabelCol(self, name: str):
        self.label = name
        return self

    def _named(self, other: _Columns):
        self.features, self.label, self.prediction = other.features, other.label, other.prediction
        return self


# Nearest neighbours.


class Neighbours(Estimator, _Columns):
    """k nearest neighbours, weighted by 1 / distance; a class, or the mean with ``mean``."""

    def __init__(self, k: int = 5, mean: bool = False):
        super().__init__()
        self.k, self.mean = k, mean

    def _fit(self, dataset: DataFrame) -> NeighboursModel:
        return NeighboursModel(self, dataset.select(F.monotonically_increasing_id().alias("_id"), vector_to_array(self.features).alias("_v"), F.col(self.label).cast("double").alias("_y")))


class NeighboursModel(Model, _Columns):
    def __init__(self, of: Neighbours, rows: DataFrame):
        super().__init__()
        self._named(of)
        # Row numbers hold while the rows are read in the same order; a checkpoint settles them where a folder is named.
        self.k, self.mean = of.k, of.mean
        self.rows = rows.checkpoint() if rows.sparkSession.sparkContext.getCheckpointDir() else rows.persist()

    def _transform(self, dataset: DataFrame) -> DataFrame:
        asked = dataset.withColumn("_id", F.monotonically_increasing_id())
        asked = asked.checkpoint() if dataset.sparkSession.sparkContext.getCheckpointDir() else asked.persist()
        near = neighbours.nearest(self.rows, asked.select("_id", vector_to_array(self.features).alias("_v")), self.k, "_id", "_v", itself=True)
        found = (neighbours.mean if self.mean else neighbours.vote)(near, self.rows, "_id", "_y")
        return asked.join(found.select(F.col("id").alias("_id"), F.col("prediction").alias(self.prediction)), "_id", "left").drop("_id")


# Kernel machines.


def normal_numbers(n: int, seed: str) -> np.ndarray:
    """n standard normal numbers that depend on seed alone, by Box and Muller from SHA-256."""
    out = []
    for i in range((n + 1) // 2):
        h = hashlib.sha256(f"{seed}:{i}".encode()).digest()
        u, v = ((int.from_bytes(h[8 * j : 8 * j + 8], "big") >> 11) / (1 << 53) for j in (0, 1))
        r = math.sqrt(-2 * math.log(1 - u))
        out += [r * math.cos(2 * math.pi * v), r * math.sin(2 * math.pi * v)]
    return np.array(out[:n])


def fourier_map(dim: int, size: int, gamma: float, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies (dim x size) and phases whose cosines, times sqrt(2 / size), have the products exp(-gamma * squared distance) on average."""
    w = normal_numbers(dim * size, f"{seed}:w").reshape(dim, size) * math.sqrt(2 * gamma)
    u = normal_numbers(size, f"{seed}:b")
    return w, np.array([math.pi * (1 + math.erf(x / math.sqrt(2))) for x in u])


def fourier_features(col: Column, w: np.ndarray, b: np.ndarray) -> Column:
    """The features of a column of arrays of doubles."""
    dim, size = w.shape

    def f(v: pa.Array) -> pa.Array:
        x = v.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        z = math.sqrt(2 / size) * np.cos(x @ w + b)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * size), pa.array(z.ravel()))

    return F.arrow_udf(f, "array<double>")(col)


def scale_gamma(df: DataFrame, features: str) -> tuple[int, float]:
    """Number of features, and 1 / (their number * the variance of all their values)."""
    x = df.select(vector_to_array(features).alias("v"))
    dim = x.select(F.size("v").alias("n")).first()["n"]
    total = lambda f: F.aggregate("v", F.lit(0.0), lambda a, e: a + f(e))
    r = x.agg(F.sum(total(lambda e: e)).alias("s"), F.sum(total(lambda e: e * e)).alias("q"), F.count("*").alias("n")).first()
    mean = r["s"] / (r["n"] * dim)
    return dim, 1 / (dim * (r["q"] / (r["n"] * dim) - mean * mean) or 1.0)


class Fourier(Transformer, _Columns):
    """Adds the random Fourier features of ``features`` as ``output``."""

    def __init__(self, dim: int, gamma: float, size: int = 1024, seed: int = 42, output: str = "_fourier"):
        super().__init__()
        self.w, self.b = fourier_map(dim, size, gamma, seed)
        self.output = output

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumn(self.output, array_to_vector(fourier_features(vector_to_array(self.features), self.w, self.b)))


class Kernel(Estimator, _Columns):
    """A linear learner of MLlib on random Fourier features of the radial kernel; gamma by the features' variance."""

    def __init__(self, learner=None, size: int = 1024, gamma: float | None = None, regression: bool = False, seed: int = 42):
        super().__init__()
        self.learner = learner or (LinearRegression(regParam=0.001) if regression else OneVsRest(classifier=LinearSVC(maxIter=50, regParam=0.001)))
        self.size, self.gamma, self.seed = size, gamma, seed

    def _fit(self, dataset: DataFrame) -> KernelModel:
        dim, gamma = scale_gamma(dataset, self.features)
        step = Fourier(dim, self.gamma or gamma, self.size, self.seed).setFeaturesCol(self.features)
        made = self.learner.setFeaturesCol(step.output).setLabelCol(self.label)
        return KernelModel(self, step, made.fit(step.transform(dataset)))


class KernelModel(Model, _Columns):
    def __init__(self, of: Kernel, step: Fourier, fitted):
        super().__init__()
        self._named(of)
        self.step, self.fitted = step, fitted

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.fitted.transform(self.step.transform(dataset)).drop(self.step.output)


# Boosting.


def reweighted(df: DataFrame, label: str, prediction: str, weight: str, classes: int) -> tuple[DataFrame, float | None]:
    """A round of SAMME: df with its weights raised where prediction is wrong, summing to one, and the round's say; None where it is no better than chance, or never wrong."""
    wrong = F.col(label) != F.col(prediction)
    r = df.agg(F.sum(weight).alias("all"), F.coalesce(F.sum(F.when(wrong, F.col(weight))), F.lit(0.0)).alias("wrong")).first()
    error = r["wrong"] / r["all"] if r["all"] else 0.0
    if error <= 0 or error >= 1 - 1 / classes:
        return df, None
    say = math.log((1 - error) / error) + math.log(classes - 1)
    total = (r["all"] - r["wrong"]) + r["wrong"] * math.exp(say)
    return df.withColumn(weight, F.col(weight) * F.when(wrong, math.exp(say)).otherwise(1.0) / total), say


class Boosted(Estimator, _Columns):
    """AdaBoost (SAMME) of weak learners that take weights; shallow trees by default."""

    def __init__(self, rounds: int = 50, learner=None):
        super().__init__()
        self.rounds, self.learner = rounds, learner or DecisionTreeClassifier(maxDepth=1)

    def _fit(self, dataset: DataFrame) -> BoostedModel:
        classes = int(dataset.agg(F.max(self.label)).first()[0]) + 1
        df = dataset.select(self.features, F.col(self.label).alias("_y")).withColumn("_w", F.lit(1.0) / dataset.count())
        kept: list = []
        learner = self.learner.copy().setFeaturesCol(self.features).setLabelCol("_y").setWeightCol("_w").setPredictionCol("_p").setRawPredictionCol("").setProbabilityCol("")
        spark, root = dataset.sparkSession, shared_dir(dataset.sparkSession)
        for i in range(self.rounds):
            model = learner.fit(df)
            df, say = reweighted(model.transform(df), "_y", "_p", "_w", classes)
            df = df.select(self.features, "_y", "_w")
            if say is None:
                if not kept:
                    kept = [(1.0, model)]  # the first round, whatever it is worth
                elif model.transform(df).where("_y <> _p").isEmpty():
                    kept.append((1.0 + sum(s for s, _ in kept), model))  # never wrong: it decides
                break
            kept.append((say, model))
            if i % 4 == 3:  # each round's weights rest on those before
                df.write.parquet(f"{root}/{i}")
                df = spark.read.parquet(f"{root}/{i}")
        return BoostedModel(self, kept, classes)


class BoostedModel(Model, _Columns):
    def __init__(self, of: Boosted, kept: list, classes: int):
        super().__init__()
        self._named(of)
        self.says, self.models, self.classes = [s for s, _ in kept], [m for _, m in kept], classes

    def _transform(self, dataset: DataFrame) -> DataFrame:
        out, votes = dataset, [f"_p{i}" for i in range(len(self.models))]
        for m, v in zip(self.models, votes):
            m.setPredictionCol(v)
            out = m.transform(out)
        score = [sum((F.when(F.col(v) == c, s).otherwise(0.0) for v, s in zip(votes, self.says)), F.lit(0.0)) for c in range(self.classes)]
        best = F.array_max(F.array(*[F.struct(x.alias("s"), F.lit(-c).alias("c")) for c, x in enumerate(score)]))  # ties: the smaller class
        return out.withColumn(self.prediction, (-best["c"]).cast("double")).drop(*votes)


# Texts.


class Terms(Estimator):
    """Weights of the ``size`` most frequent words and word pairs of a text column, scaled to length one."""

    def __init__(self, text: str, output: str, size: int = 5000, n: int = 2, stop: list[str] | None = None):
        super().__init__()
        self.text, self.output, self.size, self.n, self.stop = text, output, size, n, ngrams.default_stop_words() if stop is None else stop

    def _fit(self, dataset: DataFrame) -> TermsModel:
        known = sorted(ngrams.vocabulary(dataset, self.text, self.size, self.n, self.stop).collect(), key=lambda r: r["place"])  # size rows
        return TermsModel(self, [r["term"] for r in known], [r["documents"] for r in known], dataset.count())


class TermsModel(Model):
    def __init__(self, of: Terms, words: list[str], documents: list[int], rows: int):
        super().__init__()
        self.text, self.output, self.n, self.stop, self.words = of.text, of.output, of.n, of.stop, words
        self.idf = [math.log((1 + rows) / (1 + k)) + 1 for k in documents]

    def _transform(self, dataset: DataFrame) -> DataFrame:
        if not self.words:
            return dataset.withColumn(self.output, array_to_vector(F.array(F.lit(0.0))))
        listed = dataset.withColumn("_terms", ngrams.terms(F.col(self.text), self.n, self.stop))
        counted = CountVectorizerModel.from_vocabulary(self.words, inputCol="_terms", outputCol="_counts").transform(listed)
        weighted = ElementwiseProduct(scalingVec=Vectors.dense(self.idf), inputCol="_counts", outputCol="_weights").transform(counted)
        return Normalizer(p=2.0, inputCol="_weights", outputCol=self.output).transform(weighted).drop("_terms", "_counts", "_weights")


# Splits.


def stratified_split(df: DataFrame, target: str, keys: list[str], share: float = 0.2, buckets: int = 1024) -> tuple[DataFrame, DataFrame]:
    """Train and test rows with ``share`` of each class (to the nearest row) in the test, those of smallest SHA-256 of their keys.

    Counts by class and hash range tell the range in which a class's share ends;
    only its rows are put in order.  Classes of fewer than two rows, which
    cannot stand on both sides, go; rows without a class do too.  Keys must tell
    rows apart; rows of equal keys stay together as far as the share allows.
    """
    text = F.concat_ws("\x1f", *[F.coalesce(F.col(f"`{k}`").cast("string"), F.lit("\x00")) for k in keys])
    h = F.conv(F.substring(F.sha2(text, 256), 1, 12), 16, 10).cast("long")
    rows = df.where(F.col(f"`{target}`").isNotNull()).withColumn("_h", h).withColumn("_b", (h / (1 << 48) * buckets).cast("int"))
    c = F.col(f"`{target}`")
    counts = rows.groupBy(c.alias("_c"), "_b").agg(F.count("*").alias("_n"))  # classes times buckets
    w = Window.partitionBy("_c").orderBy("_b")
    total = F.sum("_n").over(Window.partitionBy("_c"))
    quota = F.floor(total * share + 0.5)
    ends = counts.select("_c", "_b", (F.sum("_n").over(w) - F.col("_n")).alias("_before"), "_n", total.alias("_all"), F.greatest(F.least(quota, total - 1), F.lit(1)).alias("_quota")).where("_all >= 2")
    ends = ends.where("_before < _quota and _before + _n >= _quota").select("_c", F.col("_b").alias("_end"), (F.col("_quota") - F.col("_before")).alias("_left"))  # a row a class
    both = rows.join(F.broadcast(ends), c == F.col("_c")) if _few(ends) else rows.join(ends, c == F.col("_c"))
    edge = both.where("_b = _end").withColumn("_r", F.row_number().over(Window.partitionBy("_c").orderBy("_h", *[F.col(f"`{x}`") for x in keys])))
    names = [F.col(f"`{x}`") for x in df.columns]
    test = both.where("_b < _end").select(*names).union(edge.where("_r <= _left").select(*names))
    train = both.where("_b > _end").select(*names).union(edge.where("_r > _left").select(*names))
    return train, test


def _few(ends: DataFrame, most: int = 100_000) -> bool:
    """Whether a frame of a row a class is small enough to be sent to all tasks."""
    return ends.limit(most + 1).count() <= most
