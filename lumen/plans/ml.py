"""Model choice, training and metrics on Spark's own models."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.ml import Pipeline
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LogisticRegression, NaiveBayes, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, GeneralizedLinearRegression, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumen.functions.columns import rounded
from lumen.operators.rows import average_ranks
from lumen.plans.learners import Boosted, Kernel, Neighbours, Terms, stratified_split
from lumen.plans.profile import profile
from lumen.plans.target import leaks, task_of

#: Rows below which nothing is trained.
LEAST = 100

CLASSIFIERS = {
    "random_forest": lambda: RandomForestClassifier(numTrees=100, maxDepth=8, seed=42),
    "gradient_boosting": lambda: GBTClassifier(maxIter=40, maxDepth=5, seed=42),
    "decision_tree": lambda: DecisionTreeClassifier(maxDepth=8, seed=42),
    "logistic_regression": lambda: LogisticRegression(maxIter=100, regParam=0.01),
    "naive_bayes": lambda: NaiveBayes(modelType="gaussian"),
    "boosted_trees_of_classes": lambda: OneVsRest(classifier=GBTClassifier(maxIter=40, maxDepth=5, seed=42)),
    "adaboost": lambda: Boosted(100),
    "knn": lambda: Neighbours(5),
    "kernel_svm": lambda: Kernel(),
    "linear_svm": lambda: OneVsRest(classifier=__import__("pyspark.ml.classification", fromlist=["LinearSVC"]).LinearSVC(maxIter=50)),
}
REGRESSORS = {
    "random_forest": lambda: RandomForestRegressor(numTrees=100, maxDepth=8, seed=42),
    "gradient_boosting": lambda: GBTRegressor(maxIter=40, maxDepth=5, seed=42),
    "decision_tree": lambda: DecisionTreeRegressor(maxDepth=8, seed=42),
    "linear_regression": lambda: LinearRegression(),
    "ridge": lambda: LinearRegression(regParam=0.1, elasticNetParam=0.0),
    "lasso": lambda: LinearRegression(regParam=0.1, elasticNetParam=1.0),
    "elastic_net": lambda: LinearRegression(regParam=0.1, elasticNetParam=0.5),
    "knn": lambda: Neighbours(5, mean=True),
    "kernel_ridge": lambda: Kernel(regression=True),
    "generalized_linear": lambda: GeneralizedLinearRegression(),
}
SCALED = {"logistic_regression", "linear_svm", "linear_regression", "ridge", "lasso", "elastic_net", "generalized_linear", "knn", "kernel_svm", "kernel_ridge"}


@dataclass
class Outcome:
    status: str
    model: str | None = None
    task: str | None = None
    metrics: dict = field(default_factory=dict)
    importance: list[tuple[str, float]] = field(default_factory=list)
    predictions: DataFrame | None = None
    left_out: dict[str, str] = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)
    seconds: float = 0.0


def choose(rows: int, task: str, classes: int = 2, text: bool = False) -> tuple[str, str]:
    """A model and its fallback by size and task."""
    if text:
        return "logistic_regression", "naive_bayes"
    if rows < 1000:
        return "random_forest", "logistic_regression" if task == "classification" else "ridge"
    if task == "classification" and classes > 2:
        return "random_forest", "logistic_regression"
    return "gradient_boosting", "random_forest"


def split(df: DataFrame, id_cols: list[str], share: int = 5) -> tuple[DataFrame, DataFrame]:
    """Train and test by the hash of id_cols: the same rows each time, without a shuffle."""
    h = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in id_cols]), share)
    return df.where(h != 0), df.where(h == 0)


def classification_metrics(df: DataFrame, label: str = "label", predicted: str = "prediction") -> DataFrame:
    """One row: accuracy and support-weighted precision, recall and F1, from the confusion counts."""
    n = df.groupBy(F.col(label).alias("y"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    per = n.select("y", "p", "n").where("y = p").select("y", F.col("n").alias("tp"))
    a, b = n.groupBy("y").agg(F.sum("n").alias("support")), n.groupBy(F.col("p").alias("y")).agg(F.sum("n").alias("called"))
    x = a.join(per, "y", "left").join(b, "y", "left").fillna(0)
    pr, rc = F.when(F.col("called") > 0, F.col("tp") / F.col("called")).otherwise(0.0), F.col("tp") / F.col("support")
    f1 = F.when(pr + rc > 0, 2 * pr * rc / (pr + rc)).otherwise(0.0)
    w = lambda e: rounded(F.sum(e * F.col("support")) / F.sum("support"), 4)
    return x.agg(rounded(F.sum("tp") / F.sum("support"), 4).alias("accuracy"), w(pr).alias("precision"), w(rc).alias("recall"), w(f1).alias("f1"))


def confusion(df: DataFrame, label: str = "label", predicted: str = "prediction") -> DataFrame:
    return df.groupBy(F.col(label).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def regression_metrics(df: DataFrame, label: str = "label", predicted: str = "prediction") -> DataFrame:
    e = F.col(label) - F.col(predicted)
    mse = F.avg(e * e)
    return df.agg(rounded(mse, 4).alias("mse"), rounded(F.sqrt(F.round(mse, 4)), 4).alias("rmse"), rounded(F.avg(F.abs(e)), 4).alias("mae"), rounded(1 - mse / F.var_pop(label), 4).alias("r2"))


def auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """One row: area under the curve of a 0/1 label, by the rank sum with mean ranks."""
    r = average_ranks(df.select(F.col(label).alias("y"), F.col(score).alias("s")), "s")
    n1, n = F.sum("y"), F.count("*")
    return r.agg(rounded((F.sum(F.when(F.col("y") == 1, F.col("rank"))) - n1 * (n1 + 1) / 2) / (n1 * (n - n1)), 4).alias("auc"))


def train(df: DataFrame, target: str, model: str | None = None, keys: list[str] | None = None) -> Outcome:
    """Trains a model for target with one fallback; leaking, identifying and free-text columns are left out or hashed."""
    began = time.time()
    df = df.where(F.col(f"`{target}`").isNotNull())
    ps = profile(df)
    rows = ps[target].rows
    if rows < LEAST:
        return Outcome("skipped", warnings=[f"{rows} rows; {LEAST} are needed"])
    task = task_of(ps[target])
    out = leaks(df, target, ps)
    out |= {c: "identifies rows" for c, p in ps.items() if p.kind == "identifier" and c != target} | {c: "a date" for c, p in ps.items() if p.kind == "datetime"}
    use = [c for c in ps if c != target and c not in out and ps[c].unique > 1]
    num, texts = [c for c in use if ps[c].numeric or ps[c].type == "boolean"], [c for c in use if ps[c].kind == "text"]
    cat = [c for c in use if c not in num and c not in texts]
    if not use:
        return Outcome("skipped", task=task, left_out=out, warnings=["no columns are left"])
    names = [model, *choose(rows, task, ps[target].unique, bool(texts) and len(texts) * 2 > len(use))] if model else list(choose(rows, task, ps[target].unique, bool(texts) and len(texts) * 2 > len(use)))
    if task == "classification":
        a, b = stratified_split(df, target, keys or df.columns)
        if b.select(F.col(f"`{target}`")).distinct().limit(2).count() < 2:
            return Outcome("failed", task=task, left_out=out, warnings=["fewer than two classes have two rows"])
    else:
        a, b = split(df.withColumn("_h", F.xxhash64(*[F.col(f"`{c}`") for c in keys or df.columns])).select("_h", *[F.col(f"`{c}`") for c in df.columns]), ["_h"])
    pick = lambda x: x.select(*[e for e in [F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)).alias(c) for c in num] + [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("Unknown")).alias(c) for c in cat + texts]], F.col(f"`{target}`").cast("string" if task == "classification" else "double").alias("_y"))
    train_df, test_df = pick(a), pick(b)
    steps = []
    if cat:
        steps += [StringIndexer(inputCols=cat, outputCols=[f"{c}_i" for c in cat], handleInvalid="keep"), OneHotEncoder(inputCols=[f"{c}_i" for c in cat], outputCols=[f"{c}_v" for c in cat])]
    for c in texts:
        steps.append(Terms(c, f"{c}_v"))
    steps.append(VectorAssembler(inputCols=num + [f"{c}_v" for c in cat + texts], outputCol="_x"))
    if task == "classification":
        steps.append(StringIndexer(inputCol="_y", outputCol="label", handleInvalid="skip").setStringOrderType("alphabetAsc"))
    result = Outcome("failed", task=task, left_out=out)
    for name in dict.fromkeys(names):
        try:
            if name == "gradient_boosting" and task == "classification" and ps[target].unique > 2:
                name = "boosted_trees_of_classes"
            made = (CLASSIFIERS if task == "classification" else REGRESSORS)[name]()
            fit = steps + ([StandardScaler(inputCol="_x", outputCol="features")] if name in SCALED else [])
            made = made.setFeaturesCol("features" if name in SCALED else "_x").setLabelCol("label" if task == "classification" else "_y")
            fitted = Pipeline(stages=[*fit, made]).fit(train_df)
            pred = fitted.transform(test_df)
            last = fitted.stages[-1]
            label = "label" if task == "classification" else "_y"
            result.metrics = (classification_metrics if task == "classification" else regression_metrics)(pred, label).first().asDict()
            result.predictions = pred.select(F.col(label).alias("label"), "prediction")
            weights = last.featureImportances.toArray() if hasattr(last, "featureImportances") else abs(last.coefficients.toArray()) if hasattr(last, "coefficients") else abs(last.coefficientMatrix.toArray()).mean(0) if hasattr(last, "coefficientMatrix") else []
            meta = pred.schema["_x"].metadata.get("ml_attr", {}).get("attrs", {})
            labels = {x["idx"]: x.get("name", str(x["idx"])) for k in meta.values() for x in k}
            result.importance = sorted(((labels.get(i, str(i)), round(float(w), 6)) for i, w in enumerate(weights)), key=lambda x: -x[1])[:20]
            result.status, result.model = "trained", name
            break
        except Exception as e:  # the fallback is tried, and the reason is kept
            result.warnings.append(f"{name}: {str(e)[:200]}")
    result.seconds = round(time.time() - began, 2)
    return result
