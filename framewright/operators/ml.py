"""Models on Spark ML with honest splits and metrics, and two closed-form scorers as plain plans."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier, GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier,
)
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, functions as F

from framewright.functions.numbers import finite, half_up, percent, ratio
from framewright.functions.text import is_number
from framewright.operators.encoding import FOLD, FOLDS, feature_stages, layout, summed
from framewright.operators.nearest import nearest
from framewright.operators.profile import Profile
from framewright.operators.scale import number_rows, one_row, running_totals
from framewright.session import work_folder

REGRESSORS = ("ols", "ridge", "lasso", "random_forest", "gradient_boosting")
KEY = "_key"
CLASSIFIERS = ("logistic", "decision_tree", "random_forest", "gradient_boosting")


def bucket(key: str, buckets: int = 100, seed: int = 42) -> Column:
    """A stable bucket of a row key: the same on every run, cluster and engine with md5."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")))
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % buckets).cast("int")


def split(df: DataFrame, key: str, test_pct: int = 20, seed: int = 42) -> DataFrame:
    """Adds ``is_test`` by key hash; no shuffle and no random state."""
    return df.withColumn("is_test", bucket(key, 100, seed) < test_pct)


def typed(df: DataFrame, features: list[str]) -> DataFrame:
    """Numeric features as doubles, others as text."""
    casts = {f: F.col(f"`{f}`").cast("double" if is_number(df.schema[f].dataType) else "string") for f in features}
    return df.withColumns(casts)


@dataclass
class Trained:
    """A fitted pipeline with its test predictions and tables."""

    model: PipelineModel
    predictions: DataFrame
    metrics: DataFrame
    features: list[str]
    places: list[str]

    def importances(self) -> DataFrame:
        """Weight of each feature: tree importance, or absolute coefficient of standardised features."""
        final = self.model.stages[-1]
        if hasattr(final, "featureImportances"):
            values = final.featureImportances.toArray()
        elif hasattr(final, "coefficientMatrix"):
            values = abs(final.coefficientMatrix.toArray()).mean(axis=0)
        elif hasattr(final, "coefficients"):
            values = abs(final.coefficients.toArray())
        else:
            values = [0.0] * len(self.places)
        rows = summed(self.places, values)
        spark = self.predictions.sparkSession
        return spark.createDataFrame(rows, "feature string, importance double").select(
            "feature", half_up(F.col("importance"), 4).alias("importance")
        )


def regressor(kind: str, seed: int):
    shared = {"featuresCol": "_x", "labelCol": "_y", "predictionCol": "prediction"}
    if kind == "ols":
        return LinearRegression(**shared)
    if kind == "ridge":
        return LinearRegression(regParam=0.1, elasticNetParam=0.0, **shared)
    if kind == "lasso":
        return LinearRegression(regParam=0.1, elasticNetParam=1.0, **shared)
    if kind == "random_forest":
        return RandomForestRegressor(numTrees=20, maxDepth=5, seed=seed, **shared)
    if kind == "gradient_boosting":
        return GBTRegressor(maxIter=20, maxDepth=3, seed=seed, **shared)
    raise ValueError(f"unknown regressor {kind}")


def classifier(kind: str, seed: int, classes: int):
    shared = {"featuresCol": "_x", "labelCol": "_y", "predictionCol": "prediction"}
    if kind == "logistic":
        return LogisticRegression(maxIter=50, **shared)
    if kind == "decision_tree":
        return DecisionTreeClassifier(maxDepth=5, seed=seed, **shared)
    if kind == "random_forest":
        return RandomForestClassifier(numTrees=20, maxDepth=5, seed=seed, **shared)
    if kind == "gradient_boosting":
        boosted = GBTClassifier(maxIter=20, maxDepth=3, seed=seed, **shared)
        return boosted if classes == 2 else OneVsRest(classifier=boosted, **shared)
    raise ValueError(f"unknown classifier {kind}")


def regression_metrics(predictions: DataFrame, features: int) -> DataFrame:
    """R2, adjusted R2, RMSE, MAE and MSE of ``_y`` against ``prediction`` in one aggregate."""
    gap = F.col("_y") - F.col("prediction")
    facts = predictions.agg(
        F.count("*").alias("n"), F.avg(gap * gap).alias("mse"), F.avg(F.abs(gap)).alias("mae"), F.var_pop("_y").alias("var")
    )
    r2 = 1 - ratio(F.col("mse"), F.col("var"))
    return facts.select(
        F.col("n").alias("test_rows"), half_up(r2, 4).alias("r2"),
        half_up(1 - (1 - r2) * (F.col("n") - 1) / F.nullif(F.col("n") - features - 1, F.lit(0)), 4).alias("adjusted_r2"),
        half_up(F.sqrt("mse"), 4).alias("rmse"), half_up(F.col("mae"), 4).alias("mae"), half_up(F.col("mse"), 4).alias("mse"),
    )


#: Training rows of a partition at most: files are read by their compressed bytes, and a few of these are very many vectors.
ROWS_PER_TASK = 100_000


def spread(rows: DataFrame) -> DataFrame:
    """The rows dealt evenly over partitions of at most ``ROWS_PER_TASK`` rows; fewer rows stay as they are read."""
    parts = -(-rows.count() // ROWS_PER_TASK)
    return rows.repartition(parts) if parts > 1 else rows


def _stored(df: DataFrame, name: str) -> DataFrame:
    """The frame written once and read again, so that the passes of a fit do not repeat what made it."""
    path = work_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def prepared(df: DataFrame, target: Column, features: list[str], key: str, name: str, test_pct: int = 20, seed: int = 42) -> DataFrame:
    """Key (as ``KEY``, since it may be a feature too), typed features, the target as ``name``, ``is_test`` and the fold of a row; rows without a target are left out."""
    rows = df.select(F.col(f"`{key}`").alias(KEY), *[F.col(f"`{c}`") for c in features], target.alias(name)).where(F.col(name).isNotNull())
    rows = split(rows, KEY, test_pct, seed).withColumn(FOLD, bucket(KEY, FOLDS, seed + 1))
    return _stored(typed(rows, features), "model-rows")


def train_regression(df: DataFrame, target: str, features: list[str], key: str, kind: str = "ols", test_pct: int = 20,
                     seed: int = 42, parts: DataFrame | None = None) -> Trained:
    """Fit on the training part, judge on the rest. Rows without a numeric target are left out."""
    parts = prepared(df, finite(F.col(f"`{target}`")), features, key, "_y", test_pct, seed) if parts is None else parts
    train, test = parts.where(~F.col("is_test")), parts.where(F.col("is_test")).drop(FOLD)
    model = Pipeline(stages=[*feature_stages(parts, features), regressor(kind, seed)]).fit(spread(train))
    predictions = model.transform(test).select(F.col(KEY).alias(key), "_y", "prediction")
    return Trained(model, predictions, regression_metrics(predictions, len(features)), features, layout(parts, features))


def confusion(predictions: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """Counts per actual and predicted class."""
    return predictions.groupBy(F.col(actual).cast("string").alias("actual"), F.col(predicted).cast("string").alias("predicted")).agg(
        F.count("*").alias("records")
    )


def class_metrics(counts: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class from a confusion table."""
    hit = F.when(F.col("actual") == F.col("predicted"), F.col("records")).otherwise(0)
    by_actual = counts.groupBy(F.col("actual").alias("class")).agg(F.sum("records").alias("support"), F.sum(hit).alias("hits"))
    by_predicted = counts.groupBy(F.col("predicted").alias("class")).agg(F.sum("records").alias("claimed"))
    both = by_actual.join(by_predicted, "class", "left")
    precision = F.coalesce(ratio(F.col("hits"), F.col("claimed")), F.lit(0.0))
    recall = F.coalesce(ratio(F.col("hits"), F.col("support")), F.lit(0.0))
    f1 = F.coalesce(ratio(2 * precision * recall, precision + recall), F.lit(0.0))
    return both.select(
        "class", half_up(precision, 4).alias("precision"), half_up(recall, 4).alias("recall"), half_up(f1, 4).alias("f1"), "support"
    )


def accuracy(counts: DataFrame) -> DataFrame:
    """Accuracy and support-weighted precision, recall and F1."""
    per = class_metrics(counts)
    w = F.col("support")
    weighted = per.agg(*[half_up(F.sum(F.col(c) * w) / F.sum(w), 4).alias(c) for c in ("precision", "recall", "f1")],
                       F.sum(w).alias("test_rows"))
    hits = counts.agg((F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("records")).otherwise(0)) / F.sum("records"))
                      .alias("a")).scalar()
    return weighted.select("test_rows", half_up(hits, 4).alias("accuracy"), "precision", "recall", "f1")


def class_numbers(train: DataFrame) -> DataFrame:
    """(_label, _y): the classes of a training part numbered in order of their names; a table of any length."""
    names = train.select("_label").distinct()
    return _stored(number_rows(names, [F.col("_label")], "_no").select("_label", (F.col("_no") - 1).cast("double").alias("_y")), "classes")


def train_classification(df: DataFrame, target: str, features: list[str], key: str, kind: str = "logistic", test_pct: int = 20,
                         seed: int = 42, parts: DataFrame | None = None) -> Trained:
    """Fit a classifier on the training part; predictions carry the class names and the score of the last class.

    Class names are joined to their numbers and back; only how many there are is known to the driver.
    """
    parts = prepared(df, F.col(f"`{target}`").cast("string"), features, key, "_label", test_pct, seed) if parts is None else parts
    train, test = parts.where(~F.col("is_test")), parts.where(F.col("is_test")).drop(FOLD)
    names = class_numbers(train)
    many = names.count()
    model = Pipeline(stages=[*feature_stages(parts, features, many), classifier(kind, seed, many)]).fit(spread(train).join(names, "_label"))
    scored = model.transform(test)
    cols = [F.col(KEY).alias(key), F.col("_label").alias("actual"), "prediction"]
    if "probability" in scored.columns:
        cols.append(vector_to_array("probability")[many - 1].alias("score"))
    named = scored.select(*cols).join(names.select(F.col("_y").alias("prediction"), F.col("_label").alias("predicted")), "prediction", "left")
    kept = [c for c in (key, "actual", "predicted", "score") if c in named.columns]
    predictions = named.select(*[F.col(f"`{c}`") for c in kept])
    return Trained(model, predictions, accuracy(confusion(predictions)), features, layout(parts, features, many))


def roc_points(predictions: DataFrame, positive: Column, score: str = "score") -> DataFrame:
    """ROC and precision-recall points per distinct score, best first; counts are summed before they are ordered."""
    counts = predictions.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("threshold")).agg(
        F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg")
    )
    both = running_totals(counts, [], [F.col("threshold").desc()], {"tp": F.col("pos"), "fp": F.col("neg")})
    totals = one_row(both.agg(F.max("tp").alias("p"), F.max("fp").alias("n")))
    rows = both.withColumn("_t", totals)
    return rows.select(
        "threshold", "tp", "fp", half_up(ratio(F.col("tp"), F.col("_t.p")), 6).alias("tpr"),
        half_up(ratio(F.col("fp"), F.col("_t.n")), 6).alias("fpr"),
        half_up(ratio(F.col("tp"), F.col("tp") + F.col("fp")), 6).alias("precision"), "pos", "neg",
    )


def auc(points: DataFrame) -> DataFrame:
    """Area under the ROC curve (trapezoids, so ties count half) and average precision."""
    facts = points.agg(
        F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / F.lit(2.0))).alias("area"), F.sum("pos").alias("p"),
        F.sum("neg").alias("n"), F.sum(F.col("precision") * F.col("pos")).alias("ap"),
    )
    return facts.select(
        half_up(ratio(F.col("area"), F.col("p").cast("double") * F.col("n")), 4).alias("roc_auc"),
        half_up(ratio(F.col("ap"), F.col("p")), 4).alias("average_precision"),
    )


def kfold(df: DataFrame, target: str, features: list[str], key: str, kind: str = "ols", folds: int = 5, seed: int = 42) -> DataFrame:
    """Test score of every fold of a hash split: R2 for regressors, accuracy for classifiers."""
    regression = kind in REGRESSORS
    wanted = finite(F.col(f"`{target}`")) if regression else F.col(f"`{target}`").cast("string")
    name = "_y" if regression else "_label"
    rows = prepared(df, wanted, features, key, name, 0, seed).withColumn("_part", bucket(KEY, folds, seed))
    out = None
    for i in range(folds):
        train, test = rows.where(F.col("_part") != i), rows.where(F.col("_part") == i).drop(FOLD)
        if regression:
            model = Pipeline(stages=[*feature_stages(rows, features), regressor(kind, seed)]).fit(spread(train))
            score = regression_metrics(model.transform(test), len(features)).select(F.col("r2").alias("score"))
        else:
            names = class_numbers(train)
            many = names.count()
            model = Pipeline(stages=[*feature_stages(rows, features, many), classifier(kind, seed, many)]).fit(spread(train).join(names, "_label"))
            done = model.transform(test).join(names, "_label")
            score = done.agg(half_up(F.avg((F.col("prediction") == F.col("_y")).cast("double")), 4).alias("score"))
        part = score.select(F.lit(i).cast("long").alias("fold"), "score")
        out = part if out is None else out.unionByName(part)
    return out


def kmeans(df: DataFrame, features: list[str], k: int = 3, seed: int = 42) -> dict:
    """K-means on standardised features: assignments, sizes, centres in original units, inertia and silhouette."""
    if k < 2:
        raise ValueError("k-means wants at least two clusters")
    rows = spread(_stored(typed(df, features), "cluster-rows"))
    model = Pipeline(stages=[*feature_stages(rows, features, 0), KMeans(k=k, maxIter=12, seed=seed, featuresCol="_x",
                                                                    predictionCol="cluster")]).fit(rows)
    assigned = model.transform(rows)
    total = rows.agg(F.count("*").alias("n")).scalar()
    sizes = assigned.groupBy("cluster").agg(F.count("*").alias("records")).select(
        F.col("cluster").cast("long").alias("cluster"), "records", percent(F.col("records"), total).alias("pct")
    )
    numbers = [f for f in features if is_number(df.schema[f].dataType)]
    centres = assigned.groupBy(F.col("cluster").cast("long").alias("cluster")).agg(
        *[half_up(F.avg(f"`{f}__im`"), 2).alias(f) for f in numbers]
    )
    silhouette = ClusteringEvaluator(featuresCol="_x", predictionCol="cluster").evaluate(assigned)
    inertia = model.stages[-1].summary.trainingCost
    facts = df.sparkSession.createDataFrame([(k, float(inertia), float(silhouette))], "k long, inertia double, silhouette double")
    return {"model": model, "assigned": assigned, "sizes": sizes, "centres": centres, "facts": facts}


def elbow(df: DataFrame, features: list[str], ks: range = range(2, 9), seed: int = 42) -> DataFrame:
    """Inertia and silhouette for every k."""
    parts = [kmeans(df, features, k, seed)["facts"] for k in ks]
    return reduce(lambda a, b: a.unionByName(b), parts)


def compare_models(df: DataFrame, target: str, features: list[str], key: str, task: str = "regression", kinds=None,
                   seed: int = 42) -> DataFrame:
    """All model kinds on the same split, ranked by their test score; the best is recommended."""
    kinds = kinds or (REGRESSORS if task == "regression" else CLASSIFIERS)
    wanted = finite(F.col(f"`{target}`")) if task == "regression" else F.col(f"`{target}`").cast("string")
    data = prepared(df, wanted, features, key, "_y" if task == "regression" else "_label", seed=seed)
    parts = []
    for kind in kinds:
        if task == "regression":
            metrics = train_regression(df, target, features, key, kind, seed=seed, parts=data).metrics
            parts.append(metrics.select(F.lit(kind).alias("model"), F.col("r2").alias("score"), F.col("rmse").alias("error"), "test_rows"))
        else:
            metrics = train_classification(df, target, features, key, kind, seed=seed, parts=data).metrics
            parts.append(metrics.select(F.lit(kind).alias("model"), F.col("accuracy").alias("score"),
                                        (1 - F.col("accuracy")).alias("error"), "test_rows"))
    rows = reduce(lambda a, b: a.unionByName(b), parts)
    best = rows.agg(F.min(F.struct(-F.col("score"), F.col("model"))).alias("b")).select("b.model").scalar()
    return rows.withColumn("is_recommended", F.col("model") == best)


def score_rows(model: PipelineModel, rows: DataFrame, features: list[str], keep: list[str]) -> DataFrame:
    """Predictions of a fitted pipeline for new rows."""
    kept = rows.withColumn(KEY, F.struct(*[F.col(f"`{k}`") for k in keep]))
    return model.transform(typed(kept, features)).select(f"{KEY}.*", "prediction")


def _moments(train: DataFrame, features: list[str]) -> Column:
    """Mean and population standard deviation of every feature as one scalar struct."""
    aggs = []
    for i, f in enumerate(features):
        aggs += [F.avg(finite(F.col(f"`{f}`"))).alias(f"m{i}"), F.stddev_pop(finite(F.col(f"`{f}`"))).alias(f"s{i}")]
    return one_row(train.agg(*aggs))


def _standard(features: list[str]) -> dict[str, Column]:
    """Standardised features from the struct column ``_m``; missing cells sit at the mean."""
    out = {}
    for i, f in enumerate(features):
        scale = F.when(F.col(f"_m.s{i}") > 0, F.col(f"_m.s{i}")).otherwise(1.0)
        out[f"_z{i}"] = F.coalesce((finite(F.col(f"`{f}`")) - F.col(f"_m.m{i}")) / scale, F.lit(0.0))
    return out


def linear_scorer(df: DataFrame, target: str, features: list[str], key: str, test_pct: int = 20, seed: int = 42) -> DataFrame:
    """Test predictions of the correlation-weighted linear scorer, fitted on the training part only.

    prediction = mean(y) + sd(y) * sum(w_j * z_j) / sum(|w_j|), w_j the correlation of feature j with the target.
    """
    parts = split(df, key, test_pct, seed).withColumn("_y", finite(F.col(f"`{target}`"))).where("_y is not null")
    train = parts.where(~F.col("is_test"))
    standard = lambda rows: rows.withColumn("_m", _moments(train, features)).withColumns(_standard(features))
    weights = [F.coalesce(F.nanvl(F.corr(f"_z{i}", "_y"), F.lit(0.0)), F.lit(0.0)).alias(f"w{i}") for i in range(len(features))]
    facts = standard(train).agg(*weights, F.avg("_y").alias("my"), F.stddev_pop("_y").alias("sy"))
    rows = standard(parts.where(F.col("is_test"))).withColumn("_w", one_row(facts))
    norm = reduce(lambda a, b: a + b, [F.abs(F.col(f"_w.w{i}")) for i in range(len(features))])
    pull = reduce(lambda a, b: a + b, [F.col(f"_w.w{i}") * F.col(f"_z{i}") for i in range(len(features))])
    norm = F.when(norm > 0, norm).otherwise(1.0)
    return rows.select(F.col(f"`{key}`"), "_y", (F.col("_w.my") + F.col("_w.sy") * pull / norm).alias("prediction"))


def centroids(train: DataFrame, label: str, count: int) -> DataFrame:
    """Mean of the standardised features ``_z0..`` per class."""
    return train.groupBy(F.col(f"`{label}`").cast("string").alias("class")).agg(
        F.array(*[F.avg(f"_z{i}") for i in range(count)]).alias("centre"), F.count("*").alias("records")
    )


def nearest_centroid(df: DataFrame, target: str, features: list[str], key: str, test_pct: int = 20, seed: int = 42) -> DataFrame:
    """Test predictions by the nearest class mean of standardised features; ties go to the first class name.

    The class means are a table of any length, searched in groups that the triangle inequality leaves (see ``nearest``).
    """
    rows = df.where(F.col(f"`{target}`").isNotNull()).select(*[F.col(f"`{c}`") for c in dict.fromkeys([key, target, *features])])
    parts = _stored(split(rows, key, test_pct, seed), "centroid-rows")
    train = parts.where(~F.col("is_test"))
    standard = lambda rows: rows.withColumn("_m", _moments(train, features)).withColumns(_standard(features))
    means = centroids(standard(train), target, len(features)).select("class", F.col("centre").alias("z"))
    means = _stored(means, "centroids")
    z = F.array(*[F.col(f"_z{i}") for i in range(len(features))])
    tested = standard(parts.where(F.col("is_test"))).select(F.col(f"`{key}`"), F.col(f"`{target}`").cast("string").alias("actual"), z.alias("z"))
    return nearest(tested, means).select(F.col(f"`{key}`"), "actual", F.col("class").alias("predicted"))


def centroid_importance(df: DataFrame, target: str, features: list[str]) -> DataFrame:
    """Spread of the class means per standardised feature."""
    rows = df.where(F.col(f"`{target}`").isNotNull())
    z = rows.withColumn("_m", _moments(rows, features)).withColumns(_standard(features))
    means = centroids(z, target, len(features)).agg(
        *[F.stddev_pop(F.col("centre")[i]).alias(f"f{i}") for i in range(len(features))]
    )
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), half_up(F.col(f"f{i}"), 3).alias("importance")) for i, f in enumerate(features)])
    return means.select(F.inline(pairs))


def readiness(p: Profile) -> DataFrame:
    """Check, status and points lost for size, breadth, completeness, leakage and class balance of a table."""
    facts = p.facts()
    leak = (F.col("type") == "id") | F.lower("column").rlike("id$|_id|^id|uuid|guid|ssn|token|hash")
    classes = F.col("type").isin("categorical", "boolean") & F.col("distinct").between(2, 10)
    counts = facts.agg(
        F.max("total").alias("rows"), F.count("*").alias("cols"), F.count_if(F.col("null_pct") > 30).alias("holes"),
        F.count_if(leak).alias("leaks"), F.coalesce(F.min_by("dominant_pct", F.when(classes, F.col("position"))), F.lit(0.0)).alias("dominant"),
    )
    c = F.col

    def check(name: str, status: Column, penalty: Column, evidence: Column) -> Column:
        return F.struct(F.lit(name).alias("check"), status.alias("status"), penalty.cast("long").alias("penalty"),
                        evidence.cast("double").alias("evidence"))

    def mild(test: Column, penalty: int, bad: str = "WARN") -> tuple[Column, Column]:
        return F.when(test, "PASS").otherwise(bad), F.when(test, 0).otherwise(penalty)

    size = F.when(c("rows") >= 100, "PASS").when(c("rows") >= 30, "WARN").otherwise("FAIL")
    rows = F.array(
        check("dataset_size", size, F.when(c("rows") >= 100, 0).when(c("rows") >= 30, 15).otherwise(40), c("rows")),
        check("feature_breadth", *mild(c("cols") >= 3, 30, "FAIL"), c("cols")),
        check("completeness", *mild(c("holes") == 0, 10), c("holes")),
        check("leakage", *mild(c("leaks") == 0, 0), c("leaks")),
        check("class_balance", *mild(c("dominant") < 80, 10), c("dominant")),
    )
    return counts.select(F.inline(rows))


def readiness_score(p: Profile) -> DataFrame:
    """Overall score and status."""
    lost = readiness(p).agg(F.sum("penalty").alias("l"))
    points = F.greatest(F.lit(20), F.least(F.lit(100), 100 - F.col("l"))).cast("long")
    return lost.select(
        points.alias("score"),
        F.when(points >= 75, "READY").when(points >= 50, "NEEDS_CLEANING").otherwise("INSUFFICIENT_DATA").alias("status"),
    )


def target_candidates(p: Profile) -> DataFrame:
    """Columns fit to be predicted: few classes for classification, many numbers for regression."""
    few = F.col("type").isin("categorical", "boolean") & F.col("distinct").between(2, 10)
    many = (F.col("type") == "numeric") & (F.col("distinct") > 10)
    return p.facts().where(few | many).select(
        "column", F.when(few, "classification").otherwise("regression").alias("task"), F.col("distinct").alias("classes")
    )
