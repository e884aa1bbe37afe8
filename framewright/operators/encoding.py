"""Model features from columns of any cardinality.

Numbers are imputed (median of the training part) and standardised. A column of categories gives two things, whatever its number of
categories: target means, smoothed towards the overall mean, and a signed hash of the category in ``HASHED`` sparse places. A training row
gets the target mean of the other folds only (out of fold, by a hash of the row key), so its own target never reaches its features; rows
that were not trained on get the mean of all training rows, unseen categories the overall mean. Category statistics stay a table that rows are
joined with; they are never collected.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler, VectorSizeHint
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F

from framewright.functions.text import is_number
from framewright.session import work_folder

HASHED, FOLDS, SMOOTH, CLASS_SLOTS = 32, 5, 10.0, 8
#: Column of a training row's fold; rows without it are scored with the statistics of all training rows.
FOLD = "_fold"


def category(name: str) -> Column:
    """The category of a row as text; a missing one is a category of its own."""
    return F.coalesce(F.concat(F.lit("="), F.col(f"`{name}`").cast("string")), F.lit(""))


class HashedCategory(Transformer):
    """A category as +1 or -1 in one of ``HASHED`` places, as a sparse vector ``<name>__hash``."""

    def __init__(self, name: str):
        super().__init__()
        self.name = name

    def _transform(self, df: DataFrame) -> DataFrame:
        h = F.xxhash64(F.lit(self.name), category(self.name))
        place, sign = F.pmod(h, F.lit(HASHED)), F.when(F.shiftright(h, 40).bitwiseAND(F.lit(1)) == 1, 1.0).otherwise(-1.0)
        values = F.transform(F.sequence(F.lit(0), F.lit(HASHED - 1)), lambda i: F.when(i == place, sign).otherwise(0.0))
        return df.withColumn(f"{self.name}__hash", array_to_vector(values))


class TargetMeans(Estimator):
    """Target means of a category: one column ``<name>__mean<s>`` per slot. ``slots`` is 1 for a numeric target (its mean, or the share of
    the second of two classes); with more classes a slot holds the share of the classes whose index falls on it."""

    def __init__(self, name: str, slots: int, target: str = "_y"):
        super().__init__()
        self.name, self.slots, self.target = name, slots, target

    def _fit(self, df: DataFrame) -> TargetMeansModel:
        y = F.col(self.target).cast("double")
        parts = [y] if self.slots == 1 else [(F.pmod(y.cast("long"), F.lit(self.slots)) == s).cast("double") for s in range(self.slots)]
        sums = [F.sum(p).alias(f"s{i}") for i, p in enumerate(parts)]
        by_fold = df.groupBy(category(self.name).alias("_cat"), F.col(FOLD).alias("fold")).agg(F.count("*").alias("n"), *sums)
        facts = F.struct("n", *[f"s{i}" for i in range(self.slots)])
        stats = by_fold.groupBy("_cat").agg(F.map_from_entries(F.collect_list(F.struct("fold", facts))).alias("_by"), *[
            F.sum(c).alias(f"_{c}") for c in ["n", *[f"s{i}" for i in range(self.slots)]]])
        path = work_folder(df.sparkSession, "target-means")
        stats.write.parquet(path)
        stats = df.sparkSession.read.schema(stats.schema).parquet(path)
        folds = by_fold.groupBy("fold").agg(F.sum("n").alias("n"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(self.slots)]).collect()
        return TargetMeansModel(self.name, self.slots, stats, {r["fold"]: (r["n"], *[r[f"s{i}"] for i in range(self.slots)]) for r in folds})


class TargetMeansModel(Model):
    """Joins the statistics of the training part; ``folds`` has row count and target sums of each fold."""

    def __init__(self, name: str, slots: int, stats: DataFrame, folds: dict):
        super().__init__()
        self.name, self.slots, self.stats, self.folds = name, slots, stats, folds

    def _transform(self, df: DataFrame) -> DataFrame:
        totals = [sum(f[i] for f in self.folds.values()) for i in range(self.slots + 1)]
        overall = [t / totals[0] if totals[0] else 0.0 for t in totals[1:]]
        joined = df.withColumn("_cat", category(self.name)).join(self.stats, "_cat", "left")
        trained = FOLD in df.columns
        own = F.col("_by")[F.col(FOLD)] if trained else None
        out = {}
        for s in range(self.slots):
            n, total, prior = F.col("_n"), F.col(f"_s{s}"), F.lit(overall[s])
            if trained:
                n = n - F.coalesce(own["n"], F.lit(0))
                total = total - F.coalesce(own[f"s{s}"], F.lit(0.0))
                rest = {k: (totals[s + 1] - f[s + 1]) / max(1, totals[0] - f[0]) for k, f in self.folds.items()}
                prior = F.element_at(F.create_map(*[F.lit(x) for kv in rest.items() for x in kv]), F.col(FOLD))
            mean = (total + SMOOTH * prior) / (n + SMOOTH)
            out[f"{self.name}__mean{s}"] = F.coalesce(mean, prior)
        return joined.withColumns(out).drop("_cat", "_by", "_n", *[f"_s{s}" for s in range(self.slots)])


def feature_stages(df: DataFrame, features: list[str], classes: int = 1) -> list:
    """Stages that turn features into the vector ``_x``; fitted on the training part, whose rows carry the target ``_y`` and ``_fold``.

    ``classes`` is 1 for a numeric target, the number of classes for a class index, and 0 without a target (no target means).
    """
    words = [f for f in features if not is_number(df.schema[f].dataType)]
    numbers = [f for f in features if f not in words]
    slots = 0 if classes == 0 else 1 if classes <= 2 else min(classes, CLASS_SLOTS)
    stages: list = []
    if numbers:
        stages.append(Imputer(inputCols=numbers, outputCols=[f"{n}__im" for n in numbers], strategy="median"))
    if slots:
        stages += [TargetMeans(w, slots) for w in words]
    for w in words:
        stages += [HashedCategory(w), VectorSizeHint(inputCol=f"{w}__hash", size=HASHED, handleInvalid="optimistic")]
    dense = [f"{n}__im" for n in numbers] + [f"{w}__mean{s}" for w in words for s in range(slots)]
    parts = [f"{w}__hash" for w in words]
    if dense:
        stages.append(VectorAssembler(inputCols=dense, outputCol="_raw", handleInvalid="keep"))
        stages.append(StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True, withStd=True))
        parts = ["_scaled", *parts]
    stages.append(VectorAssembler(inputCols=parts, outputCol="_x", handleInvalid="keep"))
    return stages


def layout(df: DataFrame, features: list[str], classes: int = 1) -> list[str]:
    """The feature behind each place of ``_x``."""
    words = [f for f in features if not is_number(df.schema[f].dataType)]
    slots = 0 if classes == 0 else 1 if classes <= 2 else min(classes, CLASS_SLOTS)
    dense = [f for f in features if f not in words] + [w for w in words for _ in range(slots)]
    return dense + [w for w in words for _ in range(HASHED)]


def summed(names: list[str], values) -> list[tuple[str, float]]:
    """Weights of a vector's places added up per feature."""
    out: dict[str, float] = reduce(lambda d, x: {**d, x: 0.0}, names, {})
    for n, v in zip(names, values):
        out[n] += float(v)
    return list(out.items())
