"""K-fold training, prediction and stacking with gradient-boosted trees and perceptrons."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml import Estimator, Model
from pyspark.ml.classification import GBTClassifier, MultilayerPerceptronClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import boosting as G
from .metrics import fold_metrics
from .scaling import fold_mean


#: Share of rows that are held back from a fold's training to say when to stop; a round must lower their error by this much of it.
HELD_BACK, GAIN = 0.1, 0.001
#: Tasks for each core that pass over the rows.  Training makes some two hundred passes, and each task of each sends a result to the driver, so their number must
#: not follow the partitions of the joins before.
TASKS = 2


@dataclass
class Variant:
    """One configuration of the boosted learner: which features and rows it leaves out, and its trees.

    Training ends when rows held back no longer gain, and the model keeps the rounds that were best for them.  ``rows`` is a condition on training rows.
    """

    name: str
    drop: Sequence[str] = ()
    keep: Sequence[str] = ()
    always: Sequence[str] = ()
    rows: str | None = None
    rounds: int = 20
    rate: float = 0.1
    depth: int = 5
    share: float = 0.7

    def features(self, df: DataFrame, ids: Sequence[str], label: str, fold: str) -> list[str]:
        from .relational import numeric_columns

        ok = lambda c: c in self.always or (not self.keep or any(k in c for k in self.keep)) and not any(d in c for d in self.drop)
        return [c for c in numeric_columns(df) if c not in (*ids, label, fold) and ok(c)]

    def trees(self, df: DataFrame, ids: Sequence[str], label: str = "target", fold: str = "cv", more: Sequence[str] = (), **how) -> G.Trees:
        """The variant as boosted trees of this library; more: features besides its own."""
        return G.Trees(self.name, [*self.features(df, ids, label, fold), *more], rows=self.rows, rate=self.rate, feature_share=self.share, row_share=self.share, **how)

    def estimator(self, label: str) -> Estimator:
        return GBTClassifier(labelCol=label, featuresCol="__x", maxIter=self.rounds, stepSize=self.rate, maxDepth=self.depth, subsamplingRate=self.share, featureSubsetStrategy=str(self.share), validationIndicatorCol="__held", validationTol=GAIN, seed=7)


#: Names of columns and conditions of the five boosted variants, and what the second learner leaves out.
FILTERED = "journal IS DISTINCT FROM 'no-content' AND year IS NOT NULL"
VARIANTS = {
    "32-50-0": Variant("32-50-0", drop=("year",), rate=0.03),
    "37-0": Variant("37-0", drop=("year",), rate=0.03),
    "38-0": Variant("38-0", drop=("year",), rate=0.03),
    "38-1": Variant("38-1", drop=("year",), always=("year",), rows=FILTERED, rate=0.03),
    "40-0": Variant("40-0", drop=("year",), rows=FILTERED, rate=0.03),
    "second": Variant("second", drop=("year", "pos_of_corp", "pos_of_abst", "pos_of_titl"), rate=0.1, depth=6),
}


@dataclass
class Folded:
    """Models by fold, predictions out of fold, mean predictions of the test rows and importances by feature."""

    models: dict[int, Model]
    out_of_fold: DataFrame
    test: DataFrame | None
    features: list[str]
    importances: list[float] = field(default_factory=list)

    def metrics(self) -> DataFrame:
        return fold_metrics(self.out_of_fold, "cv", "label", "target")

    def importance(self, spark: SparkSession) -> DataFrame:
        """``feature, share``, percent of the total."""
        from .metrics import share_of_total

        rows = spark.createDataFrame(list(zip(self.features, map(float, self.importances), strict=True)), "feature string, gain double")
        return share_of_total(rows, "feature", "gain").orderBy(F.desc("percent"), "feature")


def k_fold(df: DataFrame, ids: Sequence[str], label: str, fold: str, features: Sequence[str], estimator: Callable[[], Estimator], test: DataFrame | None = None, path: str | None = None, rows: str | None = None) -> Folded:
    """Train on all folds but one, predict that one, for every fold in turn; test rows get the mean over the folds' models.

    With a path, models are saved under ``<path>/fold_<n>`` and, where one is there already, loaded instead of trained.
    rows: a condition that training rows meet, also held-back ones; predictions are made for all.  A tenth of the training rows, by a hash of their
    identifiers, is marked ``__held`` for learners that stop early.
    """
    assemble = VectorAssembler(inputCols=list(features), outputCol="__x", handleInvalid="keep")
    marks = [(F.expr(rows) if rows else F.lit(True)).alias("__fit"), (F.pmod(F.xxhash64(*ids), F.lit(round(1 / HELD_BACK))) == 0).alias("__held")]
    marked, tasks = df.select("*", *marks), TASKS * df.sparkSession.sparkContext.defaultParallelism
    wide = assemble.transform(marked.na.fill(0.0, list(features))).select(*ids, fold, F.col(label).cast("double").alias(label), "__x", F.coalesce("__fit", F.lit(False)).alias("__fit"), "__held").coalesce(tasks).cache()
    wide_test = assemble.transform(test.na.fill(0.0, list(features))).select(*ids, "__x").coalesce(tasks).cache() if test is not None else None
    models, oof, tests, gains = {}, [], [], None
    held = {r[0]: r[1] for r in wide.groupBy(fold).agg(F.count_if(F.col("__fit") & F.col("__held"))).collect()}  # a handful of folds
    for n in sorted(held):
        model = _load(wide.sparkSession, f"{path}/fold_{n}") if path else None
        if model is None:
            made = estimator()
            if sum(held.values()) == held[n] and made.hasParam("validationIndicatorCol") and made.isSet("validationIndicatorCol"):
                made.clear(made.validationIndicatorCol)  # no row is held back
            model = made.fit(wide.filter((F.col(fold) != n) & F.col("__fit")))
            if path:
                model.write().overwrite().save(f"{path}/fold_{n}")
        predicted = lambda rows, m=model: m.transform(rows).withColumn("__p", vector_to_array("probability")[1])
        models[n] = model
        oof.append(predicted(wide.filter(F.col(fold) == n)).select(*ids, F.col(fold).alias("cv"), F.col(label).alias("label"), F.col("__p").alias("target")))
        if wide_test is not None:
            tests.append(predicted(wide_test).select(*ids, F.col("__p").alias("target")))
        if hasattr(model, "featureImportances"):
            g = model.featureImportances.toArray()
            gains = g if gains is None else gains + g
    return Folded(models, reduce(DataFrame.unionByName, oof), fold_mean(tests, ids, "target") if tests else None, list(features), [] if gains is None else (gains / len(models)).tolist())


def _load(spark: SparkSession, path: str) -> Model | None:
    from pyspark.ml.util import DefaultParamsReader

    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return None
    return DefaultParamsReader.loadParamsInstance(path, spark)


def boosted(df: DataFrame, variant: Variant, ids: Sequence[str], label: str = "target", fold: str = "cv", test: DataFrame | None = None, path: str | None = None) -> Folded:
    return k_fold(df, ids, label, fold, variant.features(df, ids, label, fold), lambda: variant.estimator(label), test, path, variant.rows)


def perceptron(df: DataFrame, features: Sequence[str], ids: Sequence[str], label: str = "target", fold: str = "cv", hidden: Sequence[int] = (32, 16), rounds: int = 60, test: DataFrame | None = None) -> Folded:
    layers = [len(features), *hidden, 2]
    return k_fold(df, ids, label, fold, features, lambda: MultilayerPerceptronClassifier(labelCol=label, featuresCol="__x", layers=layers, maxIter=rounds, seed=7), test)


def pair_vectors(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adds ``pair``: a, b, |a - b| and a * b of two pooled embeddings, the input of a siamese model's last layers."""
    diff = F.zip_with(a, b, lambda x, y: F.abs(x - y))
    return df.withColumn("pair", F.concat(a, b, diff, F.zip_with(a, b, lambda x, y: x * y)))
