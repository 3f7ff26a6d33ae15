"""A ranking flow in stages that a rerun finds again: models, predictions out of fold and of test rows, blend, answers, scores.

Every stage is a store whose version follows from the stage's name, its parameters and the versions of what it reads.  A store counts once its manifest is
there, so a run that was lost in any stage goes on with that stage, and ends with the same tables; a changed input or parameter makes anew what depends on it
and nothing else.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import boosting as G
from ..operators import ranking as K
from ..operators import scaling as C
from ..sources import store as ST
from . import rank as RANK


@dataclass
class Stage:
    """A stage's rows and the version that stands for them."""

    rows: DataFrame
    version: str


class Ledger:
    """The stages of one flow in the shared folder; ``made`` lists those that this run had to make."""

    def __init__(self, spark: SparkSession, flow: str):
        self.spark, self.flow, self.made = spark, flow, []

    def given(self, rows: DataFrame | Stage) -> Stage:
        """A table that the flow reads, by its files or rows, or a stage made before."""
        return rows if isinstance(rows, Stage) else Stage(rows, ST.fingerprint(rows))

    def stage(self, name: str, reads: Sequence[Stage], make: Callable[..., DataFrame], params: str = "", order: Sequence[str] = ()) -> Stage:
        """make(rows of what it reads), written once for its name, parameters and inputs."""
        version = hashlib.sha256("\n".join([self.flow, name, params, *(r.version for r in reads)]).encode()).hexdigest()[:24]

        def build(s: ST.Store) -> None:
            s.put("rows", make(*[r.rows for r in reads]))
            self.made.append(name)

        return Stage(ST.store(self.spark, f"{self.flow}-{name}", version, build).get("rows"), version)


def trained_of(models: DataFrame) -> G.Trained:
    """Models from their rows (variant, fold, model): as many as variants and folds."""
    rows = models.collect()
    made = {(r["variant"], r["fold"]): G.Model.loads(r["model"]) for r in rows}
    return G.Trained(made, next(iter(made.values())).features if made else [])


@dataclass
class Flow:
    """Predictions out of fold, mean predictions of the test rows, answers of both, and MAP at 3 by fold."""

    predictions: DataFrame
    test: DataFrame | None
    answers: DataFrame
    scores: DataFrame


def run(ledger: Ledger, features: DataFrame | Stage, query: str, doc: str, variants: Sequence[G.Trees], gold: DataFrame | Stage, test: DataFrame | Stage | None = None, weights: Mapping[str, float] | None = None, only: Mapping[str, int] | None = None) -> Flow:
    """Train by folds, predict out of fold, merge the folds' predictions of test rows, blend log-odds, answer and score; each a stage.

    features: (query, doc, target, cv, features...); test rows have the same features and no target.  Features of a single fold (only) can't be read by a
    mean over folds, so with them test rows must hold the columns of every fold.
    """
    ids, spark = [query, doc], ledger.spark
    weights = dict(weights or {v.name: 1 / len(variants) for v in variants})
    rows, right = ledger.given(features), ledger.given(gold)

    def grow(df: DataFrame) -> DataFrame:
        made = G.train(df, variants, ids, only=only)
        told = [(name, fold, m.dumps()) for (name, fold), m in made.models.items()]
        return spark.createDataFrame(told, "variant string, fold int, model string")

    models = ledger.stage("models", [rows], grow, repr((list(variants), only)))

    def predicted(df: DataFrame, told: DataFrame, fold: str | None) -> DataFrame:
        trained, out = trained_of(told), None
        for v in variants:
            part = trained.predict(df, v.name, [*ids, *([fold] if fold else [])], fold).withColumn("variant", F.lit(v.name))
            out = part if out is None else out.unionByName(part)
        return out

    def blended(df: DataFrame, keep: list[str]) -> DataFrame:
        parts = {v.name: df.filter(F.col("variant") == v.name).select(*ids, "target") for v in variants}
        score = C.blend(parts, ids, "target", weights).select(*ids, F.col("score").alias("target"))
        return score.join(df.select(*ids, *keep).distinct(), ids) if keep else score

    oof = ledger.stage("out-of-fold", [rows, models], lambda df, m: predicted(df, m, "cv"))
    blend = ledger.stage("blend", [oof], lambda p: blended(p, ["cv"]), repr(sorted(weights.items())))
    final, tests = blend, None
    if test is not None:
        seen = ledger.stage("test", [ledger.given(test), models], lambda df, m: predicted(df, m, None))
        tests = ledger.stage("test-blend", [seen], lambda p: blended(p, []), repr(sorted(weights.items())))
        final = tests
    answers = ledger.stage("answers", [final], lambda p: K.top3_wide(p, query, doc, "target", ("paper_id_1", "paper_id_2", "paper_id_3")))
    scores = ledger.stage("scores", [blend, right], lambda p, g: RANK.fold_scores(p, query, doc, g))
    return Flow(blend.rows, tests.rows if tests else None, answers.rows, scores.rows)
