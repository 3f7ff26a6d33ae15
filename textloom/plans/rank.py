"""Learning to rank: features of candidates, folds, blended predictions, answers and their score."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import boosting as G
from ..operators import features as FE
from ..operators import learners as L
from ..operators import metrics as M
from ..operators import ranking as K
from ..operators import scaling as C


def pair_features(pairs: DataFrame, queries: DataFrame, docs: DataFrame, query: str, doc: str) -> DataFrame:
    """Counts, overlaps and places for pairs, from token columns ``<field>_unigram`` of queries and documents; the texts are joined once."""
    wide = pairs.join(queries, query).join(docs, doc)
    return FE.positions(FE.overlaps(FE.counts(wide))).drop(*[f"{f}_unigram" for f in (*FE.QUERY, *FE.PAPER)])


@dataclass
class Ranked:
    """Out-of-fold predictions, the three answers of every query and the mean reciprocal rank of the right one."""

    predictions: DataFrame
    answers: DataFrame
    score: DataFrame | None


def rank(features: DataFrame, query: str, doc: str, variant: L.Variant, gold: DataFrame | None = None) -> Ranked:
    """Train by folds on ``target`` and ``cv``, order every query's documents by their prediction out of fold."""
    ids = [query, doc]
    predictions = L.boosted(features, variant, ids).out_of_fold
    answers = K.top3_wide(predictions, query, doc, "target", ("paper_id_1", "paper_id_2", "paper_id_3"))
    return Ranked(predictions, answers, M.map_at(predictions, query, doc, "target", gold) if gold is not None else None)


def fold_scores(predictions: DataFrame, query: str, doc: str, gold: DataFrame, at: int = 3) -> DataFrame:
    """``cv, queries, map_at``: the score of each fold's queries, and of all as fold 0; a query whose right answer isn't among its candidates counts 0."""
    ranked = K.rank_in_group(predictions, [query], "target", doc)
    folds = predictions.groupBy(query).agg(F.min("cv").alias("cv"))
    hit = gold.select(query, doc).distinct().join(ranked.select(query, doc, "rank"), [query, doc], "left").groupBy(query).agg(F.min("rank").alias("rank")).join(folds, query)
    score = F.when(F.col("rank") < at, 1.0 / (F.col("rank") + 1)).otherwise(0.0)
    both = hit.select(F.explode(F.array("cv", F.lit(0))).alias("cv"), score.alias("s"))
    return both.groupBy("cv").agg(F.count("*").alias("queries"), F.round(F.avg("s"), 6).alias("map_at"))


def flow(features: DataFrame, query: str, doc: str, variants: Sequence[L.Variant], gold: DataFrame, weights: dict[str, float] | None = None) -> tuple[Ranked, DataFrame]:
    """The whole flow: every variant trained by folds, their log-odds blended, answers and scores by fold made of the blend."""
    ids = [query, doc]
    made = {v.name: L.boosted(features, v, ids).out_of_fold for v in variants}
    folds = features.select(*ids, "cv").distinct()
    blended = C.blend({n: p.select(*ids, "target") for n, p in made.items()}, ids, "target", weights or {n: 1 / len(made) for n in made})
    predictions = blended.select(*ids, F.col("score").alias("target")).join(folds, ids)
    answers = K.top3_wide(predictions, query, doc, "target", ("paper_id_1", "paper_id_2", "paper_id_3"))
    return Ranked(predictions, answers, M.map_at(predictions, query, doc, "target", gold)), fold_scores(predictions, query, doc, gold)


def grown(features: DataFrame, query: str, doc: str, variants: Sequence[G.Trees], gold: DataFrame, only: dict[str, int] | None = None) -> tuple[G.Trained, DataFrame]:
    """All variants and folds trained in step, and ``variant, cv, queries, map_at``: each one's score by fold, and over all folds as fold 0."""
    ids = [query, doc]
    made = G.train(features, variants, ids, only=only)
    scores = [fold_scores(made.predict(features, v.name, [*ids, "cv"], "cv"), query, doc, gold).withColumn("variant", F.lit(v.name)) for v in variants]
    return made, reduce(DataFrame.unionByName, scores).select("variant", "cv", "queries", "map_at")


def second_level(features: DataFrame, first: Ranked, query: str, doc: str, others: dict[str, DataFrame] | None = None) -> DataFrame:
    """Features with the listwise statistics of a first model's predictions and the predictions of further models."""
    out = features.join(K.listwise(first.predictions, query, doc, "target"), [query, doc], "left")
    return FE.stacked(out, others, [query, doc], "target") if others else out.withColumn("first_prob", F.col("top1_pred").cast("float"))
