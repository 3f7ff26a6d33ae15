"""Ranks, top-k lists and group features of scored candidates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_first(by: Sequence[str], score: str, tie: str):
    """Window of a group from the highest score on; nulls last, ties by the smaller identifier."""
    return Window.partitionBy(*by).orderBy(F.desc_nulls_last(score), F.col(tie).asc())


def rank_in_group(df: DataFrame, by: Sequence[str], score: str, tie: str, name: str = "rank") -> DataFrame:
    """Adds the rank from 0."""
    return df.withColumn(name, F.row_number().over(best_first(by, score, tie)) - 1)


def topk(df: DataFrame, by: Sequence[str], score: str, tie: str, k: int) -> DataFrame:
    return rank_in_group(df, by, score, tie, "__r").filter(F.col("__r") < k).drop("__r")


def topk_concat(df: DataFrame, query: str, item: str, score: str, k: int = 3, name: str = "items") -> DataFrame:
    """``query, items``: the k best items of each query in order, joined by commas."""
    best = rank_in_group(df, [query], score, item, "__r").filter(F.col("__r") < k)
    listed = F.array_sort(F.collect_list(F.struct(F.col("__r").alias("r"), F.col(item).cast("string").alias("i"))))
    return best.groupBy(query).agg(F.array_join(F.transform(listed, lambda x: x["i"]), ",").alias(name))


def top3_wide(df: DataFrame, query: str, item: str, score: str, names: Sequence[str] = ("item_1", "item_2", "item_3")) -> DataFrame:
    """A column for each of the best items; null where a query has fewer."""
    best = rank_in_group(df, [query], score, item, "__r").filter(F.col("__r") < len(names))
    return best.groupBy(query).agg(*[F.max(F.when(F.col("__r") == i, F.col(item))).alias(n) for i, n in enumerate(names)])


def group_indices(df: DataFrame, by: str, value: str, name: str) -> DataFrame:
    """Sorted values of each group."""
    return df.groupBy(by).agg(F.array_sort(F.collect_list(value)).alias(name))


def _topk_stats(by: Sequence[str], rank: Column, pred: Column, ks: Sequence[int]) -> list[Column]:
    w = Window.partitionBy(*by)
    out = [F.max(F.when(rank == 0, pred)).over(w).alias("top1_pred")]
    for k in ks:
        inside = F.when(rank < k, pred)
        out += [F.avg(inside).over(w).alias(f"top{k}_pred_avg"), F.stddev_samp(inside).over(w).alias(f"top{k}_pred_std")]
    return out


def listwise(df: DataFrame, query: str, item: str, pred: str, ks: Sequence[int] = (2, 3, 5), mode: str = "pair") -> DataFrame:
    """Statistics of a query's best predictions, and each prediction's difference to them.

    mode ``pair``: differences of every pair.  ``query``: those of the query's lowest prediction (ties by the smaller item) for all its pairs.  The
    sample deviation of a single prediction is null.
    """
    ranked = rank_in_group(df.select(query, item, F.col(pred).alias("pred")), [query], "pred", item, "__r")
    out = ranked.select("*", *_topk_stats([query], F.col("__r"), F.col("pred"), ks))
    subs = {"pred_sub_top1": F.col("pred") - F.col("top1_pred"), **{f"pred_sub_top{k}_avg": F.col("pred") - F.col(f"top{k}_pred_avg") for k in ks}}
    out = out.withColumns(subs)
    if mode == "query":
        low = Window.partitionBy(query).orderBy(F.col("pred").asc_nulls_last(), F.col(item).asc())
        out = out.withColumns({c: F.first(c).over(low) for c in subs})
    elif mode != "pair":
        raise ValueError(f"unknown mode: {mode}")
    return out.drop("__r", "pred")


def pairwise_samples(pairs: DataFrame, query: str, item: str, label: str, positives: int = 6, negatives: int = 10, seed: int = 7) -> DataFrame:
    """``query, positive, negative, draw``: each positive up to ``positives`` times, each time with up to ``negatives`` negatives of its query at random."""
    draws = F.explode(F.sequence(F.lit(1), F.lit(positives))).alias("draw")
    # For each draw the query's negatives stand in an order by chance, and a positive takes so many in a row from a place by chance on: rows follow the
    # result's size, never positives times negatives.
    neg = pairs.filter(F.col(label) == 0).select(query, F.col(item).alias("negative"), draws)
    order = Window.partitionBy(query, "draw").orderBy(F.xxhash64(F.lit(seed), query, "draw", "negative"), "negative")
    neg = neg.withColumn("__at", F.row_number().over(order) - 1)
    sizes = neg.filter("draw = 1").groupBy(query).agg(F.count("*").alias("__m"))
    pos = pairs.filter(F.col(label) == 1).select(query, F.col(item).alias("positive"), draws).join(sizes, query)
    start = F.pmod(F.xxhash64(F.lit(seed), query, "positive", "draw"), F.col("__m"))
    places = F.sequence(F.lit(0), F.least(F.lit(negatives), F.col("__m")).cast("int") - 1)
    pos = pos.withColumn("__from", start).withColumn("__k", F.explode(places)).withColumn("__at", F.pmod(F.col("__from") + F.col("__k"), F.col("__m")).cast("int"))
    return pos.join(neg, [query, "draw", "__at"]).select(query, "positive", "draw", "negative")
