"""Ranking and classification metrics as single aggregations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .selection import edges


#: Cells into which values are dealt, so that no task orders a whole column.
CELLS = 128


def running_before(counted: DataFrame, value: str, n: str, by: Sequence[str] = (), name: str = "before") -> DataFrame:
    """Adds the sum of n over the rows with smaller values, within groups; values are distinct.

    Cells of about equal numbers of values, however these lie, are summed first; then each cell is ordered by itself.
    """
    v = F.col(value).cast("double")
    cuts = edges(counted.select(v.alias("v")), ["v"], CELLS)["v"]
    out = counted.withColumn("__cell", F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda c: c <= v)) if cuts else F.lit(0))
    cells = out.groupBy(*by, "__cell").agg(F.sum(n).alias("__all"))
    cells = cells.withColumn("__start", F.sum("__all").over(Window.partitionBy(*by).orderBy("__cell")) - F.col("__all")).drop("__all")
    inside = Window.partitionBy(*by, "__cell").orderBy(value)
    out = out.join(cells if by else F.broadcast(cells), [*by, "__cell"])
    return out.withColumn(name, F.col("__start") + F.sum(n).over(inside) - F.col(n)).drop("__cell", "__start")


def auc(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Area under the curve by the rank sum, ties counting half; null without both labels.

    Scores are counted per value first, so equal scores meet in one row and the ranks run over distinct scores.
    """
    counted = df.filter(F.col(label).isNotNull() & F.col(score).isNotNull()).groupBy(*by, score).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.count("*").alias("n"))
    ranked = running_before(counted, score, "n", by).withColumn("rank", F.col("before") + (F.col("n") + 1) / 2.0)
    pos, neg = F.sum("pos"), F.sum(F.col("n") - F.col("pos"))
    return ranked.groupBy(*by).agg(F.round(F.try_divide(F.sum(F.col("rank") * F.col("pos")) - pos * (pos + 1) / 2.0, (pos * neg).cast("double")), 5).alias("auc"))


def log_loss(df: DataFrame, label: str, prob: str, by: Sequence[str] = (), eps: float = 1e-15) -> DataFrame:
    p = F.least(F.greatest(F.col(prob), F.lit(eps)), F.lit(1 - eps))
    return df.groupBy(*by).agg(F.round(F.avg(-F.when(F.col(label) == 1, F.ln(p)).otherwise(F.ln(1 - p))), 5).alias("logloss"))


def mae(df: DataFrame, label: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.round(F.avg(F.abs(F.col(label) - F.col(pred))), 5).alias("mae"))


def rmse(df: DataFrame, label: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.round(F.sqrt(F.avg(F.pow(F.col(label) - F.col(pred), 2))), 5).alias("rmse"))


def fold_metrics(df: DataFrame, fold: str, label: str, prob: str) -> DataFrame:
    """Log-loss, mean absolute and root mean squared error and AUC of each fold."""
    out = log_loss(df, label, prob, [fold]).join(mae(df, label, prob, [fold]), fold).join(rmse(df, label, prob, [fold]), fold)
    return out.join(auc(df, label, prob, [fold]), fold)


def hit_ranks(ranked: DataFrame, query: str, item: str, score: str, gold: DataFrame) -> DataFrame:
    """``query, rank``: for every query of gold (query, item) the rank from 1 of its item among the candidates, null if it isn't among them."""
    from .ranking import rank_in_group

    found = rank_in_group(ranked, [query], score, item, "rank").join(gold.select(query, item), [query, item]).groupBy(query).agg((F.min("rank") + 1).alias("rank"))
    return gold.select(query).distinct().join(found, query, "left")


def map_at(ranked: DataFrame, query: str, item: str, score: str, gold: DataFrame, k: int = 3) -> DataFrame:
    """Mean over gold's queries of 1 / rank of the right item, 0 beyond k."""
    hits = hit_ranks(ranked, query, item, score, gold)
    return hits.agg(F.round(F.avg(F.when(F.col("rank") <= k, 1 / F.col("rank")).otherwise(0.0)), 6).alias(f"map_at_{k}"))


def recall_and_map(ranked: DataFrame, query: str, item: str, score: str, gold: DataFrame, k: int = 3) -> DataFrame:
    """Share of queries whose item is among the candidates; mean reciprocal rank up to k over these, and over all."""
    hits = hit_ranks(ranked, query, item, score, gold)
    gain = F.when(F.col("rank") <= k, 1 / F.col("rank")).otherwise(0.0)
    return hits.agg(
        F.round(F.avg(F.col("rank").isNotNull().cast("double")), 6).alias("recall"),
        F.round(F.avg(F.when(F.col("rank").isNotNull(), gain)), 6).alias("map_in_recall"),
        F.round(F.avg(gain), 6).alias("map_in_all"),
    )


def class_ratio(df: DataFrame, label: str) -> DataFrame:
    """Positives over negatives; null without negatives."""
    pos, neg = F.sum((F.col(label) == 1).cast("double")), F.sum((F.col(label) == 0).cast("double"))
    return df.agg(F.round(F.try_divide(pos, neg), 6).alias("class_ratio"))


def _corr(a: str, b: str) -> Column:
    """Pearson's coefficient over rows with both values, from sums around the means; null for constant columns."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    x, y = F.when(both, F.col(a).cast("double")), F.when(both, F.col(b).cast("double"))
    return F.try_divide(F.covar_samp(x, y), F.nullif(F.stddev_samp(x) * F.stddev_samp(y), F.lit(0.0)))


def spearman(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``a, b, rho`` for all pairs of columns.  Ranks over a whole column need its order: values are counted per distinct value first."""
    out = df.select(*cols).na.drop()
    for c in cols:
        counted = out.groupBy(c).agg(F.count("*").alias("n"))
        ranks = running_before(counted, c, "n").select(F.col(c).alias("__v"), (F.col("before") + (F.col("n") + 1) / 2.0).alias(f"__rank_{c}"))
        out = out.join(ranks, out[c] == ranks["__v"]).drop("__v")
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    row = out.agg(*[F.round(_corr(f"__rank_{a}", f"__rank_{b}"), 6).alias(f"{a}|{b}") for a, b in pairs])
    return row.select(F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("rho")) for a, b in pairs])))


def group_correlation(df: DataFrame, group: str, cols: Sequence[str]) -> DataFrame:
    """``a, b, mean_corr``: Pearson's coefficient of each pair of columns within each group, 0 where it has none, averaged over groups."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    each = df.groupBy(group).agg(*[F.coalesce(_corr(a, b), F.lit(0.0)).alias(f"{a}|{b}") for a, b in pairs])
    row = each.agg(*[F.round(F.avg(f"`{a}|{b}`"), 6).alias(f"{a}|{b}") for a, b in pairs])
    return row.select(F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("mean_corr")) for a, b in pairs])))


def share_of_total(df: DataFrame, name: str, value: str) -> DataFrame:
    """``name, share``: percent of the whole with two places, largest first."""
    total = df.agg(F.sum(value).alias("__t"))
    share = F.round(F.try_divide(F.col(value) * 100, F.col("__t")), 2)
    return df.crossJoin(F.broadcast(total)).select(name, F.concat(F.format_string("%.2f", share), F.lit("%")).alias("share"), share.alias("percent"))


def column_summary(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """A row per column: count, mean, sample deviation, minimum, maximum and sum, in one pass."""
    stats = {"n": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max, "total": F.sum}
    row = df.agg(*[f(F.col(c).cast("double")).alias(f"{c}|{n}") for c in cols for n, f in stats.items()])
    one = lambda c, n: F.col(f"`{c}|{n}`") if n == "n" else F.round(F.col(f"`{c}|{n}`"), 4)
    return row.select(F.inline(F.array(*[F.struct(F.lit(c).alias("name"), *[one(c, n).alias(n) for n in stats]) for c in cols])))
