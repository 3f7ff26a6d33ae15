"""Column scaling, fold averages and score blending."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import logit_clip, safe_divide, weighted_sum
from .relational import outer_by_key
from .selection import quantiles


def minmax_scale(df: DataFrame, cols: Sequence[str], above: float = 1.0) -> DataFrame:
    """Columns whose largest value exceeds ``above`` scaled to 0..1 over all rows; constant ones become 0."""
    row = df.agg(*[f(c).alias(f"__{n}_{c}") for c in cols for n, f in (("lo", F.min), ("hi", F.max))])
    out = df.crossJoin(F.broadcast(row))
    for c in cols:
        lo, hi = F.col(f"__lo_{c}"), F.col(f"__hi_{c}")
        out = out.withColumn(c, F.when(hi > above, F.when(F.col(c).isNotNull(), safe_divide(F.col(c) - lo, hi - lo))).otherwise(F.col(c).cast("double")))
    return out.drop(*[f"__{n}_{c}" for c in cols for n in ("lo", "hi")])


def quantile_scale(df: DataFrame, cols: Sequence[str], q: float = 0.99) -> DataFrame:
    """Columns divided by their exact quantile, with linear interpolation; 0 where that is 0.  The quantiles are found by four counting passes."""
    tops = quantiles(df, {c: [q] for c in cols})
    scaled = lambda c: F.lit(None).cast("double") if tops[c][0] is None else F.when(F.col(c).isNotNull(), safe_divide(c, F.lit(tops[c][0])))
    return df.withColumns({c: scaled(c) for c in cols})


def fold_mean(frames: Sequence[DataFrame], ids: Sequence[str], pred: str) -> DataFrame:
    """Mean prediction of the folds for each key."""
    union = reduce(DataFrame.unionByName, [f.select(*ids, pred) for f in frames])
    return union.groupBy(*ids).agg(F.avg(pred).alias(pred))


#: Fixed values, weights of a blend: the mean of eight scores, of two more, and of three stronger ones.
BLEND = {**{f"score_{i}": 1 / 8 for i in range(8)}, "score_8": 0.5, "score_9": 0.5, "score_b1": 2.0, "score_b2": 3.0 + 0.25, "score_b3": 0.75}


def blend(sources: Mapping[str, DataFrame], ids: Sequence[str], prob: str, weights: Mapping[str, float] = BLEND) -> DataFrame:
    """``ids, <source>..., score``: clipped log-odds of every source, 0 where it lacks the pair, and their weighted sum."""
    odds = {name: df.select(*ids, logit_clip(prob).alias("odds")) for name, df in sources.items()}
    return outer_by_key(odds, ids, "odds").withColumn("score", weighted_sum({k: w for k, w in weights.items() if k in sources}))
