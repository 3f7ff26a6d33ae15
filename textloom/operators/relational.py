"""Joins, unions, deduplication and column selection with defined null and tie rules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType


def rename_positional(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Columns renamed by place; the number must agree."""
    return df.toDF(*names)


def numeric_columns(df: DataFrame, ids: Sequence[str] = ()) -> list[str]:
    return [*ids, *(f.name for f in df.schema if f.name not in ids and isinstance(f.dataType, NumericType))]


def numeric_projection(df: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Identifiers and all numeric columns."""
    return df.select(*numeric_columns(df, ids))


def columns_like(df: DataFrame, keep: Sequence[str] = (), drop: Sequence[str] = (), always: Sequence[str] = ()) -> DataFrame:
    """Columns whose name holds one of keep (any, if empty) and none of drop, and those of always."""
    ok = lambda c: c in always or ((not keep or any(k in c for k in keep)) and not any(d in c for d in drop))
    return df.select(*[c for c in df.columns if ok(c)])


def differs(col: str, value) -> Column:
    """Not equal, keeping nulls."""
    return ~F.col(col).eqNullSafe(F.lit(value))


def natural_join(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
    """Join on all columns that both have."""
    shared = [c for c in a.columns if c in b.columns]
    if not shared:
        raise ValueError("no shared columns")
    return a.join(b, shared, how)


def one_to_one(frames: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Columns of several tables side by side, joined on their keys; clashing names are kept from the first table."""
    out = frames[0]
    for f in frames[1:]:
        out = out.join(f.select(*keys, *[c for c in f.columns if c not in out.columns]), list(keys), "left")
    return out


def outer_by_key(sources: Mapping[str, DataFrame], keys: Sequence[str], value: str, fill: float = 0.0) -> DataFrame:
    """A full outer join of many tables with unique keys as one union and one aggregation: a column per source, missing values filled.

    Of repeated keys within a source the largest value counts.
    """
    tagged = [df.select(*keys, F.col(value).cast("double").alias("value"), F.lit(name).alias("tag")) for name, df in sources.items()]
    union = reduce(DataFrame.unionByName, tagged)
    cols = [F.coalesce(F.max(F.when(F.col("tag") == name, F.col("value"))), F.lit(fill)).alias(name) for name in sources]
    return union.groupBy(*keys).agg(*cols)


def first_of(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each key in a total order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def rows_of(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame | None]:
    """Rows whose key no other row has, and those that share one, nulls too; None if there are none.  Counts the keys, reads nothing else."""
    again = df.groupBy(key).agg(F.count("*").alias("__m")).filter("__m > 1").select(F.col(key).alias("__k"))
    if again.isEmpty():
        return df, None
    same = F.col(key).eqNullSafe(F.col("__k"))
    return df.join(again, same, "left_anti"), df.join(again, same, "left_semi")


def union_missing(*frames: DataFrame) -> DataFrame:
    """Union by name with nulls for columns that a table lacks, columns in order of their names."""
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return out.select(*sorted(out.columns))


def explode_parallel(df: DataFrame, *cols: str, sep: str = r"\|") -> DataFrame:
    """Rows for the parts of separated texts, taken in step; rows whose texts are null vanish, as do parts beyond the first column's."""
    empty = F.array().cast("array<string>")
    parts = [F.coalesce(F.split(F.col(c), sep), empty).alias(c) for c in cols]
    zipped = df.withColumn("__z", F.slice(F.arrays_zip(*parts), F.lit(1), F.greatest(F.size(parts[0]), F.lit(0)))).drop(*cols)
    rest = [c for c in zipped.columns if c != "__z"]
    return zipped.select(*rest, F.inline("__z"))


def fuse_recalls(recalls: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Union of candidate lists; of a pair found more than once the first list's row stays (then the highest score)."""
    ranked = [df.withColumn("__p", F.lit(i)) for i, df in enumerate(recalls)]
    return first_of(reduce(DataFrame.unionByName, ranked), keys, F.col("__p"), F.desc("sim_score")).drop("__p")


def label_target(pairs: DataFrame, gold: DataFrame, query: str, item: str) -> DataFrame:
    """Adds target: 1 where the pair is in gold (query, item), else 0."""
    hit = gold.select(F.col(query).alias("__q"), F.col(item).alias("__i")).distinct()
    out = pairs.join(hit, (F.col(query) == F.col("__q")) & (F.col(item) == F.col("__i")), "left")
    return out.withColumn("target", F.col("__q").isNotNull().cast("int")).drop("__q", "__i")


def fold_of(key: Column, folds: int = 5) -> Column:
    """Fold 1 to folds of an integer key."""
    return (F.pmod(key, F.lit(folds)) + 1).cast("int")


def narrowest_types(df: DataFrame, cols: Sequence[str] | None = None) -> dict[str, str]:
    """The narrowest integer type for each whole-number column, from one pass over minima and maxima; float for doubles that fit."""
    cols = list(cols or numeric_columns(df))
    row = df.agg(*[f(c).alias(f"{c}__{n}") for c in cols for n, f in (("lo", F.min), ("hi", F.max))]).first()
    kinds = dict(df.dtypes)
    out = {}
    for c in cols:
        lo, hi = row[f"{c}__lo"], row[f"{c}__hi"]
        if kinds[c] in ("tinyint", "smallint", "int", "bigint"):
            fit = [t for t, n in (("tinyint", 7), ("smallint", 15), ("int", 31), ("bigint", 63)) if lo is None or -(1 << n) <= lo <= hi < 1 << n]
            out[c] = fit[0]
        else:
            out[c] = "float" if lo is None or max(abs(lo), abs(hi)) < 3.4e38 else kinds[c]
    return out


def downcast(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    return df.withColumns({c: F.col(c).cast(t) for c, t in narrowest_types(df, cols).items()})


def random_order(df: DataFrame, seed: int = 7, partitions: int | None = None) -> DataFrame:
    """Rows dealt out at random and shuffled within their partition."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.withColumn("__r", F.rand(seed)).repartition(n, "__r").sortWithinPartitions("__r").drop("__r")


def row_label(df: DataFrame, col: str, mark: str, name: str = "label") -> DataFrame:
    """Adds the value of a column with a mark behind it, such as one for the part that a row belongs to; null stays null."""
    return df.withColumn(name, F.concat(F.col(col).cast("string"), F.lit(mark)))


def tagged_union(parts: Mapping[str, DataFrame], tag: str = "part") -> DataFrame:
    """All rows by name, nulls for columns that a part lacks, with the part's name, so that part_of() can tell them apart again."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn(tag, F.lit(name)) for name, df in parts.items()])


def part_of(df: DataFrame, name: str, tag: str = "part") -> DataFrame:
    """The rows that came from one part."""
    return df.filter(F.col(tag) == name).drop(tag)


def split_ids(col: str | Column, sep: str = ",") -> Column:
    """Identifiers of a separated text as an array; an empty text has none, null stays null."""
    text = F.col(col) if isinstance(col, str) else col
    return F.filter(F.split(text, sep), lambda x: x != "")


def as_list(col: str | Column) -> Column:
    """A single value as an array of one; null gives an empty array."""
    return F.array_compact(F.array(F.col(col) if isinstance(col, str) else col))
