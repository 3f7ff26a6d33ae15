"""Exact order statistics of many columns at once by radix selection: no task holds or orders a column.

A double's bits, with the sign turned, order as the numbers do.  Each of four passes counts the values under every prefix that a wanted rank still lies in by
their next 16 bits, adds the counts up before they travel, and finds the next 16 bits of each rank; after the last one the value is known.  A pass counts at
most 65,536 cells for each rank that is asked, whatever the data, and equal values share one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bits of a level.
LEVEL = 16
_SIGN = np.uint64(1 << 63)


def keys_of(x: np.ndarray) -> np.ndarray:
    """Unsigned numbers in the order of the doubles; both zeros are one, and all that are no number are the largest."""
    bits = np.where(np.isnan(x), np.nan, x + 0.0).astype(np.float64).view(np.uint64)
    return np.where(bits & _SIGN, ~bits, bits | _SIGN)


def values_of(keys: np.ndarray) -> np.ndarray:
    keys = np.asarray(keys, np.uint64)
    return np.where(keys & _SIGN, keys ^ _SIGN, ~keys).view(np.float64)


def _counts(batches: Iterator[pa.RecordBatch], level: int, wanted: list[list[int]]) -> Iterator[pa.RecordBatch]:
    """Columns to (col, prefix, cell, n) of the prefixes that are wanted of each."""
    shift = np.uint64(64 - LEVEL * (level + 1))
    for b in batches:
        out = [[], [], [], []]
        for i, prefixes in enumerate(wanted):
            keys = keys_of(b.column(i).drop_null().to_numpy(zero_copy_only=False))
            head = keys >> shift
            before = head >> np.uint64(LEVEL)
            if level:
                head = head[np.isin(before, np.array(prefixes, np.uint64))]
            cells, n = np.unique(head, return_counts=True)
            for part, v in zip(out, (np.full(len(n), i), (cells >> np.uint64(LEVEL)).view(np.int64), (cells & np.uint64((1 << LEVEL) - 1)).astype(np.int64), n), strict=True):
                part.append(v)
        cols = [np.concatenate(part) if part else np.zeros(0, np.int64) for part in out]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], ["col", "prefix", "cell", "n"])


def ranked(df: DataFrame, ranks: Mapping[str, Sequence[int]]) -> dict[str, dict[int, float]]:
    """The values of the given ranks, from 0, among each column's values that aren't null; NaN comes last."""
    cols, spark = list(ranks), df.sparkSession
    told = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    # What is asked bounds what the driver holds: column, rank, bits so far, rank among those that share them.
    state = [(i, r, 0, r) for i, c in enumerate(cols) for r in sorted(set(ranks[c]))]
    for level in range(64 // LEVEL):
        prefixes = [sorted({np.uint64(s[2]).item() for s in state if s[0] == i}) for i in range(len(cols))]
        counted = told.mapInArrow(lambda it, level=level, p=prefixes: _counts(it, level, p), "col long, prefix long, cell long, n long")
        counted = counted.groupBy("col", "prefix", "cell").agg(F.sum("n").alias("n"))
        upto = counted.withColumn("upto", F.sum("n").over(Window.partitionBy("col", "prefix").orderBy("cell")))
        signed = lambda p: p - (1 << 64) if p >> 63 else p
        asked = spark.createDataFrame([(i, r, signed(p), rest) for i, r, p, rest in state], "col long, rank long, prefix long, rest long")
        met = upto.join(F.broadcast(asked), ["col", "prefix"]).filter((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("n") <= F.col("rest")))
        found = met.select("col", "rank", "prefix", "cell", (F.col("rest") - F.col("upto") + F.col("n")).alias("rest")).collect()
        state = [(r["col"], r["rank"], ((r["prefix"] << LEVEL) | r["cell"]) & ((1 << 64) - 1), r["rest"]) for r in found]
    out: dict[str, dict[int, float]] = {c: {} for c in cols}
    for i, r, key, _ in state:
        out[cols[i]][r] = float(values_of(np.array([key], np.uint64))[0])
    return out


def quantiles(df: DataFrame, asked: Mapping[str, Sequence[float]]) -> dict[str, list[float | None]]:
    """Exact quantiles of each column with linear interpolation between neighbours; None for a column without values."""
    cols = list(asked)
    sizes = df.agg(*[F.count(F.col(c)).alias(f"n{i}") for i, c in enumerate(cols)]).first()
    n = {c: sizes[f"n{i}"] for i, c in enumerate(cols)}
    ends = {c: [((n[c] - 1) * q, math.floor((n[c] - 1) * q), math.ceil((n[c] - 1) * q)) for q in asked[c]] for c in cols if n[c]}
    found = ranked(df, {c: [r for _, lo, hi in e for r in (lo, hi)] for c, e in ends.items()}) if ends else {}
    between = lambda c, at, lo, hi: found[c][lo] if found[c][lo] == found[c][hi] else found[c][lo] + (found[c][hi] - found[c][lo]) * (at - lo)
    return {c: [between(c, *e) for e in ends[c]] if c in ends else [None] * len(asked[c]) for c in cols}


def edges(df: DataFrame, cols: Sequence[str], cells: int) -> dict[str, list[float]]:
    """For each column, increasing values that split its rows into about equal cells: a value belongs behind all edges that aren't above it."""
    sizes = df.agg(*[F.count(F.col(c)).alias(f"n{i}") for i, c in enumerate(cols)]).first()
    asked = {c: sorted({sizes[f"n{i}"] * k // cells for k in range(1, cells)} - {sizes[f"n{i}"]}) for i, c in enumerate(cols)}
    found = ranked(df, {c: r for c, r in asked.items() if r and sizes[f"n{cols.index(c)}"]})
    return {c: sorted({v for v in found.get(c, {}).values() if not math.isnan(v)}) for c in cols}
