"""Exact top-k inner products of integer vectors, over blocks of norm-sorted vectors.

Vectors become integers, floor(scale * x), and are sorted by descending length into blocks.  An inner product is split by the leading axes of a singular
value decomposition: partial sums over more and more of these, each with the Cauchy-Schwarz bound on the lengths of what they leave over.  Every block of queries first meets the
block of the longest vectors, which sets each query's level, its k-th best score so far.  Queries are then dealt anew by level / |query|, the length that
a vector must have to matter, and a block travels only to blocks of queries of which one needs no more than its longest vector.  There a query goes through
the vectors from the longest on, stops where |query| * |vector| falls below its level, drops others by the bound of each partial sum, scores the likeliest
of the rest first, which raises its level, and then what still reaches it, exactly in integers, whatever their size.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_partitions, prepare, written

#: Factor of the integers; results; vectors of a block and queries of a block.
SCALE, TOP, BLOCK, QUERIES = 256, 5, 4096, 1024
#: Coordinates of the partial sums, and how many times the results are scored first, by falling partial sum, before others are asked for their bound.
STAGES, HEAD, LIKELY = (16, 32, 48), 48, 4
#: Vectors and components that the axes of one number of dimensions are fitted on at most; any axes give right results.
FITTED, FITTED_VALUES = 20_000, 1 << 24
#: Integers up to this size have exact products and sums in doubles at any usual number of dimensions; beyond it doubles bound and Python's integers score.
SAFE = 1 << 20
#: Numbers of dimensions up to which the first blocks, one for each, are broadcast; more travel by key.
FEW_DIMS = 16
#: Blocks of queries that one copy of a block of vectors meets.
TOGETHER = 16


def usable(vec: Column) -> Column:
    """Neither null nor with a null or non-finite component."""
    big = F.lit(float("inf"))
    return vec.isNotNull() & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < big))


def _ints(flat: np.ndarray, dims: int, scale: int) -> np.ndarray:
    """Rows of integers: doubles while they are exact, else objects."""
    x = flat.astype(np.float64).reshape(-1, dims)
    if not x.size or np.abs(x).max() <= SAFE / scale:
        return np.floor(scale * x)
    return np.array([[math.floor(scale * v) if abs(v) < 1 << 40 else scale * int(v) for v in row] for row in x.tolist()], object).reshape(-1, dims)


def _doubles(x: np.ndarray) -> tuple[np.ndarray, int]:
    """Doubles near x / 2**shift, off by one unit at most where x was shifted."""
    if x.dtype != object:
        return x, 0
    shift = max(0, max((abs(v).bit_length() for v in x.flat), default=0) - 400)
    return np.array([float(v >> shift) for v in x.flat]).reshape(x.shape), shift


def _axes(rows: np.ndarray) -> np.ndarray:
    """The leading orthonormal axes; they decide how much is pruned, never a result."""
    size = np.abs(rows).max(initial=0)
    rows = rows / size if size else rows
    if rows.shape[1] <= 1024:
        return np.linalg.svd(rows.T @ rows)[0][:, :HEAD]
    q = np.linalg.qr(np.random.default_rng(1).normal(size=(rows.shape[1], HEAD)))[0]
    for _ in range(6):  # subspace iteration: no square matrix of the dimensions
        q = np.linalg.qr(rows.T @ (rows @ q))[0]
    return q


#: Pairs that best() has scored exactly in this process.
counted = {"exact": 0}


def best(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, axes: np.ndarray, k: int, level: np.ndarray) -> list[tuple[int, int, int]]:
    """(query, vector, score) of each query's k best among x, which is sorted by descending length; level: scores under which nothing matters."""
    out: list[tuple[int, int, int]] = []
    if not len(x) or not len(q):
        return out
    (qf, qs), (xf, xs) = _doubles(q), _doubles(x)
    unit = 2.0 ** -(qs + xs)
    qr, xr = qf @ axes, xf @ axes
    q_sq, x_sq = (qf * qf).sum(1), (xf * xf).sum(1)
    q_len, x_len = np.sqrt(q_sq), np.sqrt(x_sq)
    stages = [(lo, hi) for lo, hi in itertools.pairwise((0, *STAGES)) if lo < axes.shape[1]]
    rest = lambda r, sq: [np.sqrt(np.maximum(sq - (r[:, :hi] ** 2).sum(1), 0)) for _, hi in stages]
    q_rest, x_rest = rest(qr, q_sq), rest(xr, x_sq)
    # Far over what rounding makes, and over a unit in each component where integers were shifted.
    slack = 1e-6 * (q_len * float(x_len.max()) + 1) + ((qs > 0) + (xs > 0)) * np.sqrt(x.shape[1]) * (q_len + float(x_len.max()) + x.shape[1])
    floor = np.where(level <= -(2.0**63), -np.inf, level * unit)
    exact = object in (q.dtype, x.dtype)
    if exact:
        q, x = (v if v.dtype == object else np.array([[int(c) for c in row] for row in v.tolist()], object).reshape(v.shape) for v in (q, x))
    top: list[list[tuple[int, int]]] = [[] for _ in q_ids]

    def scored(i: int, at: np.ndarray) -> None:
        """Exact scores of some vectors for a query."""
        if not len(at):
            return
        counted["exact"] += len(at)
        s = x[at] @ q[i]
        if len(at) > 4 * k and not exact:
            keep = s >= np.partition(s, len(s) - k)[len(s) - k]
            at, s = at[keep], s[keep]
        top[i] = sorted([*top[i], *((-int(a), int(b)) for a, b in zip(s, x_ids[at], strict=True))])[:k]
        if len(top[i]) == k:
            floor[i] = max(floor[i], float(-top[i][-1][0] >> (qs + xs)) if exact else -top[i][-1][0])

    step = 512
    for lo in range(0, len(x), step):
        live = np.flatnonzero(q_len * x_len[lo:].max() + slack >= floor)
        if not len(live):
            break
        hi = min(lo + step, len(x))
        part, reach = np.zeros((len(live), hi - lo)), np.ones((len(live), hi - lo), bool)
        for (x0, x1), qe, xe in zip(stages, q_rest, x_rest, strict=True):
            part += qr[live, x0:x1] @ xr[lo:hi, x0:x1].T
            bound = part + np.outer(qe[live], xe[lo:hi])
            reach &= bound + slack[live, None] >= floor[live, None]
        bound = bound if stages else np.zeros_like(part)
        for n, i in enumerate(live.tolist()):
            at = np.flatnonzero(reach[n])
            at = at[x_ids[lo + at] != q_ids[i]]
            if len(at) > 2 * LIKELY * k:
                first = at[np.argpartition(-part[n, at], LIKELY * k)[: LIKELY * k]]
                scored(i, lo + first)
                at = np.setdiff1d(at, first)
                at = at[bound[n, at] + slack[i] >= floor[i]]
            scored(i, lo + at)
    for name, found in zip(q_ids.tolist(), top, strict=True):
        out += [(name, v, max(min(-s, (1 << 63) - 1), -(1 << 63))) for s, v in found]
    return out


def _blocks(batches: Iterator[pa.RecordBatch], size: int, scale: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows (dims, id, need, level, vector) to blocks, cut where dims change: the longest vector, the least need, identifiers, levels and values."""
    dims, ids, needs, levels, rows = None, [], [], [], []

    def made() -> pa.RecordBatch:
        x = np.concatenate(rows) if dims else np.zeros(0)
        with np.errstate(over="ignore"):
            longest = float(np.sqrt((np.floor(scale * x.reshape(len(ids), -1)) ** 2).sum(1)).max()) if dims else 0.0
        return pa.RecordBatch.from_arrays([pa.array([dims], pa.int32()), pa.array([longest]), pa.array([min(needs)]), *(pa.array([np.array(v, kind).tobytes()], pa.binary()) for v, kind in ((ids, "<i8"), (levels, "<f8"), (x, "<f8")))], ["dims", "longest", "need", "ids", "levels", "vectors"])

    for b in batches:
        for d, name, need, level, v in zip(*(b.column(i).to_pylist() for i in range(4)), b.column(4), strict=True):
            if ids and (d != dims or len(ids) >= size):
                yield made()
                ids, needs, levels, rows = [], [], [], []
            dims = d
            ids.append(name)
            needs.append(-math.inf if need is None else need)
            levels.append(-math.inf if level is None else level)
            rows.append(np.asarray(v.values, np.float64))
    if ids:
        yield made()


_BLOCKS = "dims int, longest double, need double, ids binary, levels binary, vectors binary"


def _scored(batches: Iterator[pa.RecordBatch], axes: dict[int, np.ndarray], scale: int, k: int) -> Iterator[pa.RecordBatch]:
    """dims, q_ids, q_vectors, levels, x_ids, x_vectors to query_id, vec_id, score."""
    for b in batches:
        for d, qi, qv, lv, xi, xv in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
            q_ids, x_ids = np.frombuffer(qi, "<i8"), np.frombuffer(xi, "<i8")
            q, x = (_ints(np.frombuffer(v, "<f8"), d, scale) if d else np.zeros((len(n), 0)) for v, n in ((qv, q_ids), (xv, x_ids)))
            rot = axes.get(d)
            found = best(q, q_ids, x, x_ids, np.eye(d)[:, :HEAD] if rot is None else rot, k, np.frombuffer(lv, "<f8"))
            cols = list(zip(*found, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["query_id", "vec_id", "score"])


def search(vectors: DataFrame, queries: DataFrame, k: int = TOP, scale: int = SCALE, id_col: str = "vec_id", vec_col: str = "embedding", block: int = BLOCK, per_block: int = QUERIES) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row of queries the k rows of vectors with the highest integer inner product, but for its own id.

    Ties go to the smaller id.  Rows whose id or vector is null, or holds a null or non-finite component, take no part; vectors are compared with those
    of the same number of dimensions only.  Rows of vectors that repeat an id count each; queries that repeat one id and vector are one query, those that
    repeat an id with other vectors share one ranking of all that they find.  Scores beyond 64 bits are cut to the nearest long.
    """
    prepare(vectors.sparkSession)
    told = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).filter(F.col("id").isNotNull() & usable(F.col("v"))).withColumn("dims", F.size("v"))
    whole = lambda x: F.when(F.abs(x * scale) < float(1 << 52), F.floor(x * scale).cast("double")).otherwise(x * scale)
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + whole(x) * whole(x)))
    none = F.lit(None).cast("double")

    def in_blocks(rows: DataFrame, by: Column, size: int, name: str, n: int) -> DataFrame:
        # The id breaks ties of equal vectors, so copies of one vector don't meet in one partition.
        dealt = rows.withColumn("by", by).repartitionByRange(max(1, -(-n // size)), "dims", "by", "id").sortWithinPartitions("dims", "by", "id")
        return written(dealt.select("dims", "id", "need", "level", "v").mapInArrow(lambda it: _blocks(it, size, scale), _BLOCKS).withColumn("block", F.monotonically_increasing_id()), name)

    base, once = told(vectors), told(queries).select("dims", "id", "v").distinct()
    blocks = in_blocks(base.withColumn("need", none).withColumn("level", none), -length, block, "topk-blocks", base.count())
    asks = once.count()
    asked = in_blocks(once.withColumn("need", none).withColumn("level", none), F.col("id"), per_block, "topk-queries", asks)
    # Axes for each number of dimensions, from a bounded sample of the rows in order of a hash.
    sized = base.select("dims", "v", F.xxhash64("id").alias("h")).filter(F.col("dims") >= 2)
    room = F.greatest(F.lit(1), F.least(F.lit(FITTED), F.floor(F.lit(FITTED_VALUES) / F.col("dims"))))
    sample = sized.orderBy("h").limit(FITTED).withColumn("at", F.row_number().over(Window.partitionBy("dims").orderBy("h"))).filter(F.col("at") <= room).select("dims", "v").toArrow().to_pandas()
    axes = {int(d): _axes(np.stack(g["v"].to_numpy())) for d, g in sample.groupby("dims")}
    first = written(blocks.groupBy("dims").agg(F.max_by("block", F.struct("longest", (-F.col("block")).alias("first"))).alias("block")), "topk-first")
    few = first.count() <= FEW_DIMS
    found_schema = "query_id long, vec_id long, score long"

    def scored(rows: DataFrame) -> DataFrame:
        return rows.select("dims", "q_ids", "q_vectors", "q_levels", "ids", "vectors").mapInArrow(lambda it: _scored(it, axes, scale, k), found_schema)

    of_queries = lambda df: df.select(F.col("dims").alias("d"), F.col("need").alias("needed"), F.col("ids").alias("q_ids"), F.col("levels").alias("q_levels"), F.col("vectors").alias("q_vectors"), F.col("block").alias("asked"))
    # The longest block of each number of dimensions: at most FEW_DIMS of them are broadcast, so blocks of queries stay where they are.
    longest = blocks.join(first.select("block"), "block", "left_semi")
    begun = written(scored(of_queries(asked).join(F.broadcast(longest) if few else longest, F.col("d") == F.col("dims"))), "topk-begun")
    got = begun.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").cast("double").alias("level")).filter(F.col("n") == k).select(F.col("query_id").alias("id"), "level")
    # An id with several vectors or dimensions has no level of its own.
    one = once.groupBy("id").agg(F.count("*").alias("n")).filter("n = 1").select("id")
    known = once.join(got.join(one, "id"), "id", "left").withColumn("length", length)
    # A vector matters only if |query| * |vector| reaches the level; what rounding could make is taken off.
    known = known.withColumn("need", F.when(F.col("length") > 0, F.col("level") / F.col("length")).when(F.col("level") > 0, F.lit(float("inf"))))
    known = known.withColumn("need", F.col("need") - F.abs("need") * 1e-9 - 1e-9)
    again = in_blocks(known, F.coalesce("need", F.lit(float("-inf"))), per_block, "topk-asked", asks)
    # Pairs of blocks by their lengths and needs alone; each copy of a block meets a bounded number of blocks of queries.
    keys = n_partitions(vectors.sparkSession)
    names = again.select(F.col("dims").alias("d"), F.col("need").alias("needed"), F.col("block").alias("asked"), F.explode(F.sequence(F.lit(0), F.lit(keys - 1))).alias("key"))
    rest = blocks.join(first.select("block"), "block", "left_anti")
    at = rest.select("dims", "longest", "block", F.pmod(F.xxhash64("block"), F.lit(keys)).cast("int").alias("at"))
    near = (F.col("dims") == F.col("d")) & (F.col("at") == F.col("key")) & (F.col("longest") >= F.col("needed"))
    pairs = written(at.join(names, near).select("block", "asked", F.pmod(F.xxhash64("asked"), F.lit(max(1, asks // per_block // TOGETHER))).alias("copy")), "topk-pairs")
    copies = pairs.select("block", "copy").distinct().join(rest, "block")
    met = pairs.join(of_queries(again).drop("d", "needed"), "asked").join(copies, ["block", "copy"])
    found = begun.unionByName(scored(met))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
