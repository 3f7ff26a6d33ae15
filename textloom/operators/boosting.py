"""Gradient-boosted trees over binned rows: leaf-wise or symmetric, all folds and variants in step.

Rows become blocks of one byte per value: quantile bins whose edges are exact order statistics.  A round grows one tree for every member, that is every fold
of every variant.  A pass adds up gradients, curvatures and rows per node, feature and bin in each task, sums these tables by shuffle and hands only the best
split of each node and feature to the driver, so a pass is one job however many members there are, and the driver never sees rows or tables of bins.

Leaf-wise, the leaf of the largest gain is split next.  Which one that is among new leaves takes a pass; a pass looks at the children of all leaves that could
be next, so a tree takes about as many passes as it is deep.  Symmetric, a level has one split, the best over all its nodes.  Rows that are held back say
when to stop, and a model keeps its best number of rounds.  Gradients are summed in whole numbers, so results don't depend on the order of rows or tasks.
"""

from __future__ import annotations

import heapq
import json
import math
from collections import defaultdict
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import shared_folder
from .selection import edges

#: Bins of a feature, fixed point of gradients, rounds after which scores are written, rows of a block.
BINS, FIXED, WRITTEN, BLOCK = 64, 1 << 24, 10, 8192
#: One row in so many is held back.
HELD = 10


@dataclass
class Trees:
    """How the trees of one variant grow.  rows: a condition on training rows.  levels: the depth of symmetric trees; leaf-wise ones have no bound but leaves."""

    name: str
    features: Sequence[str]
    rows: str | None = None
    rounds: int = 100
    rate: float = 0.03
    leaves: int = 32
    levels: int = 6
    symmetric: bool = False
    feature_share: float = 0.7
    row_share: float = 0.7
    least_rows: int = 20
    least_curvature: float = 1e-3
    ridge: float = 0.0
    patience: int = 50


@dataclass
class Tree:
    """Nodes by number: feature (-1 for a leaf), highest bin that goes left, children, value."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, at: int) -> tuple[int, int]:
        self.feature[node], self.bin[node] = feature, at
        self.left[node], self.right[node] = len(self.feature), len(self.feature) + 1
        for xs, v in ((self.feature, -1), (self.bin, 0), (self.left, 0), (self.right, 0), (self.value, 0.0)):
            xs.extend([v, v])
        return self.left[node], self.right[node]

    def nodes(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row of x, features by rows."""
        feature, at, left, right = (np.array(v) for v in (self.feature, self.bin, self.left, self.right))
        node, rows = np.zeros(x.shape[1], np.int64), np.arange(x.shape[1])
        while True:
            live = rows[feature[node] >= 0]
            if not len(live):
                return node
            n = node[live]
            node[live] = np.where(x[feature[n], live] <= at[n], left[n], right[n])

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.nodes(x)]


@dataclass
class Model:
    """Trees of one member, with the edges of their features' bins."""

    features: list[str]
    edges: list[list[float]]
    start: float
    trees: list[Tree]
    gains: list[float]
    losses: list[float] = field(default_factory=list)

    def binned(self, columns: Sequence[np.ndarray]) -> np.ndarray:
        return np.stack([_binned(c, e) for c, e in zip(columns, self.edges, strict=True)]) if self.edges else np.zeros((0, 0), np.uint8)

    def dumps(self) -> str:
        return json.dumps({**self.__dict__, "trees": [t.__dict__ for t in self.trees]})

    @staticmethod
    def loads(text: str) -> Model:
        told = json.loads(text)
        return Model(**{**told, "trees": [Tree(**t) for t in told["trees"]]})


def _binned(x: np.ndarray, cuts: Sequence[float]) -> np.ndarray:
    """Bin 0 is for what is missing; others by how many edges aren't above the value."""
    out = np.searchsorted(np.asarray(cuts, float), x, side="right") + 1
    return np.where(np.isnan(x), 0, out).astype(np.uint8)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def _mixed(h: np.ndarray, salt: int) -> np.ndarray:
    """Numbers in [0, 1) from 64-bit hashes."""
    with np.errstate(over="ignore"):
        x = (h ^ np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
    return (x >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def chosen_features(t: Trees, number: int, round_: int, allowed: Sequence[int]) -> list[int]:
    """The features that a tree may use, drawn from the variant's name and the round alone."""
    salt = np.array([hash_of(f"{t.name}/{number}/{round_}")], np.uint64)
    draw = _mixed(np.arange(1, len(allowed) + 1).astype(np.uint64) * salt, 7)
    keep = max(1, math.ceil(t.feature_share * len(allowed) - 1e-9))
    return sorted(allowed[i] for i in np.argsort(draw, kind="stable")[:keep])


def hash_of(text: str) -> int:
    out = 14695981039346656037
    for b in text.encode():
        out = (out ^ b) * 1099511628211 % (1 << 64)
    return out | 1


@dataclass
class _Member:
    trees: Trees
    number: int
    fold: int | None
    allowed: list[int]
    model: Model
    salt: int = 0
    recent: list[Tree] = field(default_factory=list)
    tree: Tree | None = None
    features: list[int] = field(default_factory=list)
    wanted: list[int] = field(default_factory=list)
    best: tuple[float, int] = (math.inf, 0)
    done: bool = False


# tasks

_BLOCKS = "n int, bins binary, label binary, fold binary, hash binary, fit binary, scores binary"


def _blocked(batches: Iterator[pa.RecordBatch], cuts: list[list[float]], starts: list[float], n_fit: int) -> Iterator[pa.RecordBatch]:
    """Rows (label, fold, hash, one mark for each variant, features) to blocks."""
    for b in batches:
        for lo in range(0, b.num_rows, BLOCK):
            part = b.slice(lo, BLOCK)
            n = part.num_rows
            num = lambda i, kind: part.column(i).to_numpy(zero_copy_only=False).astype(kind)
            fit = np.stack([num(3 + v, np.uint8) for v in range(n_fit)])
            x = np.stack([_binned(num(3 + n_fit + i, np.float64), c) for i, c in enumerate(cuts)])
            scores = np.repeat(np.array(starts), n)
            cells = [x.tobytes(), num(0, np.uint8).tobytes(), num(1, np.int32).tobytes(), num(2, np.int64).tobytes(), fit.tobytes(), scores.tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), *(pa.array([c], pa.binary()) for c in cells)], [c.split()[0] for c in _BLOCKS.split(", ")])


def _read(b: pa.RecordBatch, width: int, n_fit: int, members: int) -> Iterator[tuple]:
    for n, x, label, fold, h, fit, scores in zip(*(c.to_pylist() for c in b.columns), strict=True):
        yield (n, np.frombuffer(x, np.uint8).reshape(width, n), np.frombuffer(label, np.uint8).astype(float), np.frombuffer(fold, np.int32), np.frombuffer(h, np.int64).view(np.uint64),
               np.frombuffer(fit, np.uint8).reshape(n_fit, n).astype(bool), np.frombuffer(scores, np.float64).reshape(members, n))


def _training(m: _Member, fold: np.ndarray, h: np.ndarray, fit: np.ndarray, bagged: bool) -> np.ndarray:
    rows = fit[m.number] & (h % np.uint64(HELD) != 0)
    if m.fold is not None:
        rows &= fold != m.fold
    return rows & (_mixed(h, m.salt) < m.trees.row_share) if bagged and m.trees.row_share < 1 else rows


def _tables(batches: Iterator[pa.RecordBatch], members: list[_Member], width: int, n_fit: int) -> Iterator[pa.RecordBatch]:
    """Blocks to rows (member, slot, feature, table): sums of gradients, curvatures and rows by bin."""
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for _, x, y, fold, h, fit, scores in _read(b, width, n_fit, len(members)):
            for k, m in enumerate(members):
                if not m.wanted:
                    continue
                rows = np.flatnonzero(_training(m, fold, h, fit, True))
                slot = np.full(len(m.tree.feature), -1)
                slot[m.wanted] = np.arange(len(m.wanted))
                xs = x[:, rows]
                at = slot[m.tree.nodes(xs)]
                rows, xs, at = rows[at >= 0], xs[:, at >= 0], at[at >= 0]
                if not len(rows):
                    continue
                s = scores[k][rows] + sum((t.scores(xs) for t in m.recent), np.zeros(len(rows)))
                p = sigmoid(s)
                g, c = np.rint((p - y[rows]) * FIXED), np.rint(p * (1 - p) * FIXED)
                total = sums.setdefault(k, np.zeros((len(m.wanted), len(m.features), BINS + 1, 3), np.int64))
                size = len(m.wanted) * (BINS + 1)
                for i, f in enumerate(m.features):
                    cell = at * (BINS + 1) + xs[f]
                    for j, w in enumerate((g, c, None)):
                        total[:, i, :, j] += np.bincount(cell, w, size).astype(np.int64).reshape(len(m.wanted), BINS + 1)
    out = [(k, s, members[k].features[i], t[s, i].tobytes()) for k, t in sums.items() for s in range(t.shape[0]) for i in range(t.shape[1])]
    cols = list(zip(*out, strict=True)) or [(), (), (), ()]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int32(), pa.binary()), strict=True)], ["member", "slot", "feature", "sums"])


def _sides(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums left of and including each bin, and right of it, as numbers; the last bin has nothing to its right."""
    left = np.cumsum(table, 0)
    return left[:-1] / np.array([FIXED, FIXED, 1]), (left[-1] - left[:-1]) / np.array([FIXED, FIXED, 1])


def _gains(table: np.ndarray, t: Trees) -> np.ndarray:
    """By how much a split behind each bin lowers the loss; below 0 where it isn't allowed."""
    left, right = _sides(table)
    whole = (left + right)[0]
    value = lambda s: s[..., 0] ** 2 / np.maximum(s[..., 1] + t.ridge, 1e-12)
    ok = (np.minimum(left[:, 2], right[:, 2]) >= t.least_rows) & (np.minimum(left[:, 1], right[:, 1]) >= t.least_curvature)
    return np.where(ok, value(left) + value(right) - value(whole), -1.0)


def _splits(batches: Iterator[pa.RecordBatch], members: list[_Member]) -> Iterator[pa.RecordBatch]:
    """Tables sorted by member, feature and slot to (member, slot, feature, gain, bin, g, c, n): the best split and the node's sums.

    For symmetric trees the gain is that of all slots together; each slot has a row for its sums.
    """
    out, key, held = [], None, {}

    def made() -> None:
        k, f = key
        t = members[k].trees
        if t.symmetric:
            # A node where the split isn't allowed gains nothing by it and stays whole.
            gains = sum(np.maximum(_gains(v, t), 0.0) for v in held.values())
            at = int(np.argmax(gains))
            out.extend((k, s, f, float(gains[at]), at, *map(float, v.sum(0) / np.array([FIXED, FIXED, 1]))) for s, v in sorted(held.items()))
        else:
            for s, v in sorted(held.items()):
                gains = _gains(v, t)
                at = int(np.argmax(gains))
                out.append((k, s, f, float(gains[at]), at, *map(float, v.sum(0) / np.array([FIXED, FIXED, 1]))))

    for b in batches:
        for k, s, f, sums in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if (k, f) != key:
                if key is not None:
                    made()
                key, held = (k, f), {}
            table = np.frombuffer(sums, np.int64).reshape(BINS + 1, 3)
            held[s] = held[s] + table if s in held else table
    if key is not None:
        made()
    cols = list(zip(*out, strict=True)) or [()] * 8
    kinds = [pa.int32()] * 3 + [pa.float64(), pa.int32()] + [pa.float64()] * 3
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["member", "slot", "feature", "gain", "bin", "g", "c", "n"])


def _losses(batches: Iterator[pa.RecordBatch], members: list[_Member], width: int, n_fit: int) -> Iterator[pa.RecordBatch]:
    """Blocks to (member, loss, n) over the rows that are held back, in whole numbers."""
    sums = np.zeros((len(members), 2), np.int64)
    for b in batches:
        for _, x, y, fold, h, fit, scores in _read(b, width, n_fit, len(members)):
            for k, m in enumerate(members):
                held = fit[m.number] & (h % np.uint64(HELD) == 0) & (fold != m.fold if m.fold is not None else True)
                rows = np.flatnonzero(held)
                if m.done or not len(rows):
                    continue
                xs = x[:, rows]
                s = scores[k][rows] + sum((t.scores(xs) for t in m.recent), np.zeros(len(rows)))
                sums[k] += np.rint(np.logaddexp(0, np.where(y[rows] > 0, -s, s)) * FIXED).astype(np.int64).sum(), len(rows)
    yield pa.RecordBatch.from_arrays([pa.array(range(len(members)), pa.int32()), pa.array(sums[:, 0]), pa.array(sums[:, 1])], ["member", "loss", "n"])


def _rescored(batches: Iterator[pa.RecordBatch], members: list[_Member], width: int, n_fit: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        new = []
        for _, x, _, _, _, _, scores in _read(b, width, n_fit, len(members)):
            new.append(np.stack([scores[k] + sum((t.scores(x) for t in m.recent), np.zeros(x.shape[1])) for k, m in enumerate(members)]).tobytes())
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(new, pa.binary())], b.schema.names)


# driver

def _written(df: DataFrame, name: str) -> DataFrame:
    import uuid

    path = f"{shared_folder(df.sparkSession)}/textloom-boosting/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _pass(blocks: DataFrame, members: list[_Member], width: int, n_fit: int) -> dict[tuple[int, int], list]:
    """By member and slot the best splits of each feature."""
    tables = blocks.mapInArrow(lambda it: _tables(it, members, width, n_fit), "member int, slot int, feature int, sums binary")
    dealt = tables.repartition("member", "feature").sortWithinPartitions("member", "feature", "slot")
    found = defaultdict(list)
    for r in dealt.mapInArrow(lambda it: _splits(it, members), "member int, slot int, feature int, gain double, bin int, g double, c double, n double").collect():
        found[r["member"], r["slot"]].append(r)
    return found


def _best(rows: list) -> tuple:
    return min(rows, key=lambda r: (-r["gain"], r["feature"]))


def _leaf(t: Trees, g: float, c: float) -> float:
    return -t.rate * g / max(c + t.ridge, 1e-12)


def _grow(blocks: DataFrame, members: list[_Member], width: int, n_fit: int) -> None:
    """One tree for each member that isn't done."""
    live = [m for m in members if not m.done]
    sums: dict[int, dict[int, tuple]] = {id(m): {} for m in live}  # node to (gain, feature, bin, g, c)
    for m in live:
        m.tree, m.wanted = Tree(), [0]
    heaps: dict[int, list] = {id(m): [] for m in live}
    shadow: dict[int, dict[int, tuple[int, int]]] = {id(m): {} for m in live}  # children made to look ahead
    leaves = {id(m): 1 for m in live}
    while any(m.wanted for m in live):
        found = _pass(blocks, members, width, n_fit)
        for k, m in enumerate(members):
            if m.done or not m.wanted:
                continue
            me = id(m)
            for s, node in enumerate(m.wanted):
                rows = found.get((k, s))
                if rows:
                    b = _best(rows)
                    sums[me][node] = (b["gain"], b["feature"], b["bin"], b["g"], b["c"])
            if m.trees.symmetric:
                m.wanted = _level(m, sums[me])
                continue
            known, heap = sums[me], heaps[me]
            if m.wanted == [0] and 0 in known:
                heapq.heappush(heap, (-known[0][0], 0))
            # Split the best leaf as long as it is known which one that is.
            while heap and leaves[me] < m.trees.leaves and -heap[0][0] > 1e-12:
                node = heap[0][1]
                if node not in shadow[me]:
                    break
                heapq.heappop(heap)
                m.model.gains[known[node][1]] += known[node][0]
                leaves[me] += 1
                for child in shadow[me].pop(node):
                    if child in known:
                        heapq.heappush(heap, (-known[child][0], child))
            # Look at the children of all leaves that can still be split.
            room = m.trees.leaves - leaves[me]
            m.wanted = []
            for gain, node in sorted(heap)[:room]:
                if -gain > 1e-12 and node not in shadow[me]:
                    shadow[me][node] = m.tree.split(node, known[node][1], known[node][2])
                    m.wanted += shadow[me][node]
            if not room:
                m.wanted = []
    for m in live:
        for node in shadow[id(m)]:  # looked at, not taken
            m.tree.feature[node] = -1
        for node, (_, _, _, g, c) in sums[id(m)].items():
            if m.tree.feature[node] < 0:
                m.tree.value[node] = _leaf(m.trees, g, c)
        m.wanted = []


def _level(m: _Member, known: dict[int, tuple]) -> list[int]:
    """Split all leaves of a symmetric tree alike; the new leaves, or none at the last level."""
    leaves = [n for n, f in enumerate(m.tree.feature) if f < 0]
    told = [known[n] for n in leaves if n in known]
    depth = int(math.log2(len(leaves)))
    if not told or depth >= m.trees.levels or max(t[0] for t in told) <= 1e-12:
        return []
    gain, feature, at = max(((t[0], -t[1], t[2]) for t in told), key=lambda t: t[:2])
    m.model.gains[-feature] += gain
    for n in leaves:
        left, right = m.tree.split(n, -feature, at)
        # A child without rows keeps what its parent says.
        known[left] = known[right] = (0.0, 0, 0, *known[n][3:]) if n in known else (0.0, 0, 0, 0.0, 0.0)
    return [n for n, f in enumerate(m.tree.feature) if f < 0]


@dataclass
class Trained:
    """Models by variant and fold."""

    models: dict[tuple[str, int | None], Model]
    features: list[str]

    def predict(self, df: DataFrame, variant: str, keep: Sequence[str], fold: str | None = None, folds: Sequence[int] | None = None) -> DataFrame:
        """``keep, target``: with fold, each row by the model that didn't see its fold, else the mean over models."""
        names = [n for n in self.models if n[0] == variant and (folds is None or n[1] in folds)]
        models = [self.models[n] for n in names]
        numbers = [n[1] for n in names]
        one = models[0]
        cols = [F.col(c).cast("double").alias(f"__f{i}") for i, c in enumerate(one.features)]
        told = df.select(*keep, *([F.col(fold).cast("int").alias("__fold")] if fold else []), *cols)
        first = len(keep) + bool(fold)

        def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = one.binned([b.column(first + i).to_numpy(zero_copy_only=False).astype(np.float64) for i in range(len(one.features))])
                each = np.stack([sigmoid(m.start + sum((t.scores(x) for t in m.trees), np.zeros(b.num_rows))) for m in models])
                if fold:
                    own = b.column(first - 1).to_numpy(zero_copy_only=False)
                    target = np.full(b.num_rows, np.nan)
                    for k, n in enumerate(numbers):
                        target[own == n] = each[k][own == n]
                else:
                    target = each.mean(0)
                yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(target)], [*keep, "target"])

        schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema), "target double"])
        return told.mapInArrow(scored, schema)

    def importance(self, variant: str) -> list[tuple[str, float]]:
        """Gains of each feature, summed over the folds' models."""
        return [(f, sum(m.gains[i] for n, m in self.models.items() if n[0] == variant)) for i, f in enumerate(self.features)]


def train(df: DataFrame, variants: Sequence[Trees], ids: Sequence[str], label: str = "target", fold: str | None = "cv", only: Mapping[str, int] | None = None) -> Trained:
    """A model for each variant and fold, trained on the other folds; without fold, one for each variant on all rows.

    Labels are 0 or 1; rows without label, or without fold, aren't trained on.  Missing values are a bin of their own, left of all others.  only: features
    that a single fold's model may use, such as statistics of labels that leave that fold out.  A table without rows gives models without trees.
    """
    spark = df.sparkSession
    features = list(dict.fromkeys(f for v in variants for f in v.features))
    some = df.filter(F.col(label).isNotNull() & (F.col(fold).isNotNull() if fold else F.lit(True)))
    cut = edges(some, features, BINS)
    cuts = [cut[f][: BINS - 1] for f in features]
    sums = some.groupBy(*([F.col(fold).cast("int").alias("k")] if fold else [F.lit(0).alias("k")])).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("double")).alias("y")).collect()  # a row for each fold
    members: list[_Member] = []
    for i, v in enumerate(variants):
        for k in sorted(r["k"] for r in sums) if fold else [None]:
            n, y = (sum(r[c] for r in sums if r["k"] != k) for c in ("n", "y"))
            rate = min(max(y / n, 1e-6), 1 - 1e-6) if n else 0.5
            own = [j for j, f in enumerate(features) if f in v.features and (not only or f not in only or only[f] == k)]
            members.append(_Member(v, i, k, own, Model(features, cuts, math.log(rate / (1 - rate)), [], [0.0] * len(features))))
    marks = [F.coalesce(F.expr(v.rows) if v.rows else F.lit(True), F.lit(False)).cast("int") for v in variants]
    told = some.select(F.col(label).cast("int"), F.col(fold).cast("int") if fold else F.lit(0), F.xxhash64(*ids), *marks, *[F.col(f).cast("double") for f in features])
    told = told.toDF(*[f"c{i}" for i in range(len(told.columns))])
    width, n_fit = len(features), len(variants)
    starts = [m.model.start for m in members]
    blocks = _written(told.mapInArrow(lambda it: _blocked(it, cuts, starts, n_fit), _BLOCKS), "blocks")
    for r in range(max(v.rounds for v in variants)):
        for m in members:
            m.done = m.done or r >= m.trees.rounds or not m.allowed
            m.salt = hash_of(f"{m.trees.name}/{r}")
            m.features = [] if m.done else chosen_features(m.trees, m.number, r, m.allowed)
        if all(m.done for m in members):
            break
        _grow(blocks, members, width, n_fit)
        for m in members:
            if not m.done:
                m.recent.append(m.tree)
                m.model.trees.append(m.tree)
        lost = blocks.mapInArrow(lambda it: _losses(it, members, width, n_fit), "member int, loss long, n long").groupBy("member").agg(F.sum("loss").alias("loss"), F.sum("n").alias("n")).collect()
        for x in lost:
            m = members[x["member"]]
            if m.done or not x["n"]:
                continue
            loss = x["loss"] / FIXED / x["n"]
            m.model.losses.append(loss)
            if loss < m.best[0]:
                m.best = (loss, r + 1)
            elif r + 1 - m.best[1] >= m.trees.patience:
                m.done = True
        if (r + 1) % WRITTEN == 0:
            blocks = _written(blocks.mapInArrow(lambda it: _rescored(it, members, width, n_fit), _BLOCKS), "blocks")
            for m in members:
                m.recent = []
    for m in members:
        if m.best[1]:  # without held-back rows all rounds stay
            del m.model.trees[m.best[1] :]
    return Trained({(m.trees.name, m.fold): m.model for m in members}, features)


def ordered_statistics(df: DataFrame, category: str, ids: Sequence[str], label: str = "target", fold: str = "cv", folds: Sequence[int] = (1, 2, 3, 4, 5), weight: float = 1.0, prior: float = 0.5, seed: int = 11) -> DataFrame:
    """Adds ``<category>_ts_<k>`` for each fold k: the mean label of a row's category among rows before it in a random order, without those of fold k.

    The mean is drawn to the prior by a weight.  Rows of fold k get the mean over all others.  No row's own label is in its number, and none of fold k in a
    number that its model reads.  Null is a category of its own.  A category of very many rows is added up in cells of the order first, so that no task
    orders all of it.
    """
    place = F.xxhash64(F.lit(seed), *ids)
    told = df.withColumn("__place", place).withColumn("__cell", F.shiftright("__place", 56))
    parts = [(k, F.when((F.col(fold) != k) & F.col(label).isNotNull(), v)) for k in folds for v in (F.col(label).cast("double"), F.lit(1.0))]
    names = [f"__{n}{k}" for k in folds for n in ("y", "n")]
    told = told.withColumns({n: F.coalesce(v, F.lit(0.0)) for n, (_, v) in zip(names, parts, strict=True)})
    cells = told.groupBy(F.col(category).alias("__c"), F.col("__cell").alias("__b")).agg(*[F.sum(n).alias(f"{n}s") for n in names])
    before = Window.partitionBy("__c").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("__c")
    cells = cells.select("__c", "__b", *[F.coalesce(F.sum(f"{n}s").over(before), F.lit(0.0)).alias(f"{n}b") for n in names], *[F.sum(f"{n}s").over(whole).alias(f"{n}w") for n in names])
    out = told.join(cells, told[category].eqNullSafe(cells["__c"]) & (told["__cell"] == cells["__b"]))
    inside = Window.partitionBy(category, "__cell").orderBy("__place", *ids).rowsBetween(Window.unboundedPreceding, -1)
    cols = {}
    for k in folds:
        y, n = (F.when(F.col(fold) == k, F.col(f"__{x}{k}w")).otherwise(F.col(f"__{x}{k}b") + F.coalesce(F.sum(f"__{x}{k}").over(inside), F.lit(0.0))) for x in ("y", "n"))
        cols[f"{category}_ts_{k}"] = (y + weight * prior) / (n + weight)
    return out.withColumns(cols).select(*df.columns, *cols)
