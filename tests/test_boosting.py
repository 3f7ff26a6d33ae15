"""Boosted trees against trees grown by plain loops, statistics that don't leak, early stopping, missing values."""

import math
from functools import reduce

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.operators import boosting as G
from textloom.operators import metrics as M

COLS = ["a", "b", "c", "d"]


def table(spark, n=900, seed=1, noise=0.1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4))
    x[:, 2] = np.round(x[:, 2])
    y = ((x[:, 0] * x[:, 1] > 0) ^ (rng.random(n) < noise)).astype(int)
    rows = [(i, int(y[i]), i % 5 + 1, *(None if j == 3 and i % 7 == 0 else float(x[i, j]) for j in range(4))) for i in range(n)]
    return spark.createDataFrame(rows, "id long, y int, cv int, a double, b double, c double, d double").repartition(4), rows


def bins_of(rows, model):
    cols = [np.array([np.nan if r[3 + j] is None else r[3 + j] for r in rows]) for j in range(4)]
    return model.binned(cols)


def best_split(x, g, c, rows, t):
    """The best (gain, feature, bin) of a node, the first of equal ones."""
    best = (-1.0, 0, 0)
    whole = g[rows].sum() ** 2 / (c[rows].sum() + t.ridge)
    for f in range(x.shape[0]):
        for b in range(x[f].max()):
            left = rows & (x[f] <= b)
            right = rows & ~left
            if min(left.sum(), right.sum()) < t.least_rows or min(c[left].sum(), c[right].sum()) < t.least_curvature:
                continue
            gain = g[left].sum() ** 2 / (c[left].sum() + t.ridge) + g[right].sum() ** 2 / (c[right].sum() + t.ridge) - whole
            if gain > best[0] + 1e-9:
                best = (gain, f, b)
    return best


def plain_trees(x, y, train, t, start, rounds):
    """Scores of all rows after so many rounds; leaves split by largest gain, one after another."""
    s = np.full(x.shape[1], start)
    for _ in range(rounds):
        p = G.sigmoid(s)
        g, c = np.rint((p - y) * G.FIXED) / G.FIXED, np.rint(p * (1 - p) * G.FIXED) / G.FIXED
        everything = np.ones(x.shape[1], bool)
        leaves = [everything]
        if t.symmetric:
            for _ in range(t.levels):
                gains = np.zeros((x.shape[0], G.BINS))
                for leaf in leaves:
                    rows = leaf & train
                    whole = g[rows].sum() ** 2 / max(c[rows].sum(), 1e-12)
                    for f in range(x.shape[0]):
                        for b in range(G.BINS):
                            left, right = rows & (x[f] <= b), rows & (x[f] > b)
                            if min(left.sum(), right.sum()) >= t.least_rows:
                                gains[f, b] += max(0.0, g[left].sum() ** 2 / c[left].sum() + g[right].sum() ** 2 / c[right].sum() - whole)
                f, b = np.unravel_index(np.argmax(np.round(gains, 9)), gains.shape)
                leaves = [part for leaf in leaves for part in (leaf & (x[f] <= b), leaf & (x[f] > b))]
        else:
            found = [best_split(x, g, c, everything & train, t)]
            while len(leaves) < t.leaves and max(found)[0] > 1e-12:
                k = max(range(len(found)), key=lambda i: found[i][0])
                _, f, b = found.pop(k)
                leaf = leaves.pop(k)
                for part in (leaf & (x[f] <= b), leaf & (x[f] > b)):
                    leaves.append(part)
                    found.append(best_split(x, g, c, part & train, t))
        for leaf in leaves:
            rows = leaf & train
            if c[rows].sum() > 0:
                s[leaf] += -t.rate * g[rows].sum() / (c[rows].sum() + t.ridge)
    return s


def held(spark, df):
    return {r.id: r.h for r in df.select("id", F.pmod(F.xxhash64("id"), F.lit(2**62)).alias("x"), F.xxhash64("id").alias("h")).collect()}


@pytest.mark.parametrize("symmetric", [False, True])
def test_trees_equal_plain_ones(spark, symmetric):
    """Every feature and row in use: the same scores as trees grown by loops, leaf by leaf or level by level."""
    df, rows = table(spark, 400)
    t = G.Trees("t", COLS, rounds=2, rate=0.3, leaves=9, levels=3, symmetric=symmetric, feature_share=1, row_share=1, least_rows=10)
    model = G.train(df, [t], ["id"], "y").models["t", 2]
    x, y = bins_of(rows, model), np.array([r[1] for r in rows], float)
    hashes = held(spark, df)
    back = np.array([np.array([hashes[r[0]]]).view(np.uint64)[0] % 10 == 0 for r in rows])
    train = np.array([r[2] != 2 for r in rows]) & ~back
    rounds = len(model.trees)
    want = plain_trees(x, y, train, t, model.start, rounds)
    got = model.start + sum(tree.scores(x) for tree in model.trees)
    if symmetric:  # nodes without training rows take their parent's value
        assert np.allclose(got[train], want[train], atol=1e-6)
    else:
        assert np.allclose(got, want, atol=1e-6)


def test_folds_and_variants_in_step(spark):
    """Each variant has a model for each fold, what it predicts it hasn't seen, and two runs over other partitions agree to the bit."""
    df, _ = table(spark)
    variants = [G.Trees("leafwise", COLS, rounds=12, rate=0.2, leaves=16), G.Trees("symmetric", COLS, rounds=12, rate=0.2, symmetric=True, levels=4), G.Trees("few", COLS, rows="a > 0", rounds=3)]
    made = G.train(df, variants, ["id"], "y")
    again = G.train(df.repartition(3, "b"), variants, ["id"], "y")
    assert {k: m.dumps() for k, m in made.models.items()} == {k: m.dumps() for k, m in again.models.items()}
    assert set(made.models) == {(v.name, k) for v in variants for k in range(1, 6)}
    for name in ("leafwise", "symmetric"):
        p = made.predict(df, name, ["id", "y", "cv"], "cv")
        assert p.filter("target IS NULL OR isnan(target)").count() == 0
        assert M.auc(p, "y", "target").first().auc > 0.8
    shares = dict(made.importance("leafwise"))
    assert min(shares["a"], shares["b"]) > 2 * max(shares["c"], shares["d"])
    model = made.models["symmetric", 1]
    for tree in model.trees:
        depth = {0: 0}
        for n, f in enumerate(tree.feature):
            if f >= 0:
                depth[tree.left[n]] = depth[tree.right[n]] = depth[n] + 1
        levels = {}
        for n, d in depth.items():
            if tree.feature[n] >= 0:
                levels.setdefault(d, set()).add((tree.feature[n], tree.bin[n]))
        assert all(len(s) == 1 for s in levels.values())
    assert G.Model.loads(model.dumps()).dumps() == model.dumps()


def test_the_best_round_is_kept(spark):
    """On labels that are noise, training stops when rows held back no longer gain."""
    df, _ = table(spark, 300, noise=0.5)
    made = G.train(df, [G.Trees("noise", COLS, rounds=40, rate=0.5, least_rows=2, patience=3)], ["id"], "y")
    for m in made.models.values():
        assert len(m.losses) < 40 and len(m.trees) == int(np.argmin(m.losses)) + 1


def test_edge_cases(spark):
    """One label, no rows, constant and missing features, rows without label or fold."""
    df, _ = table(spark, 60)
    one = G.train(df.withColumn("y", F.lit(1)), [G.Trees("one", COLS, rounds=2)], ["id"], "y")
    assert one.predict(df, "one", ["id"], "cv").filter("target < 0.99").count() == 0
    flat = G.train(df.withColumn("a", F.lit(1.0)).withColumn("b", F.lit(None).cast("double")), [G.Trees("flat", ["a", "b"], rounds=2)], ["id"], "y")
    assert all(len(t.feature) == 1 for m in flat.models.values() for t in m.trees)
    assert G.train(df.limit(0), [G.Trees("none", COLS, rounds=2)], ["id"], "y").models == {}
    lost = G.train(df.withColumn("y", F.when(F.col("id") % 2 == 0, F.col("y"))).withColumn("cv", F.when(F.col("id") % 3 > 0, F.col("cv"))), [G.Trees("lost", COLS, rounds=1)], ["id"], "y")
    assert len(lost.models) == 5
    mean = lost.predict(df, "lost", ["id"])
    assert mean.count() == 60 and mean.filter("target IS NULL").count() == 0


def test_ordered_statistics(spark):
    """A row's number is the mean label of rows before it in the order, without its own and without the fold's; a hot category is one of them."""
    rng = np.random.default_rng(2)
    rows = [(i, int(rng.random() < 0.4), int(rng.integers(1, 4)), ["hot", "x", None, f"r{i % 40}"][int(rng.integers(0, 4))]) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, y int, cv int, cat string").repartition(5)
    got = {r.id: r for r in G.ordered_statistics(df, "cat", ["id"], "y", folds=(1, 2, 3)).collect()}
    place = {r.id: r.p for r in df.select("id", F.xxhash64(F.lit(11), "id").alias("p")).collect()}
    assert len(got) == 400
    for i, _, cv, cat in rows:
        for k in (1, 2, 3):
            seen = [y for j, y, f, c in rows if c == cat and f != k and (cv == k or place[j] < place[i])]
            assert abs(got[i][f"cat_ts_{k}"] - (sum(seen) + 0.5) / (len(seen) + 1)) < 1e-12


def test_statistics_of_random_labels_do_not_leak(spark):
    """With a category per few rows and labels that are noise, models out of fold are no better than chance."""
    rng = np.random.default_rng(3)
    rows = [(i, int(rng.random() < 0.5), i % 3 + 1, f"c{i // 4}", float(rng.random())) for i in range(1600)]
    df = G.ordered_statistics(spark.createDataFrame(rows, "id long, y int, cv int, cat string, z double"), "cat", ["id"], "y", folds=(1, 2, 3))
    names = [f"cat_ts_{k}" for k in (1, 2, 3)]
    made = G.train(df, [G.Trees("ts", [*names, "z"], rounds=8, rate=0.3, symmetric=True, levels=3, feature_share=1)], ["id"], "y", only={f"cat_ts_{k}": k for k in (1, 2, 3)})
    assert all(g == 0 for (_, k), m in made.models.items() for f, g in zip(made.features, m.gains, strict=True) if f.startswith("cat") and f != f"cat_ts_{k}")
    out = made.predict(df, "ts", ["id", "y", "cv"], "cv")
    assert abs(M.auc(out, "y", "target").first().auc - 0.5) < 0.06


def test_a_row_is_in_a_bin_by_its_value():
    cuts = [0.0, 1.5]
    assert G._binned(np.array([np.nan, -1, 0, 1, 1.5, 9]), cuts).tolist() == [0, 1, 2, 2, 3, 3]
    assert math.isclose(reduce(lambda a, b: a + b, G._mixed(np.arange(10_000).astype(np.uint64), 5)) / 10_000, 0.5, abs_tol=0.02)
