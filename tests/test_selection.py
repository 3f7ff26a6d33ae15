"""Exact quantiles and ranks without an ordered column."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textloom.operators import metrics as M
from textloom.operators import scaling as C
from textloom.operators import selection as S

NAN, INF = float("nan"), float("inf")


@given(st.lists(st.floats(allow_nan=False), min_size=1, max_size=50))
@settings(max_examples=200, deadline=None)
def test_keys_order_as_the_numbers(xs):
    xs = np.array(xs) + 0.0
    keys = S.keys_of(xs)
    assert (np.sort(xs) == S.values_of(np.sort(keys))).all()
    assert S.keys_of(np.array([NAN]))[0] > S.keys_of(np.array([INF]))[0] and S.keys_of(np.array([-0.0])) == S.keys_of(np.array([0.0]))


@pytest.mark.parametrize("seed", [1, 2])
def test_quantiles_equal_numpy(spark, seed):
    """Columns of other sizes and shapes at once: skewed, constant, with nulls, with infinite values, empty."""
    rng = random.Random(seed)
    rows = [(rng.gauss(0, 10 ** rng.randint(-9, 9)), 1e-9 if rng.random() < 0.97 else rng.random() * 1e9, 7.0, rng.choice([None, 1.0, 2.0]), rng.choice([-INF, INF, 0.0, -0.0, 5e-324]), None) for _ in range(777)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double, f double").repartition(5)
    qs = [0.0, 0.01, 0.5, 0.77, 0.99, 1.0]
    got = S.quantiles(df, {c: qs for c in "abcdef"})
    for i, c in enumerate("abcd"):
        want = np.quantile([r[i] for r in rows if r[i] is not None], qs)
        assert np.allclose(got[c], want, rtol=1e-12, atol=0)
    assert got["e"][0] == -INF and got["e"][-1] == INF and got["f"] == [None] * 6


def test_ranks_are_exact(spark):
    xs = [float(x) for x in random.Random(3).choices(range(-50, 50), k=1000)]
    got = S.ranked(spark.createDataFrame([(x,) for x in xs], "x double"), {"x": range(0, 1000, 37)})["x"]
    assert got == {r: sorted(xs)[r] for r in range(0, 1000, 37)}


def test_edges_split_skewed_values_evenly(spark):
    rows = [(math.exp(random.Random(i).gauss(0, 9)),) for i in range(4000)]
    cuts = S.edges(spark.createDataFrame(rows, "x double"), ["x"], 16)["x"]
    sizes = np.bincount(np.searchsorted(cuts, [x for x, in rows], side="right"))
    assert len(cuts) == 15 and sizes.max() <= 252
    assert S.edges(spark.createDataFrame([(1.0,)] * 9, "x double"), ["x"], 4)["x"] == [1.0]


def test_auc_of_skewed_scores(spark):
    rng = random.Random(5)
    rows = [(i % 3, int(rng.random() < 0.3), 1e-12 * rng.random() if rng.random() < 0.99 else 1e6) for i in range(2000)]
    got = {r.g: r.auc for r in M.auc(spark.createDataFrame(rows, "g int, y int, p double"), "y", "p", ["g"]).collect()}
    for g in range(3):
        pos, neg = ([p for k, y, p in rows if k == g and y == v] for v in (1, 0))
        want = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))
        assert abs(got[g] - want) < 1e-5


def test_plan_has_no_percentile(spark):
    df = spark.createDataFrame([(1.0, None), (3.0, None)], "x double, y double")
    out = C.quantile_scale(df, ["x", "y"], 0.5)
    assert "percentile" not in out._jdf.queryExecution().toString()
    assert [tuple(r) for r in out.collect()] == [(0.5, None), (1.5, None)]
