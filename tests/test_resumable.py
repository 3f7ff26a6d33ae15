"""A flow that is lost after any stage ends with the same tables, and makes nothing twice."""

import numpy as np
import pytest

from textloom.operators import boosting as G
from textloom.plans import resumable
from textloom.sources import store as ST


def rows(spark, seed=1, items=30, test=False):
    rng = np.random.default_rng(seed)
    out = []
    for q in range(items):
        for k in range(8):
            a, b = rng.normal(size=2)
            out.append((q, 100 + k, int(k == 0), q % 3 + 1, float(a + 2 * (k == 0)), float(b)))
    df = spark.createDataFrame(out, "q long, d long, target int, cv int, a double, b double")
    return df.drop("target", "cv") if test else df


VARIANTS = [G.Trees("one", ["a", "b"], rounds=2, rate=0.3, least_rows=5, leaves=4), G.Trees("two", ["a"], rounds=2, rate=0.3, least_rows=5, symmetric=True, levels=2)]
STAGES = ["models", "out-of-fold", "blend", "test", "test-blend", "answers", "scores"]


def flow(spark, name, variants=VARIANTS, monkeypatch=None, lost=None, seed=1):
    ledger = resumable.Ledger(spark, name)
    if lost:
        plain = ledger.stage

        def stage(of, *a, **k):
            if of == lost:
                raise RuntimeError(f"lost in {of}")
            return plain(of, *a, **k)

        ledger.stage = stage
    df = rows(spark, seed)
    return ledger, resumable.run(ledger, df, "q", "d", variants, df.filter("target = 1").select("q", "d"), rows(spark, 9, 4, True))


def told(made):
    return [sorted(map(tuple, t.collect()), key=str) for t in (made.predictions, made.test, made.answers, made.scores)]


def test_a_lost_run_goes_on(spark, monkeypatch):
    ledger, whole = flow(spark, "whole")
    assert ledger.made == STAGES
    want = told(whole)
    scores = {r.cv: r for r in whole.scores.collect()}
    assert set(scores) == {0, 1, 2, 3} and scores[0].queries == 30 and scores[0].map_at > 0.6
    assert whole.answers.count() == 4 and whole.test.count() == 32 and whole.predictions.count() == 240
    for n, lost in enumerate(["blend", "answers"]):
        with pytest.raises(RuntimeError):
            flow(spark, f"lost{n}", lost=lost)
        monkeypatch.setattr(ST, "_open", {})  # as in a new process
        ledger, again = flow(spark, f"lost{n}")
        assert ledger.made == STAGES[STAGES.index(lost) :]
        assert told(again) == want
    ledger, again = flow(spark, "whole")
    assert ledger.made == [] and told(again) == want


def test_only_what_depends_on_a_change_is_made_anew(spark):
    flow(spark, "changed")
    ledger, _ = flow(spark, "changed", variants=[VARIANTS[0], G.Trees("two", ["b"], rounds=1)])
    assert ledger.made == STAGES
    ledger = resumable.Ledger(spark, "changed")
    df = rows(spark)
    resumable.run(ledger, df, "q", "d", VARIANTS, df.filter("target = 1 AND q < 9").select("q", "d"), rows(spark, 9, 4, True))
    assert ledger.made == ["scores"]
