"""Mixing, top-k search and the pipeline: SQL, brute force and edge cases."""

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import mixing, topk
from textloom.llm.queries import oracle_sql, queries

SCHEMA = "doc_id long, text string, source string, size long, target double, key double, copies double"


def table(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, 1.0, 1.0, 1.0) for i, t, s in rows], SCHEMA)


def water(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """Targets by cutting and sharing out again until nothing is above its cap."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    goal, cut = share * sum(sizes.values()), set()
    while True:
        left = goal - sum(most * sizes[s] for s in cut)
        total = sum(w[s] for s in names if s not in cut)
        target = {s: most * sizes[s] if s in cut else left * w[s] / total for s in names}
        over = {s for s in names if s not in cut and target[s] > most * sizes[s]}
        if not over:
            return target
        cut |= over


@pytest.mark.parametrize("seed", range(4))
def test_mix(spark, seed):
    rng = np.random.default_rng(seed)
    sources = [None, "", "Z", "a", "é", "b"][: 3 + seed % 4]
    rows = [(int(i), "w " * int(rng.geometric(0.02)), sources[int(rng.random() ** 2 * len(sources))]) for i in range(700)]
    got = mixing.mix(table(spark, rows)).collect()
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 2 * r.size and (r.size == 0 or r.taken % r.size == 0)
    assert {r.source: r.source_size for r in got} == dict(sizes)
    want = water(dict(sizes))
    for s, t in want.items():
        assert abs(target[s] - t) <= 1e-6 * max(1, t) and abs(taken[s] - t) <= max(60, 0.02 * t)
    again = mixing.mix(table(spark, rows).repartition(5)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)


def test_mix_edges(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "x y", "a"), (None, "x", None), (3, "x y", "a"), (4, "z " * 50_000, "b"), (5, "q", "b")]
    got = mixing.mix(table(spark, rows)).collect()
    assert len(got) == len(rows) and all(r.taken <= 2 * r.size for r in got)
    assert mixing.mix(table(spark, rows).limit(0)).count() == 0
    repeated = mixing.Mix(table(spark, rows)).repeated(table(spark, rows))
    assert repeated.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    assert repeated.select(F.sum(F.size(F.filter(F.split("text", " "), lambda w: w != "")))).first()[0] == sum(r.taken for r in got)


@pytest.mark.parametrize("ids", [[7], [None], [1, 2, None]])
def test_mix_of_rows_that_share_identifiers(spark, ids):
    """Targets are met, whatever identifiers repeat, and how often rows come doesn't depend on their order."""
    rows = [(ids[i % len(ids)], "w " * (1 + i * i % 37 % 9), "a" if i % 3 else "b") for i in range(4000)] + [(9000 + i, "v " * 30, "c") for i in range(200)]
    got = mixing.mix(table(spark, rows)).collect()
    taken, target = defaultdict(int), {}
    for r in got:
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - t) <= 35 for s, t in target.items())
    again = mixing.mix(table(spark, rows[::-1]).repartition(3)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)


def test_pareto_draws_follow_their_odds(spark):
    """Over many seeds, a document's share of draws comes near its inclusion probability."""
    rows = [(i, "w " * (4 if i % 2 else 60), "a" if i < 40 else "b") for i in range(80)]
    taken, rate = np.zeros(80), np.zeros(80)
    for seed in range(12):
        made = mixing.Mix(table(spark, rows), seed=str(seed))
        for r in made.copies_of(made.sized).collect():
            taken[r.doc_id] += r.taken_copies / 12
        for r in made._ranked(made.sized).collect():
            rate[r.doc_id] = r.copies
    for part in (slice(0, 40, 2), slice(1, 40, 2), slice(40, 80, 2), slice(41, 80, 2)):
        assert abs(taken[part].mean() - rate[part].mean()) < 0.12


def test_thousands_of_draws_follow_their_odds(spark):
    """Equal sources are draws of one mix: over 2,001 of them, both classes come as often as they should, and words within one document of the target."""
    n = 2001
    docs = spark.range(n).select(F.format_string("s%05d", "id").alias("source"), F.explode(F.array(*map(F.lit, [60, 4] * 20))).alias("k"))
    docs = docs.select(F.monotonically_increasing_id().alias("doc_id"), "source", F.repeat(F.lit("w "), F.col("k")).alias("text"))
    made = mixing.Mix(docs)
    rates = {(r.source, r["class"]): r.copies for r in made.rates.collect()}
    got = made.copies_of(made.sized).groupBy("source", "size").agg(F.avg("taken_copies").alias("mean"), F.sum(F.col("taken_copies") * F.col("size")).alias("words"), F.first("target").alias("target")).collect()
    words, target, draws = defaultdict(int), {}, defaultdict(list)
    for r in got:
        words[r.source] += r.words
        target[r.source] = r.target
        kind = int(r.source[1:]) % 3
        octave = (r.size + 1).bit_length() - 1
        rate = rates[r.source, octave * mixing.PARTS + ((r.size + 1) * mixing.PARTS >> octave) - mixing.PARTS]
        draws[kind, r.size].append(r["mean"] - rate)
    assert all(abs(words[s] - t) <= 60 for s, t in target.items())
    assert len(draws) == 6 and all(len(d) == n // 3 and abs(np.mean(d)) < 0.02 for d in draws.values())


@pytest.mark.parametrize("name", ["op3_mixing", "op5_norm_sorted_topk"])
def test_queries_match_sql(spark, data, duck, same_rows, name):
    same_rows(queries()[name](spark, data), duck.sql(oracle_sql()[name]))


# top-k

VSCHEMA = "vec_id long, embedding array<double>, dims int, block long, ids string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, "x") for i, v in rows], VSCHEMA)


def brute(rows, asked, k=5, scale=256):
    ok = [(i, [int(np.floor(scale * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in ok if asked(i)}):
        v = next(v for i, v in ok if i == q)
        found = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j) for j, w in ok if j != q and len(w) == len(v))[:k]
        out += [(q, n, j, -s) for n, (s, j) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_search_against_all_pairs(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [(i, (rng.normal(size=24) * rng.choice([0.1, 1, 3])).tolist()) for i in range(500)]
    rows += [(500 + i, rows[7][1]) for i in range(60)]  # many copies of one vector
    v = vectors(spark, rows)
    got = topk.search(v, v.filter("vec_id % 50 = 0"), block=64).collect()
    assert sorted(map(tuple, got)) == brute(rows, lambda i: i % 50 == 0)


def test_search_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [0.0, 0.0]), (6, [-1.0, 0.5]), (None, [1.0, 1.0]), (7, [1.0, 2.0, 3.0]), (8, []), (9, []), (10, [3e7, 1.0]), (50, [1.0, 2.0])]
    v = vectors(spark, rows)
    got = topk.search(v, v).collect()
    assert sorted(map(tuple, got)) == brute(rows, lambda i: True)
    assert topk.search(v.limit(0), v.limit(0)).count() == 0


def test_search_leaves_out_blocks_that_are_too_short(spark, monkeypatch):
    pairs, plain = [], topk.written
    monkeypatch.setattr(topk, "written", lambda df, name: pairs.append((name, t := plain(df, name))) or t)
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=24) * 0.99**i).tolist()) for i in range(900)]
    v = vectors(spark, rows)
    got = topk.search(v, v.filter("vec_id % 50 = 0"), block=64, per_block=4).collect()
    assert sorted(map(tuple, got)) == brute(rows, lambda i: i % 50 == 0)
    made = {n: t.count() for n, t in pairs}
    assert 0 < made["topk-pairs"] < 0.7 * made["topk-asked"] * (made["topk-blocks"] - 1)


def test_most_pairs_are_dropped_by_their_bounds(spark, data):
    """Vectors of nearly one length, in which Cauchy-Schwarz on whole vectors drops nothing: partial sums over more and more axes do."""
    rows = spark.read.parquet(f"{data}/embeddings.parquet").select("vec_id", "embedding").collect()
    x, ids = topk._ints(np.concatenate([r.embedding for r in rows]), 64, 256), np.array([r.vec_id for r in rows])
    order = np.argsort(-np.sqrt((x * x).sum(1)), kind="stable")
    x, ids = x[order], ids[order]
    asked, before = ids % 50 == 0, topk.counted["exact"]
    got = topk.best(x[asked], ids[asked], x, ids, topk._axes(x), 5, np.full(asked.sum(), -np.inf))
    assert topk.counted["exact"] - before < 0.5 * asked.sum() * len(ids)
    assert sorted((q, s) for q, _, s in got) == sorted((int(q), int(s)) for q, v in zip(ids[asked], x[asked], strict=True) for s in np.sort((x @ v)[ids != q])[-5:])


def test_search_of_large_integers(spark):
    """The same method beyond exact doubles: products and sums in whole numbers, cut to 64 bits in the result."""
    rng = np.random.default_rng(6)
    rows = [(i, (rng.normal(size=20) * 10.0 ** rng.integers(3, 7)).tolist()) for i in range(300)]
    v = vectors(spark, rows)
    assert sorted(map(tuple, topk.search(v, v.filter("vec_id % 50 = 0"), block=32).collect())) == brute(rows, lambda i: i % 50 == 0)
    huge = vectors(spark, [(i, [1e300 * (i - 2), 1.5]) for i in range(5)] + [(9, [0.5, 0.25])])
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.search(huge, huge.filter("vec_id = 4")).collect()}
    assert got[4, 1] == (3, (1 << 63) - 1) and got[4, 5][1] == -(1 << 63)


def test_axes_bound_products():
    for dims in (8, 64, 1100):
        x = np.random.default_rng(0).normal(size=(50, dims))
        a = topk._axes(x)
        assert a.shape == (dims, min(dims, topk.HEAD)) and np.allclose(a.T @ a, np.eye(a.shape[1]))
        rest = np.sqrt(np.maximum((x * x).sum(1) - ((x @ a) ** 2).sum(1), 0))
        assert (x @ x.T <= (x @ a) @ (x @ a).T + np.outer(rest, rest) + 1e-6).all()


# pipeline

def test_pipeline_stages(spark, data):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, before = docs.columns, docs
    sizes = [docs.count()]
    for name, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, data)
        assert docs.columns == columns, name
        docs = cp.written(docs, f"test-{name}")
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] > sizes[2] >= sizes[3]
    # Clean, unique documents reach the mix; every text stays once.
    labels = spark.read.parquet(f"{data}/labels.parquet")
    kept = cp.keep_quality(spark, before, data)
    clean = before.join(labels.filter("quality = 1"), "doc_id")
    assert clean.join(kept, "doc_id", "left_anti").count() <= 0.01 * clean.count()
    packed = cp.pack_sequences(spark, docs, data)
    assert packed.agg(F.count_distinct("sequence_id")).first()[0] > 0 and packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 2048").count() == 0


def test_pipeline_on_edges(spark):
    import corpus_pipeline as cp

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "one two three four five six seven", "en", None, 3), (3, "one two three four five six seven", "en", None, 3), (None, "x y z", None, "s", 1)]
    for data in (rows, []):
        docs, found = spark.createDataFrame(data, schema), []
        for k, (_, stage) in enumerate(cp.STAGES):
            docs = stage(spark, docs, "")
            if k + 1 < len(cp.STAGES):
                docs = cp.written(docs, "test-edge")
            found.append(sorted(((r.doc_id, r.text) if k < 4 else (r.doc_id, r.length) for r in docs.collect()), key=str))
        if not data:
            assert found == [[]] * 5
            continue
        assert found[0] == sorted(((r[0], r[1]) for r in rows), key=str)
        # One row of each text: the smallest identifier, and null and empty are equal.
        once = [(i, t or "") for i, t in found[1]]
        assert sorted(once, key=str) == sorted([(1, ""), (3, rows[2][1]), (None, "x y z")], key=str)
        assert found[2] == found[1]
        # Both sources take 150 % of the words at most twice; what is taken is packed whole, each row with its end.
        assert set(found[3]) <= set(found[2]) and all(found[3].count(x) <= 2 for x in found[3])
        assert [i for i, _ in found[4]] == [i for i, _ in found[3]] and sum(n for _, n in found[4]) > len(found[4])


def test_mix_with_many_sources_needs_no_broadcast(spark, monkeypatch):
    rows = [(i, "w " * (i % 9), f"s{i % 6}") for i in range(200)]
    small = sorted(map(tuple, mixing.mix(table(spark, rows)).collect()))
    monkeypatch.setattr(mixing, "FEW", 0)
    assert sorted(map(tuple, mixing.mix(table(spark, rows)).collect())) == small
