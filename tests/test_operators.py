"""Edge cases: ties, nulls, short groups, empty inputs; and properties."""

import heapq
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.functions import text as X
from textloom.operators import embedding as E
from textloom.operators import learners as L
from textloom.operators import metrics as M
from textloom.operators import ranking as K
from textloom.operators import relational as R
from textloom.operators import retrieval as B
from textloom.operators import scaling as C
from textloom.operators import text as T
from textloom.sources import io


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc int, text string").select("doc", X.tokens("text").alias("ts"))


def queries(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "q int, text string").select("q", X.tokens("text").alias("ts"))


def test_bm25_ties_and_fill(spark):
    index = B.build_index(docs(spark, "x y", "a b", "a b", "z z", "u v"), "doc", "ts")
    got = B.bm25_topk(queries(spark, "a", "none"), "q", "ts", index, 3).orderBy("q", "rank").collect()
    assert [(r.q, r.doc, r.rank) for r in got] == [(0, 1, 1), (0, 2, 2), (0, 0, 3), (1, 0, 1), (1, 1, 2), (1, 2, 3)]
    assert [r.score > 0 for r in got] == [True, True, False, False, False, False]


def test_bm25_more_than_the_corpus(spark):
    index = B.build_index(docs(spark, "a", "b"), "doc", "ts")
    assert B.bm25_topk(queries(spark, "a"), "q", "ts", index, 9).count() == 2


def test_bm25_negative_scores_stand_behind_zero(spark):
    index = B.build_index(docs(spark, "a b", "a b", "a b", "a b", "a b", ""), "doc", "ts")
    got = B.bm25_topk(queries(spark, "a"), "q", "ts", index, 2).orderBy("rank").collect()
    assert [(r.doc, r.score == 0) for r in got] == [(5, True), (0, False)] and got[1].score < 0


def bm25(q, corpus, k1=1.5, b=0.75):
    n, df = len(corpus), {}
    for d in corpus:
        for t in set(d):
            df[t] = df.get(t, 0) + 1
    idf = {t: np.log(n - f + 0.5) - np.log(f + 0.5) for t, f in df.items()}
    mean = np.mean(list(idf.values()))
    idf = {t: 0.25 * mean if x < 0 else x for t, x in idf.items()}
    avg = np.mean([len(d) for d in corpus])
    return [sum(idf[t] * d.count(t) * (k1 + 1) / (d.count(t) + k1 * (1 - b + b * len(d) / avg)) for t in set(q) if t in d) for d in corpus]


def test_bm25_against_a_plain_model(spark):
    rng = np.random.default_rng(3)
    corpus = [" ".join(rng.choice(list("abcdefgh"), rng.integers(1, 9))) for _ in range(12)]
    index = B.build_index(docs(spark, *corpus), "doc", "ts")
    got = {r.doc: r.score for r in B.bm25_scores(queries(spark, "a b a"), "q", "ts", index).collect()}
    want = bm25("a b a".split(), [c.split() for c in corpus])
    assert all(abs(got.get(i, 0.0) - w) < 1e-8 for i, w in enumerate(want))


def test_tfidf_unit_length_and_distances(spark):
    d = docs(spark, "a b", "a c", "", "d d")
    bow = B.bag_of_words(d, "doc", "ts")
    v = B.tfidf(bow, B.doc_freq(bow), B.corpus_stats(d, "ts"), "doc")
    assert all(abs(r.s - 1) < 1e-9 for r in v.groupBy("doc").agg(F.sum(F.col("w") * F.col("w")).alias("s")).collect())
    pairs = spark.createDataFrame([(0, 0), (0, 1), (0, 2), (0, 3)], "x int, doc int")
    got = {r.doc: r for r in B.distances(pairs, v.withColumnRenamed("doc", "x"), v, "x", "doc", "p").collect()}
    assert abs(got[0].p_cos_dis - 1) < 1e-9 and got[0].p_eucl_dis < 1e-6 and got[2].p_cos_dis is None and abs(got[3].p_eucl_dis - 2**0.5) < 1e-9


def test_listwise_single_prediction_has_no_deviation(spark):
    df = spark.createDataFrame([(1, 1, 0.5), (2, 1, 0.5), (2, 2, 0.5)], "q int, p int, s double")
    got = {(r.q, r.p): r for r in K.listwise(df, "q", "p", "s").collect()}
    assert got[1, 1].top2_pred_std is None and got[2, 1].top2_pred_std == 0 and got[2, 2].pred_sub_top1 == 0


def test_top3_of_short_groups(spark):
    df = spark.createDataFrame([(1, 7, 0.5), (2, 1, 0.1), (2, 2, 0.9)], "q int, p int, s double")
    assert [tuple(r) for r in K.top3_wide(df, "q", "p", "s").orderBy("q").collect()] == [(1, 7, None, None), (2, 2, 1, None)]


def test_auc_ties_and_single_class(spark):
    df = spark.createDataFrame([(1, 0.5), (0, 0.5), (1, 0.9), (0, 0.1)], "y int, p double")
    assert M.auc(df, "y", "p").first().auc == 0.875
    assert M.auc(df.filter("y = 1"), "y", "p").first().auc is None


def test_group_correlation_of_constants(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (1, 1.0, 3.0), (2, 1.0, 1.0), (2, 2.0, 2.0)], "g int, a double, b double")
    assert M.group_correlation(df, "g", ["a", "b"]).first().mean_corr == 0.5


def test_map_counts_missing_items(spark):
    ranked = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.8), (2, 1, 0.5)], "q int, p int, s double")
    gold = spark.createDataFrame([(1, 2), (2, 9), (3, 1)], "q int, p int")
    assert abs(M.map_at(ranked, "q", "p", "s", gold).first()[0] - round(0.5 / 3, 6)) < 1e-9


def test_explode_parallel_arities(spark):
    df = spark.createDataFrame([(1, "a|b", "1|2"), (2, None, None), (3, "x", "9|8")], "id int, w string, n string")
    assert sorted(map(tuple, R.explode_parallel(df, "w", "n").collect())) == [(1, "a", "1"), (1, "b", "2"), (3, "x", "9")]


def test_null_keys_and_inequality(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "id int, s string")
    assert sorted(r.id for r in df.filter(R.differs("s", "a")).collect()) == [2, 3]


def test_natural_join_needs_shared_columns(spark):
    with pytest.raises(ValueError):
        R.natural_join(spark.range(1).toDF("a"), spark.range(1).toDF("b"))


def test_minmax_of_constant_and_small_columns(spark):
    df = spark.createDataFrame([(5.0, 0.2), (5.0, 0.4)], "a double, b double")
    assert [tuple(r) for r in C.minmax_scale(df, ["a", "b"]).collect()] == [(0.0, 0.2), (0.0, 0.4)]


def test_outer_by_key_fills(spark):
    a, b = spark.createDataFrame([(1, 0.5)], "k int, v double"), spark.createDataFrame([(2, 0.7)], "k int, v double")
    assert sorted(map(tuple, R.outer_by_key({"a": a, "b": b}, ["k"], "v").collect())) == [(1, 0.5, 0.0), (2, 0.0, 0.7)]


def test_downcast(spark):
    df = spark.createDataFrame([(1, 300, 1 << 40, 0.5)], "a long, b long, c long, d double")
    assert [t for _, t in R.downcast(df).dtypes] == ["tinyint", "smallint", "bigint", "float"]


def test_cooccurrence_counts_known_words_only(spark):
    d = docs(spark, "a x b", "a b")
    ranked = spark.createDataFrame([("a", 1), ("b", 2)], "word string, rank long")
    assert sorted(map(tuple, E.cooccurrence(d, "doc", "ts", ranked, 2, symmetric=False).collect())) == [(1, 2, 2.0)]
    assert sorted(map(tuple, E.cooccurrence(d, "doc", "ts", ranked, 2).collect())) == [(1, 2, 2.0), (2, 1, 2.0)]


def test_lemmas_keep_order(spark):
    lemmas = spark.createDataFrame([("cats", "cat")], "token string, lemma string")
    got = {r.doc: r.lemmas for r in T.lemmatize(docs(spark, "two cats two", ""), "doc", "ts", lemmas).collect()}
    assert got == {0: ["two", "cat", "two"], 1: []}


def test_vocabulary_files(spark, tmp_path):
    (tmp_path / "v.txt").write_text("b 2\na 2\nc 5\n")
    assert sorted(map(tuple, io.vocabulary(spark, str(tmp_path / "v.txt")).collect()), key=lambda r: r[2]) == [("c", 5, 1), ("a", 2, 2), ("b", 2, 3)]
    (tmp_path / "w.txt").write_text("2 3\na 1 2 3\nb 4 5 6\n")
    v = io.vectors(spark, str(tmp_path / "w.txt"))
    assert {r.word: list(r.vector) for r in v.collect()} == {"a": [1, 2, 3], "b": [4, 5, 6]}
    io.save_vectors(v, str(tmp_path / "out"))
    assert io.vectors(spark, str(tmp_path / "out")).count() == 2
    np.arange(6, dtype="<f8").tofile(tmp_path / "m.bin")
    assert [list(r["values"]) for r in io.binary_vectors(spark, str(tmp_path / "m.bin"), 2).orderBy("row").collect()] == [[0, 1, 2], [3, 4, 5]]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.123456, 1)], "id int, p double, y int")
    io.save_predictions(df, str(tmp_path / "p"), ["id"], "p", "y")
    assert spark.read.csv(str(tmp_path / "p"), header=True).first().target == "0.1235"
    for f, cols in ((io.save_headerless, None), (io.save_tabbed, None)):
        f(df, str(tmp_path / f.__name__))
        assert spark.read.text(str(tmp_path / f.__name__)).count() >= 1
    io.save_lines(df, str(tmp_path / "l"), ["id", "y"])
    assert spark.read.text(str(tmp_path / "l")).first().value == "1,1"
    io.save(df, str(tmp_path / "t.parquet"))
    assert io.load(spark, str(tmp_path / "t.parquet"), rows=1).count() == 1
    with pytest.raises(FileNotFoundError):
        io.require(spark, str(tmp_path / "t.parquet"), str(tmp_path / "missing"))


def test_k_fold_passes_over_a_bounded_number_of_partitions(spark):
    df = spark.range(0, 400, 1, 64).select("id", (F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 2).cast("int").alias("target"), (F.col("id") % 2 + 1).cast("int").alias("cv"))
    out = L.boosted(df, L.Variant("v", rounds=1, depth=1), ["id"]).out_of_fold
    assert out.rdd.getNumPartitions() <= 2 * L.TASKS * spark.sparkContext.defaultParallelism < 2 * 64 and out.count() == 400


def test_k_fold_covers_every_row_once_and_resumes(spark, tmp_path):
    rows = [(i, float(i % 7), int(i % 7 > 3), i % 3 + 1) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, x double, target int, cv int")
    made = L.boosted(df, L.Variant("v", rounds=2, depth=2), ["id"], test=df.select("id", "x"), path=str(tmp_path / "m"))
    assert made.out_of_fold.count() == 60 and made.out_of_fold.select("id").distinct().count() == 60 and made.test.count() == 60
    again = L.boosted(df, L.Variant("v", rounds=2, depth=2), ["id"], path=str(tmp_path / "m"))
    a, b = ({r.id: r.target for r in m.out_of_fold.collect()} for m in (made, again))
    assert a == b
    assert made.metrics().count() == 3 and made.importance(spark).first().feature == "x"


def test_pairwise_samples_draw_negatives_of_the_query(spark):
    df = spark.createDataFrame([(1, 1, 1), (1, 2, 0), (1, 3, 0), (2, 4, 0)], "q int, p int, y int")
    got = K.pairwise_samples(df, "q", "p", "y", positives=2, negatives=1).collect()
    assert len(got) == 2 and all(r.positive == 1 and r.negative in (2, 3) for r in got)


def test_results_do_not_depend_on_partitions(spark, data):
    from textloom.queries import _docs, _items

    a = B.bm25_topk(_items(spark, data), "item_id", "ts", B.build_index(_docs(spark, data), "doc_id", "ts"), 5)
    b = B.bm25_topk(_items(spark, data).repartition(7), "item_id", "ts", B.build_index(_docs(spark, data).repartition(13), "doc_id", "ts"), 5)
    rows = lambda df: sorted((r.item_id, r["rank"], r.doc_id, round(r.score, 6)) for r in df.collect())
    assert rows(a) == rows(b)


def test_draws_of_pairs_stay_in_their_query(spark):
    rows = [(q, 100 * q + i, int(i < 3)) for q, n in ((1, 20), (2, 5), (3, 3)) for i in range(n)] + [(4, 401, 0)]
    got = K.pairwise_samples(spark.createDataFrame(rows, "q long, i long, y int"), "q", "i", "y", 6, 10).collect()
    sizes = {}
    for r in got:
        assert r.positive // 100 == r.negative // 100 == r.q and r.positive % 100 < 3 <= r.negative % 100
        sizes.setdefault((r.q, r.positive, r.draw), []).append(r.negative)
    assert all(len(set(v)) == len(v) == min(10, {1: 17, 2: 2}[q]) for (q, _, _), v in sizes.items()) and len(sizes) == 2 * 3 * 6


def test_cooccurrence_records(spark, tmp_path):
    x = np.array([(i, i + 1, i / 2) for i in range(1000)], io.RECORD)
    x.tofile(tmp_path / "a.bin")
    got = io.cooccurrences(spark, f"file://{tmp_path}/a.bin", size=64).orderBy("w1").collect()
    assert [tuple(r) for r in got] == x.tolist()


def test_vectors_of_one_component(spark, tmp_path):
    (tmp_path / "v.txt").write_text("2 1\na 0.5\nb -1.0\n")
    assert [(r.word, r.vector) for r in io.vectors(spark, f"file://{tmp_path}/v.txt").orderBy("word").collect()] == [("a", [0.5]), ("b", [-1.0])]


def test_random_vectors_follow_from_the_word(spark):
    words = spark.createDataFrame([("a",), ("a",), ("b",)], "word string")
    got = E.fallback_lookup(words, "word", spark.createDataFrame([], "word string, vector array<double>"), None, dims=400).orderBy("word").collect()
    a, again, b = (np.array(r.vector) for r in got)
    assert (a == again).all() and (a != b).any() and abs(a.mean()) < 0.2 and abs(a.std() - 1) < 0.15


def test_glove_modes():
    import pandas as pd

    v = pd.DataFrame({"rank": [1], "vector": [np.array([1.0, 2.0])], "context": [np.array([3.0, 4.0])], "bias": [5.0], "context_bias": [6.0]})
    assert [E.glove_rows(v, m)["values"][0].tolist() for m in (0, 1, 2)] == [[1, 2, 5, 3, 4, 6], [1, 2], [4, 6]]


def test_boosting_stops_early(spark):
    rng = np.random.default_rng(1)
    rows = [(i, float(rng.normal()), int(rng.random() < 0.5), i % 2 + 1, None if i % 5 else "no-content", 1.0) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, x double, target int, cv int, journal string, year double")
    out = L.boosted(df, L.Variant("v", drop=("year",), rows=L.FILTERED, rounds=12, depth=2), ["id"])
    assert out.features == ["x"] and out.out_of_fold.count() == 200 and all(m.getNumTrees < 12 for m in out.models.values()), [m.getNumTrees for m in out.models.values()]


def test_blend_keeps_a_score_without_log_odds(spark):
    a = spark.createDataFrame([(1, 0.5), (2, 1.12)], "k long, p double")
    b = spark.createDataFrame([(2, 0.5), (3, 0.5)], "k long, p double")
    out = {r.k: r.score for r in C.blend({"a": a, "b": b}, ["k"], "p", {"a": 1.0, "b": 2.0}).collect()}
    assert out[1] == 0 and math.isnan(out[2]) and out[3] == 0


# word2vec

def test_huffman_tree_is_the_shortest():
    counts = sorted([1, 1, 2, 3, 5, 8, 8, 40, 41], reverse=True)
    parent, second, depth = E.huffman(counts)
    heap = list(counts)
    heapq.heapify(heap)
    least = 0
    while len(heap) > 1:
        heapq.heappush(heap, one := heapq.heappop(heap) + heapq.heappop(heap))
        least += one
    assert sum(n * depth[k] for k, n in enumerate(counts)) == least and parent[-1] == -1
    assert sorted((p, s) for p, s in zip(parent[:-1].tolist(), second[:-1].tolist(), strict=True)) == [(p, s) for p in range(9, 17) for s in (False, True)]


def test_skip_gram_steps_are_those_of_single_places(monkeypatch):
    monkeypatch.setattr(E, "TAKEN", 1)
    tree = parent, second, depth = E.huffman([9, 5, 3, 2, 2, 1])
    ids, of = np.array([0, 1, 2, 0, 3, 4, 5, 1, 0]), np.array([0, 0, 0, 0, 0, 1, 1, 1, 2])
    w, c = np.random.default_rng(1).normal(size=(6, 4)).astype(np.float32), np.zeros((6, 4), np.float32)
    c[:5] = np.random.default_rng(2).normal(size=(5, 4))
    own_w, own_c = w.astype(float), c.astype(float)
    reach = np.random.default_rng(3).integers(1, 3, len(ids))
    for i in range(len(ids)):
        path, node = [], ids[i]
        while parent[node] >= 0:
            path.append((parent[node] - 6, 1.0 - second[node]))
            node = parent[node]
        near = [j for j in range(len(ids)) if 0 < abs(j - i) <= reach[i] and of[j] == of[i]]
        g = {(j, n): 0.1 * (want - 1 / (1 + np.exp(-own_w[ids[j]] @ own_c[n]))) for j in near for n, want in path}
        up_w, up_c = np.zeros_like(own_w), np.zeros_like(own_c)
        for (j, n), x in g.items():
            up_w[ids[j]] += x * own_c[n]
            up_c[n] += x * own_w[ids[j]]
        own_w, own_c = own_w + up_w, own_c + up_c
    E._skip_gram(w, c, ids, of, tree, 2, 0.1, np.random.default_rng(3))
    assert np.allclose(w, own_w, atol=1e-4) and np.allclose(c, own_c, atol=1e-4)


def test_word2vec_learns_and_leaves_no_word_out(spark):
    rng = np.random.default_rng(1)
    rows = [([f"{'ab'[k % 2]}{x}" for x in rng.integers(0, 8, 30)],) for k in range(300)] + [(None,), ([],), (["alone"],), (["alone"],), (["rare", "a1"],)]
    df = spark.createDataFrame(rows, "ts array<string>").repartition(6)
    got = {r.word: np.array(r.vector) for r in E.word2vec(df, "ts", dims=8, window=3, least=2, rounds=6, rate=0.1, partitions=3).collect()}
    assert set(got) == {f"{t}{x}" for t in "ab" for x in range(8)} | {"alone"} and all(len(v) == 8 and np.isfinite(v).all() for v in got.values())
    unit = {w: v / np.linalg.norm(v) for w, v in got.items() if w != "alone"}
    like = {same: np.mean([unit[a] @ unit[b] for a in unit for b in unit if a < b and (a[0] == b[0]) == same]) for same in (True, False)}
    assert like[True] > like[False] + 0.5
    assert E.word2vec(df.limit(0), "ts", dims=4, rounds=1).count() == 0
    assert E.word2vec(df, "ts", dims=4, least=5, rounds=1).select(F.size("vector")).distinct().collect() == [(4,)]
