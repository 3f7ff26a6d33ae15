"""The stored index: versions, buckets, retrieval with bounds against the exhaustive one, features of pairs."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from textloom import queries as Q
from textloom.functions import arrays as A
from textloom.operators import index as IX
from textloom.operators import retrieval as B
from textloom.sources import store as ST


def corpus(spark, texts):
    rows = [(i, t.split(" ")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc long, text array<string>").withColumn("head", F.slice("text", 1, 3))


def indexed(spark, texts, name="test"):
    return IX.stored(spark, name, corpus(spark, texts), "doc", ("text", "head"), "text")


def kept(index):
    return lambda df, name: index.store.scratch(df, name)


def bm25(texts, query, k):
    """The k best documents by plain loops, zero scores filled up in order."""
    docs = [[w for w in t.split(" ") if w] for t in texts]
    df = Counter(w for d in docs for w in set(d))
    n, mean = len(docs), sum(map(len, docs)) / max(1, len(docs))
    raw = {w: math.log(n - f + 0.5) - math.log(f + 0.5) for w, f in df.items()}
    floor = 0.25 * sum(raw.values()) / max(1, len(raw))
    idf = {w: floor if x < 0 else x for w, x in raw.items()}
    scores = []
    for d in docs:
        tf = Counter(d)
        scores.append(round(sum(idf[w] * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(d) / mean)) for w in set(query.split(" ")) if tf[w]), 9))
    order = sorted(range(n), key=lambda i: (-scores[i], i))[:k]
    return [(i, scores[i]) for i in order]


def texts_of(seed, n):
    rng = random.Random(seed)
    common, rare = ["the", "of", "and", "in"], [f"w{i}" for i in range(60)]
    return [" ".join(rng.choices(common, k=rng.choice([0, 3, 9])) + rng.choices(rare, k=rng.choice([0, 1, 4, 30]), weights=[1 / (i + 1) for i in range(60)])) for _ in range(n)]


@pytest.mark.parametrize(("seed", "n", "bits"), [(1, 400, 2), (2, 90, 1), (3, 12, 7)])
def test_topk_equals_the_exhaustive_search(spark, monkeypatch, seed, n, bits):
    """Few blocks, many small ones, ties, common terms of negative idf, queries with fewer hits than answers, unknown terms and no terms."""
    monkeypatch.setattr(IX, "BLOCK_BITS", bits)
    texts = texts_of(seed, n) + ["same text w1", "same text w1"]
    index = indexed(spark, texts, f"topk{seed}")
    rng = random.Random(seed)
    asked = [" ".join(rng.choices(["the", "of", *(f"w{i}" for i in range(64))], k=k)) for k in (1, 2, 5, 12, 40)] + ["unknown", "the of", "w1", "w59 w58 the the"]
    queries = spark.createDataFrame([(i, q.split(" ")) for i, q in enumerate(asked)] + [(99, [])], "q long, ts array<string>")
    got = {}
    for r in IX.topk(queries, "q", "ts", index, 7, kept(index)).orderBy("q", "rank").collect():
        got.setdefault(r.q, []).append((r.doc, r.score))
    for i, q in [*enumerate(asked), (99, "")]:
        want = bm25(texts, q, 7)
        assert [d for d, _ in got[i]] == [d for d, _ in want], q
        assert all(abs(a - b) < 1e-6 for (_, a), (_, b) in zip(got[i], want, strict=True))


def test_an_empty_corpus_and_no_queries(spark):
    index = indexed(spark, [], "empty")
    queries = spark.createDataFrame([(1, ["a"])], "q long, ts array<string>")
    assert IX.topk(queries, "q", "ts", index, 3, kept(index)).count() == 0
    index = indexed(spark, ["a b"], "none")
    assert IX.topk(queries.limit(0), "q", "ts", index, 3, kept(index)).count() == 0


def test_below_half_of_the_blocks_are_read(spark, monkeypatch, data):
    """In blocks of 16, as a small table has few of them."""
    monkeypatch.setattr(IX, "BLOCK_BITS", 4)
    index = IX.stored(spark, "small-blocks", Q._field_docs(spark, data).select("doc_id", "abst"), "doc_id", ("abst",), "abst")
    read = IX.search(Q._items(spark, data), "item_id", "ts", index, 10, kept(index)).read.agg(F.sum("read").alias("read"), F.sum("blocks").alias("blocks")).first()
    assert 0 < read.read < read.blocks / 2


def test_versions_follow_the_input(spark, tmp_path):
    """The same files give the same store, built once; a changed file another one, and rows without files go by what they hold."""
    path = f"{tmp_path}/docs.parquet"
    corpus(spark, ["a b", "b c"]).write.parquet(path)
    built = []

    def build(s):
        built.append(s)
        s.put("t", spark.read.parquet(path).select("doc"), ["doc"])

    one = ST.store(spark, "v", ST.fingerprint(spark.read.parquet(path)), build)
    again = ST.store(spark, "v", ST.fingerprint(spark.read.parquet(path)), build)
    assert one is again and len(built) == 1
    corpus(spark, ["a b", "b c", "d"]).write.mode("overwrite").parquet(path)
    other = ST.store(spark, "v", ST.fingerprint(spark.read.parquet(path)), build)
    assert other.folder != one.folder and other.get("t").count() == 3 and len(built) == 2
    prints = [ST.fingerprint(corpus(spark, t)) for t in (["a"], ["a"], ["b"])]
    assert prints[0] == prints[1] != prints[2]


def test_a_store_is_found_again_and_a_broken_one_is_built_anew(spark, monkeypatch):
    rows = spark.range(100).withColumn("x", F.col("id") * 2)

    def fails(s):
        s.put("t", rows, ["id"])
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        ST.store(spark, "broken", "1", fails)
    made = ST.store(spark, "broken", "1", lambda s: (s.put("t", rows, ["id"], ["x"], 3), s.facts.update(n=7)))
    spark.sql(f"DROP TABLE {made._name('t')}")  # as in a session that hasn't built it
    monkeypatch.setattr(ST, "_open", {})
    found = ST.store(spark, "broken", "1", fails)
    assert found.facts == {"n": 7} and found.get("t").count() == 100 and found.get("t").agg(F.sum("x")).first()[0] == 9900


def test_joins_on_a_bucketed_key_need_no_exchange(spark):
    one, two = (ST.store(spark, "buckets", "1", lambda s: (s.put("a", spark.range(1000), ["id"], [], 4), s.put("b", spark.range(500), ["id"], [], 4))).get(t) for t in ("a", "b"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = one.join(two, "id")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange" not in plan and "SortMergeJoin" in plan


def test_term_counts(spark):
    rows = [(["b", "a", "b", "é", "a", "b"],), (["x"],), ([],)]
    got = spark.createDataFrame(rows, "t array<string>").select(A.term_counts("t").alias("c")).collect()
    assert [[tuple(x) for x in r.c] for r in got] == [[("a", 2), ("b", 3), ("é", 1)], [("x", 1)], []]


def test_pair_scores_equal_the_joined_ones(spark):
    """One pass over shared terms gives what scoring each field and each distance by itself gives."""
    texts = [t for t in texts_of(5, 40) if t]
    docs = corpus(spark, texts)
    index = IX.stored(spark, "pairs", docs, "doc", ("text", "head"), "text")
    items = spark.createDataFrame([(1, "w1 the w2 zzz".split(" "), ["w1"]), (2, ["zzz"], []), (3, texts[3].split(" "), ["the", "the", "w0"])], "q long, ts array<string>, ks array<string>")
    pairs = items.select("q").crossJoin(docs.select("doc")).join(items, "q")
    got = {(r.q, r.doc): r for r in IX.pair_scores(pairs, "q", ("ts", "ks"), ("text", "head"), index, "text", kept(index)).collect()}
    scores = B.bm25_pair_scores(pairs, "q", ["ts", "ks"], {f: B.build_index(docs, "doc", f) for f in ("text", "head")})
    for r in scores.collect():
        for c in (f"{k}_{f}_bm25_score" for k in ("ts", "ks") for f in ("text", "head")):
            assert abs(got[r.q, r.doc][c] - r[c]) < 1e-9
    df, stats = B.doc_freq(B.bag_of_words(docs, "doc", "text")), B.corpus_stats(docs, "text")
    for k in ("ts", "ks"):
        for f in ("text", "head"):
            sides = B.tfidf(B.bag_of_words(items, "q", k), df, stats, "q"), B.tfidf(B.bag_of_words(docs, "doc", f), df, stats, "doc")
            for r in B.distances(pairs.select("q", "doc"), *sides, "q", "doc", f"{k}_tfidf_{f}").collect():
                for c in ("cos", "eucl", "manh"):
                    a, b = got[r.q, r.doc][f"{k}_tfidf_{f}_{c}_dis"], r[f"{k}_tfidf_{f}_{c}_dis"]
                    assert (a is None) == (b is None) and (a is None or abs(a - b) < 1e-6)
