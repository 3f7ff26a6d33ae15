"""Classifiers and language model: held-out accuracy, what the methods promise, and edge cases."""

import random
import re
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textloom.llm import lm, quality, toxicity
from textloom.llm.linear import fit
from textloom.llm.queries import queries

SCHEMA = "doc_id long, text string, label int, score double, pattern string, n long"
EDGE = [(1, None), (2, ""), (3, "word"), (None, "no id"), (4, "x " * 200_000), (5, " \n\t"), (5, "twice"), (5, "twice")]


def table(spark, rows):
    return spark.createDataFrame([(i, t, 0, 0.5, "p", 1) for i, t in rows], SCHEMA)


# toxicity

def test_toxicity_held_out(spark, data):
    got = queries()["op1_toxicity"](spark, data)
    rows = got.join(spark.read.parquet(f"{data}/labels.parquet"), "doc_id").collect()
    assert got.count() == spark.read.parquet(f"{data}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    held = [r for r in rows if r.held_out]
    hit = sum(r.predicted for r in held if r.toxic)
    assert hit >= 0.7 * sum(r.toxic for r in held) and sum(r.predicted for r in held if not r.toxic) <= 0.03 * len(held)


def test_toxicity_never_learns_from_held_out_rows(spark):
    rows = [(i, ("awful words here", "kind words there", "nothing at all")[i % 3]) for i in range(400)]
    labels = [(i, int(i % 3 == 0)) for i, _ in rows]
    other = [(i, y if zlib.crc32(str(i).encode()) % 3 != 1 else 1 - y) for i, y in labels]
    scores = []
    for ls in (labels, other):
        model = toxicity.train(table(spark, rows), spark.createDataFrame(ls, "doc_id long, toxic int"))
        scores.append([model.score(t) for t in ("awful", "kind")])
    assert scores[0] == scores[1] and scores[0][0] > 0.7 > 0.3 > scores[0][1]


def test_counterfactual_penalty_shrinks_the_effect_of_group_names(spark):
    # Toxic sentences name women far more often; without the penalty the name alone is evidence.
    rows, labels = [], []
    for i in range(900):
        toxic, named = i % 3 == 0, i % 3 == 0 or i % 18 == 1
        insult = "vile" if toxic and i % 2 else "so"
        rows.append((i, f"{'women' if named else 'people'} are {insult} here number n{i}"))
        labels.append((i, int(toxic)))
    effect = {}
    for fair in (0.0, 50.0):
        model = toxicity.train(table(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"), fair=fair)
        logit = lambda t, m=model: np.log(m.score(t) / (1 - m.score(t)))
        effect[fair] = abs(logit("women are here") - logit("men are here"))
        assert logit("people are vile here") > logit("people are here")
    assert effect[50.0] < 0.5 * effect[0.0]


def test_shipped_penalty_keeps_neutral_mentions_clean(spark):
    """At the strength that ships, neutral held-out sentences on any group are called toxic less often, on groups seen in training or never."""
    rows, labels = [], []
    for i in range(900):
        toxic = i % 3 == 0
        name = "women" if toxic and i % 4 or i % 30 == 1 else "people"
        rows.append((i, f"{name} are {'vile' if toxic and i % 2 else 'so'} here number n{i}"))
        labels.append((i, int(toxic)))
    neutral = [f"{g} walked along the river on day {i}" for i in range(5) for g in ("women", "men", "girls", "muslims", "black", "people")]
    false, weight = {}, {}
    for fair in (0.0, toxicity.FAIR):
        model = toxicity.train(table(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"), fair=fair)
        false[fair] = sum(model.score(t) >= 0.7 for t in neutral)
        weight[fair] = {g: sum(model.weights[k] for k in toxicity.features(g)) for g in ("women", "men")}
        assert model.score("people are vile here") > 0.7
    assert false[0.0] >= 5 and false[toxicity.FAIR] == 0
    assert weight[toxicity.FAIR]["women"] < 0.3 * weight[0.0]["women"] and weight[toxicity.FAIR]["men"] <= weight[0.0]["men"] + 1e-9


def test_swaps():
    before, after = toxicity.swapped("Women sing")
    assert before == {"women", "sing"} and after == {"men", "sing"} and toxicity.swapped("birds sing") is None


def test_toxicity_edges(spark):
    labels = spark.createDataFrame([(3, 1), (4, 0), (None, 1), (9, None)], "doc_id long, toxic int")
    model = toxicity.train(table(spark, EDGE), labels)
    got = toxicity.score(table(spark, EDGE), model).collect()
    assert len(got) == len(EDGE) and all(0 <= r.score <= 1 for r in got) and {r.held_out for r in got if r.doc_id is None} == {False}
    none = toxicity.train(table(spark, EDGE).limit(0), labels.limit(0))
    assert 0 <= none.score("x") <= 1 and toxicity.score(table(spark, EDGE).limit(0), none).count() == 0


def test_fit_separates():
    ptr, idx = np.arange(5), np.array([0, 0, 1, 1])
    w, _ = fit(ptr, idx, np.ones(4), np.array([1.0, 1, 0, 0]), np.ones(4), 2, 1e-4, 200, 0.1)
    assert w[0] > 0 > w[1]


# quality

def test_quality_agrees_with_labels_it_never_sees(spark, data):
    rows = queries()["op2_quality"](spark, data).join(spark.read.parquet(f"{data}/labels.parquet"), "doc_id").collect()
    good, bad = [r.good for r in rows if r.quality == 1], [r.good for r in rows if r.quality == 0]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.1


def test_em_finds_accuracies():
    rng = np.random.default_rng(1)
    good = rng.random(20_000) < 0.85
    hit = np.array([0.7, 0.6, 0.5, 0.8])
    votes = np.where(good[:, None], np.where(rng.random((20_000, 4)) < 0.01, 0, -1), np.where(rng.random((20_000, 4)) < hit, 0, -1))
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    prior, acc = quality.em(patterns, counts.astype(float))
    assert abs(prior - 0.85) < 0.03 and np.abs(acc[:, 0, 1] - hit).max() < 0.05


def test_votes():
    plain = "This is a perfectly plain sentence about nothing much. It has another one beside it, too. And a third."
    assert 0 not in quality.votes(plain)
    for junk in ("BUY!! NOW!! THIS!! IS!! THE!! LAST!! CHANCE!! TO!! GET!! ONE!!", "a | b | c | d | e | f | g | h | i", "one%%% two$$$ three&&& four### five***", "spam spam spam spam spam spam " * 5):
        assert quality.votes(junk).count(0) >= 2
    assert set(quality.votes("short")) == {-1} == set(quality.votes(None))


def test_quality_sees_the_end_of_texts_without_spaces():
    plain = "文章の内容です。" * 40
    junk = plain + "#$%&@!" * 100
    assert quality.features(plain) != quality.features(junk)
    shown = quality.shapes("a1-" * 20)
    assert "".join(s[: quality.APART] for s in shown[:-1]) + shown[-1] == "a9-" * 20 and quality.shapes("Word,") == ("Aa,",)
    assert set(quality.votes(plain)) == {-1} and quality.votes(junk)[0] == 0 and quality.votes("0123456789" * 30)[9] == 0


def _described(word):
    """Words' counts by patterns, one word at a time."""
    loud = sum(not c.isalnum() and c not in ".,;:'\"()?-" and unicodedata.category(c)[0] != "M" for c in word)
    plain = re.fullmatch(r"[\"'(]?[^\W\d_](?:[^\W\d_]|['’-])*[.,;:!?\"')]?", word)
    marked, ends = re.search(r"[^\w\s]{2,}$", word), re.search(r"[^\W_][.!?]$", word)
    each = [sum(f(c) for c in word) for f in (str.isalpha, str.isupper, str.isdigit)]
    return [len(word), *each, loud, bool(plain), bool(marked), not any(map(str.isalnum, word)), bool(ends)]


def test_quality_describes_words_by_their_characters(monkeypatch):
    rng = random.Random(5)
    signs = [*"aBé9_'’-(\".,;:!?)$|漢。²٣", "\u0301", "\x00", "\x01", "\x85", "\xa0", "😀"]
    texts = [None, "", "  a ", *(" ".join("".join(rng.choices(signs, k=rng.randint(1, 5))) for _ in range(rng.randint(1, 40))) for _ in range(500))]
    monkeypatch.setattr(quality, "AT_ONCE", 5000)
    portions = list(quality._portions(pa.array(texts, pa.string())))
    assert len(portions) > 5 and sum(len(p.texts) for p in portions) == len(texts)
    for p in portions:
        words = [w for t in p.texts.to_pylist() for w in re.findall(quality.WORD, t)]
        assert len(p.at) == len(words)
        got = np.stack([p.described()[k] for k in quality.COUNTS], axis=1)[p.at].astype(int).tolist()
        shape, shapes = p.shaped()
        for w, g, k in zip(words, got, shape[p.at].tolist(), strict=True):
            assert g == _described(w) and quality._pieces(shapes[k]) == quality.shapes(w), w
    scorer = quality.Scorer(np.random.default_rng(1).normal(size=quality.DIMS), 0.1)
    alone = [float(scorer.scores(pa.array([t], pa.string()))[0]) for t in texts]
    assert np.allclose(scorer.scores(pa.array(texts, pa.string())), alone, atol=1e-12)


def test_quality_does_not_work_by_distinct_word(monkeypatch):
    seen, describe = [], quality._describe
    monkeypatch.setattr(quality, "_describe", lambda of: seen.append(of) or describe(of))
    monkeypatch.setattr(quality, "_table", np.zeros(0x110000, np.uint16), raising=False)
    quality.votes(" ".join(f"w{k}" for k in range(20_000)))
    assert len(seen) <= 11  # w and digits; not 20,000 words


def test_quality_edges(spark):
    got = quality.classify(table(spark, EDGE)).collect()
    assert len(got) == len(EDGE) and all(0 <= r.score <= 1 for r in got)
    assert quality.classify(table(spark, EDGE).limit(0)).count() == 0
    assert quality.accepted(table(spark, EDGE)).columns == [c.split()[0] for c in SCHEMA.split(", ")]


# language model

def grammar(rng, n):
    """Sentences in which each word decides its neighbours."""
    out = []
    for _ in range(n):
        k = rng.integers(0, 8)
        out.append(" ".join(f"w{(k + i) % 8}" for i in range(rng.integers(6, 20))))
    return out


def test_lm_prefers_text_in_order(spark):
    rng = np.random.default_rng(5)
    texts = grammar(rng, 1500)
    model, _ = lm.train(table(spark, list(enumerate(texts))).repartition(2))
    test = grammar(rng, 50)
    mixed = [" ".join(rng.permutation(t.split())) for t in test]
    n, right = model.log_probs([t.encode() for t in test])
    _, wrong = model.log_probs([t.encode() for t in mixed])
    assert right.sum() > wrong.sum() + 0.5 * n.sum()


def test_lm_training_lowers_the_loss(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    texts = [r.text.encode() for r in docs.limit(50).collect()]
    before, after = (lm.train(docs, rounds=r)[0].log_probs(texts)[1].sum() for r in (0, 2))
    assert after > before


def test_lm_gradient():
    rng = np.random.default_rng(2)
    classes = lm.Classes(np.ones(lm.BUCKETS))
    w = lm.start(np.ones(lm.BUCKETS), classes)
    cls = np.append(rng.integers(0, 5, 4000), [lm.CLASSES] * 2)
    cls = np.append([lm.CLASSES] * 2, cls)
    at = np.arange(2, 4002)
    loss = lambda: -lm._log_softmax(w, lm._hidden(w, lm._context(cls, at)))[np.arange(len(at)), cls[at]].mean()
    before = loss()
    lm.descend(w, cls, at, [np.full_like(x, 1e-4) for x in w])
    assert loss() < before


def test_lm_edges(spark):
    model, _ = lm.train(table(spark, EDGE), rounds=1)
    got = lm.score(table(spark, EDGE), model).collect()
    assert len(got) == len(EDGE)
    for r in got:
        assert (r.n_words == 0) == (r.mean_log_prob is None) and (r.n_words > 0 or r.log_prob == 0)
    empty, _ = lm.train(table(spark, EDGE).limit(0))
    assert lm.score(table(spark, EDGE).limit(0), empty).count() == 0


def test_lm_probabilities_sum_to_one(spark):
    model, _ = lm.train(table(spark, [(1, "a b c d e"), (2, "a b c")]), rounds=1)
    cls = np.append(model.classes.of, lm.CLASSES)
    ctx = np.array([[0], [1], [lm.CLASSES], [3]])
    over = np.exp(lm._log_softmax(model.weights, lm._hidden(model.weights, ctx)))[0]
    assert abs((over[model.classes.of] * np.exp(model.classes.inside)).sum() - 1) < 1e-3 and len(cls) == lm.BUCKETS + 1


def test_lm_scores_against_a_plain_model(spark):
    """Word by word: class by the network, entry in its class, word in its entry, each normalised by itself over all that there is."""
    rows = [(i, " ".join(f"w{(i + j) % (5 + i % 3)}" for j in range(12))) for i in range(40)] + [(90, "W0 w1 unseen w2"), (91, "w0")]
    model, made = lm.train(table(spark, rows[:-2]))
    assert made.count() == 40
    out = lm.CLASSES
    for r in lm.score(table(spark, rows), model).collect():
        ws = dict(rows)[r.doc_id].lower().encode().split()
        entry = [int(np.flatnonzero(model.keys == lm.word_hash(w))[0]) if lm.word_hash(w) in model.keys else len(model.keys) + lm.word_hash(w) % (len(model.classes.of) - len(model.keys)) for w in ws]
        want = 0.0
        for i, e in enumerate(entry):
            ctx = [model.classes.of[entry[j]] if 0 <= j < len(ws) else out for j in (i - 2, i - 1, i + 1, i + 2)]
            h = np.tanh(model.weights[1] + sum(model.weights[0][p][c] for p, c in enumerate(ctx)))
            z = [h @ model.weights[4][g] + model.weights[5][g] for g in range(len(model.weights[4]))]
            top = np.exp(h @ model.weights[2] + model.weights[3])
            g, k = divmod(model.classes.of[e], len(z[0]))
            want += np.log(top[g] / top.sum()) + np.log(np.exp(z[g])[k] / np.exp(z[g]).sum())
            mass = model.classes.mass[model.classes.of == model.classes.of[e]].sum()
            want += np.log((model.classes.mass[e] if e < len(model.keys) else 0.5) / mass)
        assert abs(r.log_prob - want) < 1e-3 * len(ws) and r.n_words == len(ws)


def test_lm_masks_follow_from_the_document():
    a, b = np.arange(400, dtype=np.int32), np.arange(700, dtype=np.int32) % 9
    both, alone = lm.masked([a, b], 1), lm.masked([b], 1)
    assert (both[400:] == alone).all() and 0.05 < both.mean() < 0.15 and (lm.masked([b], 2) != alone).any()


@pytest.mark.parametrize("name", ["op7_masked_lm_score"])
def test_lm_query(spark, data, name):
    got = queries()[name](spark, data)
    assert got.count() == spark.read.parquet(f"{data}/documents.parquet").count() and got.filter(F.col("log_prob") > 0).count() == 0


def test_lm_words_have_counts_of_their_own(spark, monkeypatch):
    # With two known words the others share entries; a frequent and a rare word of one entry differ by their counts.
    monkeypatch.setattr(lm, "KNOWN", 2)
    monkeypatch.setattr(lm, "BUCKETS", 3)
    monkeypatch.setattr(lm, "SHARED", 1)
    text = "a " * 40 + "b " * 30 + "c " * 16 + "d"
    model, _ = lm.train(table(spark, [(1, text)]), rounds=0)
    got = {r.doc_id: r.log_prob for r in lm.score(table(spark, [(1, "c"), (2, "d"), (3, "never"), (4, "a"), (None, "c"), (1, None)]), model).collect() if r.n_words and r.doc_id}
    assert len(model.keys) == 2 and model.others.count() == 2
    assert abs(got[1] - got[2] - np.log(16)) < 1e-5 and abs(got[2] - got[3] - np.log(2)) < 1e-5 and got[4] > got[1]


def test_lm_grows_with_the_vocabulary(spark):
    docs = table(spark, [(i, " ".join(f"w{j}" for j in range(i * 500, i * 500 + 500))) for i in range(400)])
    model, _ = lm.train(docs, rounds=0)
    assert len(model.keys) == 200_000 and model.classes.n == 512 > lm.CLASSES and len(set(model.classes.of[: len(model.keys)])) > 400
