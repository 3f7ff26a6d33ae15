"""Exact and near deduplication against brute force, with the edge cases of both."""

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textloom.llm import exact_dedup, near_dedup
from textloom.llm.queries import oracle_sql, queries

SCHEMA = "doc_id long, text string, sha string, id long, first string, row int"


def table(spark, rows):
    """Rows (id, text) with further columns whose names clash with those used inside."""
    return spark.createDataFrame([(i, t, "x", 1, "y", 2) for i, t in rows], SCHEMA)


EDGE = [(1, "a b"), (2, "a b"), (3, None), (4, ""), (None, "a b"), (None, "z"), (5, "A  b"), (5, "A  b"), (6, "é" * 30_000), (7, "é" * 30_000), (8, " "), (9, "é" * 30_000 + "!")]


def brute(rows, keep):
    by = defaultdict(list)
    for i, t in rows:
        by[t or ""].append(i)
    pick = {t: keep([i for i in ids if i is not None], default=None) for t, ids in by.items()}
    return sorted(((i, pick[t or ""], len(by[t or ""]), i == pick[t or ""], hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows), key=str)


@pytest.mark.parametrize(("name", "keep"), [("smallest", min), ("largest", max)])
def test_exact_edges(spark, name, keep):
    got = exact_dedup.groups(table(spark, EDGE), keep=name).collect()
    assert sorted(map(tuple, got), key=str) == brute(EDGE, keep)


def test_exact_hot_group_is_split(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "BLOCK_ROWS", 8)
    rows = [(i, "hot") for i in range(200)] + [(1000 + i, f"t{i % 40}") for i in range(60)]
    got = exact_dedup.groups(table(spark, rows), keep="largest").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, max)
    for keep, best in (("largest", 199), ("smallest", 0)):
        kept = exact_dedup.dedup(table(spark, rows), keep=keep)
        assert kept.count() == 41 and kept.filter("text = 'hot'").first().doc_id == best


@pytest.mark.parametrize("ids", [[None], [7], [None, 7], [1, 2, None]])
def test_exact_hot_group_without_distinct_ids(spark, monkeypatch, ids):
    """Copies that share identifiers or have none are dealt out, counted together, and one row stays."""
    monkeypatch.setattr(exact_dedup, "BLOCK_ROWS", 8)
    rows = [(ids[i % len(ids)], "hot") for i in range(400)] + [(1000 + i, f"t{i}") for i in range(40)]
    for keep, best in (("largest", max), ("smallest", min)):
        out = exact_dedup.groups(table(spark, rows).repartition(4), keep=keep)
        assert sorted(map(tuple, out.collect()), key=str) == brute(rows, best)
        assert exact_dedup.dedup(table(spark, rows).repartition(4), keep=keep).groupBy("text").count().agg({"count": "max"}).first()[0] == 1
        shares = [r["count"] for r in out.filter("group_size = 400").groupBy(F.spark_partition_id()).count().collect()]
        assert len(shares) > 1 and max(shares) < 300


def test_exact_dedup_keeps_columns_and_one_row_per_text(spark):
    kept = exact_dedup.dedup(table(spark, EDGE))
    assert kept.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    texts = [r.text or "" for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({t or "" for _, t in EDGE})


def test_exact_forms_and_empty(spark):
    rows = [(1, " a\tb "), (2, "a b"), (3, "A B")]
    assert exact_dedup.dedup(table(spark, rows), form="space").count() == 2
    assert exact_dedup.dedup(table(spark, rows), form="fold").count() == 1
    assert exact_dedup.groups(table(spark, rows).limit(0)).count() == 0
    with pytest.raises(ValueError):
        exact_dedup.groups(table(spark, rows), form="?")


def components(rows, similar=(3, 4)):
    """Quadratic model: all pairs of shingle sets, union-find."""
    sets = []
    for i, t in rows:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").encode().split()
        k = min(5, len(w))
        sets.append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and similar[1] * both >= similar[0] * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    smallest = {}
    for x, (i, _) in enumerate(rows):
        if i is not None:
            smallest[find(x)] = min(i, smallest.get(find(x), i))
    out = []
    for x, (i, _) in enumerate(rows):
        c = smallest.get(find(x)) if sets[x] else i
        out.append((i, len(sets[x]), c, i == c))
    return sorted(out, key=str)


def texts(seed, n, words=60, edit=0.05):
    """Groups of near copies of several bases, some edited at random, some sharing a passage."""
    rng = np.random.default_rng(seed)
    vocab = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choice(vocab, 40))
    bases = [list(rng.choice(vocab, words)) for _ in range(4)]
    rows = []
    for i in range(n):
        w = list(bases[rng.integers(len(bases))]) if rng.random() < 0.8 else list(rng.choice(vocab, rng.integers(1, words)))
        for j in range(len(w)):
            if rng.random() < edit * rng.random():
                w[j] = str(rng.choice(vocab))
        rows.append((i, " ".join(w) + (" " + passage if rng.random() < 0.3 else "")))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_near_against_all_pairs(spark, seed):
    rows = texts(seed, 160, edit=0.08)
    got = near_dedup.classes_of(table(spark, rows)).collect()
    assert sorted(map(tuple, got), key=str) == components(rows)


def edited(seed, n, words, most, pool=60):
    """Copies of one base with up to so many words replaced, dropped or doubled; many edits repeat between copies, few copies reach all others."""
    rng = np.random.default_rng(seed)
    vocab = [f"w{i}" for i in range(pool)]
    base, rows = list(rng.choice([f"b{i}" for i in range(900)], words)), []
    for i in range(n):
        w = list(base)
        for j in sorted(rng.choice(words, rng.integers(0, most), replace=False), reverse=True):
            w[j : j + 1] = [[str(rng.choice(vocab))], [], [w[j], w[j]], ["same"]][rng.integers(4)]
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize(("n", "checks"), [(400, near_dedup.CHECKS), (120, 60)])
def test_near_one_large_group(spark, monkeypatch, n, checks):
    """A group in which few are linked with the pivot: right, also where lists need pivots of their own, and what is compared follows the group's size."""
    counted, plain, rows = [], near_dedup._with_sets, edited(3, n, 120, 14)
    monkeypatch.setattr(near_dedup, "CHECKS", checks)

    def counting(pairs, sets, detailed):
        counted.append(pairs.count())
        return plain(pairs, sets, detailed)

    monkeypatch.setattr(near_dedup, "_with_sets", counting)
    got = near_dedup.classes_of(table(spark, rows)).collect()
    assert sorted(map(tuple, got), key=str) == components(rows)
    assert (len(counted) > 2) == (checks < 100) and sum(counted) < 40 * len(rows)


def test_near_edges(spark):
    rows = [(1, "a b c d e f"), (2, "A B C D E F"), (3, None), (4, ""), (5, " \t"), (6, "a b"), (7, "a  b"), (8, "b a"), (None, "a b"), (None, "q"), (9, "a b c d e f"), (9, "a b c d e f"), (10, "É é"), (11, "é é")]
    got = near_dedup.classes_of(table(spark, rows)).collect()
    assert sorted(map(tuple, got), key=str) == components(rows)
    assert near_dedup.classes_of(table(spark, rows).limit(0)).count() == 0
    kept = near_dedup.dedup(table(spark, rows))
    assert kept.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    assert kept.filter("doc_id IN (3, 4, 5)").count() == 3


def test_near_rows_without_identifiers(spark):
    """Thousands of rows without or with one identifier: right classes, and one row of each group stays."""
    words = [f"w{i}" for i in range(400)]
    rng = np.random.default_rng(8)
    rows = []
    for i in range(700):
        t = " ".join(rng.choice(words, 40))
        rows += [(None, t), (None, t + " end"), (None if i % 2 else 5, t), (None, t)]
    docs = table(spark, rows)
    assert sorted(map(tuple, near_dedup.classes_of(docs).collect()), key=str) == components(rows)
    kept = near_dedup.dedup(docs).collect()
    assert len(kept) == 700 and sum(r.doc_id == 5 for r in kept) == 350
    assert {" ".join(r.text.split()[:40]) for r in kept} == {" ".join(t.split()[:40]) for _, t in rows}


def test_near_very_long_text(spark):
    long = " ".join(str(i) for i in range(60_000))
    rows = [(1, long), (2, long + " end"), (3, long[: len(long) // 2])]
    got = {r.doc_id: r.component_id for r in near_dedup.classes_of(table(spark, rows)).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_least_overlap_keeps_pairs():
    assert near_dedup.least_overlap(1) == 1 and near_dedup.least_overlap(47) <= 47 * 3 // 4
    assert 0 < near_dedup.least_overlap(48) < 36


def test_components_of_chains(spark):
    edges = spark.createDataFrame([(i + 1, i, 1) for i in range(60)] + [(100, 101, 1), (205, 200, 1), (205, 204, 1), (204, 203, 1)], "a long, b long, both long")
    got = {r.cid: r.root for r in near_dedup.components(edges).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[101] == 100 and {got[i] for i in (200, 203, 204, 205)} == {200}


@pytest.mark.parametrize("name", ["op4_minhash_near_dedup", "op6_exact_dedup"])
def test_queries_match_sql(spark, data, duck, same_rows, name):
    same_rows(queries()[name](spark, data), duck.sql(oracle_sql()[name]))


def test_exact_plan_is_native(spark, data):
    plan = queries()["op6_exact_dedup"](spark, data)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_shingle_sets_of_neighbouring_texts(monkeypatch):
    """Sets of all texts of a batch at once are those of each text alone: no shingle reaches into the next text, long words differ by any byte."""
    long = [b"q" * k + b" " + b"q" * (k + 1) + b"\tr" for k in (7, 8, 9, 16, 64, 300)]
    odd = [None, b"", b" \n", b"a", b"A b", b"a b c d", b"a b c d e", b" a b c d e f ", b"a", b"b c d e f g", b"\x00 \x00\x00 a", b"x\x0by\x1cz", "é É ñ a b c".encode(), b"a b c d e " * 30, *long]

    def brute(text, k=5):
        w = (text or b"").lower().split()
        m = min(k, len(w))
        return {tuple(w[i : i + m]) for i in range(len(w) - m + 1)} if w else set()

    for at_once in (1, 40, 1 << 20):
        monkeypatch.setattr(near_dedup, "AT_ONCE", at_once)
        got = list(near_dedup.shingle_sets(pa.array([b"left out", *odd], pa.binary()).slice(1)))
        for text, s in zip(odd, got, strict=True):
            assert (s[1:] > s[:-1]).all() and np.array_equal(s, near_dedup.shingle_set(text))
            assert [len(np.intersect1d(s, t)) for t in got] == [len(brute(text) & brute(other)) for other in odd]
    assert list(near_dedup.shingle_sets(pa.array([], pa.string()))) == []


def test_only_texts_that_are_asked_for_are_shuffled(spark):
    """Before full sets are joined to their classes, other rows are left behind; none that is asked for is."""
    told = near_dedup._told(table(spark, [(i, f"t{i}") for i in range(3000)] + [(None, "t1"), (None, None)]), "doc_id", "text")
    owners = told.filter("doc_id % 100 = 0 OR text IS NULL").select(F.col("doc_id").alias("owner"), F.col("digest").alias("own"))
    left = near_dedup._asked(told, owners).collect()
    assert {r.own for r in owners.collect()} <= {r.digest for r in left} and 31 <= len(left) < 40
    assert near_dedup._asked(told, owners.limit(0)).count() == 0
