"""Encoding, wavelet files, packing and token counts: exact round trips against the tokenizers library."""

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from textloom.llm import packing, rollups, tokens, wavelet
from textloom.llm.queries import queries

SCHEMA = "doc_id long, text string, start long, piece int, length string, source string, lang string"
FILES = [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)]


def table(spark, rows):
    return spark.createDataFrame([(i, t, 7, 7, "x", "s", None) for i, t in rows], SCHEMA)


def direct(name, texts):
    t = Tokenizer.from_file(tokens.public(name))
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


PARTS = ["a", "b", "s", "t", " ", "  ", "\n", "\t", "\x0b", "\x1c", "\x85", "'", "'s", "'ll", "'re", "é", "É", "ß", "İ", "ſ", "1", "23", "²", "½", "ª", "!", "...", "—", "“", " ", " ", "​", "́", "中文", "Ω", "ς", "Σ", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endof", "text|>", "</w>", "Ġ", "_", "the", "Don't", "x" * 70, "Ĳ", "ŉ", "😀", "﻿"]


@pytest.mark.parametrize(("name", "ends"), FILES)
def test_pieces_give_the_ids_of_whole_texts(name, ends):
    r = random.Random(11)
    texts = ["".join(r.choice(PARTS) for _ in range(r.randint(0, 25))) for _ in range(6000)] + ["", None, " ", "\n\n", "word " * 40_000]
    got = tokens.Encoder(tokens.public(name), ends).encode(texts)
    assert [np.frombuffer(b, "<u4").tolist() for b in got] == direct(name, texts)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=5))
def test_any_unicode_text(texts):
    for name, ends in FILES:
        got = tokens.encoder(tokens.public(name), ends).encode(texts)
        assert [np.frombuffer(b, "<u4").tolist() for b in got] == direct(name, texts)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 70_000), max_size=1500))
def test_wavelet_matrix(ids):
    w = wavelet.WaveletMatrix.build(np.array(ids, np.uint32))
    assert w.decode().tolist() == ids
    for i in range(0, len(ids), 97):
        x = ids[i]
        at = [k for k, v in enumerate(ids) if v == x]
        assert w.access(i) == x and w.rank(x, i) == sum(k < i for k in at) and w.occurrences(x) == at
    assert w.count(70_001) == ids.count(70_001) and w.count(1 << 20) == 0


def test_shard_file_round_trip():
    ids = np.arange(2000, dtype=np.uint32) % 321
    s = wavelet.Shard([5, None, 9], np.array([700, 0, 1300]), wavelet.WaveletMatrix.build(ids))
    back = wavelet.Shard.from_bytes(s.to_bytes())
    assert back.doc_ids == [5, None, 9] and back.document(2).tolist() == ids[700:].tolist() and back.document(1).tolist() == []
    with pytest.raises(ValueError):
        wavelet.Shard.from_bytes(b"????")


EDGE = [(3, "The quick brown fox"), (1, None), (2, ""), (None, "null id"), (5, "same"), (5, "same"), (4, "é " * 5000), (6, " \n ")]


def test_wavelet_files(spark):
    name, ends = FILES[0]
    path = wavelet.write(table(spark, EDGE), tokens.public(name), ends, 2, shard_tokens=50)
    rows = sorted(EDGE, key=lambda r: (r[0] is not None, r[0] or 0))
    got = wavelet.read(spark, path).orderBy("start").collect()
    at = 0
    for (i, _), ids, g in zip(rows, direct(name, [t for _, t in rows]), got, strict=True):
        ids = [*ids, 2]
        assert tuple(g) == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    symbol = direct(name, ["same"])[0][0]
    assert sorted(r.doc_id for r in wavelet.occurrences(spark, path, symbol).collect()) == [5, 5]
    empty = wavelet.write(table(spark, EDGE).limit(0), tokens.public(name), ends, 2)
    assert wavelet.read(spark, empty).count() == 0


def check_packing(rows, got, length):
    want = {}
    for (i, _), ids in zip(rows, direct("byte_bpe_50k.json", [t for _, t in rows]), strict=True):
        want.setdefault(i, []).append([*ids, 0])
    pieces = {}
    for r in got:
        docs = want[r.doc_id]
        part = docs[0][r.start : r.start + r.length]
        assert r.length == len(part) and r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
        if len(docs[0]) <= length:
            assert (r.piece, r.start, r.length) == (0, 0, len(docs[0]))
        elif r.piece:
            assert r.length == length
        pieces.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in pieces.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= length
    assert sum(r.length for r in got) == sum(len(d) for docs in want.values() for d in docs)
    return len(pieces)


def test_packing_edges(spark):
    got = packing.pack(table(spark, EDGE), tokens.public("byte_bpe_50k.json"), False, 0, length=64).collect()
    check_packing(EDGE, got, 64)
    assert packing.pack(table(spark, EDGE).limit(0), tokens.public("byte_bpe_50k.json"), False, 0).count() == 0


def test_packing_many(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_ROWS", 120)
    r = random.Random(4)
    rows = [(i, "word " * r.randint(0, 90)) for i in range(900)]
    got = packing.pack(table(spark, rows), tokens.public("byte_bpe_50k.json"), False, 0, length=128).collect()
    n, sizes = check_packing(rows, got, 128), np.bincount([x.length for x in got], minlength=129)
    assert n <= packing.lower_bound(sizes, 128) + 3


def test_sequences_hold_the_ids(spark):
    packed = packing.pack(table(spark, EDGE[:3]), tokens.public("byte_bpe_50k.json"), False, 0, length=64, keep_ids=True)
    seqs = packing.sequences(packed).collect()
    ids = sorted(x for s in seqs for x in np.frombuffer(bytes(s.ids), "<u4").tolist())
    assert ids == sorted(x for d in direct("byte_bpe_50k.json", [t for _, t in EDGE[:3]]) for x in [*d, 0])


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=40))
def test_lower_bound_and_best_fit(sizes):
    bins, offsets = packing.best_fit_decreasing(np.array(sizes), 40)
    used = np.bincount(bins, weights=sizes)
    bound = packing.lower_bound(np.bincount(sizes, minlength=41), 40)
    assert used.max() <= 40 and -(-sum(sizes) // 40) <= bound <= len(used) and offsets.min() == 0


def test_lower_bound_sees_large_items():
    assert packing.lower_bound(np.bincount([21] * 5, minlength=41), 40) == 5


def test_queries_on_the_tables(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    got = queries()["op9_wavelet_token_ids"](spark, data).orderBy("doc_id").collect()
    at = 0
    for d, ids, g in zip(docs, direct("word_bpe_49k.json", [d.text for d in docs]), got, strict=True):
        assert tuple(g) == (d.doc_id, at, len(ids) + 1, zlib.crc32(np.array([*ids, 2], "<u4").tobytes()))
        at += len(ids) + 1
    packed = queries()["op10_best_fit_packing"](spark, data).collect()
    n = check_packing([(d.doc_id, d.text) for d in docs], packed, 2048)
    assert n <= packing.lower_bound(np.bincount([r.length for r in packed], minlength=2049), 2048)


# rollups

CHANGES = "op string, doc_id long, source string, lang string, tokenizer string, tokens long"


def totals(store):
    return sorted(((r.source, r.lang, r.tokenizer, r.docs, r.tokens) for r in store.totals().collect()), key=str)


def test_rollup_deltas(spark, tmp_path):
    store = rollups.Store(spark, f"file://{tmp_path}/r")
    assert totals(store) == []
    first = spark.createDataFrame([("insert", 1, "a", "en", "w", 5), ("insert", 2, "a", "en", "w", 7), ("insert", 3, None, "de", "w", None), ("insert", None, "a", "en", "w", 1), ("insert", None, "a", "en", "w", 1), ("delete", 9, "a", "en", "w", 3)], CHANGES)
    assert store.commit("b1", first)
    want = [("a", "en", "w", 4, 14), (None, "de", "w", 1, 0)]
    assert totals(store) == sorted(want, key=str)
    assert not store.commit("b1", first) and totals(store) == sorted(want, key=str)
    second = spark.createDataFrame([("revise", 1, "b", "en", "w", 50), ("delete", 2, "x", "x", "w", 0), ("insert", 3, None, "de", "w", 4), ("insert", 1, "a", "en", "v2", 6)], CHANGES)
    assert store.commit("b2", second)
    want = [("a", "en", "w", 2, 2), ("b", "en", "w", 1, 50), (None, "de", "w", 1, 4), ("a", "en", "v2", 1, 6)]
    assert totals(store) == sorted(want, key=str)
    assert store.commit("b3", spark.createDataFrame([("delete", 1, None, None, "w", None), ("insert", 1, "c", "en", "w", 8)], CHANGES).withColumn("seq", F.when(F.col("op") == "insert", 2).otherwise(1)))
    assert ("c", "en", "w", 1, 8) in totals(store) and all(r[0] != "b" for r in totals(store))
    assert [b for _, b in store.batches()] == ["b1", "b2", "b3"]


def test_rollup_of_a_broken_commit(spark, tmp_path):
    store = rollups.Store(spark, f"file://{tmp_path}/r")
    rows = spark.createDataFrame([("insert", 1, "a", "en", "w", 5)], CHANGES)
    rows.withColumn("there", F.lit(True)).withColumn("number", F.lit(1)).select("doc_id", "tokenizer", "source", "lang", "tokens", "there", "number").write.parquet(store._entry("counts", 1, "b1"))
    assert totals(store) == [] and store.counts() is None
    assert store.commit("b1", rows) and totals(store) == [("a", "en", "w", 1, 5)]
    with pytest.raises(ValueError):
        store.commit("a/b", rows)
    assert store.commit("none", rows.limit(0)) and totals(store) == [("a", "en", "w", 1, 5)]


def test_rollup_refuses_unknown_changes(spark, tmp_path):
    store = rollups.Store(spark, f"file://{tmp_path}/r")
    with pytest.raises(Exception, match="unknown change"):
        store.commit("b", spark.createDataFrame([("merge", 1, "a", "en", "w", 5)], CHANGES))


def test_rollup_query(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").collect()
    want = {}
    for d, ids in zip(docs, direct("byte_bpe_50k.json", [d.text for d in docs]), strict=True):
        for name, n in (("words/1", len((d.text or "").encode().split())), ("byte_bpe_50k/1", len(ids))):
            x = want.setdefault((d.source, d.lang, name), [0, 0])
            x[0] += 1
            x[1] += n
    got = {(r.source, r.lang, r.tokenizer): [r.docs, r.tokens] for r in queries()["op8_token_count_rollups"](spark, data).collect()}
    assert got == want


def test_rows_that_share_an_identifier_count_each(spark, tmp_path):
    """Two texts, repeated rows and many copies under one identifier, and rows without one: every row is in the totals, also after they go and come back."""
    rows = [(1, "a", "en", "x y"), (1, "a", "en", "x y z"), (1, "b", "en", "x y"), (2, "a", "en", "q"), (None, "a", "en", "w w"), (None, "a", "en", "w w"), (1, None, None, None)] + [(7, "a", "en", "k k k k")] * 50
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, text string").withColumn("part", F.lit("x")).withColumn("copies", F.lit(3))
    store = rollups.Store(spark, f"file://{tmp_path}/r", compacted=2)
    want = {}
    for _, source, lang, text in rows:
        x = want.setdefault((source, lang, "w"), [0, 0])
        x[0] += 1
        x[1] += len((text or "").split())
    told = lambda: {(s, g, k): [d, n] for s, g, k, d, n in totals(store)}
    store.commit("all", rollups.token_counts(docs, {"w": None}))
    assert told() == want
    some = store.counts().filter("doc_id IN (1, 7)").withColumn("op", F.lit("delete"))
    some.write.parquet(f"{tmp_path}/some")
    some = spark.read.parquet(f"{tmp_path}/some")
    store.commit("gone", some)
    assert told() == {("a", "en", "w"): [3, 5]}
    store.commit("back", some.withColumn("op", F.lit("insert")))
    assert told() == want


def test_small_tables_are_packed_as_one(spark):
    rows = [(i, "word " * (7 + i * i % 61)) for i in range(600)]
    got = packing.pack(table(spark, rows), tokens.public("byte_bpe_50k.json"), False, 0, length=128).collect()
    sizes = np.array([x.length for x in got])
    assert check_packing(rows, got, 128) == len(set(packing.best_fit_decreasing(sizes[sizes < 128], 128)[0])) + (sizes == 128).sum()
