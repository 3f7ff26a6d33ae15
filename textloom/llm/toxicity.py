"""Toxicity scores by a counterfactually regularised classifier.

A logistic model over hashed counts of distinct words and word beginnings is fitted on labelled documents.  For every labelled sentence that names a group
of people, a counterfactual sentence names another group of the same kind; the loss penalises the squared change of the score, so that naming a group is
no evidence.  Both sides of a swap are told by the features that the model has, so a group that it knows can't lend its weight to one that it doesn't.
Whole texts are scored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare, written
from .linear import fit

#: Labelled documents that are read at most, in order of a hash of their identifiers; a documented bound of the fit, not of the scoring.
FITTED = 40_000
#: Size of the hashed space, beginnings of words in characters, weight of the penalty.
DIMS, BEGINNINGS, FAIR = 1 << 18, (3, 4, 5, 6), 2.0
#: Documents of the sample that a feature needs, the share that it may have at most, and the deviations by which its shares in toxic and other documents differ.
LEAST_DF, MOST_DF, DEVIATIONS = 3, 0.4, 3.5
L2, STEPS, RATE, POSITIVE = 1e-5, 400, 0.05, 3.0
REMEMBERED = 1 << 20

#: Names of groups of people, by kind; a counterfactual takes the next one of its kind.  A parameter of the model.
IDENTITY_TERMS = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("girl", "boy"), ("female", "male"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino"), ("gay", "lesbian", "straight", "bisexual", "transgender"), ("immigrant", "refugee", "citizen"),
    ("african", "european", "american", "arab"), ("old", "young"), ("disabled", "blind", "deaf"),
    ("frauen", "männer"), ("frau", "mann"), ("juden", "christen", "muslime"), ("femmes", "hommes"), ("femme", "homme"), ("juifs", "chrétiens", "musulmans"),
    ("mujeres", "hombres"), ("mujer", "hombre"), ("judíos", "cristianos", "musulmanes"),
)

_words = re.compile(r"[^\W\d_]+").findall
_sentences = re.compile(r"[^.!?\n]+").findall


def words(text: str | None) -> set[str]:
    return set(_words((text or "").lower()))


def features(word: str) -> list[int]:
    """Buckets of a word: itself and its beginnings."""
    names = [word, *(f"{word[:n]}*" for n in BEGINNINGS if len(word) >= n)]
    return [zlib.crc32(x.encode()) % DIMS for x in names]


def swapped(sentence: str, terms=IDENTITY_TERMS) -> tuple[set[str], set[str]] | None:
    """Words of a sentence before and after each group's name gives way to the next of its kind; None if it names no group."""
    following = {a: kind[(i + 1) % len(kind)] for kind in terms for i, a in enumerate(kind)}
    before = words(sentence)
    after = {following.get(w, w) for w in before}
    return (before, after) if any(w in following for w in before) else None


def _buckets_of(found: set[str]) -> np.ndarray:
    return np.array([x for w in sorted(found) for x in features(w)], np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """label, text to documents and toxic documents per bucket."""
    df, hits = np.zeros(DIMS, np.int64), np.zeros(DIMS, np.int64)
    for b in batches:
        for label, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            at = np.unique(_buckets_of(words(text)))
            df[at] += 1
            hits[at] += label
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at]), pa.array(hits[at])], ["bucket", "df", "hits"])


def _prepared(batches: Iterator[pa.RecordBatch], kept: np.ndarray, terms) -> Iterator[pa.RecordBatch]:
    """label, text to label, kept buckets of all distinct words, and kept buckets lost and gained by swaps, a pair of lists per sentence that names a group."""
    named, keep = {a for kind in terms for a in kind}, np.zeros(DIMS, bool)
    keep[kept] = True
    for b in batches:
        rows = []
        for label, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            all_words = words(text)
            lost, gained = [], []
            if not named.isdisjoint(all_words):
                for s in _sentences(text):
                    if found := swapped(s, terms):
                        before, after = _buckets_of(found[0] - found[1]), _buckets_of(found[1] - found[0])
                        lost.append(before[keep[before]])
                        gained.append(after[keep[after]])
            at = _buckets_of(all_words)
            rows.append((label, at[keep[at]], lost, gained))
        cols = list(zip(*rows, strict=True)) or [()] * 4
        kinds = [pa.int32(), pa.list_(pa.int64()), pa.list_(pa.list_(pa.int64())), pa.list_(pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["label", "idx", "lost", "gained"])


class Model:
    """Weights of the hashed space and the bias; scores any text."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias, self.known = weights, bias, {}

    def _weight(self, word: str) -> float:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        self.known[word] = x = float(sum(self.weights[i] for i in features(word)))
        return x

    def score(self, text: str | None) -> float:
        known, z = self.known, self.bias
        for w in words(text):
            x = known.get(w)
            z += self._weight(w) if x is None else x
        return 1 / (1 + float(np.exp(-max(-30.0, min(30.0, z)))))

    def __getstate__(self):
        at = np.flatnonzero(self.weights)
        return at.astype(np.int32), self.weights[at].astype(np.float32), self.bias

    def __setstate__(self, state):
        self.weights = np.zeros(DIMS, np.float32)
        self.weights[state[0]], self.bias, self.known = state[1], state[2], {}


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, terms=IDENTITY_TERMS, fitted: int = FITTED, fair: float = FAIR) -> Model:
    """Fit on labelled rows that aren't held out.  Null labels and identifiers are passed over; without both kinds of labels every score is the share.

    An identifier that several documents have stands for the first of their texts in order, and one with both labels counts once with each.
    """
    prepare(docs.sparkSession)
    usable = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    sample = usable.select("doc_id", F.col("toxic").cast("int").alias("toxic"), F.xxhash64("doc_id").alias("h")).distinct().orderBy("h", "toxic").limit(fitted)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample.select("doc_id", "toxic")), "doc_id")
    rows = written(rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("toxic", "text"), "toxicity-sample")
    counts = rows.mapInArrow(_counted, "bucket long, df long, hits long").groupBy("bucket").agg(F.sum("df").alias("df"), F.sum("hits").alias("hits")).toArrow()
    total = rows.agg(F.count("*"), F.sum("toxic")).first()
    n, toxic = total[0], total[1] or 0
    if not toxic or toxic == n:
        return Model(np.zeros(DIMS), float(np.log((toxic + 0.5) / (n - toxic + 0.5))))
    # What hardly any or very many documents hold, or both kinds alike, says nothing.
    bucket, df, hits = (counts[c].to_numpy() for c in ("bucket", "df", "hits"))
    share = toxic / n
    apart = np.abs(hits - df * share) / np.sqrt(df * share * (1 - share))
    kept = bucket[(df >= LEAST_DF) & (df <= MOST_DF * n) & (apart >= DEVIATIONS)]
    made = rows.mapInArrow(lambda it: _prepared(it, kept, terms), "label int, idx array<long>, lost array<array<long>>, gained array<array<long>>").toArrow()
    y = made["label"].to_numpy().astype(float)
    lists = made["idx"].combine_chunks()
    ptr, idx = lists.offsets.to_numpy().astype(np.int64), lists.flatten().to_numpy()
    ptr = ptr - ptr[0]
    diffs = []
    for lost, gained in zip(made["lost"].to_pylist(), made["gained"].to_pylist(), strict=True):
        for a, b in zip(lost, gained, strict=True):
            diffs.append((np.array(a + b, np.int64), np.array([-1.0] * len(a) + [1.0] * len(b))))
    weight = np.where(y > 0, POSITIVE, 1.0)
    return Model(*fit(ptr, idx, np.ones(len(idx)), y, weight, DIMS, L2, STEPS, RATE, diffs, fair))


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row; null and empty texts get the score of no words.  Other columns are ignored."""
    prepare(docs.sparkSession)

    @F.pandas_udf("double")
    def scored(text: pd.Series) -> pd.Series:
        return pd.Series([model.score(t) for t in text], dtype="float64")

    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), scored("text").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
