"""Quality scores without labels: overlapping heuristics vote, expectation-maximisation weighs them, and a hashed linear scorer learns the outcome.

Heuristics vote good (1), bad (0) or nothing (-1).  Patterns of votes are counted over all documents, so the
expectation-maximisation runs on a table whose size depends on the number of heuristics alone.  Its posterior labels train a logistic model over hashed
shapes of words, which generalise where heuristics abstain.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, claim, prepare
from .linear import fit

#: Documents that train the scorer, in order of a hash of their texts; a documented bound of the fit.  Patterns and scores cover all documents.
FITTED = 8_000
DIMS, L2, STEPS, RATE, ROUNDS = 1 << 16, 1e-5, 200, 0.05, 60
#: Share of good documents that a heuristic may call bad.
MOST_FALSE = 0.01
#: Words that count as seen in every text besides its own, so that short texts say little.
SHRINK = 10
#: A document stays if its score reaches this.
THRESHOLD = 0.3
#: Marks of a shape in one piece; longer shapes are overlapping pieces, each starting so many marks after the last.
PIECE, APART = 12, 6
#: A text of fewer than 5 words votes by its characters from so many on.
LONG_TEXT = 200
#: Bytes of texts whose words are described at once; a longer text is taken by itself.
AT_ONCE = 1 << 21

_words = re.compile(WORD).findall


_QUIET = set(".,;:'\"()?-")
#: What is known of each character: letter, capital, digit, loud symbol, letter or number, one but no decimal digit, mark, what a plain word may begin
#: with, hold and end in, end of a sentence, punctuation of scripts without spaces; the last says that the others are known.
LETTER, CAPITAL, DIGIT, LOUD, ALNUM, BODY, MARK, OPENS, HELD, CLOSES, STOPS, FOREIGN, SEEN = (1 << k for k in range(13))
_table = np.zeros(0x110000, np.uint16)
#: What is counted of each word: characters, letters, capitals, digits, loud symbols; whether it is plain, ends in marks, is marks alone, ends a sentence.
COUNTS = ("chars", "letters", "capitals", "digits", "loud", "plain", "marked", "bare", "ends")
NAMES = ("symbols", "marked_words", "bare_marks", "plain_words", "shouting", "few_distinct", "very_few_distinct", "stutter", "sentences", "digits")


def _describe(c: str) -> int:
    kind, named, body = unicodedata.category(c), c.isalnum(), c.isalnum() and not c.isdecimal()
    loud = not named and c not in _QUIET and kind[0] != "M"
    foreign = not c.isascii() and c not in _QUIET and kind[0] == "P"
    mark = not named and c != "_" and not c.isspace()
    of = (c.isalpha(), c.isupper(), c.isdigit(), loud, named, body, mark, c in "\"'(", body or c in "'’-", c in ".,;:!?\"')", c in ".!?", foreign, True)
    return sum(1 << k for k, x in enumerate(of) if x)


def _flags(points: np.ndarray) -> np.ndarray:
    """What is known of characters by their code points."""
    out = _table[points]
    if not out.all():
        for c in np.unique(points[out == 0]).tolist():
            _table[c] = _describe(chr(c))
        out = _table[points]
    return out


def _points(text: bytes) -> np.ndarray:
    return np.frombuffer(text.decode().encode("utf-32-le"), np.uint32)


def _counts(of: np.ndarray, what: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each pair of a text and a number below size that occurs, by text, and how often."""
    keys, n = np.unique(of * size + what, return_counts=True)
    return keys // size, keys % size, n


class _Portion:
    """Neighbouring texts: their distinct words, at each place the word and its text, and the number of words and of distinct ones by text."""

    def __init__(self, texts: pa.Array):
        lists = pc.ascii_split_whitespace(texts)
        words = lists.flatten()
        real = pc.not_equal(words, "")  # nothing is before the first and behind the last space
        coded, of = words.filter(real).dictionary_encode(), pc.list_parent_indices(lists).filter(real)
        self.texts, self.at, self.of = texts, coded.indices.to_numpy(), of.to_numpy()
        self.n = np.bincount(self.of, minlength=len(texts))
        self.counts = _counts(self.of, self.at, max(1, len(coded.dictionary)))
        self.distinct = np.bincount(self.counts[0], minlength=len(texts)) / np.maximum(self.n, 1)
        self.again = np.bincount(self.of[1:][(self.at[1:] == self.at[:-1]) & (self.of[1:] == self.of[:-1])], minlength=len(texts))
        # The characters of distinct words, one word behind the other, and where each word ends.
        self.stop = np.cumsum(pc.utf8_length(coded.dictionary).to_numpy())
        size = pc.sum(pc.binary_length(coded.dictionary)).as_py()
        self.points = _points(coded.dictionary.buffers()[2].to_pybytes()[:size] if size else b"")
        self.flags = _flags(self.points)

    def described(self) -> dict[str, np.ndarray]:
        """COUNTS of each distinct word."""
        stop, flags = self.stop, self.flags
        start, last = np.concatenate([[0], stop[:-1]])[: len(stop)], stop - 1
        size = stop - start
        has = lambda at, flag: flags[at] & flag != 0

        def number(flag: int) -> tuple[np.ndarray, np.ndarray]:
            before = np.concatenate([[0], np.cumsum(flags & flag != 0)])
            return before, before[stop] - before[start]

        out = {"chars": size, **{name: number(flag)[1] for name, flag in (("letters", LETTER), ("capitals", CAPITAL), ("digits", DIGIT), ("loud", LOUD))}}
        held, second_last = number(HELD)[0], np.maximum(last - 1, start)
        # A plain word: a sign that opens or none, a letter, letters and apostrophes, a sign that closes or none.
        first = start + has(start, OPENS)
        inside = np.maximum(last, first + 1)
        at = np.minimum(first, last)
        out["plain"] = (first < stop) & has(at, BODY) & (held[inside] - held[np.minimum(first + 1, inside)] == inside - np.minimum(first + 1, inside)) & ((last <= first) | has(last, HELD | CLOSES))
        out["marked"] = (size > 1) & has(last, MARK) & has(second_last, MARK)
        out["bare"] = number(ALNUM)[1] == 0
        out["ends"] = (size > 1) & has(last, STOPS) & has(second_last, ALNUM)
        return out

    def shaped(self) -> tuple[np.ndarray, list[str]]:
        """The number of each distinct word's shape, and the shapes."""
        kinds, first = _kinds(self.points, self.flags, self.stop)
        size = 1 + (kinds > 0x7F).astype(np.int32) + (kinds > 0x7FF) + (kinds > 0xFFFF)  # bytes in UTF-8
        ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([first, [len(kinds)]])]
        text = kinds.astype("<u4").tobytes().decode("utf-32-le").encode()
        coded = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(text)).dictionary_encode()
        return coded.indices.to_numpy(), coded.dictionary.to_pylist()


def _portions(texts: pa.Array) -> Iterator[_Portion]:
    """All texts in portions of about AT_ONCE bytes; null is empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + AT_ONCE, "right")))
        yield _Portion(texts[at:to])
        at = to


def _votes_of(p: _Portion) -> np.ndarray:
    """Votes by text: 1 good, 0 bad, -1 none.

    Long texts of fewer than 5 words vote by shares of their characters; words have no say in them.
    """
    of, word, count = p.counts
    total = {k: np.bincount(of, count * x[word], len(p.texts)) for k, x in p.described().items()}  # whole numbers below 2^53
    n = np.maximum(p.n, 1)
    plain, ends, again, many, distinct = total["plain"] / n, total["ends"] / n, p.again / n, p.n >= 20, p.distinct
    bad = lambda x: np.where(x, 0, -1)
    out = np.stack(
        [
            bad(total["loud"] > 0.06 * total["chars"]),
            bad(total["marked"] > 0.25 * n),
            bad(total["bare"] > 0.15 * n),
            np.where(plain < 0.6, 0, np.where((plain > 0.85) & (distinct > 0.5), 1, -1)),
            bad(total["capitals"] > 0.35 * np.maximum(1, total["letters"])),
            bad(many & (distinct < 0.45)),
            bad(many & (distinct < 0.25)),
            bad(again > 0.1),
            np.where(many & ~((0.005 <= ends) & (ends <= 0.7)), 0, np.where((0.02 < ends) & (ends < 0.5) & (plain > 0.7) & (distinct > 0.5), 1, -1)),
            bad(total["digits"] > 0.4 * total["chars"]),
        ],
        axis=1,
    )
    for i in np.flatnonzero(p.n < 5).tolist():
        out[i] = _votes_of_characters("".join(_words(p.texts[i].as_py())))
    return out


def votes(text: str | None) -> tuple[int, ...]:
    """Votes of the heuristics in NAMES: 1 good, 0 bad, -1 none.  They overlap, so each kind of junk meets several; short texts get few votes."""
    return tuple(_votes_of(next(_portions(pa.array([text], pa.string()))))[0].tolist())


def _votes_of_characters(run: str) -> tuple[int, ...]:
    """Votes for a text almost without spaces: loud symbols, capitals, digits, and stutter, which is a share of equal neighbours."""
    n = len(run)
    none = [-1] * len(NAMES)
    if n < LONG_TEXT:
        return tuple(none)
    points = _points(run.encode())
    letters, capitals, digits, loud, foreign = (np.count_nonzero(_flags(points) & k) for k in (LETTER, CAPITAL, DIGIT, LOUD, FOREIGN))
    loud -= foreign  # such texts are marked off by their own punctuation
    again = np.count_nonzero(points[1:] == points[:-1])
    for name, bad in (("symbols", loud > 0.06 * n), ("shouting", capitals > 0.35 * max(1, letters)), ("digits", digits > 0.4 * n), ("stutter", again > 0.3 * n)):
        none[NAMES.index(name)] = 0 if bad else -1
    return tuple(none)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    claim({})
    found = Counter()
    for b in batches:
        for p in _portions(b.column(0)):
            found.update(map(tuple, _votes_of(p).tolist()))
    yield pa.RecordBatch.from_arrays([pa.array([",".join(map(str, k)) for k in found]), pa.array(list(found.values()), pa.int64())], ["pattern", "n"])


def em(votes: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> tuple[float, np.ndarray]:
    """Share of good documents and accuracies[labeller, class, vote] from patterns and their counts; classes bad, good; votes none, bad, good.

    The start takes each labeller to be right in most of its votes, which settles which class is the good one, and no round lets one call more than
    MOST_FALSE of the good documents bad.
    """
    k = votes.shape[1]
    prior, acc = 0.85, np.tile(np.array([[0.5, 0.45, 0.05], [0.6, 0.01, 0.39]]), (k, 1, 1))
    for _ in range(rounds):
        post = posterior(votes, prior, acc)
        good, bad = counts * post, counts * (1 - post)
        prior = float(np.clip(good.sum() / max(counts.sum(), 1e-9), 0.01, 0.99))
        for v in range(3):
            hit = votes == v - 1
            acc[:, 0, v] = (bad @ hit + 0.5) / (bad.sum() + 1.5)
            acc[:, 1, v] = (good @ hit + 0.5) / (good.sum() + 1.5)
        over = acc[:, 1, 1] > MOST_FALSE
        acc[over, 1, 0] += acc[over, 1, 1] - MOST_FALSE
        acc[over, 1, 1] = MOST_FALSE
    return prior, acc


def posterior(votes: np.ndarray, prior: float, acc: np.ndarray) -> np.ndarray:
    """Chance of being good, by pattern."""
    k = np.arange(votes.shape[1])
    lg = np.log(acc[k[None, :], 1, votes + 1]).sum(1) + np.log(prior)
    lb = np.log(acc[k[None, :], 0, votes + 1]).sum(1) + np.log(1 - prior)
    return 1 / (1 + np.exp(np.clip(lb - lg, -50, 50)))


def _kinds(points: np.ndarray, flags: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the shapes of words that end at stop, and where each shape begins."""
    kinds = np.select([flags & k != 0 for k in (CAPITAL, LETTER, DIGIT)], [np.uint32(ord(x)) for x in "Aa9"], points)
    kept = np.ones(len(kinds), bool)
    kept[1:] = (kinds[1:] != kinds[:-1]) | (flags[1:] & (CAPITAL | LETTER | DIGIT) == 0)
    start = np.concatenate([[0], stop[:-1]])[: len(stop)]
    kept[start] = True
    return kinds[kept], (np.cumsum(kept) - 1)[start]


def _pieces(shape: str) -> tuple[str, ...]:
    return tuple(shape[i : i + PIECE] for i in range(0, max(1, len(shape) - PIECE + APART), APART))


def shapes(word: str) -> tuple[str, ...]:
    """A word's shape: runs of capitals as A, of other letters as a, of digits as 9, other characters as they are; overlapping pieces of a long one."""
    points = _points(word.encode())
    return _pieces("".join(map(chr, _kinds(points, _flags(points), np.array([len(points)]))[0].tolist())))


def _features_of(p: _Portion) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed shares of shapes, pairs of shapes, repeated neighbours and the share of distinct words: text, place of the hash, value."""
    at, wholes = p.shaped()
    found = list(map(_pieces, wholes))
    numbers: dict[str, int] = {}
    flat = np.fromiter((numbers.setdefault(s, len(numbers)) for x in found for s in x), np.int64)
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    # The shapes of all places, one behind the other.
    at = at[p.at]
    size, first = sizes[at], (np.cumsum(sizes) - sizes)[at]
    shape, of = flat[np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())], np.repeat(p.of, size)
    n, kinds, inside = np.bincount(of, minlength=len(p.texts)), max(1, len(numbers)), of[1:] == of[:-1]
    of1, one, n1 = _counts(of, shape, kinds)
    of2, two, n2 = _counts(of[1:][inside], (shape[:-1] * kinds + shape[1:])[inside], kinds**2)
    pairs, two = np.unique(two, return_inverse=True)
    known, texts = list(numbers), np.flatnonzero(p.n)
    tenths = (10 * p.distinct[texts]).astype(np.int64)
    names = [*known, *("\x00".join((known[a], known[b])) for a, b in zip((pairs // kinds).tolist(), (pairs % kinds).tolist(), strict=True)), "\x01same", *(f"\x01distinct{k}" for k in range(11))]
    last = len(names) - 12
    of, name, count = np.concatenate([of1, of2, texts, texts]), np.concatenate([one, len(known) + two, np.full(len(texts), last), last + 1 + tenths]), np.concatenate([n1, n2, p.again[texts], n[texts]])
    ids: dict[str, int] = {}
    same = np.array([ids.setdefault(x, len(ids)) for x in names])
    if len(ids) < len(names):  # words that hold the marks of other names: what has one name counts together
        keys, at = np.unique(of * len(ids) + same[name], return_inverse=True)
        of, name, names, count = keys // len(ids), keys % len(ids), list(ids), np.bincount(at, count)
    hashes = np.array([zlib.crc32(x.encode()) % DIMS for x in names])
    return of, hashes[name], np.sqrt(count / (n[of] + SHRINK))


def features(text: str | None) -> tuple[list[int], list[float]]:
    """Places and values of a text's features."""
    _, idx, val = _features_of(next(_portions(pa.array([text], pa.string()))))
    return idx.tolist(), val.tolist()


def _prepared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for p in _portions(b.column(0)):
            of, idx, val = _features_of(p)
            by = np.argsort(of, kind="stable")
            ends = pa.array(np.cumsum([0, *np.bincount(of, minlength=len(p.texts))]), pa.int32())
            patterns = [",".join(map(str, v)) for v in _votes_of(p).tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(patterns, pa.string()), pa.ListArray.from_arrays(ends, pa.array(idx[by], pa.int32())), pa.ListArray.from_arrays(ends, pa.array(val[by], pa.float64()))], ["pattern", "idx", "val"])


class Scorer:
    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights.astype(np.float32), bias

    def scores(self, texts: pa.Array) -> np.ndarray:
        out = [np.zeros(0)]
        for p in _portions(texts):
            of, idx, val = _features_of(p)
            z = self.bias + np.bincount(of, self.weights[idx].astype(np.float64) * val, len(p.texts))
            out.append(1 / (1 + np.exp(-np.clip(z, -30.0, 30.0))))
        return np.concatenate(out)


def train(docs: DataFrame, text: str = "text", fitted: int = FITTED) -> tuple[Scorer, float, np.ndarray]:
    """Scorer, share of good documents and accuracies of the heuristics.  An empty table gives a scorer of 0.5 for all."""
    prepare(docs.sparkSession)
    k = len(NAMES)
    texts = docs.select(F.col(text).alias("text"))
    counted = texts.mapInArrow(_counted, "pattern string, n long").groupBy("pattern").agg(F.sum("n").alias("n")).toPandas()  # at most 3 ** k rows
    if not len(counted):
        return Scorer(np.zeros(DIMS), 0.0), 0.5, np.full((k, 2, 3), 1 / 3)
    found = np.array([[int(x) for x in p.split(",")] for p in counted["pattern"]])
    prior, acc = em(found, counted["n"].to_numpy(float))
    soft = dict(zip(counted["pattern"], posterior(found, prior, acc), strict=True))
    hashed = texts.withColumn("h", F.xxhash64("text"))
    sample = hashed.select("h").distinct().orderBy("h").limit(fitted)
    # One row for each text of the sample: equal texts have one hash.
    rows = hashed.join(F.broadcast(sample), "h").groupBy("h").agg(F.min("text").alias("text")).select("text")
    made = rows.mapInArrow(_prepared, "pattern string, idx array<int>, val array<double>").toArrow()
    y = np.array([soft[p] for p in made["pattern"].to_pylist()])
    lists = made["idx"].combine_chunks()
    if not len(y) or not len(lists):
        return Scorer(np.zeros(DIMS), float(np.log(prior / (1 - prior)))), prior, acc
    ptr = lists.offsets.to_numpy().astype(np.int64)
    w, b = fit(ptr - ptr[0], lists.flatten().to_numpy().astype(np.int64), made["val"].combine_chunks().flatten().to_numpy(), y, np.ones(len(y)), DIMS, L2, STEPS, RATE)
    return Scorer(w, b), prior, acc


def scored(docs: DataFrame, scorer: Scorer, text: str = "text") -> Column:
    prepare(docs.sparkSession)

    @F.arrow_udf("double")
    def of(t: pa.Array) -> pa.Array:
        return pa.array(scorer.scores(t))

    return of(F.col(text))


def classify(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, score, good`` for every row of docs; null and empty texts have no features and get the model's bias."""
    scorer, _, _ = train(docs, text)
    return docs.select("doc_id", scored(docs, scorer, text).alias("score")).withColumn("good", F.col("score") >= threshold)


def accepted(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose score reaches the threshold, with all their columns."""
    scorer, _, _ = train(docs, text)
    return docs.filter(scored(docs, scorer, text) >= threshold)
