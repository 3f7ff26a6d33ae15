"""Language-model scores by masked pseudo-likelihood.

A small network predicts every word from the two words on either side.  Every word of the corpus is counted by itself, in a table.  Frequent words are
entries of their own, known to all workers; the others share entries by hash, and their own counts come from the table by a join when texts are scored.
Entries belong to classes by frequency, whose number grows with the square root of the vocabulary, the most frequent words each to a class of its own;
log p(word | both sides) = log p(class | both sides), by the network, + log p(entry | class) + log p(word | entry), both by the corpus' counts.  The network
predicts a group of classes, then the class within it.  It is trained in numpy from a sample of positions of all documents: each task masks a fixed share
and descends on them from the weights of the last round, and the tasks' weights are averaged by what they have seen, in Spark.  Which positions are masked
follows from the document alone.  Words become entries once, in a written table that training and scoring read.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cache, claim, prepare, written

#: Entries and classes at least, words on each side, width of the hidden layer.
BUCKETS, CLASSES, SIDE, WIDTH = 1 << 16, 128, 2, 24
#: Words that workers know at most, and entries at least that the others share.  The others' counts stay in a table, so none is lost.
KNOWN, SHARED = 1 << 18, 1 << 14
#: Share of positions masked in a round, rounds, examples of a step, rate.
MASKED, ROUNDS, STEP, RATE = 0.1, 2, 512, 0.1
#: Fixed point of weights in sums, so that their order doesn't matter.
FIXED = 1 << 16
REMEMBERED = 1 << 20


#: Words that a task counts before it hands them on.
COUNTED = 1 << 18


def word_hash(word: bytes) -> int:
    """A word's key in the table of counts, 64 bits with sign."""
    h = xxhash.xxh3_64_intdigest(word)
    return h - (1 << 64) if h >> 63 else h


class _Buckets(dict):
    """Entries by word, of one vocabulary at a time."""

    def __init__(self):
        super().__init__()
        self.keys_of, self.known, self.shared = None, {}, 1

    def use(self, keys: np.ndarray, shared: int) -> None:
        if self.keys_of is None or shared != self.shared or not np.array_equal(keys, self.keys_of):
            self.clear()
            self.keys_of, self.known, self.shared = keys, dict(zip(keys.tolist(), range(len(keys)), strict=True)), shared

    def clear(self) -> None:
        super().clear()
        self.keys_of, self.known = None, {}

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            super().clear()
        h = word_hash(word)
        at = self.known.get(h)
        self[word] = at = len(self.known) + h % self.shared if at is None else at
        return at


_buckets = cache(_Buckets())


def words(text: bytes | None) -> list[bytes]:
    """The words of a text, A-Z in lower case."""
    return (text or b"").lower().split()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    claim(_buckets)
    found: Counter = Counter()

    def told() -> pa.RecordBatch:
        rows = [pa.array(list(map(word_hash, found)), pa.int64()), pa.array(list(found.values()), pa.int64())]
        found.clear()
        return pa.RecordBatch.from_arrays(rows, ["h", "n"])

    for b in batches:
        for text in b.column(0).cast(pa.binary()).to_pylist():
            found.update(words(text))
            if len(found) >= COUNTED:
                yield told()
    yield told()


def n_classes(n_words: int) -> int:
    """Classes for a vocabulary: the power of two at or above its square root, CLASSES at least."""
    return max(CLASSES, 1 << math.ceil(math.log2(max(1, n_words)) / 2))


class Classes:
    """Class of each entry and log p(entry | class), add-half smoothed.

    Three quarters of the classes are one known word each, the most frequent ones; an eighth are bands of frequency with like sums of roots of counts, and
    an eighth hold the shared entries, those from ``known`` on.
    """

    def __init__(self, counts: np.ndarray, known: int | None = None, n: int = CLASSES):
        self.n, self.known, size = n, len(counts) if known is None else known, len(counts)
        own, bands, rest = n - n // 4, n // 8, n // 8
        order = np.lexsort((np.arange(self.known), -counts[: self.known]))
        self.of = (n - rest + np.arange(size) % rest).astype(np.int64)
        self.of[order[:own]] = np.arange(min(own, self.known))
        mid = order[own:]
        if len(mid):
            upto = np.cumsum(np.sqrt(counts[mid] + 0.5))
            self.of[mid] = own + np.minimum(bands - 1, (upto / upto[-1] * bands).astype(np.int64))
        self.mass = counts + 0.5
        self.inside = np.log(self.mass / np.bincount(self.of, weights=self.mass, minlength=n)[self.of]).astype(np.float32)


def start(counts: np.ndarray, classes: Classes) -> list[np.ndarray]:
    """First weights: inputs by place and class (the last: beyond the text), hidden bias, weights and bias of groups of classes, and of classes in them."""
    r = np.random.default_rng(7)
    n = classes.n
    groups = 1 << ((n.bit_length() - 1) // 2)
    share = np.bincount(classes.of, weights=counts + 0.5, minlength=n) + 1e-3
    share /= share.sum()
    return [
        r.normal(0, 0.3, (2 * SIDE, n + 1, WIDTH)).astype(np.float32), np.zeros(WIDTH, np.float32),
        r.normal(0, 0.1, (WIDTH, groups)).astype(np.float32), np.log(share.reshape(groups, -1).sum(1)).astype(np.float32),
        r.normal(0, 0.1, (groups, WIDTH, n // groups)).astype(np.float32), np.log(share).reshape(groups, -1).astype(np.float32),
    ]


def _entries(texts: list[bytes | None], keys: np.ndarray, shared: int) -> list[np.ndarray]:
    """Entries of the words of each text."""
    _buckets.use(keys, shared)
    return [np.fromiter(map(_buckets.__getitem__, w), np.int32, len(w)) for w in map(words, texts)]


def _joined(entries: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The entries of all texts, -1 for SIDE places around each, and the number of words of each."""
    gap = np.full(SIDE, -1, np.int32)
    parts = [gap]
    for x in entries:
        parts += [x, gap]
    return np.concatenate(parts).astype(np.int64), np.array([len(x) for x in entries], np.int64)


def _encoded(batches: Iterator[pa.RecordBatch], keys: np.ndarray, shared: int) -> Iterator[pa.RecordBatch]:
    """Identifier and text to identifier, entries, and hashes of the words that aren't known."""
    claim(_buckets)
    for b in batches:
        texts = b.column(1).cast(pa.binary()).to_pylist()
        entries, hashes = _entries(texts, keys, shared), []
        for t, x in zip(texts, entries, strict=True):
            at = np.flatnonzero(x >= len(keys)).tolist()
            found = words(t) if at else []
            hashes.append([word_hash(found[i]) for i in at])
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.astype("<i4").tobytes() for x in entries], pa.binary()), pa.array(hashes, pa.list_(pa.int64()))], ["doc_id", "entries", "others"])


def encode(docs: DataFrame, keys: np.ndarray, shared: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, entries, others`` for every row: 32-bit entries of all words in order, and hashes of those that aren't known."""
    told = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return told.mapInArrow(lambda it: _encoded(it, keys, shared), "doc_id long, entries binary, others array<long>")


def _context(cls: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Classes on both sides of the places."""
    return np.stack([cls[at + d] for d in (*range(-SIDE, 0), *range(1, SIDE + 1))])


def _hidden(w: list[np.ndarray], ctx: np.ndarray) -> np.ndarray:
    z = w[1] + w[0][0][ctx[0]]
    for p in range(1, 2 * SIDE):
        z = z + w[0][p][ctx[p]]
    return np.tanh(z)


def _normal(z: np.ndarray) -> np.ndarray:
    z = z - z.max(-1, keepdims=True)
    return z - np.log(np.exp(z).sum(-1, keepdims=True))


def _log_softmax(w: list[np.ndarray], h: np.ndarray) -> np.ndarray:
    """Log-probabilities of all classes."""
    within = _normal(np.einsum("nw,gws->ngs", h, w[4]) + w[5])
    return (within + _normal(h @ w[2] + w[3])[:, :, None]).reshape(len(h), -1)


def _by_group(group: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each group that is there, with its rows."""
    order = np.argsort(group, kind="stable")
    keys, first = np.unique(group[order], return_index=True)
    yield from zip(keys.tolist(), np.split(order, first[1:]), strict=True)


def _log_prob(w: list[np.ndarray], h: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Log-probability of one class a row; only its group is worked out."""
    group, place = np.divmod(y, w[4].shape[2])
    out = _normal(h @ w[2] + w[3])[np.arange(len(y)), group]
    for k, rows in _by_group(group):
        out[rows] += _normal(h[rows] @ w[4][k] + w[5][k])[np.arange(len(rows)), place[rows]]
    return out


def descend(w: list[np.ndarray], cls: np.ndarray, at: np.ndarray, g2: list[np.ndarray]) -> None:
    """Adagrad steps in place over the masked places; only weights of classes and groups that occur are touched."""

    def step(k: int, at: object, g: np.ndarray) -> None:
        total = g2[k][at] + g * g
        g2[k][at] = total
        w[k][at] -= RATE * g / (np.sqrt(total) + 1e-6)

    for lo in range(0, len(at), STEP):
        part = at[lo : lo + STEP]
        ctx, y, n = _context(cls, part), cls[part], len(part)
        h = _hidden(w, ctx)
        group, place = np.divmod(y, w[4].shape[2])
        d = np.exp(_normal(h @ w[2] + w[3]))
        d[np.arange(n), group] -= 1
        d /= n
        dh = d @ w[2].T
        for k, rows in _by_group(group):
            hk = h[rows]
            dk = np.exp(_normal(hk @ w[4][k] + w[5][k]))
            dk[np.arange(len(rows)), place[rows]] -= 1
            dk /= n
            dh[rows] += dk @ w[4][k].T
            step(4, k, hk.T @ dk)
            step(5, k, dk.sum(0))
        dh *= 1 - h * h
        for p in range(2 * SIDE):
            order = np.argsort(ctx[p], kind="stable")
            keys, first = np.unique(ctx[p][order], return_index=True)
            step(0, (p, keys), np.add.reduceat(dh[order], first, axis=0))
        step(1, ..., dh.sum(0))
        step(2, ..., h.T @ d)
        step(3, ..., d.sum(0))


def masked(entries: list[np.ndarray], round_: int) -> np.ndarray:
    """Which words of the texts are masked in a round: a share that follows from the text and the place in it, not from chance or the task."""
    sizes = np.array([len(x) for x in entries], np.int64)
    seed = np.repeat(np.array([zlib.crc32(x.tobytes()) for x in entries], np.uint64), sizes)
    place = (np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.uint64)
    key = (place * np.uint64(0x9E3779B97F4A7C15) + seed + np.uint64(round_ * 7919)) * np.uint64(0xBF58476D1CE4E5B9)
    return ((key ^ (key >> np.uint64(29))) * np.uint64(0x94D049BB133111EB) >> np.uint64(40)).astype(np.float64) < MASKED * (1 << 24)


def _trained(batches: Iterator[pa.RecordBatch], w: list[np.ndarray], of: np.ndarray, round_: int) -> Iterator[pa.RecordBatch]:
    w, seen, g2 = [x.copy() for x in w], 0, [np.full_like(x, 1e-4) for x in w]
    of = np.append(of, w[0].shape[1] - 1)  # -1: beyond the text
    for b in batches:
        entries = [np.frombuffer(x, "<i4") for x in b.column(0).to_pylist()]
        joined, _ = _joined(entries)
        at = np.flatnonzero(joined >= 0)[masked(entries, round_)]
        descend(w, of[joined], at, g2)
        seen += len(at)
    if seen:
        flat = np.concatenate([x.ravel() for x in w]).astype(np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat)), pa.int64()), pa.array(np.rint(flat * seen * FIXED / 1024).astype(np.int64)), pa.array(np.full(len(flat), seen), pa.int64())], ["i", "w", "seen"])


class Model:
    """Weights, classes, hashes of the known words, and the table ``h, n`` of all other words' counts; None if there are none."""

    def __init__(self, weights: list[np.ndarray], classes: Classes, keys: np.ndarray, others: DataFrame | None = None):
        self.weights, self.classes, self.keys, self.others = weights, classes, keys, others

    def __getstate__(self) -> dict:
        return self.__dict__ | {"others": None}  # a table stays with the driver

    def places(self, entries: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of words of each text; entry and log-probability of each word's entry, in order."""
        joined, sizes = _joined(entries)
        cls = np.append(self.classes.of, self.classes.n)[joined]
        at = np.flatnonzero(joined >= 0)
        lp = np.empty(len(at), np.float64)
        for lo in range(0, len(at), 8192):
            part = at[lo : lo + 8192]
            lp[lo : lo + 8192] = _log_prob(self.weights, _hidden(self.weights, _context(cls, part)), cls[part]) + self.classes.inside[joined[part]]
        return sizes, joined[at], lp

    def log_probs(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """Number of words and summed log-probabilities of the words' entries, of each text."""
        sizes, _, lp = self.places(_entries(texts, self.keys, len(self.classes.of) - len(self.keys)))
        return sizes, np.bincount(np.repeat(np.arange(len(texts)), sizes), weights=lp, minlength=len(texts))


def vocabulary(texts: DataFrame) -> tuple[np.ndarray, np.ndarray, DataFrame | None, int]:
    """Hashes of the known words, counts of all entries, the table of the other words and the number of words, from a column of texts.

    Known are all words from the least count on that at most KNOWN words reach.
    """
    counted = written(texts.mapInArrow(_counted, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "lm-words")
    levels = counted.groupBy("n").agg(F.count("*").alias("words")).toPandas().sort_values("n", ascending=False)  # a row per count, at most the root of twice the words
    upto = levels["words"].cumsum().to_numpy()
    least = int(levels["n"].to_numpy()[upto <= KNOWN][-1]) if len(upto) and upto[0] <= KNOWN else None
    top = counted.filter(F.col("n") >= least).toPandas().sort_values("h") if least else None
    keys = top["h"].to_numpy(np.int64) if least else np.zeros(0, np.int64)
    shared = max(BUCKETS - len(keys), SHARED)
    counts = np.zeros(len(keys) + shared)
    counts[: len(keys)] = top["n"] if least else 0
    n_words = int(upto[-1]) if len(upto) else 0
    if n_words == len(keys):
        return keys, counts, None, n_words
    others = counted.filter(F.col("n") < least) if least else counted
    held = others.groupBy(F.pmod("h", F.lit(shared)).alias("e")).agg(F.sum("n").alias("n")).toPandas()  # at most BUCKETS rows
    counts[len(keys) + held["e"].to_numpy()] = held["n"]
    return keys, counts, others, n_words


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> tuple[Model, DataFrame]:
    """Counts and network over all documents, and the documents' entries, a written table for scored().  Without any words the model is the smoothed start.

    Null and empty texts have no words; repeated rows count as often as they come; other columns are ignored.
    """
    prepare(docs.sparkSession)
    keys, counts, others, n_words = vocabulary(docs.select(F.col(text_col).alias("text")))
    classes = Classes(counts, len(keys), n_classes(n_words))
    made = written(encode(docs, keys, len(counts) - len(keys), id_col, text_col), "lm-entries")
    w = start(counts, classes)
    shapes = [x.shape for x in w]
    for r in range(rounds):
        of, now = classes.of, w
        rows = made.select("entries").mapInArrow(lambda it, now=now, r=r: _trained(it, now, of, r), "i long, w long, seen long")
        mean = rows.groupBy("i").agg(F.sum("w").alias("w"), F.sum("seen").alias("seen")).toPandas().sort_values("i")  # a row per weight
        if not len(mean):
            break
        flat = (mean["w"] * 1024 / FIXED / mean["seen"]).to_numpy(np.float32)
        at = np.cumsum([0, *(int(np.prod(s)) for s in shapes)])
        w = [flat[a:b].reshape(s) for a, b, s in zip(at, at[1:], shapes, strict=False)]
    return Model(w, classes, keys, others), made


def _scored(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """Counts and log-probabilities; words that aren't known count as unseen (a mass of one half)."""
    known = len(model.keys)
    for b in batches:
        n, entry, lp = model.places([np.frombuffer(x, "<i4") for x in b.column(1).to_pylist()])
        other = entry >= known
        lp[other] += np.log(0.5) - np.log(model.classes.mass[entry[other]])
        total = np.bincount(np.repeat(np.arange(len(n)), n), weights=lp, minlength=len(n))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(total.astype(np.float64)), b.column(2)], ["doc_id", "n_words", "log_prob", "others"])


def scored(made: DataFrame, model: Model) -> DataFrame:
    """``doc_id, n_words, log_prob, mean_log_prob, perplexity`` for every row of encode(); texts without words have log_prob 0 and null means."""
    out = made.mapInArrow(lambda it: _scored(it, model), "doc_id long, n_words long, log_prob double, others array<long>")
    if model.others is not None:
        # Each word's own count in place of the half that _scored took; sums in fixed point, so that their order doesn't matter.
        rows = written(out.withColumn("row", F.monotonically_increasing_id()), "lm-scores")
        own = model.others.select("h", F.rint(F.log(2 * F.col("n")) * FIXED * FIXED).cast("long").alias("x"))
        more = rows.select("row", F.explode("others").alias("h")).join(own, "h").groupBy("row").agg((F.sum("x") / FIXED / FIXED).alias("more"))
        out = rows.join(more, "row", "left").withColumn("log_prob", F.col("log_prob") + F.coalesce("more", F.lit(0.0)))
    out = out.select("doc_id", "n_words", "log_prob")
    mean = F.when(F.col("n_words") > 0, F.col("log_prob") / F.col("n_words"))
    return out.withColumn("mean_log_prob", mean).withColumn("perplexity", F.exp(-F.col("mean_log_prob")))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """scored() of any documents, also such as the model has never seen."""
    prepare(docs.sparkSession)
    return scored(encode(docs, model.keys, len(model.classes.of) - len(model.keys), id_col, text_col), model)
