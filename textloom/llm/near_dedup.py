"""Near-duplicate classes of documents by bottom-k sketches.

1. One hash function maps each document's word shingles to 64 bits; the k smallest values are its sketch, a digest of all values its class key.  Equal
   sets fall into one class before anything is compared, so copies never meet each other.
2. Retained values are ordered by how many classes retain them, rarest first.  Two sets with the wanted similarity share at least ``least_overlap``
   values, but with the chance MISS where both sets are larger than a sketch, so they meet in an inverted list of the first ``size - least_overlap + 1``
   values of each; what follows, such as passages that very many documents share, needs no list.
3. Lists of two give a pair, which the estimate from the union's sketch may drop.  In longer lists all members are compared with one pivot, the most
   central one, by their full sets.  A member is then known by its difference D to the pivot, |x ^ y| = |D_x ^ D_y|, so two members that are linked share
   at least (W_x + W_y) / 2 values of their differences, W = |D| - (1 - j) / (1 + j) * |x|, and as |D_x| and |D_y| differ by no more than |x ^ y|, W_y is no
   less than W_x - 2 (1 - j) / (1 + j) * |x| / j.  The first values of each difference make new lists, exact prefixes for that overlap: those that the pivot
   lacks before those that it has, the rarest of the group first, so what all copies have in common no longer occurs.  Lists that need a
   bounded number of comparisons give the pairs whose sizes and places in the lists allow a link; longer ones get pivots of their own, until none is left.
   Members that are connected already, through the pivot or one before it, aren't paired again; after the first ones pivots descend in a fixed order, so the
   rounds end.  From here on no link between classes that aren't connected is lost.
4. Classes are joined over the links by hooking and pointer jumping on tables in the shared folder.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, prepare, written

#: Words of a shingle, similarity as a fraction, values that a sketch retains, chance to miss a pair at the similarity.
WORDS, SIMILAR, KEPT, MISS = 5, (3, 4), 48, 1e-9
#: Members from which a first pivot is chosen anew, among so many central candidates, by likeness to so many members.
MANY, CANDIDATES, JUDGES = 64, 16, 32
#: Lists of differences whose members need at most so many comparisons of four numbers, with each other or of one side with the other, and have at most so
#: many members, do without a pivot.
CHECKS, SHORT = 1 << 21, 1 << 13
#: Bits by digest that tell, before texts are shuffled, which ones can be asked for.
SLOTS = 1 << 24
#: Bytes of texts whose words are hashed at once; a longer text is taken by itself.
AT_ONCE = 1 << 20

_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
_SPACE = np.array([bytes([c]).isspace() for c in range(256)])
#: Masks of the first 0 to 8 bytes of eight.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], "<u8")


def _word_hashes(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit hashes of words by their place in data, which has 8 bytes beyond the last; eight bytes of all words at a time."""
    eights = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    h = size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    left, at, rest = np.arange(len(start)), start, size
    while len(left):
        x = (h[left] ^ (eights[at] & _FIRST[np.minimum(rest, 8)])) * np.uint64(0xD6E8FEB86659FD93)
        h[left] = x ^ (x >> np.uint64(32))
        more = rest > 8
        left, at, rest = left[more], at[more] + 8, rest[more] - 8
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def _shingle_hashes(a: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of all runs of k words."""
    n = len(a) - k + 1
    h = np.full(n, k, np.uint64)
    for i in range(k):
        h = (h ^ a[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h.view(np.int64)


def _sets_of(data: np.ndarray, ends: np.ndarray, words: int) -> Iterator[np.ndarray]:
    """shingle_set() of neighbouring texts by the places in data where they end, the first being where the first one begins."""
    ends = ends - ends[0]
    n = int(ends[-1])
    data = np.concatenate([_LOWER[data[:n]], np.zeros(8, np.uint8)])
    inside, first = np.zeros(n + 2, bool), np.zeros(n + 1, bool)
    inside[1:-1], first[ends] = ~_SPACE[data[:n]], True
    start = np.flatnonzero(inside[1:] & (~inside[:-1] | first))
    stop = np.flatnonzero(inside[:-1] & (~inside[1:] | first))
    a = _word_hashes(data, start, stop - start)
    runs = _shingle_hashes(a, words) if len(a) >= words else None
    bounds = np.searchsorted(start, ends).tolist()
    for lo, hi in zip(bounds, bounds[1:], strict=False):
        # Runs that reach into the next text are left out.
        x = runs[lo : hi - words + 1] if hi - lo >= words else _shingle_hashes(a[lo:hi], hi - lo) if hi > lo else np.zeros(0, np.int64)
        x.sort()
        new = x[1:] != x[:-1]
        yield x if new.all() else np.concatenate([x[:1], x[1:][new]])


def shingle_sets(texts: pa.Array, words: int = WORDS) -> Iterator[np.ndarray]:
    """shingle_set() of each text; null is empty."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + AT_ONCE, "right")) - 1)
        yield from _sets_of(data[ends[at] :], ends[at : to + 1], words)
        at = to


def shingle_set(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text in UTF-8, A-Z in lower case; of all words if there are fewer than a shingle has."""
    return next(shingle_sets(pa.array([text], pa.binary()), words))


def least_overlap(size: int, kept: int = KEPT, similar=SIMILAR, miss: float = MISS) -> int:
    """Values that the sketch of a set of this size shares at least with that of a similar set.

    Of the union's kept values each is shared with a chance of the similarity or more; smaller sets are in their sketch as a whole, and at most
    a third (at 3/4) of those of the union may be beyond the sketch.
    """
    j = similar[0] / similar[1]
    if size < kept:
        return max(1, math.ceil(size * (2 * j - 1) / j - 1e-9))
    tail, t = 0.0, 0
    while t < kept:
        tail += math.comb(kept, t) * j**t * (1 - j) ** (kept - t)
        if tail > miss:
            break
        t += 1
    return max(1, t)


def _sketches(batches: Iterator[pa.RecordBatch], words: int, kept: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys, sizes, sketches = [], [], []
        for s in shingle_sets(b.column(1), words):
            keys.append(hashlib.blake2b(s, digest_size=16).digest() if len(s) else None)
            sizes.append(len(s))
            sketches.append(s[:kept].copy())
        ends = np.cumsum([0, *map(len, sketches)])
        values = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *sketches])))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), values], ["doc_id", "digest", "node", "n", "sketch"])


def _sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """doc_id, text, cid, node to cid, shingles for the rows whose set is the class's."""
    for b in batches:
        cids, sets = [], []
        for s, cid, node in zip(shingle_sets(b.column(1), words), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            if len(s) and hashlib.blake2b(s, digest_size=16).digest() == node:
                cids.append(cid)
                sets.append(s.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(cids, pa.int64()), pa.array(sets, pa.binary())], ["cid", "shingles"])


def _compared(batches: Iterator[pa.RecordBatch], detailed: bool) -> Iterator[pa.RecordBatch]:
    """sa, sb, * to *, sizes of both sets, what they share; detailed: also what only b and what only a has."""
    for batch in batches:
        na, nb, both, only_a, only_b = [], [], [], [], []
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = np.frombuffer(x, np.int64), np.frombuffer(y, np.int64)
            at = np.searchsorted(x, y)
            at[at == len(x)] = 0
            shared = x[at] == y
            na.append(len(x))
            nb.append(len(y))
            both.append(int(shared.sum()))
            if detailed:
                only = np.ones(len(x), bool)
                only[at[shared]] = False
                only_a.append(x[only])
                only_b.append(y[~shared])
        cols = [*batch.columns[2:], *(pa.array(c, pa.int64()) for c in (na, nb, both)), *([pa.array(c, pa.list_(pa.int64())) for c in (only_b, only_a)] if detailed else [])]
        yield pa.RecordBatch.from_arrays(cols, [*batch.schema.names[2:], "na", "nb", "both", *(["more", "less"] if detailed else [])])


def _with_sets(pairs: DataFrame, sets: DataFrame, detailed: bool) -> DataFrame:
    """Compare pairs (a, b, *) in full; all their columns stay."""
    on_b = pairs.join(sets.select(F.col("cid").alias("b"), F.col("shingles").alias("sb")), "b")
    rows = on_b.join(sets.select(F.col("cid").alias("a"), F.col("shingles").alias("sa")), "a").select("sa", "sb", *pairs.columns)
    schema = [f"{f.name} {f.dataType.simpleString()}" for f in pairs.schema] + ["na long", "nb long", "both long"] + ["more array<long>", "less array<long>"] * detailed
    return rows.mapInArrow(lambda it: _compared(it, detailed), ", ".join(schema))


def _similar(similar) -> Column:
    """both / union >= similar, in whole numbers."""
    return F.lit(similar[1]) * F.col("both") >= F.lit(similar[0]) * (F.col("na") + F.col("nb") - F.col("both"))


def links(docs: DataFrame, words: int = WORDS, similar=SIMILAR, kept: int = KEPT, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Membership (doc_id, digest, node, n), classes (cid, node, doc_id, digest, n) and links between classes (a, b, both), all written tables."""
    prepare(docs.sparkSession)
    told = _told(docs, id_col, text_col)
    members = written(told.mapInArrow(lambda it: _sketches(it, words, kept), "doc_id long, digest long, node binary, n long, sketch array<long>"), "near-members")
    grouped = members.filter("n > 0").groupBy("node").agg(_first().alias("own"), F.first("n").alias("n"), F.first("sketch").alias("sketch")).select("node", "own.doc_id", "own.digest", "n", "sketch")
    classes = written(grouped.withColumn("cid", F.monotonically_increasing_id()), "near-classes")

    # Inverted lists of the rarest retained values.  Counts are written first, so that a join on a very common value can be split.
    least = F.element_at(F.array(*[F.lit(least_overlap(s, kept, similar)) for s in range(1, kept + 1)]), F.size("sketch"))
    entries = classes.select("cid", F.explode("sketch").alias("v"))
    common = written(entries.groupBy("v").agg(F.count("*").alias("df")).filter("df > 1"), "near-common")
    shared = entries.join(common, "v").groupBy("cid").agg(F.array_sort(F.collect_list(F.struct("df", "v"))).alias("vs"))
    placed = shared.join(classes.select("cid", "n", least.alias("least"), F.size("sketch").alias("kept")), "cid")
    # Values that no other class retains come first in the order, without lists.
    room = F.col("kept") - F.col("least") + 1 - (F.col("kept") - F.size("vs"))
    central = F.aggregate("vs", F.lit(0.0), lambda s, x: s + F.log2(x["df"])) / F.col("kept")
    index = placed.filter(room > 0).select("cid", F.round(central, 6).alias("central"), F.explode(F.slice("vs", F.lit(1), F.least(room, F.size("vs")))).alias("x")).select(F.col("x.v").alias("v"), "cid", "central")
    index = written(index, "near-index")
    lists = written(index.groupBy("v").agg(F.count("*").alias("m"), F.max(F.struct("central", "cid")).alias("pivot")).filter("m > 1"), "near-lists")
    met = index.join(lists, "v").filter("cid <> pivot.cid").groupBy(F.col("pivot.cid").alias("a"), F.col("cid").alias("b"))
    pairs = written(met.agg(F.max(F.col("m") > 2).alias("long"), F.first("central").alias("central"), F.first("pivot.central").alias("central_a")), "near-pairs")

    # Full sets of the classes that are in a list with others.
    active = pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct()
    owners = classes.join(active, "cid").select(F.col("doc_id").alias("owner"), F.col("digest").alias("own"), "cid", "node")
    # By identifier and digest of the text: rows that share an identifier, or have none, each meet what they own themselves.
    mine = _asked(told, owners).join(owners, F.col("doc_id").eqNullSafe(F.col("owner")) & (F.col("digest") == F.col("own")))
    sets = mine.select("doc_id", "text", "cid", "node").mapInArrow(lambda it: _sets(it, words), "cid long, shingles binary")
    # Equal texts can repeat under one identifier.
    sets = written(sets.groupBy("cid").agg(F.first("shingles").alias("shingles")), "near-sets")

    pairs = _recentred(pairs, sets).select("a", "b", "long", "central", F.col("a").alias("ta"), F.col("b").alias("tb"))
    found, single = [], []
    while pairs is not None:
        single.append(pairs.filter("NOT long").select("a", "b"))
        if pairs.filter("long").isEmpty():
            break
        probed = written(_with_sets(pairs.filter("long"), sets, True), "near-probed")
        found.append(probed.filter(_similar(similar)).select("a", "b", "both"))
        pairs = _next_lists(probed, similar)
    two = _estimated(_union(single).distinct(), classes.select("cid", "n", "sketch"), kept, similar)
    found.append(_with_sets(two, sets, False).filter(_similar(similar)).select("a", "b", "both"))
    return members, classes, written(_union(found).distinct(), "near-links")


def _told(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows with a digest of their text, which with the identifier says which rows are equal."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("digest", F.xxhash64("text"))


def _asked(told: DataFrame, owners: DataFrame) -> DataFrame:
    """The rows of told whose digest can be an owner's, and a few others; SLOTS bits go to all tasks."""
    slot = owners.select(F.col("own").bitwiseAND(SLOTS - 1).alias("s"))
    found = slot.groupBy((F.col("s") / 64).cast("int").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s % 64 AS int))")).alias("bits")).toArrow()  # SLOTS / 64 rows at most
    bits = np.zeros(SLOTS >> 6, np.int64)
    bits[found["at"].to_numpy()] = found["bits"].to_numpy()
    sent = told.sparkSession.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def can(digest: pd.Series) -> pd.Series:
        s = digest.to_numpy(np.int64) & (SLOTS - 1)
        return pd.Series((sent.value[s >> 6] >> (s & 63)) & 1 == 1)

    return told.filter(can("digest"))


def _first() -> Column:
    """The first row by identifier, then digest; rows without identifier come last."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _medoid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each group's candidates the one most like its judges."""
    for batch in batches:
        best = []
        for rows in batch.column(1).to_pylist():
            sets = [(r["judge"], r["b"], np.frombuffer(r["shingles"], np.int64)) for r in rows]
            likeness = {}
            for judge, b, x in sets:
                if not judge:
                    both = [len(np.intersect1d(x, y, assume_unique=True)) for other, _, y in sets if other]
                    likeness[b] = sum(n / (len(x) + len(y) - n) for n, (_, _, y) in zip(both, (s for s in sets if s[0]), strict=True))
            best.append(max(likeness, key=lambda b: (round(likeness[b], 9), b)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best, pa.int64())], ["a", "best"])


def _recentred(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The same groups, but those of many members with the pivot that is most like a few of them.  A better pivot saves work; it changes no result."""
    many = pairs.filter("long").groupBy("a").agg(F.count("*").alias("m"), F.first("central_a").alias("central_a")).filter(F.col("m") > MANY)
    many = written(many.select("a", "central_a"), "near-many")
    if many.isEmpty():
        return pairs
    inside = pairs.filter("long").select("a", "b", "central").join(many.select("a"), "a", "left_semi")
    place = lambda *by: F.row_number().over(Window.partitionBy("a").orderBy(*by))
    candidates = inside.withColumn("n", place(F.desc("central"), F.desc("b"))).filter(F.col("n") < CANDIDATES)
    judges = inside.withColumn("n", place(F.xxhash64("b"), F.col("b"))).filter(F.col("n") <= JUDGES)
    asked = candidates.select("a", "b", F.lit(False).alias("judge")).unionByName(judges.select("a", "b", F.lit(True).alias("judge"))).unionByName(many.select("a", F.col("a").alias("b"), F.lit(False).alias("judge")))
    told = asked.join(sets.withColumnRenamed("cid", "b"), "b").groupBy("a").agg(F.collect_list(F.struct("judge", "b", "shingles")).alias("x"))
    chosen = told.mapInArrow(_medoid, "a long, best long").join(many, "a").select(F.col("a").alias("was"), "best", "central_a")
    chosen = written(chosen, "near-chosen")
    moved = pairs.filter("long").join(chosen.withColumnRenamed("central_a", "c"), F.col("a") == F.col("was"))
    old = F.col("b") == F.col("best")
    moved = moved.select(F.col("best").alias("a"), F.when(old, F.col("a")).otherwise(F.col("b")).alias("b"), "long", F.when(old, F.col("c")).otherwise(F.col("central")).alias("central")).filter("a <> b")
    kept = pairs.join(chosen, F.col("long") & (F.col("a") == F.col("was")), "left_anti").select("a", "b", "long", "central")
    return written(kept.unionByName(moved).groupBy("a", "b").agg(F.max("long").alias("long"), F.first("central").alias("central")), "near-pairs")


def _next_lists(probed: DataFrame, similar) -> DataFrame | None:
    """From members compared with their pivots (a, b, tags, sizes, more, less), the pairs with new pivots; None if all that can be linked is connected or paired.

    Two classes with one tag are known to be connected.  ``con``: connected with the pivot.  Two connected ones need no pair; one that isn't has a W above
    (q - p) * n of the pivot, so every pair that needs to be compared has a positive overlap.
    """
    p, q = similar
    tag = F.when(_similar(similar), F.col("ta")).otherwise(F.col("tb"))
    size = F.col("na") + F.col("nb") - 2 * F.col("both")
    known = probed.withColumn("tag", tag).withColumn("con", F.col("tag") == F.col("ta")).withColumn("d", size).withColumn("w", F.lit(p + q) * size - F.lit(q - p) * F.col("nb"))
    ends = known.groupBy("a").agg(F.min(F.when(~F.col("con"), F.col("w"))).alias("wu"), F.min(F.when(F.col("con"), F.col("w"))).alias("wc"), F.min("tag").alias("lo"), F.max("tag").alias("hi"))
    ends = written(ends.filter("lo <> hi").select("a", "wu", "wc"), "near-ends")
    if ends.isEmpty():
        return None
    alone = F.ceil((F.lit(p) * F.col("w") - F.lit((q - p) * q) * F.col("nb")) / F.lit(p * (p + q)))  # by the size of its own difference
    overlap = lambda least: F.when(F.col(least).isNotNull(), F.greatest(F.lit(1), alone, F.ceil((F.col("w") + F.col(least)) / F.lit(2 * (p + q)))))
    # How long a prefix is among the unconnected, and between them and the connected: what is left of the difference, and a value more.
    prefix = lambda c: F.coalesce(F.greatest(F.lit(0), F.col("d") - c + 1), F.lit(0)).cast("int")
    live = known.join(ends, "a").withColumn("ru", prefix(overlap("wu"))).withColumn("rc", F.when(F.col("con"), 0).otherwise(prefix(overlap("wc"))))
    live = live.filter("ru > 0 OR rc > 0")
    # Values that the pivot lacks come first; those that it has are needed only where a prefix reaches beyond them.
    less = F.when(F.greatest("ru", "rc") > F.size("more"), F.col("less")).otherwise(F.array().cast("array<long>"))
    both = F.concat(F.transform("more", lambda v: F.struct(F.lit(0).alias("o"), v.alias("v"))), F.transform(less, lambda v: F.struct(F.lit(1).alias("o"), v.alias("v"))))
    values = live.select("a", "b", "tag", "con", "central", "d", "w", "nb", "ru", "rc", F.size("more").alias("first"), F.size("less").alias("second"), F.explode(both).alias("x")).select("*", "x.o", "x.v").drop("x")
    common = written(values.groupBy("a", "v").agg(F.count("*").alias("df")).filter("df > 1"), "near-common")
    order = F.array_sort(F.collect_list(F.struct("o", "df", "v")))
    placed = values.join(common, ["a", "v"]).groupBy("a", "b").agg(*[F.first(c).alias(c) for c in ("tag", "con", "central", "d", "w", "nb", "ru", "rc", "first", "second")], order.alias("vs"))
    # Among values of one kind those that no other member has come first, without lists.
    placed = placed.withColumn("n0", F.size(F.filter("vs", lambda x: x["o"] == 0))).withColumn("n1", F.size("vs") - F.col("n0"))
    upto = lambda room, n: F.least(F.greatest(F.lit(0), room), F.col(n))
    inside = lambda room: upto(F.col(room) - F.col("first") + F.col("n0"), "n0") + upto(F.col(room) - F.col("first") - F.col("second") + F.col("n1"), "n1")
    kind = lambda k, room, when: F.struct(F.lit(k).alias("kind"), F.when(when, inside(room)).otherwise(0).alias("room"))
    kinds = placed.withColumn("k", F.explode(F.array(kind(0, "ru", ~F.col("con")), kind(1, "ru", F.col("con")), kind(1, "rc", ~F.col("con"))))).filter("k.room > 0")
    entries = kinds.select("*", F.posexplode(F.slice("vs", F.lit(1), F.col("k.room"))).alias("t", "x"))
    place = F.when(F.col("x.o") == 0, F.col("first") - F.col("n0") + F.col("t")).otherwise(F.col("first") + F.col("second") - F.col("n1") - F.col("n0") + F.col("t"))
    entries = entries.select("a", F.col("k.kind").alias("kind"), F.col("x.v").alias("v"), "b", "tag", "con", "central", "d", "w", F.col("nb").alias("n"), (F.col("d") - place).alias("left"))
    entries = written(entries, "near-index")
    # What the first value that two members share leaves of both must hold their overlap; here, that with the likeliest partner of the list.
    least = entries.groupBy("a", "kind", "v").agg(F.min(F.when(F.col("con"), F.col("w"))).alias("lc"), F.min(F.when(~F.col("con"), F.col("w"))).alias("lu"), F.count("*").alias("m")).filter("m > 1")
    partner = F.when((F.col("kind") == 0) | F.col("con"), F.col("lu")).otherwise(F.col("lc"))
    entries = entries.join(written(least.drop("m"), "near-least"), ["a", "kind", "v"]).filter(2 * (p + q) * F.col("left") >= F.col("w") + partner).drop("lc", "lu")
    entries = written(entries, "near-index")
    lists = entries.groupBy("a", "kind", "v").agg(F.count("*").alias("m"), F.count_if("con").alias("mc"), F.max(F.struct("central", "b", "tag")).alias("top"), F.min("tag").alias("lo"), F.max("tag").alias("hi"))
    lists = lists.filter("m > 1 AND lo <> hi AND (kind = 0 OR mc BETWEEN 1 AND m - 1)")
    checks = F.when(F.col("kind") == 0, F.col("m") * (F.col("m") - 1) / 2).otherwise(F.col("mc") * (F.col("m") - F.col("mc")))
    lists = written(lists.select("a", "kind", "v", ((F.col("m") <= SHORT) & (checks <= CHECKS)).alias("short"), "top"), "near-lists")
    met = entries.join(lists, ["a", "kind", "v"])
    tags = F.struct((F.col("tag") != F.col("top.tag")).alias("apart"), F.col("top.tag").alias("ta"), F.col("tag").alias("tb"))
    long = met.filter(~F.col("short") & (F.col("b") != F.col("top.b"))).groupBy(F.col("top.b").alias("a"), "b").agg(F.first("central").alias("central"), F.min(tags).alias("t"))
    long = long.select("a", "b", F.lit(True).alias("long"), "central", "t.ta", "t.tb")
    side = lambda con: F.collect_list(F.when(con, F.struct("central", "b", "tag", "d", "w", "n", "left")))
    short = met.filter("short").groupBy("a", "kind", "v").agg(side(F.col("con") | (F.col("kind") == 0)).alias("xs"), side(~F.col("con")).alias("ys"))
    can = lambda x, y: (2 * (p + q) * F.least(x["left"], y["left"]) >= x["w"] + y["w"]) & ((p + q) * F.abs(x["d"] - y["d"]) <= (q - p) * (x["n"] + y["n"])) & (p * x["n"] <= q * y["n"]) & (p * y["n"] <= q * x["n"])
    needed = lambda x: F.filter("ys", lambda y: (x["tag"] != y["tag"]) & can(x, y) & ((F.col("kind") == 1) | (x["b"] < y["b"])))
    both = F.flatten(F.transform("xs", lambda x: F.transform(needed(x), lambda y: F.struct(F.least(x["b"], y["b"]).alias("a"), F.greatest(x["b"], y["b"]).alias("b")))))
    short = short.select(F.explode(both).alias("x")).select("x.a", "x.b").distinct()
    return written(long.unionByName(short.withColumn("long", F.lit(False)), allowMissingColumns=True), "near-pairs")


def _estimated(pairs: DataFrame, sized: DataFrame, kept: int, similar) -> DataFrame:
    """Pairs whose union's sketch holds enough shared values."""
    of = lambda c: sized.select(F.col("cid").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"k{c}"))
    p, q = similar
    union = F.slice(F.array_sort(F.array_union("ka", "kb")), 1, kept)
    shared = F.size(F.array_intersect(union, F.array_intersect("ka", "kb")))
    needed = F.element_at(F.array(*[F.lit(least_overlap(s, kept, similar)) for s in range(1, kept + 1)]), F.least(F.size("ka"), F.size("kb")))
    sizes = (F.lit(q) * F.col("na") >= F.lit(p) * F.col("nb")) & (F.lit(q) * F.col("nb") >= F.lit(p) * F.col("na"))
    return pairs.join(of("b"), "b").join(of("a"), "a").filter(sizes & (shared >= needed)).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """``cid, root`` for every node of the edges (a, b): the smallest node that can be reached.

    Each round, every component hooks onto its smallest neighbour, and chains of hooks are halved until flat; the edges between components are all
    that the next round reads.
    """
    label = written(edges.select(F.explode(F.array("a", "b")).alias("cid")).distinct().withColumn("root", F.col("cid")), "parts-label")
    rest = edges.select("a", "b")
    while True:
        hook = rest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").groupBy(F.col("b").alias("c")).agg(F.min("a").alias("to"))
        hook = written(hook, "parts-hook")
        if hook.isEmpty():
            return label
        while True:
            up = hook.select(F.col("c").alias("to"), F.col("to").alias("next"))
            jumped = written(hook.join(up, "to", "left").select("c", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")), "parts-jump")
            hook = jumped.select("c", "to")
            if jumped.filter("moved").isEmpty():
                break
        label = written(label.join(hook, label["root"] == hook["c"], "left").select("cid", F.coalesce("to", "root").alias("root")), "parts-label")
        to = lambda c: hook.select(F.col("c").alias(c), F.col("to").alias(f"{c}_to"))
        rest = rest.join(to("a"), "a", "left").join(to("b"), "b", "left").select(F.coalesce("a_to", "a").alias("a"), F.coalesce("b_to", "b").alias("b")).filter("a <> b").distinct()
        rest = written(rest, "parts-rest")


def _joined(docs: DataFrame, words: int, similar, kept: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Membership, and ``node, root, doc_id, digest``, the root and the first row of each class."""
    members, classes, found = links(docs, words, similar, kept, id_col, text_col)
    rooted = classes.join(components(found), "cid", "left").select("node", F.coalesce("root", "cid").alias("root"), "doc_id", "digest")
    return members, written(rooted, "near-rooted")


def classes_of(docs: DataFrame, words: int = WORDS, similar=SIMILAR, kept: int = KEPT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: ``doc_id, n_shingles, component_id, kept``.

    Null, empty and blank texts have no shingles, are linked with nothing and stay.  Rows with equal shingle sets are one class, also when they share an
    identifier; rows without identifier take part, and a component of such rows alone has none.  kept: the row has the component's identifier.  Other columns
    are ignored.
    """
    members, rooted = _joined(docs, words, similar, kept, id_col, text_col)
    smallest = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of_node = written(rooted.join(smallest, "root").select("node", "component_id"), "near-roots")
    out = members.select("doc_id", "node", "n").join(of_node, "node", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def dedup(docs: DataFrame, words: int = WORDS, similar=SIMILAR, kept: int = KEPT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns: one row of each group, and all without shingles.

    Of a group the smallest identifier stays; of rows that share it, or of a group without identifiers, one of them.
    """
    members, rooted = _joined(docs, words, similar, kept, id_col, text_col)
    first = rooted.groupBy("root").agg(_first().alias("x")).select(F.col("x.doc_id").alias("__id"), F.col("x.digest").alias("__digest"))
    # Rows equal in identifier and text can't be told apart, so one of them is taken; most tables have none.
    again = members.filter("n > 0").groupBy("doc_id", "digest").agg(F.count("*").alias("m")).filter("m > 1")
    same = F.col("__id").eqNullSafe(F.col("doc_id")) & (F.col("__digest") == F.col("digest"))
    first = written(first.join(again, same, "left").select("__id", "__digest", F.col("m").isNotNull().alias("__again")), "near-first")
    told = docs.withColumn("__own", F.col(id_col).cast("long")).withColumn("__text", F.xxhash64(F.col(text_col).cast("string")))
    marked = told.join(first, F.col("__own").eqNullSafe(F.col("__id")) & (F.col("__text") == F.col("__digest")), "left")
    # A first row has shingles, so texts without words are never marked.
    wordless = ~F.coalesce(F.col(text_col).cast("string"), F.lit("")).rlike(WORD)
    out = marked.filter(wordless | ~F.coalesce("__again", F.lit(True))).select(*docs.columns)
    if first.filter("__again").isEmpty():
        return out
    one = marked.filter("__again").groupBy("__own", "__text").agg(F.first(F.struct(*docs.columns)).alias("row"))
    return out.unionByName(one.select("row.*"))
