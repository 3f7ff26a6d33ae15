"""Near-duplicate classes of documents by SimHash fingerprints within a Hamming radius, met in the middle.

1. A fingerprint's bit is set if it is set in over half the XXH64 values of a text's word shingles, repeats included.  Equal fingerprints are one node.
2. Every fingerprint emits all variants within half the radius.  Two fingerprints lie within the radius exactly if they share a variant: flip half of the
   bits that differ in one, half in the other.  And all that share one lie within the radius of each other, so a variant's fingerprints are linked by a star.
3. Variants are dealt by their first bits.  A fingerprint travels once to each prefix that one of its variants has, with the number of flips left over, and
   the variants that start with the prefix are written out, sorted and compared where they meet: what crosses the network grows with the square of the
   prefix's length and not with the number of variants.  Prefixes whose variants would be too many for a task get more bits, round by round.
4. Pairs are checked by their differing bits, and nodes joined over them by hooking and pointer jumping.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import n_partitions, prepare, written
from .near_dedup import components

#: Words of a shingle, seed of the hash, bits of a fingerprint, differing bits of a link.
WORDS, SEED, BITS, RADIUS = 4, 42, 64, 4
#: Variants that one prefix may have in a task, and bits that a longer prefix gets more.
ROOM, MORE = 1 << 22, 6
#: Hashes that are kept at once, a multiple of the 255 whose bits are counted in single bytes.
CHUNK = 255 * 64


def fingerprint(text: bytes | None, words: int = WORDS) -> int:
    """The fingerprint of a text in UTF-8, A-Z in lower case, as an unsigned number; 0 without words."""
    found = (text or b"").lower().split()
    if not found:
        return 0
    k, joined = min(words, len(found)), b" ".join(found)
    ends = list(itertools.accumulate(len(w) + 1 for w in found))
    parts = (joined[a : b - 1] for a, b in zip(itertools.chain((0,), ends), ends[k - 1 :], strict=False))
    n, hashed, counts = len(found) - k + 1, xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    while len(h := np.fromiter((hashed(x, SEED) for x in itertools.islice(parts, CHUNK)), "<u8")):
        set_bits = np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, BITS)
        for lo in range(0, len(set_bits), 255):
            counts += np.add.reduce(set_bits[lo : lo + 255], 0, dtype=np.uint8)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def _prints(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        made = np.array([fingerprint(t, words) for t in b.column(1).cast(pa.binary()).to_pylist()], np.uint64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made.view(np.int64))], ["doc_id", "print"])


def variants(bits: int, flips: int) -> np.ndarray:
    """All masks of the lowest bits with at most so many set."""
    return np.array([sum(1 << p for p in ps) for f in range(flips + 1) for ps in itertools.combinations(range(bits), f)], np.uint64)


def _count(bits: int, flips: int) -> int:
    return sum(math.comb(bits, f) for f in range(min(bits, flips) + 1))


def _split(rows: DataFrame, more: int, radius: int) -> DataFrame:
    """Rows (bits, prefix, left, print) to one row for each longer prefix that a variant can have."""
    masks = [(m, bin(m).count("1")) for m in range(1 << more) if bin(m).count("1") <= radius // 2]
    if rows.columns == ["print"]:
        rows = rows.select(F.lit(0).alias("bits"), F.lit(0).cast("long").alias("prefix"), F.lit(radius // 2).alias("left"), "print")
    own = F.expr(f"shiftrightunsigned(print, {BITS - more} - bits)").bitwiseAND(F.lit((1 << more) - 1))
    ways = F.array(*[F.struct(F.lit(m).cast("long").alias("m"), F.lit(n).alias("n")) for m, n in masks])
    out = rows.withColumn("own", own).withColumn("x", F.explode(F.filter(ways, lambda w: w["n"] <= F.col("left"))))
    prefix = F.col("prefix") * F.lit(1 << more) + F.col("own").bitwiseXOR(F.col("x.m"))
    return out.select((F.col("bits") + more).alias("bits"), prefix.alias("prefix"), (F.col("left") - F.col("x.n")).alias("left"), "print")


def _stars(prints: np.ndarray, left: np.ndarray, bits: int, radius: int, masks: dict[tuple[int, int], np.ndarray]) -> np.ndarray:
    """Pairs (print, print) that connect what shares a variant with a prefix of so many bits, which all given prints can reach with flips left."""
    low = BITS - bits
    rest = prints & np.uint64((1 << low) - 1)
    values, owners = [], []
    for flips in np.unique(left).tolist():
        at = np.flatnonzero(left == flips)
        if (low, flips) not in masks:
            masks[low, flips] = variants(low, min(low, flips))
        m = masks[low, flips]
        values.append((rest[at, None] ^ m[None, :]).ravel())
        owners.append(np.repeat(at.astype(np.int32), len(m)))
    value, owner = np.concatenate(values), np.concatenate(owners)
    order = np.argsort(value)
    value, owner = value[order], owner[order]
    again = np.concatenate([[False], value[1:] == value[:-1]])
    heads = np.maximum.accumulate(np.where(again, 0, np.arange(len(value))))
    pairs = np.unique(np.stack([owner[again], owner[heads[again]]], 1), axis=0) if again.any() else np.zeros((0, 2), np.int32)
    near = np.bitwise_count(prints[pairs[:, 0]] ^ prints[pairs[:, 1]]) <= radius
    a, b = pairs[near].T
    # One pair for each print that isn't the first of its part here.
    label = np.arange(len(prints))
    while True:
        least = np.minimum(label[a], label[b])
        if (label[a] == least).all() and (label[b] == least).all():
            break
        np.minimum.at(label, label[a], least)
        np.minimum.at(label, label[b], least)
        while (label[label] != label).any():
            label = label[label]
    tied = np.flatnonzero(label != np.arange(len(prints)))
    return np.stack([prints[label[tied]], prints[tied]], 1)


def _met(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows (bits, prefix, left, print) sorted by bits and prefix to links (a, b)."""
    key, prints, left, masks = None, [], [], {}

    def made() -> pa.RecordBatch:
        pairs = _stars(np.concatenate(prints), np.concatenate(left), key[0], radius, masks).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    for batch in batches:
        bits, prefix, flips, own = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        cuts = np.flatnonzero((bits[1:] != bits[:-1]) | (prefix[1:] != prefix[:-1])) + 1
        for lo, hi in itertools.pairwise([0, *cuts.tolist(), len(bits)]):
            if lo == hi:
                continue
            if (now := (int(bits[lo]), int(prefix[lo]))) != key:
                if prints:
                    yield made()
                key, prints, left = now, [], []
            prints.append(own[lo:hi].view(np.uint64))
            left.append(flips[lo:hi])
    if prints:
        yield made()


def links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """From distinct fingerprints (print) pairs (a, b) that connect exactly what lies within the radius, step by step."""
    count, flips = nodes.count(), radius // 2
    # An average prefix has half of the variants that a task may have.
    bits = 1
    while bits < 24 and count * _count(BITS, flips) > (ROOM // 2) << bits:
        bits += 1
    rows, ready = written(_split(nodes.select("print"), bits, radius), "simhash-variants"), []
    while True:
        # A variant's number is that of the flips left over in the bits behind the prefix.
        weigh = F.element_at(F.array(*[F.lit(_count(BITS - bits, f)) for f in range(flips + 1)]), F.col("left") + 1)
        heavy = written(rows.groupBy("prefix").agg(F.sum(weigh).alias("n")).filter(F.col("n") > ROOM).select("prefix"), "simhash-heavy")
        if bits + MORE > BITS - 2 or heavy.isEmpty():
            ready.append(rows)
            break
        ready.append(rows.join(heavy, "prefix", "left_anti").select(*rows.columns))
        rows = written(_split(rows.join(heavy, "prefix", "left_semi").select(*rows.columns), MORE, radius), "simhash-variants")
        bits += MORE
    parts = n_partitions(nodes.sparkSession)
    found = []
    for r in ready:
        dealt = r.repartition(max(parts, 1), "bits", "prefix").sortWithinPartitions("bits", "prefix")
        found.append(dealt.mapInArrow(lambda it: _met(it, radius), "a long, b long"))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return written(out.distinct(), "simhash-links")


def hexed(print_col: str | Column) -> Column:
    """16 lowercase hexadecimal digits."""
    return F.lower(F.lpad(F.hex(print_col), 16, "0"))


def classes_of(docs: DataFrame, words: int = WORDS, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: ``doc_id, fingerprint, component_id, kept``.

    Null, empty and blank texts have fingerprint zero and are linked like any other.  Rows that share an identifier count each by its text; rows without
    identifier take part, and a component of such rows alone has none.  kept: the row has the component's identifier.  An empty table gives no rows; other
    columns are ignored.
    """
    if radius % 2:
        raise ValueError("the radius must be even: both sides flip half of it")
    prepare(docs.sparkSession)
    told = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    members = written(told.mapInArrow(lambda it: _prints(it, words), "doc_id long, print long"), "simhash-members")
    nodes = written(members.groupBy("print").agg(F.min("doc_id").alias("doc_id")), "simhash-nodes")
    rooted = nodes.join(components(links(nodes, radius)).withColumnRenamed("cid", "print"), "print", "left")
    rooted = written(rooted.select("print", F.coalesce("root", "print").alias("root"), "doc_id"), "simhash-rooted")
    smallest = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    out = members.join(rooted.join(smallest, "root").select("print", "component_id"), "print")
    return out.select("doc_id", hexed("print").alias("fingerprint"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
