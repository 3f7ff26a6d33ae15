"""Best-fit packing of documents into sequences of fixed length, with a certificate for each partition.

Documents longer than a sequence are cut; a whole piece fills a sequence by itself.  All other pieces are dealt by a hash to partitions of bounded size,
each packed by best-fit decreasing.  Dual feasible functions give a lower bound on the sequences that a partition needs: where it is met, the partition
is certified and final.  Partitions with a gap exchange the documents of their sequences that aren't full: those are dealt anew, with another hash and
to fewer partitions, and packed again; the outcome counts only if it has fewer sequences.  Rounds begin with the emptiest sequences.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, written
from .tokens import encoder

#: Tokens of a sequence, pieces of a partition.
LENGTH, GROUP_ROWS = 2048, 20_000
#: Room that a sequence must have to give up its documents, in each round of exchange, as a right shift of the length.  In the last round it is one token.
ROOMS = (3, 6, 11)

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _pieces(batches: Iterator[pa.RecordBatch], path: str, word_ends: bool, end_id: int, length: int, keep_ids: bool) -> Iterator[pa.RecordBatch]:
    enc, end = encoder(path, word_ends), np.array([end_id], "<u4").tobytes()
    for b in batches:
        rows = []
        for doc, ids in zip(b.column(0).to_pylist(), enc.encode(b.column(1).to_pylist()), strict=True):
            ids += end
            n = len(ids) // 4
            at, k = 0, 0
            while at < n:
                size = n % length or length if not at else length
                part = ids[4 * at : 4 * (at + size)]
                rows.append((doc, k, at, size, zlib.crc32(part), part if keep_ids else None))
                at, k = at + size, k + 1
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()][: 5 + keep_ids]
        cols = list(zip(*rows, strict=True)) or [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=False)], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(kinds)])


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item: longest first, each into the fullest bin that still takes it.

    Bins are kept by the room that they have left; a bit mask of the rooms in use finds the best fit in one step.
    """
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = made = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fits = mask >> size
        if fits:
            room = (fits & -fits).bit_length() - 1 + size
            b = by_room[room].pop()
            if not by_room[room]:
                mask ^= 1 << room
        else:
            room, b, made = capacity, made, made + 1
        bins[i], offsets[i] = b, capacity - room
        room -= size
        if room:
            by_room[room].append(b)
            mask |= 1 << room
    return bins, offsets


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Bins that items need at least, by dual feasible functions; counts[s]: items of size s.

    Functions: the size itself; for each e up to half the capacity, sizes over capacity - e as the capacity and those below e as nothing; and for
    k up to 50, sizes scaled by k + 1 and rounded down, where they don't divide evenly.
    """
    s = np.arange(capacity + 1, dtype=np.int64)
    mass = counts * s
    n_from, mass_from = np.cumsum(counts[::-1])[::-1], np.cumsum(mass[::-1])[::-1]
    e = np.arange(1, capacity // 2 + 1)
    middle = mass_from[e] - mass_from[capacity - e + 1]
    best = max(-(-int(mass.sum()) // capacity), int((n_from[capacity - e + 1] - (-middle // capacity)).max()) if len(e) else 0)
    for k in range(1, 51):
        # in units of 1 / (k * capacity)
        value = np.where(s * (k + 1) % capacity == 0, s * k, (s * (k + 1) // capacity) * capacity)
        best = max(best, -(-int((counts * value).sum()) // (k * capacity)))
    return best


def _packed(rows: pd.DataFrame, capacity: int) -> pd.DataFrame:
    rows = rows.sort_values("uid", ignore_index=True)
    sizes = rows["length"].to_numpy()
    rows["bin"], rows["offset"] = best_fit_decreasing(sizes, capacity)
    used = np.bincount(rows["bin"], weights=sizes)
    rows["used"] = used[rows["bin"]].astype(np.int64)
    rows["bins"], rows["bound"] = len(used), lower_bound(np.bincount(sizes, minlength=capacity + 1), capacity)
    return rows


def groups_for(rows: int) -> int:
    return max(1, -(-rows // GROUP_ROWS))


def _round(rows: DataFrame, number: int, count: int, capacity: int) -> DataFrame:
    """Deal rows to partitions and pack each; a written table."""
    cols = [c for c in rows.columns if c not in ("grp", "bin", "offset", "used", "bins", "bound", "round")]
    dealt = rows.select(*cols).withColumn("grp", F.pmod(F.xxhash64("uid", F.lit(number)), F.lit(groups_for(count))).cast("int"))
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in dealt.schema), "bin long, offset long, used long, bins long, bound long"])
    order = [x.split(" ")[0] for x in schema.split(", ")]
    out = dealt.groupBy("grp").applyInPandas(lambda pdf: _packed(pdf, capacity)[order], schema)
    return written(out.withColumn("round", F.lit(number)), "pack-round")


def pack(docs: DataFrame, tokenizer: str, word_ends: bool, end_id: int, length: int = LENGTH, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` and, with keep_ids, ``ids`` (little-endian 32-bit).

    Null and empty texts are their end id alone.  Only documents over the length are cut: whole pieces, before them a shorter first one.  Repeated rows
    are packed each for itself; null identifiers stay null.  An empty table gives no rows.
    """
    prepare(docs.sparkSession)
    told = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = told.mapInArrow(lambda it: _pieces(it, tokenizer, word_ends, end_id, length, keep_ids), _PIECES + ", ids binary" * keep_ids)
    pieces = written(pieces.withColumn("uid", F.monotonically_increasing_id()), "pack-pieces")
    whole = pieces.filter(F.col("length") == length).withColumn("sequence_id", F.col("uid")).withColumn("offset", F.lit(0).cast("long"))
    rest = pieces.filter(F.col("length") < length).select("uid", "length")
    count = rest.count()
    final: list[DataFrame] = []
    last = _round(rest, 0, count, length)
    for number, shift in enumerate(ROOMS, 1):
        if groups_for(count) == 1:
            break  # nobody to exchange with
        # A certified partition gives up only what it can't fill for lack of documents: sequences that are a quarter empty.
        open_ = (F.col("bins") > F.col("bound")) | (F.col("used") <= length - (length >> 2))
        gap = open_ & (F.col("used") <= length - max(1, length >> shift))
        freed = last.filter(gap)
        had = freed.agg(F.count("*").alias("rows"), F.count_distinct("grp", "bin").alias("bins")).first()
        if had["bins"] < 2:
            continue
        tried = _round(freed, number, had["rows"], length)
        if tried.agg(F.count_distinct("grp", "bin")).first()[0] < had["bins"]:
            final.append(tried)
            last = last.filter(~gap)
    final.append(last)
    # Places by round, partition and bin; the highest bit but the sign sets them apart from whole pieces.
    number = F.lit(1 << 62) + F.shiftleft(F.col("round").cast("long"), 56) + F.shiftleft(F.col("grp").cast("long"), 32) + F.col("bin")
    placed = final[0]
    for f in final[1:]:
        placed = placed.unionByName(f)
    placed = placed.select("uid", number.alias("sequence_id"), "offset")
    out = whole.unionByName(pieces.filter(F.col("length") < length).join(placed, "uid"), allowMissingColumns=True)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else []), "sequence_id", "offset")


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids`` from pack(..., keep_ids=True): the token ids of each sequence in order, bounded by its length."""
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", F.hex("ids").alias("x")))).alias("parts"))
    return parts.select("sequence_id", F.unhex(F.array_join(F.transform("parts", lambda p: p["x"]), "")).alias("ids"))
