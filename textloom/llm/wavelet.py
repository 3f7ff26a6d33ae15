"""Token ids in wavelet-matrix files: one compressed file per shard with access, counting and occurrence lookup.

A shard holds the documents of a range of identifiers in ascending order.  Its file is, in this order: 4 bytes magic, 8 bytes length of a header in JSON,
the header, then zstandard frames whose places the header names: document identifiers, their lengths in tokens, one bit-plane per bit of the largest id
(highest first, each level stably parted into zeros and ones), and for each plane the ones before every 512th bit.  Files are stored as rows of a
Parquet table in the shared folder, so any file system that Spark reaches will do, and a lost task leaves nothing behind.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import n_partitions, prepare, scratch_path
from .tokens import encoder

MAGIC, BLOCK = b"WVM1", 512
#: Tokens after which a shard ends with the document.
SHARD_TOKENS = 1 << 19


class WaveletMatrix:
    """Bit-planes of an integer sequence with rank and select."""

    def __init__(self, n: int, planes: list[np.ndarray], ranks: list[np.ndarray]):
        self.n, self.planes, self.ranks = n, planes, ranks
        self.zeros = [n - (int(r[-1]) if len(r) else 0) for r in ranks]

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        levels = max(1, int(ids.max()).bit_length()) if len(ids) else 1
        a = ids.astype(np.uint16 if levels <= 16 else np.uint32)
        planes, ranks = [], []
        for shift in range(levels - 1, -1, -1):
            ones = (a & a.dtype.type(1 << shift)) != 0
            packed = np.packbits(ones)
            planes.append(packed)
            ranks.append(cls._directory(packed))
            if shift:
                a = np.concatenate([a.take(np.flatnonzero(~ones)), a.take(np.flatnonzero(ones))])  # far faster than masks
        return cls(len(ids), planes, ranks)

    @staticmethod
    def _directory(packed: np.ndarray) -> np.ndarray:
        """Ones before each block of 512 bits, and all at the end."""
        step = BLOCK // 8
        padded = np.zeros(-(-len(packed) // step) * step, np.uint8)
        padded[: len(packed)] = packed
        return np.concatenate([[0], np.cumsum(np.bitwise_count(padded).reshape(-1, step).sum(1, dtype=np.int64))]).astype(np.uint32)

    def _bit(self, level: int, i: int) -> int:
        return int(self.planes[level][i >> 3]) >> (7 - (i & 7)) & 1

    def _rank1(self, level: int, i: int) -> int:
        """Ones among the first i bits of a level."""
        b = i // BLOCK
        lo, hi = b * BLOCK // 8, i >> 3
        part = self.planes[level]
        out = int(self.ranks[level][b]) + int(np.bitwise_count(part[lo:hi]).sum())
        return out + ((int(part[hi]) >> (8 - (i & 7))).bit_count() if i & 7 else 0)

    def _select(self, level: int, k: int, bit: int) -> int:
        """Place of the k-th (from 0) bit of this kind in a level."""
        r = self.ranks[level].astype(np.int64)
        if not bit:
            r = np.arange(len(r)) * BLOCK - r
            r[-1] = self.n - int(self.ranks[level][-1])
        b = int(np.searchsorted(r, k, "right")) - 1
        bits = np.unpackbits(self.planes[level][b * BLOCK // 8 : (b + 1) * BLOCK // 8])[: self.n - b * BLOCK]
        return b * BLOCK + int(np.flatnonzero(bits == bit)[k - int(r[b])])

    def access(self, i: int) -> int:
        """The id at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        out = 0
        for level in range(len(self.planes)):
            bit = self._bit(level, i)
            out = out << 1 | bit
            ones = self._rank1(level, i)
            i = self.zeros[level] + ones if bit else i - ones
        return out

    def _range(self, symbol: int, lo: int, hi: int) -> tuple[int, int]:
        """Where the occurrences of a symbol among places lo to hi end up after the last level."""
        levels = len(self.planes)
        if symbol < 0 or symbol >> levels:
            return 0, 0
        for level in range(levels):
            a, b = self._rank1(level, lo), self._rank1(level, hi)
            lo, hi = (self.zeros[level] + a, self.zeros[level] + b) if symbol >> (levels - 1 - level) & 1 else (lo - a, hi - b)
        return lo, hi

    def rank(self, symbol: int, i: int) -> int:
        """Occurrences of a symbol before place i."""
        lo, hi = self._range(symbol, 0, i)
        return hi - lo

    def count(self, symbol: int) -> int:
        return self.rank(symbol, self.n)

    def select(self, symbol: int, k: int) -> int:
        """Place of the k-th occurrence, from 0."""
        lo, hi = self._range(symbol, 0, self.n)
        if not 0 <= k < hi - lo:
            raise IndexError(k)
        i = lo + k
        for level in range(len(self.planes) - 1, -1, -1):
            bit = symbol >> (len(self.planes) - 1 - level) & 1
            i = self._select(level, i - self.zeros[level] if bit else i, bit)
        return i

    def occurrences(self, symbol: int) -> list[int]:
        return [self.select(symbol, k) for k in range(self.count(symbol))]

    def decode(self) -> np.ndarray:
        """The whole sequence, undoing one level after another."""
        kind = np.uint16 if len(self.planes) <= 16 else np.uint32
        a = np.zeros(self.n, kind)
        for shift, (plane, zeros) in enumerate(zip(self.planes[::-1], self.zeros[::-1], strict=True)):
            ones = np.unpackbits(plane, count=self.n).view(bool)
            out = np.empty(self.n, kind)
            out[np.flatnonzero(~ones)] = a[:zeros]
            out[np.flatnonzero(ones)] = a[zeros:] | kind(1 << shift)
            a = out
        return a


class Shard:
    """Documents of one file: identifiers (None where null), starts and the matrix of all their ids."""

    def __init__(self, doc_ids: list[int | None], lengths: np.ndarray, matrix: WaveletMatrix):
        self.doc_ids, self.lengths, self.matrix = doc_ids, lengths, matrix
        self.starts = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)

    def to_bytes(self) -> bytes:
        z, parts, at = zstandard.ZstdCompressor(level=1), [], {}

        def put(name: str, data: bytes) -> None:
            at[name] = [sum(map(len, parts)), len(parts.append(z.compress(data)) or parts[-1])]

        put("ids", np.array([x or 0 for x in self.doc_ids], "<i8").tobytes())
        put("null", np.packbits([x is None for x in self.doc_ids]).tobytes())
        put("lengths", self.lengths.astype("<u8").tobytes())
        for i, (p, r) in enumerate(zip(self.matrix.planes, self.matrix.ranks, strict=True)):
            put(f"p{i}", p.tobytes())
            put(f"r{i}", r.astype("<u4").tobytes())
        head = json.dumps({"docs": len(self.doc_ids), "tokens": self.matrix.n, "levels": len(self.matrix.planes), "at": at}).encode()
        return MAGIC + struct.pack("<Q", len(head)) + head + b"".join(parts)

    @classmethod
    def from_bytes(cls, data: bytes) -> Shard:
        if data[:4] != MAGIC:
            raise ValueError("not a wavelet-matrix file")
        (size,) = struct.unpack("<Q", data[4:12])
        head, z = json.loads(data[12 : 12 + size]), zstandard.ZstdDecompressor()

        def get(name: str) -> bytes:
            lo, n = head["at"][name]
            return z.decompress(data[12 + size + lo : 12 + size + lo + n])

        null = np.unpackbits(np.frombuffer(get("null"), np.uint8), count=head["docs"])
        ids = [None if x else int(i) for i, x in zip(np.frombuffer(get("ids"), "<i8"), null, strict=True)]
        planes = [np.frombuffer(get(f"p{i}"), np.uint8) for i in range(head["levels"])]
        ranks = [np.frombuffer(get(f"r{i}"), "<u4") for i in range(head["levels"])]
        return cls(ids, np.frombuffer(get("lengths"), "<u8").astype(np.int64), WaveletMatrix(head["tokens"], planes, ranks))

    def document(self, k: int) -> np.ndarray:
        """Ids of the k-th document."""
        return np.array([self.matrix.access(i) for i in range(self.starts[k], self.starts[k + 1])], np.int64)


def _shards(batches: Iterator[pa.RecordBatch], path: str, word_ends: bool, end_id: int, shard_tokens: int) -> Iterator[pa.RecordBatch]:
    enc, end = encoder(path, word_ends), np.array([end_id], "<u4").tobytes()
    part, seq = TaskContext.get().partitionId(), 0
    names, texts, total = [], [], 0

    def flush() -> pa.RecordBatch:
        nonlocal seq, names, texts, total
        ids = np.frombuffer(b"".join(texts), "<u4")
        blob = Shard(names, np.array([len(x) // 4 for x in texts], np.int64), WaveletMatrix.build(ids)).to_bytes()
        out = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(names)], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([blob], pa.binary())], ["part", "seq", "docs", "tokens", "file"])
        seq, names, texts, total = seq + 1, [], [], 0
        return out

    for b in batches:
        for name, ids in zip(b.column(0).to_pylist(), enc.encode(b.column(1).to_pylist()), strict=True):
            names.append(name)
            texts.append(ids + end)
            total += len(ids) // 4 + 1
            if total >= shard_tokens:
                yield flush()
    if names:
        yield flush()


def write(docs: DataFrame, tokenizer: str, word_ends: bool, end_id: int, path: str | None = None, shard_tokens: int = SHARD_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Encode docs into shard files in ascending order of identifiers; returns the table's path.

    Null and empty texts are their end id alone.  Null identifiers come first; rows with equal identifiers lie side by side.
    """
    spark = prepare(docs.sparkSession)
    path = path or scratch_path(spark, "wavelet")
    told = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("h", F.xxhash64("text"))
    dealt = told.repartitionByRange(n_partitions(spark), "doc_id", "h").sortWithinPartitions("doc_id", "h").drop("h")
    dealt.mapInArrow(lambda it: _shards(it, tokenizer, word_ends, end_id, shard_tokens), "part int, seq int, docs long, tokens long, file binary").write.parquet(path)
    return path


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for part, seq, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            s = Shard.from_bytes(blob)
            raw = memoryview(s.matrix.decode().astype("<u4").tobytes())
            starts = s.starts.tolist()
            crc = [zlib.crc32(raw[4 * lo : 4 * hi]) for lo, hi in zip(starts, starts[1:], strict=False)]
            n = len(crc)
            cols = [pa.array([part] * n, pa.int32()), pa.array([seq] * n, pa.int32()), pa.array(s.doc_ids, pa.int64()), pa.array(starts[:-1], pa.int64()), pa.array(s.lengths, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["part", "seq", "doc_id", "inside", "n_tokens", "ids_crc32"])


def starts(shards: DataFrame) -> DataFrame:
    """``part, seq, base``: tokens in all shards before one; sums of tasks first, then within a task."""
    parts = shards.groupBy("part").agg(F.sum("tokens").alias("all")).withColumn("before", F.sum("all").over(Window.orderBy("part")) - F.col("all")).select("part", "before")
    inside = F.sum("tokens").over(Window.partitionBy("part").orderBy("seq")) - F.col("tokens")
    return shards.select("part", "seq", "tokens").withColumn("inside_part", inside).join(parts, "part").select("part", "seq", (F.col("before") + F.col("inside_part")).alias("base"))


def read(spark, path: str) -> DataFrame:
    """Per document from the files: ``doc_id, start, n_tokens, ids_crc32``."""
    shards = prepare(spark).read.parquet(path)
    rows = shards.select("part", "seq", "file").mapInArrow(_read, "part int, seq int, doc_id long, inside long, n_tokens long, ids_crc32 long")
    return rows.join(starts(shards), ["part", "seq"]).select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def _looked_up(batches: Iterator[pa.RecordBatch], symbol: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for part, seq, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            s = Shard.from_bytes(blob)
            at = np.array(s.matrix.occurrences(symbol), np.int64)
            doc = np.searchsorted(s.starts, at, "right") - 1
            cols = [pa.array([part] * len(at), pa.int32()), pa.array([seq] * len(at), pa.int32()), pa.array([s.doc_ids[k] for k in doc], pa.int64()), pa.array(at - s.starts[doc], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["part", "seq", "doc_id", "place"])


def occurrences(spark, path: str, symbol: int) -> DataFrame:
    """Every occurrence of a token id: ``part, seq, doc_id, place`` in its document."""
    return prepare(spark).read.parquet(path).select("part", "seq", "file").mapInArrow(lambda it: _looked_up(it, symbol), "part int, seq int, doc_id long, place long")
