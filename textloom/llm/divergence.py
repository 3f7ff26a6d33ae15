"""Which terms tell the sources of a language apart, and how far apart any two of its sources are: all in exact integers.

1. A first pass adds up, in a table of fixed size addressed by a hash of language and term, in how many documents terms are.  What shares a slot adds up too, so
   a term whose slot stays below the least number of documents can't be kept, and no trie needs it.
2. Each task counts its documents' other terms in byte tries, one for each language, whose leaves count documents, and occurrences by source.  Tries that have
   many leaves are handed on and begun anew, so a task's memory is bounded.  They are written in blocks of one prefix each, as the leaves in byte order,
   each with the length that it shares with the one before it.
3. Blocks are range-partitioned by language and prefix; blocks of one prefix meet and are merged into one trie, whose leaves in enough documents are kept.
4. Sums over the kept leaves give each source's total and each language's number of terms.
5. The merged tries are traversed in byte order: each batch of terms adds to the differences of all pairs of sources and to each source's leading terms, in
   which ties keep the order of traversal.  A task hands on one row for each pair, and for each source as many terms as a report holds.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import n_partitions, prepare, written

#: Documents of its language that a kept term is in, what is added to every count, the unit of shares, terms that a source's report holds.
LEAST_DOCS, ADDED, UNIT, REPORTED = 30, 5, 1_000_000_000, 50
#: Cells of term and source that a task counts before it hands them on, and terms in the first pass; bytes of a block's prefix; terms compared at once.
CELLS, COUNTED, PREFIX, TERMS = 500_000, 300_000, 2, 2048
#: Slots of the first pass, as powers of two: all, and those of one block.  One bit for each goes to all tasks: 8 MB.
SLOTS, SLOT_BLOCK = 26, 16
#: Letters of both cases to lower case, other ASCII characters to spaces, bytes of other characters as they are.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    """The terms of a text in UTF-8: runs of letters A-Z and a-z, in lower case, and of characters beyond ASCII."""
    return (text or b"").translate(_TABLE).split()


class Trie:
    """A radix trie over bytes.  A node is [label, leaf's number or None, children by first byte]; counters of leaves lie in arrays, by their numbers."""

    def __init__(self):
        self.root, self.size = [b"", None, {}], 0

    def leaf(self, term: bytes) -> int:
        """The number of the term's leaf, made if there is none."""
        node, at = self.root, 0
        while at < len(term):
            kids = node[2]
            nxt = kids.get(term[at])
            if nxt is None:
                node = kids[term[at]] = [term[at:], None, {}]
                break
            label = nxt[0]
            if not term.startswith(label, at):
                n, most = 1, min(len(label), len(term) - at)
                while n < most and label[n] == term[at + n]:
                    n += 1
                split = [label[:n], None, {label[n]: nxt}]
                nxt[0] = label[n:]
                kids[term[at]] = nxt = split
                label = split[0]
            node, at = nxt, at + len(label)
        if node[1] is None:
            node[1] = self.size
            self.size += 1
        return node[1]

    def leaves(self) -> Iterator[tuple[bytes, int]]:
        """All terms and numbers of leaves in byte order."""
        todo = [(b"", self.root)]
        while todo:
            head, node = todo.pop()
            head += node[0]
            if node[1] is not None:
                yield head, node[1]
            todo.extend((head, node[2][c]) for c in sorted(node[2], reverse=True))


#: A block: leaves in byte order, front-coded, and their documents; then for all leaves one after another, ``kinds`` of them for each, the place of a source
#: in ``sources`` and its occurrences.
_BLOCK = "lang string, prefix binary, sources array<string>, shared binary, lengths binary, tails binary, docs binary, kinds binary, codes binary, counts binary"
_BLOCK_NAMES = [c.split()[0] for c in _BLOCK.split(", ")]
_ARROW = pa.schema([(n, pa.string() if n == "lang" else pa.list_(pa.string()) if n == "sources" else pa.binary()) for n in _BLOCK_NAMES])


def _blocks(lang: str, trie: Trie, sources: list[str], docs: np.ndarray, rows: np.ndarray, codes: np.ndarray, counts: np.ndarray, least: int = 0) -> Iterator[tuple]:
    """A trie's blocks, one for each prefix, of leaves in so many documents at least.  Cells come as leaf, source and occurrences."""
    told = [(t, i) for t, i in trie.leaves() if docs[i] >= least]
    if not told:
        return
    place = np.full(trie.size, -1, np.int64)
    place[[i for _, i in told]] = np.arange(len(told))
    at = place[rows]
    order = np.lexsort((codes, at))
    order = order[at[order] >= 0]
    at, codes, counts = at[order], codes[order], counts[order]
    lo = 0
    while lo < len(told):
        prefix = told[lo][0][:PREFIX]
        hi, last, shared, tails = lo, b"", [], []
        while hi < len(told) and told[hi][0][:PREFIX] == prefix:
            term, n = told[hi][0], 0
            most = min(len(last), len(term))
            while n < most and last[n] == term[n]:
                n += 1
            shared.append(n)
            tails.append(term[n:])
            last, hi = term, hi + 1
        x, y = np.searchsorted(at, (lo, hi))
        used, own = np.unique(codes[x:y], return_inverse=True)
        packed = lambda v, kind: np.asarray(v, kind).tobytes()
        yield (lang, prefix, [sources[c] for c in used], packed(shared, "<i4"), packed([len(t) for t in tails], "<i4"), b"".join(tails),
               packed(docs[[i for _, i in told[lo:hi]]], "<i8"), packed(np.bincount(at[x:y] - lo, minlength=hi - lo), "<i4"), packed(own, "<i4"), packed(counts[x:y], "<i8"))
        lo = hi


def _terms(block: tuple) -> list[bytes]:
    """A block's terms."""
    out, term, at = [], b"", 0
    for n, k in zip(np.frombuffer(block[3], "<i4").tolist(), np.frombuffer(block[4], "<i4").tolist(), strict=True):
        term = term[:n] + block[5][at : at + k]
        at += k
        out.append(term)
    return out


def _cells(block: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each cell the place of its term, that of its source, and its occurrences."""
    kinds = np.frombuffer(block[7], "<i4")
    return np.repeat(np.arange(len(kinds)), kinds), np.frombuffer(block[8], "<i4"), np.frombuffer(block[9], "<i8")


def _batched(rows: Iterable[tuple], most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Rows as batches of a bounded number of bytes."""
    held, size = [], 0

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _ARROW, strict=True)], schema=_ARROW)

    for row in rows:
        held.append(row)
        size += sum(map(len, row[3:]))
        if size >= most:
            yield made()
            held, size = [], 0
    if held:
        yield made()


def _slots(lang: str, terms: Iterable[bytes]) -> np.ndarray:
    """The slots of a language's terms."""
    begun = zlib.crc32(lang.encode() + b"\0")
    return np.fromiter((zlib.crc32(t, begun) for t in terms), np.uint32) & np.uint32((1 << SLOTS) - 1)


def _texts(b: pa.RecordBatch) -> Iterator[tuple[str, str, list[bytes]]]:
    for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist(), strict=True):
        yield lang, source, terms_of(text)


def _filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, source, text) to (block, slots, counts), in how many documents terms of each slot are."""
    docs: dict[str, Counter] = defaultdict(Counter)

    def made() -> pa.RecordBatch:
        slots = np.concatenate([np.zeros(0, np.uint32), *(_slots(lang, c) for lang, c in docs.items())])
        counts = np.concatenate([np.zeros(0, np.int32), *(np.fromiter(c.values(), np.int32, len(c)) for c in docs.values())])
        order = np.argsort(slots, kind="stable")
        slots, counts = slots[order], counts[order]
        blocks, at = np.unique(slots >> SLOT_BLOCK, return_index=True)
        cut = lambda x: pa.array([p.tobytes() for p in np.split(x, at[1:])] if len(at) else [], pa.binary())
        docs.clear()
        return pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), cut((slots & ((1 << SLOT_BLOCK) - 1)).astype(np.uint16)), cut(counts)], ["block", "slots", "counts"])

    for b in batches:
        for lang, _, terms in _texts(b):
            docs[lang].update(set(terms))
        if sum(map(len, docs.values())) > COUNTED:
            yield made()
    yield made()


def _enough(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Rows (block, slots, counts) sorted by block to (block, bits) of slots with so many documents."""
    key, total = None, np.zeros(1 << SLOT_BLOCK, np.int64)

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), pa.array([np.packbits(total >= least).tobytes()], pa.binary())], ["block", "bits"])

    for b in batches:
        for block, slots, counts in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if block != key:
                if key is not None:
                    yield made()
                key, total = block, np.zeros(1 << SLOT_BLOCK, np.int64)
            np.add.at(total, np.frombuffer(slots, np.uint16), np.frombuffer(counts, np.int32))
    if key is not None:
        yield made()


class _Counting:
    """What a task has counted in one language: a trie, and for its terms documents and occurrences by source."""

    def __init__(self, lang: str, bits: bytes):
        self.lang, self.bits, self.begun = lang, bits, zlib.crc32(lang.encode() + b"\0")
        self.trie, self.docs, self.found = Trie(), Counter(), defaultdict(Counter)
        self.good: dict[bytes, int] = {}
        self.seen: set[bytes] = set()

    def add(self, source: str, terms: list[bytes]) -> None:
        own = set(terms)
        if new := own - self.seen:
            bits, begun, all_ = self.bits, self.begun, (1 << SLOTS) - 1
            for t in new:
                slot = zlib.crc32(t, begun) & all_
                if bits[slot >> 3] >> (7 - (slot & 7)) & 1:
                    self.good[t] = self.trie.leaf(t)
            if len(self.seen) > 4 * COUNTED:
                self.seen.clear()
            self.seen |= new
        self.docs.update(self.good.keys() & own)
        self.found[source].update(filter(self.good.__contains__, terms))

    def cells(self) -> int:
        return sum(map(len, self.found.values()))

    def blocks(self) -> Iterator[tuple]:
        size, number = self.trie.size, self.good.__getitem__
        docs = np.zeros(size, np.int64)
        docs[np.fromiter(map(number, self.docs), np.int64, len(self.docs))] = np.fromiter(self.docs.values(), np.int64, len(self.docs))
        sources = sorted(self.found)
        parts = [self.found[s] for s in sources]
        join = lambda xs, kind: np.concatenate([np.zeros(0, kind), *xs])
        rows = join([np.fromiter(map(number, c), np.int64, len(c)) for c in parts], np.int64)
        counts = join([np.fromiter(c.values(), np.int64, len(c)) for c in parts], np.int64)
        codes = np.repeat(np.arange(len(parts)), [len(c) for c in parts])
        return _blocks(self.lang, self.trie, sources, docs, rows, codes, counts)


def _counted(batches: Iterator[pa.RecordBatch], enough: dict[int, bytes]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, source, text) to blocks of tries of the terms whose slots have enough documents."""
    none = bytes(1 << (SLOT_BLOCK - 3))
    bits = b"".join(enough.get(i, none) for i in range(1 << (SLOTS - SLOT_BLOCK)))
    langs: dict[str, _Counting] = {}

    def handed() -> Iterator[tuple]:
        for lang in sorted(langs):
            yield from langs.pop(lang).blocks()

    def rows() -> Iterator[tuple]:
        for b in batches:
            for lang, source, terms in _texts(b):
                if lang not in langs:
                    langs[lang] = _Counting(lang, bits)
                langs[lang].add(source, terms)
            if sum(c.cells() for c in langs.values()) > CELLS:
                yield from handed()
        yield from handed()

    return _batched(rows())


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns), strict=True)


def _merged(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Blocks sorted by language and prefix to one block for each, of the leaves that are kept."""

    def one(blocks: list[tuple]) -> Iterator[tuple]:
        trie, number = Trie(), {}
        sources = {s: i for i, s in enumerate(sorted({s for b in blocks for s in b[2]}))}
        docs, cells = [], []
        for b in blocks:
            terms = _terms(b)
            for t in terms:
                if t not in number:
                    number[t] = trie.leaf(t)
            at = np.fromiter(map(number.__getitem__, terms), np.int64, len(terms))
            docs.append((at, np.frombuffer(b[6], "<i8")))
            row, code, n = _cells(b)
            # A cell's place in a table of all terms and sources.
            cells.append((at[row] * len(sources) + np.array([sources[s] for s in b[2]], np.int64)[code] if len(row) else np.zeros(0, np.int64), n))
        total = np.zeros(trie.size, np.int64)
        for at, n in docs:
            np.add.at(total, at, n)
        place, own = np.unique(np.concatenate([p for p, _ in cells]), return_inverse=True)
        counts = np.zeros(len(place), np.int64)
        np.add.at(counts, own, np.concatenate([n for _, n in cells]))
        width = max(1, len(sources))
        return _blocks(blocks[0][0], trie, list(sources), total, place // width, place % width, counts, least)

    def rows() -> Iterator[tuple]:
        held: list[tuple] = []
        for block in _rows(batches):
            if held and block[:2] != held[0][:2]:
                yield from one(held)
                held = []
            held.append(block)
        if held:
            yield from one(held)

    return _batched(rows())


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks to rows (lang, source, n): occurrences by source, and for a null source the number of terms."""
    sums: dict[tuple, int] = defaultdict(int)
    for block in _rows(batches):
        _, code, n = _cells(block)
        sums[block[0], None] += len(block[3]) // 4
        per = np.zeros(len(block[2]), np.int64)
        np.add.at(per, code, n)
        for source, total in zip(block[2], per.tolist(), strict=True):
            sums[block[0], source] += total
    langs, sources = zip(*sums, strict=True) if sums else ((), ())
    yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(sources, pa.string()), pa.array(list(sums.values()), pa.int64())], ["lang", "source", "n"])


def shares(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """1 + floor(UNIT * counts / totals) in whole numbers, for totals below 2**53: long division by thousands."""
    out, rest = counts // totals, counts % totals
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // totals, rest % totals
    return out + 1


class _Differences:
    """What a task adds up for one language: terms by source in, sums for pairs and leading terms out."""

    def __init__(self, lang: str, groups: list[dict], n_terms: int, reported: int):
        self.lang, self.names, self.reported = lang, [g["source"] for g in groups], reported
        self.at = {s: i for i, s in enumerate(self.names)}
        of_source = np.array([g["n"] for g in groups], np.int64)
        self.totals = np.append(of_source, of_source.sum()) + ADDED * n_terms
        self.pairs = np.zeros((len(groups), len(groups)), np.int64)
        self.best: list[list[tuple[int, bytes]]] = [[] for _ in groups]
        self.terms: list[bytes] = []
        self.cells: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, block: tuple) -> None:
        """A block's terms, TERMS of them at a time."""
        terms, (row, code, n) = _terms(block), _cells(block)
        own = np.array([self.at[s] for s in block[2]], np.int64)
        for lo in range(0, len(terms), TERMS):
            x, y = np.searchsorted(row, (lo, lo + TERMS))
            self.cells.append((row[x:y] - lo + len(self.terms), own[code[x:y]] if y > x else np.zeros(0, np.int64), n[x:y]))
            self.terms += terms[lo : lo + TERMS]
            if len(self.terms) >= TERMS:
                self.flush()

    def flush(self) -> None:
        if not self.terms:
            return
        k = len(self.names)
        counts = np.zeros((len(self.terms), k + 1), np.int64)
        row, col, n = (np.concatenate(x) for x in zip(*self.cells, strict=True))
        counts[row, col] = n
        counts[:, k] = counts[:, :k].sum(1)
        p = shares(counts + ADDED, self.totals)
        for i in range(k - 1):
            self.pairs[i, i + 1 :] += np.abs(p[:, i + 1 : k] - p[:, i : i + 1]).sum(0)
        over = np.where(counts[:, :k] > 0, p[:, :k] - p[:, k:], 0)
        for i in range(k):
            at = np.flatnonzero(over[:, i] > 0)
            at = at[np.argsort(-over[at, i], kind="stable")[: self.reported]]
            # Terms come in byte order, so a stable merge leaves ties in it.
            self.best[i] = heapq.nsmallest(self.reported, [*self.best[i], *((-int(over[t, i]), self.terms[t]) for t in at)])
        self.terms, self.cells = [], []

    def rows(self) -> Iterator[tuple]:
        """(lang, source, part, item, value)."""
        self.flush()
        for i, source in enumerate(self.names):
            yield from ((self.lang, source, "pair", self.names[j], int(self.pairs[i, j])) for j in range(i + 1, len(self.names)))
            yield from ((self.lang, source, "term", term.decode(), -f) for f, term in self.best[i])


def _traversed(batches: Iterator[pa.RecordBatch], reported: int) -> Iterator[pa.RecordBatch]:
    """Blocks in order, with n_terms and groups of their language, to partial rows."""
    now: _Differences | None = None

    def made(d: _Differences) -> pa.RecordBatch:
        cols = list(zip(*d.rows(), strict=True)) or [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.string()] * 4 + [pa.int64()], strict=True)], ["lang", "source", "part", "item", "value"])

    for b in batches:
        n = len(_BLOCK_NAMES)
        blocks = zip(*(b.column(i).to_pylist() for i in range(n)), strict=True)
        for at, block in enumerate(blocks):
            if now is None or block[0] != now.lang:
                if now:
                    yield made(now)
                now = _Differences(block[0], b.column(n + 1)[at].as_py(), b.column(n)[at].as_py(), reported)
            now.add(block)
    if now:
        yield made(now)


def tries(docs: DataFrame, least: int = LEAST_DOCS, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The merged tries of all documents as blocks of kept terms, written."""
    prepare(docs.sparkSession)
    told = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    parts = n_partitions(docs.sparkSession)
    filled = told.mapInArrow(_filled, "block int, slots binary, counts binary").repartition(parts, "block").sortWithinPartitions("block")
    bits = filled.mapInArrow(lambda it: _enough(it, least), "block int, bits binary")
    # One bit for each slot at most, whatever the table.
    enough = {r["block"]: bytes(r["bits"]) for r in bits.collect()}
    made = written(told.mapInArrow(lambda it: _counted(it, enough), _BLOCK), "divergence-tries")
    met = made.repartitionByRange(parts, "lang", "prefix").sortWithinPartitions("lang", "prefix")
    return written(met.mapInArrow(lambda it: _merged(it, least), _BLOCK), "divergence-merged")


def audit(docs: DataFrame, least: int = LEAST_DOCS, reported: int = REPORTED, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``lang, source, part, item, value, rank``; part ``pair`` compares a source with each other one of its language, part ``term`` holds leading terms.

    Null languages, sources and texts are ''.  A term is kept for a language if at least so many of its documents hold it.  A term's share is
    1 + floor(UNIT * (count + ADDED) / (N + ADDED * V)), N the occurrences of all V kept terms in the source or language.  A pair's value is the sum of all
    differences of shares, 0 where no term is kept; a term's value is by how much its share in a source that has it exceeds that in the language.  Ranks go by
    falling value, then by item.  Repeated rows count each.  A language of one source has no pairs.  An empty table gives no rows.  Other columns are ignored.
    """
    merged = tries(docs, least, lang_col, source_col, text_col)
    sums = written(merged.mapInArrow(_sums, "lang string, source string, n long").groupBy("lang", "source").agg(F.sum("n").alias("n")), "divergence-sums")
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    groups = docs.select(name(lang_col).alias("lang"), name(source_col).alias("source")).distinct().join(sums.filter("source IS NOT NULL"), ["lang", "source"], "left")
    groups = written(groups.select("lang", "source", F.coalesce("n", F.lit(0)).alias("n")), "divergence-groups")
    # A row for each language, with a cell for each of its sources: the result has a row for each two of them.
    of_lang = groups.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", "n"))).alias("groups"))
    of_lang = sums.filter("source IS NULL").select("lang", F.col("n").alias("n_terms")).join(of_lang, "lang")
    partial = merged.join(of_lang, "lang").select(*_BLOCK_NAMES, "n_terms", "groups").repartitionByRange(n_partitions(docs.sparkSession), "lang", "prefix").sortWithinPartitions("lang", "prefix")
    found = written(partial.mapInArrow(lambda it: _traversed(it, reported), "lang string, source string, part string, item string, value long"), "divergence-found")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = found.filter("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = pairs.unionByName(pairs.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    every = groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang").filter(F.col("source") != F.col("item"))
    pairs = every.join(both, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("long").alias("value"))
    terms = found.filter("part = 'term'").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= reported)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(terms)
