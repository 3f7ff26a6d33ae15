"""Token counts by source, language and tokenizer version, maintained by signed deltas.

A store is a folder with two logs, one entry per batch: ``counts`` says what each changed document has since then, ``deltas`` holds the batch's signed sums
per group.  Totals are the sum of all deltas.  A batch counts once its deltas are written; a batch whose name is already there changes nothing, and one
that broke off is written anew, so commits can be repeated at will.  Every COMPACTED batches the counts are written anew as a snapshot, so a commit reads what
documents have and a bounded number of batches, not the whole history.  A number is claimed by creating a file, so that two writers can't both take it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, word_count, written
from .tokens import encoder

GROUP = ("source", "lang", "tokenizer")
#: What a count belongs to.  Parts tell rows apart that share an identifier.
KEY = ("doc_id", "part", "tokenizer")
#: What a change may be: a document comes or is replaced, is taken away, or has its count revised.
OPS = ("insert", "delete", "revise")
#: Batches after which a snapshot is written.
COMPACTED = 8


class Store:
    def __init__(self, spark: SparkSession, path: str, compacted: int = COMPACTED):
        self.spark, self.path, self.compacted = prepare(spark), path.rstrip("/"), compacted

    def _entry(self, log: str, number: int, batch: str) -> str:
        return f"{self.path}/{log}/{number:09d}-{batch}"

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _done(self, log: str) -> list[str]:
        """Names of a log's whole entries."""
        fs, root = self._fs(f"{self.path}/{log}")
        if not fs.exists(root):
            return []
        names = [s.getPath() for s in fs.listStatus(root)]
        return [p.getName() for p in names if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]

    def batches(self) -> list[tuple[int, str]]:
        """Committed batches in order: number and name."""
        return sorted((int(n[:9]), n[10:]) for n in self._done("deltas"))

    def _claim(self, number: int, batch: str) -> None:
        """Take a number for a batch; one that broke off can take it again, another can't."""
        fs, at = self._fs(f"{self.path}/claims/{number:09d}")
        try:
            out = fs.create(at, False)
        except Exception as e:
            if not fs.exists(at):
                raise
            given = fs.open(at)
            try:
                owner = bytes(given.readNBytes(1 << 16)).decode()
            finally:
                given.close()
            if owner != batch:
                raise RuntimeError(f"batch {owner} has taken number {number} and isn't committed; repeat it, or remove {at.toString()} if it never will be") from e
            return
        out.write(bytearray(batch.encode()))
        out.close()

    def counts(self) -> DataFrame | None:
        """Latest ``doc_id, part, tokenizer, source, lang, tokens, copies`` of every document that is there; None before any batch."""
        known = self.batches()
        if not known:
            return None
        upto = max((int(n) for n in self._done("snapshots")), default=0)
        entries = [self._entry("counts", *b) for b in known if b[0] > upto] + [f"{self.path}/snapshots/{upto:09d}"] * (upto > 0)
        log = self.spark.read.parquet(*entries).filter("doc_id IS NOT NULL")
        last = log.groupBy(*KEY).agg(F.max_by(F.struct("source", "lang", "tokens", "copies", "there"), "number").alias("x"))
        return last.filter("x.there").select(*KEY, "x.source", "x.lang", "x.tokens", "x.copies")

    def compact(self) -> None:
        """Write what all documents have as a snapshot; entries before it are no longer read."""
        known, now = self.batches(), self.counts()
        if now is not None:
            rows = now.select(*KEY, "source", "lang", "tokens", "copies", F.lit(True).alias("there"), F.lit(known[-1][0]).alias("number"))
            rows.write.mode("overwrite").parquet(f"{self.path}/snapshots/{known[-1][0]:09d}")

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Apply ``op, doc_id, source, lang, tokenizer, tokens`` (and ``seq``, the order within the batch) once; False if the batch is there already.

        Where rows share an identifier, ``part`` tells them apart, and ``copies`` says how many there are of one; missing or null they are 0 and 1.

        insert and revise set what a document has for a tokenizer, whatever it had before; delete takes it away, and does nothing where there is nothing.
        Of several changes of one document, part and tokenizer in a batch the last by seq holds, then the one with the largest count.  Rows without identifier
        can't be found again: they are only inserted, each for itself.  Null counts are 0 and null tokenizers empty names; null sources and languages are groups of their own.
        """
        if "/" in batch or not batch:
            raise ValueError("a batch needs a name without /")
        known = self.batches()
        if batch in {name for _, name in known}:
            return False
        number = known[-1][0] + 1 if known else 1
        self._claim(number, batch)
        given = lambda c, default: F.coalesce(F.col(c).cast("long"), F.lit(default)) if c in changes.columns else F.lit(default).cast("long")
        told = changes.select(
            F.when(F.col("op").isin(*OPS), F.col("op")).otherwise(F.raise_error(F.concat(F.lit("unknown change: "), F.coalesce("op", F.lit("null"))))).alias("op"),
            F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"),
            F.coalesce(F.col("tokenizer").cast("string"), F.lit("")).alias("tokenizer"), F.coalesce(F.col("tokens").cast("long"), F.lit(0)).alias("tokens"),
            given("seq", 0).alias("seq"), given("part", 0).alias("part"), given("copies", 1).alias("copies"),
        )
        order = F.struct("seq", "tokens", "op", "source", "lang", "copies")
        told = told.filter("doc_id IS NOT NULL OR op = 'insert'").withColumn("loose", F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()))
        new = told.groupBy(*KEY, "loose").agg(F.max_by(F.struct("op", "source", "lang", "tokens", "copies"), order).alias("x"))
        new = new.select(*KEY, "x.source", "x.lang", "x.tokens", "x.copies", (F.col("x.op") != "delete").alias("there"))
        new.withColumn("number", F.lit(number)).write.mode("overwrite").parquet(self._entry("counts", number, batch))
        new = self.spark.read.parquet(self._entry("counts", number, batch))
        sums = lambda df, sign: df.select(*GROUP, (sign * F.col("copies")).alias("docs"), (sign * F.col("copies") * F.col("tokens")).alias("tokens"))
        signed = sums(new.filter("there"), F.lit(1))
        before = self.counts()
        if before is not None:
            signed = signed.unionByName(sums(before.join(new.select(*KEY), list(KEY), "left_semi"), F.lit(-1)))
        deltas = signed.groupBy(*GROUP).agg(F.sum("docs").cast("long").alias("docs"), F.sum("tokens").alias("tokens"))
        deltas.write.mode("overwrite").parquet(self._entry("deltas", number, batch))
        if number % self.compacted == 0:
            self.compact()
        return True

    def totals(self) -> DataFrame:
        """``source, lang, tokenizer, docs, tokens`` over all committed batches, without groups that have no documents left."""
        entries = [self._entry("deltas", *b) for b in self.batches()]
        if not entries:
            return self.spark.createDataFrame([], "source string, lang string, tokenizer string, docs long, tokens long")
        return self.spark.read.parquet(*entries).groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).filter("docs <> 0")


def in_parts(docs: DataFrame) -> DataFrame:
    """``doc_id, source, lang, text, part, copies``: every row counts, also where identifiers repeat.

    An identifier that occurs once has part 0.  Rows that share one are told apart by a hash of what they hold, and of rows equal in all one stays, with
    their number; they are counted before they are dealt, so an identifier of very many rows is never in one task.
    """
    told = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c).cast("string").alias(c) for c in ("source", "lang", "text")])
    again = written(told.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id"), "rollups-again")
    alone = lambda df: df.withColumn("part", F.lit(0).cast("long")).withColumn("copies", F.lit(1).cast("long"))
    if again.isEmpty():
        return alone(told)
    same = told.join(again, "doc_id", "left_semi").groupBy("doc_id", "source", "lang", "text").agg(F.count("*").alias("copies"))
    same = same.withColumn("part", F.xxhash64("source", F.col("source").isNull(), "lang", F.col("lang").isNull(), "text", F.col("text").isNull()))
    return alone(told.join(again, "doc_id", "left_anti")).unionByName(same)


def _encoded(batches: Iterator[pa.RecordBatch], path: str, word_ends: bool) -> Iterator[pa.RecordBatch]:
    enc = encoder(path, word_ends)
    for b in batches:
        n = np.array([len(x) // 4 for x in enc.encode(b.column(3).to_pylist())], np.int64)
        yield pa.RecordBatch.from_arrays([*(b.column(i) for i in (0, 1, 2, 4, 5, 6)), pa.array(n, pa.int64())], ["doc_id", "source", "lang", "part", "copies", "words", "pieces"])


def token_counts(docs: DataFrame, versions: dict[str, tuple[str, bool] | None]) -> DataFrame:
    """Insertions for every document and tokenizer version; a version is a vocabulary file and whether it marks ends of words, or None for plain words.

    At most one version may be a vocabulary file in one call.  Null and empty texts have no tokens but are documents; null identifiers, sources and languages
    stay null.  Rows that share an identifier are parts of it and count each.  An empty table gives no changes; other columns are ignored.
    """
    files = [(k, v) for k, v in versions.items() if v]
    if len(files) > 1:
        raise ValueError("one vocabulary file at a time")
    told = in_parts(docs).select("doc_id", "source", "lang", "text", "part", "copies", word_count("text").alias("words"))
    if files:
        path, word_ends = files[0][1]
        told = told.mapInArrow(lambda it: _encoded(it, path, word_ends), "doc_id long, source string, lang string, part long, copies long, words long, pieces long")
    pairs = [F.struct(F.lit(k).alias("tokenizer"), F.col("pieces" if v else "words").alias("tokens")) for k, v in versions.items()]
    told = told.select("doc_id", "source", "lang", "part", "copies", F.explode(F.array(*pairs)).alias("x"))
    return told.select(F.lit("insert").alias("op"), "doc_id", "part", "copies", "source", "lang", "x.tokenizer", "x.tokens")
