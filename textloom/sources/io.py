"""Reading and writing tables, predictions, submissions, corpora, vocabularies and word vectors."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from pathlib import PurePosixPath

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

FORMATS = {".parquet": "parquet", ".csv": "csv", ".tsv": "csv", ".json": "json", ".orc": "orc"}


def _format(path: str) -> tuple[str, dict]:
    ext = PurePosixPath(path).suffix.lower()
    if ext not in FORMATS:
        raise ValueError(f"unknown extension {ext!r} of {path}; known: {', '.join(FORMATS)}")
    return FORMATS[ext], {"header": "true", **({"sep": "\t"} if ext == ".tsv" else {})} if FORMATS[ext] == "csv" else {}


def load(spark: SparkSession, path: str, schema: StructType | str | None = None, rows: int | None = None) -> DataFrame:
    """A table by its extension; csv without schema has its types inferred, which reads the file once more."""
    kind, options = _format(path)
    reader = spark.read.format(kind).options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    elif kind == "csv":
        reader = reader.option("inferSchema", "true")
    out = reader.load(path)
    return out if rows is None else out.limit(rows)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return load(spark, f"{folder}/{name}.parquet")


def save(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    kind, options = _format(path)
    df.write.mode(mode).format(kind).options(**options).save(path)


def prediction_rows(df: DataFrame, ids: Sequence[str], pred: str, label: str | None = None) -> DataFrame:
    """Identifiers, ``target`` rounded to 4 places, halves to even, and, if given, ``label``."""
    return df.select(*ids, F.bround(F.col(pred).cast("double"), 4).alias("target"), *([F.col(label).alias("label")] if label else []))


def save_predictions(df: DataFrame, path: str, ids: Sequence[str], pred: str, label: str | None = None) -> None:
    prediction_rows(df, ids, pred, label).write.mode("overwrite").option("header", "true").csv(path)


def save_headerless(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "false").csv(path)


def save_lines(df: DataFrame, path: str, cols: Sequence[str], sep: str = ",") -> None:
    """One line of joined values per row."""
    df.select(F.concat_ws(sep, *[F.col(c).cast("string") for c in cols]).alias("value")).write.mode("overwrite").text(path)


def save_tabbed(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", "true").csv(path)


def corpus_lines(*columns: tuple[DataFrame, str], sentinels: Sequence[str] = ("none", "no_content")) -> DataFrame:
    """``line``: every text of the columns but nulls, empty texts and sentinels, line breaks as spaces."""
    out = None
    for df, col in columns:
        part = df.select(F.regexp_replace(F.col(col).cast("string"), r"[\r\n]+", " ").alias("line"))
        out = part if out is None else out.unionByName(part)
    return out.filter(F.col("line").isNotNull() & (F.col("line") != "") & ~F.col("line").isin(*sentinels))


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """``word, count, rank`` of lines ``word count``; rank by count, then word."""
    parts = F.split(F.btrim("value"), r"[ \t]+")
    out = spark.read.text(path).select(parts[0].alias("word"), F.try_element_at(parts, F.lit(2)).cast("long").alias("count")).filter("word <> ''")
    return ranked_vocabulary(out)


def ranked_vocabulary(vocab: DataFrame) -> DataFrame:
    """Adds rank from 1: by count descending, then word.  Numbers are dealt per count and beginning of the word and then within these, so no task orders
    the many words that occur once; one task adds up a row for each count and beginning."""
    vocab = vocab.withColumn("head", F.substring("word", 1, 3))
    sizes = vocab.groupBy("count", "head").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.orderBy(F.desc("count"), "head")) - F.col("n")).select("count", "head", "before")
    inside = F.row_number().over(Window.partitionBy("count", "head").orderBy("word"))
    return vocab.withColumn("inside", inside).join(before, ["count", "head"]).select("word", "count", (F.col("before") + F.col("inside")).alias("rank"))


def vectors(spark: SparkSession, path: str) -> DataFrame:
    """``word, vector`` of lines ``word f1 f2 ...``; a line of two whole numbers is a header and passed over."""
    parts = F.split(F.btrim("value"), r"[ \t]+")
    header = (F.size("p") == 2) & F.col("p")[0].rlike("^[0-9]+$") & F.col("p")[1].rlike("^[0-9]+$")
    lines = spark.read.text(path).select(parts.alias("p")).filter((F.size("p") > 1) & ~header)
    return lines.select(F.col("p")[0].alias("word"), F.transform(F.slice("p", 2, 1 << 20), lambda x: x.cast("float")).alias("vector"))


def save_vectors(df: DataFrame, path: str) -> None:
    line = F.concat_ws(" ", "word", F.array_join(F.transform("vector", lambda x: x.cast("string")), " "))
    df.select(line.alias("value")).write.mode("overwrite").text(path)


def _doubles(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            x = np.frombuffer(data, "<f8").reshape(-1, width)
            yield pa.RecordBatch.from_arrays([pa.array([path] * len(x)), pa.array(range(len(x)), pa.int64()), pa.array(list(x), pa.list_(pa.float64()))], ["path", "row", "values"])


def binary_vectors(spark: SparkSession, path: str, dims: int) -> DataFrame:
    """``path, row, values`` of files of 64-bit floats, dims + 1 to a row: the vector and its bias."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(lambda it: _doubles(it, dims + 1), "path string, row long, values array<double>")


#: A record of the co-occurrence files: two words by rank, 32 bits each, and a weight of 64 bits.
RECORD = np.dtype([("w1", "<i4"), ("w2", "<i4"), ("val", "<f8")])


def cooccurrences(spark: SparkSession, path: str, size: int = 1 << 16) -> DataFrame:
    """``w1, w2, val`` of binary records.  Files are split between records, whatever their size; rows of bytes go to numpy many at a time."""
    records = spark.sparkContext.binaryRecords(path, RECORD.itemsize)

    def read(rows: Iterator[bytes]) -> Iterator[tuple[int, int, float]]:
        from itertools import islice

        while part := b"".join(islice(rows, size)):
            yield from np.frombuffer(part, RECORD).tolist()

    return spark.createDataFrame(records.mapPartitions(read), "w1 int, w2 int, val double")


def require(spark: SparkSession, *paths: str) -> None:
    """Raise FileNotFoundError naming every path that isn't there, in any file system that Spark reads."""
    jvm = spark._jvm
    missing = [p for p in paths if not (h := jvm.org.apache.hadoop.fs.Path(p)).getFileSystem(spark._jsc.hadoopConfiguration()).exists(h)]
    if missing:
        raise FileNotFoundError(", ".join(missing))
