"""Word counts and windowed event counts over streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``word, count`` over all documents so far; for output mode complete or update."""
    return docs.select(F.explode(X.normalized_tokens(text)).alias("word")).groupBy("word").agg(F.count("*").alias("count"))


def event_windows(events: DataFrame, time: str = "ts", kind: str = "event_type", value: str = "value", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """``start, kind, n, total`` of tumbling windows; events later than the watermark are left out."""
    windows = events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), kind).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return windows.select(F.col("w.start").alias("start"), F.col(kind).alias("kind"), "n", "total")
