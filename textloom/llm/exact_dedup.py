"""Exact deduplication by a distributed content sort, in DataFrame operations only.

Rows are range-partitioned by sampled splitters over (first bytes, digest) of the normalised text and sorted externally by the whole text, so equal
texts lie side by side and a run ends where the full text of the neighbour differs.  A counting pass over digests alone, aggregated before its shuffle,
finds texts with very many copies; those are dealt out over several salted blocks, whose summary rows are then compared by full text once more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_partitions

#: Bytes of text in a range splitter, which bounds what the driver samples.
SPLITTER_BYTES = 48
#: A block of equal texts in one sort partition holds about so many rows at least, before it is split.
BLOCK_ROWS = 256


def normalised(text: Column, form: str = "none") -> Column:
    """``none``: as it is; ``space``: runs of ASCII white space become one space, ends trimmed; ``fold``: also lower case.  Null is empty."""
    out = F.coalesce(text, F.lit(""))
    if form not in ("none", "space", "fold"):
        raise ValueError(f"unknown form: {form}")
    if form != "none":
        out = F.btrim(F.regexp_replace(out, r"[\x20\x09-\x0D]+", " "))
    return F.lower(out) if form == "fold" else out


def _runs(salted: DataFrame, parts: int, pick, last_first: bool = False, extra: tuple[str, ...] = ()) -> DataFrame:
    """The content sort: each row with the identifier that its run of equal neighbours keeps, the run's length and its place."""
    first = F.substring(F.col("body").cast("binary"), 1, SPLITTER_BYTES)
    dealt = salted.select("id", "body", "sha", "salt", first.alias("first"), F.col("blocks").isNotNull().alias("split"), *extra)
    dealt = dealt.repartitionByRange(parts, "first", "sha", "salt")
    # The window's keys hold the range keys, so no further exchange: each partition is sorted by content and neighbours are compared in full.
    run = Window.partitionBy("first", "sha", "salt", "body")
    order = F.col("id").desc_nulls_last() if last_first else F.col("id").asc_nulls_last()
    size, place = F.count(F.lit(1)).over(run), F.row_number().over(run.orderBy(order))
    return dealt.select("id", "sha", "split", "salt", "body", *extra, pick("id").over(run).alias("run_keep"), size.alias("run_size"), place.alias("n"))


def _sorted(docs: DataFrame, form: str, keep: str, id_col: str, text_col: str, extra: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """All rows in runs, and the small table ``split_sha, all_keep, all_size, all_salt`` of texts whose copies were dealt over several blocks."""
    pick = {"smallest": F.min, "largest": F.max}[keep]
    parts = n_partitions(docs.sparkSession)
    text = normalised(F.col(text_col), form)
    sha = F.sha2(text.cast("binary"), 256).alias("sha")
    base = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("body"), sha, *extra)
    counted = docs.select(sha).groupBy("sha").agg(F.count("*").alias("copies"))
    block = max(BLOCK_ROWS, docs.count() // (4 * parts))
    # At most rows / block digests pass, that is 4 for each partition.
    heavy = counted.filter(F.col("copies") > block).select(F.col("sha").alias("heavy_sha"), F.ceil(F.col("copies") / block).alias("blocks"))
    salted = base.join(F.broadcast(heavy), F.col("sha") == F.col("heavy_sha"), "left")
    # Dealt by place, so copies that share an identifier, or have none, are dealt out as well.
    salted = salted.withColumn("salt", F.coalesce(F.pmod(F.monotonically_increasing_id(), F.col("blocks")), F.lit(0)).cast("int"))
    # Blocks of a split text meet once more, one row each, compared by digest and full text.
    blocks = _runs(salted.filter(F.col("blocks").isNotNull()), parts, pick).filter(F.col("n") == 1)
    found = F.col("run_keep").isNull() if keep == "smallest" else F.col("run_keep").isNotNull()  # a block without identifiers stays only if all are
    met = blocks.groupBy("sha", "body").agg(pick("run_keep").alias("all_keep"), F.sum("run_size").alias("all_size"), pick(F.struct(found.alias("found"), "run_keep", "salt"))["salt"].alias("all_salt"))
    return _runs(salted, parts, pick, keep == "largest", extra), met.select(F.col("sha").alias("split_sha"), "all_keep", "all_size", "all_salt")


def groups(docs: DataFrame, form: str = "none", keep: str = "smallest", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: ``doc_id, keep_id, group_size, kept, text_sha256``.

    keep: ``smallest`` or ``largest`` identifier of equal texts stays.  Null and empty texts are one group.  A null identifier stays only in a group
    without others; of rows repeated with the same identifier all carry ``kept``.  Empty input gives no rows.  Other columns are ignored.
    """
    runs, met = _sorted(docs, form, keep, id_col, text_col)
    out = runs.select("id", "sha", "split", "run_keep", "run_size").join(F.broadcast(met), F.col("split") & (F.col("sha") == F.col("split_sha")), "left")
    keep_id, size = F.when(F.col("split"), F.col("all_keep")).otherwise(F.col("run_keep")), F.when(F.col("split"), F.col("all_size")).otherwise(F.col("run_size"))
    return out.select(F.col("id").alias("doc_id"), keep_id.alias("keep_id"), size.cast("long").alias("group_size"), F.col("id").eqNullSafe(keep_id).alias("kept"), F.col("sha").alias("text_sha256"))


def dedup(docs: DataFrame, form: str = "none", keep: str = "smallest", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns: one row for each text, also where identifiers repeat."""
    told = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), F.struct(*docs.columns).alias("row"))
    runs, met = _sorted(told, form, keep, "__id", "__text", ("row",))
    out = runs.filter(F.col("n") == 1).join(F.broadcast(met), F.col("split") & (F.col("sha") == F.col("split_sha")), "left")
    # Of a text's blocks one keeps its first row.
    return out.filter(~F.col("split") | (F.col("salt") == F.col("all_salt"))).select("row.*")
