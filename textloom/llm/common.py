"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import functools
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One word: a maximal run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows and bytes that one Arrow batch to a Python worker may hold, so that very long texts do not add up.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Make Python workers able to import this package, and bound their Arrow batches."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep)
    if root not in known:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, known)])
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, which driver and executors share.

    Only where the setting is missing (tests on one machine) a temporary folder takes its place; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    made = tempfile.mkdtemp(prefix="textloom-")
    atexit.register(shutil.rmtree, made, True)
    spark.conf.set("spark.checkpoint.dir", f"file://{made}")
    return f"file://{made}"


#: Names of the tables in the shared folder that were made in each open call of a tidied function; the first list holds what results still read.
_made: list[list[str]] = [[]]


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/textloom/{name}-{uuid.uuid4().hex}"
    _made[-1].append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def tidied(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """f, but tables in the shared folder that it made and its result doesn't read are deleted when it returns; cleanup() deletes the others."""

    @functools.wraps(f)
    def run(*args, **kw) -> DataFrame:
        _made.append([])
        out = None
        try:
            out = f(*args, **kw)
        finally:
            made = _made.pop()
            read = {n for file in (out.inputFiles() if out is not None else []) for n in re.findall(r"[0-9a-f]{32}", file)}
            _made[-1] += [p for p in made if p[-32:] in read]
            if spark := SparkSession.getActiveSession():
                _delete(spark, [p for p in made if p[-32:] not in read])
        return out

    return run


def cleanup(spark: SparkSession) -> None:
    """Delete the tables that results of this session read; call it when they have been used."""
    _delete(spark, _made[0])
    _made[0].clear()


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def word_count(text: str | Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD)), F.lit(0)).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_caches: list[dict] = []


def cache(of: dict) -> dict:
    """Make a worker's memory known, so that claim() can free it for another operator's."""
    _caches.append(of)
    return of


def claim(of: dict) -> None:
    """Called at the start of a task: workers outlive tasks, and only one operator's memory is kept in them."""
    for other in _caches:
        if other is not of:
            other.clear()
