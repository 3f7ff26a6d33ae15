"""Versioned sets of bucketed tables in a shared folder, so that what one job has built many others read without an exchange.

A store is a folder with tables and, written last, a manifest: which tables there are, their schemas, keys, buckets, and some numbers.  Its version follows
from the files that it was built from and from the parameters, so a changed input gets a new store and an old one is never read for it.
"""

from __future__ import annotations

import atexit
import hashlib
import json
import shutil
import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "manifest.json"


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; only where it is unset, on one machine, a temporary one takes its place."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    made = tempfile.mkdtemp(prefix="textloom-")
    atexit.register(shutil.rmtree, made, True)
    spark.conf.set("spark.checkpoint.dir", f"file://{made}")
    return f"file://{made}"


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def fingerprint(df: DataFrame) -> str:
    """A digest of what a table reads: its plan and its files' names, sizes and times; of a table without files, its plan and a sum over its rows."""
    spark, files = df.sparkSession, df.inputFiles()
    told = [str(df.semanticHash()) if files else df.schema.simpleString()]
    for folder in sorted({f.rpartition("/")[0] for f in files}):
        fs, at = _path(spark, folder)
        told += sorted(f"{s.getPath().toString()} {s.getLen()} {s.getModificationTime()}" for s in fs.listStatus(at) if s.isFile())
    if not files:
        row = F.xxhash64(*df.columns)
        told.append(str(df.agg(F.count("*"), F.bit_xor(row), F.sum(F.shiftright(row, 20))).first()))
    return hashlib.sha256("\n".join(told).encode()).hexdigest()[:24]


def _deleted(spark: SparkSession, path: str) -> None:
    if spark._jsc is not None and not spark._jsc.sc().isStopped():
        fs, at = _path(spark, path)
        fs.delete(at, True)


class Store:
    """One version of a set of tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self._read = spark, folder, {}
        self.manifest: dict = {"tables": {}, "facts": {}}

    @property
    def facts(self) -> dict:
        return self.manifest["facts"]

    def _name(self, table: str) -> str:
        return f"textloom_{hashlib.sha256(self.folder.encode()).hexdigest()[:16]}_{table}"

    def put(self, table: str, df: DataFrame, keys: Sequence[str] = (), order: Sequence[str] = (), buckets: int | None = None) -> DataFrame:
        """Write a table, bucketed by keys and sorted by keys and order within buckets, and read it back.  Without keys it is only written."""
        path, n = f"{self.folder}/{table}", buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        if keys:
            dealt = df.repartition(n, *keys).sortWithinPartitions(*keys, *order)  # one file for each bucket
            self.spark.sql(f"DROP TABLE IF EXISTS {self._name(table)}")
            dealt.write.mode("overwrite").format("parquet").bucketBy(n, *keys).sortBy(*keys, *order).option("path", path).saveAsTable(self._name(table))
        else:
            df.write.mode("overwrite").parquet(path)
        self.manifest["tables"][table] = {"ddl": ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), "keys": list(keys), "order": list(order), "buckets": n}
        self._read[table] = True
        return self.get(table)

    def get(self, table: str) -> DataFrame:
        """A table with its buckets; in a session that hasn't written it, it is made known first."""
        of = self.manifest["tables"][table]
        path = f"{self.folder}/{table}"
        if not of["keys"]:
            return self.spark.read.schema(of["ddl"]).parquet(path)
        if table not in self._read:
            clustered = f"CLUSTERED BY ({', '.join(of['keys'])}) SORTED BY ({', '.join([*of['keys'], *of['order']])}) INTO {of['buckets']} BUCKETS"
            self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self._name(table)} ({of['ddl']}) USING parquet {clustered} LOCATION '{path}'")
            self._read[table] = True
        return self.spark.table(self._name(table))

    def scratch(self, df: DataFrame, name: str) -> DataFrame:
        """A table that only this session reads, written so that it is made once; it goes when the session ends."""
        path = f"{self.folder}/scratch/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        atexit.register(_deleted, self.spark, path)
        return self.spark.read.schema(df.schema).parquet(path)

    def has(self, table: str) -> bool:
        return table in self.manifest["tables"]

    def _manifest_path(self):
        return _path(self.spark, f"{self.folder}/{MANIFEST}")

    def seal(self) -> None:
        """Write the manifest: from now on others find the store whole.  A table that is put later is found once it is sealed again."""
        fs, at = self._manifest_path()
        part = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{uuid.uuid4().hex}.tmp")
        out = fs.create(part, True)
        out.write(bytearray(json.dumps(self.manifest).encode()))
        out.close()
        fs.delete(at, False)
        fs.rename(part, at)

    def open(self) -> bool:
        """Read the manifest; False if there is none."""
        fs, at = self._manifest_path()
        if not fs.exists(at):
            return False
        file = fs.open(at)
        try:
            self.manifest = json.loads(bytes(file.readAllBytes()).decode())
        finally:
            file.close()
        return True


_open: dict[tuple[int, str], Store] = {}


def store(spark: SparkSession, name: str, version: str, build: Callable[[Store], None]) -> Store:
    """The store of this name and version, built if there is none.  One that broke off has no manifest and is built anew."""
    folder = f"{shared_folder(spark)}/textloom-{name}-{version}"
    key = (id(spark._jsparkSession), folder)
    if key not in _open:
        made = Store(spark, folder)
        if not made.open():
            build(made)
            made.seal()
        _open[key] = made
    return _open[key]
