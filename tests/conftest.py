import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join([str(ROOT), *filter(None, [os.environ.get("PYTHONPATH")])])
DATA = os.environ.get("TEXTLOOM_TESTDATA", "/root/testdata/sf0.01")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    return DATA


@pytest.fixture(scope="session")
def duck(data):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(data):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{data}/{f}'")
    return con


def _plain(v):
    if v is None or (isinstance(v, float) and v != v):
        return "NULL"
    return repr(float(v)) if hasattr(v, "__float__") and not isinstance(v, (bool, str)) and type(v).__name__ != "bool" else str(v)


@pytest.fixture(scope="session")
def same_rows():
    """Compare a Spark and a DuckDB result as sets of rows."""

    def check(df, relation):
        a, b = df.toPandas(), relation.df()
        assert sorted(a.columns) == sorted(b.columns)
        cols = sorted(a.columns)
        rows = [sorted(map(tuple, x[cols].map(_plain).itertuples(index=False))) for x in (a, b)]
        assert rows[0] == rows[1]

    return check
