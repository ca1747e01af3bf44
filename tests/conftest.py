import os
import sys

import pandas as pd
import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    return SMALL


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SMALL}/{name}'")
    return con


def _cell(v):
    if v is None or v is pd.NA or v != v:
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float) and v.is_integer():  # of a column of whole numbers and nulls
        return int(v)
    return v if isinstance(v, (str, int, bool, float)) else str(v)


@pytest.fixture(scope="session")
def same_rows():
    """Whether two pandas frames hold the same rows, in any order of rows and columns."""

    def check(a, b):
        assert sorted(a.columns) == sorted(b.columns)
        cols = sorted(a.columns)
        rows = lambda x: sorted(repr([_cell(v) for v in r]) for r in x[cols].astype(object).itertuples(index=False))
        assert rows(a) == rows(b)

    return check
