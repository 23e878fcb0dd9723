import os
import sys

import duckdb
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[*]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "6g").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    """Values of both engines in one form."""
    import pandas as pd

    if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and v != v:
        return None
    if hasattr(v, "tolist") and not hasattr(v, "isoformat"):
        v = v.tolist()
    if isinstance(v, float) and v == int(v):
        return int(v)
    return pd.Timestamp(v).isoformat() if hasattr(v, "isoformat") else v


def rows(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted((tuple(map(plain, r)) for r in pdf[cols].itertuples(index=False, name=None)), key=str)


@pytest.fixture(scope="session")
def same_rows(spark, duck, sf):
    def check(query, sql):
        assert rows(query(spark, sf).toPandas()) == rows(duck.sql(sql).df())

    return check
