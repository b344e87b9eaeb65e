import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])
DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "3g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    def rows(sql: str, sf: str):
        c = duckdb.connect()
        for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
            c.execute(f"create view {t} as select * from '{DATA}/{sf}/{t}.parquet'")
        return c.sql(sql).df()

    return rows


@pytest.fixture(scope="session")
def same():
    import pandas as pd

    def values(df):
        cols = sorted(df.columns)
        text = lambda x: "NULL" if pd.isna(x) else repr(round(x, 9)) if isinstance(x, float) else str(x)
        return cols, sorted(tuple(map(text, t)) for t in df[cols].astype(object).itertuples(index=False, name=None))

    def check(a, b):
        assert values(a) == values(b)

    return check
