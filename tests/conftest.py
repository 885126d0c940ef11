import os

import pandas as pd
import pytest
from pyspark.sql import SparkSession

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    os.environ.setdefault("TZ", "UTC")
    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g").config("spark.sql.session.timeZone", "UTC").config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse"))).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    if not os.path.isdir(DATA):
        pytest.skip("the driver's tables are not here")
    return DATA


@pytest.fixture(scope="session")
def duck(data):
    import duckdb

    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


def same(spark_rows, duck_rows) -> bool:
    """Equal column names and rows, in any order."""

    def canon(df):
        df = df[sorted(df.columns)]
        cell = lambda v: None if pd.isna(v) else repr(float(v)) if isinstance(v, float) else str(v)
        return sorted(([cell(v) for v in r] for r in df.astype(object).values.tolist()), key=str)

    return sorted(spark_rows.columns) == sorted(duck_rows.columns) and canon(spark_rows) == canon(duck_rows)
