import os

import pytest
from pyspark.sql import SparkSession

os.environ.setdefault("TZ", "UTC")
DATA = os.environ.get("STOCKLORE_TEST_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from stocklore.session import ship

    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    ship(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder():
    if not os.path.isdir(DATA):
        pytest.skip("test tables are absent")
    return DATA


@pytest.fixture(scope="session")
def duck(folder):
    import glob

    import duckdb

    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for p in glob.glob(folder + "/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return con


def same_rows(a, b):
    """Whether two pandas frames hold the same rows under the same columns, whatever their order."""

    def plain(df):
        df = df[sorted(df.columns)].copy()
        for c in df.columns:
            if str(df[c].dtype).startswith("datetime"):
                df[c] = df[c].astype(str).str.slice(0, 26)
            df[c] = df[c].map(lambda v: repr(round(float(v), 6)) if hasattr(v, "__float__") and "." in repr(v) else str(v))
        return sorted(map(tuple, df.values.tolist()))

    return sorted(a.columns) == sorted(b.columns) and plain(a) == plain(b)
