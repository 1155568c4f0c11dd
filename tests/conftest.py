import math
import os
import sys
from collections import Counter

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{DATA}/{name}')")
    return con


def plain(v):
    """A value that compares over engines."""
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return int(v) if type(v).__name__ == "Decimal" else v


def same(df, con, sql):
    """Asserts that a frame has the rows of a query, in any order."""
    names = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in names) for r in df.collect())
    found = con.execute(sql)
    own = [d[0] for d in found.description]
    assert sorted(own) == names
    want = Counter(tuple(plain(r[own.index(c)]) for c in names) for r in found.fetchall())
    assert got == want
