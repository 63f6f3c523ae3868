import os
import tempfile

import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").config("spark.checkpoint.dir", tempfile.mkdtemp()).getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def sf_dir():
    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test tables")
    return d


@pytest.fixture(scope="session")
def duck(sf_dir):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return f"{v:.6g}"
    if isinstance(v, list | tuple):
        return str([plain(x) for x in v])
    return str(v)


@pytest.fixture(scope="session")
def same_rows(spark, duck, sf_dir):
    """Holds a query against its SQL, whatever the order of rows and columns."""

    def check(query, sql):
        df = query(spark, sf_dir)
        cols = sorted(df.columns)
        got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
        res = duck.execute(sql)
        names = [x[0] for x in res.description]
        assert sorted(names) == cols
        assert got == sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in res.fetchall())

    return check
