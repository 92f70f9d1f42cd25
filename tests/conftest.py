import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.default.parallelism", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(sf):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(rows, columns):
    """Rows as comparable tuples, in a fixed order."""

    def one(x):
        if isinstance(x, float):
            return round(x, 9)
        return list(x) if isinstance(x, (list, tuple)) else x

    return sorted((tuple(one(x) for x in r) for r in rows), key=repr)


@pytest.fixture(scope="session")
def agree(spark, sf, duck):
    """Hold a registered query against its SQL on whole tables."""

    def check(run, sql):
        df = run(spark, sf)
        names = sorted(df.columns)
        got = plain([tuple(r) for r in df.select(*names).collect()], names)
        rel = duck.execute(sql)
        have = [d[0] for d in rel.description]
        assert sorted(have) == names
        order = [have.index(n) for n in names]
        want = plain([tuple(r[i] for i in order) for r in rel.fetchall()], names)
        assert got == want

    return check
