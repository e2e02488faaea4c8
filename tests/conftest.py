import os
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def canonical(rows, columns):
    """Rows as sorted tuples of text, columns in the order of their names."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def show(v):
        if v is None:
            return "~"
        if isinstance(v, float) and v == v and abs(v) != float("inf") and v == int(v):
            return str(int(v))
        if isinstance(v, float):
            return repr(v)
        if type(v).__name__ == "Decimal":
            return str(int(v)) if v == int(v) else repr(float(v))
        return str(v)

    return sorted(tuple(show(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    return c


def check_query(spark, duck, query, sql):
    df = query(spark, DATA)
    cur = duck.execute(sql)
    names = [x[0] for x in cur.description]
    assert sorted(df.columns) == sorted(names)
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(cur.fetchall(), names)
