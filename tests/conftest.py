import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
SMALL = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from folioflow.runtime import session

    s = session("tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "3g", "spark.ui.showConsoleProgress": "false"})
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def root():
    if not Path(SMALL).is_dir():
        pytest.skip("test tables are not here")
    return SMALL


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="session")
def duck(root):
    import duckdb

    con = duckdb.connect()
    for f in Path(root).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def same(value):
    if value is None or isinstance(value, float) and value != value:
        return None
    if isinstance(value, float):
        return round(value, 5)
    return str(value) if not isinstance(value, (int, bool)) else value


def agree(spark, duck, root, f, sql):
    cursor = duck.execute(sql)
    names = [c[0] for c in cursor.description]
    expected = cursor.fetchall()
    df = f(spark, root)
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    left = sorted((tuple(same(r[names.index(c)]) for c in order) for r in expected), key=str)
    right = sorted((tuple(same(r[c]) for c in order) for r in df.collect()), key=str)
    assert left == right
