import os

import pytest

from corpuslane.session import build_session

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = build_session("tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "3g", "spark.default.parallelism": "4"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    if not os.path.isdir(DATA):
        pytest.skip("no test tables here")
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for f in os.listdir(DATA):
        p = f"{DATA}/{f}"
        c.execute(f"create view {f.split('.')[0]} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def _plain(v):
    if v is None or v != v:
        return "null"
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return "[" + ", ".join(_plain(x) for x in v) + "]"
    return repr(v) if isinstance(v, float) else str(v)


@pytest.fixture(scope="session")
def same_rows():
    """Compares a DataFrame with the result of SQL, as multisets of rows with columns sorted by name."""

    def check(df, con, sql):
        cols = sorted(df.columns)
        got = sorted(tuple(_plain(v) for v in r) for r in df.select(*[f"`{c}`" for c in cols]).collect())
        r = con.execute(sql)
        names = [x[0] for x in r.description]
        assert sorted(names) == cols
        at = [names.index(c) for c in cols]
        want = sorted(tuple(_plain(x[i]) for i in at) for x in r.fetchall())
        assert got == want
        return len(got)

    return check
