import math
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from keepstream.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, partitions=4, app="tests")
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def folder():
    if not Path(SMALL).exists():
        pytest.skip("no test tables")
    return SMALL


def plain(x):
    if isinstance(x, float) and math.isnan(x):
        return "nan"
    if isinstance(x, (list, tuple)):
        return [plain(i) for i in x]
    return x.replace(tzinfo=None) if hasattr(x, "tzinfo") else x


def same_as_sql(spark, folder, query, sql):
    """Compares a query with its SQL on the same tables, whatever the order of rows and columns."""
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for p in Path(folder).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    df = query(spark, folder)
    cols = sorted(df.columns)
    got = [[plain(r[c]) for c in cols] for r in df.collect()]
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    want = [[plain(r[names.index(c)]) for c in cols] for r in res.fetchall()]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)
