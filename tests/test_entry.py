import duckdb
import pytest

import __spark_entry__ as entry

NAMES = sorted(n for n in entry.oracle_sql())


@pytest.fixture(scope="module")
def con(small):
    import os

    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for f in os.listdir(small):
        c.execute(f"create view {f[:-8]} as select * from '{small}/{f}'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_equals_sql(spark, small, con, name):
    df = entry.queries()[name](spark, small)
    cols = sorted(df.columns)
    plain = lambda v: round(v, 9) if isinstance(v, float) else v
    got = sorted(repr(tuple(plain(x) for x in r)) for r in df.select(*cols).collect())
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted(repr(tuple(plain(r[names.index(c)]) for c in cols)) for r in cur.fetchall())
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_core_does_not_import_llm():
    import pathlib

    for p in pathlib.Path(entry.__file__).parent.joinpath("strandline").rglob("*.py"):
        if "llm" not in p.parts:
            assert "strandline.llm" not in p.read_text(), p
