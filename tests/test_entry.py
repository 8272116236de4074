import glob
import os

import pytest

duckdb = pytest.importorskip("duckdb")
DATA = os.environ.get("LUMENSPARK_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


def _names():
    import __spark_entry__ as entry

    return sorted(entry.oracle_sql())


def test_sql_only_for_known_queries():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", _names())
def test_same_rows_as_sql(spark, name):
    import __spark_entry__ as entry

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    df = entry.queries()[name](spark, DATA)
    cursor = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    shown = lambda v: f"{v:.6f}" if isinstance(v, float) else str(v)
    want = sorted([shown(v) for v in r] for r in cursor.fetchall())
    got = sorted([shown(r[c]) for c in columns] for r in df.collect())
    assert sorted(df.columns) == sorted(columns) and got == want
