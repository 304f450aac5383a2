"""Every registered query of the library against its SQL, on sf0.001."""

import duckdb
import pytest

from tidemark.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def plain(rows):
    return sorted(tuple("" if x is None else f"{x:.9g}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x) for x in r) for r in rows)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("nation", "customer", "orders", "part"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    expected = con.execute(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall()
    assert plain(df.select(*columns).collect()) == plain(expected)
