"""Every registered query against its SQL in DuckDB, and without SQL that it runs."""

from pathlib import Path

import duckdb
import pytest

from keyloom.plans import catalog

SF = "/root/testdata/sf0.01"
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(x):
    if x is None or x != x:
        return ""
    return repr(float(x)) if isinstance(x, int | float) and not isinstance(x, bool) else str(x)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in names) for r in df.collect())
    assert got or name in ("sparse_gc",)
    if name in catalog.ORACLES:
        result = duck.execute(catalog.ORACLES[name])
        columns = [d[0] for d in result.description]
        kinds = {d[0]: str(d[1]) for d in result.description}
        assert sorted(columns) == names
        assert all(KINDS.get(k, kinds[c]) == kinds[c] for c, k in df.dtypes)
        assert got == sorted(tuple(plain(r[columns.index(c)]) for c in names) for r in result.fetchall())


def test_parameters_bite(spark):
    """Operators with parameters must change the state that they are given."""
    n = catalog.QUERIES["live_state"](spark, SF).count()
    for name in ("drop_cells", "relocation_wal", "relocation_index", "relocation_filter", "scan_range", "as_of_state", "reclaimed_floor"):
        assert 0 < catalog.QUERIES[name](spark, SF).count() != n
    assert {r["to_level"] for r in catalog.QUERIES["promote_decision"](spark, SF).collect()} == {"L0", "L1"}
    assert 0 < catalog.QUERIES["sparse_gc"](spark, SF).count() < 15
