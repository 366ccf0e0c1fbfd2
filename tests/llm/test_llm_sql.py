"""Queries with SQL against DuckDB."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from keyloom.llm import queries

SF = "/root/testdata/sf0.01"


def compare(spark, name, folder):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    result = con.execute(queries.ORACLES[name])
    columns = [d[0] for d in result.description]
    want = result.fetchall()
    df = queries.QUERIES[name](spark, folder)
    assert sorted(df.columns) == sorted(columns)
    got = df.collect()
    assert sorted(map(str, want)) == sorted(str(tuple(r[c] for c in columns)) for r in got)
    return got


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, name):
    compare(spark, name, SF)


def test_hosts_that_are_rejected(spark, tmp_path):
    """The same SQL on a table in which host rules must fire, for each of the three rules."""
    good = "ten words that are all different and make a line here"
    bad = {"base": "few words", "symbols": "a#b c#d e$f g&h i|j k<l m>n o*p q%r s#t u#v", "lines": "\n".join(["one line", "one line", "two rows", "two rows", "three here", "three here"])}
    rows = [(i, bad[h] if i % 9 else good, h) for i, h in enumerate(["base", "symbols", "lines"] * 60)]
    rows += [(1000 + i, good, f"h{i % 30}") for i in range(3000)] + [(5000, "few words", "tiny"), (5001, good, "tiny"), (5002, None, None)]
    pq.write_table(pa.table(dict(zip(("doc_id", "text", "source"), map(list, zip(*rows, strict=True)), strict=True))), tmp_path / "documents.parquet")
    got = {r["doc_id"]: r for r in compare(spark, "op10_quality", str(tmp_path))}
    for i, h in ((0, "base"), (1, "symbols"), (2, "lines")):
        assert not got[i + 9 * 3]["base_failed"] and not got[i + 9 * 3]["kept"], h
    assert got[1000]["kept"] and got[5001]["kept"]
