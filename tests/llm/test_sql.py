import duckdb
import pytest

from stratalog.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    sf_dir = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    df = queries.queries()[name](spark, sf_dir)
    cur = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(tuple(row[columns.index(c)] for c in sorted(columns)) for row in cur.fetchall())
    assert sorted(tuple(r[c] for c in sorted(columns)) for r in df.collect()) == want
