"""Training-data queries against their SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from canvass.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(SF).exists(), reason="driver tables are not here")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    df = QUERIES[name](spark, SF)
    cur = con.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    tidy = lambda v: round(v, 9) if isinstance(v, float) else v
    want = sorted(tuple(tidy(x) for x in r) for r in cur.fetchall())
    assert sorted(tuple(tidy(r[c]) for c in names) for r in df.collect()) == want
