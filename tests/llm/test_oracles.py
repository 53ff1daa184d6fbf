"""The registered operator queries beside their DuckDB twins, on whole small tables."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

from quillmill.llm import queries as Q

SF = Path("/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_twin(spark, name):
    con = duckdb.connect()
    for path in SF.glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from '{path}'")
    df = Q.QUERIES[name](spark, str(SF))
    cur = con.execute(Q.ORACLE_SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = Counter(tuple(r[names.index(c)] for c in sorted(names)) for r in cur.fetchall())
    got = Counter(tuple(r[c] for c in sorted(names)) for r in df.collect())
    assert got == want
