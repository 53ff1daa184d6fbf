"""Every registered query beside its DuckDB twin on the smallest driver tables."""

import math
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from quillmill import queries as Q
from quillmill.operators import relations

SF = Path("/root/testdata/sf0.001")


def value(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6)
    return x


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in SF.glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_twin(spark, duck, name):
    df = Q.QUERIES[name](spark, str(SF))
    cur = duck.execute(Q.ORACLE_SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = Counter(tuple(value(r[names.index(c)]) for c in sorted(names)) for r in cur.fetchall())
    got = Counter(tuple(value(r[c]) for c in sorted(names)) for r in df.collect())
    assert got == want


def test_reachable_has_no_last_level(spark):
    far = 67
    start = spark.createDataFrame([("d", 0)], "doc string, node int")
    edges = spark.createDataFrame([("d", k, k + 1) for k in range(far)] + [("d", far, 0)], "doc string, src int, dst int").coalesce(1).cache()
    got = relations.reachable(start, edges).collect()
    assert sorted((r["node"], r["depth"]) for r in got) == [(k, k) for k in range(far + 1)]


def test_lines_of_few_bytes_stay_in_many_tasks(spark):
    found = Q.QUERIES["first_failing_hop"](spark, str(SF))
    assert found.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1


def test_every_query_has_a_twin():
    assert set(Q.QUERIES) == set(Q.ORACLE_SQL)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).schema == __spark_entry__.entry(spark).schema
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
