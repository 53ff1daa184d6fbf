"""Pipeline stages on tables whose columns have the names that the stages use themselves,
with nulls, empty and repeated rows, and on empty tables."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quillmill.llm import decontam, lines, mixing, rules
from tests.llm.helpers import documents, frame, prose

FOLDER = Path(lines.__file__).parent
#: Every name that any operator gives to a column, and that has no meaning to the caller.
NAMES = sorted(
    {n for f in FOLDER.glob("*.py") for n in re.findall(r'"(_?[a-z][a-z0-9_]*)"', f.read_text())}
    - {"doc_id", "text", "source", "n_chars", "item_id", "epoch", "slot", "place", "n_lines", "n_gone", "left", "long", "string", "int"}
)


def clashing(spark, rows=None):
    rows = documents() if rows is None else rows
    return frame(spark, rows, False).withColumns({c: F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))) for c in NAMES})


def bench(spark):
    return spark.createDataFrame([("i1", prose(3)[40:160]), ("i2", None), ("i3", "")], "item_id string, text string")


STAGES = {
    "rules": lambda d: rules.filtered(d, rules.Settings(host_docs=3)),
    "lines": lambda d: lines.deduplicated(d),
    "decontam": lambda d: decontam.removed(d, bench(d.sparkSession)),
    "mixing": lambda d: mixing.mix(d),
}


@pytest.mark.parametrize("name", sorted(STAGES))
def test_columns_come_back_as_they_were(spark, name):
    assert len(NAMES) > 100 and {"_at", "_k", "_host", "_th", "_own", "spans"} <= set(NAMES)
    df = clashing(spark)
    out = STAGES[name](df)
    assert [c for c in out.columns if c in df.columns] == df.columns
    got = out.collect()
    assert got
    for r in got:
        own = "-" if r["doc_id"] is None else str(r["doc_id"])
        assert all(r[c] == f"{c}:{own}" for c in NAMES)
    plain = STAGES[name](frame(spark, documents(), False)).collect()
    key = lambda r: (-1 if r["doc_id"] is None else r["doc_id"], r["text"] or "")
    assert sorted(map(key, got)) == sorted(map(key, plain))


@pytest.mark.parametrize("name", sorted(STAGES))
def test_empty_tables(spark, name):
    df = clashing(spark, [])
    out = STAGES[name](df)
    assert out.count() == 0 and [c for c in out.columns if c in df.columns] == df.columns
