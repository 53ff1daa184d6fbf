"""Severities, ignores, baselines, the source's findings, expectations and reports."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quillmill.functions import text as T
from quillmill.operators import bags, scan
from quillmill.plans import policy as Y
from quillmill.plans.document_rules import ranked

SCHEMA = "doc string, code string, severity string, `where` string, part string, subject string, message string"
ROWS = [
    ("out/a.docx", "STY001", "error", "w:pStyle#3", "word/document.xml", "Head", "undefined style"),
    ("out/a.docx", "STY001", "error", "w:pStyle#9", "word/document.xml", "Head", "undefined style"),
    ("out/a.docx", "TXT001", "warn", None, "word/document.xml", None, "edge white space"),
    ("out/sub/b.docx", "REL003", "info", None, "word/_rels/document.xml.rels", "rId4", "declared but never referenced"),
    ("out/sub/b.docx", "XML001", "error", None, "x.xml", None, "part could not be parsed"),
    ("c.docx", "FID004", "error", None, "word/comments.xml", "First.", "a comment is gone"),
]
POLICY = """
fail-on = "warn"
[severity]
REL003 = "off"
TXT001 = "error"
[[ignore]]
code = "XML001"
path = "out/**/b.docx"
reason = "a text dump"
[[ignore]]
code = "*"
path = "out/sub/"
reason = "all of it"
[[expect]]
code = "FID004"
reason = "asked for"
match = { subject = "First." }
path = "c.docx"
[[expect]]
code = "FID005"
reason = "asked for, too"
path = "c.docx"
"""


@pytest.fixture
def found(spark):
    return ranked(spark.createDataFrame(ROWS, SCHEMA))


def test_policy(found):
    got = {(r["doc"], r["code"], r["where"]): r for r in Y.apply_policy(found, Y.load(POLICY)).collect()}
    assert got["out/sub/b.docx", "REL003", None]["suppressed"] == "severity.REL003 = off"
    assert got["out/sub/b.docx", "XML001", None]["suppressed"] == "ignore XML001 in out/**/b.docx: a text dump"
    assert got["out/a.docx", "TXT001", None]["severity"] == "error" and got["out/a.docx", "TXT001", None]["severity_rank"] == 3
    assert Y.fails(Y.apply_policy(found, Y.load(POLICY)).where("doc like '%b.docx'")).first()["failed"] is False
    assert Y.fails(found).first()["failed"] and not Y.fails(found.limit(0)).first()["failed"]


@pytest.mark.parametrize("text", ["fail-on = 'loud'", "colour = 1", "[[ignore]]\ncode = 'A'", "[severity]\nA = 'bad'", "[[expect]]\ncode='A'\nreason='r'\nnope=1"])
def test_bad_policies(text):
    with pytest.raises(ValueError):
        Y.load(text)


@pytest.mark.parametrize(("pattern", "yes", "no"), [
    ("decks/*.pptx", ["decks/a.pptx"], ["decks/a/b.pptx", "a.pptx"]), ("out/**/acc/*.docx", ["out/acc/a.docx", "out/x/y/acc/a.docx"], ["out/a/acc/n/a.docx"]),
    ("out/", ["out/a", "out/a/b"], ["out"]), ("*", ["a", "a/b"], []), ("./a?[bc].docx", ["axb.docx", "./axc.docx"], ["axd.docx", "a/b.docx"]), ("a\\\\*", ["a/b"], ["a"]), ("[!a]x", ["bx"], ["ax"]),
])
def test_paths(spark, pattern, yes, no):
    rows = spark.createDataFrame([(p, True) for p in yes] + [(p, False) for p in no], "p string, want boolean")
    assert all(r["got"] == r["want"] for r in rows.withColumn("got", Y.clean(F.col("p")).rlike(Y.path_regex(pattern))).collect())


def test_baseline(spark, found):
    base = Y.make_baseline(found.where("message <> 'undefined style' or `where` = 'w:pStyle#3'"))
    again = Y.read_baseline(spark, Y.baseline_json(base))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, base.collect()))
    assert [r["where"] for r in Y.apply_baseline(found, again).collect()] == ["w:pStyle#9"]
    assert Y.apply_baseline(found.unionByName(found), again).count() == 7
    for bad in ("[]", '{"version": 1, "findings": {}}', '{"version": 2, "findings": {"a": -1}}'):
        with pytest.raises(ValueError):
            Y.read_baseline(spark, bad)


def test_introduced(found):
    source = found.where("code in ('TXT001', 'FID004', 'XML001') or `where` = 'w:pStyle#3'").withColumn("where", F.when(F.col("code") == "TXT001", "elsewhere").otherwise(F.col("where")))
    got = {(r["code"], r["where"]): r["level"] for r in Y.introduced(found, source).collect()}
    assert got == {("STY001", "w:pStyle#3"): "exact", ("STY001", "w:pStyle#9"): "new", ("TXT001", None): "loose", ("REL003", None): "new", ("XML001", None): "new", ("FID004", None): "new"}


def test_expectations(spark, found):
    files = spark.createDataFrame([("c.docx",), ("out/a.docx",)], "doc string")
    rows = Y.expect(found, Y.load(POLICY).expectations, files).collect()
    assert [(r["code"], r["expected"]) for r in rows if r["expected"]] == [("FID004", "asked for")]
    assert [(r["doc"], r["code"], r["message"]) for r in rows if r["code"] == "EXP001"] == [("c.docx", "EXP001", "expected finding did not occur: FID005 (asked for, too)")]
    assert Y.parse_expectation("fid004: subject=First.,part=x").match == {"subject": "First.", "part": "x"}
    for bad in ("", ":a=b", "FID004:nope"):
        with pytest.raises(ValueError):
            Y.parse_expectation(bad)


def test_summary_and_reports(spark, found):
    one = Y.summarize(found).first()
    assert (one["error"], one["warn"], one["info"], one["worst"]) == (4, 1, 1, "error")
    assert Y.summarize(found.limit(0)).first().asDict() == {"error": 0, "warn": 0, "info": 0, "worst_rank": None, "worst": None}
    report = {r["doc"]: json.loads(r["report"]) for r in Y.json_report(found).collect()}
    assert report["out/a.docx"]["summary"] == {"error": 2, "warn": 1, "info": 0} and "where" not in report["c.docx"]["findings"][0]
    log = json.loads(Y.sarif_log(Y.apply_policy(found, Y.load(POLICY))))["runs"][0]
    assert [r["id"] for r in log["tool"]["driver"]["rules"]] == ["FID004", "REL003", "STY001", "TXT001", "XML001"]
    assert sum("suppressions" in r for r in log["results"]) == 2 and log["results"][0]["locations"][0]["physicalLocation"]["artifactLocation"]["uri"] == "c.docx"
    assert Y.human_report(found).first()["line"] == "ERROR  FID004  a comment is gone  [word/comments.xml]"
    files = spark.createDataFrame([("c.docx",), ("out/sub/b.docx",)], "doc string")
    assert {r["doc"]: r["comparable"] for r in Y.comparable(found, files).collect()} == {"c.docx": True, "out/sub/b.docx": False}


def test_numbered_in_ranges(spark):
    rows = spark.createDataFrame([(k % 3 or None, k * 7 % 101) for k in range(101)] + [(1, None)], "g int, o int")
    one = {(r["g"], r["o"]): r["n"] for r in bags.numbered(rows, ["g"], [F.col("o")], "n").collect()}
    many = {(r["g"], r["o"]): r["n"] for r in bags.numbered(rows, ["g"], [F.col("o")], "n", bucket_rows=10).collect()}
    assert one == many and len(one) == 102


def test_null_keys_meet(spark):
    a = spark.createDataFrame([(None, 1), (None, 2), ("x", 3)], "g string, o int")
    assert {(r["g"], r["lost_o"], r["added_o"]) for r in bags.pair_lost_added(a, a.where("o <> 2"), ["g"], "o").collect()} == {(None, 1, 1), (None, 2, None), ("x", 3, 3)}
    assert sorted(r["level"] for r in bags.two_level_inherit(a, a.where("o = 1"), ["g", "o"], ["g"], [F.col("o")]).collect()) == ["exact", "new", "new"]


def test_common_prefix_and_snippet(spark):
    df = spark.createDataFrame([(["a", "b"], ["a", "c"], "abcdef"), ([], ["a"], "ab")], "a array<string>, b array<string>, s string")
    got = df.select(T.common_prefix(F.col("a"), F.col("b")), T.snippet(F.col("s"), 5)).collect()
    assert [tuple(r) for r in got] == [(1, "ab..."), (0, "ab")]


def test_only_keys_of_several_ranges_are_summed_up(spark):
    rows = [(k % 700 if k % 3 else 7, k) for k in range(6000)] + [(None, k) for k in range(400)]
    df = spark.createDataFrame(rows, "g long, o long")
    ranges = scan.apart(df, ["g"], [F.col("o")], 400)
    found = [r["g"] for r in scan.spread(ranges, ["g"]).select("g").distinct().collect()]
    held = {}
    for r in ranges.collect():
        held.setdefault(r["g"], set()).add(r[scan.PART])
    assert sorted(found, key=str) == sorted((g for g, parts in held.items() if len(parts) > 1), key=str)
    assert 7 in found and len(found) < 40


def test_each_row_is_matched_once(spark):
    r = random.Random(3)
    sides = [[(r.choice(["x", "y", None]), k, r.choice([1, 2, 3, None]), r.choice([1, 2, None])) for k in range(150)] for _ in range(2)]
    want, used = set(), [set(), set()]
    for n in range(2):
        free = [{}, {}]
        for s in range(2):
            for g, k, *v in sides[s]:
                if g is not None and v[n] is not None and k not in used[s]:
                    free[s].setdefault((g, v[n]), []).append(k)
        now = [(g, a, b, n) for (g, v), xs in free[0].items() for a, b in zip(xs, free[1].get((g, v), []))]
        want |= set(now)
        for s in range(2):
            used[s] |= {x[1 + s] for x in now}
    a, b = (spark.createDataFrame(x, "g string, ord long, p long, q long") for x in sides)
    got = bags.match_texts(a, b, ["g"], [("p", "p"), ("q", "q")]).collect()
    assert len(got) == len(want) and {(x["g"], x["s_ord"], x["e_ord"], x["round"]) for x in got} == want
