"""Metrics of rules and what became of attempts."""

from quillmill.plans import document_rules, evidence


def test_rule_metrics(spark):
    schema = "doc string, code string"
    expected = spark.createDataFrame([("a", "X"), ("b", "X"), ("c", "Y"), (None, "Y"), ("a", "X")], schema)
    found = spark.createDataFrame([("a", "X"), ("a", "X"), ("d", "X"), (None, "Y"), ("e", "Z")], schema)
    rules = spark.createDataFrame([("X",), ("Y",), ("Z",), ("W",)], "code string")
    got = {r["code"]: tuple(r)[1:] for r in evidence.rule_metrics(expected, found, rules).collect()}
    assert got == {"X": (1, 1, 1, 0.5, 0.5), "Y": (1, 0, 1, 1.0, 0.5), "Z": (0, 1, 0, 0.0, None), "W": (0, 0, 0, None, None)}
    assert {r["code"] for r in evidence.rule_metrics(expected, found).collect()} == {"X", "Y", "Z"}


def test_attempts_and_corpora(spark):
    rows = spark.createDataFrame([("a", "t1", True), ("b", "t1", True), ("c", "t1", False), ("d", "t1", False), ("e", "t2", None)], "doc string, tool string, damaged boolean")
    kind = "doc string, code string, severity string, `where` string, part string, subject string, message string"
    found = [("a", "X", "error"), ("b", "X", "warn"), ("c", "X", "error"), ("x/k.DOCX", "X", "error"), ("x/b.docx", "X", "error"), ("x/b.docx", "X", "error"), ("x.y/n", "X", "error")]
    findings = document_rules.ranked(spark.createDataFrame([(*f, None, None, None, "m") for f in found], kind))
    got = {r["tool"]: tuple(r)[1:] for r in evidence.attempts(rows, findings, ["tool"]).collect()}
    assert got == {"t1": (1, 1, 1, 1, 0, 4), "t2": (0, 0, 0, 0, 1, 1)}
    files = spark.createDataFrame([(f"x/{k}.docx",) for k in "abcdef"] + [("x/k.DOCX",), ("x.y/n",)], "doc string")
    groups = {r["suffix"]: (r["n"], r["files"], r["examples"]) for r in evidence.corpus_groups(files, findings, 1).collect()}
    assert groups == {".docx": (3, 2, ["x/b.docx"]), "": (1, 1, ["x.y/n"])}
