"""What was looked at, and rules that fail by themselves."""

import pytest
from pyspark.sql import functions as F

from quillmill.plans import coverage, document_rules
from tests.packages import W, docx

STRICT = '<w:document xmlns:w="http://purl.oclc.org/ooxml/wordprocessingml/main"><w:body/></w:document>'
FULL = docx(
    '<w:p><w:pPr><w:pStyle w:val="Head"/><w:numPr/></w:pPr><w:r><w:t>a</w:t></w:r></w:p><w:tbl><w:tblGrid/></w:tbl><w:sdt><w:sdtPr/><w:sdtContent/></w:sdt>',
    {"word/header1.xml": f"<w:hdr {W}/>", "word/media/image1.png": b"x"},
)
DOCS = {
    "full": FULL, "plain": docx(), "strict": docx(parts={"word/document.xml": STRICT}), "none": b"no zip", "missing": None,
    "styles": docx(parts={"word/styles.xml": "<w:styles"}), "comments": docx(parts={"word/comments.xml": "<w:comments"}),
    "main": docx(parts={"word/document.xml": "<w:document"}), "types": docx(without=("[Content_Types].xml",)), "rels": docx(without=("_rels/.rels",)),
}


@pytest.fixture(scope="module")
def told(spark):
    packages = spark.createDataFrame([(k, None if v is None else bytearray(v)) for k, v in DOCS.items()], "doc string, content binary")
    f = document_rules.facts(packages)
    findings = document_rules.check(packages)
    return {(r["doc"], r["surface"]): r for r in coverage.coverage(f, findings, spark.createDataFrame([("full", False), ("plain", True)], "doc string, failed boolean")).collect()}


@pytest.mark.parametrize(
    ("doc", "surface", "status"),
    [
        ("full", "package.read", "checked"), ("full", "package.xml", "checked"), ("full", "docx.styles", "checked"), ("full", "docx.tables", "checked"),
        ("full", "docx.content-controls", "checked"), ("full", "docx.numbering", "checked"), ("full", "docx.comments", "not-present"), ("full", "docx.header-footer-semantics", "unsupported"),
        ("full", "docx.media-content", "unsupported"), ("full", "package.related-content-types", "checked"), ("full", "docx.fidelity.main-story", "checked"),
        ("plain", "docx.tables", "not-present"), ("plain", "docx.media-content", "not-present"), ("plain", "docx.text-whitespace", "checked"), ("plain", "docx.fidelity.note-bodies", "skipped"),
        ("strict", "docx.tables", "skipped"), ("strict", "docx.strict-wordprocessingml", "unsupported"), ("strict", "docx.fidelity.main-story", "skipped"),
        ("styles", "docx.styles", "skipped"), ("styles", "package.xml", "skipped"), ("styles", "docx.tables", "not-present"), ("comments", "docx.comments", "skipped"),
        ("main", "docx.revisions", "skipped"), ("types", "package.content-types", "skipped"), ("rels", "package.relationships", "skipped"),
        ("none", "package.read", "skipped"), ("missing", "package.read", "skipped"),
    ],
)
def test_surface(told, doc, surface, status):
    assert told[doc, surface]["status"] == status, told[doc, surface]
    assert told[doc, surface]["reason"]


def test_unread_packages_have_one_surface(told):
    assert [s for d, s in told if d == "none"] == ["package.read"] and len([1 for d, _ in told if d == "full"]) == 23
    assert {r["status"] for r in told.values()} <= set(coverage.STATUSES)


def test_a_rule_that_raises_leaves_the_others(spark, monkeypatch):
    packages = spark.createDataFrame([("a", bytearray(docx('<w:p><w:pPr><w:pStyle w:val="No"/></w:pPr></w:p><w:tbl/>')))], "doc string, content binary")
    before = {(r["code"], r["subject"]) for r in document_rules.check(packages).collect()}
    assert {"STY001", "TBL001"} <= {c for c, _ in before}

    def late(f):  # fails when it runs, not when it is planned
        return [document_rules.found(f.main.withColumn("x", F.raise_error(F.lit("boom"))), "X", "error", F.col("x").cast("string"))]

    def early(f):
        raise RuntimeError("not planned")

    late.__name__, early.__name__ = "style_rules", "numbering_rules"
    monkeypatch.setattr(document_rules, "style_rules", late)
    monkeypatch.setattr(document_rules, "numbering_rules", early)
    findings = document_rules.check(packages)
    rows = findings.collect()
    after = {(r["code"], r["subject"]) for r in rows}
    assert {x for x in before if x[0] != "STY001"} <= after
    assert {x for x in after if x[0] == "INT001"} == {("INT001", "style_rules"), ("INT001", "numbering_rules")}
    f = document_rules.facts(packages)
    told = {r["surface"]: r["status"] for r in coverage.coverage(f, findings).collect()}
    assert told["docx.styles"] == told["docx.numbering"] == "skipped" and told["docx.tables"] == "checked"
    s = coverage.summary(coverage.coverage(f, findings)).first()
    assert sum(s[c.replace("-", "_")] for c in coverage.STATUSES) == 23 and s["skipped"] == 8
