"""Pairs of packages with one difference each."""

import pytest
from pyspark.sql import functions as F

from quillmill.plans import comparison, document_rules
from tests.packages import W, docx

P = "<w:p><w:r><w:t>{}</w:t></w:r></w:p>".format
TEXT = "".join(P(f"Paragraph number {k} with some words.") for k in range(12))
INS = '<w:ins w:id="{0}" w:author="{1}" w:date="2024-01-01T00:00:00Z"><w:r><w:t>{2}</w:t></w:r></w:ins>'.format
DEL = '<w:del w:id="{0}" w:author="{1}" w:date="2024-01-01T00:00:00Z"><w:r><w:delText>{2}</w:delText></w:r></w:del>'.format
HDR = f"<w:hdr {W}>{{}}</w:hdr>".format
SECT = '<w:sectPr><w:headerReference w:type="default" r:id="rId8"/></w:sectPr>'
SECOND = "<w:p><w:pPr><w:sectPr/></w:pPr></w:p>"  # shows the header of the section before


def noted(*texts):
    return f"<w:comments {W}>" + "".join(f'<w:comment w:id="{k}" w:author="Ann">{t}</w:comment>' for k, t in enumerate(texts)) + "</w:comments>"


def headed(text, body=TEXT + SECT):
    return docx(body, {"word/header1.xml": HDR(text)}, [("rId8", "header", "header1.xml")])


def with_notes(*texts):
    return docx(TEXT, {"word/comments.xml": noted(*texts)})


ALT = "<mc:AlternateContent><mc:Choice>{0}</mc:Choice><mc:Fallback>{1}</mc:Fallback></mc:AlternateContent>".format

CASES = {
    "same": (docx(TEXT), docx(TEXT), set()),
    "unreadable": (docx(TEXT), b"no zip", {("FID000", "error")}),
    "tables-lost": (docx(TEXT + "<w:tbl><w:tblGrid/></w:tbl>"), docx(TEXT), {("FID001", "error")}),
    "one-link-lost": (docx(TEXT + "<w:p><w:hyperlink/><w:hyperlink/></w:p>"), docx(TEXT + "<w:p><w:hyperlink/></w:p>"), {("FID001", "warn")}),
    "former-section": (docx(TEXT + "<w:p><w:pPr><w:sectPrChange><w:sectPr/></w:sectPrChange></w:pPr></w:p>"), docx(TEXT + "<w:p/>"), set()),
    "first-link": (docx(TEXT), docx(TEXT + "<w:p><w:hyperlink/></w:p>"), set()),
    "second-link": (docx(TEXT + "<w:p><w:hyperlink/></w:p>"), docx(TEXT + "<w:p><w:hyperlink/><w:hyperlink/></w:p>"), {("FID002", "info")}),
    "text-lost": (docx(TEXT), docx("".join(P(f"Paragraph number {k} with some words.") for k in range(11))), {("FID003", "error"), ("FID014", "info")}),
    "text-deleted": (docx(TEXT), docx("".join(P(f"Paragraph number {k} with some words.") for k in range(11)) + f"<w:p>{DEL(1, 'B', 'Paragraph number 11 with some words.')}</w:p>"), {("FID012", "info"), ("FID014", "info")}),
    "comment-replaced": (with_notes(P("First.") + P("Second.")), with_notes(P("Other.")), {("FID004", "error")}),
    "comment-reflowed": (with_notes(P("First.") + P("Second.")), with_notes(P("First. Second.")), set()),
    "one-of-two-equal-comments": (with_notes(P("Same."), P("Same.")), with_notes(P("Same.")), {("FID004", "error")}),
    "comment-edit-tracked": (with_notes(P("Old words")), with_notes(f"<w:p><w:r><w:t>Old </w:t></w:r>{DEL(5, 'B', 'words')}{INS(6, 'B', 'text')}</w:p>"), set()),
    "comment-pending-kept": (with_notes(f"<w:p>{INS(1, 'A', 'abc')}</w:p>"), with_notes(f"<w:p>{INS(1, 'A', 'abc')}{INS(2, 'B', ' more')}</w:p>"), set()),
    "comment-pending-accepted": (with_notes(f"<w:p>{INS(1, 'A', 'abc')}</w:p>"), with_notes(P("abc and more")), {("FID004", "error")}),
    "header-changed": (headed(P("Head")), headed(P("Foot")), {("FID007", "error"), ("FID014", "info")}),
    "header-construct": (headed(P("Head") + "<w:p><w:drawing/></w:p>"), headed(P("Head") + "<w:p/>"), {("FID008", "error")}),
    "header-inherited": (headed(P("Head"), TEXT + f"<w:p><w:pPr>{SECT}</w:pPr></w:p>" + SECOND), headed(P("Head"), TEXT + f"<w:p><w:pPr>{SECT}</w:pPr></w:p>" + f"<w:p><w:pPr>{SECT}</w:pPr></w:p>"), set()),
    "paragraph": (docx(TEXT + P("one")), docx(TEXT + P("two")), {("FID014", "info")}),
    "fallback": (docx(TEXT + f"<w:p><w:r>{ALT('<w:drawing/>', '<w:drawing/>')}</w:r></w:p>"), docx(TEXT + f"<w:p><w:r>{ALT('<w:drawing/>', '<w:pict/>')}</w:r></w:p>"), {("FID001", "warn")}),
}


@pytest.fixture(scope="module")
def findings(spark):
    pairs = spark.createDataFrame([(k, bytearray(a), bytearray(b)) for k, (a, b, _) in CASES.items()], "pair string, source binary, edited binary")
    rows = comparison.compare(pairs).collect()
    assert {r["doc"] for r in rows} <= set(CASES) and all(r["message"] and r["severity_rank"] for r in rows)
    return rows


@pytest.mark.parametrize("name", CASES)
def test_compare(findings, name):
    assert {(r["code"], r["severity"]) for r in findings if r["doc"] == name} == CASES[name][2]


def test_what_a_finding_says(findings):
    by = {(r["doc"], r["code"]): r for r in findings}
    assert by["comment-replaced", "FID004"]["subject"] == "First. Second." and by["comment-replaced", "FID004"]["part"] == "word/comments.xml"
    assert by["header-changed", "FID007"]["where"] == "header/default" and by["paragraph", "FID014"]["where"] == "document/p13"
    assert by["text-deleted", "FID012"]["message"] == "document: 1 new tracked deletion by B"
    assert by["fallback", "FID001"]["where"].endswith("mc:AlternateContent/fallback")


def test_text_views(spark):
    body = (
        f'<w:p><w:pPr><w:tabs><w:tab/></w:tabs></w:pPr><w:r><w:t>a</w:t><w:tab/><w:t>b</w:t><w:br/><w:noBreakHyphen/><w:softHyphen/><w:sym w:char="2022"/><w:sym w:char="D800"/></w:r>'
        f'{INS(1, "A", "new")}{DEL(2, "A", "old")}<w:moveFrom><w:r><w:t>gone</w:t></w:r></w:moveFrom><w:r>{ALT("<w:t>x</w:t>", "<w:t>y</w:t>")}</w:r></w:p>'
    )
    f = document_rules.facts(spark.createDataFrame([("d", bytearray(docx(body)))], "doc string, content binary"))
    got = comparison.paragraph_views(f.nodes.where("part = 'word/document.xml'")).select("current", "original").collect()
    assert [tuple(r) for r in got] == [("a b -•newx", "a b -•oldgonex")]
    codes = spark.createDataFrame([("41",), ("0001F600",), ("110000",), ("zz",), (None,), ("0",)], "c string")
    assert [r[0] for r in codes.select(comparison.symbol(F.col("c"))).collect()] == ["A", "😀", "", "", "", ""]


