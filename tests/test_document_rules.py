"""One package with the defect for each code, and a clean one without any."""

import pytest

from quillmill.plans import document_rules
from tests.packages import W, WORD, comment, docx, marks, rels, types

PAIR = '<w:p><w:pPr><w:rPr><w:ins w:id="1" w:author="A" w:date="d"/></w:rPr></w:pPr><w:ins w:id="1" w:author="A" w:date="d"><w:r><w:rPr/><w:t>x</w:t></w:r></w:ins>{}</w:p>'
LIST = '<w:p><w:pPr><w:numPr><w:ilvl w:val="{1}"/><w:numId w:val="{0}"/></w:numPr></w:pPr></w:p>'
NUMBERING = (
    f'<w:numbering {W}><w:abstractNum w:abstractNumId="0"><w:lvl w:ilvl="0"/></w:abstractNum>'
    '<w:num w:numId="1"><w:abstractNumId w:val="0"/></w:num><w:num w:numId="2"><w:abstractNumId w:val="7"/></w:num></w:numbering>'
)
UNTYPED = types(("/word/document.xml", WORD + "document.main+xml"), ("/word/styles.xml", WORD + "styles+xml"), ("/word/comments.xml", WORD + "comments+xml"))
UNTYPED = UNTYPED.replace('<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>', "")
PEOPLE = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.microsoft.com/office/2011/relationships/people" Target="people.xml"/></Relationships>'

CASES = {
    "clean": (docx(marks(1), {"word/comments.xml": comment(1)}), set()),
    "missing": (None, {"PKG000"}),
    "garbage": (b"not a zip", {"PKG002"}),
    "no-types": (docx(without=("[Content_Types].xml",)), {"PKG003"}),
    "untyped": (docx(parts={"word/media/a.png": "x"}), {"PKG005"}),
    "no-main": (docx(without=("word/document.xml",)), {"PKG006", "REL002"}),
    "wrong-type": (docx(parts={"[Content_Types].xml": types(("/word/document.xml", WORD + "document.main+xml"), ("/word/styles.xml", WORD + "comments+xml"))}), {"PKG010"}),
    "type-twice": (docx(parts={"[Content_Types].xml": types(("/word/document.xml", WORD + "document.main+xml"), ("/WORD/document.xml", WORD + "document.main+xml"))}), {"PKG011"}),
    "escape": (docx(parts={"[Content_Types].xml": types(("/word/document.xml", WORD + "document.main+xml"), ("/word/a%zz.xml", "application/xml"))}), {"PKG010", "PKG012"}),
    "unsafe": (docx(parts={"../evil.xml": "<a/>"}), {"PKG008"}),
    "bad-xml": (docx(parts={"word/styles.xml": "<w:styles"}), {"XML001"}),
    "doctype": (docx(parts={"word/styles.xml": "<!DOCTYPE a><a/>"}), {"XML001"}),
    "strict": (docx(parts={"word/document.xml": '<s:document xmlns:s="http://purl.oclc.org/ooxml/wordprocessingml/main"/>'}), {"PKG009"}),
    "dangling": (docx('<w:p><w:hyperlink r:id="rId9"/></w:p>'), {"REL001"}),
    "target": (docx(related=[("rId7", "image", "media/none.png")]), {"REL002", "REL003"}),
    "repeated-rel": (docx(related=[("rId2", "comments", "comments.xml")]), {"CMT006", "REL004"}),
    "style": (docx('<w:p><w:pPr><w:pStyle w:val="Nope"/></w:pPr></w:p>'), {"STY001"}),
    "based-on": (docx(parts={"word/styles.xml": f'<w:styles {W}><w:style w:styleId="A"><w:basedOn w:val="B"/></w:style></w:styles>'}), {"STY002"}),
    "num-no-part": (docx('<w:p><w:pPr><w:numPr><w:ilvl w:val="0"/><w:numId w:val="3"/></w:numPr></w:pPr></w:p>'), {"NUM001"}),
    "footnote": (docx('<w:p><w:r><w:footnoteReference w:id="5"/></w:r></w:p>'), {"FTN001"}),
    "no-end": (docx(marks(1, end=False), {"word/comments.xml": comment(1)}), {"CMT001"}),
    "no-start": (docx(marks(1, start=False), {"word/comments.xml": comment(1)}), {"CMT002"}),
    "no-ref": (docx(marks(1, ref=False), {"word/comments.xml": comment(1)}), {"CMT003", "CMT005"}),
    "no-definition": (docx(marks(1)), {"CMT004"}),
    "orphan": (docx(parts={"word/comments.xml": comment(4)}), {"CMT005"}),
    "marked-twice": (docx(marks(1) + marks(1), {"word/comments.xml": comment(1)}), {"CMT007"}),
    "revision-id": (docx('<w:p><w:ins w:id="1" w:author="A"/><w:ins w:id="1" w:author="B"/></w:p>'), {"REV001"}),
    "text-in-del": (docx('<w:p><w:del w:id="1"><w:r><w:t>x</w:t></w:r></w:del></w:p>'), {"REV002"}),
    "deltext-in-ins": (docx('<w:p><w:ins w:id="1"><w:r><w:delText>x</w:delText></w:r></w:ins></w:p>'), {"REV003"}),
    "nested-revision": (docx('<w:p><w:ins w:id="1"><w:del w:id="2"><w:r><w:delText>x</w:delText></w:r></w:del></w:ins></w:p>'), set()),
    "no-grid": (docx("<w:tbl><w:tr><w:tc/></w:tr></w:tbl>"), {"TBL001"}),
    "row-width": (docx("<w:tbl><w:tblGrid><w:gridCol/><w:gridCol/></w:tblGrid><w:tr><w:tc/></w:tr></w:tbl>"), {"TBL002"}),
    "spanned": (docx('<w:tbl><w:tblGrid><w:gridCol/><w:gridCol/></w:tblGrid><w:tr><w:tc><w:tcPr><w:gridSpan w:val="2"/></w:tcPr></w:tc></w:tr></w:tbl>'), set()),
    "control": (docx("<w:sdt><w:sdtPr/></w:sdt>"), {"SDT002"}),
    "control-props": (docx("<w:sdt><w:sdtContent/></w:sdt>"), {"SDT001"}),
    "edge": (docx("<w:p><w:r><w:t> x</w:t></w:r></w:p>"), {"TXT001"}),
    "preserved": (docx('<w:p><w:r><w:t xml:space="preserve"> x</w:t></w:r></w:p>'), set()),
    "no-entry": (docx(without=("_rels/.rels",)), {"REL001"}),
    "two-entries": (docx(parts={"_rels/.rels": rels(("rId1", "officeDocument", "word/document.xml"), ("rId2", "officeDocument", "word/styles.xml"))}), {"REL001"}),
    "no-comments": (docx(without=("word/comments.xml",)), {"CMT006", "REL002"}),
    "whole-paragraph": (docx(PAIR.format("")), set()),
    "not-whole": (docx(PAIR.format("<w:r><w:t>y</w:t></w:r>")), {"REV001"}),
    "letter-entity": (docx("<w:p><w:r><w:t>&amp;#65; &amp;#x0000041; &amp;#99999999;</w:t></w:r></w:p>"), set()),
    "level-text": (docx(parts={"word/numbering.xml": f'<w:numbering {W}><w:abstractNum w:abstractNumId="0"><w:lvl w:ilvl="0"><w:lvlText w:val="&amp;#x2022;"/></w:lvl></w:abstractNum></w:numbering>'}), {"TXT002"}),
    "no-num": (docx(LIST.format(9, 0), {"word/numbering.xml": NUMBERING}), {"NUM002"}),
    "no-abstract": (docx(LIST.format(2, 0), {"word/numbering.xml": NUMBERING}), {"NUM003"}),
    "no-level": (docx(LIST.format(1, 5), {"word/numbering.xml": NUMBERING}), {"NUM004"}),
    "list": (docx(LIST.format(1, 0) + LIST.format(0, 7), {"word/numbering.xml": NUMBERING}), set()),
    "unused-note": (docx(parts={"word/footnotes.xml": f'<w:footnotes {W}><w:footnote w:id="-1"/><w:footnote w:id="0" w:type="separator"/><w:footnote w:id="3"/></w:footnotes>'}), {"FTN002"}),
    "no-rels-type": (docx(parts={"[Content_Types].xml": UNTYPED}), {"PKG004"}),
    "people": (docx(parts={"word/people.xml": "<p/>", "word/_rels/document.xml.rels": PEOPLE}), {"PKG010"}),
    "unreached": (docx(parts={"word/dump.xml": "<x"}), {"XML001"}),
    "unknown": (docx(parts={"word/dump.xml": "<x", "word/_rels/document.xml.rels": "<x"}), {"XML001"}),
    "entity": (docx("<w:p><w:r><w:t>&amp;#8217;</w:t></w:r></w:p>"), {"TXT002"}),
}


#: Severity, part and subject of some findings.
SAYS = {
    ("unreached", "XML001"): ("warn", "word/dump.xml", None),
    ("bad-xml", "XML001"): ("error", "word/styles.xml", None),
    ("style", "STY001"): ("error", "word/document.xml", "Nope"),
    ("based-on", "STY002"): ("warn", "word/styles.xml", "B"),
    ("dangling", "REL001"): ("error", "word/document.xml", "rId9"),
    ("no-entry", "REL001"): ("error", "_rels/.rels", None),
    ("no-level", "NUM004"): ("warn", "word/document.xml", "1"),
    ("unused-note", "FTN002"): ("error", "word/footnotes.xml", "3"),
    ("no-rels-type", "PKG004"): ("error", None, None),
    ("people", "PKG010"): ("error", "word/people.xml", None),
    ("not-whole", "REV001"): ("error", "word/document.xml", "1"),
    ("edge", "TXT001"): ("warn", "word/document.xml", None),
}


@pytest.fixture(scope="module")
def findings(spark):
    packages = spark.createDataFrame([(k, None if v is None else bytearray(v)) for k, (v, _) in CASES.items()], "doc string, content binary")
    rows = document_rules.check(packages).collect()
    assert all(r["severity"] in document_rules.RANK and r["message"] for r in rows)
    found = {(r["doc"], r["code"]): r for r in rows}
    said = {k: (found[k]["severity"], found[k]["part"], found[k]["subject"]) for k in SAYS}
    assert said == SAYS
    return {k: {r["code"] for r in rows if r["doc"] == k} for k in CASES}


@pytest.mark.parametrize("name", CASES)
def test_codes(findings, name):
    assert findings[name] == CASES[name][1]
