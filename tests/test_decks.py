"""Slides in order, placeholders that inherit, and the geometry rules."""

import io
import random
import zipfile

import pytest

from quillmill.operators import relations
from quillmill.plans import decks, document_rules
from tests.packages import rels, types

NS = 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
INCH = 914_400


def shape(name, box=None, text="words", ph=None, rot=0, anchor="", body=""):
    at = f'<a:xfrm rot="{rot}"><a:off x="{box[0]}" y="{box[1]}"/><a:ext cx="{box[2]}" cy="{box[3]}"/></a:xfrm>' if box else ""
    holder = "" if ph is None else "<p:ph" + "".join(f' {k}="{v}"' for k, v in ph.items()) + "/>"
    anchored = f' anchor="{anchor}"' if anchor else ""
    return f'<p:sp><p:nvSpPr><p:cNvPr id="1" name="{name}"/><p:nvPr>{holder}</p:nvPr></p:nvSpPr><p:spPr>{at}</p:spPr><p:txBody><a:bodyPr{anchored}{body}/><a:p><a:r><a:t>{text}</a:t></a:r></a:p></p:txBody></p:sp>'


def tree(kind, *shapes):
    return f"<p:{kind} {NS}><p:cSld><p:spTree>{''.join(shapes)}</p:spTree></p:cSld></p:{kind}>"


def pptx(slides, layout=(), master=(), order=None, listed=None, changed=None):
    order = range(1, len(slides) + 1) if order is None else order
    entries = "".join(f'<p:sldId id="{255 + k}" r:id="rId{k}"/>' for k in order) if listed is None else listed
    files = {
        "[Content_Types].xml": types(), "_rels/.rels": rels(("rId1", "officeDocument", "ppt/presentation.xml")),
        "ppt/presentation.xml": f'<p:presentation {NS}><p:sldIdLst>{entries}</p:sldIdLst><p:sldSz cx="{10 * INCH}" cy="{5 * INCH}"/></p:presentation>',
        "ppt/_rels/presentation.xml.rels": rels(*((f"rId{k}", "slide", f"slides/slide{k}.xml") for k in range(1, len(slides) + 1))),
        "ppt/slideLayouts/slideLayout1.xml": tree("sldLayout", *layout), "ppt/slideMasters/slideMaster1.xml": tree("sldMaster", *master),
        "ppt/slideLayouts/_rels/slideLayout1.xml.rels": rels(("rId1", "slideMaster", "../slideMasters/slideMaster1.xml")),
    }
    for k, s in enumerate(slides, 1):
        files[f"ppt/slides/slide{k}.xml"] = tree("sld", *s)
        files[f"ppt/slides/_rels/slide{k}.xml.rels"] = rels(("rId1", "slideLayout", "/ppt/slideLayouts/slideLayout1.xml"))
    files |= changed or {}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in files.items():
            if data is not None:
                z.writestr(zipfile.ZipInfo(name, (2020, 1, 1, 0, 0, 0)), data)
    return out.getvalue()


A, B = (INCH, INCH, 2 * INCH, INCH), (6 * INCH, INCH, 2 * INCH, INCH)
HOLDERS = [shape("T", A, ph={"type": "title", "idx": "0"}, anchor="b"), shape("L1", None, ph={"idx": "7"}), shape("L2", B, ph={"idx": "8"}, anchor="ctr"), shape("L3", A, ph={"type": "pic"})]
MASTER = [shape("MT", B, ph={"type": "title"}, anchor="ctr"), shape("MB", None, ph={"type": "body"}, anchor="b")]
DECKS = {
    "order": pptx([[shape("one", A)], [shape("two", A)], [shape("three", A)]], order=[3, 1]),
    "inherit": pptx(
        [[
            shape("title", ph={"type": "title"}), shape("by-index", ph={"idx": "8"}), shape("by-type", ph={"idx": "99"}), shape("place-of-another", ph={"idx": "7"}),
            shape("own", (1, 2, 3, 4), ph={"idx": "8"}, anchor="t"), shape("centred", ph={"type": "ctrTitle"}), shape("none"), shape("grouped"), shape("picture", ph={"type": "pic", "idx": "55"}),
        ]], HOLDERS, MASTER,
    ),
    "edges": pptx([[
        shape("in", A), shape("near", (-20_000, 0, INCH, INCH)), shape("over", (-INCH, 0, 2 * INCH, INCH)), shape("off", (20 * INCH, 0, INCH, INCH)),
        shape("corner", (9 * INCH, 4 * INCH, 2 * INCH, 2 * INCH)),
    ]]),
    "overlaps": pptx([[
        shape("a", A), shape("b", (A[0] + INCH, A[1], A[2], A[3])), shape("c", (A[0], A[1], A[2] - 1, A[3])), shape("silent", A, ""), shape("turned", A, rot=600_000), shape("far", B),
        shape("touch", (A[0], A[1] + A[3], A[2], A[3])),
    ]]),
    "twice": pptx([[shape("one", A)]], order=[1, 1]), "foreign": pptx([[shape("one", A)]], listed='<p:other id="256" r:id="rId1"/>'), "no-id": pptx([[shape("one", A)]], listed='<p:sldId r:id="rId1"/>'),
    "no-rel": pptx([[shape("one", A)]], listed='<p:sldId id="256" r:id="rId9"/>'), "no-part": pptx([[shape("one", A)]], changed={"ppt/slides/slide1.xml": None}),
    "other-root": pptx([[shape("one", A)]], changed={"ppt/slides/slide1.xml": tree("sldLayout")}), "no-list": pptx([], changed={"ppt/presentation.xml": f"<p:presentation {NS}/>"}),
    "other-kind": pptx([[shape("one", A)]], changed={"ppt/_rels/presentation.xml.rels": rels(("rId1", "slideLayout", "slides/slide1.xml"))}),
    "no-presentation": pptx([], changed={"ppt/presentation.xml": None}),
    "same-part": pptx([[shape("one", A)]], listed='<p:sldId id="256" r:id="rId1"/><p:sldId id="257" r:id="rId2"/>', changed={"ppt/_rels/presentation.xml.rels": rels(("rId1", "slide", "slides/slide1.xml"), ("rId2", "slide", "slides/slide1.xml"))}),
    "escaped": pptx([[shape("one", A)]], changed={"ppt/_rels/presentation.xml.rels": rels(("rId1", "slide", "/ppt/slides/sl%69de1.xml"))}),
}


@pytest.fixture(scope="module")
def read(spark):
    packages = spark.createDataFrame([(k, bytearray(v)) for k, v in DECKS.items()], "doc string, content binary")
    f = document_rules.facts(packages)
    deck = decks.read(f)
    shapes = {(r["doc"], r["name"]): r for r in deck.shapes.collect()}
    listed = {}
    for r in deck.slides.orderBy("doc", "slide").collect():
        listed.setdefault(r["doc"], []).append(r["part"].rsplit("/", 1)[1])
    return shapes, listed, {r["doc"]: r["message"] for r in deck.failed.collect()}, {r["doc"]: r for r in decks.features(f, deck).collect()}


def test_slides_follow_the_list(read):
    _, listed, failed, _ = read
    assert listed["order"] == ["slide3.xml", "slide1.xml"] and listed["escaped"] == ["slide1.xml"]
    assert set(failed) == {"twice", "foreign", "no-id", "no-rel", "no-part", "other-root", "other-kind", "no-presentation", "same-part"}
    assert not set(failed) & set(listed)


def test_placeholders_inherit(read):
    box = lambda n: tuple(read[0]["inherit", n][c] for c in ("x", "y", "cx", "cy"))
    anchor = lambda n: read[0]["inherit", n]["anchor"]
    assert box("title") == A and anchor("title") == "b"
    assert box("by-index") == B and anchor("by-index") == "ctr"
    assert box("by-type") == B and anchor("by-type") == "b"  # L1 is first of its type, has no anchor; then the master's
    assert box("place-of-another") == B  # its own partner has no place
    assert box("own") == (1, 2, 3, 4) and anchor("own") == "t"
    assert box("centred") == (None,) * 4 and anchor("centred") == "ctr"  # the master's title
    assert box("none") == (None,) * 4 and anchor("none") == "t" and box("picture") == A


def test_findings(spark):
    packages = spark.createDataFrame([(k, bytearray(v)) for k, v in DECKS.items()], "doc string, content binary")
    rows = decks.check(packages).collect()
    of = lambda doc, code: {(r["where"], r["severity"]) for r in rows if r["doc"] == doc and r["code"] == code}
    assert of("edges", "PPT004") == {("slide1/over", "warn"), ("slide1/off", "info"), ("slide1/corner", "warn")}
    said = next(r["message"] for r in rows if r["where"] == "slide1/corner")
    assert "72 pt over the right edge" in said and "72 pt over the bottom edge" in said
    pairs = {(r["where"], r["subject"], r["severity"]) for r in rows if r["doc"] == "overlaps" and r["code"] == "PPT006"}
    assert pairs == {("slide1/a", "b", "error"), ("slide1/a", "c", "error"), ("slide1/b", "c", "warn")}
    assert {r["doc"] for r in rows if r["code"] == "PKG002"} >= {"twice", "no-presentation"} and not [r for r in rows if r["code"] == "INT001"]


def test_features(read):
    f = read[3]
    assert (f["order"]["slides"], f["inherit"]["plain_text_shapes"], f["overlaps"]["rotated_shapes"]) == (2, 9, 1)
    assert f["inherit"]["unread_text_shapes"] == 3 and f["overlaps"]["plain_text_shapes"] == 6


def test_overlaps_by_cells_are_those_of_all_pairs(spark):
    r = random.Random(5)
    rows = []
    for g in ("hot", "hot", "hot", "cold"):
        for _ in range(120):
            big = r.choice([3, 30, 300, 3000])
            rows.append((g, len(rows), r.randint(-500, 2000), r.randint(-500, 2000), r.randint(-1, big), r.randint(0, big)))
    rows += [("edge", 9000 + k, 64 * k, 0, 64, 64) for k in range(5)]
    want = {}
    for g, i, x, y, cx, cy in rows:
        for h, j, x2, y2, cx2, cy2 in rows:
            if g == h and i < j and min(cx, cy, cx2, cy2) > 0:
                w, t = min(x + cx, x2 + cx2) - max(x, x2), min(y + cy, y2 + cy2) - max(y, y2)
                if w > 0 and t > 0:
                    want[i, j] = w * t / min(cx * cy, cx2 * cy2)
    found = relations.rectangles_overlap(spark.createDataFrame(rows, "g string, i long, x long, y long, cx long, cy long"), ["g"], "i").collect()
    assert len(found) == len(want) and {(x["a_i"], x["b_i"]): x["share"] for x in found} == want


def test_pairs_of_few_bytes_are_many_tasks(spark):
    rows = [(f"g{k % 40}", k, k % 97, k % 50, k % 53 + 1, k % 29 + 1) for k in range(1200)]
    found = relations.rectangles_overlap(spark.createDataFrame(rows, "g string, i long, x long, y long, cx long, cy long"), ["g"], "i")
    assert found.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1
