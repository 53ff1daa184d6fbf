"""Tracked changes, fields and bookmarks: pairs of packages with one difference each."""

import random

import pytest
from pyspark.sql import functions as F

from quillmill.operators import budget, scan
from quillmill.plans import comparison, references
from quillmill.sources import packages
from tests.packages import W, docx

P = "<w:p>{}</w:p>".format
R = "<w:r><w:t xml:space='preserve'>{}</w:t></w:r>".format
TEXT = "".join(P(R(f"Paragraph number {k} with some words.")) for k in range(12))
DATE = "2024-01-01T00:00:00Z"


def ins(text, author="Ann", date=DATE, i=1, inner=R):
    return f'<w:ins w:id="{i}" w:author="{author}" w:date="{date}">{inner(text)}</w:ins>'


def gone(text, author="Ann", date=DATE, i=1):
    return f'<w:del w:id="{i}" w:author="{author}" w:date="{date}"><w:r><w:delText xml:space="preserve">{text}</w:delText></w:r></w:del>'


def bold(text):
    return f"<w:r><w:rPr><w:b/></w:rPr><w:t>{text}</w:t></w:r>"


CHAR = '<w:r><w:fldChar w:fldCharType="{}"/></w:r>'.format
READ = "<w:r><w:instrText>{}</w:instrText></w:r>".format
BOOK = '<w:bookmarkStart w:id="{0}" w:name="{1}"/><w:bookmarkEnd w:id="{0}"/>'.format
SIMPLE = '<w:fldSimple w:instr="{}"/>'.format


def field(*parts, result="shown"):
    return CHAR("begin") + "".join(READ(p) if not p.startswith("<") else p for p in parts) + CHAR("separate") + R(result) + CHAR("end")


def doc(*body):
    return docx(TEXT + "".join(body))


def noted(*notes):
    body = "".join(f'<w:footnote w:id="{k}"><w:p>{n}</w:p></w:footnote>' for k, n in enumerate(notes))
    return docx(TEXT, {"word/footnotes.xml": f"<w:footnotes {W}>{body}</w:footnotes>"}, [("rId7", "footnotes", "footnotes.xml")])


LONG = "the tenant shall pay the landlord on the first day of each month"
CASES = {
    # FID009
    "payload-changed": (doc(P(ins("alpha"))), doc(P(ins("beta"))), {"FID009"}),
    "payload-deleted-text-changed": (doc(P(gone("alpha"))), doc(P(gone("beta"))), {"FID009"}),
    "payload-moved-bounds": (doc(P(ins("ab") + R("x") + ins("cd"))), doc(P(ins("a") + R("x") + ins("bcd"))), set()),
    "payload-one-of-two": (doc(P(ins("same") + R("x") + ins("same"))), doc(P(ins("same") + R("x") + ins("other"))), {"FID009"}),
    "payload-unsupported": (doc(P(ins("alpha"))), doc(P(ins("beta", inner=lambda t: f"<w:r><w:t>{t}</w:t><w:tab/></w:r>"))), set()),
    # FID001 and its witness
    "joined": (doc(P(ins("one ", i=1) + ins("two", i=2))), doc(P(ins("one two", i=9))), set()),
    "joined-runs": (doc(P(ins("one ", i=1) + ins("two", i=2) + R("x"))), doc(P(ins("", i=9, inner=lambda _: R("one t") + R("wo")) + R("x"))), set()),
    "joined-other-author": (doc(P(ins("one ") + ins("two"))), doc(P(ins("one two", "Bob"))), {"FID001", "FID012"}),
    "joined-other-text": (doc(P(ins("one ") + ins("two"))), doc(P(ins("one twX"))), {"FID001"}),
    "joined-other-look": (doc(P(ins("one ") + ins("two"))), doc(P(ins("one two", inner=bold))), {"FID001"}),
    "joined-elsewhere": (doc(P(ins("one ") + ins("two")) + P(R("x"))), doc(P(R("x")) + P(ins("one two"))), {"FID001"}),
    "joined-with-a-tab": (doc(P(ins("one ") + ins("two") + "<w:r><w:tab/></w:r>")), doc(P(ins("one two") + "<w:r><w:tab/></w:r>")), {"FID001"}),
    # FID010
    "note-loses-revision": (noted(ins("words")), noted(R("words")), {"FID010"}),
    "note-keeps-one": (noted(ins("wor") + ins("ds")), noted(ins("wor") + R("ds")), set()),
    "note-text-changes": (noted(ins("words")), noted(R("other words")), {"FID005"}),
    # FID011
    "grown": (doc(P(ins("abc"))), doc(P(ins("abcd"))), {"FID011"}),
    "grown-inside": (doc(P(ins("abc"))), doc(P(ins("axbc"))), {"FID009", "FID011"}),
    "grown-under-its-own": (doc(P(ins("abc"))), doc(P(ins("abc") + ins("d", "Bob"))), {"FID002", "FID012"}),
    "grown-and-struck": (doc(P(ins("abc"))), doc(P(ins("abc", inner=lambda t: gone(t, "Bob")))), {"FID012"}),
    "not-grown-but-lost": (doc(P(ins("abc"))), doc(P(ins("abd"))), {"FID009"}),
    "grown-without-date": (doc(P('<w:ins w:id="1" w:author="A"><w:r><w:t>abc</w:t></w:r></w:ins>')), doc(P('<w:ins w:id="1" w:author="A"><w:r><w:t>abcd</w:t></w:r></w:ins>')), set()),
    # FID013
    "wide": (doc(P(R(LONG))), doc(P(gone(LONG) + ins(LONG.replace("first", "last")))), {"FID013", "FID012"}),
    "narrow": (doc(P(R(LONG))), doc(P(R("the tenant shall pay the landlord on the ") + gone("first") + ins("last") + R(" day of each month"))), {"FID012"}),
    "rewritten": (doc(P(R(LONG))), doc(P(gone(LONG) + ins("the tenant shall pay what was agreed with the owner of that house by any means")), ), {"FID012"}),
    "wide-by-two": (doc(P(R(LONG))), doc(P(gone(LONG) + ins(LONG.replace("first", "last"), "Bob"))), {"FID012"}),
    "wide-before": (doc(P(gone(LONG) + ins(LONG.replace("first", "last")))), doc(P(gone(LONG) + ins(LONG.replace("first", "last")))), set()),
    # FID015
    "bookmark-kept": (doc(P(BOOK(1, "a"))), doc(P(BOOK(1, "A"))), set()),
    "bookmark-unused": (doc(P(BOOK(1, "a"))), doc(P(R("x"))), {("FID015", "warn", "nothing")}),
    "bookmark-hidden": (doc(P(BOOK(1, "_a"))), doc(P(R("x"))), set()),
    "bookmark-of-a-field": (doc(P(BOOK(1, "a") + field(" REF a "))), doc(P(field(' ref "A" \\h '))), {("FID015", "error", "fields")}),
    "bookmark-of-a-link": (doc(P(BOOK(1, "_a") + '<w:hyperlink w:anchor="_A"/>')), doc(P('<w:hyperlink w:anchor="_A"/>')), {("FID015", "warn", "links")}),
    "bookmark-of-a-link-field": (doc(P(BOOK(1, "a") + field('HYPERLINK \\l "a"'))), doc(P(field('HYPERLINK \\l "a"'))), {("FID015", "warn", "links")}),
    # FID016
    "field-gone": (doc(P(field("PAGE"))), doc(P(R("shown"))), {("FID016", "error", "PAGE")}),
    "one-field-of-two": (doc(P(field("PAGE") + field("page"))), doc(P(field("PAGE"))), {("FID016", "warn", "PAGE")}),
    "reference-elsewhere": (doc(P(field("REF a") + field("REF b"))), doc(P(field("REF a") + field("REF a"))), {("FID016", "error", "REF")}),
    "simple-for-complex": (doc(P(field(" DATE ", "\\@ x"))), doc(P(SIMPLE("DATE \\@ x"))), set()),
    "derived-do-not-count": (doc(P(CHAR("begin") + READ("TOC") + CHAR("separate") + field("PAGEREF a") + CHAR("end"))), doc(P(field("TOC"))), set()),
    "link-field-becomes-link": (doc(P(field('HYPERLINK "http://x"'))), doc(P("<w:hyperlink/>")), set()),
    "formula": (doc(P(field("=SUM(ABOVE)"))), doc(P(R("3"))), {("FID016", "error", "=")}),
}


@pytest.fixture(scope="module")
def findings(spark):
    pairs = spark.createDataFrame([(k, bytearray(a), bytearray(b)) for k, (a, b, _) in CASES.items()], "pair string, source binary, edited binary")
    return comparison.compare(pairs).collect()


@pytest.mark.parametrize("name", sorted(CASES))
def test_pair(findings, name):
    mine = [r for r in findings if r["doc"] == name and r["code"] != "FID014"]
    want = CASES[name][2]
    whole = {x for x in want if isinstance(x, tuple)}
    assert {r["code"] for r in mine} == {x[0] if isinstance(x, tuple) else x for x in want}, mine
    assert whole <= {(r["code"], r["severity"], r["subject"]) for r in mine}


def test_fields_nested_unclosed_and_stray(spark):
    body = P(
        CHAR("end") + READ("lost") + CHAR("separate")  # nothing is open
        + CHAR("begin") + READ(" IF ") + field("REF inner", result=field("PAGE")) + READ(" = 1 ") + CHAR("separate") + field("NUMPAGES") + SIMPLE("DATE") + READ("late") + CHAR("separate") + CHAR("end")
        + CHAR("begin") + READ("AUTHOR") + CHAR("begin") + READ("  ") + CHAR("end")
    )
    nodes = packages.nodes(packages.members(spark.createDataFrame([("d", bytearray(docx(body)))], "doc string, content binary")))
    got = [(r["kind"], r["instruction"], r["derived"]) for r in references.fields(nodes).orderBy("id").collect()]
    assert got == [("IF", "IF = 1", False), ("REF", "REF inner", False), ("PAGE", "PAGE", True), ("NUMPAGES", "NUMPAGES", True), ("DATE", "DATE", True), ("AUTHOR", "AUTHOR", False)]


def stack(marks):
    out, open_ = [], []
    for n, m in enumerate(marks, 1):
        if m == "begin":
            open_.append(n)
        out.append((n, len(open_), open_[-1] if open_ else None))
        if m == "end" and open_:
            open_.pop()
    return out


def test_brackets_are_those_of_a_stack(spark):
    r = random.Random(4)
    marks = {k: [r.choice(["begin", "end", "end" if k % 2 else "begin", "x"]) for _ in range(r.randint(0, 300))] for k in range(12)}
    rows = [(None if k == 3 else k, n * 7, m) for k, v in marks.items() for n, m in enumerate(v)]
    df = spark.createDataFrame(rows, "k long, at long, m string").repartition(5)
    got = scan.brackets(df, ["k"], [F.col("at")], F.col("m")).collect()
    for k, v in marks.items():
        mine = sorted((x["n"], x["level"], x["owner"]) for x in got if x["k"] == (None if k == 3 else k))
        assert mine == stack(v)


def test_scans_over_several_ranges_of_a_key(spark):
    r = random.Random(9)
    rows = [(r.choice(["hot", "hot", "cold", None]), k, r.choice([None, 1, 2, 3]), r.choice("ab")) for k in range(900)]
    df = spark.createDataFrame(rows, "g string, o long, v long, s string").repartition(6)
    by, total, last, run, want = {}, {}, {}, {}, {}
    for g, o, v, s in sorted(rows, key=lambda x: x[1]):
        by[g] = by.get(g, 0) + 1
        total[g] = total.get(g) if v is None else (total.get(g) or 0) + v
        last[g] = last.get(g) if v is None else v
        before = run.get(g, (0, object()))
        run[g] = (before[0] + (before[1] != s), s)
        want[o] = (by[g], total[g], last[g], run[g][0])
    key, order = ["g"], [F.col("o")]
    tables = [scan.numbered(df, key, order, "x", 50), scan.running_total(df, key, order, F.col("v"), "x"), scan.carry_forward(df, key, order, F.col("v"), "x"), scan.islands(df, key, order, "s").withColumnRenamed("run", "x")]
    for k, table in enumerate(tables):
        assert {r["o"]: r["x"] for r in table.collect()} == {o: w[k] for o, w in want.items()}


def test_budget_passes_over_what_does_not_fit(spark):
    r = random.Random(2)
    rows = [(d, k, r.randint(0, 30)) for d in range(20) for k in range(r.randint(1, 40))]
    want = {}
    for d in range(20):
        left = 100
        for _, k, c in sorted(x for x in rows if x[0] == d):
            want[d, k] = c <= left
            left -= c if c <= left else 0
    got = budget.within_budget(spark.createDataFrame(rows, "d int, k int, c int"), ["d"], ["k"], "c", 100).collect()
    assert {(x["d"], x["k"]): x["taken"] for x in got} == want


def test_surplus(spark):
    rows = [(list("abc"), list("axbbcx")), ([], list("ab")), (list("ab"), list("ba")), (["a", None], [None, "a", None]), (list("ab"), [])]
    df = spark.createDataFrame(rows, "w array<string>, g array<string>")
    got = [tuple(r["s"]) for r in df.select(budget.surplus(F.col("w"), F.col("g")).alias("s")).collect()]
    assert got == [(True, ["x", "b", "x"]), (True, ["a", "b"]), (False, ["b"]), (True, [None]), (False, [])]
