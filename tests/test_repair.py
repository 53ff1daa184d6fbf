"""Comment threads, fresh ids and repair decisions."""

import random

import pytest
from pyspark.sql import functions as F

from quillmill.operators import forest
from quillmill.plans import document_rules, repair
from tests.packages import W, docx, marks, types

W14 = 'xmlns:w14="http://schemas.microsoft.com/office/word/2010/wordml"'
EXT = "commentsExtended.xml"


def commented(comments, parents, anchored, extra="", twice=()):
    """comments: {id: paraId}; parents: [(paraId, parent paraId)]; anchored: ids with marks."""
    body = "".join(f'<w:comment w:id="{c}" w:author="A"><w:p w14:paraId="{p}"><w:r><w:t>Note {c}</w:t></w:r></w:p></w:comment>' for c, p in [*comments.items(), *twice])
    links = "".join(f'<w15:commentEx w15:paraId="{p}"' + (f' w15:paraIdParent="{q}"' if q else "") + "/>" for p, q in parents)
    parts = {
        "word/comments.xml": f"<w:comments {W} {W14}>{body}</w:comments>",
        f"word/{EXT}": f'<w15:commentsEx xmlns:w15="http://schemas.microsoft.com/office/word/2012/wordml">{links}</w15:commentsEx>',
    }
    package = docx("".join(marks(i) for i in anchored) + extra, parts)
    import io
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(package)) as old, zipfile.ZipFile(out, "w") as new:
        for n in old.namelist():
            data = old.read(n)
            if n == "word/_rels/document.xml.rels":
                data = data.replace(b"</Relationships>", f'<Relationship Id="rId9" Type="{repair.EXTENDED}" Target="{EXT}"/></Relationships>'.encode())
            new.writestr(n, data)
    return out.getvalue()


CASES = {
    "reply": (commented({"0": "A0", "1": "A1"}, [("A0", ""), ("A1", "A0")], ["0"]), ("add", "0")),
    "lower-case-link": (commented({"0": "a0", "1": "A1"}, [("A0", ""), ("a1", "a0")], ["0"]), ("add", "0")),
    "top-level": (commented({"0": "A0", "1": "A1"}, [("A0", ""), ("A1", "")], ["0"]), ("refuse", "no reply")),
    "reply-of-a-reply": (commented({"0": "A0", "2": "A2", "1": "A1"}, [("A0", ""), ("A2", "A0"), ("A1", "A2")], ["0", "2"]), ("refuse", "a reply itself")),
    "own-parent": (commented({"0": "A0", "1": "A1"}, [("A0", ""), ("A1", "A1")], ["0"]), ("refuse", "a reply itself")),
    "parent-lost": (commented({"0": "A0", "1": "A1"}, [("A0", ""), ("A1", "A0")], ["0", "0"]), ("refuse", "anchored once")),
    "two-parents": (commented({"0": "A0", "3": "A0", "1": "A1"}, [("A0", ""), ("A1", "A0")], ["0", "3"]), ("refuse", "doesn't name one")),
    "described-twice": (commented({"0": "A0", "1": "A1"}, [("A1", "A0"), ("A1", "A0")], ["0"]), ("refuse", "more than once")),
    "defined-twice": (commented({"0": "A0", "1": "A1"}, [("A1", "A0")], ["0"], twice=[("1", "A7")]), ("refuse", "several comments have this id")),
    "sibling-astray": (commented({"0": "A0", "1": "A1", "2": "A2"}, [("A1", "A0"), ("A2", "A0")], ["0"], extra=marks("2", end=False)), ("refuse", "reply 2")),
    "not-linked": (docx(parts={"word/comments.xml": f'<w:comments {W} {W14}><w:comment w:id="1"><w:p w14:paraId="A1"/></w:comment></w:comments>'}), ("refuse", "no single part")),
}


@pytest.fixture(scope="module")
def found(spark):
    rows = spark.createDataFrame([(k, bytearray(v)) for k, (v, _) in CASES.items()], "doc string, content binary")
    f = document_rules.facts(rows)
    targets = spark.createDataFrame([(k, "1") for k in CASES], "doc string, subject string")
    return {r["doc"]: r for r in repair.reply_anchors(f, targets).collect()}


@pytest.mark.parametrize("name", sorted(CASES))
def test_reply(found, name):
    r, (action, text) = found[name], CASES[name][1]
    assert r["action"] == action
    assert r["new"] == text and r["part"] == "word/document.xml" if action == "add" else text in r["reason"]


def test_forest_is_that_of_walks(spark):
    r = random.Random(1)
    rows = []
    for d in range(6):
        for n in range(400):
            up = None if n % 50 == 0 else r.choice([n - 1, n - 1, r.randint(0, n), n + r.randint(0, 3), 900])
            rows.append((d if d else None, n, up))
    rows += [(2, 7, 3), (2, 8, None), (None, None, 4)]
    by = {}
    for d, n, up in rows:
        by.setdefault((d, n), []).append(up)
    chain = [(9, k, k - 1 if k else None) for k in range(1000)]
    table = spark.createDataFrame([x for x in rows if x[0] is not None] + chain, "d int, node int, parent int").repartition(4)
    got = {(x["d"], x["node"]): x for x in forest.rooted(table, ["d"]).collect()}

    def kind(d, n):
        ups = by[d, n]
        if len(ups) > 1 or (ups[0] is not None and len(by.get((d, ups[0]), [])) > 1):
            return "unclear"
        return "top" if ups[0] is None else "orphan" if (d, ups[0]) not in by else "below"

    for (d, n), ups in by.items():
        if d is None or n is None:
            continue
        at, depth, seen = n, 0, set()
        while kind(d, at) == "below" and at not in seen:
            seen.add(at)
            at, depth = by[d, at][0], depth + 1
        x = got[d, n]
        if kind(d, at) == "below":
            assert (x["state"], x["root"], x["depth"]) == ("cycle", None, None)
        else:
            assert (x["state"], x["root"], x["depth"]) == (kind(d, n), at, depth), (d, n)
    assert all((got[9, k]["root"], got[9, k]["depth"]) == (0, k) for k in range(1000))


def test_fresh_ids_have_no_gaps(spark):
    r = random.Random(6)
    rows = [(r.choice(["hot", "hot", "cold"]), k, str(r.choice(["x", *range(1, 40)]))) for k in range(500)]
    top = spark.createDataFrame([("cold", 1000)], "g string, top long")
    got = forest.fresh_ids(spark.createDataFrame(rows, "g string, o long, i string").repartition(5), ["g"], "i", [F.col("o")], top).collect()
    seen, nxt = set(), {"hot": 39, "cold": 1000}
    want = {}
    for g, o, i in sorted(rows, key=lambda x: x[1]):
        want[o] = None
        if (g, i) in seen:
            nxt[g] += 1
            want[o] = nxt[g]
        seen.add((g, i))
    assert max(int(i) for g, _, i in rows if g == "hot" and i != "x") == 39
    assert {x["o"]: x["fresh"] for x in got} == want


def test_revision_ids_and_content_types(spark):
    change = '<w:ins w:id="{}" w:author="A" w:date="2024-01-01T00:00:00Z"><w:r><w:t>x</w:t></w:r></w:ins>'.format
    repeated = docx("<w:p>" + "".join(map(change, (4, 4, 7, 4, 7))) + "</w:p>", {"word/comments.xml": f'<w:comments {W}><w:comment w:id="30"/></w:comments>'})
    wrong = docx(parts={"[Content_Types].xml": types(("/word/document.xml", document_rules.WORD + "document.main+xml"), ("/word/styles.xml", "application/xml"))})
    packages = spark.createDataFrame([("r", bytearray(repeated)), ("t", bytearray(wrong))], "doc string, content binary")
    f = document_rules.facts(packages)
    findings = document_rules.check(packages)
    got = repair.decisions(f, findings).collect()
    assert sorted((r["old"], r["new"]) for r in got if r["rule"] == "renumber-revisions") == [("4", "31"), ("4", "32"), ("7", "33")]
    assert {(r["subject"], r["action"], r["new"]) for r in got if r["rule"] == "content-type" and r["doc"] == "t"} >= {("word/styles.xml", "change", document_rules.WORD + "styles+xml")}
    none = repair.revision_ids(f, spark.createDataFrame([("r", "99")], "doc string, subject string")).collect()
    assert [(r["action"], r["reason"]) for r in none] == [("refuse", "no repeated use")]


def test_verified(spark):
    schema = "doc string, code string, severity string, part string, where string, subject string"
    row = lambda d, c, s="1": (d, c, "error", None, None, s)
    before = spark.createDataFrame([row("a", "X"), row("a", "Y"), row("b", "X"), row("b", "X"), row("c", "X"), row("d", "X"), row("d", "Y")], schema)
    after = spark.createDataFrame([row("a", "Y"), row("b", "X"), row("b", "X"), row("c", "Z")], schema)
    targets = spark.createDataFrame([row("a", "X"), row("b", "X"), row("c", "X"), row("d", "X")], schema)
    got = {r["doc"]: tuple(r)[1:] for r in repair.verified(before, after, targets).collect()}
    assert got == {"a": (True, 0, 0, 0), "b": (False, 1, 0, 0), "c": (False, 0, 1, 0), "d": (False, 0, 0, 1)}
