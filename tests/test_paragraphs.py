"""Paragraph changes: what is told of an edit rebuilds it."""

import random

from quillmill.operators.matching import _rising
from quillmill.plans import comparison

SCHEMA = "doc string, story string, side string, number int, current string, original string"


def changes(spark, pairs):
    rows = [(d, "document", side, k, x, x) for d, sides in pairs.items() for side, texts in zip("se", sides) for k, x in enumerate(texts, 1)]
    out = {d: [] for d in pairs}
    for r in comparison.diff_paragraphs(spark.createDataFrame(rows, SCHEMA)).collect():
        out[r["doc"]].append((r["change"], r["number"], r["before"], r["after"]))
    return {d: sorted(v) for d, v in out.items()}


def test_changes(spark):
    pairs = {
        "same": ("abc", "abc"), "changed": ("abc", "axc"), "added": ("abc", "abxc"), "removed": ("abc", "ac"), "moved": ("abcd", "bcda"), "repeats": ("axxb", "axb"),
        "swapped": ("ab", "ba"), "rewritten": ("abc", "xy"), "from-nothing": ("", "ab"), "to-nothing": ("ab", ""),
    }
    got = changes(spark, {d: (list(a), list(b)) for d, (a, b) in pairs.items()})
    assert got["same"] == [] and got["changed"] == [("changed", 2, "b", "x")] and got["added"] == [("added", 3, "", "x")] and got["removed"] == [("removed", 2, "b", "")]
    assert got["moved"] == [("added", 4, "", "a"), ("removed", 1, "a", "")] and got["repeats"] == [("removed", 3, "x", "")]
    assert got["from-nothing"] == [("added", 1, "", "a"), ("added", 2, "", "b")] and got["to-nothing"] == [("removed", 1, "a", ""), ("removed", 2, "b", "")]
    assert len(got["swapped"]) == 2 and len(got["rewritten"]) == 5


def test_changes_rebuild_the_edit(spark):
    r = random.Random(8)
    pairs = {}
    for d in range(60):
        old = [r.choice("abcdefgh") + str(r.randint(0, 9)) for _ in range(r.randint(0, 40))]
        new = list(old)
        for _ in range(r.randint(0, 12)):
            at = r.randint(0, len(new))
            kind = r.randrange(3)
            new[at : at + (kind != 0)] = [] if kind == 1 else [f"n{r.randint(0, 20)}"]
        pairs[str(d)] = (old, new)
    for d, found in changes(spark, pairs).items():
        old, new = pairs[d]
        gone = {n for c, n, *_ in found if c == "removed"}
        put = {n: after for c, n, _, after in found if c in ("added", "changed")}
        assert all(new[n - 1] == x for n, x in put.items()) and all(old[n - 1] == b for c, n, b, _ in found if c == "removed")
        kept_old, kept_new = [x for k, x in enumerate(old, 1) if k not in gone], [x for k, x in enumerate(new, 1) if k not in put]
        before = [b for c, _, b, _ in found if c == "changed"]
        for b in before:
            kept_old.remove(b)
        assert sorted(kept_old) == sorted(kept_new)  # the same paragraphs stay
        assert len(found) <= max(len(old) + len(new), 0) and (found or old == new)


def test_rising():
    r = random.Random(2)
    for _ in range(300):
        v = r.sample(range(12), r.randint(0, 9))
        best = max((m for m in range(1 << len(v)) if (lambda w: all(a < b for a, b in zip(w, w[1:])))([x for k, x in enumerate(v) if m >> k & 1])), key=lambda m: bin(m).count("1"), default=0)
        got = [v[k] for k in _rising(v)]
        assert got == sorted(got) and len(got) == bin(best).count("1")
