"""ZIP packages by ranges: preflight, budgets, projection, and the data source."""

import io
import random
import struct
import zipfile

import pytest

from quillmill import __main__ as command
from quillmill.sources import archive, packages
from quillmill.sources.package_source import Ranges, found, rows
from tests.packages import docx


def made(files, method=zipfile.ZIP_DEFLATED, comment=b""):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        for name, data in files.items():
            z.writestr(zipfile.ZipInfo(name, (2020, 1, 1, 0, 0, 0)), data, method)
        z.comment = comment
    return out.getvalue()


def read_of(data):
    return lambda at, n: data[at : at + n]


def told(data, **limits):
    """The code and message of a package, or its members."""
    got = list(rows("d", read_of(data), len(data), archive.Limits(**limits), None, True))
    return (got[0][9], got[0][10]) if got and got[0][1] == -1 else {r[2]: r[8] if r[9] is None else r[9] for r in got}


def patched(data, offset, fmt, value):
    """data with a field of its end record replaced."""
    at = data.rindex(b"PK\5\6") + offset
    return data[:at] + struct.pack(fmt, value) + data[at + struct.calcsize(fmt) :]


FILES = {"a.xml": b"<a/>" * 50, "word/b.xml": b"", "word/media/c.bin": bytes(range(256)) * 4, "d/": b"", "ünï.xml": b"x"}


@pytest.mark.parametrize("method", [zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED])
@pytest.mark.parametrize("comment", [b"", b"some words", b"x" * 65_535])
def test_members_are_those_that_were_written(method, comment):
    assert told(made(FILES, method, comment)) == {k: v if not k.endswith("/") else None for k, v in FILES.items()}


def test_zip64_and_streamed_members():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in FILES.items():
            if not name.endswith("/"):
                with z.open(zipfile.ZipInfo(name), "w", force_zip64=True) as f:
                    f.write(data)
    assert told(out.getvalue()) == {k: v for k, v in FILES.items() if not k.endswith("/")}


def wide(data, locator=b"", record=b""):
    """data with ZIP64 end records in front of its end record."""
    at = data.rindex(b"PK\5\6")
    _, _, here, count, length, start, _ = archive.END_REST.unpack(data[at + 4 : at + 22])
    end64 = record or archive.END64 + archive.END64_REST.pack(44, 45, 45, 0, 0, here, count, length, start)
    loc = locator or archive.LOCATOR + archive.LOCATOR_REST.pack(0, at, 1)
    end = archive.END + archive.END_REST.pack(0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    return data[:at] + end64 + loc + end


def test_zip64_end_records():
    data = made(FILES)
    at = data.rindex(b"PK\5\6")
    assert told(wide(data))["a.xml"] == FILES["a.xml"]
    _, _, here, count, length, start, _ = archive.END_REST.unpack(data[at + 4 : at + 22])
    cases = {
        "several disks": wide(data, archive.LOCATOR + archive.LOCATOR_REST.pack(0, at, 2)),
        "not where": wide(data, archive.LOCATOR + archive.LOCATOR_REST.pack(0, at - 1, 1)),
        "no ZIP64 end record": wide(data, record=b"PK\6\5" + archive.END64_REST.pack(44, 45, 45, 0, 0, here, count, length, start)),
        "is extended": wide(data, record=archive.END64 + archive.END64_REST.pack(60, 45, 45, 0, 0, here, count, length, start)),
        "span several disks": wide(data, record=archive.END64 + archive.END64_REST.pack(44, 45, 45, 1, 0, here, count, length, start)),
        "disagree": patched(wide(data), 10, "<H", count + 1),
    }
    for text, bad in cases.items():
        code, message = told(bad)
        assert code == "PKG002" and text in message, (text, message)


CASES = {
    "no end record": (b"PK\3\4 and no more", {}, "PKG002", "no end record"),
    "empty file": (b"", {}, "PKG002", "no end record"),
    "compound": (archive.COMPOUND + b"\0" * 600, {}, "PKG002", "OLE"),
    "newline after": (made(FILES) + b"\n", {}, "PKG002", "1 byte(s) after"),
    "cut comment": (made(FILES, comment=b"abc")[:-1], {}, "PKG002", "comment"),
    "disk": (patched(made(FILES), 4, "<H", 1), {}, "PKG002", "several disks"),
    "counts": (patched(made(FILES), 8, "<H", 1), {}, "PKG002", "counts disagree"),
    "more than said": (patched(patched(made(FILES), 8, "<H", 2), 10, "<H", 2), {}, "PKG002", "more entries"),
    "fewer than said": (patched(patched(made(FILES), 8, "<H", 9), 10, "<H", 9), {}, "PKG002", "entries"),
    "place": (patched(made(FILES), 16, "<L", 3), {}, "PKG002", "not where"),
    "junk before": (b"junk" + made(FILES), {}, "PKG002", "not where"),
    "archive bytes": (made(FILES), {"archive_bytes": 10}, "PKG007", "bytes, more than 10"),
    "entries": (made(FILES), {"entries": 4}, "PKG007", "5 entries"),
    "directory bytes": (made(FILES), {"directory_bytes": 99}, "PKG007", "directory"),
    "entry bytes": (made(FILES), {"entry_bytes": 1000}, "PKG007", "word/media/c.bin expands to 1024"),
    "running total": (made(FILES), {"expanded_bytes": 1100}, "PKG007", "up to word/media/c.bin"),
    "ratio": (made({"z": b"0" * 100_000}), {"ratio": 100}, "PKG007", "times"),
    "same part": (made({"A.xml": b"", "a%2Exml": b""}), {}, "PKG008", "the same part"),
    "up": (made({"x/../y": b""}), {}, "PKG008", "unsafe"), "dot": (made({"x/./y": b""}), {}, "PKG008", "unsafe"), "empty": (made({"x//y": b""}), {}, "PKG008", "unsafe"),
    "root": (made({"/x": b""}), {}, "PKG008", "unsafe"), "drive": (made({"C:/x": b""}), {}, "PKG008", "unsafe"), "back": (made({"x%5Cy": b""}), {}, "PKG008", "unsafe"),
    "half escape": (made({"x%4": b""}), {}, "PKG008", "unsafe"), "bad escape": (made({"x%FF": b""}), {}, "PKG008", "unsafe"), "nul": (made({"x%00": b""}), {}, "PKG008", "unsafe"),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_refused(name):
    data, limits, code, text = CASES[name]
    got = told(data, **limits)
    assert isinstance(got, tuple) and got[0] == code and text in got[1], got


def test_corrupt_encrypted_and_unknown_members():
    data = made({"a": b"hello " * 100, "b": b"fine"})
    first = data.index(b"PK\3\4")
    bad = bytearray(data)
    bad[first + 31 + 3] ^= 0x55
    assert told(bytes(bad)) == {"a": "PKG001", "b": b"fine"}
    entry = data.index(b"PK\1\2")
    for offset, value in ((8, 1), (10, 99)):
        odd = data[: entry + offset] + struct.pack("<H", value) + data[entry + offset + 2 :]
        assert told(odd) == {"a": "PKG002", "b": b"fine"}


def test_damaged_packages_are_rows_not_errors():
    data, r = made(FILES), random.Random(1)
    for _ in range(3000):
        bad = bytearray(data)
        for _ in range(r.randint(1, 4)):
            bad[r.randrange(len(bad))] = r.randrange(256)
        told(bytes(bad[: r.choice([len(bad), r.randrange(len(bad))])]))


def test_only_what_is_asked_for_is_read(tmp_path):
    path = tmp_path / "p.zip"
    path.write_bytes(made({f"big{k}": random.Random(k).randbytes(200_000) for k in range(20)} | {"small.xml": b"<a/>"}))
    read = Ranges(str(path))
    got = list(rows("d", read, read.size, archive.Limits(), lambda e: e.part == "small.xml", True))
    assert [r[8] for r in got] == [b"<a/>"] and read.taken < 80_000 < read.size / 40
    names = Ranges(str(path))
    assert len(list(rows("d", names, names.size, archive.Limits(), None, False))) == 21 and names.taken < 80_000


def test_source(spark, tmp_path):
    for k in range(6):
        (tmp_path / f"d{k}.docx").write_bytes(docx())
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "e.docx").write_bytes(docx())
    every = packages.opened(spark, [f"{tmp_path}/*.docx", f"file://{tmp_path}/none.docx"])
    rows_ = every.collect()
    assert {(r["code"]) for r in rows_ if r["ord"] == -1} == {"PKG002", "PKG000"} and len({r["doc"] for r in rows_}) == 8
    some = packages.opened(spark, [f"{tmp_path}/*.docx"]).where("part = 'word/styles.xml'")
    assert sorted(r["doc"].rsplit("/", 1)[1] for r in some.collect()) == [f"d{k}.docx" for k in range(6)]
    both = packages.opened(spark, [f"{tmp_path}/"], entries=100).where("part in ('word/comments.xml', '_rels/.rels') and name like 'word/%'")
    assert both.count() == 7
    names = packages.opened(spark, [f"{tmp_path}/d1.docx"], inflate="false").select("name", "data").collect()
    assert len(names) == 6 and all(r["data"] is None for r in names)
    # the same rows as from contents
    content = packages.members(packages.load(spark, [f"file://{tmp_path}/d*.docx"]))
    assert sorted((r["part"], bytes(r["data"])) for r in content.collect()) == sorted((r["part"], bytes(r["data"])) for r in rows_ if r["ord"] >= 0)


def test_patterns_without_files_are_wrong_usage(spark, tmp_path):
    with pytest.raises(ValueError, match="no file matches"):
        found(f"{tmp_path}/*.docx")
    with pytest.raises(ValueError, match="no file matches"):
        packages.load(spark, [f"file://{tmp_path}/*.docx"])
    assert command.main(["check", f"file://{tmp_path}/*.docx"], spark) == 2
