"""Files in a folder, checked in two runs of one stream."""

from quillmill.streaming import inbox
from tests.packages import docx


def test_inbox(spark, tmp_path):
    folder, out, at = tmp_path / "in", tmp_path / "out", tmp_path / "at"
    folder.mkdir()

    def run():
        inbox.watch(spark, str(folder), str(out), str(at), once=True).awaitTermination()
        return {(r["doc"].rsplit("/", 1)[-1], r["code"]) for r in spark.read.parquet(str(out)).collect()}

    (folder / "a.docx").write_bytes(docx("<w:tbl/>"))
    (folder / "notes.txt").write_bytes(b"no package")
    assert run() == {("a.docx", "TBL001")}
    (folder / "b.docx").write_bytes(b"broken")
    assert run() == {("a.docx", "TBL001"), ("b.docx", "PKG002")}
