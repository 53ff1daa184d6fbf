"""The command line over files in a folder."""

import json

from quillmill.__main__ import main
from quillmill.plans import document_rules, policy
from tests.packages import docx

SCHEMA = "doc string, code string, severity string, `where` string, part string, subject string, message string"


def test_check_and_compare(spark, tmp_path, capsys):
    good, bad = tmp_path / "good.docx", tmp_path / "bad.docx"
    good.write_bytes(docx())
    bad.write_bytes(docx("<w:p><w:r><w:t>Text</w:t></w:r></w:p><w:tbl/>"))
    assert main(["check", f"{tmp_path}/*.docx", "--format", "json"], spark) == 1
    report = json.loads(capsys.readouterr().out)
    assert report["file"].endswith("bad.docx") and [f["code"] for f in report["findings"]] == ["TBL001"]
    base, config = tmp_path / "base.json", tmp_path / "policy.toml"
    key = policy.make_baseline(document_rules.ranked(spark.createDataFrame([(f"file:{bad}", "TBL001", "error", "w:tbl#5", "word/document.xml", None, "m")], SCHEMA)))
    base.write_text(policy.baseline_json(key))
    config.write_text('[severity]\nFID001 = "off"\n')
    assert main(["compare", str(bad), str(good), "--config", str(config), "--baseline", str(base), "--format", "sarif"], spark) == 0
    assert "suppressions" in capsys.readouterr().out


def test_against_pairs_coverage_and_decks(spark, tmp_path, capsys):
    from tests.test_decks import DECKS

    paths = {k: tmp_path / k for k in ("old.docx", "new.docx", "deck.pptx", "list.csv")}
    paths["old.docx"].write_bytes(docx("<w:p><w:r><w:t>Text</w:t></w:r></w:p><w:tbl/>"))
    paths["new.docx"].write_bytes(docx("<w:p><w:r><w:t>Text</w:t></w:r></w:p><w:tbl/><w:sdt/>"))
    paths["deck.pptx"].write_bytes(DECKS["overlaps"])
    paths["list.csv"].write_text(f"source,edited\n{paths['old.docx']},{paths['new.docx']}\n{paths['new.docx']},{paths['old.docx']}\n")
    new = str(paths["new.docx"])
    assert main(["check", new, "--against", str(paths["old.docx"]), "--format", "json"], spark) == 1
    codes = {f["code"] for f in json.loads(capsys.readouterr().out)["findings"]}
    assert codes == {"SDT001", "SDT002"}
    assert main(["compare", "--pairs", str(paths["list.csv"])], spark) == 1
    assert [line for line in capsys.readouterr().out.splitlines() if "FID001" in line and "content controls" in line]
    assert main(["check", f"{tmp_path}/*.*x", "--coverage"], spark) == 1
    said = capsys.readouterr().out
    assert "PPT006" in said and "docx.tables  checked" in said and "TBL001" in said
    assert main(["compare", new], spark) == 2 and main(["check", new, new, "--against", new], spark) == 2


def test_wrong_usage(tmp_path):
    config = tmp_path / "policy.toml"
    config.write_text("colour = 1")
    assert main(["check"]) == 2 and main(["check", "a", "--config", str(config)]) == 2 and main(["check", "a", "--expect", ":x"]) == 2
