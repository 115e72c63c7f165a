"""The command line over a small tree."""

import json

import pytest

from glintsieve.__main__ import main


@pytest.fixture
def project(tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p/a.py").write_text("eval(x)\nroll = random.random()\n")
    (tmp_path / "p/b.js").write_text("var a = Math.random();\n")
    return tmp_path


def test_reports_and_exit_codes(spark, project, capsys):
    path = str(project / "p")
    assert main(["scan", path, "--fail-on", "high"]) == 1
    text = capsys.readouterr().out
    assert text.startswith("3 finding(s), 2 file(s) scanned, complete: true\n[HIGH] SR004 a.py:1 (ast/candidate)\n") and text.count("SR009") == 2
    assert main(["scan", path, "--format", "json"]) == 0
    found = json.loads(capsys.readouterr().out)
    assert [(x["path"], x["line"], x["rule_id"]) for x in found["findings"]] == [("a.py", 1, "SR004"), ("a.py", 2, "SR009"), ("b.js", 1, "SR009")] and found["summary"]["complete"]
    assert main(["scan", path, "--format", "sarif"]) == 0
    assert len(json.loads(capsys.readouterr().out)["runs"][0]["results"]) == 3
    assert main(["scan", path, "--format", "quality"]) == 0
    assert len(json.loads(capsys.readouterr().out)) == 3
    assert main(["scan", str(project / "none")]) == 2


def test_baseline_and_errors(spark, project, capsys):
    path, baseline = str(project / "p"), str(project / "baseline")
    assert main(["scan", path, "--format", "quiet", "--write-baseline", baseline]) == 0
    assert main(["scan", path, "--format", "quiet", "--baseline", baseline, "--fail-on", "info"]) == 0
    assert capsys.readouterr().out.splitlines()[-1] == "0 new of 3; complete: true"
    assert main(["scan", path, "--write-baseline", baseline]) == 2  # it is there already
    (project / "p/.gitignore").write_text("!a\\\\b\n")
    assert main(["scan", path, "--format", "quiet"]) == 3


def test_settings_rules_and_templates(spark, project, capsys):
    path = project / "p"
    (path / ".glintsieve.toml").write_text('disabled = ["SR009"]\nfail_on = "high"\n')
    assert main(["scan", str(path), "--format", "quiet"]) == 1
    assert capsys.readouterr().out == "1 new of 3; complete: true\n"
    assert main(["rules"]) == 0 and capsys.readouterr().out.count("\n") == 22
    assert main(["init", str(path)]) == 0 and (path / ".github/workflows/glintsieve.yml").exists()
    assert 'disabled = ["SR009"]' in (path / ".glintsieve.toml").read_text()
