import os

import pytest

from glintsieve.sinks import files
from glintsieve.sources import settings, tree


def test_tree_prunes_links_and_ignored_folders(spark, tmp_path):
    for name, text in {"a.py": "eval(x)", "b.pyc": "", "node_modules/x.js": "", "sub/c.py": "", "sub/skip.py": "", "sub/.gitignore": "skip.py\n", ".env": "A=b"}.items():
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True, parents=True)
        path.write_text(text)
    os.symlink(tmp_path / "a.py", tmp_path / "link.py")
    tree.register(spark)
    rows = {r.path: r for r in spark.read.format("source_tree").option("excludes", "*.pyc").load(str(tmp_path)).collect()}
    assert set(rows) == {"a.py", "b.pyc", "sub/c.py", "sub/skip.py", "sub/.gitignore", ".env", "link.py"}
    assert rows["link.py"].is_symlink and rows["b.pyc"].excluded and rows["sub/skip.py"].excluded and bytes(rows["a.py"].content) == b"eval(x)"
    small = spark.read.format("source_tree").option("max_file_bytes", "3").load(str(tmp_path)).filter("path = 'a.py'").first()
    assert small.content is None and small.error == "too large"


def _made(folder, files):
    for name, text in files.items():
        path = folder / name
        path.parent.mkdir(exist_ok=True, parents=True)
        path.write_bytes(text if isinstance(text, bytes) else text.encode())


def test_every_cap_of_the_tree_is_an_error_row(spark, tmp_path):
    _made(tmp_path, {"ok/.gitignore": "*.log\n", "ok/a.log": "", "ok/b.py": "x", "many/a.py": "1", "many/b.py": "2", "many/c.py": "3", "large/.gitignore": "#" * (65 << 10), "large/a.py": "", "bad/.gitignore": "!a\\b\n", "bad/a.py": "", "odd/.gitignore": "a\\b\n", "odd/a.py": b"\xff"})
    rows = tree.load(spark, str(tmp_path), max_entries=2)
    errors = {r.path: r.error for r in rows.filter("error is not null").collect()}
    assert set(errors) == {"many/c.py", "ok/b.py", "large/.gitignore", "bad/.gitignore"} | {x for x in errors if x.count("/") == 0}
    assert "more than 2 entries" in errors["many/c.py"] and errors["large/.gitignore"] == "ignore file too large"
    assert [(r.path, "not supported" in r.note) for r in rows.filter("note is not null").collect()] == [("odd/.gitignore", True)]
    assert tree.summary(rows).first().complete is False
    whole = tree.summary(tree.load(spark, str(tmp_path))).first()
    assert (whole.files, whole.excluded_files, whole.n_errors, whole.complete) == (11, 1, 3, False)
    assert whole.errors == ["bad/.gitignore: ignore file: line 1: an exception that is not supported may hide files", "large/.gitignore: ignore file too large", "odd/a.py: no UTF-8"]


def test_one_more_entry_than_the_default_cap(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tree, "MAX_ENTRIES", 1000)
    for k in range(1001):
        (tmp_path / f"f{k:04d}.py").touch()
    rows = tree.load(spark, str(tmp_path), max_entries=1000)
    assert rows.filter("error is null").count() == 1000 and rows.filter("error is not null").first().path == "f1000.py"
    assert not tree.summary(rows).first().complete
    assert tree.summary(tree.load(spark, str(tmp_path), max_entries=1001)).first().complete


def test_subtrees_and_filters(spark, tmp_path):
    names = {f"d{a}/e{b}/f{c}.py": f"{a}{b}{c}" for a in range(4) for b in range(3) for c in range(2)}
    _made(tmp_path, names)
    for subtrees in (1, 3, 10, 1000):
        rows = tree.load(spark, str(tmp_path), subtrees=subtrees)
        assert sorted(r.path for r in rows.collect()) == sorted(names)
    tree.register(spark)
    reader = tree.TreeReader({"path": str(tmp_path)})
    from pyspark.sql.datasource import StringStartsWith

    assert len(list(reader.pushFilters([StringStartsWith(("path",), "d1/e2")]))) == 1
    assert [p.path for p in reader.partitions()] == ["", "d1", "d1/e2"]
    found = tree.load(spark, str(tmp_path)).filter("startswith(path, 'd1/e') and path != 'd1/e0/f0.py'")
    assert sorted(r.path for r in found.collect()) == sorted(n for n in names if n.startswith("d1/e") and n != "d1/e0/f0.py")
    one = tree.load(spark, str(tmp_path / "d1/e2/f0.py")).collect()
    assert [(r.path, bytes(r.content)) for r in one] == [("f0.py", b"120")]


def test_new_files_only(tmp_path):
    path = str(tmp_path / "r")
    files.write_new(path, "x")
    assert os.stat(path).st_mode & 0o777 == 0o600
    with pytest.raises(FileExistsError):
        files.write_new(path, "y")
    assert files.write_cases(str(tmp_path / "cases"), [("A", "{}"), ("B", "{}")]) == 2
    with pytest.raises(FileExistsError):
        files.write_cases(str(tmp_path / "cases"), [])


def test_repairs():
    assert files.repaired(b"get(u, verify=False)", [(14, 19)]) == b"get(u, verify=True)"
    with pytest.raises(ValueError):
        files.repaired(b"get(u, verify=True)", [(14, 18)])


def test_settings():
    s = settings.parse('disabled = ["SR001"]\nfail_on = "high"\n')
    assert s.disabled == ("SR001",) and s.fail_on == "high"
    for bad in ('x = 1', 'disabled = ["SR999"]', 'fail_on = "huge"', "max_findings = 0"):
        with pytest.raises(ValueError):
            settings.parse(bad)
    for bad in ("/a", "a/../b", "c:d", ""):
        with pytest.raises(ValueError):
            settings.relative(bad)
