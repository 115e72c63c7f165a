"""Deltas of file versions over several batches, restarts and late versions."""

import datetime

import pytest
from pyspark.sql import functions as F

from glintsieve.streaming import deltas

SCHEMA = "path string, at timestamp, version long, content string"
T0 = datetime.datetime(2024, 1, 1)


def at(minute):
    return T0 + datetime.timedelta(minutes=minute)


@pytest.fixture
def stream(spark, tmp_path):
    """Feeds batches of versions as files, runs until they are read, and returns all deltas so far."""
    (tmp_path / "in").mkdir()

    def feed(*rows, late="1 hour"):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        query = deltas.run(deltas.deltas(source, late=late), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
        assert query.awaitTermination(120)
        return sorted((r.path, r.version, r.rule_id, r.line, r.state) for r in deltas.written(spark, str(tmp_path / "out")).collect())

    return feed


def test_states_over_restarts(stream):
    first = stream(("a.py", at(0), 1, "eval(x)\n"), ("b.py", at(0), 1, "os.system(x)\neval(y)\n"), ("c.txt", at(0), 1, "eval(x)"), (None, at(0), 1, "eval(x)"))
    assert first == [("a.py", 1, "SR004", 1, "new"), ("b.py", 1, "SR004", 2, "new"), ("b.py", 1, "SR005", 1, "new")]
    second = stream(("a.py", at(5), 2, "y = 1\neval(x)\neval(x)\n"), ("b.py", at(5), 2, "eval(y)  # glintsieve:ignore\n"), ("b.py", at(6), 3, None))
    new = set(second) - set(first)
    assert new == {("a.py", 2, "SR004", 2, "unchanged"), ("a.py", 2, "SR004", 3, "new"), ("b.py", 2, "SR004", 2, "fixed"), ("b.py", 2, "SR005", 1, "fixed")}
    third = stream(("b.py", at(9), 4, "eval(y)\n"))
    assert set(third) - set(second) == {("b.py", 4, "SR004", 1, "new")}


def test_repeats_and_late_versions_change_nothing(stream):
    rows = [("a.py", at(10), 2, "eval(x)\n"), ("a.py", at(20), 3, "")]
    first = stream(*rows)
    assert first == [("a.py", 2, "SR004", 1, "new"), ("a.py", 3, "SR004", 1, "fixed")]
    assert stream(*rows, ("a.py", at(5), 1, "os.system(x)\n"), ("a.py", at(20), 3, "eval(z)\n")) == first
    assert stream(("a.py", at(20), 4, "eval(x)\n"))[-1] == ("a.py", 4, "SR004", 1, "new")


def test_fingerprints_are_those_of_the_scan(spark):
    from glintsieve.plans import corpus, scan
    from conftest import SMALL

    files = corpus.files(spark, SMALL).filter("path < 'src/m1'")
    one = deltas.version_findings(files.withColumn("at", F.lit(T0)).withColumn("version", F.lit(1).cast("long")))
    found = one.select(F.explode(F.from_json("findings", "array<struct<fingerprint:string,rule_id:string,line:int>>")).alias("f")).select("f.*")
    wanted = scan.scan(files, scan.Settings(max_findings=None)).select("fingerprint", "rule_id", "line")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, wanted.collect())) and wanted.count() > 100
