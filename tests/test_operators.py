"""Running totals and stabbing against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from glintsieve.operators import prefix, stabbing


def test_running_totals(spark):
    rng = random.Random(2)
    rows = [(k, f"{rng.choice('abc')}/{rng.randrange(90)}", rng.randrange(50), 1) for k in range(500)] + [(900, "b/5", None, 2)]
    df = spark.createDataFrame(rows, "id int, path string, n int, own int").repartition(7)
    order = [F.split("path", "/").asc(), F.col("id").asc()]
    found = {r.id: (r.total, r.path) for r in prefix.running(df, order, "n", "total").collect()}
    total = 0
    for k, path, n, _ in sorted(rows, key=lambda r: (r[1].split("/"), r[0])):
        total += n or 0
        assert found[k] == (total, path)
    numbers = {r.id: r.at for r in prefix.numbered(df, [F.col("n").desc(), F.col("id").asc()], "at").collect()}
    wanted = sorted(rows, key=lambda r: (-(r[2] if r[2] is not None else -1), r[0]))
    assert numbers == {r[0]: k for k, r in enumerate(wanted, 1)}
    assert prefix.running(df.limit(0), order, "n", "total").count() == 0 == prefix.numbered(df.limit(0), order, "at").count()


def _intervals(kind, rng):
    if kind == "short":
        return [(k, rng.randrange(3), a, a + rng.randrange(9)) for k in range(150) for a in [rng.randrange(-50, 300)]]
    if kind == "long":  # most hold everything
        return [(k, 0, -(1 << 40), 1 << rng.randrange(9, 60)) for k in range(60)]
    return [(k, k % 2, a, a + (1 << rng.randrange(20)) - 1) for k in range(150) for a in [rng.randrange(-1000, 1000)]] + [(800, 0, 5, 4), (801, None, 0, 9), (802, 1, None, 9)]


@pytest.mark.parametrize("kind", ["short", "long", "mixed"])
def test_stabbing(spark, kind):
    rng = random.Random(kind)
    intervals = _intervals(kind, rng)
    points = [(k, rng.randrange(3), rng.randrange(-60, 320)) for k in range(200)] + [(900, None, 5), (901, 1, None), (902, 1, 7), (902, 1, 7)]
    p, i = spark.createDataFrame(points, "id int, key int, at int").repartition(3), spark.createDataFrame(intervals, "number int, key int, lo long, hi long")
    found = sorted((r.id, r.number) for r in stabbing.stabbed(p, i, ["key"], "at", "lo", "hi").collect())
    inside = lambda x, y: None not in (x[1], x[2], y[1], y[2], y[3]) and x[1] == y[1] and y[2] <= x[2] <= y[3]
    assert found == sorted((x[0], y[0]) for x in points for y in intervals if inside(x, y)) and found
    inner = sorted((r.id, r.lo, r.hi) for r in stabbing.innermost(p, i, ["key"], "at", "lo", "hi").filter("lo is not null").collect())
    wanted = [(x[0], *min(((y[3] - y[2], y[2], y[3]) for y in intervals if inside(x, y)))[1:]) for x in points if any(inside(x, y) for y in intervals)]
    assert inner == sorted(wanted)
    assert stabbing.innermost(p, i, ["key"], "at", "lo", "hi").count() == len(points)
    assert stabbing.stabbed(p, i.limit(0), ["key"], "at", "lo", "hi").count() == 0


def test_stabbing_has_no_nested_loop(spark):
    p, i = spark.range(100).selectExpr("id % 3 as key", "id as at"), spark.range(50).selectExpr("id % 3 as key", "id as lo", "id + 5 as hi")
    plan = stabbing.stabbed(p, i, ["key"], "at", "lo", "hi")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_the_shared_folder_is_cleared(spark, monkeypatch):
    import os

    from glintsieve.sinks import shared

    monkeypatch.setattr(shared, "_GIVEN", {})
    table = shared.written(spark.range(5), "numbers")
    assert table.count() == 5
    path = shared._GIVEN[spark.sparkContext.applicationId][0].removeprefix("file://")
    assert os.path.isdir(path)
    assert shared.clear(spark) == 1 and not os.path.exists(path) and shared.clear(spark) == 0


def test_intervals_are_worked_out_once(spark):
    """What makes the intervals may be a pass over files: it does not run for the levels and again for the join."""
    runs = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            runs.add(batch.num_rows)
            yield batch

    i = spark.range(0, 50, 1, 2).selectExpr("id % 3 as key", "id as lo", "id + 5 as hi").mapInArrow(counted, "key long, lo long, hi long")
    p = spark.range(100).selectExpr("id % 3 as key", "id as at")
    assert stabbing.stabbed(p, i, ["key"], "at", "lo", "hi").count() == 100
    assert runs.value == 50


def test_labels_are_not_broadcast(spark):
    """However small the labels look, what is unscored is found by dealing both sides."""
    from glintsieve.plans import scoring

    labels = spark.createDataFrame([("a", 1, ["X", "Y"]), ("a", 2, []), ("b", 1, None), (None, 1, ["X"])], "path string, line int, rules array<string>")
    found = spark.createDataFrame([("a", 1, "X"), ("a", 1, "Z"), ("a", 1, "Z"), ("a", 2, "X"), ("b", 1, "X"), ("c", 1, "Y"), (None, 1, "X")], "path string, line int, rule_id string")
    out = scoring.unscored(labels, found, ["path", "line"], "rule_id", "rules")
    assert sorted(((r.path or "", r.line, r.rule_id) for r in out.collect())) == [("", 1, "X"), ("a", 1, "Z"), ("a", 2, "X"), ("b", 1, "X"), ("c", 1, "Y")]
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
