import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from glintsieve.operators import analyze
from glintsieve.plans import corpus, dependencies, scan
from glintsieve.sources import languages


def run(spark, files, **settings):
    frame = spark.createDataFrame(list(files.items()), "path string, content string")
    rows = scan.scan(frame, scan.Settings(**settings)).orderBy("path", "line", "emit_ord").collect()
    return [(r.path, r.line, r.rule_id, r.severity, r.confidence) for r in rows]


def test_flow_through_a_file(spark):
    text = "name = request.args['p']\nq = 'SELECT ' + name\ndb.execute(q)\nopen(name)\nopen(__file__)\nn = int(name)\neval(n)\n"
    found = run(spark, {"a.py": text})
    assert [(line, rule, conf) for _, line, rule, _, conf in found] == [(3, "SR011", "tainted"), (4, "SR012", "tainted"), (7, "SR004", "candidate")]


def test_local_sources_are_reachable_and_calls_are_followed_on_demand(spark):
    text = "import sys\nitem = sys.argv[1]\ndef go(value):\n    eval(value)\ngo(item)\n"
    assert run(spark, {"a.py": text})[0][4] == "candidate"
    assert run(spark, {"a.py": text}, between_functions=True)[0][4] == "reachable"


def test_command_bindings_and_shadowing(spark):
    text = "const {exec: run, spawn} = require('child_process');\nrun(a);\nspawn('ls');\nfunction f(run) { run(a); }\n"
    assert [(line, rule, sev) for _, line, rule, sev, _ in run(spark, {"a.js": text})] == [(2, "SR005", "high"), (3, "SR005", "info")]


def test_suppression_needs_a_comment(spark):
    text = "eval(a)  # glintsieve:ignore\neval(b)  # glintsieve:ignore[SR004]\neval(c)  # glintsieve:ignore[SR005]\neval('glintsieve:ignore')\n"
    assert [line for _, line, *_ in run(spark, {"a.py": text})] == [3, 4]


def test_components_and_configuration(spark):
    files = {"a.vue": "<template>eval(x)</template>\n<script>\nconst a = req.query.x;\neval(a);\n</script>\n", ".env.local": "API_TOKEN=live-value-1\nOTHER=1\n", "b.py": "text = 'eval(x)'\n"}
    assert [(p, line, r) for p, line, r, *_ in run(spark, files)] == [(".env.local", 1, "SR007"), ("a.vue", 4, "SR004")]


def test_secret_lines_show_no_source(spark):
    frame = spark.createDataFrame([("a.py", "password = 'hunter2-secret'; eval(x)\n")], "path string, content string")
    rows = scan.scan(frame).collect()
    assert {r.rule_id for r in rows} == {"SR004", "SR007"} and all(r.snippet is None for r in rows)


def test_fingerprints_survive_other_lines_and_tell_repeats_apart(spark):
    first = spark.createDataFrame([("a.py", "eval(x)\neval(x)\n")], "path string, content string")
    later = spark.createDataFrame([("a.py", "y = 1\n\neval(x)\nz = 2\neval(x)\n")], "path string, content string")
    a, b = ({r.fingerprint for r in scan.scan(f).collect()} for f in (first, later))
    assert a == b and len(a) == 2


def test_states_add_up_and_the_budget_cuts_in_order(spark):
    frame = spark.createDataFrame([(f"f{k:02d}.py", "eval(a)\neval(b)  # glintsieve:ignore\nrandom.random()\n") for k in range(10)], "path string, content string")
    from glintsieve.operators import analyze

    lines = analyze.line_rows(frame.withColumn("language", F.lit("python")))
    states = {r.state: r.n for r in scan.judged(lines, scan.Settings(disabled=("SR009",), max_findings=7)).groupBy("state").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert states == {"new": 7, "truncated": 3, "suppressed": 10, "disabled": 10}


def test_partitions_do_not_matter(spark):
    files = corpus.files(spark, SMALL)
    a, b = (sorted((r.path, r.line, r.rule_id) for r in scan.scan(files.repartition(n)).collect()) for n in (1, 9))
    assert a == b and len(a) > 1000


@pytest.mark.parametrize(("version", "hit"), [("1.1.0", True), ("1.2.0", False), ("2.0.5", True), ("2.1.0", False), ("1.0.0-rc1", None)])
def test_ranges(spark, version, hit):
    from glintsieve.functions.versions import in_ranges
    from glintsieve.queries.functions import _EVENTS

    assert spark.range(1).select(in_ranges(F.lit(version), F.expr(_EVENTS)).alias("x")).first().x is hit


def _advisory(k, events, versions=(), withdrawn=None, name="lodash", kind="SEMVER"):
    events = [dict.fromkeys(("introduced", "fixed", "last_affected", "limit")) | e for e in events]
    return (f"ADV-{k}", "s", withdrawn, [{"package": {"ecosystem": "npm", "name": name}, "versions": list(versions), "ranges": [{"type": kind, "events": events}]}])


ADVISORIES = [
    _advisory(1, [{"introduced": "4.0.0"}, {"last_affected": "4.17.11"}], ["4.17.20"]), _advisory(2, [{"introduced": "0"}], withdrawn="2020"), _advisory(3, [{"introduced": "0"}, {"fixed": "1.2"}, {"introduced": "2.0.0"}]),
    _advisory(4, [{"introduced": "0"}, {"fixed": "1.0.0-rc1"}]), _advisory(5, [{"introduced": "99999999"}]), _advisory(6, [{"introduced": "0"}], kind="GIT"), _advisory(7, [{"fixed": "3"}, {"limit": "4"}]),
    _advisory(8, [{"introduced": "1"}, {"introduced": "3"}, {"limit": "2"}]), _advisory(9, [{"introduced": "0"}], name="other"),
]
VERSIONS = ["4.17.20", "4.17.12", "4.17.11", "0.0.1", "1.2.0", "1.1.99", "2", "v3.0+b", "1.0-beta", "100000000.0", "4.0.0"]


def test_advisories_by_stabbing_equal_all_pairs(spark):
    """Versions in ranges, listed ones, unknown syntax, large numbers, withdrawn records: as each pair by itself says."""
    from glintsieve.functions.versions import in_ranges

    records = spark.createDataFrame(ADVISORIES, dependencies.ADVISORY)
    packages = spark.createDataFrame([("npm", "lodash", v, None) for v in VERSIONS * 2] + [(None, None, None, "bad"), ("npm", None, "1", None)], "ecosystem string, name string, version string, error string")
    found = {(r.id, r.version): r.status for r in dependencies.vulnerable(packages, records).collect()}
    wanted = {}
    for key, _, withdrawn, affected in ADVISORIES:
        for r in affected:
            one = r["ranges"][0]
            for v in VERSIONS if withdrawn is None and r["package"]["name"] == "lodash" else []:
                events = F.array(*[F.struct(*[F.lit(e[n]).cast("string").alias(n) for n in ("introduced", "fixed", "last_affected", "limit")]) for e in one["events"]])
                hit = spark.range(1).select(in_ranges(F.lit(v), events)).first()[0] if one["type"] != "GIT" else False
                if v in r["versions"] or hit:
                    wanted[key, v] = "affected"
                elif hit is None:
                    wanted[key, v] = "unknown"
    assert found == wanted and "unknown" in wanted.values() and ("ADV-1", "4.17.20") in wanted
    assert dependencies.vulnerable(packages.limit(0), records).count() == 0 == dependencies.vulnerable(packages, records.limit(0)).count()


def test_lines_that_are_left_out_match_no_rule(spark):
    """All lines and only telling ones give the same findings, with and without calls followed."""
    files = corpus.files(spark, SMALL)
    extra = [
        ("a.js", "const {exec: go} = require('child_process');\ngo(name);\n"), ("b.js", "import * as cp from 'node:child_process';\ncp.spawn(x)\n"), ("c.py", "name = request.args['n']\ndb.run(name)\n"),
        ("d.py", "x = DEBUG  =  True\nkey = 'sk_live_0123456789abcdefghijklmn'\n"), ("e.py", "def f(a):\n    eval(a)\nf(request.args['x'])\n"), ("f.env", "export API_TOKEN=abcdefgh1\n"), ("g.py", "total = 1\n'quiet'\n"),
        ("h.cs", "var f = new BinaryFormatter();\nvar x = f.Deserialize(s);\n"), ("i.ts", "el . innerHTML = req.query.a;\n"), ("j.py", "u = {'url': 'postgres://u:passw0rd@h/d'}\n"),
    ]
    files = files.unionByName(spark.createDataFrame(extra, "path string, content string")).withColumn("language", languages.language(F.col("path")))
    for between in (False, True):
        every, some = (analyze.line_rows(files, between, matching) for matching in (False, True))
        rows = [sorted(map(str, scan.judged(x).collect())) for x in (every, some)]
        assert rows[0] == rows[1] and len(rows[0]) > 1000
        assert some.count() < every.count()
        inside = scan.judged_matches(analyze.match_rows(files, between))
        assert sorted(map(str, inside.collect())) == rows[0]
