"""Queries: reports, files, cases, exit codes and repeated scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from glintsieve.operators import rules
from glintsieve.plans import cases, dependencies, scan
from glintsieve.queries.inputs import ADVISORIES_SQL, inventory, records
from glintsieve.queries.registry import LABELS, all_matches, new_findings, query, repaired_files, source_files, source_lines, table, values
from glintsieve.queries.relations import _SCORES, _hits, _labels
from glintsieve.sinks import files, fragments, reports
from glintsieve.sinks.shared import fresh_path


def _report(spark, sf_dir):
    return scan.report(source_lines(spark, sf_dir), all_matches(spark, sf_dir), source_files(spark, sf_dir))


def _to(spark, write):
    """The path of a new report that `write` has written."""
    path = fresh_path(spark, "report")
    write(path)
    return path


_ENGINE = "CASE WHEN path LIKE '%/.env.env' THEN 'lexical' ELSE 'ast' END"
_CONFIDENCE = "CASE WHEN rule_id IN ('SR012', 'SR015', 'SR016', 'SR021') THEN 'tainted' ELSE 'candidate' END"
_PRINT = "sha256(rule_id || chr(0) || path || chr(0) || sha256(text))"
_PLACED = f"{LABELS}, placed_findings AS (SELECT row_number() OVER (ORDER BY path, line, n) AS position, *, {_ENGINE} AS engine, {_CONFIDENCE} AS confidence, {_PRINT} AS fingerprint FROM expected)"


@query("k01_json", f"{_PLACED} SELECT position, rule_id, severity, engine, confidence, path, line, fingerprint FROM placed_findings")
def k01(spark, sf_dir):
    """The JSON report, read back from its fragments."""
    path = _to(spark, lambda to: reports.write_json(new_findings(spark, sf_dir), _report(spark, sf_dir), to))
    return reports.read_items(spark, path, "rule_id string, severity string, engine string, confidence string, path string, line int, fingerprint string")


@query("k02_sarif", f"{_PLACED} SELECT position, path, line, rule_id, CASE severity WHEN 'high' THEN 'error' WHEN 'medium' THEN 'warning' ELSE 'note' END AS level, fingerprint FROM placed_findings")
def k02(spark, sf_dir):
    path = _to(spark, lambda to: reports.write_sarif(new_findings(spark, sf_dir), rules.table(spark), to))
    place = "locations array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:int>>>>"
    x = reports.read_items(spark, path, f"ruleId string, level string, {place}, partialFingerprints struct<primary:string>")
    at = F.get("locations", F.lit(0))["physicalLocation"]
    return x.select("position", at["artifactLocation"]["uri"].alias("path"), at["region"]["startLine"].alias("line"), F.col("ruleId").alias("rule_id"), "level", F.col("partialFingerprints.primary").alias("fingerprint"))


@query("k03_text", f"""{_PLACED}, text_lines AS (
  SELECT position AS p, 0 AS k, '[' || upper(severity) || '] ' || rule_id || ' ' || path || ':' || CAST(line AS VARCHAR) || ' (' || engine || '/' || confidence || ')' AS item FROM placed_findings
  UNION ALL SELECT position, 1, '    source line ' || CAST(line AS VARCHAR) FROM placed_findings WHERE confidence = 'tainted'
  UNION ALL SELECT position, 2, '    sink line ' || CAST(line AS VARCHAR) FROM placed_findings WHERE confidence = 'tainted')
SELECT row_number() OVER (ORDER BY p, k) AS position, item FROM text_lines""")
def k03(spark, sf_dir):
    return fragments.read(spark, _to(spark, lambda to: reports.write_text(new_findings(spark, sf_dir), _report(spark, sf_dir), to)))


_RULES = ", ".join(f"('{r.rule_id}', '{r.rule_id} [{r.severity}] {r.name}')" for r in rules.RULES)


@query("k04_rules", f"{LABELS}, bank(rule_id, body) AS (VALUES {_RULES}) SELECT rule_id, body, count(path) AS n FROM bank LEFT JOIN expected USING (rule_id) GROUP BY ALL")
def k04(spark, sf_dir):
    """The rule bank with the findings of each rule."""
    found = new_findings(spark, sf_dir).groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))
    listed = rules.table(spark).select("rule_id", F.format_string("%s [%s] %s", "rule_id", "severity", "name").alias("body"))
    return listed.join(found, "rule_id", "left").select("rule_id", "body", F.coalesce("n", F.lit(0)).alias("n"))


@query("k05_markdown", f"{LABELS} SELECT path, line, rule_id, '| ' || severity || ' | ' || rule_id || ' | ' || path || ':' || CAST(line AS VARCHAR) || ' | ' || CASE WHEN rule_id IN ('SR012', 'SR015', 'SR016', 'SR021') THEN 'tainted' ELSE 'candidate' END || ' |' AS body FROM expected")
def k05(spark, sf_dir):
    return reports.markdown_rows(new_findings(spark, sf_dir))


@query("k06_annotations", f"{LABELS} SELECT path, line, rule_id, '::' || CASE severity WHEN 'high' THEN 'error' WHEN 'medium' THEN 'warning' ELSE 'notice' END || ' file=' || path || ',line=' || CAST(line AS VARCHAR) || '::' || rule_id AS body FROM expected")
def k06(spark, sf_dir):
    return reports.annotation_rows(new_findings(spark, sf_dir))


@query("k07_code_quality", f"{_PLACED} SELECT position, rule_id AS check_name, fingerprint, CASE WHEN severity = 'high' THEN 'critical' ELSE 'minor' END AS severity, path, line FROM placed_findings")
def k07(spark, sf_dir):
    path = _to(spark, lambda to: reports.write_code_quality(new_findings(spark, sf_dir), to))
    x = reports.read_items(spark, path, "check_name string, fingerprint string, severity string, location struct<path:string,lines:struct<begin:int>>")
    return x.select("position", "check_name", "fingerprint", "severity", "location.path", F.col("location.lines.begin").alias("line"))


@query("k08_quiet", f"{LABELS} SELECT CAST(count(*) AS VARCHAR) || ' new of ' || CAST(count(*) AS VARCHAR) || '; complete: true' AS body FROM expected")
def k08(spark, sf_dir):
    return reports.quiet(_report(spark, sf_dir))


@query("k09_new_file", f"{LABELS} SELECT count(*) AS lines, true AS refused, true AS whole FROM expected")
def k09(spark, sf_dir):
    """A report is written to a new folder; writing there again is refused, and what it holds is whole."""
    path = _to(spark, lambda to: reports.write_code_quality(new_findings(spark, sf_dir), to))
    try:
        reports.write_code_quality(new_findings(spark, sf_dir), path)
        refused = False
    except FileExistsError:
        refused = True
    told = fragments.manifest(path)["fragments"]
    sums = values(spark, [(f["file"], f["lines"], f["sha256"]) for f in told], "file string, lines long, sha256 string")  # a row a fragment
    raw = spark.read.format("binaryFile").load(f"{path}/part-*").select(F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2("content", 256).alias("found"))
    return sums.join(raw, "file", "left").agg(F.sum("lines").alias("lines"), F.lit(refused).alias("refused"), F.bool_and(F.coalesce(F.col("sha256") == F.col("found"), F.lit(False))).alias("whole"))


@query("k10_baseline", f"{LABELS} SELECT row_number() OVER (ORDER BY fingerprint) AS position, fingerprint FROM (SELECT DISTINCT {_PRINT} AS fingerprint FROM expected)")
def k10(spark, sf_dir):
    return reports.read_fingerprints(spark, _to(spark, lambda to: reports.write_baseline(new_findings(spark, sf_dir), to)))


@query("k11_cases", f"{LABELS} SELECT 'CASE-' || upper(substr(sha256(rule_id || chr(0) || path || chr(0) || sha256(text)), 1, 16)) AS case_id, path, line, rule_id FROM expected WHERE rule_id IN ('SR012', 'SR015', 'SR016', 'SR021')")
def k11(spark, sf_dir):
    return cases.records(new_findings(spark, sf_dir), "repository", "revision").select("case_id", "path", "line", "rule_id")


@query("k12_dependency_report", f"{ADVISORIES_SQL} SELECT row_number() OVER (ORDER BY id, ecosystem, package, version) AS position, id, package, version, status FROM hits")
def k12(spark, sf_dir):
    packages = inventory(spark, sf_dir)
    found = dependencies.vulnerable(packages, records(spark, sf_dir))
    errors = packages.filter("error is not null").select("error")
    path = _to(spark, lambda to: reports.write_dependencies(found, errors, to))
    return reports.read_items(spark, path, "id string, package string, version string, status string")


_TEMPLATES = ", ".join("(" + ", ".join("'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for x in pair) + ")" for pair in sorted(files.TEMPLATES.items()))


@query("k13_templates", f"SELECT 'p' || CAST(n_nationkey AS VARCHAR) || '/' || path AS path, body, true AS refused FROM nation, (VALUES {_TEMPLATES}) AS t(path, body)")
def k13(spark, sf_dir):
    """Templates in a folder for each nation, written by the tasks; where they stand they are not written again."""
    top = fresh_path(spark, "projects")

    def run(batches):
        import os

        import pyarrow as pa

        root = top.removeprefix("file://")
        for batch in batches:
            rows = []
            for key in batch.column("n_nationkey").to_pylist():
                folder = os.path.join(root, f"p{key}")
                for name in sorted(files.TEMPLATES):
                    if not os.path.exists(os.path.join(folder, name)):  # a rerun of a lost task finds its own
                        files.init(folder, [name])
                    try:
                        files.init(folder, [name])
                        refused = False
                    except FileExistsError:
                        refused = True
                    with open(os.path.join(folder, name), encoding="utf-8") as f:
                        rows.append((f"p{key}/{name}", f.read(), refused))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], ["path", "body", "refused"])

    return table(spark, sf_dir, "nation").select("n_nationkey").mapInArrow(run, "path string, body string, refused boolean")


@query("k14_repairs", f"{LABELS} SELECT path, string_agg(CASE WHEN contains(text, 'requests.put(') THEN replace(text, 'verify=False', 'verify=True') ELSE text END, chr(10) ORDER BY line) AS content FROM corpus WHERE path IN (SELECT path FROM corpus WHERE contains(text, 'requests.put(')) GROUP BY path")
def k14(spark, sf_dir):
    """Files with verification switched on where a request switches it off."""
    return repaired_files(spark, sf_dir).select("path", "content")


_METRICS = ["rule_id", "tp", "fp", "tn", "fn", "precision", "recall", "false_positive_rate"]


@query("k15_results", _SCORES + """, c AS (SELECT rule_id, count(*) FILTER (positive AND predicted) AS tp, count(*) FILTER (NOT positive AND predicted) AS fp, count(*) FILTER (NOT positive AND NOT predicted) AS tn, count(*) FILTER (positive AND NOT predicted) AS fn FROM judged GROUP BY rule_id)
SELECT row_number() OVER (ORDER BY rule_id) AS position, *, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(fp / nullif(fp + tn, 0), 6) AS false_positive_rate FROM c""")
def k15(spark, sf_dir):
    from glintsieve.plans import scoring

    m = scoring.metrics(_labels(spark, sf_dir), _hits(spark, sf_dir), ["rule_id", "path", "line"], ["rule_id"]).select(*_METRICS)
    path = _to(spark, lambda to: reports.write_results(m, to, ["rule_id"]))
    return reports.read_items(spark, path, "rule_id string, tp long, fp long, tn long, fn long, precision double, recall double, false_positive_rate double")


@query("k16_diagnostics", f"{LABELS} SELECT path, count(*) AS n FROM expected GROUP BY path")
def k16(spark, sf_dir):
    return reports.diagnostics(new_findings(spark, sf_dir)).select("path", "n")


@query("x01_watch", f"{LABELS} SELECT CAST(k AS INTEGER) AS scan, CAST((SELECT count(*) > 0 FROM expected WHERE severity = 'high') AS INTEGER) AS code FROM range(2) AS t(k)")
def x01(spark, sf_dir):
    """Two scans of the corpus, one after the other."""
    from glintsieve.streaming.watch import watch

    x = new_findings(spark, sf_dir)
    codes = list(watch(lambda: int(not x.filter("severity = 'high'").isEmpty()), count=2, seconds=0.01))
    return values(spark, [(k, c) for k, c in enumerate(codes)], "scan int, code int")


#: (line, rule, how often it is in a version of a file: where event_id modulo the number is 0)
_VERSION_LINES = [("eval(a)", "SR004", 2), ("os.system(b)", "SR005", 3), ("digest = hashlib.md5(c)", "SR008", 5), ("pickle.loads(d)", "SR006", 7), ("roll = random.random()", "SR009", 1)]


@query("x02_deltas", f"""WITH versions AS (
  SELECT user_id, event_id, event_type = 'error' AS gone, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
lines(text, rule_id, every) AS (VALUES {', '.join(f"('{t}', '{r}', {n})" for t, r, n in _VERSION_LINES)}),
has AS (SELECT user_id, k, rule_id, text FROM versions JOIN lines ON event_id % every = 0 WHERE NOT gone),
now AS (SELECT v.user_id, v.event_id, v.k, h.rule_id, h.text FROM versions v JOIN has h ON h.user_id = v.user_id AND h.k = v.k),
before AS (SELECT v.user_id, v.event_id, v.k, h.rule_id, h.text FROM versions v JOIN has h ON h.user_id = v.user_id AND h.k = v.k - 1),
states AS (
  SELECT n.*, CASE WHEN b.k IS NULL THEN 'new' ELSE 'unchanged' END AS state FROM now n LEFT JOIN before b ON b.user_id = n.user_id AND b.k = n.k AND b.rule_id = n.rule_id
  UNION ALL SELECT b.*, 'fixed' FROM before b ANTI JOIN now n ON b.user_id = n.user_id AND b.k = n.k AND b.rule_id = n.rule_id)
SELECT 'u/' || CAST(user_id AS VARCHAR) || '.py' AS path, event_id AS version, rule_id, sha256(rule_id || chr(0) || 'u/' || CAST(user_id AS VARCHAR) || '.py' || chr(0) || sha256(text)) AS fingerprint, state FROM states""")
def x02(spark, sf_dir):
    """The events as a stream of versions of each user's file, and what every version adds, keeps and fixes."""
    from glintsieve.streaming import deltas

    events = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    lines = F.array(*[F.when(F.col("event_id") % n == 0, F.lit(t)) for t, _, n in _VERSION_LINES])
    content = F.when(F.col("event_type") != "error", F.concat(F.array_join(F.filter(lines, lambda x: x.isNotNull()), "\n"), F.lit("\n")))
    versions = events.select(F.concat(F.lit("u/"), F.col("user_id").cast("string"), F.lit(".py")).alias("path"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("version"), content.alias("content"))
    out = fresh_path(spark, "deltas")
    deltas.run(deltas.deltas(versions), out, fresh_path(spark, "deltas-progress")).awaitTermination()
    return deltas.written(spark, out).select("path", "version", "rule_id", "fingerprint", "state")


@query("x04_transitions", "SELECT event_id FROM (SELECT event_id, (['candidate', 'validated', 'remediated', 'verified', 'inconclusive'])[CAST(1 + event_id % 5 AS BIGINT)] AS b, (['candidate', 'validated', 'remediated', 'verified', 'inconclusive'])[CAST(1 + user_id % 5 AS BIGINT)] AS a FROM events) WHERE NOT ((b = 'candidate' AND a IN ('validated', 'inconclusive')) OR (b = 'validated' AND a IN ('remediated', 'inconclusive')) OR (b = 'remediated' AND a IN ('verified', 'inconclusive')))")
def x04(spark, sf_dir):
    states = F.array(*[F.lit(s) for s in cases.TRANSITIONS])
    pick = lambda c: F.get(states, (F.col(c) % 5).cast("int"))
    history = table(spark, sf_dir, "events").select("event_id", pick("event_id").alias("before"), pick("user_id").alias("after"))
    return cases.illegal(history).select("event_id")


@query("x06_exit_code", "SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 2 WHEN event_id % 7 = 0 THEN 3 WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS code FROM events")
def x06(spark, sf_dir):
    row = F.struct((F.col("event_id") % 11 == 0).alias("usage_error"), (F.col("event_id") % 7 != 0).alias("complete"))
    return table(spark, sf_dir, "events").select("event_id", reports.exit_code(row, F.col("event_id") % 3 == 0).alias("code"))
