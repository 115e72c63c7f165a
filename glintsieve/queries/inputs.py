"""Queries: sources and readers."""

from __future__ import annotations

import os
import subprocess

from pyspark.sql import functions as F

from glintsieve.functions import patterns
from glintsieve.functions import text as T
from glintsieve.plans import dependencies, scan
from glintsieve.queries.registry import LABELS, PATHS, _sql_list, new_findings, paths, query, source_files, table, values
from glintsieve.sources import gitignore, languages, manifests, results, settings, tree
from glintsieve.sinks import reports
from glintsieve.sinks.shared import fresh_path


#: Folders of the tree that is written from customers; one is never entered.
_FOLDERS = ["src", "src/deep/er", "node_modules/lib", "docs"]
_EXTENSIONS = ["py", "c", "tmp"]
_LIMIT = 64
_TREE = f"""WITH made AS (
  SELECT c_custkey, c_custkey % 89 = 0 AS link, c_custkey % 97 = 0 AS large, c_custkey % 3 = 2 AS tmp, c_name AS body,
         'd' || CAST(c_custkey % 7 AS VARCHAR) || '/' || ({_sql_list(_FOLDERS)})[CAST(1 + c_custkey % {len(_FOLDERS)} AS BIGINT)] || '/f' || CAST(c_custkey AS VARCHAR) || '.' || ({_sql_list(_EXTENSIONS)})[CAST(1 + c_custkey % 3 AS BIGINT)] AS path
  FROM customer), seen AS (SELECT * FROM made WHERE path NOT LIKE '%/node_modules/%')"""


def _tree(spark, sf_dir, **options):
    """A file for each customer, written by the tasks into the shared folder, as a tree; every 89th is a link, every 97th too large."""
    top = fresh_path(spark, "tree")
    key = F.col("c_custkey")
    pick = lambda values, n: F.get(F.array(*[F.lit(v) for v in values]), (key % n).cast("int"))
    path = F.concat(F.lit("d"), (key % 7).cast("string"), F.lit("/"), pick(_FOLDERS, len(_FOLDERS)), F.lit("/f"), key.cast("string"), F.lit("."), pick(_EXTENSIONS, 3))
    body = F.when(key % 97 == 0, F.repeat(F.lit("x"), _LIMIT + 1)).otherwise(F.col("c_name"))
    rows = table(spark, sf_dir, "customer").select(path.alias("path"), body.alias("body"), (key % 89 == 0).alias("link"))

    def run(batches):
        import pyarrow as pa

        root = top.removeprefix("file://")
        for batch in batches:
            for x in batch.to_pylist():
                full = os.path.join(root, x["path"])
                os.makedirs(os.path.dirname(full), exist_ok=True)
                with open(full + ".new", "w", encoding="utf-8") as f:  # moved in place, so that a rerun writes the same file again
                    f.write(x["body"])
                os.replace(full + ".new", full)
                if x["link"]:
                    os.replace(full, full + ".to")
                    os.symlink(full + ".to", full + ".new")
                    os.replace(full + ".new", full)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    rows.mapInArrow(run, "n long").agg(F.sum("n")).collect()
    return top, tree.load(spark, top, **options)


@query("s01_tree", f"{_TREE} SELECT path, CASE WHEN link OR tmp THEN NULL WHEN large THEN {_LIMIT + 1} ELSE length(body) END AS size, link AS is_symlink, tmp AND NOT link AS excluded FROM seen UNION ALL SELECT path || '.to', CASE WHEN large THEN {_LIMIT + 1} ELSE length(body) END, false, false FROM seen WHERE link")
def s01(spark, sf_dir):
    return _tree(spark, sf_dir, excludes="*.tmp")[1].select("path", "size", "is_symlink", "excluded")


@query("s02_single_file", "SELECT 'f1.c' AS path, CAST(length(c_name) AS BIGINT) AS size FROM customer WHERE c_custkey = 1")
def s02(spark, sf_dir):
    top, _ = _tree(spark, sf_dir)
    return tree.load(spark, f"{top}/d1/src/deep/er/f1.c").select("path", "size")


@query("s03_language", PATHS + """, n AS (SELECT o_orderkey, path, string_split(path, '/')[-1] AS name FROM paths), e AS (SELECT *, lower(regexp_extract(name, '^.+[.]([^.]+)$', 1)) AS x FROM n)
SELECT o_orderkey, path, CASE WHEN name = '.env' OR starts_with(name, '.env.') OR name = 'Dockerfile' THEN 'config' WHEN x = 'py' THEN 'python' WHEN x IN ('js', 'ts') THEN 'javascript' WHEN x = 'rs' THEN 'rust' WHEN x = 'go' THEN 'go' WHEN x = 'kts' THEN 'jvm' WHEN x = 'cs' THEN 'csharp' WHEN x = 'phtml' THEN 'php' WHEN x = 'toml' THEN 'config' END AS language FROM e""")
def s03(spark, sf_dir):
    return paths(spark, sf_dir).select("o_orderkey", "path", languages.language(F.col("path")).alias("language"))


@query("s04_ignored_directories", PATHS + " SELECT o_orderkey, path FROM paths WHERE NOT list_has_any(string_split(path, '/')[:-2], ['node_modules', 'build', 'vendor', '.git'])")
def s04(spark, sf_dir):
    return paths(spark, sf_dir).filter(~languages.in_ignored_directory(F.col("path"))).select("o_orderkey", "path")


@query("s05_excludes", PATHS + " SELECT o_orderkey, path FROM paths WHERE NOT (starts_with(path, 'src/app/') OR path LIKE 'src/app' OR regexp_matches(path, '^docs/[^/]*[.]md$') OR regexp_matches(path, '(^|/)[^/]*[.]png$'))")
def s05(spark, sf_dir):
    return paths(spark, sf_dir).filter(~patterns.excluded(F.col("path"), ["src/app", "docs/*.md", "*.png"])).select("o_orderkey", "path")


_IGNORE = "# comment\n*.py\n!/src/main.py\ndocs/\n/deps/**/x*\n\n!test_*.py\n"


@query("s06_ignore_rules", "SELECT 'p' || CAST(n_nationkey AS VARCHAR) AS base, pattern, negate, directory, anchored FROM nation, (VALUES ('*.py', false, false, false), ('src/main.py', true, false, true), ('docs', false, true, false), ('deps/**/x*', false, false, true), ('test_*.py', true, false, false)) AS t(pattern, negate, directory, anchored) UNION ALL SELECT 'p' || CAST(n_nationkey AS VARCHAR), 'n' || CAST(n_nationkey AS VARCHAR) || '*', n_nationkey % 2 = 0, false, false FROM nation")
def s06(spark, sf_dir):
    """The rules of an ignore file for each nation, parsed by the tasks."""
    key = F.col("n_nationkey").cast("string")
    own = F.concat(F.when(F.col("n_nationkey") % 2 == 0, "!").otherwise(""), F.lit("n"), key, F.lit("*\n"))
    texts = table(spark, sf_dir, "nation").select(F.concat(F.lit("p"), key).alias("base"), F.concat(F.lit(_IGNORE), own).alias("content"))
    return gitignore.rule_rows(texts).select("base", "pattern", "negate", "directory", "anchored")


@query("s07_ignored", PATHS + " SELECT o_orderkey, path, CASE WHEN regexp_matches(path, '(^|/)test_[^/]*[.]py$') THEN false WHEN regexp_matches(path, '^deps/(.*/)?x[^/]*$') THEN true WHEN directory AND regexp_matches(path, '(^|/)docs$') THEN true WHEN path = 'src/main.py' THEN false WHEN regexp_matches(path, '[.]py$') THEN true ELSE false END AS ignored FROM paths")
def s07(spark, sf_dir):
    found, _ = gitignore.parse("", _IGNORE)
    return paths(spark, sf_dir).select("o_orderkey", "path", patterns.ignored(F.col("path"), F.col("directory"), found).alias("ignored"))


@query("s08_bounded_read", f"{_TREE}, read AS (SELECT path, large, body FROM seen WHERE NOT link UNION ALL SELECT path || '.to', large, body FROM seen WHERE link) SELECT path, CASE WHEN NOT large THEN body END AS content, CASE WHEN large THEN 'too large' END AS error FROM read")
def s08(spark, sf_dir):
    """Files over a limit are errors, not content."""
    return tree.texts(_tree(spark, sf_dir, max_file_bytes=_LIMIT)[1])


@query("s09_confinement", f"{_TREE} SELECT (SELECT count(*) FROM seen WHERE link) AS skipped_symlinks, (SELECT count(*) FROM seen WHERE NOT link AND NOT large) + (SELECT count(*) FROM seen WHERE link AND NOT large) AS files, (SELECT count(*) FROM seen WHERE large) AS n_errors, (SELECT count(*) FROM seen WHERE large) = 0 AS complete")
def s09(spark, sf_dir):
    """Links are not followed; what could not be read makes a scan incomplete."""
    return tree.summary(_tree(spark, sf_dir, max_file_bytes=_LIMIT)[1]).select("skipped_symlinks", "files", "n_errors", "complete")


@query("s10_decoding", "SELECT doc_id, doc_id % 7 <> 0 AS valid FROM documents")
def s10(spark, sf_dir):
    raw = F.when(F.col("doc_id") % 7 == 0, F.concat(F.encode("text", "UTF-8"), F.unhex(F.lit("FF")))).otherwise(F.encode("text", "UTF-8"))
    return table(spark, sf_dir, "documents").select("doc_id", F.is_valid_utf8(raw.cast("string")).alias("valid"))


@query("s11_byte_budget", f"{LABELS}, f AS (SELECT path, sum(octet_length(encode(text)) + 1) - 1 AS n FROM corpus GROUP BY path), r AS (SELECT path, sum(n) OVER (ORDER BY string_split(path, '/')) AS total FROM f) SELECT path, total <= 30000 AS read FROM r")
def s11(spark, sf_dir):
    """Files that a budget of bytes lets in, in discovery order."""
    f = source_files(spark, sf_dir).select("path", F.octet_length("content").cast("long").alias("n"))
    return scan.files_within(f, "n", 30000).select("path", "read")


@query("s12_changed_list", PATHS + " SELECT DISTINCT path FROM paths")
def s12(spark, sf_dir):
    """A list of changed files as another system writes it."""
    listed = F.replace("path", F.lit("/"), F.lit("\\"))
    return paths(spark, sf_dir).select(T.relative_path(F.concat(F.lit(".\\"), listed)).alias("path")).filter("path is not null").distinct()


@query("s13_git_diff", "SELECT 'p' || CAST(n_nationkey AS VARCHAR) || '.py' AS path FROM nation WHERE n_nationkey % 3 <> 0")
def s13(spark, sf_dir):
    """A work tree with a file for each nation, two thirds of them changed or added since the commit; deleted ones are not told."""
    root = fresh_path(spark, "work-tree").removeprefix("file://")
    os.makedirs(root)
    git = ["git", "-C", root, "-c", "user.name=x", "-c", "user.email=x@localhost", "-c", "commit.gpgsign=false"]
    keys = [r[0] for r in table(spark, sf_dir, "nation").select("n_nationkey").collect()]  # 25 rows
    subprocess.run([*git, "init", "-q"], check=True, capture_output=True)

    def write(name: str, text: str) -> None:
        with open(os.path.join(root, name), "w", encoding="utf-8") as f:
            f.write(text)

    for k in [k for k in keys if k % 3 != 2]:
        write(f"p{k}.py", "x = 1\n")
    write("gone.py", "x = 1\n")
    subprocess.run([*git, "add", "-A"], check=True)
    subprocess.run([*git, "commit", "-q", "-m", "first"], check=True, capture_output=True)
    for k in [k for k in keys if k % 3]:
        write(f"p{k}.py", f"x = {k + 2}\n")
    os.remove(os.path.join(root, "gone.py"))
    subprocess.run([*git, "add", "-A"], check=True)
    return values(spark, [(x,) for x in settings.changed(root, "HEAD")], "path string")


@query("s14_settings", "SELECT 'p' || CAST(n_nationkey AS VARCHAR) AS path, CASE WHEN n_nationkey > 0 THEN 'medium' END AS fail_on, CASE WHEN n_nationkey > 0 THEN CAST(n_nationkey AS INTEGER) END AS max_findings, CASE WHEN n_nationkey > 0 THEN ['tests/' || CAST(n_nationkey AS VARCHAR) || '/**'] END AS overrides, CASE WHEN n_nationkey = 0 THEN 'max_findings must be between 1 and 1000000' END AS error FROM nation")
def s14(spark, sf_dir):
    """A settings file for each nation."""
    k = F.col("n_nationkey").cast("string")
    text = F.concat(F.lit('fail_on = "medium"\ndisabled = ["SR002"]\nmax_findings = '), k, F.lit('\n[[overrides]]\npath = "tests/'), k, F.lit('/**"\ndisabled = ["SR007"]\n'))
    return settings.rows(table(spark, sf_dir, "nation").select(F.concat(F.lit("p"), k).alias("path"), text.alias("content"))).select("path", "fail_on", "max_findings", "overrides", "error")


@query("s15_baseline", f"{LABELS} SELECT DISTINCT sha256(rule_id || chr(0) || path || chr(0) || sha256(text)) AS fingerprint FROM expected")
def s15(spark, sf_dir):
    path = fresh_path(spark, "baseline")
    reports.write_baseline(new_findings(spark, sf_dir), path)
    return reports.read_fingerprints(spark, path).select("fingerprint")


@query("s16_default_baseline", "SELECT n_nationkey, n_nationkey % 2 = 0 AS found FROM nation")
def s16(spark, sf_dir):
    """Every other nation's project, written by the tasks, has a baseline beside it."""
    top = fresh_path(spark, "baselines")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            keys = batch.column("n_nationkey").to_pylist()
            found = []
            for key in keys:
                folder = os.path.join(top.removeprefix("file://"), f"p{key}")
                os.makedirs(folder, exist_ok=True)
                if key % 2 == 0:
                    open(os.path.join(folder, "glintsieve.baseline.json"), "w", encoding="utf-8").close()
                found.append(settings.find_baseline(folder) is not None)
            yield pa.RecordBatch.from_arrays([batch.column("n_nationkey"), pa.array(found)], ["n_nationkey", "found"])

    return table(spark, sf_dir, "nation").select("n_nationkey").mapInArrow(run, "n_nationkey int, found boolean")


#: Advisories are made from parts: a third of them, and a third of the inventory, belong to one package.
_PACKAGE = "CASE WHEN {k} % 3 = 0 THEN 'hot' ELSE 'pkg' || CAST({k} % 40 AS VARCHAR) END"
ADVISORIES_SQL = f"""WITH advisories AS (
  SELECT p_partkey AS k, 'ADV-' || CAST(p_partkey AS VARCHAR) AS id, {_PACKAGE.format(k="p_partkey")} AS package, [p_size % 5, p_partkey % 10, 0] AS lo, [p_size % 5, p_partkey % 10 + p_partkey % 4, p_size % 3] AS hi, p_partkey % 7 AS kind FROM part WHERE p_partkey % 11 <> 0),
stock AS (SELECT DISTINCT {_PACKAGE.format(k="o_orderkey")} AS package, o_custkey % 6 AS a, o_orderkey % 13 AS b, o_custkey % 4 AS c FROM orders),
stocked AS (SELECT package, CAST(a AS VARCHAR) || '.' || CAST(b AS VARCHAR) || CASE WHEN c = 3 THEN '' ELSE '.' || CAST(c AS VARCHAR) END AS version, [a, b, CASE WHEN c = 3 THEN 0 ELSE c END] AS v FROM stock),
hits AS (
  SELECT DISTINCT id, 'npm' AS ecosystem, s.package, version, CASE WHEN kind = 6 AND NOT version = '1.1' THEN 'unknown' ELSE 'affected' END AS status FROM advisories a JOIN stocked s ON a.package = s.package
  WHERE CASE kind WHEN 0 THEN v >= lo AND v <= hi WHEN 1 THEN v >= lo WHEN 2 THEN version = '2.3.1' WHEN 3 THEN v < hi OR v >= [5, 0, 0] WHEN 6 THEN true ELSE v >= lo AND v < hi END)"""


def records(spark, sf_dir):
    """An advisory record as JSON for each part, parsed: ranges of all kinds, listed versions, withdrawn ones, and some with a version that can't be read."""
    k, size = F.col("p_partkey"), F.col("p_size")
    dotted = lambda *n: F.concat_ws(".", *[x.cast("string") for x in n])
    lo, hi = dotted(size % 5, k % 10, F.lit(0)), dotted(size % 5, k % 10 + k % 4, size % 3)
    event = lambda name, value: F.concat(F.lit(f'{{"{name}":"'), value, F.lit('"}'))
    two = lambda a, b: F.concat(a, F.lit(","), b)
    events = (
        F.when(k % 7 == 0, two(event("introduced", lo), event("last_affected", hi))).when(k % 7 == 1, event("introduced", lo))
        .when(k % 7 == 3, two(two(event("introduced", F.lit("0")), event("limit", hi)), event("introduced", F.lit("v5"))))
        .when(k % 7 == 6, two(event("introduced", F.lit("0")), event("fixed", F.lit("1.0.0-rc1")))).otherwise(two(event("introduced", lo), event("fixed", hi)))
    )
    listed = F.when(k % 7 == 2, '["2.3.1"]').when(k % 7 == 6, '["1.1"]').otherwise("[]")
    ranges = F.when(k % 7 == 2, F.lit("[]")).otherwise(F.concat(F.lit('[{"type":"SEMVER","events":['), events, F.lit("]}]")))
    name = F.when(k % 3 == 0, "hot").otherwise(F.concat(F.lit("pkg"), (k % 40).cast("string")))
    body = F.concat(F.lit('{"id":"ADV-'), k.cast("string"), F.lit('","summary":"s"'), F.when(k % 11 == 0, ',"withdrawn":"2020"').otherwise(""), F.lit(',"affected":[{"package":{"ecosystem":"npm","name":"'), name, F.lit('"},"versions":'), listed, F.lit(',"ranges":'), ranges, F.lit("}]}"))
    kind = f"struct<{dependencies._typed(dependencies.ADVISORY)}>"
    return table(spark, sf_dir, "part").select(F.from_json(body, kind, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def inventory(spark, sf_dir):
    """Packages with versions from orders, as readers of lock files give them, repeats included."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    name = F.when(k % 3 == 0, "hot").otherwise(F.concat(F.lit("pkg"), (k % 40).cast("string")))
    version = F.concat((c % 6).cast("string"), F.lit("."), (k % 13).cast("string"), F.when(c % 4 == 3, "").otherwise(F.concat(F.lit("."), (c % 4).cast("string"))))
    error = F.when(k % 1000 == 999, "not resolved")
    return table(spark, sf_dir, "orders").select(F.lit("npm").alias("ecosystem"), name.alias("name"), version.alias("version"), F.lit(None).cast("string").alias("error")).unionByName(
        table(spark, sf_dir, "orders").filter("o_orderkey % 1000 = 999").select(F.lit(None).cast("string").alias("ecosystem"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("version"), error.alias("error"))
    )


@query("s17_advisories", f"SELECT 'ADV-' || CAST(p_partkey AS VARCHAR) AS id, 'npm' AS ecosystem, {_PACKAGE.format(k='p_partkey')} AS name, p_partkey % 11 = 0 AS withdrawn, CAST(CASE p_partkey % 7 WHEN 2 THEN 0 WHEN 1 THEN 1 WHEN 3 THEN 3 ELSE 2 END AS INTEGER) AS events FROM part")
def s17(spark, sf_dir):
    a = F.get("affected", F.lit(0))
    return records(spark, sf_dir).select("id", a["package"]["ecosystem"].alias("ecosystem"), a["package"]["name"].alias("name"), F.col("withdrawn").isNotNull().alias("withdrawn"), F.coalesce(F.size(F.get(a["ranges"], F.lit(0))["events"]), F.lit(0)).alias("events"))


def _npm(spark, sf_dir):
    """A lock file for each nation."""
    key = F.col("n_nationkey").cast("string")
    text = F.concat(F.lit('{"packages":{"":{"version":"1.0.0"},"node_modules/lodash":{"version":"4.17.'), key, F.lit('"},"node_modules/a/node_modules/b":{"version":"2.0.0"},"x":{"name":"named","version":"3.0.0"},"node_modules/l":{"link":true},"node_modules/bad":{}}}'))
    return table(spark, sf_dir, "nation").select(F.concat(F.lit("p"), key, F.lit("/package-lock.json")).alias("path"), text.alias("content"))


@query("s18_npm", "SELECT 'p' || CAST(n_nationkey AS VARCHAR) || '/package-lock.json' AS path, e AS ecosystem, n AS name, CASE WHEN n = 'lodash' THEN '4.17.' || CAST(n_nationkey AS VARCHAR) ELSE v END AS version, x AS error FROM nation, (VALUES ('npm', 'lodash', '', NULL), ('npm', 'b', '2.0.0', NULL), ('npm', 'named', '3.0.0', NULL), (NULL, NULL, NULL, 'not resolved'), (NULL, NULL, NULL, 'not resolved')) AS t(e, n, v, x)")
def s18(spark, sf_dir):
    return manifests.npm(_npm(spark, sf_dir))


def _requirements(spark, sf_dir):
    key = F.col("n_nationkey").cast("string")
    text = F.concat(F.lit("# pins\nRequests_X==2."), key, F.lit(".0  # why\n\nother>=1\nflask==1.*\nrequests==2.19.0\r\n"))
    return table(spark, sf_dir, "nation").select(F.concat(F.lit("p"), key).alias("path"), text.alias("content"))


@query("s19_requirements", "SELECT 'p' || CAST(n_nationkey AS VARCHAR) AS path, e AS ecosystem, n AS name, CASE WHEN n = 'requests-x' THEN '2.' || CAST(n_nationkey AS VARCHAR) || '.0' ELSE v END AS version, x AS error FROM nation, (VALUES ('PyPI', 'requests-x', '', NULL), ('PyPI', 'requests', '2.19.0', NULL), (NULL, NULL, NULL, 'no exact pin'), (NULL, NULL, NULL, 'no exact pin')) AS t(e, n, v, x)")
def s19(spark, sf_dir):
    return manifests.requirements(_requirements(spark, sf_dir))


@query("s20_cargo", "SELECT 'p' || CAST(n_nationkey AS VARCHAR) AS path, e AS ecosystem, n AS name, CASE WHEN n = 'smallvec' THEN '0.6.' || CAST(n_nationkey AS VARCHAR) END AS version, x AS error FROM nation, (VALUES ('crates.io', 'smallvec', NULL), (NULL, NULL, 'incomplete block')) AS t(e, n, x)")
def s20(spark, sf_dir):
    key = F.col("n_nationkey").cast("string")
    text = F.concat(F.lit('version = 3\n\n[[package]]\nname = "smallvec"\nversion = "0.6.'), key, F.lit('"\n\n[[package]]\nname = "broken"\n'))
    return manifests.cargo(table(spark, sf_dir, "nation").select(F.concat(F.lit("p"), key).alias("path"), text.alias("content")))


@query("s21_go_mod", "SELECT 'p' || CAST(n_nationkey AS VARCHAR) AS path, e AS ecosystem, n AS name, CASE WHEN n = 'example.org/mod' THEN 'v1.' || CAST(n_nationkey AS VARCHAR) || '.0' ELSE v END AS version, x AS error FROM nation, (VALUES ('Go', 'example.org/mod', '', NULL), ('Go', 'example.org/b', 'v2.0.0', NULL), ('Go', 'example.org/c', 'v3.0.0', NULL), (NULL, NULL, NULL, 'not supported')) AS t(e, n, v, x)")
def s21(spark, sf_dir):
    key = F.col("n_nationkey").cast("string")
    text = F.concat(F.lit("module x\n\nrequire example.org/mod v1."), key, F.lit(".0\nrequire (\n\texample.org/b v2.0.0 // indirect\n\texample.org/c v3.0.0\n)\nreplace a => b\n"))
    return manifests.go(table(spark, sf_dir, "nation").select(F.concat(F.lit("p"), key).alias("path"), text.alias("content")))


@query("s22_component_scripts", r"SELECT page_id, regexp_extract_all(html, '(?is)<script\b[^>]*>(.*?)</script\s*>', 1) AS scripts FROM pages")
def s22(spark, sf_dir):
    from glintsieve.sources.components import scripts

    return table(spark, sf_dir, "pages").select("page_id", scripts(F.col("html")).alias("scripts"))


@query("s24_findings_report", f"{LABELS} SELECT rule_id, path, line FROM expected")
def s24(spark, sf_dir):
    path = fresh_path(spark, "findings")
    reports.write_json(new_findings(spark, sf_dir).withColumn("snippet", F.lit(None).cast("string")), spark.range(1).select(F.lit(True).alias("complete")), path)
    return results.findings_parts(spark, path, reports.FINDINGS_SCHEMA)


@query("s25_csv_labels", "SELECT 'Test' || CAST(c_custkey AS VARCHAR) AS test_name, c_custkey % 2 = 0 AS positive, CAST(c_custkey % 90 AS INTEGER) AS cwe FROM customer")
def s25(spark, sf_dir):
    """Labels as CSV with comments, written by the tasks and read back."""
    line = F.concat(F.lit("Test"), F.col("c_custkey").cast("string"), F.lit(",kind,"), (F.col("c_custkey") % 2 == 0).cast("string"), F.lit(","), (F.col("c_custkey") % 90).cast("string"))
    path = fresh_path(spark, "labels")
    table(spark, sf_dir, "customer").select(F.explode(F.array(F.lit("# test name, category, real, cwe"), line)).alias("value")).write.text(path)
    return results.csv_labels(spark, path).select("test_name", "positive", "cwe")


@query("s26_ground_truth", "SELECT 'SR' || lpad(CAST(1 + c_custkey % 22 AS VARCHAR), 3, '0') AS rule_id, CAST(c_custkey AS INTEGER) AS line, c_custkey % 2 = 0 AS positive FROM customer")
def s26(spark, sf_dir):
    path = fresh_path(spark, "truth")
    rule = F.concat(F.lit("SR"), F.lpad((1 + F.col("c_custkey") % 22).cast("string"), 3, "0"))
    rows = table(spark, sf_dir, "customer").select(rule.alias("rule_id"), F.lit("a.py").alias("path"), F.col("c_custkey").cast("int").alias("line"), (F.col("c_custkey") % 2 == 0).alias("positive"))
    rows.write.json(path)
    return results.ground_truth(spark, path).select("rule_id", "line", "positive")


@query("s27_sarif", f"{LABELS} SELECT path, line, rule_id FROM expected")
def s27(spark, sf_dir):
    from glintsieve.operators import rules

    path = fresh_path(spark, "sarif")
    reports.write_sarif(new_findings(spark, sf_dir), rules.table(spark), path)
    return results.sarif_parts(spark, path).select("path", "line", "rule_id")


_URIS = ["src/a%20b.py", "/etc/passwd", "file:///x", "a/../b", "a%2F..%2Fb", "ok.py", "a\\b", "a//b"]


@query("s28_safe_uri", "SELECT c_custkey, (['src/a b.py', NULL, NULL, NULL, NULL, 'ok.py', NULL, NULL])[CAST(1 + c_custkey % 8 AS BIGINT)] AS path FROM customer")
def s28(spark, sf_dir):
    uri = F.get(F.array(*[F.lit(x) for x in _URIS]), (F.col("c_custkey") % 8).cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", results.safe_uri(uri).alias("path"))


@query("s29_case_admission", f"{LABELS} SELECT 'CASE-' || upper(substr(sha256(rule_id || chr(0) || path || chr(0) || sha256(text)), 1, 16)) AS case_id, rule_id, false AS admitted FROM expected WHERE rule_id IN ('SR012', 'SR015', 'SR016', 'SR021')")
def s29(spark, sf_dir):
    from glintsieve.plans import cases

    x = cases.records(new_findings(spark, sf_dir), "repository", "revision")
    return x.select("case_id", "rule_id", cases.admitted(F.col("record")).alias("admitted"))


@query("s30_pinned_files", f"{LABELS} SELECT DISTINCT path, true AS intact FROM corpus")
def s30(spark, sf_dir):
    f = source_files(spark, sf_dir)
    return results.pinned(f.select("path", "content"), f.select("path", F.sha2("content", 256).alias("sha256")))


@query("j08_advisories", f"{ADVISORIES_SQL} SELECT id, package, version, status FROM hits")
def j08(spark, sf_dir):
    return dependencies.vulnerable(inventory(spark, sf_dir), records(spark, sf_dir)).select("id", "package", "version", "status")
