"""Queries: joins, aggregations, ordinals, order, limits and set operations over findings and files."""

from __future__ import annotations

from pyspark.sql import functions as F

from glintsieve.functions import patterns
from glintsieve.functions.globs import to_regex
from glintsieve.operators import analyze, stabbing
from glintsieve.plans import baseline, corpus, dependencies, scan, scoring
from glintsieve.queries.inputs import _npm, _requirements
from glintsieve.queries.registry import FOLDERS, LABELS, NAMES, PATHS, all_matches, customers, new_findings, paths, query, raw_matches, source_files, source_lines, table, values
from glintsieve.sinks import shared
from glintsieve.sources import manifests, tree

SHA = "sha256(rule_id || chr(0) || path || chr(0) || sha256(text))"

# --- joins ---------------------------------------------------------------------------------------

_SELECTED = "SELECT DISTINCT 'src/m' || CAST(c_custkey * 3 % 30 AS VARCHAR) || '/file.py' AS path FROM customer"


def _selected(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select(F.concat(F.lit("src/m"), (F.col("c_custkey") * 3 % 30).cast("string"), F.lit("/file.py")).alias("path")).distinct()


@query("j01_selection", f"{LABELS}, chosen AS ({_SELECTED}) SELECT DISTINCT path, path IN (SELECT path FROM chosen) AS selected FROM corpus")
def j01(spark, sf_dir):
    files, chosen = source_files(spark, sf_dir).select("path"), _selected(spark, sf_dir)
    semi = files.join(chosen, "path", "left_semi").withColumn("selected", F.lit(True))
    return semi.unionByName(files.join(chosen, "path", "left_anti").withColumn("selected", F.lit(False)))


@query("j02_missing_selected", f"{LABELS}, chosen AS (SELECT path FROM ({_SELECTED}) UNION ALL VALUES ('src/gone.py'), ('src/photo.png')) SELECT path, path NOT LIKE '%.py' AS unsupported FROM chosen WHERE path NOT IN (SELECT path FROM corpus)")
def j02(spark, sf_dir):
    chosen = _selected(spark, sf_dir).unionByName(values(spark, [("src/gone.py",), ("src/photo.png",)], "path string"))
    return chosen.join(source_files(spark, sf_dir).select("path"), "path", "left_anti").withColumn("unsupported", ~F.col("path").endswith(".py"))


@query("j03_baseline", f"{LABELS} SELECT path, line, rule_id, rule_id IN ('SR004', 'SR009') AS known FROM expected")
def j03(spark, sf_dir):
    x = new_findings(spark, sf_dir)
    baseline = x.filter(F.col("rule_id").isin("SR004", "SR009")).select("fingerprint").distinct()
    old = x.join(baseline, "fingerprint", "left_semi").withColumn("known", F.lit(True))
    return old.unionByName(x.join(baseline, "fingerprint", "left_anti").withColumn("known", F.lit(False))).select("path", "line", "rule_id", "known")


#: What an older scan knew: the findings of some lines, and of lines that are gone.
_OLD = "line % 3 <> 0"


@query("j03a_states", f"""{LABELS}, prints AS (SELECT {SHA} AS fingerprint, line FROM expected), old AS (SELECT DISTINCT fingerprint FROM prints WHERE {_OLD} UNION SELECT sha256('gone' || CAST(c_custkey AS VARCHAR)) FROM customer)
SELECT fingerprint, CASE WHEN fingerprint IN (SELECT fingerprint FROM old) THEN 'known' ELSE 'new' END AS state FROM prints UNION ALL SELECT fingerprint, 'fixed' FROM old WHERE fingerprint NOT IN (SELECT fingerprint FROM prints)""")
def j03a(spark, sf_dir):
    """Findings against a kept baseline: new, known and fixed."""
    found = new_findings(spark, sf_dir).select("fingerprint", "line", F.lit("new").alias("state"))
    gone = table(spark, sf_dir, "customer").select(F.sha2(F.concat(F.lit("gone"), F.col("c_custkey").cast("string")), 256).alias("fingerprint"))
    path = shared.fresh_path(spark, "baseline")
    baseline.save(found.filter(_OLD).select("fingerprint").unionByName(gone), path)
    old = baseline.load(spark, path)
    return baseline.told_apart(found, old).select("fingerprint", "state").unionByName(baseline.fixed(found, old).withColumn("state", F.lit("fixed")))


@query("j04_syntax_facts", f"{LABELS} SELECT path, line FROM expected WHERE rule_id = 'SR004' AND path LIKE '%.py'")
def j04(spark, sf_dir):
    x = source_lines(spark, sf_dir).filter(F.col("path").endswith(".py"))
    calls = x.select("path", "line", F.explode("classes").alias("class")).filter("class = 'C'")
    return scan.matched(x).filter("rule_id = 'SR004'").join(calls, ["path", "line"], "left_semi").select("path", "line")


@query("j05_ranges", "SELECT o.o_orderkey, r.lo FROM orders o JOIN (SELECT c_custkey % 7 AS k, c_custkey AS lo, c_custkey + 25 AS hi FROM customer) r ON o.o_custkey % 7 = r.k AND o.o_custkey BETWEEN r.lo AND r.hi")
def j05(spark, sf_dir):
    """Lines in ranges."""
    r = table(spark, sf_dir, "customer").selectExpr("c_custkey % 7 as k", "c_custkey as lo", "c_custkey + 25 as hi")
    o = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_custkey as at", "o_custkey % 7 as k")
    return stabbing.stabbed(o, r, ["k"], "at", "lo", "hi").select("o_orderkey", "lo")


@query("j06_evidence", f"{LABELS} SELECT path, line, rule_id, CASE WHEN rule_id IN ('SR012', 'SR015', 'SR016', 'SR021') THEN 'tainted' ELSE 'candidate' END AS confidence FROM expected")
def j06(spark, sf_dir):
    x = raw_matches(spark, sf_dir)
    evidence = x.filter("evidence is not null").select("path", "line", "rule_id", "evidence.remote")
    found = x.select("path", "line", "rule_id").join(evidence, ["path", "line", "rule_id"], "left")
    return found.select("path", "line", "rule_id", F.when(F.col("remote").isNull(), "candidate").when(F.col("remote"), "tainted").otherwise("reachable").alias("confidence"))


_FILES = "WITH files AS (SELECT c_custkey AS k, 'c/' || CAST(c_custkey AS VARCHAR) AS path FROM customer)"


def _made(spark, sf_dir, language: str, content):
    """A file for each customer; content is an expression over its key k."""
    k = F.col("c_custkey")
    return customers(spark, sf_dir).select(F.concat(F.lit("c/"), k.cast("string"), F.lit({"python": ".py", "csharp": ".cs", "c": ".c"}[language])).alias("path"), F.lit(language).alias("language"), content(k).alias("content"))


@query("j07_first_function", f"{_FILES} SELECT path || '.py' AS path, CAST(2 + k % 5 AS INTEGER) AS line FROM files")
def j07(spark, sf_dir):
    """A call is followed into the first function of its name."""
    text = lambda k: F.concat(F.lit("def go(a):\n"), F.repeat(F.lit("    b = 1\n"), (k % 5).cast("int")), F.lit("    eval(a)\ndef go(a):\n    eval(a)\nx = request.args['q']\ngo(x)\n"))
    return analyze.match_rows(_made(spark, sf_dir, "python", text), True).filter("evidence is not null").select("path", "line")


_GLOBS = ["**/*.py", "src/**", "docs/*", "**/test_*", "*/app/[!x]*"]


@query("j10_globs", PATHS + ', globs("glob", pattern) AS (VALUES ' + ", ".join(f"('{g}', '{to_regex(g)}')" for g in _GLOBS) + ') SELECT o_orderkey, path, "glob" FROM paths JOIN globs ON regexp_matches(path, pattern)')
def j10(spark, sf_dir):
    """Every path with every pattern that it matches."""
    number = F.explode(patterns.hits(F.col("path"), _GLOBS)).alias("k")
    return paths(spark, sf_dir).select("o_orderkey", "path", number).select("o_orderkey", "path", F.get(F.array(*[F.lit(g) for g in _GLOBS]), F.col("k")).alias("glob"))


#: Patterns of every folder, name and extension of the paths, and as many that match nothing: about 1,000.
_MANY = [f"{f}/{n}" for f in FOLDERS for n in NAMES] + [f"**/{n}" for n in NAMES] + [f"{f.split('/')[0]}/**" for f in FOLDERS] + [f"**/{f.split('/')[-1]}/*.{n.split('.')[-1]}" for f in FOLDERS for n in NAMES] + [f"none{k}/**/x{k}*" for k in range(500)]


@query("j10a_many_globs", PATHS + ', globs(k, pattern) AS (VALUES ' + ", ".join(f"({k}, '{to_regex(g)}')" for k, g in enumerate(_MANY)) + '), names AS (SELECT DISTINCT path FROM paths), found AS (SELECT path, count(*) AS n, max(k) AS last FROM names JOIN globs ON regexp_matches(path, pattern) GROUP BY path) SELECT o_orderkey, n, last FROM paths JOIN found USING (path)')
def j10a(spark, sf_dir):
    """How many of some 1,000 patterns match a path, and the last one of them."""
    x = paths(spark, sf_dir).withColumn("k", patterns.hits(F.col("path"), _MANY)).filter("size(k) > 0")
    return x.select("o_orderkey", F.size("k").cast("long").alias("n"), F.element_at("k", -1).alias("last"))


def _labels(spark, sf_dir):
    """Labels of every line of the corpus for each rule that has labels: a row grows by that fixed number."""
    fires = {r: [t for t, rule, _ in corpus.labels() if rule == r] for r in LABELLED}
    asked = F.explode(F.array(*[F.struct(F.lit(r).alias("rule_id"), F.col("template").isin(*fires[r]).alias("positive")) for r in LABELLED]))
    return corpus.rows(spark, sf_dir).select("path", "line", asked.alias("l")).select("l.rule_id", "path", "line", "l.positive")


#: The rules that labels are kept for; findings of the others stay unscored.
LABELLED = sorted({r for _, r, _ in corpus.labels()} - {"SR010", "SR017", "SR022"})
_SCORES = f"""{LABELS}, asked(rule_id) AS (VALUES {', '.join(f"('{r}')" for r in LABELLED)}),
labels AS (SELECT rule_id, path, line, template IN (SELECT template FROM fires f WHERE f.rule_id = a.rule_id) AS positive FROM corpus, asked a),
hits AS (SELECT DISTINCT rule_id, path, line FROM expected WHERE severity <> 'info'),
judged AS (SELECT l.*, h.rule_id IS NOT NULL AS predicted FROM labels l LEFT JOIN hits h ON l.rule_id = h.rule_id AND l.path = h.path AND l.line = h.line)"""


def _hits(spark, sf_dir):
    """What a scan that reports from medium severity on says; the labels know of more."""
    return new_findings(spark, sf_dir).filter("severity <> 'info'")


@query("j11_labels", f"{_SCORES} SELECT rule_id, path, line, positive, predicted FROM judged")
def j11(spark, sf_dir):
    hits = _hits(spark, sf_dir).select("rule_id", "path", "line").distinct().withColumn("predicted", F.lit(True))
    return _labels(spark, sf_dir).join(hits, ["rule_id", "path", "line"], "left").withColumn("predicted", F.coalesce("predicted", F.lit(False)))


@query("j12_unscored", f"{_SCORES} SELECT rule_id, path, line FROM hits WHERE (rule_id, path, line) NOT IN (SELECT (rule_id, path, line) FROM labels)")
def j12(spark, sf_dir):
    labels = corpus.rows(spark, sf_dir).select("path", "line", F.array(*[F.lit(r) for r in LABELLED]).alias("rules"))  # every line is judged for every one of them
    return scoring.unscored(labels, _hits(spark, sf_dir), ["path", "line"], "rule_id", "rules").select("rule_id", "path", "line")


def _formatter(spark, sf_dir):
    """A constructor, up to 29 lines, and what it is used for."""
    return _made(spark, sf_dir, "csharp", lambda k: F.concat(F.lit("var f = new BinaryFormatter();\n"), F.repeat(F.lit("x();\n"), (k % 30).cast("int")), F.lit("var o = f.Deserialize(s);\n")))


@query("j13_formatter_near", f"{_FILES} SELECT path || '.cs' AS path, CAST(k % 30 + 2 AS INTEGER) AS line FROM files WHERE k % 30 + 1 <= 20")
def j13(spark, sf_dir):
    """Uses of a formatter at most so many lines after its constructor."""
    return analyze.match_rows(_formatter(spark, sf_dir)).filter("rule_id = 'SR006'").select("path", "line")


@query("j14_pinned", "SELECT 'doc/' || CAST(doc_id AS VARCHAR) AS path, doc_id % 5 <> 0 AS intact FROM documents")
def j14(spark, sf_dir):
    from glintsieve.sources.results import pinned

    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"), F.encode("text", "UTF-8").alias("content"), "doc_id")
    manifest = d.select("path", F.sha2(F.concat("content", F.when(F.col("doc_id") % 5 == 0, F.encode(F.lit("!"), "UTF-8")).otherwise(F.encode(F.lit(""), "UTF-8"))), 256).alias("sha256"))
    return pinned(d.select("path", "content"), manifest)


# --- aggregations --------------------------------------------------------------------------------


@query("g01_by_severity", f"{LABELS} SELECT count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'info') AS info FROM expected")
def g01(spark, sf_dir):
    return new_findings(spark, sf_dir).agg(*[F.count_if(F.col("severity") == s).alias(s) for s in ("high", "medium", "info")])


@query("g03_complete", "SELECT true AS complete")
def g03(spark, sf_dir):
    return source_lines(spark, sf_dir, "complete").agg((F.count_if(~F.col("complete")) == 0).alias("complete"))


@query("g04_by_rule", f"{LABELS} SELECT rule_id, count(*) AS n FROM expected GROUP BY rule_id")
def g04(spark, sf_dir):
    return new_findings(spark, sf_dir).groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))


@query("g05_confusion", f"{_SCORES} SELECT rule_id, count(*) FILTER (positive AND predicted) AS tp, count(*) FILTER (NOT positive AND predicted) AS fp, count(*) FILTER (NOT positive AND NOT predicted) AS tn, count(*) FILTER (positive AND NOT predicted) AS fn FROM judged GROUP BY rule_id")
def g05(spark, sf_dir):
    return scoring.metrics(_labels(spark, sf_dir), _hits(spark, sf_dir), ["rule_id", "path", "line"], ["rule_id"]).select("rule_id", "tp", "fp", "tn", "fn")


@query("g06_ratios", f"{_SCORES}, c AS (SELECT rule_id, count(*) FILTER (positive AND predicted) AS tp, count(*) FILTER (NOT positive AND predicted) AS fp, count(*) FILTER (NOT positive AND NOT predicted) AS tn, count(*) FILTER (positive AND NOT predicted) AS fn FROM judged GROUP BY rule_id) SELECT rule_id, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(fp / nullif(fp + tn, 0), 6) AS false_positive_rate FROM c")
def g06(spark, sf_dir):
    return scoring.metrics(_labels(spark, sf_dir), _hits(spark, sf_dir), ["rule_id", "path", "line"], ["rule_id"]).select("rule_id", "precision", "recall", "false_positive_rate")


@query("g07_distinct_files", f"{LABELS} SELECT rule_id, count(DISTINCT path) AS files FROM expected GROUP BY rule_id")
def g07(spark, sf_dir):
    return new_findings(spark, sf_dir).groupBy("rule_id").agg(F.countDistinct("path").alias("files"))


@query("g08_distinct_fingerprints", f"{LABELS} SELECT count(DISTINCT {SHA}) AS n FROM expected")
def g08(spark, sf_dir):
    return new_findings(spark, sf_dir).agg(F.countDistinct("fingerprint").alias("n"))


@query("g09_threshold_met", f"{LABELS} SELECT coalesce(bool_or(severity = 'high'), false) AS met FROM expected")
def g09(spark, sf_dir):
    return new_findings(spark, sf_dir).agg(F.coalesce(F.bool_or(F.col("severity") == "high"), F.lit(False)).alias("met"))


_MESSAGES = "SELECT DISTINCT event_type || ':' || CAST(user_id AS VARCHAR) AS message FROM events WHERE event_type <> 'view'"


def _messages(spark, sf_dir):
    return table(spark, sf_dir, "events").filter("event_type <> 'view'").select(F.concat("event_type", F.lit(":"), F.col("user_id").cast("string")).alias("message"))


@query("g10_error_cap", f"WITH m AS ({_MESSAGES}) SELECT message, greatest((SELECT count(*) FROM m) - 100, 0) AS left_out FROM (SELECT message, row_number() OVER (ORDER BY message) AS k FROM m) WHERE k <= 100")
def g10(spark, sf_dir):
    """The first 100 errors, and how many are left out: the limit is the feature."""
    return tree.first_errors(_messages(spark, sf_dir), 100)


@query("g11_labelled_gate", f"{LABELS} SELECT rule_id, true AS perfect FROM fires GROUP BY rule_id")
def g11(spark, sf_dir):
    x = corpus.rows(spark, sf_dir)
    fires = values(spark, corpus.labels(), "template int, rule_id string, s string").select("template", "rule_id")
    truth = x.join(F.broadcast(fires), "template").select("path", "line", "rule_id").withColumn("t", F.lit(1))
    found = new_findings(spark, sf_dir).select("path", "line", "rule_id").withColumn("f", F.lit(1))
    return truth.join(found, ["path", "line", "rule_id"], "full").groupBy("rule_id").agg((F.count_if(F.col("t").isNull() | F.col("f").isNull()) == 0).alias("perfect"))


@query("g12_by_file", f"{LABELS} SELECT path, count(*) AS n, min(line) AS first_line FROM expected GROUP BY path")
def g12(spark, sf_dir):
    return new_findings(spark, sf_dir).groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.min("line").alias("first_line"))


# --- ordinals ------------------------------------------------------------------------------------


@query("w01_occurrence", f"{_FILES} SELECT path || '.py' AS path, CAST(n + 1 AS INTEGER) AS line, 'SR004' AS rule_id, CAST(n AS INTEGER) AS ordinal FROM files, range(12) AS t(n) WHERE n <= k % 12 UNION ALL SELECT path || '.py', CAST(k % 12 + 2 AS INTEGER), 'SR009', 0 FROM files")
def w01(spark, sf_dir):
    """Equal lines of a file are told apart by how many came before."""
    x = _made(spark, sf_dir, "python", lambda k: F.concat(F.repeat(F.lit("eval(x)\n"), (k % 12 + 1).cast("int")), F.lit("r = random.random()\n")))
    return scan.judged_matches(analyze.match_rows(x), scan.Settings(max_findings=None)).select("path", "line", "rule_id", "ordinal")


@query("w02_innermost", "SELECT o_orderkey, lo, hi FROM (SELECT o.o_orderkey, r.lo, r.hi, row_number() OVER (PARTITION BY o.o_orderkey ORDER BY hi - lo, lo) AS k FROM orders o JOIN (SELECT c_custkey % 7 AS k, c_custkey AS lo, c_custkey + 10 + c_custkey % 40 AS hi FROM customer) r ON o.o_custkey % 7 = r.k AND o.o_custkey BETWEEN lo AND hi) WHERE k = 1")
def w02(spark, sf_dir):
    r = table(spark, sf_dir, "customer").selectExpr("c_custkey % 7 as k", "c_custkey as lo", "c_custkey + 10 + c_custkey % 40 as hi")
    o = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_custkey as at", "o_custkey % 7 as k")
    return stabbing.innermost(o, r, ["k"], "at", "lo", "hi").filter("lo is not null").select("o_orderkey", "lo", "hi")


@query("w03_proximity", f"{_FILES} SELECT path || '.cs' AS path, CAST(n AS INTEGER) AS line, n - 1 <= 20 AS near FROM files, range(1, 32) AS t(n) WHERE n <= k % 30 + 2")
def w03(spark, sf_dir):
    """The lines within reach of the last constructor."""
    return analyze.line_rows(_formatter(spark, sf_dir), columns=["path", "line", "formatter_near"]).select("path", "line", F.col("formatter_near").alias("near"))


@query("w04_byte_budget", f"{LABELS}, f AS (SELECT path, sum(octet_length(encode(text)) + 1) - 1 AS n FROM corpus GROUP BY path), r AS (SELECT *, sum(n) OVER (ORDER BY string_split(path, '/')) AS total FROM f) SELECT path, CAST(n AS BIGINT) AS n FROM r WHERE total <= 20000")
def w04(spark, sf_dir):
    """Files in discovery order up to a budget."""
    f = source_files(spark, sf_dir).select("path", F.octet_length("content").cast("long").alias("n"))
    return scan.files_within(f, "n", 20000).filter("read").select("path", "n")


@query("w05_finding_budget", f"{LABELS}, r AS (SELECT path, line, rule_id, row_number() OVER (ORDER BY string_split(path, '/'), line, rule_id) AS k FROM expected) SELECT path, line, rule_id, CASE WHEN k <= 500 THEN 'new' ELSE 'truncated' END AS state FROM r")
def w05(spark, sf_dir):
    return scan.budgeted(all_matches(spark, sf_dir), 500).select("path", "line", "rule_id", "state")


@query("w06_last_match", PATHS + " SELECT o_orderkey, CASE WHEN regexp_matches(path, '[.]py$') THEN '**/*.py' WHEN starts_with(path, 'src/') THEN 'src/**' ELSE '**/*a*' END AS winner FROM paths WHERE regexp_matches(path, '[.]py$') OR starts_with(path, 'src/') OR contains(string_split(path, '/')[-1], 'a')")
def w06(spark, sf_dir):
    """The last pattern of a list that matches a path."""
    ordered = ["**/*a*", "src/**", "**/*.py"]
    x = paths(spark, sf_dir).withColumn("k", patterns.hits(F.col("path"), ordered)).filter("size(k) > 0")
    return x.select("o_orderkey", F.get(F.array(*[F.lit(g) for g in ordered]), F.element_at("k", -1)).alias("winner"))


@query("w07_block_flag", f"{_FILES} SELECT path || '.c' AS path, CAST(n AS INTEGER) AS line, n BETWEEN 2 AND k % 7 + 3 AS inside FROM files, range(1, 12) AS t(n) WHERE n <= k % 7 + 4")
def w07(spark, sf_dir):
    """Lines inside of a block comment that goes over several of them."""
    x = _made(spark, sf_dir, "c", lambda k: F.concat(F.lit("a();\n/* b();\n"), F.repeat(F.lit("c();\n"), (k % 7).cast("int")), F.lit("*/\nd();\n")))
    return analyze.line_rows(x, columns=["path", "line", "comments"]).select("path", "line", (F.col("comments") != "").alias("inside"))


# --- order, limit, sets --------------------------------------------------------------------------


@query("o01_report_order", f"{LABELS} SELECT path, line, rule_id FROM expected ORDER BY path, line, rule_id")
def o01(spark, sf_dir):
    return new_findings(spark, sf_dir).orderBy("path", "line", "emit_ord").select("path", "line", "rule_id")


@query("o02_discovery_order", PATHS + " SELECT path FROM (SELECT DISTINCT path FROM paths) ORDER BY string_split(path, '/')")
def o02(spark, sf_dir):
    return paths(spark, sf_dir).select("path").distinct().orderBy(F.split("path", "/"))


@query("o03_sorted_errors", f"{_MESSAGES} ORDER BY message")
def o03(spark, sf_dir):
    return tree.first_errors(_messages(spark, sf_dir), (1 << 31) - 1).select("message").orderBy("message")


@query("o04_limit", f"{LABELS} SELECT count(*) AS total, least(count(*), 500) AS kept, greatest(count(*) - 500, 0) AS truncated FROM expected")
def o04(spark, sf_dir):
    x = scan.budgeted(all_matches(spark, sf_dir), 500)
    return x.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("state") == "new").alias("kept"), F.count_if(F.col("state") == "truncated").alias("truncated"))


@query("o05_display_filter", f"{LABELS} SELECT path, line, rule_id FROM expected WHERE severity = 'high'")
def o05(spark, sf_dir):
    return new_findings(spark, sf_dir).filter((scan.rank(F.col("severity")) >= 2) & (F.col("file_class") == "production")).select("path", "line", "rule_id")


@query("u01_candidates", f"{LABELS} SELECT DISTINCT path, line, rule_id FROM expected")
def u01(spark, sf_dir):
    x = source_lines(spark, sf_dir)
    flows = x.select("path", "line", F.explode("flows").alias("f")).select("path", "line", F.col("f.rule_id").alias("rule_id"))
    return scan.matched(x).select("path", "line", "rule_id").unionByName(flows).dropDuplicates(["path", "line", "rule_id"])


_TWO = scan.Settings(overrides=(scan.Override("src/m1*/**", ("SR004", "SR009")), scan.Override("**/*.py", ("SR009", "SR005"))))


@query("u02_rule_union", f"{LABELS} SELECT path, line, rule_id FROM expected WHERE NOT (path LIKE 'src/m1%' AND rule_id IN ('SR004', 'SR009')) AND NOT (path LIKE '%.py' AND rule_id IN ('SR009', 'SR005'))")
def u02(spark, sf_dir):
    """Overrides add to what is disabled: what any of them disables is off."""
    return new_findings(spark, sf_dir).filter(scan.rule_enabled(F.col("rule_id"), F.col("path"), _TWO)).select("path", "line", "rule_id")


@query("u03_rule_difference", f"{LABELS} SELECT path, line, rule_id FROM expected WHERE rule_id IN ('SR001', 'SR004')")
def u03(spark, sf_dir):
    """What is enabled without what is disabled."""
    s = scan.Settings(enabled=("SR001", "SR002", "SR004"), disabled=("SR002", "SR007"))
    return new_findings(spark, sf_dir).filter(scan.rule_enabled(F.col("rule_id"), F.col("path"), s)).select("path", "line", "rule_id")


@query("u04_inventory_union", "SELECT DISTINCT e AS ecosystem, n AS name, CASE WHEN n = 'lodash' THEN '4.17.' || CAST(n_nationkey AS VARCHAR) WHEN n = 'requests-x' THEN '2.' || CAST(n_nationkey AS VARCHAR) || '.0' ELSE v END AS version FROM nation, (VALUES ('npm', 'lodash', ''), ('npm', 'b', '2.0.0'), ('npm', 'named', '3.0.0'), ('PyPI', 'requests-x', ''), ('PyPI', 'requests', '2.19.0')) AS t(e, n, v)")
def u04(spark, sf_dir):
    """The inventory of the lock files of two systems."""
    return dependencies.inventory(manifests.npm(_npm(spark, sf_dir)), manifests.requirements(_requirements(spark, sf_dir)))
