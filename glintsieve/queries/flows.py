"""Queries: syntax facts and the flow of untrusted input."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import functions as F


from glintsieve.operators import analyze, facts, stabbing, taint
from glintsieve.queries.registry import LABELS, customers, kept, new_findings, query, source_files, source_lines


def _facts(spark, sf_dir):
    return kept(spark, sf_dir, "facts", lambda: analyze.fact_rows(source_files(spark, sf_dir)))


@query("a01_reader", f"{LABELS} SELECT DISTINCT path, CASE WHEN path LIKE '%.py' THEN 'python' WHEN path LIKE '%.rb' THEN 'ruby' WHEN path NOT LIKE '%/.env.env' THEN 'structure' END AS reader FROM corpus")
def a01(spark, sf_dir):
    known = F.create_map(*[F.lit(x) for pair in facts.READERS.items() for x in pair])
    name = F.element_at(F.split("path", "/"), -1)
    extension = F.lower(F.regexp_extract(name, r"^.+\.([^.]+)$", 1))
    return source_files(spark, sf_dir).select("path", F.when(F.col("language") == "config", None).otherwise(F.try_element_at(known, extension)).alias("reader"))


@dataclass(frozen=True)
class Sample:
    """A file of a language with the labels of its structure: functions (name, parameters, first and last line), calls (full name, line), uncertain lines."""

    extension: str
    language: str
    text: str
    functions: tuple[tuple[str, str, int, int], ...]
    calls: tuple[tuple[str, int], ...]
    uncertain: tuple[tuple[int, int], ...] = ()


#: Whole files and files with errors, of every language; @ is a number.
SAMPLES = [
    Sample("c", "c", "int f_@(char *a, int b) {\n  strcpy(a, b);\n}\nvoid g(int c) {\n  if (c) {\n    h(c);\n}\nint k(int d) {\n  return m(d);\n}\n", (("f_@", "a b", 1, 3), ("k", "d", 8, 10), ("g", "c", 4, 4)), (("strcpy", 2), ("h", 6), ("m", 9)), ((4, 7),)),
    Sample("cs", "csharp", "class A {\n  public int F_@(string s) {\n    var x = Process.Start(s);\n  }\n}\n", (("F_@", "s", 2, 4),), (("Process.Start", 3),)),
    Sample("go", "go", "func (s *T) Run_@(a string, b int) error {\n  return exec.Command(a)\n}\n)\nfunc two() {\n  g(1)\n}\n", (("Run_@", "a b", 1, 3), ("two", "", 5, 7)), (("exec.Command", 2), ("g", 6)), ((4, 4),)),
    Sample("java", "jvm", "class A {\n  void f_@(String s) throws E {\n    Object o = in.readObject();\n  }\n}\n}\n", (("f_@", "s", 2, 4),), (("in.readObject", 3),), ((6, 6),)),
    Sample("kt", "jvm", "fun f_@(a: String, b: Int): Int {\n  return g(a)\n}\n", (("f_@", "a b", 1, 3),), (("g", 2),)),
    Sample("js", "javascript", "function a_@(x) {\n  eval(x);\n}\nfunction b( {\n  y = [1, 2;\n}\nfunction c(z) {\n  run(z);\n}\n", (("a_@", "x", 1, 3), ("c", "z", 7, 9)), (("eval", 2), ("run", 8)), ((4, 6),)),
    Sample("ts", "javascript", "const go_@ = async (x: string): Promise<void> => {\n  await call<T>(x);\n}\nlast(1);\nopen = `\nx(2);\n", (("go_@", "x", 1, 3),), (("call", 2), ("last", 4)), ((5, 6),)),
    Sample("php", "php", "<?php\nfunction f_@($a, $b = 1) {\n  unserialize($a);\n}\n", (("f_@", "a b", 2, 4),), (("unserialize", 3),)),
    Sample("rs", "rust", "pub fn f_@<'a>(x: &'a str) -> i32 {\n  unsafe { p.read(); }\n}\n", (("f_@", "x", 1, 3),), (("p.read", 2),)),
    Sample("swift", "swift", "func f_@(a: Int, b c: String) -> Int {\n  let t = Process()\n}\n", (("f_@", "a b", 1, 3),), (("Process", 2),)),
    Sample("rb", "ruby", "class A\n  def go_@(x, y = 1)\n    if x\n      eval(x)\n    end\n    system \"ls #{x}\"\n  end\n  def one; 1; end\nend\ndef open_one(a)\n  b(a)\ndef two(c)\n  items.each do |i|\n    exec i\n  end\nend\n", (("go_@", "x y", 2, 7), ("one", "", 8, 8), ("two", "c", 12, 16)), (("eval", 4), ("system", 6), ("b", 11), ("exec", 14)), ((10, 11),)),
    Sample("py", "python", "x = request.args['a']\neval(x)\ndef (:\n  y\nz = 1\ndef ok_@(a, *b, c=1):\n    return a\nos.system(x)\n", (("ok_@", "a b c", 6, 7),), (("eval", 2), ("os.system", 8)), ((3, 4),)),
]


def _sample_files(spark, sf_dir):
    """A file for each customer, of one language after the other."""
    key = F.col("c_custkey")
    pick = lambda values: F.get(F.array(*[F.lit(v) for v in values]), (key % len(SAMPLES)).cast("int"))
    path = F.concat(F.lit("g/"), key.cast("string"), F.lit("."), pick([x.extension for x in SAMPLES]))
    return customers(spark, sf_dir).select(path.alias("path"), pick([x.language for x in SAMPLES]).alias("language"), F.replace(pick([x.text for x in SAMPLES]), F.lit("@"), key.cast("string")).alias("content"))


def _rows(values: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'" for v in row) + ")" for row in values)


_SAMPLES_SQL = f"""WITH samples(n, extension) AS (VALUES {_rows([(k, x.extension) for k, x in enumerate(SAMPLES)])}),
files AS (SELECT c_custkey AS k, n, 'g/' || CAST(c_custkey AS VARCHAR) || '.' || extension AS path FROM customer JOIN samples ON c_custkey % {len(SAMPLES)} = n),
functions(n, name, params, first, last) AS (VALUES {_rows([(k, *f) for k, x in enumerate(SAMPLES) for f in x.functions])}),
calls(n, name, line) AS (VALUES {_rows([(k, *c) for k, x in enumerate(SAMPLES) for c in x.calls])}),
uncertain(n, first, last) AS (VALUES {_rows([(k, *u) for k, x in enumerate(SAMPLES) for u in x.uncertain])}),
sizes(n, n_lines) AS (VALUES {_rows([(k, x.text.count(chr(10))) for k, x in enumerate(SAMPLES)])})"""


@query("a02_facts", f"{_SAMPLES_SQL} SELECT path, 'function' AS kind, replace(name, '@', CAST(k AS VARCHAR)) AS name, params, first AS line, last FROM files JOIN functions USING (n) UNION ALL SELECT path, 'call', name, '', line, line FROM files JOIN calls USING (n) UNION ALL SELECT path, 'uncertain', NULL, '', first, last FROM files JOIN uncertain USING (n)")
def a02(spark, sf_dir):
    """Functions with their parameters and lines, calls, and the ranges that can't be read, of a file of every language."""
    x = analyze.fact_rows(_sample_files(spark, sf_dir)).filter("kind in ('function', 'call', 'uncertain')")
    is_function, is_call = F.col("kind") == "function", F.col("kind") == "call"
    return x.select("path", "kind", F.when(is_call, F.col("qualified")).otherwise(F.col("name")).alias("name"), F.when(is_function, F.array_join("items", " ")).otherwise("").alias("params"), "line", F.when(is_call, F.col("line")).otherwise(F.col("end")).alias("last"))


@query("a03_node_classes", f"{LABELS} SELECT path, line FROM corpus WHERE path LIKE '%.py' AND contains(regexp_replace(text, '#.*$', ''), '(')")
def a03(spark, sf_dir):
    x = source_lines(spark, sf_dir, "path", "line", "classes").filter(F.col("path").endswith(".py"))
    return x.filter(F.array_contains("classes", "C")).select("path", "line")


@query("a04_allowed", f"{_SAMPLES_SQL} SELECT DISTINCT path, line FROM files JOIN calls USING (n)")
def a04(spark, sf_dir):
    """The lines on which rules for calls may fire, by the calls that the grammars find."""
    x = analyze.line_rows(_sample_files(spark, sf_dir), columns=["path", "language", "line", "text", "parsed", "classes"]).filter("parsed and array_contains(classes, 'C')")
    # the line that is only a member access counts as a call in Ruby
    return x.filter("not (language = 'ruby' and text like '%items.each%')").select("path", "line")


@query("a05_uncertain", f"{_SAMPLES_SQL} SELECT path, n_lines, coalesce(sum(last - first + 1), 0) AS unreliable, true AS parsed FROM files JOIN sizes USING (n) LEFT JOIN uncertain USING (n) GROUP BY path, n_lines")
def a05(spark, sf_dir):
    """Lines in uncertain ranges; the rest of each file is read."""
    return analyze.line_rows(_sample_files(spark, sf_dir), columns=["path", "reliable", "parsed"]).groupBy("path").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(~F.col("reliable")).alias("unreliable"), F.bool_and("parsed").alias("parsed"))


_CHAIN = 'a_@ = {source}["x"]\nb_@ = {step}\ndef helper(p_@):\n    return eval(p_@)\nif True:\n    eval(b_@)\nhelper(a_@)'
#: (source, step, rule fires at eval(b), depth, confidence)
_CHAINS = [("request.args", "a_@ + '!'", 3, "tainted"), ("request.form", "int(a_@)", 0, "candidate"), ("os.environ", "a_@", 3, "reachable"), ("settings", "a_@", 0, "candidate")]


def _chain_files(spark, sf_dir):
    """A file for each customer: a source, a step, a sink in a function and one outside of it."""
    key = F.col("c_custkey")
    texts = [_CHAIN.replace("{source}", s).replace("{step}", t) for s, t, _, _ in _CHAINS]
    content = F.replace(F.get(F.array(*[F.lit(t) for t in texts]), (key % 4).cast("int")), F.lit("@"), key.cast("string"))
    return customers(spark, sf_dir).select(F.concat(F.lit("c/"), key.cast("string"), F.lit(".py")).alias("path"), F.lit("python").alias("language"), content.alias("content"))


def chains(spark, sf_dir, between: bool = False):
    return kept(spark, sf_dir, f"chains-{between}", lambda: analyze.line_rows(_chain_files(spark, sf_dir), between, columns=["path", "line", "flows"]))


def _chain_flows(spark, sf_dir, between: bool = False):
    x = chains(spark, sf_dir, between).select("path", "line", F.explode("flows").alias("f"))
    return x.select("path", "line", F.col("f.rule_id").alias("rule_id"), F.col("f.depth").alias("depth"), F.col("f.remote").alias("remote"), F.transform("f.steps", lambda s: s["kind"]).alias("kinds"), "f.steps")


_PATH = "'c/' || CAST(c_custkey AS VARCHAR) || '.py' AS path"


@query("a06_functions", f"SELECT {_PATH}, 'helper' AS name, ['p_' || CAST(c_custkey AS VARCHAR)] AS params, 3 AS start_line, 4 AS end_line FROM customer")
def a06(spark, sf_dir):
    key = F.col("c_custkey")
    content = F.replace(F.lit(_CHAIN.replace("{source}", "x").replace("{step}", "1")), F.lit("@"), key.cast("string"))
    f = customers(spark, sf_dir).select(F.concat(F.lit("c/"), key.cast("string"), F.lit(".py")).alias("path"), F.lit("python").alias("language"), content.alias("content"))
    return analyze.fact_rows(f).filter("kind = 'function'").select("path", "name", F.col("items").alias("params"), F.col("start").alias("start_line"), F.col("end").alias("end_line"))


@query("a07_calls", f"{LABELS} SELECT path, line, regexp_extract(text, '(eval|os.system|pickle.loads|yaml.safe_load)[(]([a-z_0-9]+)', 1) AS qualified, regexp_extract(text, '(eval|os.system|pickle.loads|yaml.safe_load)[(]([a-z_0-9]+)', 2) AS first_argument FROM corpus WHERE path LIKE '%.py' AND regexp_matches(text, '^[a-z_0-9 =]*(eval|os.system|pickle.loads|yaml.safe_load)[(]')")
def a07(spark, sf_dir):
    x = _facts(spark, sf_dir).filter("kind = 'call' and qualified in ('eval', 'os.system', 'pickle.loads', 'yaml.safe_load')")
    return x.filter(F.col("path").endswith(".py")).select("path", "line", "qualified", F.col("text").alias("first_argument"))


@query("a08_scopes", f"SELECT {_PATH}, CAST(n AS INTEGER) AS line, CASE WHEN n IN (3, 4) THEN 3 ELSE 1 END AS scope_start FROM customer, range(1, 8) AS t(n)")
def a08(spark, sf_dir):
    """The innermost function around each line, by stabbing; the module where there is none."""
    x = analyze.line_rows(_chain_files(spark, sf_dir), columns=["path", "line"])
    f = analyze.fact_rows(_chain_files(spark, sf_dir)).filter("kind = 'function'").select("path", "start", "end")
    return stabbing.innermost(x, f, ["path"], "line", "start", "end").select("path", "line", F.coalesce("start", F.lit(1)).cast("int").alias("scope_start"))


def _each(name: str, sql: str, extension: str, content: str, pick) -> None:
    """A query over a file for each customer, @ in its content is the key."""
    language = {"py": "python"}.get(extension, "javascript")

    @query(name, f"WITH files AS (SELECT c_custkey AS k, 'c/' || CAST(c_custkey AS VARCHAR) || '.{extension}' AS path FROM customer) {sql}")
    def run(spark, sf_dir):
        key = F.col("c_custkey").cast("string")
        path, text = F.concat(F.lit("c/"), key, F.lit(f".{extension}")), F.replace(F.lit(content), F.lit("@"), key)
        return pick(customers(spark, sf_dir).select(path.alias("path"), F.lit(language).alias("language"), text.alias("content")))


_each("a09_interpolations", "SELECT path, 1 AS line, t AS text FROM files, (VALUES (1), (2)) AS l(n), LATERAL (SELECT CASE n WHEN 1 THEN '{name_' || CAST(k AS VARCHAR) || '}' ELSE '{other}' END AS t)", "py", "x = f'{name_@} and {other}'\n", lambda f: analyze.fact_rows(f).filter("kind = 'interpolation'").select("path", "line", "text"))
_JS = "const {exec: run@, spawn} = require('child_process');\nimport * as cp from 'node:child_process';\nrun@(a);\nspawn('ls');\ncp.execSync(b);\nfunction f(run@) { run@(a); }\n"
_each("a10_command_bindings", "SELECT path, line, shell FROM files, (VALUES (3, true), (4, false), (5, true)) AS l(line, shell)", "js", _JS, lambda f: analyze.line_rows(f, columns=["path", "line", "shell"]).filter("shell is not null").select("path", "line", "shell"))
_each("a11_shadowing", "SELECT path, 6 AS line FROM files", "js", _JS, lambda f: analyze.line_rows(f, columns=["path", "line", "shadowed"]).filter("shadowed").select("path", "line"))
_each("a13_components", "SELECT path, 4 AS line, 'SR004' AS rule_id FROM files", "vue", "<template><p>eval(x)</p></template>\n<script>\nconst a@ = req.query.x;\neval(a@);\n</script>\n", lambda f: analyze.match_rows(f).select("path", "line", "rule_id"))


@query("a12_repairs", f"{LABELS} SELECT path, line FROM corpus WHERE contains(text, 'requests.put(')")
def a12(spark, sf_dir):
    """The lines of the byte ranges that a repair would change."""
    r = _facts(spark, sf_dir).filter("kind = 'repair'").select("path", "start")
    x = source_files(spark, sf_dir).join(r, "path")
    head = F.decode(F.substring(F.encode("content", "UTF-8"), F.lit(1), F.col("start")), "UTF-8")
    return x.select("path", F.size(F.split(head, "\n")).alias("line"))


@query("t01_scope_environment", f"SELECT {_PATH}, line, CASE WHEN line = 6 AND c_custkey % 4 IN (0, 2) THEN 1 ELSE 0 END AS n_flows FROM customer, (VALUES (4), (6)) AS l(line)")
def t01(spark, sf_dir):
    """A function's parameter hides what the module knows: evidence outside of the function, none inside without following calls."""
    return chains(spark, sf_dir).filter("line in (4, 6)").select("path", "line", F.size("flows").alias("n_flows"))


_SOURCES = [*taint.REMOTE, *taint.LOCAL]


@query("t02_sources", f"{LABELS} SELECT path, line FROM corpus WHERE " + " OR ".join(f"contains(CASE WHEN contains(text, '=') THEN substr(text, strpos(text, '=') + 1) ELSE text END, '{s}')" for s in _SOURCES))
def t02(spark, sf_dir):
    right = F.when(F.instr("text", "=") > 0, F.substring("text", F.instr("text", "=") + 1, F.length("text"))).otherwise(F.col("text"))
    return source_lines(spark, sf_dir, "path", "line", "text").filter(right.rlike(taint.SOURCE_PATTERN)).select("path", "line")


_FLOWS = f"SELECT {_PATH}, 6 AS line, 'SR004' AS rule_id, 3 + CASE WHEN true THEN 1 ELSE 0 END - 1 AS depth, c_custkey % 4 = 0 AS remote FROM customer WHERE c_custkey % 4 IN (0, 2)"


@query("t03_propagation", _FLOWS)
def t03(spark, sf_dir):
    return _chain_flows(spark, sf_dir).filter("line = 6").select("path", "line", "rule_id", "depth", "remote")


@query("t04_assign_kill", f"SELECT {_PATH}, ['source', 'propagation', 'sink'] AS kinds FROM customer WHERE c_custkey % 4 IN (0, 2)")
def t04(spark, sf_dir):
    return _chain_flows(spark, sf_dir).filter("line = 6").select("path", "kinds")


@query("t05_sanitizers", f"SELECT {_PATH} FROM customer WHERE c_custkey % 4 NOT IN (0, 2)")
def t05(spark, sf_dir):
    """Files whose value is cast or never tainted: no evidence at the sink."""
    x = chains(spark, sf_dir)
    return x.select("path").distinct().join(_chain_flows(spark, sf_dir).filter("line = 6").select("path"), "path", "left_anti")


_each("t06_sql_argument", "SELECT path, 3 AS line FROM files", "py", "name_@ = request.args['n']\nq = 'SELECT ' + name_@\ndb.execute(q)\ndb.execute('SELECT 1', (name_@,))\n", lambda f: analyze.match_rows(f).filter("rule_id = 'SR011'").select("path", "line"))


@query("t07_sinks", f"{LABELS} SELECT path, line, rule_id FROM expected WHERE rule_id IN ('SR012', 'SR015', 'SR016', 'SR021')")
def t07(spark, sf_dir):
    return source_lines(spark, sf_dir, "path", "line", "flows").select("path", "line", F.explode("flows").alias("f")).select("path", "line", F.col("f.rule_id").alias("rule_id"))


@query("t08_one_call", f"SELECT {_PATH}, 4 AS line, 3 AS depth, ['source', 'call', 'sink'] AS kinds FROM customer WHERE c_custkey % 4 IN (0, 1, 2)")
def t08(spark, sf_dir):
    return _chain_flows(spark, sf_dir, True).filter("line = 4").select("path", "line", "depth", "kinds")


@query("t09_trace_bounds", f"SELECT {_PATH}, CAST(c_custkey % 20 + 3 AS INTEGER) AS depth, CAST(least(c_custkey % 20 + 2, 8) + 1 AS INTEGER) AS kept, 'source' AS first, 'sink' AS last FROM customer")
def t09(spark, sf_dir):
    """Chains of 1 to 20 steps: the depth is counted on where steps are no longer kept."""
    key = F.col("c_custkey")
    steps = F.transform(F.sequence(F.lit(1), (key % 20 + 1).cast("int")), lambda k: F.concat(F.lit("v"), k.cast("string"), F.lit(" = v"), (k - 1).cast("string"), F.lit("\n")))
    content = F.concat(F.lit("v0 = request.args['x']\n"), F.array_join(steps, ""), F.lit("eval(v"), (key % 20 + 1).cast("string"), F.lit(")\n"))
    f = customers(spark, sf_dir).select(F.concat(F.lit("c/"), key.cast("string"), F.lit(".py")).alias("path"), F.lit("python").alias("language"), content.alias("content"))
    e = F.col("evidence")
    return analyze.match_rows(f).select("path", e["depth"].alias("depth"), F.size(e["steps"]).alias("kept"), F.get(e["steps"], F.lit(0))["kind"].alias("first"), F.element_at(e["steps"], -1)["kind"].alias("last"))


@query("t10_confidence", f"{LABELS} SELECT CASE WHEN rule_id IN ('SR012', 'SR015', 'SR016', 'SR021') THEN 'tainted' ELSE 'candidate' END AS confidence, count(*) AS n FROM expected GROUP BY 1")
def t10(spark, sf_dir):
    return new_findings(spark, sf_dir).groupBy("confidence").agg(F.count(F.lit(1)).alias("n"))


@query("t11_engine", f"{LABELS} SELECT path, line, rule_id, CASE WHEN path LIKE '%/.env.env' THEN 'lexical' ELSE 'ast' END AS engine FROM expected")
def t11(spark, sf_dir):
    return new_findings(spark, sf_dir).select("path", "line", "rule_id", "engine")


@query("t12_unreliable_lines", f"SELECT {_PATH}, CAST(n AS INTEGER) AS line, c_custkey % 2 = 0 OR n <> 4 AS reliable, CASE WHEN n = 2 THEN 1 WHEN n = 5 AND c_custkey % 2 = 0 THEN 1 ELSE 0 END AS n_flows FROM customer, range(1, 6) AS t(n)")
def t12(spark, sf_dir):
    """Every other file has a line that can't be read: what was known before it is known no longer."""
    key = F.col("c_custkey")
    content = F.concat(F.lit("x = request.args['a']\neval(x)\ny = x\n"), F.when(key % 2 == 0, "z = 1\n").otherwise("def (:\n"), F.lit("eval(y)\n"))
    f = customers(spark, sf_dir).select(F.concat(F.lit("c/"), key.cast("string"), F.lit(".py")).alias("path"), F.lit("python").alias("language"), content.alias("content"))
    return analyze.line_rows(f, columns=["path", "line", "reliable", "flows"]).select("path", "line", "reliable", F.size("flows").alias("n_flows"))


@query("t13_sink_rules", f"{LABELS} SELECT rule_id, count(*) AS n FROM expected WHERE rule_id IN ('SR004', 'SR005', 'SR006', 'SR011', 'SR012', 'SR015', 'SR016', 'SR021') GROUP BY rule_id")
def t13(spark, sf_dir):
    """Findings of the rules that are sinks."""
    from glintsieve.operators import rules

    return new_findings(spark, sf_dir).filter(F.col("rule_id").isin(*[r.rule_id for r in rules.SINKS])).groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))
