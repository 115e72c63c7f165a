"""Queries: the scan itself, the rule bank, the lexer, predicates, gates and settings."""

from __future__ import annotations

from pyspark.sql import functions as F

from glintsieve.functions import credentials as C
from glintsieve.functions import predicates as P
from glintsieve.functions import text as T
from glintsieve.operators import analyze, parts, rules
from glintsieve.plans import corpus, scan
from glintsieve.queries.registry import LABELS, PATHS, all_matches, new_findings, paths, query, source_files, source_lines, table
from glintsieve.sources import languages

FINDING = "rule_id || chr(0) || path || chr(0) || sha256(text)"


@query("scan_findings", f"{LABELS} SELECT path, line, rule_id, severity, sha256({FINDING}) AS fingerprint FROM expected")
def scan_findings(spark, sf_dir):
    """The flagship: every finding of the corpus with its fingerprint."""
    found = scan.scan(corpus.files(spark, sf_dir), scan.Settings(max_findings=None))
    return found.select("path", "line", "rule_id", "severity", "fingerprint")


def _rule_query(rule: rules.Rule) -> None:
    n = int(rule.rule_id[2:])
    sql = f"{LABELS} SELECT path, line, severity FROM expected WHERE rule_id = '{rule.rule_id}'"

    @query(f"r{n:02d}_{rule.name.replace('-', '_')}", sql)
    def run(spark, sf_dir):
        x = analyze.match_rows(source_files(spark, sf_dir), only=[rule.rule_id])
        return x.select("path", "line", scan.severity(scan.Settings()).alias("severity"))


for _rule in rules.RULES:
    _rule_query(_rule)


# --- predicates over raw template lines ----------------------------------------------------------

I = "[A-Za-z0-9_]"  # noqa: E741
_raw = lambda spark, sf_dir: corpus.rows(spark, sf_dir).withColumn("code", F.col("text")).withColumn("visible", F.col("text"))


def _predicate(name: str, condition, sql: str) -> None:
    @query(name, f"{LABELS} SELECT path, line FROM corpus WHERE {sql}")
    def run(spark, sf_dir):
        return _raw(spark, sf_dir).filter(condition()).select("path", "line")


_predicate("p01_contains_token", lambda: F.col("code").rlike(P.java(P.token_pattern(["unsafe"]))), rf"regexp_matches(text, '(^|[^A-Za-z0-9_])unsafe([^A-Za-z0-9_]|$)')")
_predicate("p02_contains_call", lambda: F.col("code").rlike(P.java(P.call_pattern(["eval"]))), rf"regexp_matches(text, '(^|[^A-Za-z0-9_])eval\s*\(')")
_predicate("p03_contains_any_call", lambda: F.col("code").rlike(P.java(P.call_pattern(rules.COMMANDS["python"]))), rf"regexp_matches(text, '(^|[^A-Za-z0-9_])(os\.system|subprocess\.run)\s*\(')")
_predicate("p04_command_words", lambda: (F.col("path").endswith(".rb")) & F.col("code").rlike(P.java(P.command_pattern(rules.RUBY_EVALS))), rf"path LIKE '%.rb' AND regexp_matches(text, '^eval\(')")
_predicate("p08_flag_value", lambda: F.col("code").rlike(P.java(P.flag_pattern("verify", "False"))), rf"regexp_matches(text, '(^|[^A-Za-z0-9_])verify\s*[=:,]\s*False([^A-Za-z0-9_]|$)')")
_predicate("p10_taint_source", lambda: F.col("text").rlike(P.any_of(["request.args", "request.form", "req.query"])), r"contains(text, 'request.args') OR contains(text, 'request.form') OR contains(text, 'req.query')")
_predicate("p11_sql_sink", lambda: F.regexp_extract("text", r"([A-Za-z_$]+)\s*\(", 1).isin(*rules.SQL_APIS), r"regexp_extract(text, '([A-Za-z_$]+)\s*\(', 1) IN ('execute', 'executemany', 'query', 'rawQuery', 'createStatement', 'raw', 'prepare')")

_NAME = "c_mktsegment"
_TARGETS = ["userPassword", "api_key", "passwordHash", "tokenizer", "myApiKey", "service_role", "count", "clientSecret", "SECRET", "apikey2"]
_IS_NAME = [True, False, True, False, True, True, False, True, True, False]


@query("p05_secret_name", f"SELECT c_custkey, ({_TARGETS!r})[CAST(1 + c_custkey % {len(_TARGETS)} AS BIGINT)] AS name, ([{', '.join(str(x).lower() for x in [True, True, True, False, True, True, False, True, True, False])}])[CAST(1 + c_custkey % {len(_TARGETS)} AS BIGINT)] AS is_secret FROM customer")
def p05(spark, sf_dir):
    name = F.get(F.array(*[F.lit(x) for x in _TARGETS]), (F.col("c_custkey") % len(_TARGETS)).cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", name.alias("name")).withColumn("is_secret", C.secret_name(F.col("name")))


_HOLDERS = ["changeme", "CHANGEME", "<your key>", "${KEY}", "a{{b}}c", "xxxxxxxx", "hunter2-real", "test key", "exampleX"]


@query("p06_placeholder", f"WITH v AS (SELECT c_custkey, ({_HOLDERS!r})[CAST(1 + c_custkey % {len(_HOLDERS)} AS BIGINT)] AS v FROM customer) SELECT c_custkey, v, lower(v) IN ('changeme','password','your-key-here','example','test','test key','secret_key','dummy','redacted') OR starts_with(v, '<') OR contains(v, '${{') OR contains(v, '{{{{') OR replace(v, v[1], '') = '' AS holder FROM v")
def p06(spark, sf_dir):
    v = F.get(F.array(*[F.lit(x) for x in _HOLDERS]), (F.col("c_custkey") % len(_HOLDERS)).cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", v.alias("v")).withColumn("holder", C.placeholder(F.col("v")))


@query("p07_secret_assignment", f"{LABELS} SELECT DISTINCT path, line FROM expected WHERE rule_id IN ('SR007', 'SR013')")
def p07(spark, sf_dir):
    x = source_lines(spark, sf_dir, "path", "line", "visible", "literals")
    return x.filter(C.secret_assignment(F.col("visible"), F.col("literals"))).select("path", "line")


@query("p09_variable_path", f"{LABELS} SELECT path, line FROM corpus WHERE starts_with(text, 'open(')")
def p09(spark, sf_dir):
    return source_lines(spark, sf_dir, "path", "line", "path_call").filter("path_call").select("path", "line")


_SUPPRESS = ["x  # scan:skip", "x  # scan:skip[SR004]", "x  # scan:skip[SR005]", "x  # noscan:skip", "x  # scan:skipped", "'scan:skip'", "x  # scan:skip */"]


@query("p12_suppressed", f"SELECT o_orderkey, (o_orderkey % {len(_SUPPRESS)}) IN (0, 1, 6) AS hidden FROM orders")
def p12(spark, sf_dir):
    text = F.get(F.array(*[F.lit(x) for x in _SUPPRESS]), (F.col("o_orderkey") % len(_SUPPRESS)).cast("int"))
    comments = F.when(text.contains("#"), F.regexp_extract(text, "(#.*)$", 1)).otherwise("")
    return table(spark, sf_dir, "orders").select("o_orderkey", T.suppressed(comments, F.lit("SR004"), "scan:skip").alias("hidden"))


@query("p13_rule_enabled", f"{LABELS} SELECT path, line, rule_id FROM expected WHERE rule_id IN ('SR004', 'SR005') AND rule_id <> 'SR005'")
def p13(spark, sf_dir):
    s = scan.Settings(enabled=("SR004", "SR005"), disabled=("SR005",))
    return new_findings(spark, sf_dir).filter(scan.rule_enabled(F.col("rule_id"), F.col("path"), s)).select("path", "line", "rule_id")


_OVERRIDES = scan.Settings(fail_on="high", overrides=(scan.Override("src/m1*/**", ("SR009",), "info"), scan.Override("**/*.c", ("SR002",), "medium")))


@query("p14_overrides", f"{LABELS} SELECT path, line, rule_id, CASE WHEN path LIKE '%.c' THEN 'medium' WHEN path LIKE 'src/m1%' THEN 'info' ELSE 'high' END AS fail_on FROM expected WHERE NOT (path LIKE 'src/m1%' AND rule_id = 'SR009') AND NOT (path LIKE '%.c' AND rule_id = 'SR002')")
def p14(spark, sf_dir):
    x = new_findings(spark, sf_dir).filter(scan.rule_enabled(F.col("rule_id"), F.col("path"), _OVERRIDES))
    return x.select("path", "line", "rule_id", scan.threshold(F.col("path"), _OVERRIDES).alias("fail_on"))


@query("p15_file_class", PATHS + """
SELECT o_orderkey, path, CASE
  WHEN list_has_any(string_split(lower(path), '/'), ['vendor', 'node_modules', 'third_party', 'deps']) THEN 'vendored'
  WHEN contains(lower(path), '.min.') OR contains(lower(path), '.generated.') OR list_contains(string_split(lower(path), '/'), 'generated') THEN 'generated'
  WHEN list_has_any(string_split(lower(path), '/'), ['examples', 'example', 'samples']) THEN 'example'
  WHEN list_has_any(string_split(lower(path), '/'), ['test', 'tests', 'spec', '__tests__', 'fixtures']) OR lower(path) LIKE '%\\_test.go' ESCAPE '\\' OR contains(lower(path), '.test.') OR contains(lower(path), '.spec.')
    OR starts_with(string_split(lower(path), '/')[-1], 'test_') OR string_split(lower(path), '/')[-1] = 'conftest.py' THEN 'test'
  ELSE 'production' END AS file_class FROM paths""")
def p15(spark, sf_dir):
    return paths(spark, sf_dir).select("o_orderkey", "path", languages.file_class(F.col("path")).alias("file_class"))


@query("p16_severity_threshold", f"{LABELS} SELECT path, line, rule_id, severity FROM expected WHERE severity IN ('medium', 'high')")
def p16(spark, sf_dir):
    return new_findings(spark, sf_dir).filter(scan.rank(F.col("severity")) >= 1).select("path", "line", "rule_id", "severity")


@query("p17_syntax_gate", f"{LABELS} SELECT path, line, rule_id FROM expected WHERE path LIKE '%.py' OR path LIKE '%.c'")
def p17(spark, sf_dir):
    return scan.matched(source_lines(spark, sf_dir)).filter(F.col("path").rlike(r"\.(py|c)$")).select("path", "line", "rule_id")


# --- the lexer -----------------------------------------------------------------------------------


@query("l01_lines", "SELECT doc_id, CAST(n AS INTEGER) AS line, rtrim(t, chr(13)) AS text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n, len(string_split(text, chr(10))) AS m FROM documents) WHERE NOT (n = m AND t = '')")
def l01(spark, sf_dir):
    """Line split of every document."""
    x = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "text"), F.size(F.split("text", "\n")).alias("m"))
    return x.filter(~((F.col("n") == F.col("m") - 1) & (F.col("text") == ""))).select("doc_id", (F.col("n") + 1).alias("line"), F.regexp_replace("text", "\r$", "").alias("text"))


@query("l02_masks", f"{LABELS} SELECT path, line, CAST(octet_length(encode(text)) AS INTEGER) AS n_bytes FROM corpus")
def l02(spark, sf_dir):
    """Views keep a line's width in bytes."""
    x = source_lines(spark, sf_dir, "path", "language", "line", "text", "visible", "masked").filter("octet_length(visible) = octet_length(text) and octet_length(masked) = octet_length(text) or language = 'config'")
    return x.select("path", "line", F.octet_length("text").alias("n_bytes"))


@query("l03_code_view", f"""{LABELS} SELECT path, line, text AS code FROM corpus WHERE NOT regexp_matches(text, '["''`#]|//|/[*]')""")
def l03(spark, sf_dir):
    """The code view is the text where there is no string and no comment."""
    return source_lines(spark, sf_dir, "path", "line", "text", "code").filter(~F.col("text").rlike("[\"'`#]|//|/[*]")).select("path", "line", "code")


@query("l04_visible_masked", f"{LABELS} SELECT path, line, regexp_replace(text, '#.*$', '') AS visible FROM corpus WHERE path LIKE '%.py'")
def l04(spark, sf_dir):
    return source_lines(spark, sf_dir, "path", "line", "text", "visible", "comments").filter(F.col("path").endswith(".py")).select("path", "line", F.when(F.col("comments") == "", F.col("visible")).otherwise(F.substring("visible", F.lit(1), F.instr("text", "#") - 1)).alias("visible"))


_QUOTED = '"[^"]*"'


@query("l05_literals", f"{LABELS} SELECT path, line, regexp_extract_all(text, '{_QUOTED}') AS literals FROM corpus WHERE path LIKE '%.py'")
def l05(spark, sf_dir):
    return source_lines(spark, sf_dir, "path", "line", "literals").filter(F.col("path").endswith(".py")).select("path", "line", "literals")


@query("l06_comments", f"{LABELS} SELECT path, line, regexp_extract(text, '#.*$') || ' ' AS comments FROM corpus WHERE path LIKE '%.py' AND contains(text, '#')")
def l06(spark, sf_dir):
    return source_lines(spark, sf_dir, "path", "line", "comments").filter(F.col("path").endswith(".py") & (F.col("comments") != "")).select("path", "line", "comments")


@query("l07_block_comments", f"{LABELS} SELECT path, line FROM corpus WHERE path LIKE '%.c' AND contains(text, '/*')")
def l07(spark, sf_dir):
    return source_lines(spark, sf_dir, "path", "line", "comments").filter(F.col("path").endswith(".c") & (F.col("comments") != "")).select("path", "line")


def _lexed(name: str, language: str, text: str, expected: list[tuple[str, list[str]]]) -> None:
    """The visible text and the literals of each line of a file for every nation; @ is its number."""
    row = lambda k, visible, literals: f"({k}, {_text(visible)}, [{', '.join(map(_text, literals))}]::VARCHAR[])"
    own = "replace({}, '@', CAST(n_nationkey AS VARCHAR))"

    @query(name, f"SELECT 'f' || CAST(n_nationkey AS VARCHAR) || '.x' AS path, CAST(line AS INTEGER) AS line, {own.format('visible')} AS visible, list_transform(literals, lambda x: {own.format('x')}) AS literals, true AS complete FROM nation, (VALUES {', '.join(row(k, *e) for k, e in enumerate(expected, 1))}) AS t(line, visible, literals)")
    def run(spark, sf_dir):
        key = F.col("n_nationkey").cast("string")
        n = table(spark, sf_dir, "nation").select(F.concat(F.lit("f"), key, F.lit(".x")).alias("path"), F.lit(language).alias("language"), F.replace(F.lit(text), F.lit("@"), key).alias("content"))
        return analyze.line_rows(n).select("path", "line", "visible", "literals", "complete")


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_lexed("l08_quotes", "csharp", 'a = $"x@""y"; c = "q\\"r@";', [('a = $"x@""y"; c = "q\\"r@";', ['"x@""y"', '"q\\"r@"'])])
_lexed("l09_triple_quotes", "python", "a = \'\'\'x@\ny\'\'\'\nb = \"\"\"z\"\"\"  # no", [("a = \'\'\'x@", ["\'\'\'x@"]), ("y\'\'\'", ["y\'\'\'"]), ("b = \"\"\"z\"\"\"      ", ["\"\"\"z\"\"\""])])
_lexed("l10_raw_strings", "rust", "let a = r#\"x\"y@\"#; fn f<\'a>(x: &\'a str) { \'c\' }", [("let a = r#\"x\"y@\"#; fn f<\'a>(x: &\'a str) { \'c\' }", ["r#\"x\"y@\"#", "\'c\'"])])
_lexed("l11_regex_literals", "javascript", "var r = /a[/]b/g; x = a / b; t = \"s@\"; return /x/;", [("var r =         ; x = a / b; t = \"s@\"; return    ;", ["\"s@\""])])


#: Files whose tokens go on over lines: by extension, the lines that a row adds, with what is visible of them and their literals; @ is the row's key.
_CROSSING = [
    ("rs", [('let a_@ = r#"raw @', 'let a_@ = r#"raw @', ['r#"raw @']), ('"still" @"#; /* open /* in */', '"still" @"#; ' + " " * 16, ['"still" @"#']), ("eval */ let b_@ = 1;", " " * 7 + " let b_@ = 1;", [])]),
    ("py", [("a_@ = \'\'\'open @", "a_@ = \'\'\'open @", ["\'\'\'open @"]), ("# text", "# text", ["# text"]), ("end @\'\'\' # gone", "end @\'\'\'       ", ["end @\'\'\'"])]),
    ("js", [("a_@ = `open @", "a_@ = `open @", ["`open @"]), ("/* text */ // text", "/* text */ // text", ["/* text */ // text"]), ("` + /x[/]y/; // c", "` +        ;     ", ["`"])]),
    ("go", [("a_@ := `raw @", "a_@ := `raw @", ["`raw @"]), ('"in" @`; /* note', '"in" @`;' + " " * 8, ['"in" @`']), ('*/ b_@ := "s@"', '   b_@ := "s@"', ['"s@"'])]),
]
_CROSSING_SQL = ", ".join(f"({k}, '{e}', {j}, {_text(visible)}, [{', '.join(map(_text, literals))}]::VARCHAR[])" for k, (e, lines) in enumerate(_CROSSING) for j, (_, visible, literals) in enumerate(lines))


@query("l02_large_files", f"""
    WITH placed AS (SELECT o_orderkey, CAST(o_orderkey % {len(_CROSSING)} AS INTEGER) AS kind, o_orderkey // {corpus.KEYS} AS folder FROM orders),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY kind, folder ORDER BY o_orderkey) - 1 AS n FROM placed),
    crossing(kind, extension, j, visible, literals) AS (VALUES {_CROSSING_SQL})
    SELECT 'src/m' || CAST(folder AS VARCHAR) || '/large.' || extension AS path, CAST(3 * n + j + 1 AS BIGINT) AS line, replace(visible, '@', CAST(o_orderkey AS VARCHAR)) AS visible,
           list_transform(literals, lambda x: replace(x, '@', CAST(o_orderkey AS VARCHAR))) AS literals, true AS complete
    FROM numbered JOIN crossing USING (kind)""")
def l02_large(spark, sf_dir):
    """Files lexed by parts of 2,000 characters, most of which begin or end inside of a token."""
    key = F.col("o_orderkey")
    own = F.get(F.array(*[F.lit("\n".join(text for text, _, _ in lines)) for _, lines in _CROSSING]), (key % len(_CROSSING)).cast("int"))
    extension = F.get(F.array(*[F.lit(e) for e, _ in _CROSSING]), (key % len(_CROSSING)).cast("int"))
    path = F.concat(F.lit("src/m"), F.floor(key / corpus.KEYS).cast("string"), F.lit("/large."), extension)
    rows = table(spark, sf_dir, "orders").select(path.alias("path"), F.struct(key.alias("k"), F.replace(own, F.lit("@"), key.cast("string")).alias("text")).alias("x"))
    files = rows.groupBy("path").agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["text"]), "\n").alias("content"))
    views, complete = parts.lexed(files.withColumn("language", languages.language(F.col("path"))), 2000)
    return views.join(complete, "path").select("path", "line", "visible", "literals", "complete")


@query("l12_complete_files", f"{LABELS} SELECT path, true AS complete FROM corpus GROUP BY path")
def l12(spark, sf_dir):
    return source_lines(spark, sf_dir, "path", "complete").groupBy("path").agg(F.bool_and("complete").alias("complete"))


@query("l13_identifiers", "SELECT p_partkey, len(regexp_extract_all(p_name || '$x_1 ' || p_brand, '[A-Za-z0-9_]')) AS n FROM part")
def l13(spark, sf_dir):
    text = F.concat("p_name", F.lit("$x_1 "), "p_brand")
    return table(spark, sf_dir, "part").select("p_partkey", F.size(F.regexp_extract_all(text, F.lit(P.JAVA_IDENTIFIER), F.lit(0))).cast("long").alias("n"))


@query("s23_config_lines", f"{LABELS} SELECT path, line, [string_split(text, '=')[2]] AS literals FROM corpus WHERE path LIKE '%/.env.env'")
def s23(spark, sf_dir):
    return source_lines(spark, sf_dir, "path", "language", "line", "literals").filter("language = 'config'").select("path", "line", "literals")


@query("j09_rule_dimension", f"{LABELS} SELECT path, line, rule_id, CASE severity_of WHEN 'high' THEN 'error' WHEN 'medium' THEN 'warning' ELSE 'note' END AS sarif_level FROM (SELECT path, line, rule_id, CASE WHEN rule_id = 'SR005' THEN 'medium' ELSE severity END AS severity_of FROM expected)")
def j09(spark, sf_dir):
    return new_findings(spark, sf_dir).join(F.broadcast(rules.table(spark).select("rule_id", "sarif_level")), "rule_id").select("path", "line", "rule_id", "sarif_level")


@query("x03_parallel_scan", f"{LABELS} SELECT path, line, rule_id FROM expected")
def x03(spark, sf_dir):
    """The same findings, whatever the number of partitions."""
    return scan.matched(analyze.line_rows(source_files(spark, sf_dir).repartition(7))).select("path", "line", "rule_id")


@query("r07a_provider_tokens", "SELECT c_custkey, c_custkey % 6 IN (0, 2, 4) AS is_token FROM customer")
def r07a(spark, sf_dir):
    import zlib

    body = "abcdefghijklmnopqrstuvwxyz0123"
    n, digits = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, k = divmod(n, 62)
        digits = C.BASE62[k] + digits
    kinds = ["AKIA" + "0" * 16, "AKIAshort", "sk_live_" + "0" * 32, "ghp_" + body + "000000", "ghp_" + body + digits, "eyJhbGciOiJIUzI1NiJ9.e30.x"]
    v = F.get(F.array(*[F.lit(x) for x in kinds]), (F.col("c_custkey") % 6).cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", C.provider(v).alias("is_token"))


@query("g02_coverage", f"{LABELS} SELECT (SELECT count(DISTINCT path) FROM corpus) AS supported_files, CAST((SELECT sum(n) FROM (SELECT sum(octet_length(encode(text)) + 1) - 1 AS n FROM corpus GROUP BY path)) AS BIGINT) AS total_bytes, (SELECT count(*) FROM expected) AS total")
def g02(spark, sf_dir):
    return scan.sizes(source_files(spark, sf_dir)).crossJoin(scan.counts(all_matches(spark, sf_dir))).select("supported_files", "total_bytes", "total")  # one row each
