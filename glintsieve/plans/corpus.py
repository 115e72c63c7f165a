"""A source corpus made from table rows: each order is a line of code, drawn from labelled templates.

Spark builds files from it for the scanner; an SQL oracle builds the labels, which no scanner code touches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: (extension, line with @ for a number, rule that fires or None, severity)
TEMPLATES: list[tuple[str, str, str | None, str | None]] = [
    ("py", "value_@ = eval(expression_@)", "SR004", "high"),
    ("py", "print(\"eval(value_@)\")  # eval(other_@)", None, None),
    ("py", "os.system(command_@)", "SR005", "high"),
    ("py", "subprocess.run([\"ls\", name_@])", "SR005", "info"),
    ("py", "subprocess.run(name_@)", "SR005", "medium"),
    ("py", "pickle.loads(payload_@)", "SR006", "high"),
    ("py", "yaml.safe_load(payload_@)", None, None),
    ("py", "password = \"hunter-@-secret\"", "SR007", "high"),
    ("py", "password = get_value(@)", None, None),
    ("py", "digest_@ = hashlib.md5(data_@)", "SR008", "medium"),
    ("py", "digest_@ = hashlib.md5(data_@, usedforsecurity=False)", None, None),
    ("py", "roll_@ = random.randint(1, @)", "SR009", "info"),
    ("py", "requests.put(address_@, verify=False)", "SR010", "high"),
    ("py", "cursor.execute(\"SELECT a FROM t@ WHERE x=\" + clause_@)", "SR011", "medium"),
    ("py", "cursor.execute(\"SELECT a FROM t@ WHERE x=?\", (clause_@,))", None, None),
    ("py", "open(request.args[\"p@\"])", "SR012", "medium"),
    ("py", "open(fixed_@)", None, None),
    ("py", "application_@.run(debug=True)", "SR014", "high"),
    ("py", "render_template_string(request.form[\"t@\"])", "SR015", "high"),
    ("py", "fetch(request.args[\"u@\"])", "SR016", "high"),
    ("py", "claims_@ = jwt.decode(body_@, verify=False)", "SR017", None),
    ("py", "tool_@ = PythonREPLTool()", "SR022", "high"),
    ("py", "count_@ = count_@ + @", None, None),
    ("c", "strcpy(target_@, source_@);", "SR001", "high"),
    ("c", "memcpy(target_@, source_@, @);", "SR002", "info"),
    ("c", "/* strcpy(a_@, b) */ total_@ += @;", None, None),
    ("c", "int roll_@ = rand();", "SR009", "info"),
    ("rs", "unsafe { pointer_@.read(); }", "SR003", "medium"),
    ("rs", "let text_@ = \"unsafe @\";", None, None),
    ("js", "const roll_@ = Math.random();", "SR009", "info"),
    ("js", "const roll_@ = crypto.randomUUID();", None, None),
    ("js", "element_@.innerHTML = req.query.part@;", "SR015", "high"),
    ("js", "const NEXT_PUBLIC_TOKEN = \"public-@-token-value\";", "SR013", "high"),
    ("js", "cookie_@.set({ secure: false });", "SR019", "high"),
    ("env", "API_TOKEN=live-value-@", "SR007", "high"),
    ("env", "API_TOKEN=${TOKEN_@}", None, None),
    ("rb", "eval(source_@)", "SR004", "high"),
    ("rb", "def eval(source_@)", None, None),
    ("php", "<?php $data_@ = unserialize($body_@); ?>", "SR006", "high"),
    ("go", "out_@ := exec.Command(name_@)", "SR005", "medium"),
    ("java", "Object o_@ = in_@.readObject();", "SR006", "high"),
    ("cs", "var x_@ = Process.Start(name_@);", "SR005", "medium"),
    ("swift", "let task_@ = Process()", "SR005", "medium"),
    ("js", "const sharing_@ = cors({ origin: \"*\", credentials: true });", "SR018", "high"),
    ("js", "const SERVICE_ROLE_TOKEN = \"role-@-token-value\";", "SR020", "high"),
    ("js", "collection.find({ $where: req.query.w@ });", "SR021", "high"),
]
#: Rules that fire beside the labelled one: a cross-check that the labels state everything.
ALSO = {
    "claims_@ = jwt.decode(body_@, verify=False)": [("SR010", "high"), ("SR017", "high")],
    "const NEXT_PUBLIC_TOKEN = \"public-@-token-value\";": [("SR007", "high"), ("SR013", "high")],
    "const SERVICE_ROLE_TOKEN = \"role-@-token-value\";": [("SR007", "high"), ("SR020", "high")],
}
#: Keys of a folder: files have a bounded size however many rows there are.
KEYS = 1000


def labels() -> list[tuple[int, str, str]]:
    """(template, rule, severity) of every rule that fires."""
    out = []
    for k, (_, text, rule, severity) in enumerate(TEMPLATES):
        for r, s in ALSO.get(text, [(rule, severity)] if rule else []):
            out.append((k, r, s))
    return out


def path(template: Column, key: Column) -> Column:
    """The file of a row: its extension is the template's, its folder depends on the row's key."""
    extensions = F.array(*[F.lit(t[0]) for t in TEMPLATES])
    extension = F.get(extensions, template)
    return F.concat(F.lit("src/m"), F.floor(key / KEYS).cast("string"), F.when(extension == "env", "/.env.").otherwise("/file."), extension)


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, line, template and text of every line of the corpus."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey")
    template = (F.col("o_orderkey") % len(TEMPLATES)).cast("int")
    texts = F.array(*[F.lit(t[1]) for t in TEMPLATES])
    x = orders.select("o_orderkey", template.alias("template"))
    x = x.select("o_orderkey", "template", path(F.col("template"), F.col("o_orderkey")).alias("path"), F.replace(F.get(texts, F.col("template")), F.lit("@"), F.col("o_orderkey").cast("string")).alias("text"))
    return x.withColumn("line", F.row_number().over(Window.partitionBy("path").orderBy("o_orderkey")))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path and content of every file of the corpus."""
    ordered = F.sort_array(F.collect_list(F.struct("o_orderkey", "text")))
    dealt = rows(spark, sf_dir).repartition(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), "path")  # a scan is work for the processors, not for the disks
    return dealt.groupBy("path").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n").alias("content"))


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def labels_sql() -> str:
    """The labelled lines for DuckDB: corpus(path, line, text, template) and expected(path, line, text, rule_id, severity)."""
    templates = ", ".join(f"({k}, {_text(e)}, {_text(t)})" for k, (e, t, _, _) in enumerate(TEMPLATES))
    fires = ", ".join(f"({k}, {_text(r)}, {_text(s)}, {n})" for n, (k, r, s) in enumerate(labels()))
    return f"""
    templates(template, extension, pattern) AS (VALUES {templates}),
    fires(template, rule_id, severity, n) AS (VALUES {fires}),
    placed AS (
      SELECT o_orderkey, t.template, 'src/m' || CAST(o_orderkey // {KEYS} AS VARCHAR) || CASE WHEN extension = 'env' THEN '/.env.' ELSE '/file.' END || extension AS path,
             replace(pattern, '@', CAST(o_orderkey AS VARCHAR)) AS text
      FROM orders JOIN templates t ON o_orderkey % {len(TEMPLATES)} = t.template),
    corpus AS (SELECT *, CAST(row_number() OVER (PARTITION BY path ORDER BY o_orderkey) AS INTEGER) AS line FROM placed),
    expected AS (SELECT path, line, text, rule_id, severity, n FROM corpus JOIN fires USING (template))"""
