"""Queries: scalar functions over table columns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from glintsieve.functions import credentials as C
from glintsieve.functions import patch
from glintsieve.functions import text as T
from glintsieve.functions import versions as V
from glintsieve.functions.globs import to_regex
from glintsieve.functions.predicates import QUOTES, java
from glintsieve.queries.registry import LABELS, PATHS, paths, query, repaired_files, table
from glintsieve.sources import settings


def _pick(values: list[str], key: str):
    return F.get(F.array(*[F.lit(v) for v in values]), (F.col(key) % len(values)).cast("int"))


def _pick_sql(values: list[str], key: str) -> str:
    return "([" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + f"])[CAST(1 + {key} % {len(values)} AS BIGINT)]"


@query("f01_sha256", "SELECT doc_id, sha256(text) AS digest FROM documents")
def f01(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))


@query("f02_fingerprint", "WITH x AS (SELECT o_orderkey, o_orderkey % 3 AS n, sha256('SR004' || chr(0) || o_orderpriority || chr(0) || sha256(o_orderstatus)) AS base FROM orders) SELECT o_orderkey, CASE WHEN n = 0 THEN base ELSE sha256(base || chr(0) || CAST(n AS VARCHAR)) END AS fingerprint FROM x")
def f02(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", T.fingerprint(F.lit("SR004"), F.col("o_orderpriority"), F.col("o_orderstatus"), F.col("o_orderkey") % 3).alias("fingerprint"))


@query("f03_tokens", "SELECT p_partkey, regexp_extract_all(p_name || ' $v=' || p_type, '[A-Za-z0-9_$]+') AS tokens FROM part")
def f03(spark, sf_dir):
    text = F.concat("p_name", F.lit(" $v="), "p_type")
    return table(spark, sf_dir, "part").select("p_partkey", F.regexp_extract_all(text, F.lit(java(r"(?:\i|\$)+")), F.lit(0)).alias("tokens"))


@query("f04_compact", "SELECT doc_id, regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', '', 'g') AS compact FROM documents")
def f04(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.compact(F.col("text")).alias("compact"))


@query("f05_split_once", "SELECT event_id, CASE WHEN strpos(props, ':') > 0 THEN substr(props, 1, strpos(props, ':') - 1) ELSE props END AS head, CASE WHEN strpos(props, ':') > 0 THEN substr(props, strpos(props, ':') + 1) END AS tail FROM events")
def f05(spark, sf_dir):
    head, tail = T.split_once(F.col("props"), ":")
    return table(spark, sf_dir, "events").select("event_id", head.alias("head"), tail.alias("tail"))


@query("f06_literal_trim", "SELECT c_custkey, trim('\"#' || c_name || '`''', '''\"`#') AS value FROM customer")
def f06(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", F.btrim(F.concat(F.lit('"#'), "c_name", F.lit("`'")), F.lit(QUOTES)).alias("value"))


@query("f07_snake_case", "SELECT c_custkey, lower(regexp_replace('my' || c_mktsegment || 'Key' || 'ID', '([a-z])([A-Z])', '\\1_\\2', 'g')) AS name FROM customer")
def f07(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", C.snake_case(F.concat(F.lit("my"), "c_mktsegment", F.lit("KeyID"))).alias("name"))


@query("f08_terminal_safe", r"SELECT n_nationkey, n_name || '\u202ea\u001b[0m\u200b' AS shown FROM nation")
def f08(spark, sf_dir):
    text = F.concat("n_name", F.lit("‮a\x1b[0m​"))
    return table(spark, sf_dir, "nation").select("n_nationkey", T.terminal_safe(text).alias("shown"))


@query("f09_snippet", "WITH t AS (SELECT doc_id, trim(regexp_replace(text, '[^ -~]', '', 'g')) AS t FROM documents) SELECT doc_id, CASE WHEN length(t) > 180 THEN substr(t, 1, 180) || '…' ELSE t END AS snippet FROM t")
def f09(spark, sf_dir):
    """A snippet is 180 characters by definition; here of each document's printable ones."""
    text = F.regexp_replace("text", r"[^ -~]", "")
    return table(spark, sf_dir, "documents").select("doc_id", T.snippet(text).alias("snippet"))


@query("f10_json_escape", "SELECT doc_id, text FROM documents")
def f10(spark, sf_dir):
    """Every document's text as JSON and back again: the escapes lose nothing."""
    body = F.to_json(F.struct("text"))
    return table(spark, sf_dir, "documents").select("doc_id", body.alias("body")).select("doc_id", F.from_json("body", "text string")["text"].alias("text"))


@query("f11_uri", "SELECT c_custkey, replace(replace(c_name || ' +*~/a%b', '%', '%25'), ' ', '%20').replace('+', '%2B').replace('*', '%2A').replace('#', '%23') AS uri FROM customer")
def f11(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", T.uri(F.concat("c_name", F.lit(" +*~/a%b"))).alias("uri"))


_VERSIONS = ["1.2.3", "v2.0", "3", "1.2.3-beta", "1.2.3.4", "1.x", "4.5.6+build", ""]


@query("f12_version", f"SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN [1, 2, 3] WHEN 1 THEN [2, 0, 0] WHEN 2 THEN [3, 0, 0] WHEN 6 THEN [4, 5, 6] END AS version FROM part")
def f12(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", V.parsed(_pick(_VERSIONS, "p_partkey")).alias("version"))


_EVENTS = "array(named_struct('introduced','0','fixed',cast(null as string),'last_affected',cast(null as string),'limit',cast(null as string)), named_struct('introduced',null,'fixed','1.2.0','last_affected',null,'limit',null), named_struct('introduced','2.0.0','fixed',null,'last_affected',null,'limit',null), named_struct('introduced',null,'fixed','2.1.0','last_affected',null,'limit',null))"


@query("f13_ranges", "SELECT p_partkey, (minor_of(p_partkey) < 2 AND major_of(p_partkey) <= 1) OR major_of(p_partkey) = 0 OR (major_of(p_partkey) = 2 AND minor_of(p_partkey) < 1) AS affected FROM part".replace("minor_of(p_partkey)", "(p_partkey % 4)").replace("major_of(p_partkey)", "((p_partkey // 4) % 4)"))
def f13(spark, sf_dir):
    version = F.concat_ws(".", (F.floor(F.col("p_partkey") / 4) % 4).cast("string"), (F.col("p_partkey") % 4).cast("string"), F.lit("5"))
    return table(spark, sf_dir, "part").select("p_partkey", V.in_ranges(version, F.expr(_EVENTS)).alias("affected"))


@query("f14_exact_versions", "SELECT p_partkey, p_size IN (1, 3, 5) AND p_partkey % 2 = 0 AS affected FROM part")
def f14(spark, sf_dir):
    listed = F.array_contains(F.array(F.lit("1"), F.lit("3"), F.lit("5")), F.col("p_size").cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 2 == 1, F.lit(False)).otherwise(listed).alias("affected"))


@query("f15_case_id", "SELECT doc_id, 'CASE-' || upper(substr(sha256(text), 1, 16)) AS case_id FROM documents")
def f15(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.case_id(F.sha2("text", 256)).alias("case_id"))


_GLOB = "**/[!a-s]*.t[sx]"


@query("f16_glob", PATHS + " SELECT o_orderkey, regexp_matches(path, '(^|/)t[^/]*[.]go$|(^|/)t[^/]*[.]p[xy]$') AS hit FROM paths")
def f16(spark, sf_dir):
    hit = F.col("path").rlike(to_regex("**/t*.go")) | F.col("path").rlike(to_regex("**/t*.p[xy]"))
    return paths(spark, sf_dir).select("o_orderkey", hit.alias("hit"))


_RAW = ["src\\a.py", "./b.py", "/etc/x", "a/../b", "c:d", "ok/é.py"]


@query("f17_path", "SELECT c_custkey, ([ 'src/a.py', 'b.py', NULL, NULL, NULL, 'ok/é.py' ])[CAST(1 + c_custkey % 6 AS BIGINT)] AS path FROM customer")
def f17(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", T.relative_path(_pick(_RAW, "c_custkey")).alias("path"))


@query("f18_bounded_number", "SELECT p_partkey, CASE WHEN p_size BETWEEN 1 AND 32 THEN p_size END AS jobs FROM part")
def f18(spark, sf_dir):
    ok = F.col("p_size").between(1, 32)
    return table(spark, sf_dir, "part").select("p_partkey", F.when(ok, F.col("p_size")).alias("jobs"))


@query("f19_settings_text", "SELECT n_nationkey, CASE WHEN n_nationkey % 3 <> 2 THEN ['SR' || lpad(CAST(1 + n_nationkey % 22 AS VARCHAR), 3, '0')] END AS disabled, CASE n_nationkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' END AS fail_on, CASE WHEN n_nationkey % 3 = 2 THEN 'no severity: huge' END AS error FROM nation")
def f19(spark, sf_dir):
    """Settings texts, with comments and, in every third, an unknown severity."""
    k = F.col("n_nationkey")
    level = F.when(k % 3 == 0, "high").when(k % 3 == 1, "medium").otherwise("huge")
    text = F.concat(F.lit('disabled = ["SR'), F.lpad((k % 22 + 1).cast("string"), 3, "0"), F.lit('"]\nfail_on = "'), level, F.lit('"  # comment\n[severity]\nSR002 = "medium"\n'))
    return settings.rows(table(spark, sf_dir, "nation").select(k.cast("string").alias("path"), text.alias("content"))).select(F.col("path").cast("int").alias("n_nationkey"), "disabled", "fail_on", "error")


@query("f20_escapes", "SELECT p_partkey, replace(replace(replace(replace(replace(p_name || '<a>|`&', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '|', '&#124;'), '`', '&#96;') AS markdown, replace(replace(replace(p_name || '%:,' || chr(10), '%', '%25'), chr(10), '%0A'), ':', '%3A').replace(',', '%2C') AS annotation FROM part")
def f20(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.markdown(F.concat("p_name", F.lit("<a>|`&"))).alias("markdown"), T.annotation(F.concat("p_name", F.lit("%:,\n"))).alias("annotation"))


@query("f21_patch", f"{LABELS}, repaired AS (SELECT path, string_agg(CASE WHEN contains(text, 'requests.put(') THEN replace(text, 'verify=False', 'verify=True') ELSE text END, chr(10) ORDER BY line) AS content, count(*) FILTER (contains(text, 'requests.put(')) AS n FROM corpus GROUP BY path) SELECT path, content, n AS removed, n AS added FROM repaired WHERE n > 0")
def f21(spark, sf_dir):
    """The patch of every repaired file, applied to the file again, and the lines that it takes away and puts in."""
    @F.pandas_udf("string")
    def patched(before: pd.Series, after: pd.Series, path: pd.Series) -> pd.Series:
        return pd.Series([patch.unified(*x) for x in zip(before, after, path)], dtype=object)

    @F.pandas_udf("string")
    def again(before: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series([patch.applied(*x) for x in zip(before, text)], dtype=object)

    x = repaired_files(spark, sf_dir).withColumn("patch", patched("before", "content", "path"))
    rows = F.split("patch", "\n")
    n = lambda sign: F.size(F.filter(rows, lambda x: x.startswith(sign) & ~x.startswith(sign * 3))).cast("long")
    return x.select("path", again("before", "patch").alias("content"), n("-").alias("removed"), n("+").alias("added"))
