"""Registered queries by name, the SQL that states their results, and the frames that they share."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glintsieve.operators import analyze
from glintsieve.plans import corpus, scan
from glintsieve.sinks import files, shared
from glintsieve.sources import languages

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(run: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"registered twice: {name}")
        QUERIES[name] = run
        if sql is not None:
            ORACLE_SQL[name] = sql
        return run

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys of customer, dealt out: the table is narrow and comes as few tasks, but the file that a query makes of a row is work."""
    return table(spark, sf_dir, "customer").select("c_custkey").repartition(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), "c_custkey")


_KEPT: dict[tuple[str, str, str], DataFrame] = {}


def kept(spark: SparkSession, sf_dir: str, what: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A table that several queries of a session start from, written in the shared folder by the first one."""
    key = (spark.sparkContext.applicationId, sf_dir, what)
    if key not in _KEPT:
        _KEPT[key] = shared.written(make(), what)
    return _KEPT[key]


def forget(spark: SparkSession) -> None:
    """Takes away the shared tables of a session, and all else that its queries have written."""
    for key in [k for k in _KEPT if k[0] == spark.sparkContext.applicationId]:
        del _KEPT[key]
    shared.clear(spark)


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled corpus: path, language, content."""
    return corpus.files(spark, sf_dir).withColumn("language", languages.language(F.col("path")))


def source_lines(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The corpus after the per-file pass. With columns, only these are worked out, and nothing is written."""
    if columns:
        return analyze.line_rows(source_files(spark, sf_dir), columns=columns)
    return kept(spark, sf_dir, "lines", lambda: analyze.line_rows(source_files(spark, sf_dir)))


def raw_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line and rule that fires on it. Only this is kept: what judges a match is left to each query, which works out the columns that it asks for."""
    return kept(spark, sf_dir, "matches", lambda: scan.matches(corpus.files(spark, sf_dir), scan.Settings()))


def all_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every judged match of the corpus under the default settings, but for the finding budget, which is lifted."""
    return scan.judged_matches(raw_matches(spark, sf_dir), scan.Settings(max_findings=None))


def new_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_matches(spark, sf_dir).filter("state = 'new'").drop("state")


def repaired_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, before and content of the Python files of the corpus in which a request switches verification off, repaired."""
    f = source_files(spark, sf_dir).filter(F.col("path").endswith(".py"))
    ranges = analyze.fact_rows(f).filter("kind = 'repair'").groupBy("path").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("ranges"))

    @F.pandas_udf("string")
    def repair(content: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([files.repaired(c.encode(), [(s["start"], s["end"]) for s in own]).decode() for c, own in zip(content, spans)], dtype=object)

    return f.join(ranges, "path").select("path", F.col("content").alias("before"), repair("content", "ranges").alias("content"))


#: DuckDB: corpus and expected, as common table expressions.
LABELS = "WITH " + corpus.labels_sql()

FOLDERS = ["src", "src/app", "node_modules/lib", "a/build/x", "tests/unit", "examples", "vendor/z", "docs", "deps", "gen/generated", ".git/hooks", "lib/spec"]
NAMES = ["main.py", "app.JS", "x.min.js", "Dockerfile", ".env", ".env.local", "readme.md", "lib.rs", "a.test.ts", "test_a.py", "conftest.py", "m_test.go", "k.kts", "noext", "b.generated.cs", "p.PHTML", "q.toml", "photo.png"]


def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


PATHS = f"""WITH paths AS (
  SELECT o_orderkey, ({_sql_list(FOLDERS)})[CAST(1 + o_orderkey % {len(FOLDERS)} AS BIGINT)] || '/' || ({_sql_list(NAMES)})[CAST(1 + (o_orderkey // {len(FOLDERS)}) % {len(NAMES)} AS BIGINT)] AS path,
         o_orderkey % 3 = 0 AS directory FROM orders)"""


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """o_orderkey, path and directory: a path for each order."""
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    pick = lambda values, k: F.get(F.array(*[F.lit(v) for v in values]), k.cast("int"))
    key = F.col("o_orderkey")
    path = F.concat(pick(FOLDERS, key % len(FOLDERS)), F.lit("/"), pick(NAMES, F.floor(key / len(FOLDERS)) % len(NAMES)))
    return o.select("o_orderkey", path.alias("path"), (key % 3 == 0).alias("directory"))


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small fixed frame."""
    return spark.createDataFrame(rows, schema)
