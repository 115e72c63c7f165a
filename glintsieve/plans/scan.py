"""The scan: files to lines to candidates to findings, with coverage accounting."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glintsieve.functions import text as T
from glintsieve.functions.globs import to_regex
from glintsieve.operators import analyze, prefix, rules
from glintsieve.sinks.shared import written
from glintsieve.sources import languages


@dataclass(frozen=True)
class Override:
    pattern: str
    disabled: tuple[str, ...] = ()
    fail_on: str | None = None


@dataclass(frozen=True)
class Settings:
    """What a scan looks for and reports; bounds are part of its meaning."""

    enabled: tuple[str, ...] = ()  # empty: all
    disabled: tuple[str, ...] = ()
    severity: dict[str, str] = field(default_factory=dict)
    overrides: tuple[Override, ...] = ()
    fail_on: str | None = None
    between_functions: bool = False
    snippets: bool = True
    max_findings: int | None = 10_000  # None: no budget
    keyword: str = "glintsieve:ignore"


def _case(pairs: dict[str, str], key: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, v in pairs.items():
        out = F.when(key == k, v).otherwise(out)
    return out


def rule_enabled(rule_id: Column, path: Column, settings: Settings) -> Column:
    """Allowlist without denylist; every matching override adds to the denylist."""
    on = rule_id.isin(*settings.enabled) if settings.enabled else F.lit(True)
    if settings.disabled:
        on = on & ~rule_id.isin(*settings.disabled)
    for o in settings.overrides:
        if o.disabled:
            on = on & ~(path.rlike(to_regex(o.pattern)) & rule_id.isin(*o.disabled))
    return on


def threshold(path: Column, settings: Settings) -> Column:
    """The severity from which a file's findings fail the scan: the last matching override's, else the general one."""
    out = F.lit(settings.fail_on).cast("string")
    for o in settings.overrides:
        if o.fail_on is not None:
            out = F.when(path.rlike(to_regex(o.pattern)), F.lit(o.fail_on)).otherwise(out)
    return out


def rank(severity: Column) -> Column:
    return F.when(severity == "high", 2).when(severity == "medium", 1).when(severity == "info", 0).cast("int")


def matched(lines: DataFrame) -> DataFrame:
    """A row for each line and rule that fires on it: lexical matches, then flows and command bindings not among them; gates applied.

    Lines without a match leave here, before anything is shuffled.
    """
    flow_ids = F.transform("flows", lambda f: f["rule_id"])
    command = F.when(F.col("shell").isNotNull(), F.array(F.lit("SR005"))).otherwise(F.array().cast("array<string>"))
    ids = F.array_union(F.array_union(rules.candidates(), flow_ids), command)
    x = lines.withColumn("_ids", ids).filter(F.size("_ids") > 0)
    x = x.select("*", F.posexplode("_ids").alias("emit_ord", "rule_id")).withColumn("evidence", F.get(F.filter("flows", lambda f: f["rule_id"] == F.col("rule_id")), F.lit(0)))
    gates = F.create_map(*[y for r in rules.RULES for y in (F.lit(r.rule_id), F.array(*[F.lit(g) for g in r.gate]))])
    config = F.col("rule_id").isin(*[r.rule_id for r in rules.RULES if r.config])
    flow_only = F.col("rule_id").isin(*[r.rule_id for r in rules.RULES if r.flow_only])
    allowed = ~F.col("parsed") | ~F.col("reliable") | F.arrays_overlap("classes", F.element_at(gates, F.col("rule_id")))
    allowed = allowed & ~((F.col("rule_id") == "SR005") & F.col("shadowed"))
    return x.filter(((F.col("language") != "config") | config) & allowed & (~flow_only | F.col("evidence").isNotNull()))


def severity(settings: Settings) -> Column:
    """The rule's severity; commands are told apart by how they are called."""
    by_rule = _case({r.rule_id: r.severity for r in rules.RULES}, F.col("rule_id"))
    shell_text = F.col("compact").contains("shell=True") | F.col("compact").contains("os.system(") | F.col("compact").contains("os.popen(")
    command = (
        F.when(F.col("shell"), "high").when(~F.col("shell"), "info")
        .when((F.col("language") == "python") & shell_text, "high").when((F.col("language") == "python") & F.col("compact").contains("(["), "info")
    )
    return F.coalesce(_case(settings.severity, F.col("rule_id")), F.when(F.col("rule_id") == "SR005", command), by_rule)


def judged(lines: DataFrame, settings: Settings | None = None) -> DataFrame:
    """judged_matches of line rows."""
    return judged_matches(matched(lines), settings)


def judged_matches(matches: DataFrame, settings: Settings | None = None) -> DataFrame:
    """Every match with its ordinal, fingerprint and state: new, disabled, suppressed or truncated.

    Matches are dealt by path once, and all windows start from that exchange. With a budget they are written first, as it counts them all.
    """
    settings = settings or Settings()
    state = F.when(~rule_enabled(F.col("rule_id"), F.col("path"), settings), "disabled").when(T.suppressed(F.col("comments"), F.col("rule_id"), settings.keyword), "suppressed").otherwise("new")
    dealt = matches.select("path", "language", "line", "text", "compact", "reliable", "shell", "emit_ord", "rule_id", "evidence", state.alias("state"))
    dealt = (written(dealt, "matches") if settings.max_findings is not None else dealt).repartition("path").withColumn("_digest", F.sha2("text", 256))
    same = Window.partitionBy("path", "rule_id", "_digest").orderBy("line", "emit_ord")
    x = dealt.withColumn("ordinal", F.row_number().over(same) - 1)
    x = x.withColumn("fingerprint", T.fingerprint(F.col("rule_id"), F.col("path"), F.col("text"), F.col("ordinal")))
    x = x.withColumn("sensitive", F.max(F.col("rule_id") == "SR007").over(Window.partitionBy("path", "line")))
    if settings.max_findings is not None:
        x = budgeted(x, settings.max_findings)
    shown = F.when(F.lit(settings.snippets) & ~F.col("sensitive"), T.snippet(F.col("text")))
    confidence = F.when(F.col("evidence").isNull(), "candidate").when(F.col("evidence.remote"), "tainted").otherwise("reachable")
    return x.select(
        "path", "line", "emit_ord", "rule_id", severity(settings).alias("severity"), "state", "ordinal", "fingerprint", shown.alias("snippet"),
        F.when(F.col("reliable"), "ast").otherwise("lexical").alias("engine"), confidence.alias("confidence"), F.coalesce("evidence.depth", F.lit(0)).alias("trace_depth"),
        F.coalesce("evidence.steps", F.expr("cast(array() as array<struct<line:int,kind:string>>)")).alias("trace"), languages.file_class(F.col("path")).alias("file_class"), "language",
    )


def budgeted(x: DataFrame, most: int) -> DataFrame:
    """The first `most` new matches in discovery order (by path components) stay new, the others are truncated.

    A row's rank is the count of the paths before its own, a running total over ranges of paths, plus its rank in the path.
    """
    counts = x.groupBy("path").agg(F.count_if(F.col("state") == "new").alias("_n"))
    bases = prefix.running(counts, [F.split("path", "/").asc(), F.col("path").asc()], "_n", "_to").select(F.col("path").alias("_path"), (F.col("_to") - F.col("_n")).alias("_base"))
    inside = Window.partitionBy("path", "state").orderBy("line", "emit_ord")
    x = x.withColumn("_rank", F.row_number().over(inside)).join(bases, F.col("path").eqNullSafe(F.col("_path")), "left")
    cut = (F.col("state") == "new") & (F.col("_base") + F.col("_rank") > most)
    return x.withColumn("state", F.when(cut, "truncated").otherwise(F.col("state"))).drop("_rank", "_base", "_path")


def files_within(files: DataFrame, size: str, most: int, read: str = "read") -> DataFrame:
    """Files in discovery order with a flag: whether the bytes up to and with a file stay within a budget."""
    total = f"_{read}_total"
    return prefix.running(files, [F.split("path", "/").asc(), F.col("path").asc()], size, total).withColumn(read, F.col(total) <= most).drop(total)


def findings(lines: DataFrame, settings: Settings | None = None) -> DataFrame:
    """The new findings."""
    return judged(lines, settings).filter("state = 'new'").drop("state")


def matches(files: DataFrame, settings: Settings, parse_all: bool = False) -> DataFrame:
    """Every line and rule that fires on it, of files (path, content); unsupported files have none."""
    known = files.select("path", languages.language(F.col("path")).alias("language"), "content").filter("language is not null")
    return analyze.match_rows(known, settings.between_functions, parse_all)


def scan(files: DataFrame, settings: Settings | None = None, parse_all: bool = False) -> DataFrame:
    """Findings of files (path, content). parse_all: parse files without a line that a rule may match, too; the findings are the same."""
    settings = settings or Settings()
    return judged_matches(matches(files, settings, parse_all), settings).filter("state = 'new'").drop("state")


STATES = ("new", "known", "disabled", "suppressed", "truncated")


def coverage(tree: DataFrame, found: DataFrame) -> DataFrame:
    """The one-row report of a scan of a tree: what was read and left out, matches by state; errors of sources and a spent budget make it incomplete."""
    counts = found.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("state") == s).alias(s) for s in STATES])
    out = tree.withColumnRenamed("files", "scanned_files").crossJoin(counts)  # one row each
    return out.withColumn("complete", F.col("complete") & (F.col("truncated") == 0))


def sizes(files: DataFrame) -> DataFrame:
    """The part of the report on what was to be read."""
    return files.agg(F.count(F.lit(1)).alias("supported_files"), F.sum(F.octet_length("content")).alias("total_bytes"))


def counts(found: DataFrame) -> DataFrame:
    """The part of the report on all judged matches."""
    return found.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("state") == s).alias(s) for s in ("new", "disabled", "suppressed", "truncated")])


def report(lines: DataFrame, found: DataFrame, files: DataFrame) -> DataFrame:
    """The one-row coverage report. found: all judged matches."""
    by_file = lines.groupBy("path").agg(F.first("parsed").alias("parsed"), F.first("complete").alias("complete"), F.first("error_nodes").alias("error_nodes"), F.first("language").alias("language"))
    b = by_file.agg(
        F.count(F.lit(1)).alias("scanned_files"), F.count_if("parsed").alias("ast_files"), F.count_if(~F.col("parsed")).alias("lexical_files"),
        F.count_if(~F.col("parsed") & (F.col("language") != "config")).alias("parse_fallback_files"), F.sum("error_nodes").alias("error_nodes"), (F.count_if(~F.col("complete")) == 0).alias("lexed"),
    )
    out = sizes(files).crossJoin(b).crossJoin(counts(found))  # one row each
    return out.withColumn("complete", F.col("lexed") & (F.col("truncated") == 0)).drop("lexed")
