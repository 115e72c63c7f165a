"""The command line: scan a source tree, list the rules, write the templates.

Exit codes: 0 nothing to report, 1 a finding of the threshold's severity, 2 an error of use, 3 an incomplete scan.
"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _arguments(given: list[str] | None) -> argparse.Namespace:
    top = argparse.ArgumentParser(prog="glintsieve")
    commands = top.add_subparsers(dest="command", required=True)
    scan = commands.add_parser("scan", help="scan a source tree")
    scan.add_argument("path")
    scan.add_argument("--format", choices=["text", "json", "sarif", "quality", "quiet"], default="text")
    scan.add_argument("--output", help="a new folder for the report's fragments; without it the report is printed")
    scan.add_argument("--baseline", help="a folder with a baseline: its findings are known")
    scan.add_argument("--write-baseline", help="a new folder for a baseline of all findings")
    scan.add_argument("--fail-on", choices=["info", "medium", "high"])
    scan.add_argument("--exclude", action="append", default=[])
    commands.add_parser("rules", help="list the rules")
    commands.add_parser("init", help="write the templates that are not there yet").add_argument("path", nargs="?", default=".")
    return top.parse_args(given)


def session() -> SparkSession:
    out = SparkSession.builder.appName("glintsieve").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    out.sparkContext.setLogLevel("ERROR")
    return out


def scanned(spark: SparkSession, args: argparse.Namespace) -> tuple[DataFrame, DataFrame, object]:
    """The judged matches with the known ones told apart, the one-row coverage report, and the settings."""
    from glintsieve.plans import baseline, scan
    from glintsieve.sinks import reports
    from glintsieve.sinks.shared import written
    from glintsieve.sources import settings as sources
    from glintsieve.sources import tree

    settings = sources.load(args.path)
    files = tree.load(spark, os.path.abspath(args.path), excludes=",".join(args.exclude))
    texts = tree.texts(files).filter("content is not null").select("path", "content")
    found = written(scan.judged_matches(scan.matches(texts, settings), settings), "judged")
    if args.baseline:
        found = baseline.told_apart(found, reports.read_fingerprints(spark, args.baseline).select("fingerprint"))
    return found, scan.coverage(tree.summary(files), found), settings


def main(given: list[str] | None = None) -> int:
    from glintsieve.operators import rules
    from glintsieve.plans import scan
    from glintsieve.sinks import files, fragments, reports
    from glintsieve.sinks.shared import clear, fresh_path

    args = _arguments(given)
    if args.command == "rules":
        for r in rules.RULES:
            print(f"{r.rule_id} [{r.severity}] {r.name}: {r.message}")
        return 0
    if args.command == "init":
        for name in sorted(files.TEMPLATES):
            if not os.path.exists(os.path.join(args.path, name)):
                print(*files.init(args.path, [name]))
        return 0
    if not os.path.exists(args.path):
        print(f"no such path: {args.path}", file=sys.stderr)
        return 2
    own = SparkSession.getActiveSession() is None
    spark = session()
    try:
        found, report, settings = scanned(spark, args)
        new = found.filter("state = 'new'").drop("state")
        if args.write_baseline:
            reports.write_baseline(found.filter("state in ('new', 'known', 'truncated')"), args.write_baseline)
        if args.format == "quiet":
            print(reports.quiet(report).first()[0])
        else:
            to = args.output or fresh_path(spark, "report")
            {
                "text": lambda: reports.write_text(new, report, to), "json": lambda: reports.write_json(new, report, to, args.path),
                "sarif": lambda: reports.write_sarif(new, rules.table(spark), to), "quality": lambda: reports.write_code_quality(new, to),
            }[args.format]()
            if not args.output:
                for piece in fragments.assembled(to):
                    sys.stdout.write(piece.decode())
        least = F.lit(args.fail_on) if args.fail_on else scan.threshold(F.col("path"), settings)
        met = not new.filter(scan.rank(F.col("severity")) >= scan.rank(least)).isEmpty()
        return 3 if not report.first()["complete"] else int(met)
    except (ValueError, FileExistsError) as e:
        print(str(e), file=sys.stderr)
        return 2
    finally:
        if own:
            clear(spark)
            spark.stop()


if __name__ == "__main__":
    sys.exit(main())
