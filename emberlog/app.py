"""The command line: analyze, report, summarize, trend."""

from __future__ import annotations

import argparse
import os
import sys
from collections.abc import Iterable

from pyspark.sql import SparkSession

from emberlog.operators import trend
from emberlog.operators.engine import Report, analyze, cap_evidence, over_threshold
from emberlog.operators.summary import BUDGET, summarize
from emberlog.sinks import documents
from emberlog.sinks import runs as run_sinks
from emberlog.sinks.run_tables import RunTables
from emberlog.sources.reports import load_reports
from emberlog.sources.runs import is_tables, load_store

STORE = ".emberlog/runs.jsonl"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="emberlog", description="Ranked findings of build-failure reports.")
    p.add_argument("--version", action="version", version=documents.VERSION)
    sub = p.add_subparsers(dest="command")

    def command(name: str, text: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name, help=text)
        c.add_argument("inputs", nargs="+", help="report files, globs, folders, or - for stdin")
        c.add_argument("-o", "--output")
        return c

    def filters(c: argparse.ArgumentParser) -> None:
        c.add_argument("--fail-on", choices=("error", "failure", "warning", "none"), default="error")
        c.add_argument("--category", action="append", default=[])
        c.add_argument("--recipe")

    c = command("analyze", "print findings")
    filters(c)
    c.add_argument("--format", choices=("text", "json", "sarif"), default="text")
    c.add_argument("--max-evidence", type=int, default=15)
    c.add_argument("--no-color", action="store_true")
    c.add_argument("--redact", action="store_true", help="leave host identity out of titles and evidence")
    c = command("report", "write index.html and report.json")
    filters(c)
    c.add_argument("--html", required=True, metavar="DIR")
    c.add_argument("--format", choices=("json", "sarif"))
    c.add_argument("--store")
    c.add_argument("--baseline")
    c = command("summarize", "write a summary within a budget of tokens")
    c.add_argument("--for-llm", action="store_true")
    c.add_argument("--format", choices=("md", "json"), default="md")
    c.add_argument("--budget", type=int, default=BUDGET)
    c.add_argument("--include-config", action="store_true")
    c = command("trend", "compare with recorded runs")
    c.add_argument("--store", default=STORE)
    c.add_argument("--baseline")
    c.add_argument("--record", action="store_true")
    c.add_argument("--fail-on-new", action="store_true")
    c.add_argument("--format", choices=("text", "json"), default="text")
    return p


def _write(pieces: Iterable[str], path: str | None) -> None:
    if path is None:
        sys.stdout.writelines(pieces)
        return
    with open(path, "w", encoding="utf-8") as out:
        out.writelines(pieces)


def _compared(spark: SparkSession, report: Report, store: str, baseline: str | None):
    """(baseline's id, status, fixed), cached: the store may be appended to before they are read."""
    if is_tables(store):
        tables = RunTables(spark, store)
        head = tables.baseline(baseline)
        base, (status, gone) = head and head.run_id, tables.compare(report.findings, head)
    else:
        runs, rows = load_store(spark, store)
        found = trend.baseline_run(runs, baseline)
        at = found[0] if found else None
        base, status, gone = found and found[1], trend.classify(report.findings, rows, at), trend.fixed(report.findings, rows, at)
    status, gone = status.persist(), gone.persist()
    status.count(), gone.count()
    return base, status, gone


def _record(spark: SparkSession, report: Report, store: str) -> None:
    """Into a folder of tables if there is one or the name ends with /, into a file otherwise."""
    if is_tables(store):
        RunTables(spark, store).append(report)
    else:
        run_sinks.record_run(report, store)


def _analyze(spark: SparkSession, report: Report, args: argparse.Namespace) -> int:
    report = report.filtered(args.category, args.recipe)
    code = int(over_threshold(report.findings, args.fail_on))
    report = Report(report.builds, cap_evidence(report.findings, args.max_evidence), report.groups)
    report = report.redacted() if args.redact else report
    color = not (args.no_color or args.output or os.environ.get("NO_COLOR")) and sys.stdout.isatty()
    made = {"text": lambda: documents.text(report, code, color), "json": lambda: documents.analysis_json(report), "sarif": lambda: documents.sarif(report)}
    _write(made[args.format](), args.output)
    return code


def _report(spark: SparkSession, report: Report, args: argparse.Namespace) -> int:
    report = report.filtered(args.category, args.recipe)
    status = gone = None
    if args.store:
        _, status, gone = _compared(spark, report, args.store, args.baseline)
    os.makedirs(args.html, exist_ok=True)
    _write(documents.page(report, status=status, fixed=gone), f"{args.html}/index.html")
    _write(documents.report_json(report), f"{args.html}/report.json")
    if args.format and args.output:
        _write(documents.sarif(report) if args.format == "sarif" else documents.report_json(report), args.output)
    return int(over_threshold(report.findings, args.fail_on))


def _summarize(spark: SparkSession, report: Report, args: argparse.Namespace) -> int:
    made = summarize(report, args.budget, include_config=args.include_config)
    _write([documents.summary_json(made) if args.format == "json" else documents.markdown(made)], args.output)
    return 0


def _trend(spark: SparkSession, report: Report, args: argparse.Namespace) -> int:
    base, status, gone = _compared(spark, report, args.store, args.baseline)
    if args.record:
        _record(spark, report, args.store)
    _write([run_sinks.trend_json(base, status, gone)] if args.format == "json" else run_sinks.trend_text(report, base, status, gone), args.output)
    return int(args.fail_on_new and trend.new_findings(status))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Exit code: 0, 1 where the threshold or the gate is reached, 2 without input or where something cannot be read or written."""
    p = parser()
    args = p.parse_args(argv)
    if args.command is None:
        p.print_help()
        return 0
    spark = spark or SparkSession.builder.appName("emberlog").getOrCreate()
    builds = load_reports(spark, args.inputs)
    if builds.isEmpty():
        print(f"emberlog: no matching inputs: {' '.join(args.inputs)}", file=sys.stderr)
        return 2
    report = analyze(builds)
    report = Report(report.builds, report.findings.persist(), report.groups)
    run = {"analyze": _analyze, "report": _report, "summarize": _summarize, "trend": _trend}[args.command]
    try:
        return run(spark, report, args)
    except (OSError, ValueError) as e:
        print(f"emberlog: {e}", file=sys.stderr)
        return 2
    finally:
        report.findings.unpersist()


if __name__ == "__main__":
    sys.exit(main())
