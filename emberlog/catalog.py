"""The frames of a report and of a run store as views, for SQL over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.functions.text import log_lines
from emberlog.operators import trend
from emberlog.operators.engine import Report, failures_of

#: Views of a report, and those of a run store.
REPORT_VIEWS = ("builds", "failures", "lines", "findings", "groups")
STORE_VIEWS = ("runs", "run_findings", "history", "trend")


def lines_of(failures: DataFrame) -> DataFrame:
    """A row for each line of each failure's log: build_key, failure_ord, n, level, text."""
    each = failures.select("build_key", "failure_ord", F.explode(log_lines(F.col("log"))).alias("l"))
    return each.select("build_key", "failure_ord", "l.*")


def frames(report: Report, runs: DataFrame | None = None, rows: DataFrame | None = None) -> dict[str, DataFrame]:
    """The frames by the names of their views; those of a store if its runs and rows (sources.runs.load_store) are given."""
    failures = failures_of(report.builds)
    found = dict(zip(REPORT_VIEWS, (report.builds, failures, lines_of(failures), report.findings, report.groups), strict=True))
    if runs is not None and rows is not None:
        base = trend.baseline_run(runs)
        status = trend.classify(report.findings, rows, base[0] if base else None)
        found |= dict(zip(STORE_VIEWS, (runs, rows, trend.history(rows, runs), status), strict=True))
    return found


def register(report: Report, runs: DataFrame | None = None, rows: DataFrame | None = None, prefix: str = "") -> list[str]:
    """Register the frames as temporary views of the session, each named by prefix and its name; return the names.

    Views are lazy: a query reads what it asks for, and columns that it does
    not name are not read.
    """
    made = frames(report, runs, rows)
    for name, df in made.items():
        df.createOrReplaceTempView(prefix + name)
    return [prefix + name for name in made]
