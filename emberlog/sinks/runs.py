"""Run stores and trend documents."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.functions.text import redact_host
from emberlog.operators.engine import Report, rank_order, totals
from emberlog.operators.trend import with_status
from emberlog.shared import written
from emberlog.sinks.documents import NO_RECIPE, VERSION

KEYS = ("signature", "category", "severity", "recipe", "title")


def run_findings(findings: DataFrame) -> DataFrame:
    """What a store keeps of findings: no evidence, titles without host identity."""
    return findings.orderBy(*rank_order()).select("signature", "category", "severity", "recipe", redact_host(F.col("title")).alias("title"))


def run_id(findings: DataFrame, version: str) -> str:
    """The hash of all signatures in order, repeats included, and the version; read one partition at a time. run_tables.set_id needs no order."""
    sha = hashlib.sha1()
    begun = False
    for r in findings.select("signature").orderBy("signature").toLocalIterator():
        sha.update(("\n" if begun else "").encode() + r[0].encode())
        begun = True
    sha.update(f"\n{version}".encode())
    return f"sha1:{sha.hexdigest()}"


@dataclass(frozen=True)
class RunRecord:
    """What a store keeps of a run; findings is lazy, and in no order."""

    run_id: str
    recorded_at: str
    tool_version: str
    source_count: int
    summary: dict
    findings: DataFrame


def run_record(report: Report, version: str = VERSION, recorded_at: str | None = None) -> RunRecord:
    """The record of a report's run, now in UTC to the second if no time is given. Findings are evaluated once, and kept in the shared folder."""
    report = Report(report.builds, written(report.findings, "findings"), report.groups)
    at = recorded_at or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    return RunRecord(run_id(report.findings, version), at, version, report.builds.count(), totals(report.findings), report.findings)


def record_run(report: Report, path: str, version: str = VERSION, recorded_at: str | None = None) -> RunRecord:
    """Append a run to a JSON Lines store, as one line, and return its record.

    The line is made in a file of its own, as its findings come, and appended
    once it is whole: a failure before leaves the store as it was. A store
    whose last line has no end gets one. All findings pass the driver, one
    partition at a time: for runs that are too large for a line of a file, see
    sinks/run_tables.py.
    """
    run = run_record(report, version, recorded_at)
    path = os.path.abspath(path)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    made = f"{path}.{uuid.uuid4().hex}"
    try:
        with open(made, "w", encoding="utf-8") as out:
            out.write('{"findings": [')
            for i, r in enumerate(run_findings(run.findings).toLocalIterator()):
                out.write((", " if i else "") + json.dumps(r.asDict(), sort_keys=True))
            rest = {k: getattr(run, k) for k in ("recorded_at", "run_id", "source_count", "summary", "tool_version")}
            out.write("], " + json.dumps(rest, sort_keys=True)[1:] + "\n")
        with open(path, "ab+") as store, open(made, "rb") as line:
            if store.tell():
                store.seek(-1, os.SEEK_END)
                if store.read(1) != b"\n":
                    store.write(b"\n")
            shutil.copyfileobj(line, store)
    finally:
        if os.path.exists(made):
            os.remove(made)
    return run


def trend_json(baseline_id: str | None, status: DataFrame, fixed: DataFrame) -> str:
    """Signatures by status, what is fixed, and the counts."""
    lists: dict[str, list] = {"new": [], "recurring": [], "regressed": []}
    for r in status.orderBy("signature").toLocalIterator():
        lists[r["status"]].append(r["signature"])
    gone = [{**{k: r[k] for k in KEYS}, "last_seen_run": r["run_id"], "last_seen_at": r["recorded_at"]} for r in fixed.orderBy("signature").toLocalIterator()]
    counts = {**{k: len(v) for k, v in lists.items()}, "fixed": len(gone)}
    return json.dumps({"baseline_run_id": baseline_id, **lists, "fixed": gone, "counts": counts}, indent=2, sort_keys=True) + "\n"


def trend_text(report: Report, baseline_id: str | None, status: DataFrame, fixed: DataFrame) -> Iterator[str]:
    """Counts, each finding with its status, and what is fixed."""
    n = {r["status"]: r["count"] for r in status.groupBy("status").count().collect()}
    gone = fixed.orderBy("signature")
    counts = ", ".join(f"{k} {n.get(k, 0)}" for k in ("new", "recurring", "regressed"))
    yield f"Trend vs {baseline_id or '(no baseline — first run)'}\n{counts}, fixed {gone.count()}\n\n"
    found = with_status(report.findings, status)
    for r in found.orderBy(*rank_order()).toLocalIterator():
        yield f"[{r['status']}] {r['recipe'] or NO_RECIPE} - {r['category']}: {r['title']}\n"
    for i, r in enumerate(gone.toLocalIterator()):
        yield ("" if i else "\nFixed since baseline:\n") + f"[fixed] {r['recipe'] or NO_RECIPE} - {r['category']}: {r['title']}\n"
