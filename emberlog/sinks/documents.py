"""Documents of a report: text, JSON, SARIF, HTML, Markdown.

Findings come to the driver in rank order, one partition at a time, and are
written as they come; no document is held whole. Equal reports give equal
bytes, whatever their partitions.
"""

from __future__ import annotations

import html
import json
import textwrap
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from emberlog.functions.labels import LIKELY_CAUSE, phase_rank, sarif_level, severity_rank
from emberlog.functions.text import basename, redact_host
from emberlog.operators.engine import Report, placed, rank_order, totals, with_occurrences
from emberlog.operators.summary import BUDGET, MOST_EVIDENCE, Summary, shown, within_budget

VERSION = "0.1.0"
NAME = "emberlog"
# Fixed values.
SCHEMA_VERSION = "1.0"
SARIF_VERSION, SARIF_SCHEMA = "2.1.0", "https://json.schemastore.org/sarif-2.1.0.json"
ANSI = {"error": "\033[31m", "failure": "\033[31m", "warning": "\033[33m", "anomaly": "\033[36m"}
RESET = "\033[0m"
NO_RECIPE = "(unknown recipe)"


def _dumps(value: object) -> str:
    return json.dumps(value, indent=2, sort_keys=True)


def _array(items: Iterable[object], depth: int) -> Iterator[str]:
    """A JSON array, piece by piece, as json.dumps would write it at that depth."""
    pad, begun = "  " * depth, False
    for x in items:
        yield (",\n" if begun else "[\n") + textwrap.indent(_dumps(x), pad + "  ", lambda _: True)
        begun = True
    yield f"\n{pad}]" if begun else "[]"


def _member(key: str, value: object, depth: int = 1) -> str:
    """"key": value of an object at that depth."""
    pad = "  " * depth
    return f"{pad}{json.dumps(key)}: " + textwrap.indent(_dumps(value), pad, lambda _: True).lstrip(" ")


def _ranked(df: DataFrame) -> Iterator[Row]:
    return df.orderBy(*rank_order()).toLocalIterator()


def _place(r: Row) -> str:
    return r["file"] + (f":{r['line']}" if r["line"] else "")


def text(report: Report, exit_code: int, color: bool = False) -> Iterator[str]:
    """Blocks for a terminal, most important first, and a line of totals."""
    for r in _ranked(report.findings):
        tag = f"[{r['severity'].upper()}]"
        tag = f"{ANSI.get(r['severity'], '')}{tag}{RESET}" if color else tag
        of_task = f" [{r['task']}]" if r["task"] else ""
        mark = "  (cascade)" if r["cascade_of"] else ""
        yield f"{tag} {r['recipe'] or NO_RECIPE}{of_task} - {r['category']} ({r['confidence']:.2f}){mark}\n    {r['title']}\n"
        if r["file"]:
            yield f"    at {_place(r)}\n"
        yield "".join(f"      | {e}\n" for e in r["evidence"]) + "\n"
    t = totals(report.findings)
    yield f"{t['errors']} error(s), {t['warnings']} warning(s) - exit {exit_code}\n"


KEYS = ("category", "severity", "confidence", "title", "recipe", "task", "file", "line", "evidence", "signature", "cascade_of", "occurrences", "affected_recipes")


def finding_json(findings: DataFrame, groups: DataFrame, redacted: bool) -> DataFrame:
    """The columns of a finding in JSON documents."""
    full = with_occurrences(findings, groups)
    if redacted:
        full = full.withColumns({"title": redact_host(F.col("title")), "evidence": F.transform("evidence", redact_host)})
    return full


def analysis_pieces(report: Report) -> tuple[str, DataFrame, str]:
    """The analysis document in pieces: its head, the findings (place from 0, piece), its tail.

    Findings are written as JSON where they are; put together in order, the pieces are the document.
    """
    found = placed(finding_json(report.findings, report.groups, False))

    @F.arrow_udf("string")
    def piece(place: pa.Array, findings: pa.Array) -> pa.Array:
        made = zip(place.to_pylist(), findings.to_pylist(), strict=True)
        return pa.array([(",\n" if k else "[\n") + textwrap.indent(_dumps(f), "    ", lambda _: True) for k, f in made], pa.string())

    place = F.col("rank").cast("bigint") - 1
    each = found.select(place.alias("place"), piece(place, F.struct(*KEYS)).alias("piece"))
    t = totals(found)
    end = "\n  ]" if t["by_category"] else "[]"
    return '{\n  "findings": ', each, end + ",\n" + _member("schema_version", SCHEMA_VERSION) + ",\n" + _member("summary", t) + "\n}\n"


def analysis_json(report: Report) -> Iterator[str]:
    """Findings and totals, as they are (Report.redacted leaves host identity out)."""
    head, each, tail = analysis_pieces(report)
    yield head
    for r in each.orderBy("place").toLocalIterator():
        yield r["piece"]
    yield tail


def report_json(report: Report, version: str = VERSION) -> Iterator[str]:
    """The canonical document: builds, findings without host identity, totals."""
    fields = ("component", "machine", "distro")
    builds = report.builds.orderBy("build_key").select(*fields, F.coalesce(basename(F.col("source_path")), F.lit("")).alias("source"), F.coalesce(F.size("failures"), F.lit(0)).alias("failure_count"))
    rows = ({k: r[k] for k in KEYS} for r in _ranked(finding_json(report.findings, report.groups, True)))
    yield '{\n  "builds": '
    yield from _array((r.asDict() for r in builds.toLocalIterator()), 1)
    yield ',\n  "findings": '
    yield from _array(rows, 1)
    yield ",\n" + ",\n".join((_member("schema_version", SCHEMA_VERSION), _member("summary", totals(report.findings)), _member("tool_version", version))) + "\n}\n"


def categories_in_order(findings: DataFrame) -> DataFrame:
    """(category, place) in the order of their best-ranked finding."""
    first = F.struct(severity_rank(F.col("severity")).alias("s"), (-F.col("confidence")).alias("c"), F.coalesce("recipe", F.lit("")).alias("r"), "signature")
    # a category has one phase, so the phase can be compared apart
    by = findings.groupBy("category").agg(F.min(first).alias("f"))
    order = Window.orderBy("f.s", phase_rank(F.col("category")), "f.c", "f.r", "f.signature")
    return by.select("category", F.row_number().over(order).alias("place")).orderBy("place")  # a row for each category


def sarif(report: Report, version: str = VERSION) -> Iterator[str]:
    """SARIF 2.1.0 with one run."""

    def result(r: Row) -> dict:
        out = {"ruleId": r["category"], "level": r["level"], "message": {"text": r["title"]}}
        if r["file"]:
            region = {"region": {"startLine": r["line"]}} if r["line"] else {}
            out["locations"] = [{"physicalLocation": {"artifactLocation": {"uri": r["file"]}, **region}}]
        return out

    rules = [{"id": r["category"], "name": r["category"]} for r in categories_in_order(report.findings).collect()]
    found = report.findings.withColumns({"level": sarif_level(F.col("severity")), "title": redact_host(F.col("title"))})
    yield "{\n" + _member("$schema", SARIF_SCHEMA) + ',\n  "runs": [\n    {\n      "results": '
    yield from _array(map(result, _ranked(found)), 3)
    tool = {"driver": {"name": NAME, "version": version, "rules": rules}}
    yield ",\n" + _member("tool", tool, 3) + "\n    }\n  ],\n" + _member("version", SARIF_VERSION) + "\n}\n"


def _metadata(build: dict | None) -> list[str]:
    rows = (("machine", "machine"), ("distro", "distro"), ("target", "target_sys")), (("bitbake", "bitbake_version"), ("branch", "branch_commit"))
    told = [" · ".join(f"{name}: {build[key]}" for name, key in row if build.get(key)) for row in rows] if build else []
    return [f"- {t}" for t in told if t]


def markdown(summary: Summary, heading: str = "Build failure") -> str:
    """A summary to paste."""
    root = summary.findings[0] if summary.findings else {}
    subject = root.get("recipe") or (summary.build or {}).get("component") or "build"
    out = [f"# {heading} — {subject}" + (f" ({root['task']})" if root.get("task") else ""), *_metadata(summary.build), ""]
    for i, f in enumerate(summary.findings, 1):
        at = f" at {_place(f)}" if f["file"] else ""
        out += [f"## Finding {i} — {f['category']}-error (confidence {f['confidence']:.2f})", f"Root cause: {f['title']}{at}", "", "```", *f["evidence"], "```", ""]
    if summary.config:
        out += ["## Build config (secrets redacted)", "```", *summary.config.splitlines(), "```", ""]
    cut = [f"{n} {what}" for n, what in ((summary.findings_omitted, "further findings omitted"), (summary.log_lines_dropped, "log lines dropped")) if n]
    out += [f"({'; '.join(cut)})"] if cut else []
    return "\n".join(out).rstrip() + "\n"


def summary_json(summary: Summary) -> str:
    fields = ("component", "machine", "distro", "target_sys", "bitbake_version", "branch_commit")
    own = ("category", "confidence", "recipe", "task", "title", "file", "line", "evidence")
    return _dumps(
        {
            "build": {k: v for k in fields if (v := (summary.build or {}).get(k)) is not None},
            "findings": [{**{k: f[k] for k in own}, "likely_cause": LIKELY_CAUSE.get(f["category"], LIKELY_CAUSE["unknown"])} for f in summary.findings],
            "config": summary.config,
            "truncated": {"findings_omitted": summary.findings_omitted, "log_lines_dropped": summary.log_lines_dropped},
        }
    ) + "\n"


def finding_markdown(build: dict | None, shown_finding: dict) -> str:
    """One finding, of those that shown() returns, as a summary of its own."""
    return markdown(Summary(build, within_budget([shown_finding], BUDGET), 0, 0))


STYLE = "body{font:16px/1.5 sans-serif;max-width:60rem;margin:2rem auto;padding:0 1rem}pre{overflow-x:auto;background:#f4f4f4;padding:.6rem}.chip,.badge{border:1px solid #999;border-radius:9px;padding:0 .5rem;margin-right:.3rem}.sev-error summary{color:#a00}.cascade{opacity:.7}"
SCRIPT = "document.querySelectorAll('button.copy').forEach(b=>b.onclick=()=>navigator.clipboard&&navigator.clipboard.writeText(b.dataset.markdown))"


def page(report: Report, version: str = VERSION, generated_at: str | None = None, status: DataFrame | None = None, fixed: DataFrame | None = None) -> Iterator[str]:
    """A page that needs nothing from elsewhere: findings by recipe, recipes by their first finding.

    Everything is escaped and without host identity. With a trend's status,
    findings get a badge, and what is fixed is listed.
    """
    e = html.escape
    row = report.builds.orderBy("build_key").drop("failures", "ingest_findings", "raw").first()
    build = row.asDict() if row else None
    t = totals(report.findings)
    yield f'<!DOCTYPE html>\n<html lang="en"><head><meta charset="utf-8"><title>Build report</title><style>{STYLE}</style></head><body>\n<h1>Build report'
    yield (f" — {e(build['component'] or '')}" if build else "") + "</h1>\n"
    if build:
        told = [f"{k}: {e(v)}" for k, v in (("machine", build["machine"]), ("distro", build["distro"]), ("source", (build["source_path"] or "").split("/")[-1])) if v]
        yield f'<p class="meta">{" · ".join(told)}</p>\n'
    chips = [f"{t['errors']} error(s)", f"{t['warnings']} warning(s)", *(f"{c}: {n}" for c, n in t["by_category"].items())]
    yield "".join(f'<span class="chip">{e(c)}</span>' for c in chips) + "\n"
    found = shown(report.findings, 0)
    found = found.withColumn("copied", F.slice("evidence", F.greatest(F.size("evidence") - MOST_EVIDENCE + 1, F.lit(1)), MOST_EVIDENCE))
    if status is not None:
        found = found.join(status, "signature", "left").withColumn("status", F.coalesce("status", F.lit("recurring")))
    names = found.withColumn("heading", F.coalesce(F.nullif("recipe", F.lit("")), F.lit(NO_RECIPE)))
    order = rank_order()
    best = names.groupBy("heading").agg(F.min(F.struct(*[c.alias(f"o{i}") if i != 2 else (-F.col("confidence")).alias("o2") for i, c in enumerate(order)])).alias("best"))
    heading = None
    for r in names.join(best, "heading").orderBy("best", *order).toLocalIterator():
        if r["heading"] != heading:
            heading = r["heading"]
            yield f'<h2 class="recipe">{e(heading)}</h2>\n'
        badge = f'<span class="badge trend-{r["status"]}">{r["status"]}</span>' if status is not None else ""
        task = f" [{e(r['task'])}]" if r["task"] else ""
        copy = finding_markdown(build, {**r.asDict(), "evidence": r["copied"]})
        yield (
            f'<details class="finding sev-{e(r["severity"])}{" cascade" if r["cascade_of"] else ""}"><summary>{e(r["category"])}{task} (confidence {r["confidence"]:.2f})'
            f'{" ↳ cascade" if r["cascade_of"] else ""}{badge}</summary><p class="title">{e(r["title"])}{" at " + e(_place(r)) if r["file"] else ""}</p>'
            f'<button class="copy" type="button" data-markdown="{e(copy)}">Copy</button>'
        )
        lines = "\n".join(map(e, r["evidence"]))
        yield (f'<pre class="evidence">{lines}</pre>' if r["evidence"] else "") + "</details>\n"
    if heading is None:
        yield '<p class="meta">No findings.</p>\n'
    if fixed is not None:
        begun = False
        for r in fixed.orderBy("signature").toLocalIterator():
            yield ("" if begun else '<h2 class="recipe">Fixed since baseline</h2>\n<ul class="fixed">\n') + f"<li>{e(r['category'])} — {e(r['recipe'] or NO_RECIPE)}: {e(r['title'])}</li>\n"
            begun = True
        yield "</ul>\n" if begun else ""
    yield f"<footer>Generated by {NAME} {e(version)}{' at ' + e(generated_at) if generated_at else ''}.</footer>\n<script>{SCRIPT}</script>\n</body></html>\n"

