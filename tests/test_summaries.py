"""Summaries of many builds, views, and rules of both kinds."""

import json

import pyarrow as pa
import pytest

from emberlog import catalog
from emberlog.operators import rules
from emberlog.operators.engine import analyze
from emberlog.operators.summary import summaries, summarize
from emberlog.sinks.run_tables import RunTables
from emberlog.sources.reports import from_texts
from emberlog.sources.runs import load_store


def report_of(spark, builds):
    return analyze(from_texts(spark, [(name, json.dumps({"component": name, "failures": f})) for name, f in builds.items()]))


@pytest.fixture(scope="module")
def builds():
    long = "\n".join(f"line {i} " + "x" * (i % 37) for i in range(40))
    return {
        "many": [{"task": "do_compile", "recipe": f"r{i}", "log": f"{long}\nERROR: a.c:{i}: error: number {i}"} for i in range(9)],
        "one": [{"task": "do_fetch", "recipe": "f", "log": "ERROR: FetchError('Unable to fetch', 'git://h/dart.git')"}],
        "wide": [{"task": "do_compile", "recipe": "w", "log": "ERROR: " + "y" * 900}],
        "none": [],
    }


@pytest.mark.parametrize(("budget", "top_k"), [(4000, 5), (60, 5), (12, 3), (0, 2), (200, 9)])
def test_every_build_as_summarize_makes_it(spark, builds, budget, top_k):
    found = {r.source_path: r for r in summaries(report_of(spark, builds), budget, top_k).collect()}
    assert set(found) == set(builds)
    for name, failures in builds.items():
        want = summarize(report_of(spark, {name: failures}), budget, top_k)
        got = found[name]
        assert [(f.title, f.evidence) for f in got.findings] == [(f["title"], f["evidence"]) for f in want.findings]
        assert (got.findings_omitted, got.log_lines_dropped, got.component) == (want.findings_omitted, want.log_lines_dropped, name)


def test_views_of_a_report_and_a_store(spark, builds, tmp_path):
    report = report_of(spark, builds)
    store = RunTables(spark, f"{tmp_path}/store")
    for at in ("t0", "t1"):
        store.append(report, recorded_at=at)
    names = catalog.register(report, *load_store(spark, store.path), prefix="v_")
    assert names == [f"v_{n}" for n in (*catalog.REPORT_VIEWS, *catalog.STORE_VIEWS)]
    assert spark.sql("SELECT count(*) FROM v_builds b LEFT ANTI JOIN v_failures f ON b.build_key = f.build_key").first()[0] == 1
    assert spark.sql("SELECT max(n) FROM v_lines").first()[0] == 41
    assert spark.sql("SELECT DISTINCT status FROM v_findings JOIN v_trend USING (signature)").collect()[0][0] == "recurring"
    assert spark.sql("SELECT min(h.current_streak), count(*) FROM v_history h JOIN v_groups g USING (signature)").first()[0] == 2
    assert spark.sql("SELECT count(*) FROM v_run_findings r JOIN v_runs USING (run_ord)").first()[0] == 2 * report.findings.count()


def test_arrow_rules_are_registered_beside_others(spark, builds):
    calls = spark.sparkContext.accumulator(0)

    def wide(task, package, recipe, kind, log):
        calls.add(len(log))
        one = {"category": "custom", "severity": "warning", "title": "wide", "recipe": None, "task": None, "file": None, "line": None, "evidence": ["w"], "confidence": 0.25}
        kinds = pa.struct([*[(c, pa.string()) for c in ("category", "severity", "title", "recipe", "task", "file")], ("line", pa.int32()), ("evidence", pa.list_(pa.string())), ("confidence", pa.float64())])
        return pa.array([one if len(x or "") > 900 else None for x in log.to_pylist()], kinds)

    kept = dict(rules._rules)
    try:
        rules.register(rules.ArrowRule("wide", wide, order=99))
        found = report_of(spark, builds).findings.select("recipe", "category", "rule_ord").collect()
    finally:
        rules._rules.clear()
        rules._rules.update(kept)
    assert {r.recipe for r in found if r.category == "custom"} == {"w", *[f"r{i}" for i in range(9)]} - ({"w"} if len("ERROR: " + "y" * 900) <= 900 else set())
    assert {r.rule_ord for r in found if r.category == "custom" and r.recipe != "w"} == {1}  # behind the compile rule's
    assert calls.value == 11  # once for each failure
