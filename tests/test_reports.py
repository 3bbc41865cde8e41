"""From report files to findings, summaries, documents, trends and the command line."""

import json
import os

import pytest
from pyspark.sql import functions as F

from emberlog import app
from emberlog.operators import rules, trend
from emberlog.operators.engine import analyze, cap_evidence, findings_of
from emberlog.operators.summary import estimate_tokens, summarize
from emberlog.sinks import documents
from emberlog.sinks.runs import record_run
from emberlog.sources.reports import from_texts, load_report, load_reports
from emberlog.sources.runs import load_runs
from emberlog.streaming.reports import groups_so_far, watch


def report(*failures, **more):
    return json.dumps({"component": "comp", "machine": "m1", "failures": list(failures), **more})


def failure(task, log, **more):
    return {"task": task, "package": "pkg", "recipe": "rec", "log": log, **more}


@pytest.fixture(scope="module")
def found(spark):
    def run(*failures, **more):
        return [r.asDict() for r in analyze(from_texts(spark, [("a.txt", report(*failures, **more))])).ranked().collect()]

    return run


def test_rules(found):
    rows = found(
        failure("do_compile", "NOTE: x\n/s/a/b.cpp:12:3: error: bad\nninja: build stopped"),
        failure("do_compile", 'package "Qt5" is considered to be NOT FOUND\nCMake Error at CMakeLists.txt:86 (x)\nfoo.c:1: error: later\nninja: build stopped'),
        failure("do_patch", "Applying patch fix.patch\npatching file a/one.h\npatching file b/two.h\nHunk #2 FAILED at 601.\n1 out of 2"),
        failure("do_package_qa", "ERROR: QA Issue: link [dev-so]\nERROR: QA Issue: link2 [dev-so]\nERROR: QA Issue: path [buildpaths]"),
        {"task": "Nothing provides 'some-lib'", "package": "only-package", "log": "NOTE: a\nNOTE: b"},
        failure("do_fetch", "ERROR: FetchError('Unable to fetch', 'git://h/dart.git')"),
        failure("do_install", "WARNING: one\nWARNING: two"),
    )
    by = {r["category"]: r for r in rows}
    assert [r["category"] for r in rows] == ["dependency", "fetch", "patch", "configure", "compile", "qa", "unknown"]
    assert (by["compile"]["title"], by["compile"]["file"], by["compile"]["line"]) == ("/s/a/b.cpp:12:3: error: bad", "b.cpp", 12)
    assert (by["configure"]["title"], by["configure"]["file"], by["configure"]["line"]) == ('package "Qt5" considered NOT FOUND', "CMakeLists.txt", 86)
    assert (by["patch"]["title"], by["patch"]["line"]) == ("fix.patch failed: Hunk #2 at two.h:601", 601)
    assert by["patch"]["evidence"][-1] == "Hunk #2 FAILED at 601."
    assert by["qa"]["title"] == "QA Issue: dev-so x2, buildpaths x1" and by["qa"]["evidence"] == ["QA Issue: link [dev-so] (x2)", "QA Issue: path [buildpaths]"]
    assert (by["dependency"]["title"], by["dependency"]["recipe"], by["dependency"]["task"]) == ("Nothing provides 'some-lib'", "only-package", None)
    assert by["dependency"]["evidence"] == ["NOTE: a", "NOTE: b"]
    assert by["fetch"]["title"] == "Unable to fetch (git://h/dart.git)"
    assert (by["unknown"]["title"], by["unknown"]["severity"], by["unknown"]["confidence"]) == ("two", "warning", 0.3)


def test_evidence_is_a_window_without_noise(found):
    log = "\n".join(["NOTE: n"] * 30 + [f"plain {i} x.c:{i}:" for i in range(30)] + ["ERROR: final"] + ["after"] * 3)
    (row,) = found(failure("do_install", log))
    assert len(row["evidence"]) == 15 and row["evidence"][-1] == "ERROR: final"
    assert "after" not in row["evidence"] and not any("NOTE" in e for e in row["evidence"])
    (quiet,) = found(failure("do_install", "NOTE: a\nDEBUG: b"))
    assert quiet["evidence"] == ["NOTE: a", "DEBUG: b"] and quiet["title"] == "do_install"
    (empty,) = found({"task": None})
    assert (empty["title"], empty["evidence"], empty["category"]) == ("Unresolved dependency", ["Unresolved dependency"], "dependency")


def test_cascades_groups_and_occurrences(spark):
    same = failure("do_compile", "a.c:1:2: error: x")
    r = analyze(from_texts(spark, [("a", report(same, {**same, "recipe": "other"}, failure("do_compile", "b.c:1: error: y"))), ("b", report(same))]))
    rows = r.findings.orderBy("build_key", "failure_ord").collect()
    assert [x.cascade_of is not None for x in rows] == [False, True, False, False]
    group = r.groups.where("occurrences = 3").first()
    assert group.affected_recipes == ["rec", "other"]
    assert cap_evidence(r.findings, 0).where("size(evidence) > 0").isEmpty()


def test_own_rules(spark):
    own = rules.Rule("own", lambda: F.col("task") == "do_x", lambda: rules.hit("own", F.lit("found"), 0.5, rules.evidence()))
    builds = from_texts(spark, [("a", report(failure("do_x", "l"), failure("do_y", "l")))])
    assert [r.category for r in findings_of(builds, [own]).collect()] == ["own"]
    assert findings_of(builds, []).count() == 0
    before = rules.registered_rules()
    rules.register(own)
    try:
        assert {r.category for r in findings_of(builds).collect()} == {"own", "unknown"}
    finally:
        rules.clear_rules()
        rules.register_defaults()
    assert rules.registered_rules() != [] and [r.name for r in rules.registered_rules()] == [r.name for r in before]


@pytest.fixture
def folder(tmp_path):
    f = tmp_path / "in"
    (f / "sub").mkdir(parents=True)
    (f / "a.txt").write_text(report(failure("do_compile", "a.c:1:2: error: x in /home/me/2024-05-06/y"), local_conf="A=1\nPASSWORD=2"))
    (f / "sub" / "b.json").write_text(report(failure("do_fetch", "ERROR: Unable to fetch url")))
    (f / "bad.txt").write_text('{"failures": [')
    (f / "list.txt").write_text("[1]")
    (f / "latin.txt").write_bytes(b"\xff\xfe")
    return f


def test_sources(spark, folder):
    scanned = load_reports(spark, [str(folder)])
    assert sorted(r.source_path.split("/")[-1] for r in scanned.collect()) == ["a.txt", "b.json"]
    named = load_reports(spark, [f"{folder}/*.txt", str(folder), f"{folder}/none*"]).orderBy("build_key").collect()
    assert [r.source_path.split("/")[-1] for r in named] == ["a.txt", "bad.txt", "latin.txt", "list.txt", "b.json"]
    titles = {r.title for r in findings_of(load_reports(spark, [f"{folder}/bad.txt", f"{folder}/list.txt", f"{folder}/latin.txt"])).collect()}
    assert any("(got list)" in t for t in titles) and any(t.startswith("Report is not valid JSON") for t in titles) and any(t.startswith("Could not read report") for t in titles)
    assert load_reports(spark, [f"{folder}/none"]).isEmpty()


def test_odd_json(spark):
    rows = [("a", '{"failures": [1, {"task": 5, "log": 7}], "machine": NaN, "machine": ["x"]}'), ("b", '{"failures": 3}'), ("c", '{} x'), ("d", "")]
    builds = {r.source_path: r for r in from_texts(spark, rows).collect()}
    assert [tuple(f) for f in builds["a"].failures] == [("5", None, None, "", "message")] and builds["a"].machine == '["x"]'
    assert builds["b"].failures == [] and len(builds["c"].ingest_findings) == len(builds["d"].ingest_findings) == 1


def test_summary(spark, folder):
    r = analyze(load_reports(spark, [str(folder)]))
    full = summarize(r, include_config=True)
    assert full.findings_omitted == 0 and full.config == "A=1\n# [redacted secret]"
    assert "HOSTDIR" in full.findings[1]["title"] and "/home/me" not in documents.markdown(full)
    small = summarize(r, budget=3)
    assert len(small.findings) == 1 and small.findings[0]["evidence"] and small.findings_omitted == 1
    assert estimate_tokens(full) <= 4000 and json.loads(documents.summary_json(full))["truncated"] == {"findings_omitted": 0, "log_lines_dropped": 0}


def test_documents(spark, folder):
    builds = load_reports(spark, [str(folder)])
    r, again = analyze(builds), analyze(builds.repartition(3))
    for make in (documents.report_json, documents.analysis_json, documents.sarif, documents.page):
        assert "".join(make(r)) == "".join(make(again))
    doc = "".join(documents.report_json(r))
    assert doc == json.dumps(json.loads(doc), indent=2, sort_keys=True) + "\n"
    assert "/home/me" not in doc and json.loads(doc)["summary"]["errors"] == 2
    plain, shown = ("".join(documents.text(x, 1)) for x in (r, r.redacted()))
    assert "/home/me" in plain and "/home/me" not in shown and "HOSTDIR" in shown
    assert "/home/me" not in "".join(documents.analysis_json(r.redacted()))
    sarif = "".join(documents.sarif(r))
    assert sarif == json.dumps(json.loads(sarif), indent=2, sort_keys=True) + "\n"
    assert [x["id"] for x in json.loads(sarif)["runs"][0]["tool"]["driver"]["rules"]] == ["fetch", "compile"]
    none = analyze(load_reports(spark, ["/nowhere"]))
    empty = "".join(documents.report_json(none))
    assert empty == json.dumps(json.loads(empty), indent=2, sort_keys=True) + "\n"
    assert "No findings." in "".join(documents.page(none))


def test_trends_and_store(spark, folder, tmp_path):
    store = f"{tmp_path}/s/runs.jsonl"
    assert load_runs(spark, store).isEmpty()
    one, two = (analyze(load_reports(spark, [f"{folder}/{p}"])) for p in ("a.txt", "sub/*.json"))
    first = record_run(one, store, recorded_at="t0").run_id
    with open(store, "a") as f:
        f.write("\njunk\n[1]\n")
    record_run(two, store, recorded_at="t1")
    runs = load_runs(spark, store)
    assert [(r.run_ord, r.run_id == first, r.source_count) for r in runs.orderBy("run_ord").collect()] == [(0, True, 1), (1, False, 1)]
    rows = trend.run_rows(runs)
    assert [r.status for r in trend.classify(one.findings, rows, 1).collect()] == ["regressed"]
    assert [r.status for r in trend.classify(one.findings, rows, 0).collect()] == ["recurring"]
    assert [r.status for r in trend.classify(one.findings, rows, None).collect()] == ["new"]
    assert trend.fixed(one.findings, rows, 1).first().category == "fetch"
    assert trend.baseline_run(runs)[0] == 1 and trend.baseline_run(runs, first)[0] == 0
    with pytest.raises(ValueError):
        trend.baseline_run(runs, "no such run")
    streaks = {r.first_seen_run == first: r.current_streak for r in trend.history(rows).collect()}
    assert streaks == {True: 0, False: 1}
    with open(store, "a") as f:
        f.write('{"run_id": "cut off')
    record_run(one, store, recorded_at="t2")
    assert [r.recorded_at for r in load_runs(spark, store).orderBy("run_ord").collect()] == ["t0", "t1", "t2"]
    assert os.listdir(tmp_path / "s") == ["runs.jsonl"]


def test_streaks_end_with_a_run_that_found_nothing(spark, tmp_path):
    store = tmp_path / "runs.jsonl"
    store.write_text("\n".join(json.dumps({"run_id": f"r{i}", "findings": [{"signature": s} for s in found]}) for i, found in enumerate((["a"], ["a", "b"], []))))
    runs = load_runs(spark, str(store))
    streaks = {r.signature: (r.current_streak, r.runs_present) for r in trend.history(trend.run_rows(runs), runs).collect()}
    assert streaks == {"a": (0, 2), "b": (0, 1)}


def test_run_stores_are_read_by_the_rules_of_pythons_json(spark, tmp_path):
    """Each of these lines means what json.loads makes of it."""
    store = tmp_path / "runs.jsonl"
    lines = [
        '{"run_id": "a", "findings": [{"signature": "x"}, 7, null, "text", {"title": null}]}',  # objects count, whatever the others are
        '{"run_id": "b", "summary": {"errors": NaN}, "source_count": "7"}',  # NaN is a number there
        '{"run_id": "c", "run_id": "d"}',  # the last of a repeated key counts
        '{"run_id": "f"} }',  # no JSON
        ' {"run_id": 5, "findings": {"a": 1}, "source_count": null} ',
        '{"run_id": "g"}\x0b{"run_id": "h"}'.replace("\\x0b", "\x0b"),  # splitlines() cuts here
        "[1]", "", "{oops",
    ]
    store.write_text("\n".join(lines))
    found = load_runs(spark, str(store)).orderBy("run_ord").collect()
    assert [(r.run_ord, r.run_id, r.source_count) for r in found] == [(0, "a", 0), (1, "b", 7), (2, "d", 0), (3, "5", None), (4, "g", 0), (5, "h", 0)]
    assert [(f.signature, f.category, f.severity, f.title) for f in found[0].findings] == [("x", "unknown", "error", ""), ("", "unknown", "error", None)]


def test_hidden_bracketed_and_missing_files(spark, tmp_path):
    for name in ("_a.json", ".hid/c.json", "r[1].json", "d.json", "d-/e.json"):
        path = tmp_path / "in" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(report(failure("do_compile", "x"), component=name))
    named = lambda *s: [r.component for r in load_reports(spark, [f"{tmp_path}/in{x}" for x in s]).orderBy("build_key").collect()]
    assert named("") == [".hid/c.json", "_a.json", "d-/e.json", "d.json", "r[1].json"]
    assert named("/_a.json", "/*.json") == ["_a.json", "d.json", "r[1].json"]
    assert named("/r[[]1].json") == ["r[1].json"] and named("/none.json") == []
    missing = load_report(spark, f"{tmp_path}/none.json").first()
    assert not missing.failures and missing.ingest_findings[0].title.startswith("Could not read report: ")
    assert load_report(spark, f"{tmp_path}/in/r[1].json").first().component == "r[1].json"


def test_command_line(spark, folder, tmp_path, capsys):
    go = lambda *a: app.main([str(x) for x in a], spark)
    assert go("analyze", folder) == 1 and "2 error(s), 0 warning(s) - exit 1" in capsys.readouterr().out
    assert go("analyze", folder, "--fail-on", "none", "--category", "fetch", "--format", "json", "-o", tmp_path / "o.json") == 0
    assert len(json.loads((tmp_path / "o.json").read_text())["findings"]) == 1
    assert go("analyze", folder / "none") == 2 and go("analyze", folder, "-o", tmp_path / "no" / "x") == 2
    store = tmp_path / "runs.jsonl"
    assert go("trend", folder, "--store", store, "--record", "--fail-on-new") == 1
    assert go("trend", folder, "--store", store, "--fail-on-new", "--format", "json") == 0
    assert go("trend", folder, "--store", store, "--baseline", "x") == 2
    assert go("report", folder, "--html", tmp_path / "html", "--store", store, "--fail-on", "none") == 0
    assert "trend-recurring" in (tmp_path / "html" / "index.html").read_text() and (tmp_path / "html" / "report.json").exists()
    capsys.readouterr()
    assert go("summarize", folder, "--format", "json") == 0 and json.loads(capsys.readouterr().out)["findings"]
    assert app.main([]) == 0


def test_watched_groups_equal_those_of_all_reports(spark, tmp_path):
    """Three rounds of arriving files; one is written again, one round brings nothing new to a signature."""
    arrived, want = tmp_path / "in", {}

    def round_of(files):
        arrived.mkdir(exist_ok=True)
        for name, recipes in files.items():
            want.setdefault(name, recipes)
            (arrived / name).write_text(report(*[{"task": "do_compile", "recipe": r, "log": "ERROR: it fails"} for r in recipes]))
        q = watch(spark, str(arrived), f"{tmp_path}/out", f"{tmp_path}/cp", once=True)
        assert q.awaitTermination(120)
        texts = [(n, report(*[{"task": "do_compile", "recipe": r, "log": "ERROR: it fails"} for r in rs])) for n, rs in sorted(want.items())]
        whole = analyze(from_texts(spark, texts)).groups
        rows = lambda df: sorted((r.signature, r.occurrences, r.affected_recipes) for r in df.collect())
        assert rows(groups_so_far(spark, f"{tmp_path}/cp")) == rows(whole)

    round_of({"a.json": ["x", "y"], "b.json": ["x"]})
    os.utime(arrived / "a.json", (2_000_000_000, 2_000_000_000))
    round_of({"c.json": ["z"], "a.json": ["w", "w"]})  # a.json counts as it first came
    round_of({"d.json": ["y", "x"]})
    assert spark.read.parquet(f"{tmp_path}/out").count() == 6


def test_watch(spark, folder, tmp_path):
    q = watch(spark, str(folder), f"{tmp_path}/out", f"{tmp_path}/cp", once=True)
    q.awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 5  # two findings, and three files that are no reports
