"""format("reports"): what it lists, skips, leaves to Spark and takes over."""

import json
import os

import pytest

from emberlog.sources import datasource
from emberlog.sources.reports import load_reports, read_reports


@pytest.fixture
def folder(tmp_path):
    """Reports and others, hidden and bracketed names among them."""
    for name, text in {"b/one.json": '{"component": "one"}', "b/.two.json": '{"component": "two"}', "a/r[1].json": '{"component": "three"}', "b.txt": "{oops", "c/four.log": '{"component": "four"}'}.items():
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_text(text)
    return str(tmp_path)


def components(df):
    return [(r.component, bool(r.problem)) for r in df.orderBy("build_key").collect()]


def test_folder_glob_and_file_in_order(spark, folder):
    whole = [("three", False), ("one", False), ("two", False), ("four", False)]
    assert sorted(components(read_reports(spark, [folder]))) == sorted(whole)
    assert components(read_reports(spark, [f"{folder}/c/*.log", folder]))[0] == ("four", False)  # once, for its first source
    assert len(components(read_reports(spark, [f"{folder}/c/*.log", folder]))) == 4
    assert components(read_reports(spark, [f"{folder}/b.txt"])) == [(None, True)]  # named: a finding
    assert components(read_reports(spark, [f"{folder}/none", f"{folder}/*.none"])) == []
    assert sorted(components(read_reports(spark, [f"{folder}/**/*.json"]))) == sorted(whole[:3])


def test_plain_use_as_a_format(spark, folder):
    datasource.register(spark)
    assert spark.read.format("reports").load(folder).where("component = 'one'").count() == 1
    assert spark.read.format("reports").load(f"file://{folder}/c").select("component").first()[0] == "four"


@pytest.mark.parametrize("scheme", ["file://", "file:"])
def test_a_store_with_a_scheme_works_alike(spark, folder, scheme):
    for source in ("", "/b/one.json", "/b.txt", "/**/*.json", "/*/r[[]*.json", "/none"):
        local, stored = read_reports(spark, [folder + source]), read_reports(spark, [scheme + folder + source])
        assert components(local) == components(stored)
        assert [f"file://{r[0]}" for r in local.select("source_path").collect()] == [r[0] for r in stored.select("source_path").collect()]
    both = read_reports(spark, [f"{folder}/c", f"{scheme}{folder}/c"])
    assert both.count() == 1


def test_a_path_filter_skips_files(spark, folder):
    opened = f"{folder}/b/one.json"
    os.chmod(f"{folder}/c/four.log", 0)
    (reader,) = [datasource.PushedReader([folder], False)]
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, StringStartsWith

    left = list(reader.pushFilters([EqualTo(("source_path",), opened), GreaterThan(("source_path",), "a"), EqualTo(("component",), "x")]))
    assert [type(f) for f in left] == [GreaterThan, EqualTo] and [f.path for p in reader.partitions() for f in p.files] == [opened]
    for filters, n in (([In(("source_path",), (opened, "x"))], 1), ([StringStartsWith(("source_path",), f"{folder}/b")], 3)):
        reader = datasource.PushedReader([folder], False)
        assert list(reader.pushFilters(filters)) == [] and sum(len(p.files) for p in reader.partitions()) == n


def test_pushed_filters_reach_the_scan(spark, folder):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = read_reports(spark, [folder]).where(f"source_path = '{folder}/b/one.json'")
        assert components(df) == [("one", False)]
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Filter (" not in plan.replace("isnotnull(source_path", "")  or "source_path" not in plan.split("Filter (")[1].split("\n")[0].replace("isnotnull(source_path", "")
        assert load_reports(spark, [folder]).where(f"source_path LIKE '{folder}/b/%'").count() == 2
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_partitions_are_bounded(monkeypatch):
    monkeypatch.setattr(datasource, "FILES_OF_A_TASK", 3)
    monkeypatch.setattr(datasource, "BYTES_OF_A_TASK", 100)
    files = [datasource.File(0, str(i), str(i), size, True) for i, size in enumerate([10, 10, 10, 10, 90, 20, 500, 1])]
    assert [[f.size for f in p.files] for p in datasource.packed(files)] == [[10, 10, 10], [10, 90], [20], [500], [1]]
    assert datasource.packed([]) == []


def test_a_listed_file_that_a_task_does_not_see_is_an_error(tmp_path):
    path = tmp_path / "r.json"
    path.write_text(json.dumps({}))
    reader = datasource.ReportReader([str(tmp_path)], False)
    (part,) = reader.partitions()
    path.unlink()
    with pytest.raises(RuntimeError, match="must see the same files"):
        list(reader.read(part))
