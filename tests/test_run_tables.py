"""Run stores as tables: commits, repeated appends, two writers, and what a trend reads."""

import json
import threading

import pytest
from pyspark.sql import functions as F

from emberlog.operators import trend
from emberlog.operators.engine import Report, analyze
from emberlog.sinks.run_tables import RunTables, Taken, set_id
from emberlog.sources.reports import from_texts
from emberlog.sources.runs import load_store


@pytest.fixture(scope="module")
def reports(spark):
    """Three reports: a and b, b and c, nothing."""

    def made(*logs):
        text = json.dumps({"failures": [{"task": "do_compile", "recipe": x, "log": f"ERROR: {x} fails"} for x in logs]})
        r = analyze(from_texts(spark, [("r.json", text)]))
        return Report(r.builds, r.findings.persist(), r.groups)

    return made("a", "b"), made("b", "c"), made()


def by_recipe(rows):
    return sorted((r.recipe, r.status) for r in rows.collect())


def test_appends_trends_and_history(spark, reports, tmp_path):
    store = RunTables(spark, f"{tmp_path}/store")
    assert store.heads() == [] and store.rows().isEmpty() and store.baseline() is None
    status, gone = store.compare(reports[0].findings, None)
    assert {r.status for r in status.collect()} == {"new"} and gone.isEmpty()
    with pytest.raises(ValueError):
        heads = [store.append(r, recorded_at=f"t{i}") for i, r in enumerate(reports)]
        store.baseline("no such run")
    assert [h.run_ord for h in heads] == [0, 1, 2] == [h.run_ord for h in store.heads()] and [h.errors for h in heads] == [2, 2, 0]

    runs, rows = load_store(spark, store.path)
    assert [(r.run_ord, r.run_id, r.source_count) for r in runs.orderBy("run_ord").collect()] == [(h.run_ord, h.run_id, 1) for h in heads]
    assert sorted((r.run_ord, r.recipe, r.place) for r in rows.collect()) == [(0, "a", 0), (0, "b", 1), (1, "b", 0), (1, "c", 1)]
    for at, want in ((0, [("b", "recurring"), ("c", "new")]), (1, [("b", "recurring"), ("c", "recurring")]), (2, [("b", "regressed"), ("c", "regressed")])):
        status, gone = store.compare(reports[1].findings, heads[at])
        assert by_recipe(reports[1].findings.join(status, "signature")) == want
        old = trend.classify(reports[1].findings, rows, at), trend.fixed(reports[1].findings, rows, at)
        assert sorted(map(tuple, status.collect())) == sorted(map(tuple, old[0].collect()))
        assert [r.recipe for r in gone.collect()] == [r.recipe for r in old[1].collect()] == (["a"] if at == 0 else [])
    for head in heads:
        seen = rows.where(F.col("run_ord") <= head.run_ord)
        assert sorted(map(tuple, store.history(head).select(*trend.history_state(seen).columns).collect())) == sorted(map(tuple, trend.history_state(seen).collect()))


def test_a_trend_reads_two_partitions(spark, reports, tmp_path):
    store = RunTables(spark, f"{tmp_path}/store")
    heads = [store.append(r, recorded_at=f"t{i}") for i, r in enumerate(reports)]
    for df in store.compare(reports[1].findings, heads[1]):
        files = {f.rsplit("/", 2)[1] for f in df.inputFiles() if str(tmp_path) in f}
        assert files == {f"commit={heads[1].key}"}


def test_a_repeated_append_changes_nothing(spark, reports, tmp_path):
    store = RunTables(spark, f"{tmp_path}/store")
    first = store.append(reports[0], recorded_at="t0")
    assert store.append(reports[0], recorded_at="t0") == first and len(store.heads()) == 1
    named = store.append(reports[1], recorded_at="t1", key="job-17")
    assert store.append(reports[0], recorded_at="t9", key="job-17") == named and len(store.heads()) == 2
    assert store.append(reports[0], recorded_at="t2").run_ord == 2  # the same findings at another time are another run


def test_what_a_dead_writer_left_is_not_read(spark, reports, tmp_path, monkeypatch):
    store = RunTables(spark, f"{tmp_path}/store")
    store.append(reports[0], recorded_at="t0")

    def dies(self, head):
        raise KeyboardInterrupt

    with monkeypatch.context() as m, pytest.raises(KeyboardInterrupt):
        m.setattr(RunTables, "_commit", dies)
        store.append(reports[1], recorded_at="t1", key="k")
    assert len(store.heads()) == 1 and {r.run_ord for r in store.rows().collect()} == {0}
    assert store.append(reports[1], recorded_at="t1", key="k").run_ord == 1
    assert store.rows().where("run_ord = 1").count() == 2


def test_two_writers_get_two_numbers(spark, reports, tmp_path):
    store = RunTables(spark, f"{tmp_path}/store")
    done, tries = [], []
    gate = threading.Barrier(2, timeout=120)

    class Writer(RunTables):
        def _commit(self, head):
            if not any(t is threading.current_thread() for t in tries):
                tries.append(threading.current_thread())
                gate.wait()  # both are about to take number 0
            super()._commit(head)

    def write(i):
        done.append(Writer(spark, store.path).append(reports[i], recorded_at=f"t{i}"))

    writers = [threading.Thread(target=write, args=(i,)) for i in range(2)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert sorted(h.run_ord for h in done) == [0, 1] and [h.key for h in store.heads()] == [h.key for h in sorted(done, key=lambda h: h.run_ord)]
    last = store.heads()[-1]
    assert store.history(last).agg(F.sum("runs_present")).first()[0] == 4  # the loser merged its history anew
    with pytest.raises(Taken):
        store._commit(last)


def test_set_id_is_the_same_in_any_partitioning(spark):
    df = spark.range(1000).select(F.concat(F.lit("s"), F.col("id") % 300).alias("signature"))
    ids = {set_id(x, "1") for x in (df, df.repartition(7), df.orderBy(F.desc("signature")).coalesce(1))}
    assert len(ids) == 1 and next(iter(ids)).startswith("set:")
    others = {set_id(df, "2"), set_id(df.where("signature <> 's5'"), "1"), set_id(df.union(df.limit(1)), "1"), set_id(df.limit(0), "1")}
    assert len(others) == 4 and not others & ids


def test_merged_histories_equal_the_whole(spark):
    rows = spark.range(400).selectExpr("cast(id * 7 % 12 as bigint) run_ord", "concat('s', (id * id + id % 5) % 37) signature", "concat('r', id * 7 % 12) run_id", "concat('t', id * 7 % 12) recorded_at")
    rows = rows.where("(run_ord + length(signature)) % 4 <> 0").persist()
    whole = trend.history_state(rows)
    for cuts in ([0, 12], [0, 1, 2, 12], [0, 5, 9, 12], [0, 11, 12]):
        state = None
        for a, b in zip(cuts, cuts[1:], strict=False):
            part = trend.history_state(rows.where(f"run_ord >= {a} AND run_ord < {b}"))
            state = part if state is None else trend.merge_history(state, part)
        assert sorted(map(tuple, state.select(*whole.columns).collect())) == sorted(map(tuple, whole.collect()))
