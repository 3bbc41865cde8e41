"""Logs in pieces give the findings of whole logs."""

import random

import pytest
from pyspark.sql import functions as F

from emberlog import schema
from emberlog.operators.engine import analyze, failures_of
from emberlog.operators.pieces import analyze_pieces, blocks_of, cut
from emberlog.operators.rules import Rule, any_line, evidence, first_with, hit, line_has, registered_rules

TEXTS = (
    "", "\r", "plain", "NOTE: quiet", "DEBUG: probe", "WARNING: slow", "ERROR: broken", "ERROR: ", "ERROR: Fetcher failure", "ERROR: QA Issue: a [dev-so]", "QA Issue: b [dev-so]",
    "ERROR: QA Issue: x y", "QA Issue:", "CMake Error at x", "CMakeLists.txt:12", 'package "Qt" is considered to be NOT FOUND', "a/b.c:3:4: error: bad", "error: no place", "undefined reference to f",
    "ninja: build stopped", "Nothing provides 'libz'", "No provider", "patching file src/a.c", "patching file src/b.c", "Hunk #2 FAILED at 17.", "Hunk #x", "rejects in file c/d.c",
    "Applying patch fix.patch", "p.patch does not apply", "ERROR: FetchError('none', 'git://h/r')", "FetchError('all', 'x')", "FetchError('open", "', 'later')", "ERROR: FetchError('half',", "ERROR: 'end')",
    "ERROR: got 'https://h/r'", "got 'git://open", "closed' here", "checksum", "é😀 wide", "my own sign",
)
TASKS = ("do_compile", "do_fetch", "do_fetch", "do_patch", "do_package_qa", "Nothing provides 'x'", None)


def made(spark, logs):
    none = "array<struct<category:string,severity:string,title:string,evidence:array<string>,confidence:double>>"
    rows = [(f"b{i // 3:04d}", [(t, "pkg", "rec" if i % 2 else "", log, "task")], []) for i, (t, log) in enumerate(logs)]
    rows = [(f"{k}-{i}", f, n) for i, (k, f, n) in enumerate(rows)]
    return spark.createDataFrame(rows, f"build_key string, failures array<{schema.FAILURE}>, ingest_findings {none}")


def rows(findings):
    order = sorted(findings.columns)
    return sorted(str(tuple(r)) for r in findings.select(*order).collect())


def random_logs(n, seed):
    rng = random.Random(seed)
    for _ in range(n):
        few = rng.sample(TEXTS, rng.randint(1, 8)) + ["plain", "NOTE: quiet"] * rng.randint(0, 3)
        lines = [rng.choice(few) for _ in range(rng.randint(0, 70))]
        yield rng.choice(TASKS), "\n".join(lines) + rng.choice(("", "\n", "\r\n"))


@pytest.mark.parametrize("size", [1, 7, 60])
def test_pieces_give_the_findings_of_whole_logs(spark, size):
    builds = made(spark, [*random_logs(150, size), ("do_fetch", None), ("do_patch", ""), ("do_compile", "\n")])
    failures = failures_of(builds)
    assert rows(analyze_pieces(builds, failures, cut(failures, size)).findings) == rows(analyze(builds).findings)


def test_lines_over_pieces_are_whole(spark):
    pieces = spark.createDataFrame([("b", 0, p, t) for p, t in [(0, "a"), (3, "b\r"), (4, "\n"), (9, None), (10, "ERROR: c\nd\n\nNOT"), (11, "E: e"), (12, "\n")]], "build_key string, failure_ord int, piece bigint, text string")
    found = sorted((x["n"], x["level"], x["text"]) for b in blocks_of(pieces).collect() for x in b["lines"])
    assert [x[1:] for x in found] == [(None, "ab"), ("ERROR", "c"), (None, "d"), (None, ""), ("NOTE", "e")]


def test_rules_say_what_they_read(spark):
    def sign(x):
        return line_has(x, "my own sign")

    def rule(**more):
        return Rule("own", lambda: any_line("my own sign"), lambda: hit("own", first_with("my own sign")["text"], 0.5, evidence(first_with("my own sign")["n"])), **more)

    builds = made(spark, list(random_logs(40, 5)) + [("do_x", "plain\n" * 40 + "my own sign here\n" + "plain\n" * 40)])
    failures = failures_of(builds)
    with pytest.raises(ValueError, match="own"):
        analyze_pieces(builds, failures, cut(failures, 9), [*registered_rules(), rule()])
    rules = [*registered_rules(), rule(firsts=(sign,))]
    assert rows(analyze_pieces(builds, failures, cut(failures, 9), rules).findings) == rows(analyze(builds, rules).findings)


def test_digests_are_small(spark):
    from emberlog.operators.pieces import lines_in_short

    builds = made(spark, [("do_compile", "\n".join(f"{x} {i}" for i in range(4000) for x in ("plain", "ERROR: e", "a.c:1: error: b")))])
    failures = failures_of(builds)
    kept = lines_in_short(failures, cut(failures, 1000)).select(F.size("lines")).first()[0]
    assert kept < 100


def test_no_pieces(spark):
    builds = made(spark, [("do_fetch", None)])
    failures = failures_of(builds)
    assert rows(analyze_pieces(builds, failures, cut(failures, 5)).findings) == rows(analyze(builds).findings)
    none = failures.limit(0)
    assert analyze_pieces(builds, none, cut(none, 5)).findings.count() == 0
