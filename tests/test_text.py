"""Column functions against short Python versions."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from emberlog.functions import text


def normal(s):
    s = re.sub(r"0x[0-9a-fA-F]+", "0x<HEX>", s)
    s = re.sub(r"(run\.[A-Za-z0-9_]+\.)\d+", r"\1<PID>", s)
    s = re.sub(r"([\w./+-]*\.[A-Za-z][A-Za-z0-9+]*):\d+(?::\d+)?", r"\1:<N>", s)
    return re.sub(r"\bline \d+\b", "line <N>", s)


def host(s):
    s = re.sub(r'SSH_AUTH_SOCK="[^"]*"', 'SSH_AUTH_SOCK="<redacted>"', s)
    s = re.sub(r"/[\w.+-]+/[\w.+-]+/\.(?:gnupg|ssh)/[\w./+-]*", "<redacted-path>", s)
    return re.sub(r"/[\w.+-]+/[\w.+-]+/\d{4}-\d{2}-\d{2}", "HOSTDIR", s)


def secrets(s):
    keyword = re.compile("password|passwd|secret|token|api[_-]?key|private[_-]?key|credential", re.I)
    return "\n".join("# [redacted secret]" if keyword.search(x) else x for x in s.splitlines())


def random_texts(n):
    rnd = random.Random(8)
    parts = ["0x1F", "0x", "run.do_x.12", "a/b.c:3:4", "é.c:٣", "line 7", "line ٣", "xline 1", ":", ".", " ", "\n", "\r\n", "\x0b", " ", "/home/me/.ssh/id", "/srv/u/2024-01-02/x", "token", "API-Key", "ERROR: ", "NOTE:", " WARNING: ", 'SSH_AUTH_SOCK="/x"', "ß", "\r"]
    return ["".join(rnd.choices(parts, k=rnd.randint(0, 12))) for _ in range(n)]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(t,) for t in random_texts(600)], "t string").repartition(2)


def test_substitutions(texts):
    t = F.col("t")
    rows = texts.select(t, text.normalized(t).alias("n"), text.redact_host(t).alias("h"), text.redact_secrets(t).alias("s"), text.tokens(t).alias("k")).collect()
    for r in rows:
        assert r.n == normal(r.t) and normal(r.n) == r.n
        assert r.h == host(r.t)
        assert r.s == secrets(r.t)
        assert r.k == -(-len(r.t) // 4)


def test_log_lines_and_totals(texts):
    for r in texts.select("t", text.log_lines(F.col("t")).alias("x"), text.line_total(F.col("t")).alias("k")).collect():
        pieces = r.t.split("\n")
        pieces = pieces[:-1] if pieces[-1] == "" else pieces
        want = []
        for i, p in enumerate(pieces):
            p = p[:-1] if p.endswith("\r") else p
            m = re.match(r"(ERROR|WARNING|NOTE|DEBUG):\s?", p)
            want.append((i + 1, m[1] if m else None, p[m.end() :] if m else p))
        assert [tuple(x) for x in r.x] == want
        assert r.k == (r.t.count("\n") + 1 if r.t else 0)


def test_null_logs(spark):
    row = spark.range(1).select(text.log_lines(F.lit(None).cast("string")).alias("x"), text.line_total(F.lit(None).cast("string")).alias("k")).first()
    assert (row.x, row.k) == ([], 0)


def test_signature_and_collapse(spark):
    lines = ["at a.c:1", "at a.c:2", "boom", "boom", "boom", "next", "at a.c:1"]
    df = spark.createDataFrame([(lines,), ([],), (None,)], "e array<string>")
    rows = df.select(text.collapsed(F.col("e")).alias("c"), text.signature(F.lit("compile"), F.lit("x line 4"), F.col("e")).alias("s")).collect()
    assert rows[0].c == ["at a.c:1 (x2)", "boom (x3)", "next", "at a.c:1"] and rows[1].c == []
    sha = lambda s: "sha1:" + hashlib.sha1(s.encode()).hexdigest()
    assert rows[0].s == sha("compile\nx line <N>\nat a.c:<N>") and rows[1].s == sha("compile\nx line <N>\n")


def test_backtrace(spark):
    log = "x\nBacktrace (BB generated script): \n\t#1: do_it, /tmp/run.sh, line 12\n  #2: main, /tmp/a b.sh, line 3\nend\n#3: no, /x, line 1"
    got = spark.createDataFrame([(log,), ("#1: a, b, line 2",)], "log string").select(text.backtrace(text.log_lines(F.col("log"))).alias("b")).collect()
    assert [tuple(f) for f in got[0].b] == [(1, "do_it", "/tmp/run.sh", 12), (2, "main", "/tmp/a b.sh", 3)] and got[1].b == []
