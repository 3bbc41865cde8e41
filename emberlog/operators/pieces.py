"""Findings of logs that are larger than a row: a log is many pieces, cut anywhere.

Rules read little of a log: the first lines that hold a signal or match a
pattern, a few lines before them, and the log's end. A digest keeps these lines
of a piece, and digests of neighbours merge into that of both, so that pieces
are reduced where they are read and only digests move: pairs of pieces never
meet. The rules then see the digest of a whole log as if it were the log.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.functions.text import first, let, level_of, without_level
from emberlog.operators import rules as r
from emberlog.operators.engine import Report, group_findings, hits_of_lines, signed_findings
from emberlog.shared import written

KEY = ("build_key", "failure_ord")
FAN = 64
#: A line's place in its log: the piece that it begins in, and the line of that piece.
PLACE_BITS = 32
#: What a match of the fetch patterns over several lines leaves at the end of its first line.
OPEN_ERROR = r"(?Ud)FetchError\('[^']*(?:'(?:,\s*(?:'[^']*'?)?)?)?\z"
OPEN_URI = r"(?Ud)'(?:git|https?|ftp|ssh|svn|npm|file|s3|crate)://[^']*\z"
Test = Callable[[Column], Column]


def cut(failures: DataFrame, size: int) -> DataFrame:
    """Pieces of size code points of each failure's log: build_key, failure_ord, piece from 0, text. None for an empty log."""
    log = F.coalesce("log", F.lit(""))
    starts = F.when(log != "", F.sequence(F.lit(0), F.floor((F.char_length(log) - 1) / size).cast("int")))
    return failures.select(*KEY, log.alias("_log"), F.explode(starts).alias("piece")).select(
        *KEY, F.col("piece").cast("bigint").alias("piece"), F.expr(f"substring(_log, piece * {size} + 1, {size})").alias("text")
    )


def _of_level(level: str) -> Test:
    return lambda x: F.coalesce(x["level"] == level, F.lit(False))


def _like(pattern: str, *signals: str) -> Test:
    return lambda x: r.line_has(x, *signals) & x["text"].rlike(pattern)


def _signal(*signals: str) -> Test:
    return lambda x: r.line_has(x, *signals)


def _scoped(pattern: str, mark: str, errors: bool) -> Test:
    """Lines with a match of a fetch pattern, among the errors or all lines."""
    test = lambda x: x["text"].contains(mark) & x["text"].rlike(pattern)
    return (lambda x: _of_level("ERROR")(x) & test(x)) if errors else test


#: What is searched for in a do_fetch log's errors, or all lines if it has no error's text: (whole match in a line, match left open).
_FETCH = {e: ((_scoped(r.FETCH_ERROR, "FetchError(", e), _scoped(OPEN_ERROR, "FetchError(", e)), (_scoped(r.FETCH_URI, "://", e), _scoped(OPEN_URI, "://", e))) for e in (True, False)}
#: Tests whose first line is kept; evidence is kept up to the first line of each of FOCI.
_FIRSTS: tuple[Test, ...] = (
    *[_signal(s) for s in r.SIGNALS],
    _like(r.CONFIGURE_PACKAGE, "considered to be NOT"),
    _like(r.CONFIGURE_PLACE, r.CMAKE_LISTS),
    _like(r.COMPILE_PLACE, "error:"),
    _like(r.DEPENDENCY_NAME, *r.DEPENDENCY_SIGNALS),
    _like(r.PATCH_REJECTS, r.REJECTS),
    r.patch_name_test,
    *[test for pairs in _FETCH.values() for pair in pairs for test in pair],
)
_FOCI: tuple[Test, ...] = (
    _signal("considered to be NOT", "CMake Error"),
    *[_signal(s) for s in r.COMPILE_SIGNALS],
    lambda x: F.coalesce(r.reason_test(x), F.lit(False)),
    r.hunk_test,
    _of_level("ERROR"),
)


def _last(found: Column, test: Test) -> Column:
    return let(F.filter(found, test), lambda a: F.get(a, F.size(a) - 1))


def digest(found: Column, firsts: Sequence[Test] = ()) -> Column:
    """The lines of found, in order, that rules can read: what it keeps of two neighbours, it keeps of their digests.

    firsts are those of further rules. The first line of a QA class counts
    (times) for all of the class, others for none.
    """

    def made(lines: Column) -> Column:
        marked = F.filter(lines, lambda x: (x["signals"] != 0) | _of_level("ERROR")(x) | _of_level("WARNING")(x) | x["text"].contains("://"))
        return let(marked, lambda m: chosen(lines, m))

    def chosen(lines: Column, m: Column) -> Column:
        hunk = first(m, r.hunk_test)["n"]
        single = [first(m, t) for t in _FIRSTS]
        single += [first(lines, t) for t in firsts]
        single += [_last(m, _of_level("ERROR")), _last(m, r.patched_test)]
        single.append(let(hunk, lambda n: _last(m, lambda x: (x["n"] <= n) & r.patched_test(x))))
        foci = [first(m, t)["n"] for t in _FOCI] + [_last(m, _of_level("WARNING"))["n"]] + [first(lines, t)["n"] for t in firsts]
        focus_lines = [first(m, t) for t in _FOCI] + [_last(m, _of_level("WARNING"))]

        def windows(pool: Column) -> Column:
            upto = F.transform(F.array_distinct(F.array_compact(F.array(*foci))), lambda n: r.tail(F.filter(pool, lambda x: x["n"] <= n)))
            return F.flatten(F.array_append(upto, r.tail(pool)))

        issues = F.transform(F.filter(m, lambda x: r.line_has(x, r.QA_ISSUE)), lambda x: F.struct(r.qa_class(x["text"]).alias("class"), x.alias("line")))

        def counted(found: Column) -> Column:
            def one(c: Column) -> Column:
                of = F.filter(found, lambda x: x["class"] == c)
                return F.get(of, F.lit(0))["line"].withField("times", F.aggregate(of, F.lit(0).cast("bigint"), lambda a, x: a + x["line"]["times"]))

            return F.transform(F.array_distinct(F.transform(found, lambda x: x["class"])), one)

        def joined(classes: Column) -> Column:
            others = F.concat(F.array_compact(F.array(*single, *focus_lines)), let(r.quiet(lines), windows))
            silent = F.array_distinct(F.transform(others, lambda x: x.withField("times", F.lit(0).cast("bigint"))))
            own = F.transform(classes, lambda x: x["n"])
            return F.array_sort(F.concat(classes, F.filter(silent, lambda x: ~F.array_contains(own, x["n"]))))

        return let(let(issues, counted), joined)

    return let(found, made)


def _line(n: Column, raw: Column) -> Column:
    text = F.regexp_replace(raw, r"\r\z", "")
    return F.struct(n.alias("n"), level_of(text).alias("level"), without_level(text).alias("text"))


def _place(piece: Column, i: Column) -> Column:
    return F.shiftleft(piece, PLACE_BITS) + i


def blocks_of(pieces: DataFrame) -> DataFrame:
    """The lines of pieces: build_key, failure_ord, piece, lines (with signals), each line once, whole.

    Lines within a piece stay there. Those over the ends of pieces are put
    together: a row for each piece, with its two ends, meets the others of its
    log. A line must fit into a row. n orders the lines of a log.
    """
    split = pieces.select(*KEY, "piece", F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("p")).withColumn("k", F.size("p") - 1)
    inner = F.transform(F.slice("p", 2, F.greatest(F.col("k") - 1, F.lit(0))), lambda x, i: _line(_place(F.col("piece"), i + 1), x))
    within = split.where("k > 1").select(*KEY, "piece", inner.alias("lines"))

    before = Window.partitionBy(*KEY).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    ends = split.select(*KEY, "piece", "k", F.get("p", F.lit(0)).alias("head"), F.when(F.col("k") > 0, F.get("p", F.col("k"))).alias("tail"))
    ends = ends.withColumn("g", F.coalesce(F.sum((F.col("k") > 0).cast("bigint")).over(before), F.lit(0)))
    part = lambda g, i, text, ends_here: F.struct(g.alias("g"), _place(F.col("piece"), i).alias("n"), text.alias("text"), ends_here.alias("whole"))
    both = F.array(part(F.col("g"), F.lit(0), F.col("head"), F.col("k") > 0), part(F.col("g") + 1, F.col("k"), F.col("tail"), F.lit(False)))
    parts = ends.select(*KEY, F.explode(both).alias("e")).select(*KEY, "e.*").where("text IS NOT NULL")
    over = parts.groupBy(*KEY, "g").agg(F.sort_array(F.collect_list(F.struct("n", "text"))).alias("parts"), F.bool_or("whole").alias("whole"))
    over = over.select(*KEY, F.get("parts", F.lit(0))["n"].alias("n"), F.array_join(F.transform("parts", lambda x: x["text"]), "").alias("raw"), "whole")
    # the piece behind a last newline is no line
    over = over.where("whole OR raw <> ''").select(*KEY, F.shiftright("n", PLACE_BITS).alias("piece"), F.array(_line(F.col("n"), F.col("raw"))).alias("lines"))
    return within.unionByName(over).withColumn("lines", r.with_signals(F.col("lines")))


def merged(digests: DataFrame, last: int, firsts: Sequence[Test] = ()) -> DataFrame:
    """build_key, failure_ord, lines: the digest of each log, FAN neighbours at a time; last is the largest piece."""
    while True:
        last //= FAN
        digests = digests.groupBy(*KEY, F.expr(f"piece DIV {FAN}").alias("piece")).agg(F.array_sort(F.flatten(F.collect_list("lines"))).alias("lines"))
        digests = digests.withColumn("lines", digest(F.col("lines"), firsts))
        if not last:
            return digests.drop("piece")
        digests = written(digests, "digests")


def _open_ranges(logs: DataFrame) -> DataFrame:
    """The do_fetch logs with a match that is left open before the first whole one: the places to read between (no end: null), and whether errors only."""
    errors = F.filter("lines", _of_level("ERROR"))
    told = (F.size(errors) > 1) | F.exists(errors, lambda x: x["text"] != "")

    def span(pair: tuple[Test, Test]) -> Column:
        whole, left = first(F.col("lines"), pair[0])["n"], first(F.col("lines"), pair[1])["n"]
        return F.when(left.isNotNull() & (whole.isNull() | (left <= whole)), F.struct(left.alias("low"), whole.alias("high")))

    def spans(e: bool) -> Column:
        return F.array_compact(F.array(*[span(pair) for pair in _FETCH[e]]))

    found = logs.select(*KEY, told.alias("errors"), F.when(told, spans(True)).otherwise(spans(False)).alias("spans"))
    return found.where(F.size("spans") > 0)


def lines_in_short(failures: DataFrame, pieces: DataFrame, firsts: Sequence[Test] = ()) -> DataFrame:
    """failures with lines: all that rules read of their pieces, in order."""
    blocks = blocks_of(pieces)
    last = pieces.agg(F.max("piece")).first()[0] or 0
    logs = written(merged(blocks.withColumn("lines", digest(F.col("lines"), firsts)), last, firsts), "digests")
    open_ = _open_ranges(logs.join(failures.where("task = 'do_fetch'").select(*KEY), [*KEY], "left_semi"))
    if not open_.isEmpty():
        inside = lambda x: F.exists("spans", lambda s: (x["n"] >= s["low"]) & (s["high"].isNull() | (x["n"] <= s["high"])))
        wanted = lambda x: inside(x) & (~F.col("errors") | _of_level("ERROR")(x))
        more = blocks.join(open_, [*KEY]).select(*KEY, F.transform(F.filter("lines", wanted), lambda x: x.withField("times", F.lit(0).cast("bigint"))).alias("more"))
        more = more.groupBy(*KEY).agg(F.flatten(F.collect_list("more")).alias("more"))
        new = let(F.transform("lines", lambda x: x["n"]), lambda own: F.filter("more", lambda x: ~F.array_contains(own, x["n"])))
        logs = logs.join(more, [*KEY], "left").withColumn("lines", F.when(F.col("more").isNull(), F.col("lines")).otherwise(F.array_sort(F.concat("lines", new)))).drop("more")
    return failures.join(logs, [*KEY], "left").withColumn("lines", F.coalesce("lines", F.array().cast(logs.schema["lines"].dataType)))


def analyze_pieces(builds: DataFrame, failures: DataFrame, pieces: DataFrame, rules: Sequence[r.Rule] | None = None) -> Report:
    """The report that engine.analyze gives of the whole logs.

    failures has build_key, failure_ord, task, package, recipe and kind, a row
    each; pieces has build_key, failure_ord, piece (0 or more; unique within a
    log, in order, gaps allowed) and text (null: empty). builds has build_key
    and ingest_findings. A failure without pieces has an empty log; pieces
    without a failure are passed over. Rules must say what they read (firsts).
    Memory is bounded by a piece and FAN digests; but a do_fetch log with a
    quoted address that is left open keeps its lines from there to the first
    whole one, as a match may run over them.
    """
    chosen = r.registered_rules() if rules is None else list(rules)
    last = r.fallback_rule() if rules is None else None
    for rule in [*chosen, *([last] if last else [])]:
        if getattr(rule, "firsts", None) is None:
            raise ValueError(f"rule {rule.name} reads whole logs: it names no lines (firsts)")
    firsts = [t for rule in [*chosen, *([last] if last else [])] for t in rule.firsts]
    lined = lines_in_short(failures.drop("log"), pieces, firsts)
    findings = signed_findings(hits_of_lines(lined, chosen, last, {}), builds)
    return Report(builds, findings, group_findings(findings))
