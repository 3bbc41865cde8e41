"""Rules: Columns that tell whether a failure is theirs, and what they find.

A rule reads the columns task, package, recipe, kind and lines of a failure, and
signals: the bits of what any of its lines holds, which every line is searched
for once. All rules are evaluated in one projection: nothing is shuffled. New rules are
registered; the core needs no change.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from emberlog import schema
from emberlog.functions.text import basename, captured, first, let, rendered, stripped

# Signals, patterns, confidences, orders.
EVIDENCE = 15
NOISE = ("NOTE", "DEBUG")
CONFIGURE_SIGNALS = ("CMake Error", "Configuring incomplete", "considered to be NOT", "NOT FOUND")
CONFIGURE_PACKAGE = r'(?Ud)package "([^"]+)" is considered to be NOT'
CONFIGURE_PLACE = r"(?Ud)(CMakeLists\.txt):(\d+)"
COMPILE_SIGNALS = ("error:", "undefined reference to", "ninja: build stopped")
COMPILE_PLACE = r"(?Ud)(\S+\.[A-Za-z][\w+]*):(\d+):(?:\d+:)?\s*error:"
DEPENDENCY_SIGNALS = ("Nothing provides", "No provider", "Nothing RPROVIDES", "No eligible RPROVIDERs")
DEPENDENCY_NAME = (
    r"(?Ud)(?:Nothing provides|No provider(?:s)? for|Nothing RPROVIDES|No eligible RPROVIDERs exist for)"
    r"\s+'?([^'\n)]+?)'?(?:\s|$|\))"
)
FETCH_SIGNALS = ("Unable to fetch", "Fetcher failure", "FetchError", "Network is unreachable", "checksum", "Unable to find revision")
FETCH_ERROR = r"(?Ud)FetchError\('([^']+)',\s*'([^']+)'\)"
FETCH_URI = r"(?Ud)'((?:git|https?|ftp|ssh|svn|npm|file|s3|crate)://[^']+)'"
PATCH_HUNK = r"(?Ud)Hunk #(\d+) FAILED at (\d+)"
PATCH_FILE = r"(?Ud)patching file (\S+)"
PATCH_REJECTS = r"(?Ud)rejects in file (\S+)"
PATCH_NAME = r"(?Ud)([\w.+-]+\.patch)"
QA_TAG = r"(?Ud)\[([\w-]+)\]\s*$"
QA_ISSUE, QA_FATAL = "QA Issue:", "Fatal QA errors were found"
HUNK, PATCHED, REJECTS, NOT_APPLIED, APPLYING, CMAKE_LISTS = "Hunk #", "patching file", "rejects in file", "does not apply", "Applying patch", "CMakeLists.txt"
#: All signals that the rules look for; a line's are kept as bits in this order.
SIGNALS = (
    *CONFIGURE_SIGNALS, *COMPILE_SIGNALS, *DEPENDENCY_SIGNALS, *FETCH_SIGNALS,
    HUNK, PATCHED, REJECTS, NOT_APPLIED, APPLYING, CMAKE_LISTS, QA_ISSUE, QA_FATAL,
)


@dataclass(frozen=True)
class Rule:
    """match and extract take no arguments: they build Columns over a failure's columns.

    firsts tests lines: of a log in pieces (operators/pieces.py) the rule sees
    the first line that passes each, and the evidence up to there. None: it
    reads whole logs only.
    """

    name: str
    match: Callable[[], Column]
    extract: Callable[[], Column]
    order: int = 10
    firsts: tuple[Callable[[Column], Column], ...] | None = None


#: What an Arrow rule reads of a failure.
ARROW_INPUT = ("task", "package", "recipe", "kind", "log")


@dataclass(frozen=True)
class ArrowRule:
    """A rule for what Columns cannot say: find gets Arrow arrays of ARROW_INPUT, a batch of failures at a time.

    It returns an array of schema.HIT, a struct for each failure, null where the
    rule does not match. A recipe that it leaves null is the failure's own. It
    runs in the projection of the other rules, and its hits come in its order
    among theirs.
    """

    name: str
    find: Callable[..., pa.Array]
    order: int = 10

    def hit(self) -> Column:
        find = self.find

        @F.arrow_udf(schema.HIT)
        def run(task_: pa.Array, package: pa.Array, recipe_: pa.Array, kind: pa.Array, log: pa.Array) -> pa.Array:
            return find(task_, package, recipe_, kind, log)

        return run(*ARROW_INPUT)


_rules: dict[str, Rule | ArrowRule] = {}
_fallback: list[Rule] = []


def register(rule: Rule | ArrowRule) -> Rule | ArrowRule:
    """Adds a rule, or takes the place of the one of its name."""
    _rules[rule.name] = rule
    return rule


def registered_rules() -> list[Rule | ArrowRule]:
    return sorted(_rules.values(), key=lambda r: (r.order, r.name))


def clear_rules() -> None:
    _rules.clear()
    _fallback.clear()


def set_fallback(rule: Rule | None) -> None:
    _fallback[:] = [rule] if rule else []


def fallback_rule() -> Rule | None:
    return _fallback[0] if _fallback else None


def lines() -> Column:
    return F.col("lines")


def has(text: Column, signals: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for s in signals:
        found = found | text.contains(s)
    return found


def signal_bits(signals: tuple[str, ...]) -> int | None:
    """The bits of signals; None if one is not kept."""
    return sum({1 << SIGNALS.index(s) for s in signals}) if set(signals) <= set(SIGNALS) else None


def with_signals(found: Column) -> Column:
    """Log lines with the bits of their signals, for which each line is searched once, and times: 1, as each stands for itself."""

    def bits(text: Column) -> Column:
        out = F.lit(0).cast("bigint")
        for i, s in enumerate(SIGNALS):
            out = out + F.when(text.contains(s), F.lit(1 << i).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
        return out

    return F.transform(found, lambda x: x.withField("signals", bits(x["text"])).withField("times", F.lit(1).cast("bigint")))


def all_signals(found: Column) -> Column:
    """The bits of all lines together."""
    return F.aggregate(found, F.lit(0).cast("bigint"), lambda a, x: a.bitwiseOR(x["signals"]))


def hunk_test(line: Column) -> Column:
    """Whether a line tells of a hunk that failed."""
    return line_has(line, HUNK) & line["text"].rlike(PATCH_HUNK)


def patched_test(line: Column) -> Column:
    return line_has(line, PATCHED) & line["text"].rlike(PATCH_FILE)


def patch_name_test(line: Column) -> Column:
    return line_has(line, NOT_APPLIED, APPLYING) & line["text"].rlike(PATCH_NAME)


def reason_test(line: Column) -> Column:
    """Whether a line is an error of fetching."""
    return (line["level"] == "ERROR") & F.lower(line["text"]).contains("fetch")


def line_has(line: Column, *signals: str) -> Column:
    """Whether a line has one of the signals: by its bits, or by its text if they are signals of another rule's own."""
    bits = signal_bits(signals)
    return has(line["text"], signals) if bits is None else line["signals"].bitwiseAND(F.lit(bits).cast("bigint")) != 0


def any_line(*signals: str) -> Column:
    bits = signal_bits(signals)
    if bits is None:
        return F.exists(lines(), lambda x: has(x["text"], signals))
    return F.col("signals").bitwiseAND(F.lit(bits).cast("bigint")) != 0


def first_with(*signals: str) -> Column:
    return F.when(any_line(*signals), first(lines(), lambda x: line_has(x, *signals)))


def first_match(pattern: str, *signals: str) -> Column:
    """Text of the first line that matches; every match holds one of the signals, if they are given."""
    if not signals:
        return first(lines(), lambda x: x["text"].rlike(pattern))["text"]
    return F.when(any_line(*signals), first(lines(), lambda x: line_has(x, *signals) & x["text"].rlike(pattern)))["text"]


def quiet(found: Column) -> Column:
    """The lines that are no noise; all of them where a log has nothing else."""
    kept = F.filter(found, lambda x: x["level"].isNull() | ~x["level"].isin(*NOISE))
    return let(kept, lambda q: F.when(F.size(q) == 0, found).otherwise(q))


def tail(found: Column) -> Column:
    return F.slice(found, F.greatest(F.size(found) - (EVIDENCE - 1), F.lit(1)), EVIDENCE)


def evidence(focus: Column | None = None) -> Column:
    """The last EVIDENCE lines up to focus that are no noise; from the end where none is that early.

    Noise counts only where a failure has nothing else.
    """

    def window(pool: Column) -> Column:
        if focus is None:
            return tail(pool)
        upto = let(focus, lambda n: F.filter(pool, lambda x: n.isNull() | (x["n"] <= n)))
        return let(upto, lambda u: tail(F.when(F.size(u) == 0, pool).otherwise(u)))

    return F.transform(let(quiet(lines()), window), rendered)


def recipe() -> Column:
    return F.coalesce(F.nullif("recipe", F.lit("")), F.col("package"))


def task() -> Column:
    return F.when(F.col("kind") == "task", F.col("task"))


def hit(
    category: str, title: Column, confidence: float, found: Column, severity: Column | None = None, file: Column | None = None, line: Column | None = None, of_task: Column | None = None
) -> Column:
    """A finding's struct."""
    none = F.lit(None)
    return F.struct(
        F.lit(category).alias("category"),
        (F.lit("error") if severity is None else severity).alias("severity"),
        title.alias("title"),
        recipe().alias("recipe"),
        (task() if of_task is None else of_task).alias("task"),
        (none if file is None else file).cast("string").alias("file"),
        (none if line is None else line).try_cast("int").alias("line"),
        found.alias("evidence"),
        F.lit(confidence).alias("confidence"),
    ).cast(schema.HIT)


def _configure() -> Column:
    package = captured(first_match(CONFIGURE_PACKAGE, "considered to be NOT"), CONFIGURE_PACKAGE)
    title = F.coalesce(F.concat(F.lit('package "'), package, F.lit('" considered NOT FOUND')), first_with("CMake Error")["text"], F.lit("Configure error"))
    place = first_match(CONFIGURE_PLACE, CMAKE_LISTS)
    focus = first_with("considered to be NOT", "CMake Error")["n"]
    return hit("configure", title, 0.85, evidence(focus), file=captured(place, CONFIGURE_PLACE), line=captured(place, CONFIGURE_PLACE, 2))


def _compile() -> Column:
    error = F.coalesce(first_with("error:"), first_with("undefined reference to"))
    place = first_match(COMPILE_PLACE, "error:")
    focus = F.coalesce(error["n"], first_with("ninja: build stopped")["n"])
    title = F.coalesce(error["text"], F.lit("Compilation failed"))
    return hit("compile", title, 0.8, evidence(focus), file=basename(captured(place, COMPILE_PLACE)), line=captured(place, COMPILE_PLACE, 2))


def _dependency() -> Column:
    name = F.coalesce(captured(F.col("task"), DEPENDENCY_NAME), captured(first_match(DEPENDENCY_NAME, *DEPENDENCY_SIGNALS), DEPENDENCY_NAME))
    name = F.nullif(stripped(name), F.lit(""))
    title = F.coalesce(F.concat(F.lit("Nothing provides '"), name, F.lit("'")), F.nullif("task", F.lit("")), F.lit("Unresolved dependency"))
    found = let(evidence(), lambda e: F.when(F.size(e) == 0, F.array(title)).otherwise(e))
    return hit("dependency", title, 0.9, found)


def _dependency_matches() -> Column:
    start = F.coalesce(F.col("task").startswith(DEPENDENCY_SIGNALS[0]) | F.col("task").startswith(DEPENDENCY_SIGNALS[1]), F.lit(False))
    return (F.col("kind") == "message") | start | any_line(*DEPENDENCY_SIGNALS)


def _fetch() -> Column:
    texts = lambda a: F.array_join(F.transform(a, lambda x: x["text"]), "\n")
    scope = F.coalesce(F.nullif(texts(F.filter(lines(), lambda x: x["level"] == "ERROR")), F.lit("")), texts(lines()))
    reason = first(lines(), reason_test)

    def title(s: Column) -> Column:
        error, uri = captured(s, FETCH_ERROR), captured(s, FETCH_URI)
        named = lambda what, where: F.concat(what, F.lit(" ("), where, F.lit(")"))
        return F.coalesce(
            named(error, captured(s, FETCH_ERROR, 2)), named(F.nullif(reason["text"], F.lit("")), uri), F.concat(F.lit("Unable to fetch "), uri), F.nullif(reason["text"], F.lit("")), F.lit("do_fetch failed")
        )

    return hit("fetch", let(scope, title), 0.85, evidence(reason["n"]), of_task=F.lit("do_fetch"))


def _patch() -> Column:
    hunk = first(lines(), hunk_test)
    before = F.filter(lines(), lambda x: (x["n"] <= hunk["n"]) & patched_test(x))
    carried = captured(F.get(before, F.size(before) - 1)["text"], PATCH_FILE)
    path = F.coalesce(carried, captured(first_match(PATCH_REJECTS, REJECTS), PATCH_REJECTS))
    named = first(lines(), patch_name_test)
    parts = F.struct(
        captured(hunk["text"], PATCH_HUNK).cast("decimal(38,0)").cast("string").alias("hunk"),
        captured(hunk["text"], PATCH_HUNK, 2).cast("decimal(38,0)").cast("string").alias("line"),
        F.nullif(basename(path), F.lit("")).alias("file"),
        captured(named["text"], PATCH_NAME).alias("patch"),
    )

    def title(p: Column) -> Column:
        at = F.concat(p["file"], F.lit(":"), p["line"])
        return F.coalesce(
            F.concat(p["patch"], F.lit(" failed: Hunk #"), p["hunk"], F.lit(" at "), at),
            F.concat(F.lit("Patch hunk #"), p["hunk"], F.lit(" failed at "), at),
            F.concat(F.lit("Patch "), p["patch"], F.lit(" does not apply")),
            F.lit("Patch failed to apply"),
        )

    return let(parts, lambda p: hit("patch", title(p), 0.9, evidence(hunk["n"]), file=p["file"], line=p["line"]))


def qa_class(text: Column) -> Column:
    """The tag at a line's end, else the first word behind QA Issue:, else qa."""
    behind = F.regexp_replace(text, r"(?s)^.*?QA Issue:", "")
    return F.coalesce(captured(text, QA_TAG), F.nullif(F.regexp_extract(behind, r"(?U)^\s*(\S+)", 1), F.lit("")), F.lit("qa"))


def _qa() -> Column:
    issues = F.transform(F.filter(lines(), lambda x: line_has(x, QA_ISSUE)), lambda x: F.struct(qa_class(x["text"]).alias("class"), x["text"].alias("text"), x["n"].alias("n"), x["times"].alias("times")))

    def counted(found: Column) -> Column:
        def one(c: Column) -> Column:
            of = F.filter(found, lambda x: x["class"] == c)
            size = F.aggregate(of, F.lit(0).cast("bigint"), lambda a, x: a + x["times"])
            return F.struct((-size).alias("order"), F.get(of, F.lit(0))["n"].alias("n"), c.alias("class"), F.get(of, F.lit(0))["text"].alias("text"))

        return F.sort_array(F.transform(F.array_distinct(F.transform(found, lambda x: x["class"])), one))

    def made(classes: Column) -> Column:
        size = lambda c: (-c["order"]).cast("string")
        listed = F.array_join(F.transform(classes, lambda c: F.concat(c["class"], F.lit(" x"), size(c))), ", ")
        title = F.when(F.size(classes) > 0, F.concat(F.lit("QA Issue: "), listed)).otherwise(F.lit(QA_FATAL))
        texts = F.transform(classes, lambda c: F.when(c["order"] < -1, F.concat(c["text"], F.lit(" (x"), size(c), F.lit(")"))).otherwise(c["text"]))
        return hit("qa", title, 0.9, F.when(F.size(classes) > 0, texts).otherwise(evidence()))

    return let(let(issues, counted), made)


def _unknown() -> Column:
    error = first(lines(), lambda x: x["level"] == "ERROR")
    warnings = F.filter(lines(), lambda x: x["level"] == "WARNING")
    line = F.coalesce(error, F.get(warnings, F.size(warnings) - 1))
    severity = F.when(error.isNull() & line.isNotNull(), F.lit("warning")).otherwise(F.lit("error"))
    title = F.coalesce(line["text"], stripped(F.coalesce(F.nullif("task", F.lit("")), F.lit("unknown failure"))))
    return hit("unknown", title, 0.3, evidence(line["n"]), severity=severity)


def register_defaults() -> None:
    """The built-in rules and fallback. What they read of logs in pieces is said in operators/pieces.py."""
    configure = lambda: any_line(*CONFIGURE_SIGNALS)
    register(Rule("configure", configure, _configure, 5, ()))
    register(Rule("compile", lambda: any_line(*COMPILE_SIGNALS) & ~configure(), _compile, firsts=()))
    register(Rule("dependency", _dependency_matches, _dependency, firsts=()))
    register(Rule("fetch", lambda: F.coalesce(F.col("task") == "do_fetch", F.lit(False)) & any_line(*FETCH_SIGNALS), _fetch, firsts=()))
    register(Rule("patch", lambda: any_line(NOT_APPLIED, REJECTS) | (any_line(HUNK) & F.exists(lines(), hunk_test)), _patch, firsts=()))
    register(Rule("qa", lambda: F.coalesce(F.col("task") == "do_package_qa", F.lit(False)) | any_line(QA_ISSUE, QA_FATAL), _qa, firsts=()))
    set_fallback(Rule("fallback", lambda: F.lit(True), _unknown, 1000, ()))


register_defaults()
