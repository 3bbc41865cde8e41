"""Text as Columns: log lines, levels, normalisation, redaction, signatures.

Patterns carry (?Ud): word, digit and space classes cover all of Unicode, and
a dot stops at a newline only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values. With a pattern of NORMAL and HOST: what any text that it changes holds.
LEVEL = r"(?Ud)^(ERROR|WARNING|NOTE|DEBUG):\s?"
NORMAL = (
    (r"(?Ud)0x[0-9a-fA-F]+", "0x<HEX>", r"0x"),
    (r"(?Ud)(run\.[A-Za-z0-9_]+\.)\d+", "$1<PID>", r"run\."),
    (r"(?Ud)([\w./+-]*\.[A-Za-z][A-Za-z0-9+]*):\d+(?::\d+)?", "$1:<N>", r"(?U)[A-Za-z0-9+]:\d"),
    (r"(?Ud)\bline \d+\b", "line <N>", r"(?U)line \d"),
)
HOST = (
    (r'(?Ud)SSH_AUTH_SOCK="[^"]*"', 'SSH_AUTH_SOCK="<redacted>"', r"SSH_AUTH_SOCK"),
    (r"(?Ud)/[\w.+-]+/[\w.+-]+/\.(?:gnupg|ssh)/[\w./+-]*", "<redacted-path>", r"/\.(?:gnupg|ssh)/"),
    (r"(?Ud)/[\w.+-]+/[\w.+-]+/\d{4}-\d{2}-\d{2}", "HOSTDIR", r"(?U)/\d{4}-\d"),
)
SECRET = r"(?Uid)password|passwd|secret|token|api[_-]?key|private[_-]?key|credential"
SECRET_LINE = "# [redacted secret]"
LINE_ENDS = r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x85\x{2028}\x{2029}]"
FRAME_HEADER = "Backtrace (BB generated script)"
FRAME = r"(?Ud)^\s*#(\d+):\s*([^,]+?),\s*(.+?),\s*line\s+(\d+)\s*$"
CHARS_PER_TOKEN = 4


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value evaluated once even where lambdas read it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def first(items: Column, test: Callable[[Column], Column]) -> Column:
    """The first element that passes, else null."""
    return F.get(F.filter(items, test), F.lit(0))


def captured(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, null where nothing matches."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def level_of(text: Column) -> Column:
    """ERROR, WARNING, NOTE or DEBUG at the very start of a line, else null."""
    return captured(text, LEVEL)


def without_level(text: Column) -> Column:
    return F.regexp_replace(text, LEVEL, "")


def log_texts(log: Column) -> Column:
    """Lines of a log: split at \\n, without one last empty piece and one \\r each; null and empty: none."""
    pieces = F.split(F.coalesce(log, F.lit("")), "\n", -1)
    whole = lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, 1, F.size(p) - 1)).otherwise(p)
    return F.transform(let(pieces, whole), lambda x: F.regexp_replace(x, r"\r\z", ""))


def log_lines(log: Column) -> Column:
    """array<struct<n, level, text>> of a log, n from 1."""
    return F.transform(
        log_texts(log),
        lambda x, i: F.struct((i + 1).cast("int").alias("n"), level_of(x).alias("level"), without_level(x).alias("text")),
    )


def rendered(line: Column) -> Column:
    """A line with its level in front again."""
    return F.when(line["level"].isNull(), line["text"]).otherwise(F.concat(line["level"], F.lit(": "), line["text"]))


def line_total(log: Column) -> Column:
    """Newlines plus one, 0 for an empty log: counts the piece behind a last newline too."""
    log = F.coalesce(log, F.lit(""))
    return F.when(log == "", 0).otherwise(F.char_length(log) - F.char_length(F.replace(log, F.lit("\n"), F.lit(""))) + 1).cast("bigint")


def backtrace(lines: Column) -> Column:
    """Frames that follow the first backtrace header without a gap: array<struct<index, func, path, line>>."""
    head = first(lines, lambda x: x["text"].startswith(FRAME_HEADER))["n"]

    def after(n: Column) -> Column:
        rest = F.filter(lines, lambda x: x["n"] > n)
        stop = first(rest, lambda x: ~x["text"].rlike(FRAME))["n"]
        return let(stop, lambda s: F.filter(rest, lambda x: s.isNull() | (x["n"] < s)))

    part = lambda x, g: F.trim(F.regexp_extract(x["text"], FRAME, g))
    frame = lambda x: F.struct(
        part(x, 1).try_cast("int").alias("index"), part(x, 2).alias("func"), part(x, 3).alias("path"), part(x, 4).try_cast("int").alias("line")
    )
    return F.transform(let(head, after), frame)


def _replaced(text: Column, steps: tuple[tuple[str, str, str], ...]) -> Column:
    """All steps in order. Their patterns try many starts, so they run only on texts that hold their mark."""
    for pattern, by, mark in steps:
        text = let(text, lambda t: F.when(t.rlike(mark), F.regexp_replace(t, pattern, by)).otherwise(t))  # noqa: B023
    return text


def normalized(text: Column) -> Column:
    """text without what changes from run to run: addresses, process ids, line numbers. Idempotent."""
    return _replaced(text, NORMAL)


def redact_host(text: Column) -> Column:
    return _replaced(text, HOST)


def is_secret(line: Column) -> Column:
    return line.rlike(SECRET)


def redact_secrets(text: Column) -> Column:
    """Each line with a secret's keyword becomes a note; other lines stay. A last line end goes."""
    pieces = F.split(text, LINE_ENDS, -1)
    whole = lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, 1, F.size(p) - 1)).otherwise(p)
    return F.array_join(F.transform(let(pieces, whole), lambda x: F.when(is_secret(x), F.lit(SECRET_LINE)).otherwise(x)), "\n")


def tokens(text: Column) -> Column:
    """Code points by four, rounded up."""
    return F.ceil(F.char_length(text) / CHARS_PER_TOKEN).cast("bigint")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def signature(category: Column, title: Column, evidence: Column) -> Column:
    """sha1 of the normalised category, title and first evidence line."""
    head = F.coalesce(F.get(evidence, F.lit(0)), F.lit(""))
    return F.concat(F.lit("sha1:"), F.sha1(normalized(F.concat_ws("\n", category, title, head))))


def collapsed(texts: Column) -> Column:
    """Neighbours that are equal when normalised become the first of them with (xN). For short arrays."""
    named = F.transform(texts, lambda x: F.struct(x.alias("text"), normalized(x).alias("norm")))

    def heads(p: Column) -> Column:
        at = F.transform(p, lambda x, i: F.struct(i.alias("i"), x["text"].alias("text"), ((i == 0) | (F.get(p, i - 1)["norm"] != x["norm"])).alias("head")))
        return F.filter(at, lambda x: x["head"])

    def counted(h: Column) -> Column:
        size = lambda x, k: F.coalesce(F.get(h, k + 1)["i"], F.size(texts)) - x["i"]
        return F.transform(h, lambda x, k: F.when(size(x, k) > 1, F.concat(x["text"], F.lit(" (x"), size(x, k), F.lit(")"))).otherwise(x["text"]))

    return let(let(named, heads), counted)


def location(file: Column, line: Column) -> Column:
    """file[:line]; null without a file."""
    return F.when(F.nullif(file, F.lit("")).isNotNull(), F.concat_ws(":", file, F.nullif(line, F.lit(0)).cast("string")))
