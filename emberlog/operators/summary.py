"""Token-bounded summaries: the first few findings, cut to a budget."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.functions.text import CHARS_PER_TOKEN, line_total, redact_host, redact_secrets, tokens
from emberlog.operators.engine import Report, rank_order
from emberlog.schema import BUILD_FIELDS
from emberlog.shared import written

BUDGET, TOP_K, MOST_EVIDENCE = 4000, 5, 8


@dataclass(frozen=True)
class Summary:
    build: dict | None
    findings: list[dict]
    findings_omitted: int
    log_lines_dropped: int
    config: str | None = None


def shown(findings: DataFrame, most_evidence: int = MOST_EVIDENCE) -> DataFrame:
    """findings as they may be shared: title and the last lines of evidence without host identity. 0 keeps all."""
    tail = F.slice("evidence", F.greatest(F.size("evidence") - most_evidence + 1, F.lit(1)), most_evidence) if most_evidence > 0 else F.col("evidence")
    last = F.get("evidence", F.size("evidence") - 1)
    return findings.withColumns({"title": redact_host(F.col("title")), "evidence": F.transform(tail, redact_host), "last_line": redact_host(last)})


def fitted(title: Column, evidence: Column, budget: Column | int) -> Column:
    """The most last lines of evidence that fit a budget of tokens together with the title."""
    room = F.lit(budget) if isinstance(budget, int) else budget
    starts = F.sequence(F.lit(1), F.size(evidence) + 1)
    size = lambda s: tokens(F.concat_ws("\n", title, F.slice(evidence, s, F.size(evidence))))
    cut = F.get(F.filter(starts, lambda s: (s > F.size(evidence)) | (size(s) <= room)), F.lit(0))
    return F.slice(evidence, cut, F.size(evidence))


def finding_tokens(title: Column, evidence: Column) -> Column:
    """Tokens of a finding as a summary shows it."""
    return tokens(F.concat_ws("\n", title, evidence))


def _tokens(title: str, evidence: list[str]) -> int:
    return -(-len("\n".join([title, *evidence])) // CHARS_PER_TOKEN)


def within_budget(rows: list[dict], budget: int) -> list[dict]:
    """rows (title, evidence, last_line), in order, each cut to what the ones before left.

    Ends where a title does not fit; the first always keeps its title and its
    last line of evidence.
    """
    out: list[dict] = []
    for row in rows:
        if out and (budget <= 0 or _tokens(row["title"], []) > budget):
            break
        lines = list(row["evidence"])
        while lines and _tokens(row["title"], lines) > budget:
            del lines[0]
        if not out and not lines and row["last_line"] is not None:
            lines = [row["last_line"]]
        out.append({**row, "evidence": lines})
        budget -= _tokens(row["title"], lines)
    return out


def config_text(build: DataFrame) -> DataFrame:
    """config of each build: its local and automatic configuration, without host identity and secrets."""
    told = lambda c: F.when(F.col(c).rlike(r"(?U)\S"), F.col(c))
    text = F.nullif(F.concat_ws("\n", told("local_conf"), told("auto_conf")), F.lit(""))
    return build.withColumn("config", redact_secrets(redact_host(text)))


def log_line_total(builds: DataFrame) -> int:
    """Lines of all logs."""
    each = F.aggregate("failures", F.lit(0).cast("bigint"), lambda a, f: a + line_total(f["log"]))
    return builds.agg(F.sum(each)).first()[0] or 0


def summarize(report: Report, budget: int = BUDGET, top_k: int = TOP_K, most_evidence: int = MOST_EVIDENCE, include_config: bool = False) -> Summary:
    """The summary of a report: only top_k findings and the first build reach the driver. Findings are evaluated once."""
    findings = written(report.findings, "findings")
    report = Report(report.builds, findings, report.groups)
    top = shown(report.ranked().limit(top_k), most_evidence)
    chosen = within_budget([r.asDict(recursive=True) for r in top.collect()], budget)
    first = config_text(report.builds).drop("failures", "ingest_findings", "raw").orderBy("build_key").first()
    build = first.asDict() if first else None
    return Summary(
        build,
        chosen,
        report.findings.count() - len(chosen),
        max(0, log_line_total(report.builds) - sum(len(f["evidence"]) for f in chosen)),
        build["config"] or None if build and include_config else None,
    )


SHOWN_FINDING = ("category", "severity", "recipe", "title", "file", "line", "confidence", "evidence", "signature")


def budgeted(rows: Column, kind: str, budget: int) -> Column:
    """within_budget as a fold over an array of rows, with what is left of the budget in the state; kind is the array's type."""
    none = F.array().cast(kind)

    def step(state: Column, row: Column) -> Column:
        first = F.size(state["out"]) == 0
        stop = state["done"] | (~first & ((state["left"] <= 0) | (tokens(row["title"]) > state["left"])))
        fit = fitted(row["title"], row["evidence"], state["left"])
        lines = F.when(first & (F.size(fit) == 0) & row["last_line"].isNotNull(), F.array(row["last_line"])).otherwise(fit)
        left = (state["left"] - finding_tokens(row["title"], lines)).cast("bigint")
        taken = F.concat(state["out"], F.array(row.withField("evidence", lines)))
        return F.when(stop, F.struct(state["left"].alias("left"), F.lit(True).alias("done"), state["out"].alias("out"))).otherwise(
            F.struct(left.alias("left"), F.lit(False).alias("done"), taken.alias("out"))
        )

    start = F.struct(F.lit(budget).cast("bigint").alias("left"), F.lit(False).alias("done"), none.alias("out"))
    return F.aggregate(rows, start, step, lambda state: state["out"])


def summaries(report: Report, budget: int = BUDGET, top_k: int = TOP_K, most_evidence: int = MOST_EVIDENCE) -> DataFrame:
    """A summary of every build, as summarize() makes it of one: build_key, source_path, those of BUILD_FIELDS that builds have, findings (array), findings_omitted, log_lines_dropped.

    The top_k findings of a build are found before anything is gathered, so a
    build's array has top_k rows at most, however many findings it has. Builds
    without findings have an empty array.
    """
    found = written(report.findings, "findings")
    counts = found.groupBy("build_key").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("build_key").orderBy(*rank_order()))
    top = shown(found.withColumn("place", place).where(F.col("place") <= top_k), most_evidence)
    row = F.struct("place", *SHOWN_FINDING, "last_line")
    kind = top.select(F.array(row).alias("rows")).schema["rows"].dataType.simpleString()
    chosen = top.groupBy("build_key").agg(F.sort_array(F.collect_list(row)).alias("rows")).select("build_key", budgeted(F.col("rows"), kind, budget).alias("chosen"))
    logs = F.aggregate("failures", F.lit(0).cast("bigint"), lambda a, f: a + line_total(f["log"]))
    fields = [c for c in BUILD_FIELDS if c in report.builds.columns]
    builds = report.builds.select("build_key", "source_path", *fields, logs.alias("log_lines"))
    every = builds.join(counts, "build_key", "left").join(chosen, "build_key", "left").withColumn("chosen", F.coalesce("chosen", F.array().cast(kind)))
    kept = F.aggregate("chosen", F.lit(0), lambda a, x: a + F.size(x["evidence"]))
    return every.select(
        "build_key",
        "source_path",
        *fields,
        F.transform("chosen", lambda x: x.dropFields("place", "last_line")).alias("findings"),
        (F.coalesce("n", F.lit(0)) - F.size("chosen")).alias("findings_omitted"),
        F.greatest(F.lit(0), F.col("log_lines") - kept).alias("log_lines_dropped"),
    )


def estimate_tokens(summary: Summary) -> int:
    return sum(_tokens(f["title"], f["evidence"]) for f in summary.findings)
