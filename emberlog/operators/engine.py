"""From builds to ranked findings and their groups."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog import schema
from emberlog.functions.labels import phase_rank, severity_rank
from emberlog.functions.text import collapsed, let, log_lines, redact_host, signature
from emberlog.operators.rules import ArrowRule, Rule, all_signals, fallback_rule, registered_rules, with_signals
from emberlog.operators.rules import recipe as recipe_of
from emberlog.shared import written

#: Order of findings as they were found, and their columns.
FOUND = ("build_key", "failure_ord", "rule_ord")
FIELDS = ("category", "severity", "title", "recipe", "task", "file", "line", "evidence", "confidence")


@dataclass(frozen=True)
class Report:
    """Lazy frames: builds, all findings, and their groups."""

    builds: DataFrame
    findings: DataFrame
    groups: DataFrame

    def ranked(self) -> DataFrame:
        return self.findings.orderBy(*rank_order())

    def ranked_groups(self) -> DataFrame:
        """The groups by occurrences, most first, then by signature."""
        return self.groups.orderBy(*group_order())

    def redacted(self) -> Report:
        """Titles and evidence without host identity; signatures and groups stay."""
        kept = self.findings.withColumns({"title": redact_host(F.col("title")), "evidence": F.transform("evidence", redact_host)})
        return replace(self, findings=kept)

    def filtered(self, categories: Sequence[str] = (), recipe: str | None = None) -> Report:
        """The findings of these categories and this recipe; groups stay those of all findings."""
        kept = self.findings
        if categories:
            kept = kept.where(F.col("category").isin(*categories))
        if recipe:
            kept = kept.where(F.col("recipe") == recipe)
        return replace(self, findings=kept)


def failures_of(builds: DataFrame) -> DataFrame:
    """A row for each failure of each build, failure_ord from 0."""
    each = builds.select("build_key", F.posexplode("failures").alias("failure_ord", "f"))
    return each.select("build_key", "failure_ord", "f.*")


def with_hits(failures: DataFrame, rules: Sequence[Rule | ArrowRule] | None = None) -> DataFrame:
    """failures with hits: what the rules found, in their order.

    Null where a rule does not match. Without any hit the registered fallback
    answers; rules given by hand come without it. A failure stays a row: no
    shuffle, and its lines go no further than this projection.
    """
    chosen = registered_rules() if rules is None else list(rules)
    last = fallback_rule() if rules is None else None
    by_arrow = {r.name: f"_arrow{i}" for i, r in enumerate(chosen) if isinstance(r, ArrowRule)}
    # each is evaluated once, in a column of its own
    lined = failures.withColumns({by_arrow[r.name]: r.hit() for r in chosen if r.name in by_arrow}) if by_arrow else failures
    lined = lined.withColumn("lines", with_signals(log_lines(F.col("log"))))
    return hits_of_lines(lined, chosen, last, by_arrow).drop(*by_arrow.values())


def hits_of_lines(lined: DataFrame, chosen: Sequence[Rule | ArrowRule], last: Rule | None, by_arrow: dict[str, str]) -> DataFrame:
    """lined with hits in place of its lines; by_arrow names the columns that hold what Arrow rules found."""
    lined = lined.withColumn("signals", all_signals(F.col("lines")))

    def found(r: Rule | ArrowRule) -> Column:
        if isinstance(r, Rule):
            return F.when(r.match(), r.extract())
        own = F.col(by_arrow[r.name])
        return F.when(own.isNotNull(), own.withField("recipe", F.coalesce(own["recipe"], recipe_of())))

    hits = F.array(*[found(r) for r in chosen]) if chosen else F.array()
    lined = lined.withColumn("hits", F.array_compact(hits.cast(f"array<{schema.HIT}>")))
    if last is not None:
        lined = lined.withColumn("hits", F.when(F.size("hits") == 0, F.array(last.extract())).otherwise(F.col("hits")))
    return lined.drop("lines", "signals")


def findings_of(builds: DataFrame, rules: Sequence[Rule | ArrowRule] | None = None) -> DataFrame:
    """All findings with evidence collapsed, signature and cascade_of.

    What went wrong while reading comes before a build's failures. A failure
    may give several findings. Builds without either give none.
    """
    return signed_findings(with_hits(failures_of(builds), rules), builds)


def signed_findings(hit: DataFrame, builds: DataFrame) -> DataFrame:
    """The findings of failures with hits, and those of reading their builds."""
    read = builds.select("build_key", F.lit(-1).alias("failure_ord"), F.posexplode("ingest_findings").alias("rule_ord", "h"))
    read = read.select(*FOUND, *[F.col(f"h.{c}") if c in ("category", "severity", "title", "evidence", "confidence") else F.lit(None).alias(c) for c in FIELDS])
    # outer: from an inner explode Spark infers a filter that evaluates all rules once more
    hits = hit.select("build_key", "failure_ord", F.posexplode_outer("hits").alias("rule_ord", "h"))
    hits = hits.where("rule_ord IS NOT NULL").select(*FOUND, "h.*")
    found = hits.unionByName(read)
    signed = let(collapsed(F.col("evidence")), lambda e: F.struct(e.alias("evidence"), signature(F.col("category"), F.col("title"), e).alias("signature")))
    found = found.withColumn("signed", signed).withColumns({"evidence": F.col("signed.evidence"), "signature": F.col("signed.signature")})
    return mark_cascades(found.drop("signed"))


def mark_cascades(findings: DataFrame) -> DataFrame:
    """cascade_of: the signature, for errors of a build that repeat an earlier one of it."""
    seen = Window.partitionBy("build_key", "signature", "severity").orderBy("failure_ord", "rule_ord")
    again = (F.col("severity") == "error") & (F.row_number().over(seen) > 1)
    return findings.withColumn("cascade_of", F.when(again, F.col("signature")))


#: What is known of a signature's findings of one recipe: their number, and the place of the first. States of disjoint findings merge.
GROUP_STATE = "signature string, recipe string, n bigint, place struct<build_key:string,failure_ord:int,rule_ord:int>"


def group_state(findings: DataFrame) -> DataFrame:
    """A row of GROUP_STATE for each signature and recipe."""
    return findings.groupBy("signature", "recipe").agg(F.count("*").alias("n"), F.min(F.struct(*FOUND)).alias("place"))


def merged_groups(*states: DataFrame) -> DataFrame:
    """The state of all findings that the states tell of."""
    every = states[0]
    for state in states[1:]:
        every = every.unionByName(state)
    return every.groupBy("signature", "recipe").agg(F.sum("n").alias("n"), F.min("place").alias("place"))


def groups_of(state: DataFrame) -> DataFrame:
    """(signature, occurrences, affected_recipes): recipes in the order of their first finding."""
    named = F.when(F.coalesce(F.col("recipe"), F.lit("")) != "", F.struct("place", "recipe"))
    return state.groupBy("signature").agg(
        F.sum("n").alias("occurrences"), F.transform(F.sort_array(F.collect_list(named)), lambda x: x["recipe"]).alias("affected_recipes")
    )


def group_findings(findings: DataFrame) -> DataFrame:
    """groups_of all findings: counted per signature and recipe first, so that a frequent signature is
    combined before it moves and only distinct recipes are gathered.
    """
    return groups_of(group_state(findings))


def rank_order() -> list[Column]:
    """Severity, phase of the build, confidence, recipe, signature; then as found."""
    return [
        severity_rank(F.col("severity")),
        phase_rank(F.col("category")),
        F.col("confidence").desc(),
        F.coalesce(F.col("recipe"), F.lit("")),
        F.col("signature"),
        *[F.col(c) for c in FOUND],
    ]


def group_order() -> list[Column]:
    return [F.col("occurrences").desc(), F.col("signature")]


def placed(df: DataFrame, order: list[Column] | None = None) -> DataFrame:
    """df with rank, from 1, in the order of findings or in the one given.

    Rows are cut into ranges, which are written to the shared folder; only the
    ranges' counts meet in one task, and rows are numbered within their range.
    """
    order = rank_order() if order is None else order
    ranges = written(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranges.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranges.withColumn("_inside", inside).join(counts, "_range").withColumn("rank", F.col("_before") + F.col("_inside")).drop("_range", "_before", "_inside")


def analyze(builds: DataFrame, rules: Sequence[Rule | ArrowRule] | None = None) -> Report:
    """The report of builds; rules given by hand replace the registered ones and their fallback."""
    findings = findings_of(builds, rules)
    return Report(builds, findings, group_findings(findings))


def with_occurrences(findings: DataFrame, groups: DataFrame) -> DataFrame:
    """findings with their group's occurrences and affected recipes; 1 and the own recipe without a group."""
    own = F.when(F.coalesce(F.col("recipe"), F.lit("")) != "", F.array("recipe")).otherwise(F.array().cast("array<string>"))
    return findings.join(groups, "signature", "left").withColumns(
        {"occurrences": F.coalesce("occurrences", F.lit(1)), "affected_recipes": F.coalesce("affected_recipes", own)}
    )


def cap_evidence(findings: DataFrame, most: int) -> DataFrame:
    """The last most lines of evidence: none for 0, all for less. Signatures stay."""
    if most < 0:
        return findings
    tail = F.slice("evidence", F.greatest(F.size("evidence") - most + 1, F.lit(1)), most) if most else F.array().cast("array<string>")
    return findings.withColumn("evidence", tail)


def over_threshold(findings: DataFrame, fail_on: str) -> bool:
    """Whether a finding is at least as severe; none: never."""
    from emberlog.functions.labels import SEVERITY_RANK

    return fail_on != "none" and not findings.where(severity_rank(F.col("severity")) <= SEVERITY_RANK[fail_on]).isEmpty()


def totals(findings: DataFrame) -> dict:
    """errors, warnings, and findings by category."""
    rows = findings.groupBy("category").agg(F.count("*").alias("n"), F.count_if(F.col("severity") == "error").alias("e"), F.count_if(F.col("severity") == "warning").alias("w"))
    by = {r["category"]: r for r in rows.collect()}  # a row for each category
    return {"errors": sum(r["e"] for r in by.values()), "warnings": sum(r["w"] for r in by.values()), "by_category": {k: by[k]["n"] for k in sorted(by)}}
