"""Trends over runs: what is new, recurring, regressed or fixed.

rows hold a row for each finding of each run: run_ord, signature and what else
is known of it. All is joins and aggregates by signature.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STATUS = ("new", "recurring", "regressed")
#: The state of a signature's history; see history_state.
HISTORY = (
    "signature string, first_ord bigint, first_seen_run string, first_seen_at string, last_ord bigint, last_seen_run string, "
    "last_seen_at string, runs_present bigint, total_occurrences bigint, streak bigint"
)


def run_rows(runs: DataFrame) -> DataFrame:
    """The findings of all runs; a finding without a signature has the empty one."""
    each = runs.select("run_ord", "run_id", "recorded_at", F.posexplode("findings").alias("place", "f")).select("run_ord", "run_id", "recorded_at", "place", "f.*")
    return each.withColumns({"signature": F.coalesce("signature", F.lit("")), "category": F.coalesce("category", F.lit("unknown")), "severity": F.coalesce("severity", F.lit("error")), "title": F.coalesce("title", F.lit(""))})


def baseline_run(runs: DataFrame, baseline: str | None = None) -> tuple[int, str, str] | None:
    """(run_ord, run_id, recorded_at) of the last run, or of the first run of that id. No runs: None."""
    chosen = runs if baseline is None else runs.where(F.col("run_id") == baseline)
    order = F.col("run_ord").desc() if baseline is None else F.col("run_ord")
    row = chosen.orderBy(order).select("run_ord", "run_id", "recorded_at").first()
    if row is None:
        if baseline is not None and not runs.isEmpty():
            raise ValueError(f"unknown baseline run_id: {baseline}")
        return None
    return tuple(row)


def classify(current: DataFrame, rows: DataFrame, baseline_ord: int | None) -> DataFrame:
    """(signature, status) of every signature in current.

    recurring: in the baseline run; regressed: not there, but in an older run;
    new: in neither. Later runs say nothing. The runs' rows become one row for
    each signature before they meet the current ones.
    """
    known = rows.where(F.col("run_ord") <= (-1 if baseline_ord is None else baseline_ord))
    known = known.groupBy("signature").agg(F.max("run_ord").alias("last"))
    joined = current.select("signature").distinct().join(known, "signature", "left")
    status = F.when(F.col("last") == baseline_ord, "recurring").when(F.col("last").isNotNull(), "regressed") if baseline_ord is not None else F.lit(None).cast("string")
    return joined.select("signature", F.coalesce(status, F.lit("new")).alias("status"))


def fixed(current: DataFrame, rows: DataFrame, baseline_ord: int | None) -> DataFrame:
    """The baseline's first row of each signature that is not in current any more."""
    base = rows.where(F.col("run_ord") == (-1 if baseline_ord is None else baseline_ord))
    once = Window.partitionBy("signature").orderBy("place")
    gone = base.join(current.select("signature").distinct(), "signature", "left_anti")
    return gone.withColumn("r", F.row_number().over(once)).where("r = 1").drop("r")


def with_status(findings: DataFrame, status: DataFrame) -> DataFrame:
    """findings with the status of their signature; recurring where none is known."""
    return findings.join(status, "signature", "left").withColumn("status", F.coalesce("status", F.lit("recurring")))


def new_findings(status: DataFrame) -> bool:
    """The gate: whether a signature is not recurring."""
    return not status.where("status <> 'recurring'").isEmpty()


def history_state(rows: DataFrame) -> DataFrame:
    """What is known of each signature from the rows of some runs in a row: a row of HISTORY each.

    rows are counted per run first. streak is the number of runs without a gap
    that ends with last_ord; run_ord counts runs from 0 without gaps.
    """
    per_run = rows.groupBy("signature", "run_ord").agg(F.count("*").alias("n"), F.min("run_id").alias("run_id"), F.min("recorded_at").alias("recorded_at"))
    # runs in a row share run_ord less their number
    place = Window.partitionBy("signature").orderBy("run_ord")
    per_run = per_run.withColumn("island", F.col("run_ord") - F.row_number().over(place))
    newest = F.max("island").over(Window.partitionBy("signature"))
    per_run = per_run.withColumn("newest", F.col("island") == newest)
    return per_run.groupBy("signature").agg(
        F.min("run_ord").alias("first_ord"),
        F.min_by("run_id", "run_ord").alias("first_seen_run"),
        F.min_by("recorded_at", "run_ord").alias("first_seen_at"),
        F.max("run_ord").alias("last_ord"),
        F.max_by("run_id", "run_ord").alias("last_seen_run"),
        F.max_by("recorded_at", "run_ord").alias("last_seen_at"),
        F.count("*").alias("runs_present"),
        F.sum("n").alias("total_occurrences"),
        F.count_if("newest").alias("streak"),
    )


def merge_history(older: DataFrame, newer: DataFrame) -> DataFrame:
    """The states of earlier and of later runs as one: a join of a row each, however many runs they tell of."""
    a, b = older.alias("a"), newer.alias("b")
    both = a.join(b, F.col("a.signature") == F.col("b.signature"), "full_outer")
    either = lambda c, first, then: F.when(F.col(f"{first}.signature").isNotNull(), F.col(f"{first}.{c}")).otherwise(F.col(f"{then}.{c}"))
    # a later streak goes on with an earlier one if that ends with the run before it
    goes_on = F.col("a.last_ord") + 1 == F.col("b.last_ord") - F.col("b.streak") + 1
    streak = F.when(goes_on, F.col("a.streak") + F.col("b.streak")).otherwise(either("streak", "b", "a"))
    total = lambda c: F.coalesce(F.col(f"a.{c}"), F.lit(0)) + F.coalesce(F.col(f"b.{c}"), F.lit(0))
    return both.select(
        either("signature", "a", "b").alias("signature"),
        *[either(c, "a", "b").alias(c) for c in ("first_ord", "first_seen_run", "first_seen_at")],
        *[either(c, "b", "a").alias(c) for c in ("last_ord", "last_seen_run", "last_seen_at")],
        total("runs_present").alias("runs_present"),
        total("total_occurrences").alias("total_occurrences"),
        streak.alias("streak"),
    )


def history_of(state: DataFrame, last_ord: int | None) -> DataFrame:
    """First and last run, runs present, occurrences and current streak of each signature, last_ord being the last of all runs."""
    streak = F.when(F.col("last_ord") == F.lit(last_ord), F.col("streak")).otherwise(0)
    return state.withColumn("current_streak", streak.cast("bigint")).drop("first_ord", "last_ord", "streak")


def history(rows: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """history_of all rows. The streak counts up to the last of runs, which may have no findings; without runs, up to the last that has some."""
    last_ord = (rows if runs is None else runs).agg(F.max("run_ord")).first()[0]
    return history_of(history_state(rows), last_ord)


def run_ids(rows: DataFrame, tool_version: str) -> DataFrame:
    """(run_ord, run_id): a hash of all signatures of a run in order, repeats included, and the version."""
    text = F.concat(F.array_join(F.sort_array(F.collect_list("signature")), "\n"), F.lit("\n" + tool_version))
    return rows.groupBy("run_ord").agg(F.concat(F.lit("sha1:"), F.sha1(text)).alias("run_id"))
