"""Run stores as tables: a log of commits, and two tables partitioned by run.

    _log/000000012.json               the head of run 12, one JSON object
    findings/commit=KEY/              the findings of the run that KEY names, in rank order by place
    history/commit=KEY/               the history of every signature up to and with that run

A run counts once its head is in the log. Heads are put there under the next
number by an operation that fails if the number is taken (a link on local disks,
elsewhere a rename that does not replace), so that two writers get two numbers,
there are no gaps, and a reader never sees half a run. KEY makes an append
repeatable: what is in the log already changes nothing, and what a writer that
died has left is written over. A trend reads the baseline's findings and history
and no other partition.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from dataclasses import asdict, dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog import schema
from emberlog.functions.text import redact_host
from emberlog.operators import trend
from emberlog.operators.engine import Report, placed, totals
from emberlog.shared import written
from emberlog.sinks.documents import VERSION

KEYS = ("signature", "category", "severity", "recipe", "title")
FINDING_ROW = "place bigint, signature string, category string, severity string, recipe string, title string, commit string"
HISTORY_ROW = f"{trend.HISTORY}, commit string"


@dataclass(frozen=True)
class Head:
    """What the log has of a run."""

    run_ord: int
    key: str
    run_id: str
    recorded_at: str
    tool_version: str
    source_count: int
    errors: int
    warnings: int
    by_category: dict[str, int]

    @property
    def summary(self) -> dict:
        return {"errors": self.errors, "warnings": self.warnings, "by_category": self.by_category}


class Taken(Exception):
    """Another writer has the number."""


def set_id(findings: DataFrame, version: str) -> str:
    """An id of the signatures of a run, repeats included, and the version; the same in any order and partitioning.

    The SHA-256 of each signature is cut into four numbers, which are summed
    over all findings: an aggregate of four sums, whatever the number of
    findings. The id is the SHA-1 of the sums.
    """
    sha = F.sha2(F.coalesce("signature", F.lit("")), 256)
    parts = [F.conv(F.substring(sha, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)") for i in range(4)]
    sums = findings.agg(F.count("*").alias("n"), *[F.sum(p).alias(f"s{i}") for i, p in enumerate(parts)]).first()
    text = "\n".join(str(v or 0) for v in sums) + f"\n{version}"
    return f"set:{hashlib.sha1(text.encode()).hexdigest()}"


class RunTables:
    """The run store in the folder at path, local or of any store that Spark writes to."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _hadoop(self, name: str):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def heads(self) -> list[Head]:
        """The runs in the order of their commits: as many as there are runs, not findings."""
        at, files = self._hadoop("_log")
        if not files.exists(at):
            return []
        rows = self.spark.read.schema("value string").text(f"{self.path}/_log/*.json", wholetext=True).collect()
        return sorted((Head(**json.loads(r.value)) for r in rows), key=lambda h: h.run_ord)

    def runs(self) -> DataFrame:
        """The heads as rows of schema.RUN_HEAD."""
        rows = [(h.run_ord, h.run_id, h.recorded_at, h.tool_version, h.source_count, (h.errors, h.warnings, h.by_category)) for h in self.heads()]
        return self.spark.createDataFrame(rows, schema.RUN_HEAD)

    def _of(self, table: str, kind: str, heads: list[Head]) -> DataFrame:
        """The partitions of some runs, with what the log has of them; runs that are not in the log are not read."""
        known = self.spark.createDataFrame([(h.key, h.run_ord, h.run_id, h.recorded_at) for h in heads], "commit string, run_ord bigint, run_id string, recorded_at string")
        if not heads:
            return self.spark.createDataFrame([], kind).join(known, "commit").drop("commit")
        top = f"{self.path}/{table}"  # only the partitions that are asked for are listed
        rows = self.spark.read.schema(kind).option("basePath", top).parquet(*[f"{top}/commit={h.key}" for h in heads])
        if len(heads) == 1:
            (h,) = heads
            return rows.withColumns({"run_ord": F.lit(h.run_ord).cast("bigint"), "run_id": F.lit(h.run_id), "recorded_at": F.lit(h.recorded_at)}).drop("commit")
        return rows.join(known, "commit").drop("commit")

    def rows(self, heads: list[Head] | None = None) -> DataFrame:
        """The findings of all runs, or of some, as rows of schema.RUN_ROW."""
        return self._of("findings", FINDING_ROW, self.heads() if heads is None else heads).select("run_ord", "run_id", "recorded_at", "place", *KEYS)

    def history(self, head: Head) -> DataFrame:
        """The history of all signatures up to and with a run: a row of trend.HISTORY each, from one partition."""
        return self._of("history", HISTORY_ROW, [head]).drop("run_ord", "run_id", "recorded_at")

    def baseline(self, run_id: str | None = None) -> Head | None:
        """The last run, or the first run of that id. No runs: None."""
        heads = self.heads()
        chosen = heads[-1:] if run_id is None else [h for h in heads if h.run_id == run_id][:1]
        if heads and not chosen:
            raise ValueError(f"unknown baseline run_id: {run_id}")
        return chosen[0] if chosen else None

    def compare(self, findings: DataFrame, baseline: Head | None) -> tuple[DataFrame, DataFrame]:
        """(signature, status) of findings, and what is fixed since the baseline. Reads two partitions."""
        rows = self.rows([baseline] if baseline else [])
        at = baseline.run_ord if baseline else None
        past = self.history(baseline) if baseline else self.spark.createDataFrame([], trend.HISTORY)
        return trend.classify(findings, past.select("signature", F.col("last_ord").alias("run_ord")), at), trend.fixed(findings, rows, at)

    def _commit(self, head: Head) -> None:
        """Put a head into the log under its number, or raise Taken."""
        name, text = f"_log/{head.run_ord:09d}.json", json.dumps(asdict(head), sort_keys=True)
        at, files = self._hadoop(name)
        made, _ = self._hadoop(f"_log/.{uuid.uuid4().hex}")
        out = files.create(made, False)
        out.write(bytearray(text.encode()))
        out.close()
        try:
            if files.getScheme() == "file":
                os.link(made.toUri().getPath(), at.toUri().getPath())
            else:
                self.spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(made.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(
                    made, at, self.spark.sparkContext._gateway.new_array(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 0)
                )
        except FileExistsError as e:
            raise Taken(name) from e
        except Exception as e:
            if files.exists(at):
                raise Taken(name) from e
            raise
        finally:
            files.delete(made, False)

    def append(self, report: Report, version: str = VERSION, recorded_at: str | None = None, key: str | None = None) -> Head:
        """Add a run and return its head.

        key names the append: repeated with the same key it returns the first
        head. Without one, the run's id and time name it. Findings are
        evaluated once. Nothing passes the driver but counts and the id.
        """
        at = recorded_at or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
        if key and (done := self._found(key)):
            return done
        once = written(report.findings, "findings")
        run_id = set_id(once, version)
        key = key or hashlib.sha1(f"{run_id}\n{at}".encode()).hexdigest()
        if done := self._found(key):
            return done
        rows = placed(once).withColumn("title", redact_host(F.col("title"))).withColumn("place", F.col("rank") - 1)
        rows.select("place", *KEYS).write.mode("overwrite").parquet(f"{self.path}/findings/commit={key}")
        counts = totals(once)
        rest = {"key": key, "run_id": run_id, "recorded_at": at, "tool_version": version, "source_count": report.builds.count(), **{k: counts[k] for k in ("errors", "warnings", "by_category")}}
        while True:
            heads = self.heads()
            if done := next((h for h in heads if h.key == key), None):
                return done
            head = Head(run_ord=len(heads), **rest)
            own = self.spark.read.schema(FINDING_ROW.removesuffix(", commit string")).parquet(f"{self.path}/findings/commit={key}")
            own = own.withColumns({"run_ord": F.lit(head.run_ord).cast("bigint"), "run_id": F.lit(run_id), "recorded_at": F.lit(at)})
            past = trend.history_state(own)
            if heads:
                past = trend.merge_history(self.history(heads[-1]), past)
            past.write.mode("overwrite").parquet(f"{self.path}/history/commit={key}")
            try:
                self._commit(head)
                return head
            except Taken:  # the history is merged anew with the run that came before
                continue

    def _found(self, key: str) -> Head | None:
        return next((h for h in self.heads() if h.key == key), None)
