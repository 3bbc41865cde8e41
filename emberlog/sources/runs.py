"""Run stores in the order of their recording: JSON Lines, one run a line, or a folder of tables."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberlog import schema
from emberlog.sources.decoding import text

_TEXT = pa.string()
_FINDING = pa.struct([(k, _TEXT) for k in ("signature", "category", "severity", "recipe", "title")])
_SUMMARY = pa.struct([("errors", pa.int64()), ("warnings", pa.int64()), ("by_category", pa.map_(_TEXT, pa.int64()))])
_RUN = [("run_id", _TEXT), ("recorded_at", _TEXT), ("tool_version", _TEXT), ("source_count", pa.int32()), ("findings", pa.list_(_FINDING)), ("summary", _SUMMARY)]
LINE = "block bigint, line bigint, part int, " + schema.RUN.removeprefix("run_ord bigint, ")
_LINE = pa.schema([("block", pa.int64()), ("line", pa.int64()), ("part", pa.int32()), *_RUN])
#: What a finding has where a key is missing; one that is null stays so.
DEFAULTS = {"signature": "", "category": "unknown", "severity": "error", "recipe": None, "title": ""}


def _number(value: object) -> int | None:
    """Whole numbers, also as texts; null stays null, anything else is 0."""
    if value is None:
        return None
    try:
        return max(-(1 << 31), min((1 << 31) - 1, int(value)))
    except (TypeError, ValueError, OverflowError):
        return 0


def _summary(value: object) -> dict | None:
    if not isinstance(value, dict):
        return None
    by = value.get("by_category")
    return {**{k: _number(value.get(k)) for k in ("errors", "warnings")}, "by_category": [(str(k), _number(v)) for k, v in by.items()] if isinstance(by, dict) else None}


def decode_run(line: str) -> dict | None:
    """A run from a line of a store, by the rules of Python's json; None if the line is no JSON object.

    Of its findings those that are objects count, whatever the others are.
    """
    try:
        data = json.loads(line)
    except (json.JSONDecodeError, RecursionError):
        return None
    if not isinstance(data, dict):
        return None
    listed = data.get("findings")
    findings = [{k: text(f.get(k, d)) for k, d in DEFAULTS.items()} for f in (listed if isinstance(listed, list) else ()) if isinstance(f, dict)]
    told = {k: text(data.get(k, "")) for k in ("run_id", "recorded_at", "tool_version")}
    return {**told, "source_count": _number(data.get("source_count", 0)), "findings": findings, "summary": _summary(data.get("summary"))}


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block, line, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            runs = [(i, r) for i, part in enumerate(value.splitlines()) if part.strip() and (r := decode_run(part))]
            for i, r in runs:
                yield pa.RecordBatch.from_pylist([{"block": block, "line": line, "part": i, **r}], _LINE)


def load_runs(spark: SparkSession, path: str) -> DataFrame:
    """All runs of a store, run_ord from 0 in file order.

    A missing store has none; blank lines and lines that are no JSON object
    are passed over; missing fields get defaults. Lines are read by the rules
    of Python's json: the last of a repeated key counts, and NaN is a number.
    """
    if "://" not in path and not os.path.isfile(path):
        return spark.createDataFrame([], schema.RUN)
    lines = spark.read.option("lineSep", "\n").text(path)
    lines = lines.select(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"), "value")
    parsed = lines.mapInArrow(_decoded, LINE)
    # the file is read in blocks, each in order; runs are counted by block, and numbered within
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = parsed.groupBy("block").agg(F.count("*").alias("n")).select("block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    parsed = parsed.withColumn("own", F.row_number().over(Window.partitionBy("block").orderBy("line", "part")) - 1).join(blocks, "block")
    return parsed.select((F.col("before") + F.col("own")).cast("bigint").alias("run_ord"), *[n for n, _ in _RUN])


def load_store(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(runs, rows of findings) of a store: a folder of tables (sinks/run_tables.py) or a file of JSON Lines."""
    from emberlog.operators.trend import run_rows
    from emberlog.sinks.run_tables import RunTables

    if is_tables(path):
        store = RunTables(spark, path)
        return store.runs(), store.rows()
    runs = load_runs(spark, path)
    return runs, run_rows(runs)


def is_tables(path: str) -> bool:
    """Whether a store is a folder of tables: it is a folder, or its name ends with /."""
    return path.endswith("/") or os.path.isdir(path)
