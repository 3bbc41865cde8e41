"""Failure reports as a frame of builds.

Files are read by the data source of sources/datasource.py, each decoded in a
task, so no report passes the driver; stores that it cannot open are listed and
read by Spark. Builds are known and ordered by build_key: the place of their
source among the sources, then their path, part by part.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberlog import schema
from emberlog.sources.datasource import FORMAT, known_store, register
from emberlog.sources.decoding import DECODED_FIELDS, DECODED_TYPE, decode

STDIN = "-"
DECODED = f"struct<{DECODED_FIELDS.replace(' string', ':string').replace('failures ', 'failures:')}>"


def decoded(content: Column) -> Column:
    """decode() of each value, batch by batch."""

    @F.arrow_udf(DECODED)
    def run(contents: pa.Array) -> pa.Array:
        return pa.array([decode(c.as_py()) for c in contents], pa.struct(DECODED_TYPE))

    return run(content)


def read_reports(spark: SparkSession, paths: list[str], **options: str) -> DataFrame:
    """The rows of the data source for paths; filters on source_path reach it where the session pushes them down."""
    register(spark)
    pushed = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format(FORMAT).options(paths=json.dumps(paths), pushdown=pushed, **options).load()


def _key(source: Column, path: Column) -> Column:
    """Order of builds: paths are compared part by part, so / comes before any other character."""
    return F.concat(source, F.translate(path, "/", "\x01"))


def _with_hits(rows: DataFrame) -> DataFrame:
    """Decoded rows as builds: a problem becomes a finding."""
    problem = F.struct(
        F.lit("unknown").alias("category"),
        F.lit("error").alias("severity"),
        F.col("problem").alias("title"),
        F.array("problem").alias("evidence"),
        F.lit(1.0).alias("confidence"),
    )
    hits = F.when(F.col("problem").isNotNull(), F.array(problem)).otherwise(F.array().cast("array<struct<category:string,severity:string,title:string,evidence:array<string>,confidence:double>>"))
    return rows.select("build_key", "source_path", *schema.BUILD_FIELDS, "failures", hits.alias("ingest_findings"), "local_conf", "auto_conf", "raw")


def _as_builds(found: DataFrame) -> DataFrame:
    """found (build_key, source_path, content, or decoded as d) as builds."""
    d = found if "d" in found.columns else found.select("build_key", "source_path", decoded(F.col("content")).alias("d"))
    return _with_hits(d.select("build_key", "source_path", "d.*"))


def from_texts(spark: SparkSession, rows: Iterable[tuple[str, str | bytes]]) -> DataFrame:
    """Builds of a few (source_path, content) rows."""
    listed = [(f"{i:09d}|", p, c.encode() if isinstance(c, str) else c) for i, (p, c) in enumerate(rows)]
    return _as_builds(spark.createDataFrame(listed, "build_key string, source_path string, content binary"))


def load_report(spark: SparkSession, path: str) -> DataFrame:
    """The build of one local file, whatever it is named: one row, with a finding if it cannot be read or is no report.

    Executors open it: on a cluster it must lie where all of them see it.
    """
    return _with_hits(read_reports(spark, [path], named="true"))


def load_reports(spark: SparkSession, sources: Iterable[str]) -> DataFrame:
    """Builds of all sources: files, globs (** allowed), folders, URIs, or - for one report on stdin.

    A path reached twice counts once, for its first source. In a folder, what
    is no report is passed over; a file that is named makes a build with a
    finding that tells what is wrong. A path or glob without a match yields
    nothing; without any match the frame is empty. Hidden files count. A local
    file that was listed but is not there for an executor is an error.
    """
    places = list(enumerate(map(str, sources)))
    local = [(k, s) for k, s in places if s != STDIN and known_store(s)]
    stored = [(k, s) for k, s in places if s != STDIN and not known_store(s)]
    frames = []
    if local:
        # sources keep their place among all: those that are read elsewhere are empty here
        names = ["" if (k, s) not in local else s for k, s in places]
        frames.append(_with_hits(read_reports(spark, names)))
    texts = [(f"{k:09d}|", STDIN, sys.stdin.read().encode()) for k, s in places if s == STDIN]
    if texts:
        frames.append(_as_builds(spark.createDataFrame(texts, "source string, source_path string, content binary").withColumn("build_key", _key(F.col("source"), F.col("source_path")))))
    if stored:
        frames.append(_from_store(spark, stored))
    if not frames:
        return from_texts(spark, [])
    found = frames[0]
    for df in frames[1:]:
        found = found.unionByName(df)
    return found


def _from_store(spark: SparkSession, sources: list[tuple[int, str]]) -> DataFrame:
    """Builds of (place, URI) that Spark's own reader lists: folders end with /."""
    found = None
    for k, source in sources:
        folder = source.endswith("/")
        reader = spark.read.format("binaryFile")
        reader = reader.option("recursiveFileLookup", "true") if folder else reader
        df = reader.load(source).select(F.lit(f"{k:09d}|").alias("source"), "path", "content", F.lit(folder).alias("folder"))
        found = df if found is None else found.unionByName(df)
    if len(sources) > 1:  # the narrow paths are compared, not the contents
        once = Window.partitionBy("path").orderBy("source")
        keep = found.select("path", "source").withColumn("r", F.row_number().over(once)).where("r = 1")
        found = found.join(keep.select("path", "source"), ["path", "source"], "left_semi")
    d = found.select(_key(F.col("source"), F.col("path")).alias("build_key"), F.col("path").alias("source_path"), "folder", decoded(F.col("content")).alias("d"))
    return _as_builds(d.where(~F.col("folder") | F.col("d.problem").isNull()))
