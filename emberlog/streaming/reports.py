"""Reports that arrive in a folder, analysed batch by batch (an extension)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from emberlog.operators.engine import GROUP_STATE, findings_of, group_state, groups_of, merged_groups
from emberlog.sources.reports import _as_builds

FILES = "path string, modificationTime timestamp, length bigint, content binary"
PATHS = "path string"


def _before(spark: SparkSession, folder: str, number: int, schema: str) -> DataFrame:
    """What the batches before one have written to folder, with their numbers as batch; nothing if there are none."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], f"{schema}, batch bigint")
    return spark.read.schema(f"{schema}, batch bigint").parquet(folder).where(F.col("batch") < number)


def watch(spark: SparkSession, folder: str, out: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Append the findings of new report files in folder to the table at out, and keep the groups of all findings.

    A build's findings depend on its own file only, so every batch is
    complete. A path counts once: a file that is written again is passed over.
    Each batch merges its groups into the state of the batch before, a row for
    each signature and recipe, and writes that under its number; a batch that
    is repeated after a failure overwrites what it wrote. The checkpoint holds
    which files were read, their paths and the states. See groups_so_far.
    """
    files = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").load(folder)

    def write(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        paths = batch.select("path").distinct().join(_before(session, f"{checkpoint}/paths", number, PATHS), "path", "left_anti")
        paths.write.mode("overwrite").parquet(f"{checkpoint}/paths/batch={number}")
        # the narrow paths are compared, not the contents
        new = batch.join(session.read.schema(PATHS).parquet(f"{checkpoint}/paths/batch={number}"), "path", "left_semi")
        builds = _as_builds(new.select(F.col("path").alias("build_key"), F.col("path").alias("source_path"), "content"))
        findings_of(builds).write.mode("overwrite").parquet(f"{out}/batch={number}")
        own = group_state(session.read.parquet(f"{out}/batch={number}"))
        states = _before(session, f"{checkpoint}/groups", number, GROUP_STATE)
        last = states.agg(F.max("batch")).first()[0]
        if last is not None:
            own = merged_groups(own, states.where(F.col("batch") == last).drop("batch"))
        own.write.mode("overwrite").parquet(f"{checkpoint}/groups/batch={number}")

    writer = files.writeStream.foreachBatch(write).option("checkpointLocation", f"{checkpoint}/stream")
    return (writer.trigger(availableNow=True) if once else writer).start()


def groups_so_far(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The groups of all findings of the batches that are whole, as engine.group_findings has them of all at once."""
    states = _before(spark, f"{checkpoint}/groups", (1 << 63) - 1, GROUP_STATE)
    last = states.agg(F.max("batch")).first()[0]
    return groups_of(states.where(F.col("batch") == F.lit(last)).drop("batch"))
