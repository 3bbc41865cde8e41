"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words of every contract: runs without space, tab, newline, VT, FF or CR.
WORD = r"[^\x20\x09-\x0D]+"
#: A value is hot if it has over a HOTth of all rows; no more than HOT values can be.
HOT = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where the session names none a temporary one is made, on a local master
    only: executors on other machines could not read it.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="emberlog-shared-")
        sc.setCheckpointDir(named)
    return named


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write df to the shared folder (options: of the Parquet writer) and read it back.

    Cuts the lineage with files that outlive any executor. Unlike
    checkpoint(), the plan runs once, and later reads prune columns.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written._written_to = path
    return written


def discard(*frames: DataFrame) -> None:
    """Delete the files of materialized frames that no later job reads."""
    for df in frames:
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(df._written_to)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def free_name(df: DataFrame, base: str) -> str:
    """A column name that df does not have yet (compared without case)."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name = f"_{name}"
    return name


def running_sum(df: DataFrame, keys: list[str], order: list[str | Column], sums: dict[str, Column], group: str) -> DataFrame:
    """Exclusive running sums (by their names) within keys, without one task for a key.

    group names a column that cuts each key into ordered, bounded pieces:
    order must sort by group first. Sums of pieces are added up in one small
    window per key, rows in one window per piece.
    """
    pieces = [f"_piece{i}" for i in range(len(sums))]
    offsets = df.groupBy(*keys, group).agg(*[F.sum(v).alias(p) for p, v in zip(pieces, sums.values(), strict=True)])
    before = Window.partitionBy(*keys).orderBy(group).rowsBetween(Window.unboundedPreceding, -1)
    offsets = offsets.withColumns({f"_before{p}": F.coalesce(F.sum(p).over(before), F.lit(0)) for p in pieces})
    offsets = offsets.drop(*pieces).withColumnsRenamed({k: f"_k{i}" for i, k in enumerate([*keys, group])})
    inside = Window.partitionBy(*keys, group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumns({f"_inside{p}": F.coalesce(F.sum(v).over(inside), F.lit(0)) for p, v in zip(pieces, sums.values(), strict=True)})
    on = F.lit(True)
    for i, k in enumerate([*keys, group]):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    df = df.join(offsets, on).withColumns({out: F.col(f"_before{p}") + F.col(f"_inside{p}") for p, out in zip(pieces, sums, strict=True)})
    return df.drop(*[f"_before{p}" for p in pieces], *[f"_inside{p}" for p in pieces], *[f"_k{i}" for i in range(len(keys) + 1)])


def numbered(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Exclusive running sums (by their names) over all rows in the given order, range by range; materialized.

    The ranges are written first, so that a repeated task finds them as they were.
    """
    ranges = materialize(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    found = materialize(running_sum(ranges, [], ["_range", *order], sums, "_range").drop("_range"), "numbers")
    discard(ranges)
    return found


def hot_join(rows: DataFrame, names: DataFrame, by: list[str], total: int, how: str = "inner", size: str = "n") -> DataFrame:
    """rows joined (inner or left) with names: a row for each value of by, with the number of its rows as size.

    Values with over total / HOT rows are broadcast, so that none of them goes
    to one task; the others are shuffled. There are HOT hot ones at most, if
    total is the number of rows.
    """
    hot, cold = names.where(F.col(size) > total / HOT), names.where(F.col(size) <= total / HOT)
    others = rows.join(F.broadcast(hot.select(*by)), by, "left_anti")
    return rows.join(F.broadcast(hot), by).unionByName(others.join(cold, by, how))
