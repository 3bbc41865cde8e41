"""Connected components of an edge table by alternating large and small stars.

Kiveris et al., "Connected Components in MapReduce and Beyond" (2014). Only
edge rows move; no node's neighbours are gathered in one task: minima are
combined before the shuffle and joined back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import discard, materialize


def _star(edges: DataFrame, large: bool, written: list[DataFrame]) -> DataFrame:
    """Large: link larger neighbours of a node to its least; small: the other ones. Its own tables go to written."""
    if large:
        both = edges.select(F.col("a").alias("n"), F.col("b").alias("m")).union(
            edges.select(F.col("b").alias("n"), F.col("a").alias("m"))
        )
    else:
        both = edges.select(F.greatest("a", "b").alias("n"), F.least("a", "b").alias("m"))
    least = both.groupBy("n").agg(F.min("m").alias("least")).withColumn("least", F.least("n", "least"))
    # written, so that the join below deals its sides anew and Spark can split the partition of a node with many links
    least = materialize(least, "least")
    written.append(least)
    linked = both.join(least, "n")
    if large:
        out = linked.where("m > n").select(F.col("m").alias("a"), F.col("least").alias("b"))
    else:
        out = linked.select(F.col("m").alias("a"), F.col("least").alias("b")).union(
            least.select(F.col("n").alias("a"), F.col("least").alias("b"))
        )
    return out.where("a <> b").distinct()


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, root) of every node in edges (a, b), root the least node reachable.

    Ends when a round leaves the edges as they were; every node then hangs on
    its root. Each round is written to the shared folder. No edges: no rows.
    """
    edges = materialize(edges.where("a <> b").select("a", "b").distinct(), "edges")
    state = None
    for _ in range(rounds):
        written = [edges]
        edges = materialize(_star(_star(edges, True, written), False, written), "edges")
        for done in written:
            discard(done)
        # decimals, so that sums of hashes cannot overflow
        seen = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(seen) == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = tuple(seen)
    raise RuntimeError(f"no end after {rounds} rounds")
