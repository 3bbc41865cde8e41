"""Mixing sources to target weights by a hypergeometric splitting tree.

Documents of a source are dealt by hash into blocks of BLOCK_WORDS words at
most, on average, and at least SPREAD blocks for each shard if the source has
as many documents. A source's target is met by whole passes over its blocks
and by a part of one more pass: blocks in permuted order, the last of them in
part. These block draws are the source's exact quota. The quotas of all sources
are split recursively among the output shards: at each node of a binary tree a
multivariate hypergeometric draw decides how many of each source's draws go
left. Each shard then gets disjoint runs of every source's permuted draws,
and is shuffled by hash order. All random numbers are hashes, so reruns agree.

All of this is DataFrame functions: no Python runs on the executors.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberlog.llm.common import WORD, discard, free_name, hot_join, materialize, numbered, running_sum, table
from emberlog.llm.quality import let

WEIGHTS = (5, 2, 1)
MOST = 3  # times a document may be taken
BLOCK_WORDS, SHARDS, SPREAD, SEED = 1 << 18, 16, 32, 20240229
#: Blocks, on average, that the last pass takes in part, and documents of them that may fill the gap left in the end.
TAIL, FILLS = 16, 3
#: Sources up to which their targets are broadcast; beyond, they are joined by a shuffle.
BROADCAST_SOURCES = 10_000
#: Bits of a source's place that one row of a node deals with: 256 counts.
DIGIT = 8


def word_count(text: Column) -> Column:
    """Words of a whole text: each is turned into one character, and these are counted."""
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), WORD, "x")
    return F.char_length(F.regexp_replace(marked, "[^x]+", "")).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """sizes (skey, source, source_size, ...) with place, target, passes and rest.

    Weights go round by code point, null last. Targets stop at MOST times the
    source; in order of that bound per weight, the first source that stays
    below its bound tells the level of all that do. Sources are ordered range
    by range; only totals come to the driver.
    """
    placed = numbered(sizes, [F.col("source").isNull(), F.col("source")], {"place": F.lit(1)})
    weight = F.get(F.array(*[F.lit(w) for w in WEIGHTS]), (F.col("place") % len(WEIGHTS)).cast("int"))
    s = placed.withColumn("weight", weight).withColumn("most", MOST * F.col("source_size"))
    s = s.withColumn("ratio", F.col("most") / F.col("weight"))
    words, weights = s.agg(F.sum("source_size"), F.sum("weight")).first()
    s = numbered(s, [F.col("ratio"), F.col("place")], {"most_before": F.col("most"), "weight_before": F.col("weight")})
    level = (F.lit(words or 0) - F.col("most_before")) / (F.lit(weights or 0) - F.col("weight_before"))
    common = s.where(level <= F.col("ratio")).agg(F.min_by(level, F.struct("ratio", "place"))).first()[0]
    target = F.least(F.col("most").cast("double"), F.col("weight") * F.lit(common or 0.0))
    passes = F.when(F.col("source_size") > 0, F.floor(target / F.col("source_size"))).otherwise(0).cast("int")
    s = s.select(*sizes.columns, "place", target.alias("target"), passes.alias("passes"))
    found = materialize(s.withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size")), "targets")
    return found


def _unit(*parts: Column) -> Column:
    """A number in [0, 1) from a hash of parts."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(SEED), *parts), 11) / float(1 << 53)


def hypergeometric(total: Column, good: Column, drawn: Column, u: Column) -> Column:
    """How many of drawn are good, by inversion at u in [0, 1).

    Weights relative to the mode's are summed outwards by the ratio of
    neighbours, up to twelve standard deviations away.
    """
    total, good, drawn = (x.cast("double") for x in (total, good, drawn))

    def draw(v: Column) -> Column:
        big, k_all, n = v["total"], v["good"], v["drawn"]
        low, high = F.greatest(F.lit(0.0), n - (big - k_all)), F.least(k_all, n)
        mode = F.least(high, F.greatest(low, F.floor((n + 1) * (k_all + 1) / (big + 2)).cast("double")))
        spread = F.sqrt(n * k_all / big * (1 - k_all / big) * (big - n) / F.greatest(big - 1, F.lit(1.0)))

        def from_mode(m: Column) -> Column:
            def steps(room: Column) -> Column:
                count = F.least(room, m["reach"]).cast("int")
                return F.when(count >= 1, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))

            def up(j: Column) -> Column:
                k = m["mode"] + j - 1
                return (k_all - k) * (n - k) / ((k + 1) * (big - k_all - n + k + 1))

            def down(j: Column) -> Column:
                k = m["mode"] - j + 1
                return k * (big - k_all - n + k) / ((k_all - k + 1) * (n - k + 1))

            start = lambda at: F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"), at.alias("at"), F.lit(False).alias("found"))

            def walk(side: Column, ratio: Callable[[Column], Column], sign: int, until: Column) -> Column:
                """Sum of a side's weights, and the first value whose sum exceeds until."""

                def step(acc: Column, j: Column) -> Column:
                    return let(
                        acc["w"] * ratio(j.cast("double")),
                        lambda w: F.struct(
                            w.alias("w"),
                            (acc["sum"] + w).alias("sum"),
                            F.when(acc["found"], acc["at"]).otherwise(m["mode"] + sign * j).alias("at"),
                            (acc["found"] | (acc["sum"] + w > until)).alias("found"),
                        ),
                    )

                return F.aggregate(steps(side), start(m["mode"]), step)

            never = F.lit(float("inf"))
            sums = F.struct(
                walk(high - m["mode"], up, 1, never)["sum"].alias("up"), walk(m["mode"] - low, down, -1, never)["sum"].alias("down")
            )

            def pick(s: Column) -> Column:
                at = v["u"] * (1 + s["up"] + s["down"])
                return (
                    F.when(at < 1, m["mode"])
                    .when(at < 1 + s["up"], walk(high - m["mode"], up, 1, at - 1)["at"])
                    .otherwise(walk(m["mode"] - low, down, -1, at - 1 - s["up"])["at"])
                )

            return let(sums, pick)

        return let(F.struct(mode.alias("mode"), (F.ceil(12 * spread) + 10).alias("reach")), from_mode)

    values = F.struct(total.alias("total"), good.alias("good"), drawn.alias("drawn"), u.alias("u"))
    certain = F.when((good <= 0) | (drawn <= 0), 0.0).when(good >= total, drawn).when(drawn >= total, good)
    return F.coalesce(certain, let(values, draw)).cast("long")


def _fold(groups: DataFrame, *node: Column) -> DataFrame:
    """(shard, id, n, drawn): of each group (shard, drawn, q), the draw of every count in q (id, n), one after the other."""
    total = F.aggregate("q", F.lit(0).cast("long"), lambda a, x: a + x["n"])
    start = F.struct(total.alias("total"), F.col("drawn"), F.array().cast("array<long>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        return let(
            hypergeometric(acc["total"], x["n"], acc["drawn"], _unit(*node, F.col("shard"), x["id"])),
            lambda d: F.struct(
                (acc["total"] - x["n"]).alias("total"), (acc["drawn"] - d).alias("drawn"), F.concat(acc["out"], F.array(d)).alias("out")
            ),
        )

    drawn = F.aggregate("q", start, step, lambda a: a["out"])
    each = groups.select("shard", "q", drawn.alias("d")).select("shard", F.explode(F.arrays_zip("q", "d")).alias("z"))
    return each.select("shard", F.col("z.q.id").alias("id"), F.col("z.q.n").alias("n"), F.col("z.d").alias("drawn"))


def split_tree(quotas: DataFrame, shards: int) -> DataFrame:
    """(shard, place, n): quotas (place, n) of all sources split among shards; materialized.

    A node's draw is divided among groups of sources of alike leading digits
    of their place, each group's among narrower ones, and so on to sources: a
    row never holds more than 2 ** DIGIT counts.
    """
    if shards < 1 or shards & (shards - 1):
        raise ValueError("shards must be a power of two")
    nodes = materialize(quotas.select(F.lit(0).alias("shard"), F.col("place").cast("long").alias("place"), "n"), "tree")
    digits = max(1, -(-int(nodes.agg(F.max("place")).first()[0] or 0).bit_length() // DIGIT))
    wider = F.shiftright("id", DIGIT)
    for depth in range(shards.bit_length() - 1):
        sums = [nodes.withColumnRenamed("place", "id")]
        for _ in range(digits):
            sums.append(sums[-1].groupBy("shard", wider.alias("id")).agg(F.sum("n").alias("n")))
        drawn = sums.pop().select("shard", "id", F.ceil(F.col("n") / 2).cast("long").alias("drawn"))
        for digit in range(digits - 1, -1, -1):
            groups = sums[digit].groupBy("shard", wider.alias("group")).agg(F.sort_array(F.collect_list(F.struct("id", "n"))).alias("q"))
            groups = groups.join(drawn.select("shard", F.col("id").alias("group"), "drawn"), ["shard", "group"])
            drawn = _fold(groups, F.lit(depth), F.lit(digit))
        halves = F.array(
            F.struct((F.col("shard") * 2).alias("shard"), F.col("id").alias("place"), F.col("drawn").alias("n")),
            F.struct((F.col("shard") * 2 + 1).alias("shard"), F.col("id").alias("place"), (F.col("n") - F.col("drawn")).alias("n")),
        )
        split = materialize(drawn.select(F.explode(halves).alias("h")).select("h.*"), "tree")
        discard(nodes)
        nodes = split
    return nodes


def _keys(docs: DataFrame) -> tuple[Column, Column]:
    """A source's key, and the hash that stands for a document: of its id and text."""
    source = F.concat(F.lit("="), F.col("source").cast("string"))
    return F.coalesce(source, F.lit("")).alias("skey"), F.xxhash64(F.lit(SEED), F.col("doc_id"), F.xxhash64("text")).alias("h")


def decisions(sizes: DataFrame, shards: int = SHARDS) -> tuple[DataFrame, DataFrame]:
    """Of sizes (skey, source, h, size): the sources (skey, source_size, target, n), and the documents taken (skey, h, n, copies).

    Only these narrow rows are shuffled. copies holds (pass, shard, order_key)
    of each copy, MOST at most; n counts the rows of a source or document.
    Both are materialized.
    """
    total = sizes.count()
    by_source = sizes.groupBy("skey").agg(F.min("source").alias("source"), F.sum("size").alias("source_size"), F.count("*").alias("n"))
    plan = targets(by_source)
    few = plan.count() <= BROADCAST_SOURCES

    def of_source(rows: DataFrame, side: DataFrame, key: str) -> DataFrame:
        return rows.join(F.broadcast(side), key) if few else hot_join(rows, side, [key], total)

    units = sizes.where("size > 0").groupBy("skey", "h").agg(F.sum("size").alias("words"), F.count("*").alias("n"))
    blocks = F.least(F.col("rows"), F.greatest(F.ceil(F.col("source_size") / BLOCK_WORDS), F.lit(SPREAD * shards)))
    shape = plan.select("skey", "place", "passes", "rest", F.col("n").alias("rows"), "source_size")
    blocks = F.greatest(F.lit(1), blocks)
    tail = (TAIL * F.col("source_size") / blocks).alias("tail")
    shape = shape.select("skey", "place", "passes", "rest", F.col("rows").alias("n"), blocks.alias("blocks"), tail)
    block = F.pmod(F.xxhash64(F.lit(SEED + 1), F.col("h")), F.col("blocks")).alias("block")
    units = of_source(units.withColumnRenamed("n", "rows"), shape, "skey")
    units = materialize(units.select("skey", "h", "words", "rows", "place", "passes", "rest", "tail", block), "units")

    # blocks in permuted order, and what of them the last pass takes
    of_blocks = units.groupBy("skey", "place", "block", "passes", "rest", "tail").agg(F.sum("words").alias("words"))
    order = F.xxhash64(F.lit(SEED + 2), F.col("skey"), F.col("block"))
    of_blocks = of_blocks.withColumn("order", order).withColumn("piece", F.shiftrightunsigned("order", 54))
    of_blocks = running_sum(of_blocks, ["skey"], ["order", "block"], {"start": F.col("words")}, "piece")
    room = F.col("rest") - F.col("start")
    last = F.when(room >= F.col("words"), "whole").when(room + F.col("tail") > 0, "part").otherwise("none")
    of_blocks = materialize(of_blocks.withColumn("last", last).withColumn("room", room).drop("piece", "tail"), "blocks")

    # the draws of every source, in permuted order, are dealt to the shards by their quotas
    every = F.sequence(F.lit(0), F.when(F.col("last") != "none", F.col("passes")).otherwise(F.col("passes") - 1))
    draws = of_blocks.where("passes > 0 OR last <> 'none'").select("skey", "place", "block", F.explode(every).alias("pass"))
    order = F.xxhash64(F.lit(SEED + 3), F.col("skey"), F.col("block"), F.col("pass"))
    draws = draws.withColumn("order", order).withColumn("piece", F.shiftrightunsigned("order", 54))
    draws = running_sum(draws, ["skey"], ["order", "block", "pass"], {"rank": F.lit(1)}, "piece")
    draws = materialize(draws.select("skey", "place", "block", "pass", "rank"), "draws")
    quotas = split_tree(draws.groupBy("place").agg(F.count("*").alias("n")), shards)
    until = F.sum("n").over(Window.partitionBy("place").orderBy("shard"))
    ends = quotas.withColumn("end", until).groupBy("place").agg(F.sort_array(F.collect_list(F.struct("shard", "end"))).alias("ends"), F.sum("n").alias("n"))
    shard = F.size(F.filter("ends", lambda e: e["end"] <= F.col("rank")))
    dealt = of_source(draws, ends, "place").select("skey", "block", "pass", shard.alias("shard"))
    dealt = dealt.groupBy("skey", "block").agg(F.sort_array(F.collect_list(F.struct("pass", "shard"))).alias("draws"))  # MOST at most
    dealt = of_blocks.select("skey", "block", "last", "order", "room").join(dealt, ["skey", "block"])
    met = materialize(units.join(dealt, ["skey", "block"]), "met")
    discard(units, of_blocks, draws, quotas)

    # of the blocks taken in part, about TAIL a source, those documents that fit in order, and then those nearest to the gap
    inside = Window.partitionBy("skey")
    upto = inside.orderBy("order", "block", "h").rowsBetween(Window.unboundedPreceding, 0)
    part = met.where("last = 'part'").withColumn("room", F.max("room").over(inside))
    part = part.withColumn("in", F.sum("words").over(upto) <= F.col("room"))
    for _ in range(FILLS):
        gap = F.col("room") - F.sum(F.when(F.col("in"), F.col("words")).otherwise(0)).over(inside)
        part = part.withColumn("gap", gap).withColumn("miss", F.when(~F.col("in"), F.abs(F.col("gap") - F.col("words"))))
        nearest = F.row_number().over(inside.orderBy(F.col("miss").asc_nulls_last(), "h")) == 1
        part = part.withColumn("in", F.col("in") | F.coalesce(nearest & (F.col("miss") < F.abs("gap")), F.lit(False)))
    whole = met.where("last <> 'part'").withColumn("in", F.col("last") == "whole")
    taken = whole.unionByName(part.drop("gap", "miss"))
    key = lambda d: F.struct(d["pass"].alias("pass"), d["shard"].alias("shard"), F.xxhash64(F.lit(SEED + 4), F.col("h"), d["pass"]).alias("order_key"))
    copies = F.transform(F.filter("draws", lambda d: (d["pass"] < F.col("passes")) | F.col("in")), key)
    taken = taken.select("skey", "h", F.col("rows").alias("n"), copies.alias("copies")).where(F.size("copies") > 0)
    taken = materialize(taken, "taken")
    discard(met)
    return plan.select("skey", "source_size", "target", "n"), taken


def mix(docs: DataFrame, shards: int = SHARDS, keep: list[str] | None = None) -> DataFrame:
    """keep of docs (by default all columns) with size, source_size, target, taken and copies (pass, shard, order_key).

    A row's size is its words (null text: 0); texts without words are never
    taken. Rows equal in id and text are taken alike. taken is size times the
    number of copies, MOST at most; a source's taken words differ from its
    target by less than such a group of rows. A null source is a source. Where
    keep has a column of one of these names, it stays, and the new one has _
    before its name.

    No task gets a source: documents meet in blocks, and sums over blocks go
    by pieces. Empty table: no rows.
    """
    keep = docs.columns if keep is None else keep
    row = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.struct(F.lit(1).alias("_none"))
    keys = _keys(docs)
    sizes = docs.select(row.alias("row"), *keys, F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"))
    sizes = materialize(sizes, "sizes")
    total = sizes.count()
    plan, taken = decisions(sizes.select("skey", "source", "h", "size"), shards)
    rows = hot_join(sizes, taken, ["skey", "h"], total, "left").drop("n")
    rows = hot_join(rows, plan, ["skey"], total) if plan.count() > BROADCAST_SOURCES else rows.join(F.broadcast(plan), "skey")
    named = docs.select(*[F.col(f"`{c}`") for c in keep])
    none = F.array().cast("array<struct<pass:int,shard:int,order_key:bigint>>")
    copies = F.coalesce("copies", none)
    new = {
        "size": F.col("size"),
        "source_size": F.col("source_size"),
        "target": F.col("target"),
        "taken": (F.col("size") * F.size(copies)).cast("long"),
        "copies": copies,
    }
    return rows.select(*[F.col(f"row.`{c}`").alias(c) for c in keep], *[c.alias(free_name(named, name)) for name, c in new.items()])


def mixed_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The mix itself: a row of docs for each copy taken, dealt to shards and shuffled within them.

    All columns come out as they went in, whatever their names. Texts meet
    their decisions once, and move once more to their shards. A shard's order
    is cut into 2**16 pieces that go to tasks of their own, so no task holds a
    shard. The rows of a task are in the order of their shards.
    """
    keys = _keys(docs)
    sizes = docs.select(*keys, F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"))
    sizes = materialize(sizes, "sizes")
    total = sizes.count()
    _, taken = decisions(sizes, shards)
    discard(sizes)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *keys)
    copies = hot_join(packed, taken, ["skey", "h"], total).select("row", F.explode("copies").alias("copy"))
    shard, key = F.col("copy.shard"), F.col("copy.order_key")
    dealt = copies.repartition(shard, F.shiftrightunsigned(key, 48)).sortWithinPartitions(shard, key)
    return dealt.select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: what the mix takes of every document, and the shard of each copy."""
    mixed = mix(table(spark, sf_dir, "documents"), keep=["doc_id"])
    shards = F.transform("copies", lambda c: c["shard"]).alias("shards")
    return mixed.select("doc_id", "size", "source_size", "target", "taken", shards)
