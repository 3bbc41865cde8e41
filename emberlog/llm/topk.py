"""Exact top-k by inner product: dual-tree search over cover trees.

Vectors are ordered by their nearest pivots, and runs of alike ones become
blocks. Each block, of data or of queries, becomes a cover tree in a task of its
own. A query block first meets the nearest data blocks of its own cell (nearest
pivot), which gives the worst kth score of its queries; then cells of data, and
blocks of the cells that are left, are pruned by the bounds of their balls. In a
task, two trees are descended together: a pair of nodes with centres p and q
and covering radii r and s holds no score above p.q + r|q| + s|p| + rs, and is
pruned where that is less than the worst kth score of the query node.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberlog.llm.common import discard, hot_join, materialize, numbered, running_sum, table

#: Rows of a data block, its blocks that a pivot stands for, pivots at least and at most (taken from a sample of
#: SAMPLED rows each, those of least hash; all vectors are indexed), nearest pivots that order a vector, and data
#: blocks of a query block's first round.
BLOCK, BLOCKS_OF_PIVOT, PIVOTS, SAMPLED, NEAREST, FIRST_BLOCKS = 4096, 16, (4, 4096), 8, 4, 2
#: Rows of a leaf at most; children of fewer rows than FEW share leaves of PACK rows; depth of a tree at most.
LEAF, FEW, PACK, DEEPEST = 32, 8, 128, 200
#: Scores are kept within these.
LEAST, MOST = -(2.0**63), 2.0**63 - 1024
#: What rounding may take from a bound: of its size, and beside it.
ROUNDING, SLACK = 1e-9, 1e-6
#: Query blocks that a data block meets in one task (aimed at), and tasks of a search at most.
SIDE, TASKS = 16, 4096


class Tree:
    """Cover tree over rows, as arrays; each node is a run of the reordered rows.

    A node of level l is centred at one of its rows and covers them all within
    2**l. Its children are of level l - 1 at most (covering), their centres
    are more than 2**(l - 1) apart (separation), and the first has the centre of
    its parent (nesting). Radii are measured, so they always cover. A node of
    LEAF rows at most is a leaf. Children of fewer than FEW rows are gathered,
    nearest ones first, into leaves of PACK rows and level -1, each centred at a row of its own.
    no tells rows apart and orders ties; ids (with missing ones) are only told.
    """

    def __init__(self, no: np.ndarray, x: np.ndarray, ids: np.ndarray | None = None, missing: np.ndarray | None = None):
        order: list[int] = []
        self.point: list[int] = []
        #: -1: a leaf of packed rows
        self.level: list[int] = []
        self.first: list[int] = []
        self.last: list[int] = []
        self.children: list[list[int]] = []
        radius: list[float] = []

        square = (x**2).sum(axis=1)

        def node(rows: np.ndarray, point: int, packed: bool) -> tuple[int, np.ndarray]:
            far = np.sqrt(((x[rows] - x[point]) ** 2).sum(axis=1))
            widest = float(far.max())
            self.point.append(point)
            self.level.append(-1 if packed else max(0, math.ceil(math.log2(max(widest, 1.0)))))
            self.first.append(len(order))
            self.last.append(len(order) + len(rows))
            self.children.append([])
            radius.append(widest * (1 + ROUNDING))
            return len(radius) - 1, far

        def away(rows: np.ndarray, point: int) -> np.ndarray:
            """Distances, in one product; the measured ones of node() are what bounds rest on."""
            return np.sqrt(np.maximum(square[rows] - 2 * (x[rows] @ x[point]) + square[point], 0))

        def gathered(few: list[tuple[int, np.ndarray]]) -> list[np.ndarray]:
            """Small children (centre, rows) in leaves: the first that is left, and those nearest to it."""
            out, left = [], list(range(len(few)))
            centres = np.array([c for c, _ in few], np.int64)
            while left:
                near = np.argsort(away(centres[left], few[left[0]][0]), kind="stable").tolist()
                taken, size = [], 0
                for i in near:
                    if size + len(few[left[i]][1]) > PACK:
                        break
                    taken.append(left[i])
                    size += len(few[left[i]][1])
                out.append(np.concatenate([few[i][1] for i in taken]))
                gone = set(taken)
                left = [i for i in left if i not in gone]
            return out

        def grow(rows: np.ndarray, point: int, depth: int) -> int:
            own, far = node(rows, point, False)
            if len(rows) <= LEAF or radius[own] == 0 or depth == DEEPEST:
                order.extend(rows.tolist())
                return own
            cover = 2.0 ** (self.level[own] - 1)
            centres, part, near = [point], np.zeros(len(rows), np.int64), far
            while near.max() > cover:
                centres.append(int(rows[near.argmax()]))
                d = away(rows, centres[-1])
                part[d < near] = len(centres) - 1
                near = np.minimum(near, d)
            by_part = np.argsort(part, kind="stable")
            groups = np.split(rows[by_part], np.searchsorted(part[by_part], np.arange(1, len(centres))))
            few = [(c, g) for c, g in zip(centres, groups, strict=True) if len(g) < FEW]
            for c, g in zip(centres, groups, strict=True):
                if len(g) >= FEW:
                    self.children[own].append(grow(g, c, depth + 1))
            for g in gathered(few):
                middle = int(g[np.argmin(((x[g] - x[g].mean(axis=0)) ** 2).sum(axis=1))])
                self.children[own].append(node(g, middle, True)[0])
                order.extend(g.tolist())
            return own

        grow(np.arange(len(x)), 0, 0)
        at = np.array(order)
        self.no, self.x = no[at], np.ascontiguousarray(x[at])
        self.ids = self.no if ids is None else ids[at]
        self.missing = np.zeros(len(x), bool) if missing is None else missing[at]
        self.centre = x[self.point]
        self.radius = np.array(radius)
        self.norm = np.sqrt((self.centre**2).sum(axis=1))
        self.row_norm = np.sqrt((self.x**2).sum(axis=1))

    def __getstate__(self) -> dict:
        small = self.x.astype(np.float32)
        return self.__dict__ | ({"x": small, "centre": self.centre.astype(np.float32)} if (small == self.x).all() else {})

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state | {k: state[k].astype(np.float64) for k in ("x", "centre")}


class Best:
    """The k best (score, least no) of every query row of a tree."""

    def __init__(self, n: int, k: int, floor: np.ndarray):
        self.score = np.full((n, k), -np.inf)
        self.no = np.full((n, k), np.iinfo(np.int64).max)
        self.floor = floor  # scores known to be among each query's k best elsewhere

    def worst(self, a: int, b: int) -> np.ndarray:
        """The worst kth score known of each of the rows a to b."""
        return np.maximum(self.score[a:b, -1], self.floor[a:b])

    def offer(self, rows: np.ndarray, score: np.ndarray, no: np.ndarray) -> None:
        k = self.score.shape[1]
        s = np.concatenate([self.score[rows], score], axis=1)
        i = np.concatenate([self.no[rows], np.broadcast_to(no, score.shape)], axis=1)
        top = np.lexsort((i, -s), axis=1)[:, :k]
        self.score[rows] = np.take_along_axis(s, top, axis=1)
        self.no[rows] = np.take_along_axis(i, top, axis=1)


def bounds(q: Tree, i: np.ndarray, d: Tree, j: np.ndarray) -> np.ndarray:
    """The largest scores that the nodes i of q and j of d, pair by pair, can hold."""
    across = q.radius[i] * d.norm[j] + d.radius[j] * q.norm[i] + q.radius[i] * d.radius[j]
    return np.maximum((q.centre[i] * d.centre[j]).sum(axis=1) + across + ROUNDING * (q.norm[i] * d.norm[j] + across) + SLACK, LEAST)


def row_bounds(q: Tree, a: int, b: int, d: Tree, nodes: np.ndarray) -> np.ndarray:
    """The largest scores of each of the rows a to b of q with each of some nodes of d."""
    norm = q.row_norm[a:b, None]
    across = norm * d.radius[nodes]
    return np.maximum(q.x[a:b] @ d.centre[nodes].T + across + ROUNDING * (norm * d.norm[nodes] + across) + SLACK, LEAST)


def search(q: Tree, d: Tree, best: Best) -> None:
    """Descend both trees together, the highest bound first; of two nodes the wider one is opened.

    Below a leaf of queries, each of its rows is a ball without a radius, with a bound of its own.
    """
    root = np.zeros(1, np.int64)
    stack = [(float(bounds(q, root, d, root)[0]), 0, 0)]
    while stack:
        bound, i, j = stack.pop()
        a, b = q.first[i], q.last[i]
        worst = best.worst(a, b)
        if bound < worst.min():
            continue
        if q.children[i] and (not d.children[j] or q.radius[i] >= d.radius[j]):
            left = np.array(q.children[i])
            right = np.full(len(left), j)
        elif q.children[i]:
            right = np.array(d.children[j])
            left = np.full(len(right), i)
        else:
            right = np.array(d.children[j] or [j])
            each = row_bounds(q, a, b, d, right)
            each[each < worst[:, None]] = -np.inf
            if d.children[j]:
                most = each.max(axis=0)
                stack += sorted((m, i, c) for m, c in zip(most.tolist(), right.tolist(), strict=True) if m > -np.inf)
            elif len(rows := a + np.flatnonzero(each[:, 0] > -np.inf)):
                _compare(q, rows, d, d.first[j], d.last[j], best)
            continue
        stack += sorted(zip(bounds(q, left, d, right).tolist(), left.tolist(), right.tolist(), strict=True))


def _compare(q: Tree, rows: np.ndarray, d: Tree, s: int, e: int, best: Best) -> None:
    """All scores of some rows of q with the rows s to e of d; a row does not meet itself."""
    score = np.clip(q.x[rows] @ d.x[s:e].T, LEAST, MOST)
    score[q.no[rows, None] == d.no[None, s:e]] = -np.inf
    hit = (score >= np.maximum(best.score[rows, -1], best.floor[rows])[:, None]).any(axis=0)
    if hit.any():
        best.offer(rows, score[:, hit], d.no[s:e][hit])


def integer_vectors(df: DataFrame, id_col: str, vector_col: str, scale: int = 64) -> DataFrame:
    """(id, v): floor(scale * x) of each component; vectors null or with a null or non-finite component go."""
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.where(v.isNotNull() & finite).select(
        F.col(id_col).alias("id"), F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("double")).alias("v")
    )


def _padded(rows: list[np.ndarray], dim: int) -> np.ndarray:
    out = np.zeros((len(rows), dim))
    for r, v in enumerate(rows):
        out[r, : min(dim, len(v))] = v[:dim]
    return out


def _near(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """vectors with near, the NEAREST pivots in order of their distance, and cell, the first of them."""
    most = min(NEAREST, len(pivots))

    @F.arrow_udf("array<int>")
    def nearest(vs: pa.Array) -> pa.Array:
        x = _padded([r.values.to_numpy() for r in vs], pivots.shape[1])
        far = (pivots**2).sum(axis=1)[None, :] - 2 * x @ pivots.T
        first = np.argsort(far, axis=1, kind="stable")[:, :most].astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * most), pa.array(first.ravel()))

    return vectors.withColumn("near", nearest("v")).withColumn("cell", F.get("near", F.lit(0)))


def _trees(vectors: DataFrame, dim: int, rows: int, total: int) -> DataFrame:
    """(block, cell, tree, centre, radius): a row for each block, of 2 * rows vectors at most, or so.

    Blocks are cut from a cell's vectors in the order of their nearest pivots.
    Only those that agree in all of these, and are more than rows, are dealt
    by hash.
    """
    alike = vectors.groupBy("cell", "near").agg(F.count("*").alias("n")).withColumn("second", F.get("near", F.lit(1)))
    alike = running_sum(alike, ["cell"], ["second", "near"], {"start": F.col("n")}, "second")
    alike = materialize(alike.select("near", "n", F.floor(F.col("start") / rows).alias("cut"), F.ceil(F.col("n") / rows).alias("parts")), "alike")
    dealt = hot_join(vectors, alike, ["near"], total)
    dealt = dealt.withColumn("part", F.when(F.col("parts") > 1, F.pmod(F.xxhash64("no"), "parts")).otherwise(-1))
    # the cut of a dealt group is its own
    dealt = dealt.withColumn("block", F.concat_ws("-", "cell", "cut", F.when(F.col("parts") > 1, F.concat_ws("-", "part", F.concat_ws(".", F.col("near").cast("array<string>"))))))

    def build(t: pa.Table) -> pa.Table:
        order = np.argsort(t.column("no").to_numpy())
        x = _padded([r.values.to_numpy() for r in t.column("v").combine_chunks()], dim)[order]
        ids = t.column("id").combine_chunks()
        missing = ids.is_null().to_numpy(zero_copy_only=False)[order]
        tree = Tree(t.column("no").to_numpy()[order], x, ids.fill_null(0).to_numpy(zero_copy_only=False)[order], missing)
        return pa.table(
            {
                "block": pa.array([t.column("block")[0].as_py()]),
                "cell": pa.array([t.column("cell")[0].as_py()], pa.int32()),
                "tree": pa.array([pickle.dumps(tree)], pa.binary()),
                "centre": pa.array([tree.centre[0].tolist()], pa.list_(pa.float64())),
                "radius": pa.array([float(tree.radius[0])]),
            }
        )

    schema = "block string, cell int, tree binary, centre array<double>, radius double"
    trees = materialize(dealt.select("block", "cell", "no", "id", "v").groupBy("block").applyInArrow(build, schema), "trees")
    discard(alike)
    return trees


FOUND = "qblock string, query_no bigint, query_id bigint, vec_no bigint, vec_id bigint, score bigint"


def _searched(pairs: DataFrame, asked: DataFrame, data: DataFrame, k: int, floors: DataFrame | None) -> DataFrame:
    """What the block pairs (qblock, block) hold, k rows per query and pair at most.

    A data block travels to each of its sides, groups of about SIDE query
    blocks; a query block travels to each pair.
    """
    sides = pairs.groupBy("block").agg(F.ceil(F.count("*") / SIDE).alias("sides"))
    sides = materialize(sides, "sides")
    left = pairs.join(sides, "block").withColumn("side", F.pmod(F.xxhash64("qblock"), "sides")).drop("sides")
    left = left.join(asked.select(F.col("block").alias("qblock"), F.col("tree").alias("qtree")), "qblock")
    none = F.lit(None).cast("map<bigint,double>").alias("floors")
    left = left.select("*", none) if floors is None else left.join(floors, "qblock", "left")
    right = data.select("block", "tree").join(sides, "block").withColumn("side", F.explode(F.expr("sequence(0L, sides - 1)"))).drop("sides")

    def run(queries: pa.Table, trees: pa.Table) -> pa.Table:
        out = {f.split()[0]: [] for f in FOUND.split(", ")}
        if trees.num_rows and queries.num_rows:
            d = pickle.loads(trees.column("tree")[0].as_py())
            by_no = np.argsort(d.no)
            for block, tree, known in zip(*(queries.column(c) for c in ("qblock", "qtree", "floors")), strict=True):
                q, known = pickle.loads(tree.as_py()), dict(known.as_py() or ())
                best = Best(len(q.no), k, np.array([known.get(n, -np.inf) for n in q.no.tolist()]))
                search(q, d, best)
                row, col = np.nonzero(np.isfinite(best.score))
                no = best.no[row, col]
                at = by_no[np.searchsorted(d.no, no, sorter=by_no)]
                score = best.score[row, col].astype(np.int64)
                of = (pa.array([block.as_py()] * len(row), pa.string()), pa.array(q.no[row]), pa.array(q.ids[row], mask=q.missing[row]))
                for name, values in zip(out, (*of, pa.array(no), pa.array(d.ids[at], mask=d.missing[at]), pa.array(score)), strict=True):
                    out[name].append(values)
        types = [pa.string(), *[pa.int64()] * 5]
        return pa.table({n: pa.chunked_array(v, t) for (n, v), t in zip(out.items(), types, strict=True)})

    # few bytes but much work: as many tasks as groups, so that small shuffles are not merged into few
    tasks = max(1, min(TASKS, sides.agg(F.sum("sides")).first()[0] or 0))
    keys = ["block", "side"]
    left, right = left.repartition(tasks, *keys), right.repartition(tasks, *keys)
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, FOUND)


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_no").orderBy(F.col("score").desc(), "vec_no")
    return found.withColumn("rank", F.row_number().over(order)).where(f"rank <= {int(k)}")


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _bound() -> Column:
    """The largest score of the balls qc, qr and dc, dr."""
    q, d = F.sqrt(_dot(F.col("qc"), F.col("qc"))), F.sqrt(_dot(F.col("dc"), F.col("dc")))
    across = F.col("qr") * d + F.col("dr") * q + F.col("qr") * F.col("dr")
    return _dot(F.col("qc"), F.col("dc")) + across + ROUNDING * (q * d + across) + SLACK


def top_k(vectors: DataFrame, asked: Column, k: int, pivots: int | None = None, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of vectors (id, v) with the best scores for each row that asked is true of, exactly.

    Scores are inner products of whole numbers, exact below 2**53, and kept
    within a long. Ties go to the smaller id, null last. Every row is a
    candidate, repeated ids and null ids too, but a row for itself; repeated
    rows that are asked for give an answer each. Vectors of unlike length meet
    as if the shorter ended in zeros. A query has fewer than k rows only if
    there are fewer vectors. No vectors or no queries: no rows. Pivots grow
    with the rows: one for BLOCKS_OF_PIVOT data blocks, up to PIVOTS[1].
    """
    vectors = numbered(vectors.select("id", "v"), [F.col("id").isNull(), F.col("id")], {"no": F.lit(1)})
    total, dim = vectors.agg(F.count("*"), F.max(F.size("v"))).first()
    pivots = pivots or min(PIVOTS[1], max(PIVOTS[0], total // (BLOCKS_OF_PIVOT * block)))
    sample = [r.v for r in vectors.orderBy(F.xxhash64("no")).limit(SAMPLED * pivots).select("v").collect()]  # a bounded sample
    centres = _padded([np.array(v) for v in list(dict.fromkeys(map(tuple, sample)))[:pivots]], dim or 0) if sample else np.zeros((1, 0))
    placed = materialize(_near(vectors, centres), "placed")
    data = _trees(placed, dim or 0, block, total)
    queries = _trees(placed.where(asked), dim or 0, max(1, block // 8), total)
    discard(vectors, placed)

    q = queries.select(F.col("block").alias("qblock"), F.col("cell").alias("qcell"), F.col("centre").alias("qc"), F.col("radius").alias("qr"))
    d = data.select("block", "cell", F.col("centre").alias("dc"), F.col("radius").alias("dr"))
    nearest = Window.partitionBy("qblock").orderBy(_dot(F.col("qc"), F.col("dc")).desc(), "block")
    turn = q.join(d, F.col("qcell") == F.col("cell")).withColumn("turn", F.row_number().over(nearest))
    turn = materialize(turn.where(F.col("turn") <= FIRST_BLOCKS).select("qblock", "block"), "turns")
    first = materialize(_searched(turn, queries, data, k, None), "first")

    kth = _top(first, k).groupBy("qblock", "query_no").agg(F.min("score").cast("double").alias("s"), F.count("*").alias("n"))
    kth = kth.withColumn("s", F.when(F.col("n") >= k, F.col("s")).otherwise(F.lit(float("-inf"))))
    floors = kth.groupBy("qblock").agg(
        F.map_from_entries(F.collect_list(F.struct("query_no", "s"))).alias("floors"), F.min("s").alias("worst"), F.count("*").alias("known")
    )  # a query block each
    floors = materialize(floors, "floors")

    # a query block meets the balls of the cells, one for each pivot at most, and then the blocks of those that are left
    least = F.coalesce("worst", F.lit(float("-inf")))
    q = q.join(floors.select("qblock", "worst"), "qblock", "left")
    cells = data.groupBy("cell").agg(F.min_by("centre", "block").alias("dc"))
    apart = F.sqrt(F.aggregate(F.zip_with("centre", "dc", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    balls = data.join(F.broadcast(cells), "cell").groupBy("cell").agg(F.first("dc").alias("dc"), F.max((apart + F.col("radius")) * (1 + ROUNDING)).alias("dr"))
    balls = materialize(balls, "balls")
    met = q.join(F.broadcast(balls), _bound() >= least).select("qblock", "qc", "qr", "worst", "cell")
    rest = met.join(d, "cell").where(_bound() >= least).select("qblock", "block")
    rest = materialize(rest.join(turn, ["qblock", "block"], "left_anti"), "pairs")
    second = _searched(rest, queries, data, k, floors.select("qblock", "floors"))
    return _top(first.unionByName(second), k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: the 20 best of every vector whose id is divisible by 20."""
    vectors = integer_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return top_k(vectors, F.col("id") % 20 == 0, 20)


SQL = """
WITH v AS (
  SELECT row_number() OVER () AS no, vec_id, list_transform(embedding, lambda x: floor(64.0 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.no, q.vec_id AS query_id, d.no AS other, d.vec_id, list_inner_product(q.e, d.e)::BIGINT AS score
  FROM v q JOIN v d ON q.no <> d.no WHERE q.vec_id % 20 = 0
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY no ORDER BY score DESC, vec_id NULLS LAST, other)::INTEGER AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
