"""Exact search against all inner products."""

import math

import numpy as np
from pyspark.sql import functions as F

from emberlog.llm import topk


def brute(rows, asked, k):
    """rows (id, vector), in any number; those at the places asked are the queries."""
    out = []
    for n in asked:
        q, x = rows[n]
        dots = sorted(((-int(np.dot(x, y)), i is None, i or 0, m, i) for m, (i, y) in enumerate(rows) if m != n))[:k]
        out += [(q, r + 1, d[4], -d[0]) for r, d in enumerate(dots)]
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [float(x) if x is not None else None for x in v]) for i, v in rows], "vec_id bigint, embedding array<double>")


def test_trees_find_the_same_as_all_products(spark):
    rnd = np.random.default_rng(4)
    x = np.floor(rnd.normal(size=(1500, 6)) * 4)
    x[100:460] = x[0]  # ties, more than a block
    rows = list(enumerate(x))
    df = frame(spark, rows).selectExpr("vec_id AS id", "embedding AS v")
    got = topk.top_k(df, F.col("id") % 7 == 0, 9, pivots=6, block=128)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, range(0, 1500, 7), 9)


def test_covering_separation_and_nesting_hold():
    rnd = np.random.default_rng(1)
    for x in (np.floor(rnd.normal(size=(900, 2)) * 64), np.floor(rnd.normal(size=(5, 4))[rnd.integers(0, 5, 2500)] * 900 + rnd.normal(size=(2500, 4)) * 20), np.floor(rnd.normal(size=(700, 40)) * 64), np.zeros((600, 3))):
        tree = topk.Tree(np.arange(len(x)), x)
        assert sorted(tree.no.tolist()) == list(range(len(x)))
        dist = lambda a, b: np.sqrt(((a - b) ** 2).sum(axis=-1))
        for i, kids in enumerate(tree.children):
            inside = tree.x[tree.first[i] : tree.last[i]]
            assert (dist(inside, tree.centre[i]) <= tree.radius[i] + 1e-12).all() and (dist(inside, tree.centre[i]) == 0).any()
            own = [c for c in kids if tree.level[c] >= 0]
            for c in own:
                assert tree.level[c] < tree.level[i] and tree.radius[c] <= 2.0 ** (tree.level[i] - 1) * (1 + 1e-8)
                assert all(dist(tree.centre[c], tree.centre[e]) > 2.0 ** (tree.level[i] - 1) for e in own if e != c)
            if kids:
                assert tree.first[kids[0]] == tree.first[i] and tree.last[kids[-1]] == tree.last[i]
                assert sum(tree.last[c] - tree.first[c] for c in kids) == tree.last[i] - tree.first[i]
            else:
                assert tree.last[i] - tree.first[i] <= (topk.PACK if tree.level[i] < 0 else topk.LEAF) or tree.radius[i] == 0
        assert len(x) != 2500 or len(tree.children[0]) > 1 and max(tree.level) > 0


def test_few_scores_are_computed_on_clusters(monkeypatch):
    """200 tight clusters in 4,096 rows: leaves are of one, but where two are small, and under a fifth of all scores is computed."""
    rnd = np.random.default_rng(3)
    for dim in (16, 64):
        centres = rnd.normal(size=(200, dim)) * 50
        of = rnd.integers(0, 200, 4096)
        x = np.floor(centres[of] + rnd.normal(size=(4096, dim)))
        d, q = topk.Tree(np.arange(4096), x), topk.Tree(np.arange(512), x[:512])
        leaves = [i for i, kids in enumerate(d.children) if not kids]
        unlike = [i for i in leaves if len(set(of[d.no[d.first[i] : d.last[i]]].tolist())) > 1]
        assert len(unlike) < len(leaves) / 10 and len(leaves) > 150
        best, seen, compare = topk.Best(512, 5, np.full(512, -np.inf)), [], topk._compare
        with monkeypatch.context() as m:
            m.setattr(topk, "_compare", lambda q, rows, d, s, e, best: (seen.append(len(rows) * (e - s)), compare(q, rows, d, s, e, best)))
            topk.search(q, d, best)
        assert 0 < sum(seen) < 0.2 * 512 * 4096
        scores = q.x @ x.T
        scores[np.arange(512), q.no] = -np.inf
        assert (best.score == -np.sort(-scores, axis=1)[:, :5]).all()


def test_trees_of_the_table_have_nodes(spark):
    vectors = topk.integer_vectors(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet"), "vec_id", "embedding")
    x = np.array([r.v for r in vectors.orderBy("id").collect()])
    tree = topk.Tree(np.arange(len(x)), x)
    assert len(tree.children) > 10 and max(tree.radius[i] for i, kids in enumerate(tree.children) if not kids) < tree.radius[0]


def test_pruning_drops_pairs_and_keeps_results():
    rnd = np.random.default_rng(2)
    centres = rnd.normal(size=(8, 8)) * 50
    x = np.floor(centres[rnd.integers(0, 8, 4000)] + rnd.normal(size=(4000, 8)))
    q, d = topk.Tree(np.arange(200) + 10_000, x[:200]), topk.Tree(np.arange(4000), x)
    best = topk.Best(200, 5, np.full(200, -np.inf))
    seen = 0
    inner = best.offer

    def offer(rows, score, no):
        nonlocal seen
        seen += score.size
        inner(rows, score, no)

    best.offer = offer
    topk.search(q, d, best)
    assert seen < 200 * 4000 / 2
    want = -np.sort(-(q.x @ d.x.T), axis=1)[:, :5]
    assert (best.score == want).all()


def test_saturated_scores_tie_and_long_vectors_meet(spark):
    huge, long = [2.0**40] * 8, [1.0] * 5_000
    rows = [(5, huge), (3, [2.0**41] * 8), (4, huge), (7, [-(2.0**41)] * 8), (6, long), (2, long[:2_500])]
    df = frame(spark, rows).selectExpr("vec_id AS id", "embedding AS v", "1 AS no", "2 AS cell", "'x' AS block")
    got = topk.top_k(df, F.col("id") == 5, 5, pivots=2, block=2).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(3, topk.MOST), (4, topk.MOST), (2, 2**43), (6, 2**43), (7, topk.LEAST)]


def test_edges(spark, as_table):
    rows = [(0, [1, 2]), (20, None), (40, [1, None]), (60, [math.nan, 1]), (80, [math.inf, 1]), (100, [3, -1]), (100, [3, -1]), (1, [0.5, -0.5]), (1, [0.5, -0.5]), (None, [9, 9]), (3, []), (4, [1e300, 0])]
    got = topk.query(spark, as_table("embeddings", frame(spark, rows))).collect()
    most = 2**63 - 1024
    v = [(0, [64, 128]), (100, [192, -64]), (100, [192, -64]), (1, [32, -32]), (1, [32, -32]), (None, [576, 576]), (3, [0, 0])]
    want = brute(v, range(3), 20)
    # floor saturates at the largest long, and so does the score
    mine = [tuple(r) for r in got if r.vec_id != 4]
    assert sorted((q, i, s) for q, _, i, s in map(lambda r: (r[0], r[1], -1 if r[2] is None else r[2], r[3]), mine)) == sorted((q, -1 if i is None else i, s) for q, _, i, s in want)
    assert sorted((r.query_id, r.rank, r.score) for r in got if r.vec_id == 4) == [(q, 1, most) for q in (0, 100, 100)]
    assert topk.query(spark, as_table("embeddings", frame(spark, []))).count() == 0
