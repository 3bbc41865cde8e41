"""Targets, quotas and draws against plain Python and exact probabilities."""

import math
import re
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
import xxhash
from pyspark.sql import functions as F

from emberlog.llm import mixing

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(sizes):
    """Targets of sizes {source: words}, excess reshared by weight until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
    capped, total = {}, Fraction(sum(sizes.values()))
    while True:
        free = [s for s in order if s not in capped]
        left = total - sum(capped.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return {s: float(share.get(s, capped.get(s))) for s in order}
        capped |= {s: Fraction(3 * sizes[s]) for s in over}


def check(spark, rows, got):
    size = Counter()
    for _, text, source in rows:
        size[source] += len(WORDS.findall(text or ""))
    want = brute_targets(dict(size))
    taken, largest = Counter(), defaultdict(int)
    for r in got:
        source = r.source
        n = len(WORDS.findall(r.text or ""))
        assert (r.size, r.source_size) == (n, size[source])
        assert r.target == pytest.approx(want[source], rel=1e-12)
        assert r.taken <= 3 * n and (r.taken == 0 if n == 0 else r.taken % n == 0)
        taken[source] += r.taken
        largest[source] = max(largest[source], n)
    for s in size:
        assert abs(taken[s] - want[s]) <= largest[s]
    return taken


def test_all_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    mixed = mixing.mix(docs).collect()
    assert len(mixed) == len(rows)
    taken = check(spark, rows, mixed)
    again = mixing.query(spark, "/root/testdata/sf0.01").collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in mixed)
    target = {r.source: r.target for r in mixed}
    assert all(abs(taken[s] - target[s]) <= 0.02 * target[s] + 20 for s in taken)


def test_partitioning_does_not_change_the_draws(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    one = sorted((r.doc_id, r.taken, str(r.copies)) for r in mixing.mix(docs.coalesce(1)).collect())
    assert one == sorted((r.doc_id, r.taken, str(r.copies)) for r in mixing.mix(docs.repartition(7)).collect())


def test_caps_are_reshared_and_null_is_a_source(spark, docs):
    rows = [(i, "w " * (i % 9 + 1), s) for i, s in enumerate(["a"] * 3 + ["b"] * 60 + ["c"] * 30 + [None] * 20 + ["é"] * 2)]
    rows += [(900, None, "d"), (901, "", "d"), (902, None, None), (None, "x y z", "b"), (903, "x y z", "b"), (903, "x y z", "b")]
    df = docs([(r[0], r[1]) for r in rows]).drop("source").join(spark.createDataFrame([(r[0], r[2]) for r in rows if r[0] is not None and r[0] < 900], "doc_id bigint, source string"), "doc_id", "left")
    df = spark.createDataFrame([(r[0], r[1], "en", r[2], 0) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = mixing.mix(df.selectExpr("*", "'k' AS block", "'m' AS skey", "1 AS words", "'r' AS row", "9 AS h")).collect()
    assert len(got) == len(rows)
    check(spark, rows, got)
    assert {(r.block, r.skey, r.words, r.row, r.h) for r in got} == {("k", "m", 1, "r", 9)}


def test_columns_of_the_same_names_stay(spark, docs):
    df = docs([(i, "w " * (i + 1)) for i in range(40)])
    plain = {r.doc_id: (r.size, r.target, r.taken, r.copies) for r in mixing.mix(df).collect()}
    more = df.selectExpr("*", "777 AS size", "'keep' AS target", "5 AS taken", "'c' AS copies", "doc_id AS source_size")
    for r in mixing.mix(more).collect():
        assert (r.size, r.target, r.taken, r.copies, r.source_size) == (777, "keep", 5, "c", r.doc_id)
        assert (r._size, r._target, r._taken, r._copies) == plain[r.doc_id]
    for r in mixing.mixed_documents(more).collect():
        assert (r.size, r.target, r.taken, r.copies, r.source_size) == (777, "keep", 5, "c", r.doc_id)


def test_empty_tables_and_texts(spark, docs):
    assert mixing.mix(docs([])).count() == 0
    assert [(r.taken, r.target) for r in mixing.mix(docs([(1, None), (2, " ")])).collect()] == [(0, 0.0)] * 2
    assert mixing.mixed_documents(docs([])).count() == 0


def test_mixed_documents_are_the_copies(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = Counter({r.doc_id: len(r.copies) for r in mixing.mix(docs).collect()})
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    assert Counter(r.doc_id for r in out.collect()) == +want


def test_hypergeometric_draws_have_the_exact_distribution(spark):
    for total, good, drawn in ((20, 7, 9), (50, 3, 25), (9, 9, 4), (30, 29, 15), (6, 0, 3)):
        n = 4000
        u = (F.col("id") + 0.5) / n
        got = Counter(r[0] for r in spark.range(n).select(mixing.hypergeometric(F.lit(total), F.lit(good), F.lit(drawn), u)).collect())
        for k in range(good + 1):
            p = math.comb(good, k) * math.comb(total - good, drawn - k) / math.comb(total, drawn) if drawn >= k else 0
            assert got.get(k, 0) == pytest.approx(n * p, abs=2)


def test_quotas_are_split_exactly(spark):
    quotas = spark.createDataFrame([(0, 17), (1, 1), (2, 0), (3, 240)], "place int, n bigint")
    got = mixing.split_tree(quotas, 8).collect()
    by_place, by_shard = Counter(), Counter()
    for r in got:
        by_place[r.place] += r.n
        by_shard[r.shard] += r.n
    assert by_place == {0: 17, 1: 1, 2: 0, 3: 240}
    assert max(by_shard.values()) - min(by_shard.values()) <= 1
    with pytest.raises(ValueError):
        mixing.split_tree(quotas, 6)


def unit(*parts):
    """mixing._unit of whole numbers (width in bytes, value), in plain Python: XXH64, each seeded by the one before."""
    seed = 42
    for width, x in ((4, mixing.SEED), *parts):
        seed = xxhash.xxh64_intdigest(x.to_bytes(width, "little"), seed)
    return (seed >> 11) / 2**53


def draw(total, good, drawn, u):
    """A hypergeometric draw by inversion, outwards from the mode: the mode first, then all above, then all below."""
    if good <= 0 or drawn <= 0:
        return 0
    if good >= total:
        return drawn
    if drawn >= total:
        return good
    low, high = max(0, drawn - (total - good)), min(good, drawn)
    mode = min(high, max(low, (drawn + 1) * (good + 1) // (total + 2)))
    p = {k: Fraction(math.comb(good, k) * math.comb(total - good, drawn - k), math.comb(total, drawn)) for k in range(low, high + 1)}
    acc = Fraction(0)
    for k in (mode, *range(mode + 1, high + 1), *range(mode - 1, low - 1, -1)):
        acc += p[k]
        if u < acc:
            return k
    return low


def test_tree_equals_its_recomputation_in_plain_python(spark):
    counts = {0: 40, 1: 3, 2: 128, 3: 0, 5: 77, 300: 12, 301: 9, 70_000: 31}
    got = {(r.shard, r.place): r.n for r in mixing.split_tree(spark.createDataFrame(list(counts.items()), "place bigint, n bigint"), 4).collect()}

    def fold(node, depth, digit, ids, drawn, value):
        total, out = sum(value.values()), {}
        for i in ids:
            out[i] = draw(total, value[i], drawn, unit((4, depth), (4, digit), (4, node), (8, i)))
            total, drawn = total - value[i], drawn - out[i]
        return out

    nodes = {0: counts}
    for depth in range(2):
        split = {}
        for node, own in nodes.items():
            level = [own]
            for _ in range(3):
                wider = Counter()
                for i, n in level[-1].items():
                    wider[i >> 8] += n
                level.append(dict(wider))
            drawn = {0: -(-level[3][0] // 2)}
            for digit in (2, 1, 0):
                below = {}
                for g, d in drawn.items():
                    ids = sorted(i for i in level[digit] if i >> 8 == g)
                    below |= fold(node, depth, digit, ids, d, {i: level[digit][i] for i in ids})
                drawn = below
            split[2 * node], split[2 * node + 1] = drawn, {i: own[i] - drawn[i] for i in own}
        nodes = split
    assert got == {(s, i): n for s, own in nodes.items() for i, n in own.items()}


def test_every_shard_has_the_mix(spark):
    """On 10,000 documents: shares of the sources in each of 16 shards lie near the targets'."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    words, want = Counter(), {}
    for r in mixing.mix(docs, keep=["source"]).where("size(copies) > 0").collect():
        want[r.source] = r.target
        for c in r.copies:
            words[c.shard, r.source] += r.size
    shard = Counter()
    for (s, _), n in words.items():
        shard[s] += n
    whole = sum(want.values())
    assert len(shard) == 16 and all((s, x) in words for s in shard for x in want)
    off = [abs(words[s, x] / shard[s] - want[x] / whole) for s in shard for x in want]
    # the longest document alone is 8% of a shard's words
    assert max(off) <= 0.12 and sum(off) / len(off) <= 0.015
