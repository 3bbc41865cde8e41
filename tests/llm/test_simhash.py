"""Fingerprints and components against brute force."""

import random

import numpy as np
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from emberlog.llm import simhash
from emberlog.llm.components import components


def brute_fingerprint(text, width):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in low).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows, radius):
    """id -> least id reachable of rows (id, fp)."""
    fps = np.array([f for _, f in rows], np.uint64)
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in np.nonzero(np.bitwise_count(fps ^ fps[i]) <= radius)[0]:
            a, b = find(i), find(int(j))
            up[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        least.setdefault(find(i), []).append(d)
    return {d: min(least[find(i)]) for i, (d, _) in enumerate(rows)}


def test_query_equals_brute_force_on_all_documents(spark):
    sf = "/root/testdata/sf0.01"
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    prints = [(d, brute_fingerprint(t, 4)) for d, t in texts]
    roots = brute_components(prints, 4)
    got = simhash.query(spark, sf).collect()
    assert sorted(map(tuple, got)) == sorted((d, f"{f:016x}", roots[d]) for d, f in prints)
    assert sum(d != r for d, r in roots.items()) > 20


def test_tiles_lose_no_connection(monkeypatch):
    rnd = random.Random(3)
    fps = [rnd.getrandbits(64) for _ in range(300)]
    fps += [f ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) for f in fps] + [0, 1, 3]
    a = np.array(fps, np.uint64).reshape(-1, 1)
    monkeypatch.setattr(simhash, "SUB_TILE", 16)
    got = {tuple(sorted((int(x), int(y)))) for xs, ys in simhash.linked_pairs(a, a, 4, 4) for x, y in zip(xs, ys, strict=True) if x != y}
    want = {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if (fps[i] ^ fps[j]).bit_count() <= 4}
    assert got == want


def test_small_tiles_give_the_same_groups(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 20)
    rnd = random.Random(4)
    fps = [rnd.getrandbits(64) for _ in range(60)]
    for _ in range(120):
        fps.append(rnd.choice(fps) ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)))
    fps = list(dict.fromkeys(fps))
    df = spark.createDataFrame([(i, [f - 2**64 if f >= 2**63 else f]) for i, f in enumerate(fps)], "i bigint, fp array<bigint>")
    nodes = df.withColumn("node", F.get("fp", F.lit(0)))
    got = components(simhash.links(nodes, 1, 4, 4))
    back = {f - 2**64 if f >= 2**63 else f: i for i, f in enumerate(fps)}
    roots = {back[r.node]: back[r.root] for r in got.collect()}
    want = brute_components(list(enumerate(fps)), 4)
    group = {}
    for i in want:
        group.setdefault(want[i], set()).add(roots.get(i, i))
    assert all(len(g) == 1 for g in group.values()) and len({next(iter(g)) for g in group.values()}) == len(group)


def shuffled(spark):
    """Bytes that the session's stages have shuffled so far."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_four_times_the_fingerprints_shuffle_less_than_eight_times_the_bytes(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 10)
    monkeypatch.setattr(simhash, "BLOCKS", 4, raising=False)
    rnd, moved = random.Random(5), []
    for n in (300, 1200):
        rows = [(i, [rnd.getrandbits(64) - 2**63 for _ in range(4)]) for i in range(n)]
        classes = spark.createDataFrame(rows, "node bigint, fp array<bigint>")
        before = shuffled(spark)
        simhash.links(classes, 4, 20, 54).count()
        moved.append(shuffled(spark) - before)
    assert 0 < moved[1] < 8 * moved[0], moved


def test_blocks_lose_no_link_between_them(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 10)
    rnd = random.Random(6)
    fps = [sum(1 << b for b in rnd.sample(range(64), k)) for k in range(1, 64) for _ in range(6)]
    fps += [f ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) for f in fps]
    fps = list(dict.fromkeys(fps))
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    classes = spark.createDataFrame([(f, [f]) for f in signed], "node bigint, fp array<bigint>")
    roots = {r.node: r.root for r in components(simhash.links(classes, 1, 4, 4)).collect()}
    want = brute_components(list(zip(signed, fps, strict=True)), 4)
    assert {f: roots.get(f, f) for f in signed} == want and len(set(want.values())) < len(fps) - 200


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and all(got[i] == 100 for i in range(101, 160))
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_near_copies_go_and_others_stay(spark, docs):
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choices("abcdefghijklmnop", k=5))
    texts = [[word() for _ in range(300)] for _ in range(12)]
    near = [list(t) for t in texts[:6]]
    for t in near:
        for p in rnd.sample(range(300), 3):
            t[p] = word()
    rows = [(i, " ".join(t)) for i, t in enumerate(texts + near)]
    rows += [(50, None), (51, ""), (52, " \n"), (None, rows[0][1]), (60, "Solo Wort"), (61, "solo wort")]
    kept = simhash.drop_near_duplicates(docs(rows).selectExpr("*", "1 AS id", "2 AS node"))
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted([*map(str, range(12)), "50", "60", "None"])
    assert set(kept.columns) == {"doc_id", "text", "lang", "source", "n_chars", "id", "node"}


def test_empty_table_and_repeated_rows(spark, docs):
    assert simhash.drop_near_duplicates(docs([])).count() == 0
    assert simhash.drop_near_duplicates(docs([(1, "a b"), (1, "a b"), (2, "a b")])).count() == 2


def similar(a, b, width=5):
    a, b = ({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} for w in (a.split(), b.split()))
    return len(a & b) / len(a | b)


def test_pairs_below_the_similarity_stay(spark, docs, monkeypatch):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choices("abcdefghijklmnop", k=5))
    rows = []
    for changed in (6, 8, 14, 16, 18, 20, 24, 30) * 4:  # similarities of 0.90 to 0.59
        own = [word() for _ in range(120)]
        rows += [" ".join(own), " ".join(own[: 120 - changed] + [word() for _ in range(changed)])]
    for _ in range(6):  # short texts, as line dedup may leave
        own = [word() for _ in range(16)]
        rows += [" ".join(own), " ".join([*own[:14], word(), word()])]
    same = "ja " * 300  # one shingle outweighs all others, which are distinct
    rows += [same + " ".join(word() for _ in range(40)) for _ in range(2)]
    alike = [(i, j) for j in range(len(rows)) for i in range(j) if similar(rows[i], rows[j]) >= 0.8]
    want = set(range(len(rows))) - {j for _, j in alike}
    assert len(alike) == 8
    for chunk in (1024, 1):  # whole groups, and a chunk for each text
        monkeypatch.setattr(simhash, "CHUNK", chunk)
        assert {r.doc_id for r in simhash.drop_near_duplicates(docs(list(enumerate(rows)))).collect()} == want


def test_pairs_right_at_the_similarity_are_found(docs):
    """Planted pairs of 4 of 5 shingles in common, whatever their number; texts of few shingles are the hard ones."""
    rnd = random.Random(8)
    rows, pairs = [], {}
    for shared in (4, 8, 12, 16, 20, 40, 80):
        for _ in range(60):
            words = [f"w{rnd.randrange(10**9)}" for _ in range(shared + shared // 4 + 4)]
            rows += [" ".join(words), " ".join(words[: shared + 4])]
            pairs[len(rows) - 1] = shared
    kept = {r.doc_id for r in simhash.drop_near_duplicates(docs(list(enumerate(rows)))).collect()}
    assert {i for i in range(len(rows)) if i not in pairs} <= kept
    for shared in set(pairs.values()):
        found = [i not in kept for i, k in pairs.items() if k == shared]
        assert sum(found) >= 0.95 * len(found), shared


def test_sizes_and_connections_of_similar_links():
    rnd = np.random.default_rng(5)
    sets = [rnd.choice(10_000, 40, replace=False) for _ in range(12)]
    for s in sets[:12]:
        sets += [np.concatenate([s[k:], rnd.choice(10_000, k, replace=False)]) for k in (2, 5, 9)]
    sets = [np.unique(s) for s in sets]
    fps = np.zeros((len(sets), 4), np.uint64)  # all are candidates
    sizes = np.array([*map(len, sets)])
    pairs = [(i, j) for j in range(len(sets)) for i in range(j) if 5 * len(np.intersect1d(sets[i], sets[j])) >= 4 * len(np.union1d(sets[i], sets[j]))]
    want = simhash.absorb(np.arange(len(sets)), *np.array(pairs).T)
    for half in (None, 20):
        got = np.arange(len(sets))
        parts = [(range(48), None)] if half is None else [(range(20), None), (range(20, 48), None), (range(20), range(20, 48))]
        for a, b in parts:
            at = np.array([*a, *(b or [])])
            hung, root = simhash.similar_links(fps[list(a)], None if b is None else fps[list(b)], sizes[at], np.concatenate([sets[i] for i in at]), 20, 54, (4, 5))
            got = simhash.absorb(got, at[hung], at[root])
        assert (got == want).all()
    assert 12 < len(set(want.tolist())) < 48


def test_query_on_nulls_repeats_and_very_long_texts(spark, docs, as_table):
    long = " ".join(f"W{i % 70_001}" for i in range(simhash.SHINGLES_AT_ONCE + 20_000))
    rows = [(1, None), (2, ""), (2, ""), (None, " \n"), (3, long), (3, long), (7, long.lower()), (4, "A b"), (5, "a\tB"), (None, "words of their own")]
    component = [1, 1, 1, 1, 3, 3, 3, 4, 4, None]
    got = simhash.query(spark, as_table("documents", docs(rows).selectExpr("*", "1 AS node", "2 AS fp", "3 AS component_id"))).collect()
    prints = {t: f"{brute_fingerprint(t, 4):016x}" for _, t in rows}
    assert sorted(map(str, map(tuple, got))) == sorted(str((i, prints[t], c)) for (i, t), c in zip(rows, component, strict=True))
