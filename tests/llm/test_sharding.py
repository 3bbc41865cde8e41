"""Jump hashing against its published loop; slots and growth."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from emberlog.llm import sharding


def jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_shards_equal_the_published_loop():
    rnd = random.Random(1)
    keys = [rnd.randrange(2**64) for _ in range(500)] + [0, 2**64 - 1]
    for n in (1, 2, 8, 9, 1000):
        assert sharding.jump_hash(np.array(keys, np.uint64), n).tolist() == [jump(k, n) for k in keys]


def test_growth_moves_only_into_the_new_shard_and_little():
    keys = np.random.default_rng(1).integers(0, 2**63, 20_000).astype(np.uint64)
    for n in (8, 40):
        a, b = sharding.jump_hash(keys, n), sharding.jump_hash(keys, n + 1)
        assert set(b[a != b]) == {n}
        assert (a != b).mean() == pytest.approx(1 / (n + 1), rel=0.2)


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = sharding.query(spark, sf).collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    slots = defaultdict(list)
    for r in rows:
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 1, zlib.crc32(raw), "key")
        assert r.grown_shard in (r.shard, 8)
        slots[r.shard].append(r.slot)
    assert set(slots) == set(range(8))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_nulls_repeats_clashing_names_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a", 5), (1, "a", 5), (None, None, None), (2, "b", 7)], "doc_id bigint, _bucket string, shard int")
    got = sharding.shard_rows(df, ["doc_id"], 3)
    rows = got.collect()
    assert set(got.columns) == {"doc_id", "_bucket", "shard", "_shard", "grown_shard", "slot"} and len(rows) == 4
    by = defaultdict(list)
    for r in rows:
        by[r._shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert len({r._shard for r in rows if r.doc_id == 1}) == 1
    assert sharding.shard_rows(df.where("false"), ["doc_id"], 3).count() == 0


def test_written_shards(spark, tmp_path):
    df = sharding.shard_rows(spark.range(1000).withColumnRenamed("id", "doc_id"), ["doc_id"], 4)
    sharding.write_shards(df, f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 1000
    assert {p.name for p in (tmp_path / "out").iterdir() if p.is_dir()} == {f"shard={i}" for i in range(4)}


def test_query_on_nulls_very_long_texts_repeats_and_clashing_names(spark, docs, as_table):
    long = "é" * 3_000_000
    rows = [(1, None), (2, ""), (3, long), (3, long), (None, "a"), (None, "a"), (None, None)]
    df = docs(rows).selectExpr("*", "7 AS size", "'x' AS slot", "8 AS law", "9 AS _bucket", "1 AS text_crc32")
    got = sharding.query(spark, as_table("documents", df)).collect()
    want = [(str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows]
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == sorted(want)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({r.shard for r in got if r.doc_id is None}) == 1
