"""Token files: ids against the tokenizers library, files against what was written."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from emberlog.llm import token_files as tf
from emberlog.llm.byte_bpe import Encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def expected(library, rows):
    """(doc_id, start, n_tokens, ids_crc32) of (doc_id, text) rows in order."""
    out, at = [], 0
    for doc_id, text in rows:
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        out.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_encoder_equals_library_on_odd_texts(library):
    rng = random.Random(5)
    parts = [*"stmdrevlLS'' ab19!?\n\t é　中½́  ", "'re", "'ll", "'ve", "'RE", "  ", "\x1c", "\x85", "🙂", "𐐀", "<|endoftext|>", "ﬁ", "٣"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(20_000)]
    encoder = Encoder(PATH)
    for a in range(0, len(texts), 2_000):
        ids, start = encoder.encode(texts[a : a + 2_000])
        want = [e.ids for e in library.encode_batch(texts[a : a + 2_000], add_special_tokens=False)]
        assert [ids[x:y].tolist() for x, y in zip(start, start[1:], strict=False)] == want


@pytest.mark.parametrize("sizes", [[1], [255, 256, 257], [70_000, 3, 65_536, 0], [0]])
def test_blocks_round_trip(sizes):
    rng = np.random.default_rng(1)
    blocks = [np.minimum(rng.zipf(1.3, n), 50_000).astype(np.int32) for n in sizes]
    values, counts = np.unique(np.concatenate(blocks), return_counts=True)
    table = tf.Table.from_bytes(tf.Table.fitted(dict(zip(values.tolist(), counts.tolist(), strict=True))).to_bytes())
    for ids, coded in zip(blocks, tf.encode_blocks(blocks, table), strict=True):
        made = tf.frame(ids, coded, ([None, 7], [len(ids), 1], [0, 0], [len(ids), 0]), (3, 4, 5), 9)
        (f,) = tf.frames(made + tf.SEPARATOR.encode())
        assert tf.decode_frames([f], table)[0].tolist() == ids.tolist()
        assert (f["range"], f["block"], f["first"], f["doc_id"].tolist(), f["has"].tolist()) == (3, 4, 5, [0, 7], [0, 1])


def test_rare_and_single_ids_are_coded():
    for counts in ({5: 1}, {0: 10**12, 50_256: 1}, {i: 1 for i in range(100_000)}):
        table = tf.Table.fitted(counts)
        assert table.slots.sum() == 1 << table.precision and table.slots.min() >= 1
        ids = np.array(list(counts)[:1_000], np.int32)
        ((words, states, offsets),) = tf.encode_blocks([ids], table)
        rows = np.array([-(-len(ids) // tf.LANES)])
        assert tf.decode_segments(words, states, offsets, rows, table)[0][: len(ids)].tolist() == ids.tolist()


def test_skewed_ids_take_about_their_entropy():
    ids = np.random.default_rng(2).choice(4, 1 << 18, p=[0.9, 0.05, 0.03, 0.02]).astype(np.int32)
    ((words, states, _),) = tf.encode_blocks([ids], tf.Table.fitted(dict(enumerate(np.bincount(ids).tolist()))))
    p = np.bincount(ids) / len(ids)
    assert words.nbytes + states.nbytes < len(ids) / 8 * -(p * np.log2(p)).sum() * 1.02 + 16 * tf.LANES * 8


def test_crc_of_pieces():
    data = np.random.default_rng(3).bytes(100_000)
    for cut in (0, 1, 4_096, 99_999, 100_000):
        assert tf.crc_before(zlib.crc32(data[:cut]), len(data) - cut) ^ zlib.crc32(data[cut:]) == zlib.crc32(data)


def test_query_equals_library(spark, library):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    assert sorted(map(tuple, tf.query(spark, SF).collect())) == expected(library, rows)


def test_edges(spark, docs, as_table, library):
    long = "x y " * 200_000  # over one block
    rows = [(3, None), (1, "a b"), (2, ""), (4, long), (4, "z"), (4, "z"), (None, "no id"), (9, "<|endoftext|> it's")]
    df = docs(rows).withColumnsRenamed({"lang": "range", "source": "start"})
    found = [tuple(r) for r in tf.query(spark, as_table("documents", df)).orderBy("start").collect()]
    texts = [r for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] == "z"))]
    either = [*texts[:4], *texts[5:7], texts[4], *texts[7:]]  # rows of one doc_id come in order of their texts' hashes
    assert found in (expected(library, texts), expected(library, either))
    assert tf.query(spark, as_table("documents", docs([]))).count() == 0


def test_ids_are_read_back_in_pieces_and_files_keep_order(spark, docs, tmp_path, library):
    rows = [(i, f"text {i} " * (1 + i % 7)) for i in range(300)] + [(300, "x y " * 200_000)]
    path = f"{tmp_path}/tokens"
    tf.write_token_files(docs(rows).repartition(5), path, PATH, 2)
    found: dict = {}
    for r in tf.read_token_files(spark, path).orderBy("start", "skip").collect():
        found[r.doc_id] = found.get(r.doc_id, []) + r.ids
    assert found == {i: library.encode(t, add_special_tokens=False).ids + [2] for i, t in rows}
    shared, last = tf.Table.from_bytes(tf.read_table(spark, path)), (-1, -1)
    for file in sorted((tmp_path / "tokens/ids").glob("range=*/part-*")):
        for f in tf.frames(file.read_bytes()):
            assert (f["range"], f["block"]) > last and len(tf.decode_frames([f], shared)[0]) == f["n"]
            last = f["range"], f["block"]


def test_changed_files_are_found(spark, docs, tmp_path):
    path = f"{tmp_path}/tokens"
    tf.write_token_files(docs([(1, "some text"), (2, "more text")]).coalesce(1), path, PATH, 2)
    (file,) = (tmp_path / "tokens/ids").glob("range=*/part-*")
    whole = file.read_bytes()
    for changed in (whole[:-20], whole[:70] + bytes([whole[70] ^ 1]) + whole[71:], b"EMBX" + whole[4:]):
        with pytest.raises(tf.Corrupt):
            list(tf.frames(changed))
    packed = tf.read_table(spark, path)
    with pytest.raises(tf.Corrupt):
        tf.Table.from_bytes(packed[:-6] + b"xxxxxx")
