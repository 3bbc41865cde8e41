"""Encoding and decoding against the sentencepiece library."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from emberlog.llm import sentencepiece_bpe as bpe

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def odd_texts():
    rnd = random.Random(3)
    alphabet = ["a", "b", "th", "er", " ", "  ", "\n", "\t", "é", "ß", "中", "🙂", "▁", "0", "12", "AKIA", "=", "the", " ", "́", "ﬁ", "<s>", "<0x41>", "aaaa"]
    return ["".join(rnd.choices(alphabet, k=rnd.randint(0, 60))) for _ in range(400)]


EDGES = ["", " ", "  ", "   a", "a   ", "\n", "▁", "▁▁a", " ▁ ", "a" * 9000, "ab" * 4000 + " c", "🙂" * 50, "\x00", "</s>", "x\r\ny", "ab " * 5000]


def test_ids_and_text_equal_the_librarys(library):
    model = bpe.PieceModel(PATH)
    texts = odd_texts() + EDGES
    ids, start = model.encode(texts)
    for t, a, b in zip(texts, start[:-1], start[1:], strict=True):
        assert ids[a:b].tolist() == library.encode(t), t[:80]
    out, ends = model.decode(ids, start)
    for t, a, b in zip(texts, ends[:-1], ends[1:], strict=True):
        assert out[a:b].tobytes().decode() == library.decode(library.encode(t)), t[:80]


def test_decoding_of_any_ids(library):
    model = bpe.PieceModel(PATH)
    rnd = random.Random(5)
    rows = [[rnd.randrange(model.base - 1) for _ in range(rnd.randint(0, 20))] for _ in range(200)]
    rows += [[rnd.choice(model.byte).item() for _ in range(rnd.randint(0, 9))] for _ in range(200)] + [[], [0], [1, 2], [model.unk]]
    start = np.r_[0, np.cumsum([len(r) for r in rows])].astype(np.int64)
    out, ends = model.decode(np.array([i for r in rows for i in r], np.int64), start)
    for r, a, b in zip(rows, ends[:-1], ends[1:], strict=True):
        assert out[a:b].tobytes().decode() == library.decode(r), r


def test_word_table_starts_anew_when_full(library, monkeypatch):
    monkeypatch.setattr(bpe, "TABLE_WORDS", 5)
    model = bpe.PieceModel(PATH)
    for t in odd_texts()[:40]:
        ids, _ = model.encode([t])
        assert ids.tolist() == library.encode(t)


def test_query_equals_the_library_on_whole_documents(spark, library):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in bpe.query(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for d in docs:
        ids = library.encode(d.text or "")
        assert got[d.doc_id].n_tokens == len(ids)
        assert got[d.doc_id].ids_sha256 == sha(",".join(map(str, ids)))
        assert got[d.doc_id].decoded_sha256 == sha(library.decode(ids))


def test_nulls_repeats_and_empty_tables(spark, docs):
    rows = bpe.digests(docs([(1, None), (None, ""), (1, "a b"), (1, "a b")])).collect()
    assert sorted((r.n_tokens for r in rows)) == [0, 0, 2, 2]
    assert len({r.ids_sha256 for r in rows}) == 2
    assert bpe.digests(docs([])).count() == 0


def test_columns_encode_and_decode_apart(spark, docs, library):
    ids = docs([(1, "hello there"), (2, None)]).withColumn("ids", bpe.encode_column(F.col("text"), PATH))
    back = {r.doc_id: (r.ids, r.back) for r in ids.withColumn("back", bpe.decode_column(F.col("ids"), PATH)).collect()}
    assert back[1] == (library.encode("hello there"), "hello there")
    assert back[2] == ([], "")


def test_very_long_words_go_through_the_same_rounds(library):
    model = bpe.PieceModel(public_tokenizers.path("piece_bpe_32k.model"))
    rnd = random.Random(3)
    words = ["ab" * 12_000, "a" * 20_001, "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=30_000)), "".join(rnd.choices("aab", k=20_000))]
    words += ["".join(rnd.choices("ABCDEFabcdef0123456789+/=", k=20_000)), "".join(rnd.choices("的一是不了人我在有他éñ", k=9_000)), "thethethein" * 2_000, "-" * 9_000 + "=" * 9_001]
    words += ["".join(rnd.choices(["ing", "tion", "th", "e", "s", "er", "the", "in"], k=8_000)) for _ in range(3)]
    for w in words:
        ids, start = model.encode([w, f"x {w} y"])
        assert [ids[a:b].tolist() for a, b in zip(start[:-1], start[1:])] == library.encode([w, f"x {w} y"])


def test_clashing_names(docs):
    df = docs([(1, "a b"), (None, "a b")])
    wide = df.selectExpr("*", "7 AS n_tokens", "'x' AS ids_sha256", "8 AS ids", "9 AS decoded_sha256")
    columns = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(str, bpe.digests(wide).select(*columns).collect())) == sorted(map(str, bpe.digests(df).select(*columns).collect()))


def test_long_words_are_cut_where_no_piece_crosses(library):
    rnd = random.Random(3)
    texts = [
        "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(30000)),
        base64.b64encode(rnd.randbytes(30000)).decode(),
        rnd.randbytes(20000).hex(),
        "a" * 20000 + "é漢😀" * 2000,
    ]
    model = bpe.PieceModel(PATH)
    ids, start = model.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(start[:-1], start[1:], strict=True)] == library.encode(texts)
    characters = model.of_char[np.array([ord(c) for c in "qz"])]
    assert not model.beside(characters).any() and model.beside(model.of_char[np.array([ord(c) for c in "th"])]).all()
