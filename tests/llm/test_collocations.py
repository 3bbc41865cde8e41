"""Collocations: against SQL, and against plain Python on odd texts."""

import random
from collections import Counter

import duckdb
import numpy as np
import pytest

from emberlog.llm import collocations as col

SF = "/root/testdata/sf0.001"


def plain(rows, most=4, least=30, covered=80, top=2000, factor=2_000_000):
    """The result by definition, for (lang, text) rows."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        data = (text or "").encode().lower()
        for c in b".,;:!?\n\x0b\x0c\r":
            data = data.replace(bytes([c]), b"\n")
        for piece in data.split(b"\n"):
            words = [w for w in piece.replace(b"\t", b" ").split(b" ") if w]
            n[lang] += len(words)
            f.update((lang, tuple(words[i : i + k])) for k in range(1, most + 1) for i in range(len(words) - k + 1))
    found = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    longer = Counter()
    for (lang, p), a in found.items():
        for part in {p[i : i + k] for k in range(2, len(p)) for i in range(len(p) - k + 1)}:
            longer[lang, part] = max(longer[lang, part], a)
    out = []
    for (lang, p), a in found.items():
        if 100 * longer[lang, p] >= covered * a:
            continue
        cuts = [(factor * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.append((lang, b" ".join(p), a, f[lang, p[:k]], f[lang, p[k:]], n[lang], score))
    ranked = []
    for lang in {x[0] for x in out}:
        own = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1]))[:top]
        ranked += [(x[0], i + 1, x[1].decode(), *x[2:]) for i, x in enumerate(own)]
    return sorted(ranked)


@pytest.fixture
def texts(spark):
    def make(rows):
        return spark.createDataFrame([(t, g, "s") for g, t in rows], "text string, lang string, phrase string")

    return make


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    found = sorted(map(tuple, col.query(spark, SF).collect()))
    assert found and found == sorted(con.sql(col.SQL).fetchall())


def test_odd_texts_equal_plain_python(texts):
    rng = random.Random(4)
    words = ["A", "b", "é", "É", "the", "x-y", " ", "\x1c", "日本"]
    gaps = [" ", " ", " ", "  ", "\t", ". ", "\n", ",", "\x0b", "\x85"]
    rows = [(rng.choice(["en", "de", None, "und"]), "".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.randint(0, 60)))) for _ in range(400)]
    rows += [("en", None), ("fr", ""), ("en", " \t. "), *[("en", "the same text")] * 40]
    found = sorted(map(tuple, col.collocations(texts(rows)).collect()))
    assert found and found == plain(rows)


def test_ties_top_and_covered_phrases(texts):
    rows = [("en", "p q r")] * 10 + [("en", "a b, c d, e f")] * 12 + [("en", "q r")] * 3
    for args in ({"least": 5}, {"least": 5, "top": 2}, {"least": 5, "covered": 70}, {"least": 5, "most": 2}):
        found = sorted(map(tuple, col.collocations(texts(rows), **args).collect()))
        assert found == plain(rows, **args)
    # ties in score and count are ranked by phrase; 'p q' lies in 'p q r', as often as it
    found = [r.phrase for r in col.collocations(texts(rows), least=5).orderBy("rank").collect()]
    assert found[:4] == ["q r", "a b", "c d", "e f"] and "p q" not in found and "p q r" in found


def test_no_texts_and_no_phrases(texts):
    for rows in ([], [("en", None)], [("en", "one two three")]):
        assert col.collocations(texts(rows)).count() == 0


@pytest.mark.parametrize("k", [1, 2, 3, 4])
def test_long_texts_are_cut_without_losing_or_repeating_phrases(k):
    rng = random.Random(k)
    for size in (5, 16, 40, 100):
        texts = ["".join(rng.choice(["a", "bb", "ccc", "d" * rng.randint(1, 60)]) + rng.choice([" ", "  ", "\t", ". ", "\n"]) for _ in range(rng.randint(0, 80))) for _ in range(5)]
        want, found = Counter(), Counter()
        for t in texts:
            for piece in t.encode().translate(col.FOLD).split(b"\n"):
                w = piece.split()
                want.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
        for chunk in col.chunks([t.encode() for t in texts], k, size):
            for piece in chunk.split(b"\n"):
                w = piece.split()
                found.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
        assert found == want


def test_a_full_bit_table_changes_nothing(texts, monkeypatch):
    rng = random.Random(9)
    rows = [("en", " ".join(rng.choices("abcdefghij", k=30))) for _ in range(200)]
    want = plain(rows)
    monkeypatch.setattr(col, "bit_table", lambda level: np.full(col.LEAST_BITS // 8, 255, np.uint8))  # lets every phrase through
    assert sorted(map(tuple, col.collocations(texts(rows)).collect())) == want


def test_numbers_beyond_64_bits_are_exact(texts):
    rows = [("en", "a b")] * 40 + [("en", "a. b")] * 2
    found = col.collocations(texts(rows), factor=10**17).collect()
    assert [(r.a, r.l, r.r, r.score) for r in found] == [(40, 42, 42, 10**17 * 40 // 84)]
