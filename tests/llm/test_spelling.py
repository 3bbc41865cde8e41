"""Spelling variants against plain Python."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from emberlog.llm import spelling

SF = "/root/testdata/sf0.001"
ALPHABET = [chr(c) for c in [*range(97, 123), *range(0xC0, 0x100)]]


def plain(rows, shortest=6, least=5, times=5, rate=199):
    """The result by definition, for (doc_id, text) rows."""
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % rate == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= shortest:
                n[run] += 1
    n = {w: c for w, c in n.items() if c >= least}
    slots = defaultdict(list)
    for w in n:
        for i in range(len(w)):
            slots[i, w[:i] + w[i + 1 :]].append(w)
    near = defaultdict(set)
    for (_, rest), own in slots.items():
        for w in own:
            near[w].update(set(own) - {w})
            if rest in n:
                near[w].add(rest)
                near[rest].add(w)
    form = {}
    for w, c in n.items():
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= times * c else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=str)


def test_query_equals_plain_python(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = plain(rows)
    assert any(r[1] for r in want) and rows_of(spelling.query(spark, SF)) == want


def test_near_words_of_few_letters_equal_plain_python(docs):
    """Words over three letters: anagrams, doubled letters and exchanges everywhere."""
    rng = random.Random(6)
    rows = [(i, " ".join("".join(rng.choices("aBé", k=rng.randint(3, 6))) for _ in range(80))) for i in range(40)]
    args = {"shortest": 3, "least": 2, "times": 2, "rate": 7}
    want = plain(rows, **args)
    assert max(r[4] for r in want) > 8 and rows_of(spelling.variants(docs(rows), **args)) == want


def test_chains_of_forms_and_ties(docs):
    text = "abcdef " * 1000 + "abcdeg " * 100 + "abcdxg " * 10 + "abzdef " * 1000 + "abydef " * 10
    want = plain([(1, text)])
    found = rows_of(spelling.variants(docs([(1, text)])))
    assert found == want
    by_word = {r[0]: r for r in found}
    assert by_word["abcdxg"][1:3] == ("abcdeg", "abcdef") and by_word["abydef"][1] == "abcdef"


def test_edges(docs):
    long = "q" * 3_000
    rows = [(1, None), (2, ""), (None, "summer Summer SUMMER summer summer sumer"), (3, "1234 a-b"), (4, "ÀÉÎÕÜß ÀÉÎÕÜß ÀÉÎÕÜß ÀÉÎÕÜß ÀÉÎÕÜß"), (4, "ÀÉÎÕÜß"), (4, "ÀÉÎÕÜß")]
    rows += [(10 + i, f"{long} {long}q x{long[:500]} {long[:250]}x{long[:250]}") for i in range(6)]
    df = docs(rows).withColumnsRenamed({"lang": "word", "source": "form"})
    assert rows_of(spelling.variants(df)) == plain(rows)
    assert spelling.variants(docs([])).count() == 0
    assert spelling.variants(docs([(1, None)])).count() == 0


@pytest.mark.parametrize("rate", [1, 3])
def test_slips(docs, rate):
    rows = [(i, "Kangaroo kangaroos Straße") for i in range(60)]
    assert rows_of(spelling.variants(docs(rows), rate=rate)) == plain(rows, rate=rate)
