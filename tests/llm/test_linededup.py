"""Line dedup against a brute-force version."""

import random
import re

from emberlog.llm import linededup

WORDY = re.compile(r"[^\x20\x09-\x0D]")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, min_words):
    """(id, text after, lines before, lines removed) of each of rows (id, text), from the definition: every run
    of lines with min_words words that begins at an earlier place too is deleted."""
    lines = {i: (t.split("\n") if t is not None else []) for i, t in rows}
    wordy = {i: [p for p, x in enumerate(ls) if WORDY.search(x)] for i, ls in lines.items()}
    order = sorted((i for i, t in rows if t is not None), key=lambda i: (i is None, i or 0))
    seq = [(i, p) for i in order for p in [*wordy[i], None]]  # None: the gap after a document
    at, earlier, cut = [None if p is None else lines[i][p] for i, p in seq], {}, {}
    for a, (i, p) in enumerate(seq):
        if p is None:
            continue
        longest = 0
        for b in earlier.get(at[a], ()):
            n = 0
            while at[a + n] is not None and at[a + n] == at[b + n]:
                n += 1
            longest = max(longest, n)
        earlier.setdefault(at[a], []).append(a)
        if sum(len(WORDS.findall(at[a + k])) for k in range(longest)) >= min_words:
            cut.setdefault(i, set()).update(seq[a + k][1] for k in range(longest))
    out = []
    for i, t in rows:
        gone = cut.get(i, set())
        left = "\n".join(x for p, x in enumerate(lines[i]) if p not in gone)
        out.append((i, None if t is None else left, len(lines[i]), len(gone)))
    return out


def key(r):
    return str(r)


def test_random_documents_equal_brute_force(spark, docs):
    rnd = random.Random(11)
    pool = [" ".join(rnd.choices("a b c d e f".split(), k=rnd.randint(1, 7))) for _ in range(12)] + ["", " \t"]
    rows = [(i, "\n".join(rnd.choices(pool, k=rnd.randint(0, 18)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, rows[3][1]), (104, "x " * 40), (105, "x " * 40), (None, rows[5][1])]
    got = linededup.dedup_lines(docs(rows), min_words=9).select("doc_id", "text", "n_lines", "n_removed").collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows, 9), key=key)


def test_all_documents_equal_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = linededup.query(spark, sf).select("doc_id", "text", "n_lines", "n_removed").collect()
    want = brute(rows, linededup.MIN_WORDS)
    assert sorted(map(tuple, got)) == sorted(want)
    assert sum(r[3] for r in want) > 50


def test_the_end_of_a_copy_goes_though_it_is_short(spark, docs):
    text = "\n".join(" ".join(f"{x}{i}" for i in range(n)) for x, n in (("a", 10), ("b", 10), ("c", 5)))
    out = linededup.dedup_lines(docs([(1, text), (2, text), (3, text + "\nown words of it")]))
    assert {r.doc_id: (r.text, r.n_removed) for r in out.collect()} == {1: (text, 0), 2: ("", 3), 3: ("own words of it", 3)}


def test_longest_earlier_runs_are_those_of_all_pairs(spark, docs):
    rnd = random.Random(5)
    for pool, n in ((2, 60), (5, 200), (1, 70)):
        rows = [(i, "\n".join(rnd.choices("abcdefg"[:pool], k=rnd.randint(1, n // 3)))) for i in range(4)]
        shared, _ = linededup.suffixes(docs(rows), "doc_id", "text")
        levels = linededup.doubled(shared)
        got = {r.g: r.length for r in linededup.longest_earlier(levels).collect()}
        texts = list(dict.fromkeys(t for _, t in rows))
        seq = "|".join(t.replace("\n", "") for t in texts) + "|"
        want = {}
        for a in range(len(seq)):
            for b in range(a):
                k = 0
                while seq[a + k] == seq[b + k] != "|":
                    k += 1
                want[a] = max(want.get(a, 0), k)
        assert got == {a: k for a, k in want.items() if k}


def test_repeated_rows_clashing_names_and_empty_tables(spark, docs):
    text = "one two three four five\nsix seven eight nine ten"
    df = docs([(1, text), (1, text), (2, text)]).selectExpr("*", "9 AS n_lines", "'z' AS h1", "'y' AS k1", "'q' AS runs", "'p' AS _doc")
    out = linededup.dedup_lines(df, min_words=8)
    rows = sorted((r.doc_id, r.text, r.n_lines, r._n_lines, r.n_removed, r.h1, r.k1, r.runs, r._doc) for r in out.collect())
    assert rows == [(1, text, 9, 2, 0, "z", "y", "q", "p")] * 2 + [(2, "", 9, 2, 2, "z", "y", "q", "p")]
    assert linededup.drop_copied_lines(df, min_words=8).columns == df.columns
    assert linededup.dedup_lines(df.where("false")).count() == 0
