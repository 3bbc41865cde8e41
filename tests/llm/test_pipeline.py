"""The pipeline's stages against brute-force versions, each on its own input."""

import hashlib
from collections import Counter

import public_tokenizers
import sentencepiece

import corpus_pipeline
from emberlog.llm import linededup, mixing, quality
from tests.llm.test_linededup import WORDY, brute
from tests.llm.test_mixing import brute_targets
from tests.llm.test_quality import WORDS, counts

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    before, results = docs, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, before, SF).write.parquet(f"{tmp_path}/{k}")
        before = spark.read.parquet(f"{tmp_path}/{k}")
        results.append(before)
    assert all(r.columns == columns for r in results[:-1])
    whole = [[(r.doc_id, r.text) for r in x.collect()] for x in [docs, *results[:-1]]]

    verdict = {r.doc_id: r.kept for r in quality.query(spark, SF).collect()}
    assert sorted(whole[1]) == sorted(x for x in whole[0] if verdict[x[0]])
    assert all(counts(t)["n_words"] >= 10 for _, t in whole[1])

    lines = [(i, t) for i, t, _, gone in brute(whole[1], linededup.MIN_WORDS) if not gone or WORDY.search(t)]
    assert sorted(whole[2]) == sorted(lines)
    assert all(r.n_chars == len(r.text) for r in results[1].collect())

    def shingles(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    own = [(i, shingles(t)) for i, t in whole[2]]
    kept = {i for i, _ in whole[3]}
    assert kept and sorted(whole[3]) == sorted(x for x in whole[2] if x[0] in kept)
    alike = lambda a, b: len(a & b) / len(a | b)
    for i, a in own:
        near = [j for j, b in own if j != i and alike(a, b) >= 0.8]
        assert i in kept or near, "a document without a near copy went"
        assert not (i in kept and any(j in kept for j in near)), "two near copies stayed"

    sizes = Counter()
    for r in results[2].collect():
        sizes[r.source] += len(WORDS.findall(r.text))
    target, taken = brute_targets(sizes), Counter()
    for r in results[3].collect():
        taken[r.source] += len(WORDS.findall(r.text))
    longest = max(len(WORDS.findall(t)) for _, t in whole[3])
    assert all(abs(taken[s] - target[s]) <= longest for s in target)
    assert max(Counter(i for i, _ in whole[4]).values()) <= mixing.MOST

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t in whole[4]:
        ids = library.encode(t)
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))))
    assert sorted(map(tuple, results[4].collect())) == sorted(want)
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(want)


def test_stages_on_nulls_repeats_and_nothing(spark, docs):
    text = "one two three four five six seven eight nine ten eleven"
    for rows in ([], [(1, None, None), (None, text), (2, text), (2, text), (3, ""), (4, "x " * 30_000, None)]):
        df = docs(rows).selectExpr("*", "1 AS id", "'x' AS _doc", "2 AS size")
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, df, SF).count() <= 3 * len(rows)


def test_columns_of_clashing_names_come_out_as_they_went_in(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60").drop("n_chars")
    names = "size target taken copies source_size n_lines n_removed row h skey kept node root fp runs whole k t1 t2 n key id _doc _gone stratum n_words rank".split()
    more = docs.selectExpr("*", *[f"concat('{n}', doc_id) AS {n}" for n in names])
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        plain, wide = stage(spark, docs, SF), stage(spark, more, SF)
        assert wide.columns == more.columns
        got = wide.collect()
        assert all(r[n] == f"{n}{r.doc_id}" for r in got for n in names)
        assert Counter((r.doc_id, r.text) for r in got) == Counter((r.doc_id, r.text) for r in plain.collect())
        kept.append(len(got))
    assert all(kept)
