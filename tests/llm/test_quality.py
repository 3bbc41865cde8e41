"""Counts, bounds and verdicts against plain Python."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from emberlog.llm import quality

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    text = text or ""
    words = WORDS.findall(text)
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    hit = {p for i, w in enumerate(windows) if often[w] > 1 for p in range(i, i + 5)}
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ" + "".join(chr(c) for c in [*range(0xC0, 0xD7), *range(0xD8, 0xDF)])
    return {
        "n_words": len(words),
        "n_chars_in_words": sum(map(len, words)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_capitals": sum(c in upper for c in text),
        "n_shouts": text.count("!"),
        "n_lines": len(lines),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(hit),
    }


def scores(c):
    words = max(c["n_words"], 1)
    return {
        "symbols": c["n_symbols"] / words,
        "capitals": c["n_capitals"] / max(c["n_chars_in_words"], 1),
        "shouts": c["n_shouts"] / words,
        "dup_lines": c["n_dup_lines"] / max(c["n_lines"], 1),
        "repeats": c["n_repeat_words"] / words,
        "long_words": c["n_chars_in_words"] / words,
    }


def cdf(k, n, p):
    return math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(p) + (n - j) * math.log1p(-p)) for j in range(k + 1))


def brute_cutoffs(good):
    """(stratum, rule) -> cutoff, of good = [(stratum, scores)]."""
    strata = sorted({s for s, _ in good})
    tests = sum(len(g) for _, g in quality.RULES.values()) * len(strata)
    out = {}
    for s in strata:
        own = [x for t, x in good if t == s]
        for rule, (_, grid) in quality.RULES.items():
            for cut in grid:
                k = sum(x[rule] > cut for x in own)
                share = quality.RISK / len(quality.RULES)
                if k <= len(own) * share and cdf(k, len(own), share) <= quality.DELTA / tests:
                    out[s, rule] = cut
                    break
    return out


def test_binomial_bound(spark):
    cases = [(0, 10, 0.1), (3, 50, 0.01), (49, 50, 0.5), (7, 20_000, 0.001), (0, 5000, 0.0017)]
    for k, n, p in cases:
        got = spark.range(1).select(quality.log_binomial_cdf(F.lit(k), F.lit(n), p)).first()[0]
        assert got == pytest.approx(math.log(cdf(k, n, p)), rel=1e-9, abs=1e-12)


def test_query_equals_plain_python(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    q = {}
    for r in labels:
        if r.quality is not None:
            q[r.doc_id] = min(q.get(r.doc_id, 1), r.quality)
    own = {d.doc_id: counts(d.text) for d in docs}
    cuts = brute_cutoffs([(d.lang or "", scores(own[d.doc_id])) for d in docs if q.get(d.doc_id) == 1])
    got = {r.doc_id: r for r in quality.query(spark, sf).collect()}
    assert len(got) == len(docs)
    for d in docs:
        c, r = own[d.doc_id], got[d.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == tuple(c[k] for k in ("n_words", "n_chars_in_words", "n_symbols", "n_dup_lines", "n_repeat_words"))
        failed = c["n_words"] < 10 or 100 * c["n_repeat_words"] > 20 * c["n_words"]
        beyond = any(scores(c)[rule] > cuts[d.lang or "", rule] for rule in quality.RULES if (d.lang or "", rule) in cuts)
        assert (r.base_failed, r.kept) == (failed, not failed and not beyond)


def labelled(spark, n):
    """Documents of which a twentieth is junk, labelled rightly but for three."""
    ok = "the quick brown fox jumps over a lazy dog while it rains on {} hills of {} today"
    rows = [(i, ok.format(i, i * 7) if i % 20 else "#a $b %c &d *e |f <g >h #i $j %k &l " + str(i), "xx", "s", 0) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return docs, spark.createDataFrame([(i, int(i % 20 > 0 or i % 3000 == 0), 0) for i in range(n)], "doc_id bigint, quality int, toxic int")


def test_enough_labels_certify_and_few_do_not(spark):
    docs, labels = labelled(spark, 9000)
    kept = {r.doc_id for r in quality.filter_documents(docs, labels).collect()}
    assert kept == {i for i in range(9000) if i % 20}
    assert quality.filter_documents(docs, labels.limit(60)).count() == 9000


def test_nulls_repeats_clashing_names_and_empty_tables(spark, docs):
    good = "one two three four five six seven eight nine ten eleven"
    df = docs([(1, None), (2, ""), (3, good), (3, good), (None, good)]).selectExpr("*", "1 AS n_words", "2 AS counted", "3 AS cuts", "4 AS _row", "5 AS stratum")
    labels = spark.createDataFrame([(3, 1, 0), (3, 1, 0), (None, 1, 0), (1, None, None)], "doc_id bigint, quality int, toxic int")
    out = quality.filter_documents(df, labels)
    assert out.columns == df.columns and [r.text for r in out.collect()] == [good] * 3
    assert quality.filter_documents(df.withColumn("lang", F.lit(None).cast("string")), labels).count() == 3
    assert quality.filter_documents(df, labels.where("false")).count() == 3
    assert quality.filter_documents(df.where("false"), labels).count() == 0


def brute_steps(of_stratum, strata):
    """Cutoffs by rule of [scores], tightened in the fixed order."""
    cuts, stopped = {}, set()
    for d in range(7):
        for rule, (_, grid) in quality.RULES.items():
            if d >= len(grid) or rule in stopped:
                continue
            new = {**cuts, rule: grid[len(grid) - 1 - d]}
            k = sum(any(x[r] > c for r, c in new.items()) for x in of_stratum)
            j, n = len(stopped), len(of_stratum)
            if k <= n * quality.RISK and cdf(k, n, quality.RISK) <= quality.DELTA / 2 ** (j + 1) / math.comb(35, j) / strata:
                cuts = new
            else:
                stopped.add(rule)
    return cuts


def test_hundreds_of_labels_certify(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    counted, cutoffs = quality.cutoffs_from(docs, labels)
    good = counted.join(quality.labelled_good(labels), "doc_id", "left_semi").collect()
    by_lang = {}
    for r in good:
        by_lang.setdefault(r.stratum, []).append(scores(r.asDict()))
    enough = {s: x for s, x in by_lang.items() if len(x) >= 368}
    assert {s: r for s, r in cutoffs.collect()} == {s: brute_steps(x, len(enough)) for s, x in enough.items()}
    judged = quality.judge(counted, cutoffs)
    assert judged.where(~F.col("kept") & ~quality.base_failed()).count() > 0


def test_a_rule_that_good_documents_break_does_not_stop_the_others(spark):
    words = "the quick brown fox jumps over a lazy dog while it rains on hills of today"
    text = lambda i: (words.upper() if i % 2 else words) + f" {i} {i * 7}" + (" # $ % & * < > | # $ % & *" if i % 50 == 0 else "")
    rows = [(i, text(i), "xx", "s", 0) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    labels = spark.createDataFrame([(i, int(i % 50 > 0), 0) for i in range(2000)], "doc_id bigint, quality int, toxic int")
    assert {r.doc_id for r in quality.filter_documents(df, labels).collect()} == {i for i in range(2000) if i % 50}


def test_very_long_texts(docs):
    words = [f"W{i}" for i in range(120_000)]
    text = "\n".join(" ".join(words[i : i + 40]) for i in range(0, len(words), 40)) + "\n" + " ".join(words[:400]) + "\n" + " ".join(words[:40]) + " # $\n" * 2
    r = quality.counts(docs([(1, text), (2, "x" * 2_000_000)]), "text", [F.col("doc_id")])
    got = {x.doc_id: x.asDict() for x in r.collect()}
    assert {k: got[1][k] for k in counts(text)} == counts(text)
    assert (got[2]["n_words"], got[2]["n_chars_in_words"], got[2]["n_repeat_words"]) == (1, 2_000_000, 0)
