"""Quality rules whose cutoffs carry a risk guarantee.

Every rule scores a document; larger is worse. On labelled holdouts, per
stratum (the language), cutoffs are tightened step by step in a fixed order
(STEPS): the loosest of each rule first, then the next. An exact binomial test
decides at each step whether the share of good documents beyond any cutoff,
the new one included, is at most RISK. A rule whose step fails keeps its last
cutoff and is not tried again. The steps up to the first failure need no
correction for their number, as the first set of cutoffs that loses too much
must pass by chance for anything to go wrong. After j failures the order
depends on which of the steps failed, so there the level is divided by the
number of choices of j steps. Each j has a share 2^-(j+1) of DELTA, and the
strata with labels enough to pass any test share alike, so with probability
1 - DELTA no stratum loses more than RISK of its good documents to cutoffs.
A stratum with too few labels rejects nothing by them.

All of this is DataFrame functions: no Python runs on the executors.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm.common import WORD, materialize, table

RISK, DELTA = 0.01, 0.05
#: Each rule's score as SQL over the counts, and its grid of cutoffs.
RULES: dict[str, tuple[str, tuple[float, ...]]] = {
    "symbols": ("n_symbols / greatest(n_words, 1)", (0.02, 0.05, 0.1, 0.2, 0.4, 0.8, 1.6)),
    "capitals": ("n_capitals / greatest(n_chars_in_words, 1)", (0.1, 0.15, 0.2, 0.3, 0.4, 0.6)),
    "shouts": ("n_shouts / greatest(n_words, 1)", (0.02, 0.05, 0.1, 0.2, 0.5, 1.0)),
    "dup_lines": ("n_dup_lines / greatest(n_lines, 1)", (0.34, 0.4, 0.5, 0.6, 0.7, 0.8)),
    "repeats": ("n_repeat_words / greatest(n_words, 1)", (0.02, 0.05, 0.1, 0.15, 0.2)),
    "long_words": ("n_chars_in_words / greatest(n_words, 1)", (8.0, 10.0, 12.0, 15.0, 20.0)),
}
#: The order of tests: (rule, grid place of its new cutoff), from the loosest cutoffs of all rules to the strictest.
STEPS: list[tuple[int, int]] = [
    (r, len(grid) - 1 - d)
    for d in range(max(len(grid) for _, grid in RULES.values()))
    for r, (_, grid) in enumerate(RULES.values())
    if d < len(grid)
]
SPACES = r"[\x20\x09-\x0D]+"
REPEAT = 5
#: Strata up to which their cutoffs are broadcast; beyond, they are joined by a shuffle.
BROADCAST_STRATA = 10_000


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value evaluated once even where lambdas read it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _kept(text: Column, pattern: str) -> Column:
    """Characters of text that match pattern."""
    return F.char_length(F.regexp_replace(text, f"[^{pattern}]+", "")).cast("long")


def repeated_words(words: Column) -> Column:
    """Words in windows of REPEAT words found twice or more, first ones included.

    Windows are compared by a 64-bit hash. Most texts repeat none: there the
    distinct hashes are as many as the hashes, and nothing is sorted.
    """
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def windows(h: Column) -> Column:
        at = F.when(F.size(h) >= REPEAT, F.sequence(F.lit(0), F.size(h) - REPEAT)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(REPEAT)]))

    def covered(g: Column) -> Column:
        placed = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("p"))))

        def twice(s: Column) -> Column:
            same = lambda x, i: F.coalesce(F.get(s, i)["g"] == x["g"], F.lit(False))
            return F.transform(F.filter(s, lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["p"])

        return F.aggregate(
            F.sort_array(let(placed, twice)),
            F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
            lambda acc, p: F.struct(
                (p + REPEAT).alias("end"), (acc["n"] + REPEAT - F.greatest(F.lit(0), acc["end"] - p)).alias("n")
            ),
            lambda acc: acc["n"],
        )

    none = lambda g: F.size(F.array_distinct(g)) == F.size(g)
    return let(let(hashes, windows), lambda g: F.when(none(g), 0).otherwise(covered(g))).cast("long")


def count_columns(text: Column) -> dict[str, Column]:
    """The counts of a whole text that the rules use; null and empty texts count 0 throughout."""
    text = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))
    lines = F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(WORD)))
    counted = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("r")))
    line_counts = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), F.size(F.array_distinct(x)).cast("long").alias("d")))
    return {
        "counted": counted,
        "line_counts": line_counts,
        "n_chars_in_words": F.char_length(F.regexp_replace(text, SPACES, "")).cast("long"),
        "n_symbols": _kept(text, "#*$%&|<>"),
        "n_capitals": _kept(text, "A-ZÀ-ÖØ-Þ"),
        "n_shouts": _kept(text, "!"),
    }


def counts(df: DataFrame, text_col: str, keep: list[Column]) -> DataFrame:
    """keep and all counts of every row."""
    raw = df.select(*keep, *[c.alias(k) for k, c in count_columns(F.col(text_col)).items()])
    return raw.select(
        *[c for c in raw.columns if c not in ("counted", "line_counts")],
        F.col("counted.n").alias("n_words"),
        F.col("counted.r").alias("n_repeat_words"),
        F.col("line_counts.n").alias("n_lines"),
        (F.col("line_counts.n") - F.col("line_counts.d")).alias("n_dup_lines"),
    )


def base_failed() -> Column:
    return F.expr("n_words < 10 OR 100 * n_repeat_words > 20 * n_words")


def log_binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """ln P(X <= k), X binomial(n, p): the terms are summed from j = 0 in logarithms."""
    n, k = n.cast("double"), k.cast("int")
    first = n * math.log1p(-p)
    grow = lambda acc, j: acc["term"] + F.log((n - j + 1.0) / j) + F.lit(math.log(p / (1 - p)))

    def step(acc: Column, j: Column) -> Column:
        def both(term: Column) -> Column:
            top = F.greatest(acc["sum"], term)
            low = F.least(acc["sum"], term)
            return F.struct(term.alias("term"), (top + F.log1p(F.exp(low - top))).alias("sum"))

        return let(grow(acc, j.cast("double")), both)

    steps = F.when(k >= 1, F.sequence(F.lit(1), k)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, F.struct(first.alias("term"), first.alias("sum")), step, lambda acc: acc["sum"])


def log_levels(delta: float) -> list[float]:
    """ln of a test's level after 0, 1, ... failures, for a single stratum."""
    return [math.log(delta / 2 ** (j + 1) / math.comb(len(STEPS), j)) for j in range(len(RULES))]


def tightened(of: Column, n: Column, strata: Column, risk: float, delta: float) -> Column:
    """Grid places of the cutoffs certified by all steps; a grid's length is no cutoff.

    of holds structs (beyond, n): for each rule how many cutoffs of its grid the
    score is beyond, and how many documents are alike in that. n is their sum.
    """
    levels = F.array(*[F.lit(x) for x in log_levels(delta)])

    def step(acc: Column, at: Column) -> Column:
        places = F.transform(acc["places"], lambda p, i: F.when(i == at["rule"], at["place"]).otherwise(p))

        def tried(places: Column) -> Column:
            out = lambda e: F.exists(F.zip_with(e["beyond"], places, lambda b, p: b > p), lambda x: x)
            k = F.aggregate(of, F.lit(0).cast("long"), lambda sum_, e: sum_ + F.when(out(e), e["n"]).otherwise(0))

            def verdict(k: Column) -> Column:
                # beyond the mean the probability exceeds any bound in use, so it is not summed
                bound = F.get(levels, acc["failed"]) - F.log(strata)
                passed = F.when(k <= n * risk, log_binomial_cdf(k, n, risk) <= bound).otherwise(F.lit(False))
                stopped = F.transform(acc["stopped"], lambda x, i: x | ((i == at["rule"]) & ~passed))
                return F.struct(
                    F.when(passed, places).otherwise(acc["places"]).alias("places"),
                    stopped.alias("stopped"),
                    (acc["failed"] + F.when(passed, 0).otherwise(1)).alias("failed"),
                )

            return let(k, verdict)

        return F.when(F.get(acc["stopped"], at["rule"]), acc).otherwise(let(places, tried))

    start = F.struct(
        F.array(*[F.lit(len(grid)) for _, grid in RULES.values()]).alias("places"),
        F.array(*[F.lit(False) for _ in RULES]).alias("stopped"),
        F.lit(0).alias("failed"),
    )
    steps = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(p).alias("place")) for r, p in STEPS])
    return F.aggregate(steps, start, step, lambda acc: acc["places"])


def calibrate(good: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """(stratum, cuts): a map from rule to its certified cutoff, for every stratum with labels enough.

    good has the counts and the stratum of every labelled good document. Only
    a histogram over the grids is shuffled. Without labels there are no
    strata, and nothing will be rejected.
    """
    # grid cutoffs below the score: it is beyond just these
    beyond = [F.expr("+".join(f"int({score} > {c}D)" for c in grid)) for score, grid in RULES.values()]
    histogram = good.select("stratum", F.array(*beyond).alias("beyond")).groupBy("stratum", "beyond").agg(F.count("*").alias("n"))
    dense = histogram.groupBy("stratum").agg(F.sum("n").alias("n"), F.collect_list(F.struct("beyond", "n")).alias("of"))
    # fewer cannot pass even if no other stratum counts and none is beyond; sizes say nothing of the scores
    dense = materialize(dense.where(F.col("n") >= log_levels(delta)[0] / math.log1p(-risk)), "histograms")
    strata = dense.agg(F.count("*").alias("strata"))
    found = dense.join(F.broadcast(strata))  # one row
    places = found.select("stratum", tightened(F.col("of"), F.col("n"), F.col("strata"), risk, delta).alias("places"))
    cuts = [
        F.struct(F.lit(rule).alias("rule"), F.get(F.array(*[F.lit(c) for c in grid]), F.get("places", F.lit(r))).alias("cut"))
        for r, (rule, (_, grid)) in enumerate(RULES.items())
    ]
    return places.select("stratum", F.map_from_entries(F.filter(F.array(*cuts), lambda x: x["cut"].isNotNull())).alias("cuts"))


def stratum(col: str) -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit("")).alias("stratum")


def labelled_good(labels: DataFrame) -> DataFrame:
    """Ids whose labels all say quality 1; rows without id or quality say nothing."""
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL")
    return known.groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1").select("doc_id")


def judge(counted: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """counted with kept: false if a base rule or a certified cutoff rejects it."""
    cutoffs = materialize(cutoffs, "cutoffs")
    small = cutoffs.count() <= BROADCAST_STRATA
    joined = counted.join(F.broadcast(cutoffs) if small else cutoffs, "stratum", "left")
    beyond = " OR ".join(f"coalesce({score} > cuts['{rule}'], false)" for rule, (score, _) in RULES.items())
    return joined.withColumn("kept", ~base_failed() & ~F.expr(beyond)).drop("cuts")


def cutoffs_from(docs: DataFrame, labels: DataFrame, *keep: Column) -> tuple[DataFrame, DataFrame]:
    """The counts of every document, with keep (materialized), and the certified cutoffs."""
    counted = materialize(counts(docs, "text", [*keep, F.col("doc_id"), stratum("lang")]), "counts")
    return counted, calibrate(counted.join(labelled_good(labels), "doc_id", "left_semi"))


def filter_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are kept, with their columns as they were.

    Labels may name any documents, none, or some twice. Rows with null text,
    fewer than ten words or many repeats go; the rest go only by a certified
    cutoff. Repeated rows are judged alike. No rows in, no rows out.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    counted, cutoffs = cutoffs_from(docs, labels, whole)
    return judge(counted, cutoffs).where("kept").select("_row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: counts and verdict of every document."""
    counted, cutoffs = cutoffs_from(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judge(counted, cutoffs).select(
        "doc_id",
        "n_words",
        F.col("n_chars_in_words").alias("word_chars"),
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base_failed().alias("base_failed"),
        "kept",
    )
