"""Spelling variants by anagram hashing (Reynaert, 2004).

A word's key is the sum of its letters' fifth powers, so that words of the same
letters share it, and one letter more, less or exchanged moves it by that
letter's power, or by the difference of two. Words are joined on keys: a key
less the power of one of the word's letters meets the keys of words without
that letter (additions and removals) and other such keys (exchanges). Only where
keys meet is the order of letters verified: what is left of a word without the
letter at a place must equal the other word, or what is left of it without the
letter at the same place. The verification is an equi-join within the key, so
that anagrams that are not near make no pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm.common import discard, materialize, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTERS = "a-zÀ-ÿ"
#: Power of a letter's code point in keys, which count modulo 2**64.
POWER = 5
#: What is left of a word is compared by its SHA-256 if it is longer than this.
LONG = 256
KEYED = "word string, n bigint, key bigint, letter string"


def slips(docs: DataFrame, run: Column, rate: int) -> Column:
    """The run less one letter where rate divides the crc32 of <doc_id>:<run>; a null doc_id is written as nothing."""
    hashed = F.crc32(F.encode(F.concat(F.coalesce(docs["doc_id"].cast("string"), F.lit("")), F.lit(":"), run), "UTF-8"))
    at = F.pmod(hashed, F.length(run)).cast("int")
    return F.when(hashed % rate == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def vocabulary(docs: DataFrame, shortest: int, least: int, rate: int) -> DataFrame:
    """(word, n): words of shortest letters at least that occur least times or more, counted over whole texts."""
    lowered = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    # a longer run than the pattern asks for is taken whole; shorter ones cannot give a word
    runs = F.explode(F.regexp_extract_all(lowered, F.lit(f"[{LETTERS}]{{{shortest},}}"), F.lit(0))).alias("run")
    words = docs.select("doc_id", runs)
    words = words.select(slips(words, F.col("run"), rate).alias("word")).where(F.length("word") >= shortest)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each word with its key and no letter, and one for each of its letters, with the key less the letter's power."""
    for batch in batches:
        words = batch.column(0).to_pylist()
        if not words:
            continue
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
        size = np.array([len(w) for w in words])
        key = np.add.reduceat(points**POWER, np.cumsum(size) - size)
        own = np.unique(np.repeat(np.arange(len(words), dtype=np.uint64), size) << np.uint64(32) | points)
        word, letter = (own >> np.uint64(32)).astype(np.int64), own & np.uint64(0xFFFFFFFF)
        less = key[word] - letter**POWER
        rows = np.r_[np.arange(len(words)), word]
        letters = pa.array([None] * len(words) + [chr(c) for c in letter.tolist()], pa.string())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(rows)), batch.column(1).take(pa.array(rows)), pa.array(np.r_[key, less].view(np.int64)), letters],
            ["word", "n", "key", "letter"],
        )


def _best(n: str, word: str) -> Column:
    """For least(): the word of largest n, ties to the smallest word."""
    return F.struct((-F.col(n)).alias("minus"), F.col(word).alias("word"))


def near_words(words: DataFrame) -> DataFrame:
    """For each word of words (word, n) that has near ones: their number, and the best of them (form, form_n).

    Near are words that differ by one letter added, removed or exchanged. The
    best has the largest n, then the smallest word. Words must be distinct.
    """
    keyed = materialize(words.mapInArrow(_keys, KEYED), "keyed")
    removed = F.col("letter").isNotNull()
    # keys that meet: of a word and a word less a letter, or of two words less a letter
    met = keyed.groupBy("key").agg(F.count(F.when(removed, 1)).alias("less"), F.count(F.when(~removed, 1)).alias("whole"))
    met = met.where("less > 1 OR (less > 0 AND whole > 0)").select("key")
    place = F.when(removed, F.filter(F.sequence(F.lit(1), F.length("word")), lambda i: F.substring("word", i, F.lit(1)) == F.col("letter"))).otherwise(F.array(F.lit(0)))
    rest = F.concat(F.substring("word", F.lit(1), F.col("place") - 1), F.substring("word", F.col("place") + 1, F.length("word")))
    rest = F.when(removed, rest).otherwise(F.col("word"))
    rest = F.when(F.length(rest) > LONG, F.sha2(rest, 256)).otherwise(rest)
    first = (F.col("place") < 2) | (F.substring("word", F.col("place") - 1, F.lit(1)) != F.substring("word", F.col("place"), F.lit(1)))
    rows = keyed.join(met, "key", "left_semi").withColumn("place", F.explode(place)).withColumn("first", first)
    rows = materialize(rows.select("key", rest.alias("rest"), "place", "first", "word", "n"), "rests")

    # additions and removals: of equal letters side by side, only the first is taken out
    longer = rows.where("place > 0 AND first").select("key", "rest", F.col("word").alias("long"), F.col("n").alias("long_n"))
    pairs = rows.where("place = 0").select("key", "rest", "word", "n").join(longer, ["key", "rest"])
    added = pairs.select(F.explode(F.array(
        F.struct("word", F.lit(1).cast("long").alias("near"), _best("long_n", "long").alias("best")),
        F.struct(F.col("long").alias("word"), F.lit(1).cast("long").alias("near"), _best("n", "word").alias("best")),
    )).alias("x")).select("x.*")
    # exchanges: words alike but for the letter at a place, as many as there are letters at most
    slots = rows.where("place > 0").groupBy("key", "rest", "place").agg(F.sort_array(F.collect_list(_best("n", "word"))).alias("all")).where(F.size("all") > 1)
    other = F.transform(F.col("all"), lambda x, i: F.struct(x["word"].alias("word"), (F.size("all") - 1).cast("long").alias("near"), F.when(i == 0, F.col("all")[1]).otherwise(F.col("all")[0]).alias("best")))
    exchanged = slots.select(F.explode(other).alias("x")).select("x.*")
    both = added.unionByName(exchanged).groupBy("word").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))
    found = materialize(both.select("word", "n_near", F.col("best.word").alias("form"), (-F.col("best.minus")).alias("form_n")), "near")
    discard(keyed, rows)
    return found


def roots(forms: DataFrame, rounds: int = 64) -> DataFrame:
    """(word, root) from (word, form): forms followed to the last, each round twice as far. Forms must not go round in a circle."""
    up = materialize(forms.select("word", F.coalesce("form", "word").alias("root")), "roots")
    for _ in range(rounds):
        step = up.select(F.col("word").alias("root"), F.col("root").alias("next"))
        nxt = materialize(up.join(step, "root").select("word", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")), "roots")
        discard(up)
        up = nxt
        if not up.where("moved").limit(1).count():
            return up.select("word", "root")
    raise RuntimeError(f"no end after {rounds} rounds")


def variants(docs: DataFrame, shortest: int = 6, least: int = 5, times: int = 5, rate: int = 199) -> DataFrame:
    """word, form, root, n, n_near, form_n of the words of docs (doc_id, text).

    A word's form is its near word of largest n, ties to the smallest, if that n
    is at least times the word's; as it grows so along forms, they end. Null
    and empty texts have no words; repeated rows count again; a null doc_id is
    written as nothing where runs are hashed. Texts and words may be of any
    length. Further columns of docs are not read. Empty table: no rows.
    """
    words = materialize(vocabulary(docs, shortest, least, rate), "words")
    near = near_words(words)
    held = F.col("form_n") >= F.col("n") * times
    known = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(held, F.col("form")).alias("form"), F.when(held, F.col("form_n")).alias("form_n"))
    known = materialize(known, "known")
    root = roots(known)
    out = materialize(known.join(root, "word").select("word", "form", "root", "n", "n_near", "form_n"), "variants")
    discard(words, near, known)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: spelling variants of all documents; null and empty texts, ties, repeated rows and an empty table as in variants."""
    return variants(table(spark, sf_dir, "documents"))
