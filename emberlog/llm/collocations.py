"""Phrase collocations by level-wise passes (Apriori; Agrawal and Srikant, 1994).

A phrase of k words can be frequent only if both its phrases of k - 1 words
are. Each pass reads all texts, and emits a phrase of k words only where both
are found among the frequent ones of the level before. These are broadcast as a
bit table over hashes of phrases, of MOST_BITS bits at most, whatever their
number: a chance hit lets a phrase through that its own count then puts out, so
the levels are exact at any size, and a fuller table only prunes less. Phrases
are counted within a chunk of text by exact codes of their words, then by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberlog.llm.common import discard, hot_join, materialize, table

#: Bytes that end a piece, and those between its words.
ENDS, GAPS = b".,;:!?\n\x0b\x0c\r", b" \t"
FOLD = bytes(ord("\n") if c in ENDS else ord(" ") if c in GAPS else c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Bits for each frequent phrase in the broadcast table, and in all.
BITS_EACH, LEAST_BITS, MOST_BITS = 16, 1 << 15, 1 << 28
#: Bits of a row of Spark's bitmap functions.
ROW_BITS = 32768
#: Bytes of text handled at once. A longer text is cut where a piece, or else a word, ends.
CHUNK = 1 << 23
#: Pieces of a lang whose first phrases are found apart.
PARTS = 64
LEVEL = "lang string, phrase binary, f bigint"
MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * MIX
    return h ^ (h >> np.uint64(29))


def gram_hashes(lang: str, words: list[np.ndarray]) -> np.ndarray:
    """64-bit hashes of phrases, given the hashes of their first words, second words, and so on."""
    h = np.full(len(words[0]), xxhash.xxh64_intdigest(lang.encode()), np.uint64)
    for w in words:
        h = _mixed(h * MIX + w)
    return h


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


class Codes(dict):
    """Codes of a chunk's words in order of arrival. An end of a piece is 0, nothing is -1."""

    def __init__(self) -> None:
        super().__init__({b"\n": 0, b"": -1})
        self.words = [b"\n"]

    def __missing__(self, word: bytes) -> int:
        self[word] = code = len(self.words)
        self.words.append(word)
        return code


def _words_back(text: bytes, begin: int, end: int, n: int) -> int:
    """Where the last n words before end begin; begin, if there are not as many after it."""
    for _ in range(n):
        end = begin + len(text[begin:end].rstrip(b" "))
        end = text.rfind(b" ", begin, end) + 1 or begin
    return end


def _cuts(text: bytes, k: int, size: int) -> Iterator[bytes]:
    """A long folded text in parts of about size bytes, cut after a piece, else after a word.

    The k - 1 words before a cut within a piece come again, so that each phrase of k words lies whole in one part.
    """
    begin = 0
    while len(text) - begin > size:
        end = again = text.rfind(b"\n", begin, begin + size) + 1
        if end <= begin:
            end, again = begin + size, begin
            while again <= begin and end < len(text):  # until the part has k words
                stops = [x for x in (text.find(b" ", end + 1), text.find(b"\n", end + 1)) if x >= 0]
                end = min(stops, default=len(text))
                again = _words_back(text, begin, end, k - 1)
            if again <= begin:
                break
        yield text[begin:end]
        begin = again
    yield text[begin:]


def chunks(texts: list[bytes], k: int, size: int = CHUNK) -> Iterator[bytes]:
    """The folded texts, an end of a piece between them, in chunks of about size bytes."""
    part: list[bytes] = []
    total = 0
    for text in texts:
        for cut in _cuts(text.translate(FOLD), k, size):
            if part and total + len(cut) > size:
                yield b"\n".join(part)
                part, total = [], 0
            part.append(cut)
            total += len(cut)
    if part:
        yield b"\n".join(part)


def count_grams(lang: str, chunk: bytes, k: int, bits: np.ndarray | None) -> tuple[pa.Array, np.ndarray]:
    """The distinct phrases of k words of a folded chunk, and how often each occurs; those only whose parts have their bits set."""
    codes = Codes()
    at = chunk.replace(b"\n", b" \n ").split(b" ")
    code = np.fromiter(map(codes.__getitem__, at), np.int64, len(at))
    del at
    code = code[code >= 0]
    names = pa.array(codes.words, pa.binary())
    if k == 1:
        n = np.bincount(code, minlength=len(names))[1:]
        return names[1:], n
    starts = len(code) - k + 1
    if starts < 1:
        return names[:0], np.zeros(0, np.int64)
    hashed = word_hashes(codes.words)[code]
    shorter = gram_hashes(lang, [hashed[i : len(code) - k + 2 + i] for i in range(k - 1)])
    place = (shorter & np.uint64(8 * len(bits) - 1)).astype(np.int64)
    found = (bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
    good = found[:-1] & found[1:]
    for i in range(k):
        good &= code[i : starts + i] > 0
    begin = np.flatnonzero(good)
    _, same = np.unique(code[begin], return_inverse=True)
    for i in range(1, k):
        _, first, same, n = np.unique(same * len(names) + code[begin + i], return_index=True, return_inverse=True, return_counts=True)
    phrases = pc.binary_join_element_wise(*[names.take(pa.array(code[begin[first] + i])) for i in range(k)], b" ")
    return phrases, n


def _level_rows(batches: Iterator[pa.RecordBatch], k: int, bits: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Phrases of k words and their counts by chunk; for k = 1 also the number of words, as a null phrase."""
    for batch in batches:
        by_lang: dict[str, list[bytes]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
            by_lang.setdefault(lang, []).append(text.as_py())
        for lang, texts in by_lang.items():
            for chunk in chunks(texts, k):
                phrases, n = count_grams(lang, chunk, k, bits)
                if k == 1:
                    phrases, n = pa.concat_arrays([phrases, pa.nulls(1, pa.binary())]), np.append(n, n.sum())
                if len(n):
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n)), phrases.cast(pa.binary()), pa.array(n, pa.int64())], ["lang", "phrase", "f"])


def _places(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """The bit of each phrase of a level."""
    for batch in batches:
        langs = batch.column(0).to_pylist()
        words = [p.split(b" ") for p in batch.column(1).to_pylist()]
        places = np.zeros(len(langs), np.int64)
        for lang in set(langs):
            own = [i for i, x in enumerate(langs) if x == lang]
            columns = [word_hashes([words[i][j] for i in own]) for j in range(len(words[own[0]]))]
            places[own] = (gram_hashes(lang, columns) & np.uint64(bits - 1)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(places)], ["place"])


def bit_table(level: DataFrame) -> np.ndarray:
    """The bits of a level's phrases: BITS_EACH for each, rounded up to a power of two, MOST_BITS at most.

    The driver gets rows of bits that tasks have put together, 32 MB in all at most.
    """
    n_bits = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_EACH * level.count() - 1).bit_length()))
    places = level.select("lang", "phrase").mapInArrow(lambda rows: _places(rows, n_bits), "place bigint")
    bit = F.col("place") + 1  # the functions count from one
    rows = places.groupBy(F.bitmap_bucket_number(bit).alias("row")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits"))
    out = np.zeros(n_bits // 8, np.uint8)
    for r in rows.toLocalIterator():
        a = (r.row - 1) * ROW_BITS // 8
        out[a : a + ROW_BITS // 8] = np.frombuffer(bytes(r.bits), np.uint8)
    return out


def levels(docs: DataFrame, most: int, least: int) -> tuple[list[DataFrame], DataFrame]:
    """The frequent phrases of 1 to most words (lang, phrase, f), each level written, and the words of each lang (lang, n)."""
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    found: list[DataFrame] = []
    for k in range(1, most + 1):
        shared = docs.sparkSession.sparkContext.broadcast(bit_table(found[-1]) if k > 1 else None)
        rows = texts.mapInArrow(lambda batches, k=k, shared=shared: _level_rows(batches, k, shared.value), LEVEL)
        counted = rows.groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
        level = materialize(counted.where((F.col("f") >= least) | F.col("phrase").isNull()), f"level{k}")
        if k == 1:
            n_words = level.where("phrase IS NULL").select("lang", F.col("f").alias("n"))
        found.append(level.where("phrase IS NOT NULL"))
        found[-1]._written_to = level._written_to
        shared.unpersist()
    return found, n_words


def _part(words: Column, begin: Column | int, size: Column) -> Column:
    return F.array_join(F.slice(words, begin, size), " ")


def _counted(cuts: DataFrame, parts: DataFrame, part: str, out: str, total: int) -> DataFrame:
    """cuts with the count of the phrase in column part as out; parts shared by many cuts are broadcast, HOT at most."""
    sizes = cuts.groupBy("lang", part).agg(F.count("*").alias("size"))
    names = sizes.join(parts.select("lang", F.col("phrase").alias(part), F.col("f").alias(out)), ["lang", part])
    return hot_join(cuts, names, ["lang", part], total, size="size").drop("size")


def collocations(docs: DataFrame, most: int = 4, least: int = 30, covered: int = 80, top: int = 2000, factor: int = 2_000_000) -> DataFrame:
    """The top phrases of 2 to most words of each lang: lang, rank, phrase, a, l, r, n, score.

    A phrase of count a >= least scores floor(factor * a / (l + r)), with the
    counts l and r of the two parts of its lowest-scoring cut, the first such
    one. It goes if a longer phrase of count b holds it and 100 b >= covered a.
    Null lang is und, null text is empty; rows that are repeated count again;
    rows need no id, and further columns of docs are not read. Ties of score
    and a are ranked by phrase. No texts, or no frequent phrases: no rows.
    """
    found, n_words = levels(docs, most, least)
    as_text = [x.withColumn("phrase", F.col("phrase").cast("string")).withColumn("k", F.lit(k + 1)) for k, x in enumerate(found)]
    union = as_text[0]
    for level in as_text[1:]:
        union = union.unionByName(level)
    candidates = union.where("k > 1").withColumnRenamed("f", "a")

    words = F.split("phrase", " ")
    cuts = candidates.select("lang", "phrase", "a", "k", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.withColumns({"first": _part(words, 1, F.col("cut")), "rest": _part(words, F.col("cut") + 1, F.col("k") - F.col("cut"))}).drop("k")
    cuts = materialize(cuts, "cuts")
    total = cuts.count()
    cuts = _counted(_counted(cuts, union, "first", "l", total), union, "rest", "r", total)
    # decimals: the product may pass 64 bits
    score = F.expr(f"CAST(CAST({factor} AS DECIMAL(18,0)) * CAST(a AS DECIMAL(19,0)) div (l + r) AS BIGINT)")
    lowest = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("m"))

    inner = F.expr("flatten(transform(sequence(2, k - 1), s -> transform(sequence(1, k - s + 1), b -> array_join(slice(split(phrase, ' '), b, s), ' '))))")
    inside = candidates.where("k > 2").select("lang", F.explode(inner).alias("phrase"), F.col("a").alias("b"))
    longer = inside.groupBy("lang", "phrase").agg(F.max("b").alias("b"))
    kept = lowest.join(longer, ["lang", "phrase"], "left")
    kept = kept.where(f"b IS NULL OR CAST(b AS DECIMAL(19,0)) * 100 < CAST(a AS DECIMAL(19,0)) * {covered}")
    kept = kept.select("lang", "phrase", "a", "m.l", "m.r", "m.score", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)).alias("part"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    out = materialize(kept.join(n_words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"), "phrases")
    discard(*found)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: the first 2000 phrases of each lang of all documents; null and empty texts, ties and an empty table as in collocations."""
    return collocations(table(spark, sf_dir, "documents"))


SQL = """
WITH texts AS (
  SELECT coalesce(lang, 'und') AS lang,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents),
pieces AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM texts),
runs AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]'), lambda x: x <> '') AS w FROM pieces),
grams AS (
  SELECT lang, k, array_to_string(w[b:b + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS b
        FROM (SELECT lang, w, unnest([1, 2, 3, 4]) AS k FROM runs))),
counted AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 30),
total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM runs GROUP BY lang),
cand AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM counted WHERE k > 1),
cuts AS (SELECT *, unnest(range(1, k)) AS cut FROM cand),
scored AS (
  SELECT c.lang, c.phrase, c.a, c.cut, l.f AS l, r.f AS r,
         ((2000000::HUGEINT * c.a) // (l.f + r.f))::BIGINT AS score
  FROM cuts c
  JOIN counted l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:c.cut], ' ')
  JOIN counted r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[c.cut + 1:], ' ')),
lowest AS (
  SELECT * FROM scored
  QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inside AS (
  SELECT lang, array_to_string(w[b:b + s - 1], ' ') AS phrase, max(a) AS b_longer
  FROM (SELECT lang, w, a, s, unnest(range(1, k - s + 2)) AS b
        FROM (SELECT lang, w, a, k, unnest(range(2, k)) AS s FROM cand WHERE k > 2))
  GROUP BY ALL),
kept AS (
  SELECT x.* FROM lowest x LEFT JOIN inside i USING (lang, phrase)
  WHERE i.b_longer IS NULL OR 100::HUGEINT * i.b_longer < 80::HUGEINT * x.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN total USING (lang)
QUALIFY rank <= 2000
"""
