"""Line dedup: maximal repeated runs of lines, from a suffix array over line-ID sequences.

The lines with a word of all documents form one sequence, with a gap after
each document. Prefix doubling ranks its suffixes by their first 1, 2, 4, ...
lines: the ranks of two places, one length apart, become the rank at twice the
length. A suffix whose prefix is unique leaves the race, and doubling ends when
no prefix is shared. Suffixes of one rank are an interval of the suffix array
with at least that longest common prefix (LCP).

From the longest length to the shortest, intervals are then descended: what
shares n lines with an earlier place is split by the rank of the lines that
follow. A suffix goes on in the narrower interval if that has an earlier
member, and stays otherwise. So each suffix ends with the longest run that
begins there and occurs earlier. Runs within the run of the place before are
part of it; the others are maximal to both sides. Those of MIN_WORDS words are
later copies, and their lines are deleted.

All of this is DataFrame functions: no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm.common import WORD, discard, free_name, hot_join, materialize, numbered, running_sum, table
from emberlog.llm.mixing import word_count
from emberlog.llm.quality import let

MIN_WORDS = 20


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _has_word(line: Column) -> Column:
    return F.rlike(line, F.lit(WORD))


def _hashes(text: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes; texts or lines equal in both are taken as equal."""
    return F.xxhash64(text), F.xxhash64(F.lit(1), text)


def _ranked(named: DataFrame, by: list[str]) -> DataFrame:
    """named, a row for n suffixes alike in by, with their rank: where their interval of the suffix array begins.

    Unlike values follow one another in an order of their hash, piece by piece.
    """
    named = named.withColumn("order", F.xxhash64(*by)).withColumn("piece", F.shiftrightunsigned("order", 48))
    return materialize(running_sum(named, [], ["order", *by], {"rank": F.col("n")}, "piece").select(*by, "n", "rank"), "names")


def suffixes(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The suffixes that begin with a line that occurs elsewhere, and the later copies of whole texts.

    (g, r, w, k, t1, t2, i): place g in the sequence of all documents, rank by
    the first line, its words, and where it stands: document k = id, t1 and
    t2 = hashes of its text, i-th of its lines with a word. Documents follow
    one another by id, null last. Of equal texts only the first is in the
    sequence; the others, (k, t1, t2), are copies as a whole.
    """
    each = lambda line: F.struct(
        *[h.alias(f"h{j}") for j, h in enumerate(_hashes(line), 1)], word_count(line).cast("int").alias("w")
    )
    text = F.col(text_col)
    lines = docs.where(text.isNotNull()).select(
        F.col(id_col).alias("k"),
        *[h.alias(f"t{j}") for j, h in enumerate(_hashes(text), 1)],
        F.posexplode(F.transform(F.filter(_lines(text), _has_word), each)).alias("i", "line"),
    )
    lines = materialize(lines.select("k", "t1", "t2", "i", "line.*"), "lines")
    firsts = lines.groupBy("t1", "t2").agg(F.min("k").alias("least"), (F.max("i") + 1).alias("lines"))
    order = [F.col("least").isNull(), F.col("least"), F.col("t1"), F.col("t2")]
    texts = numbered(firsts, order, {"base": F.col("lines") + 1})
    firsts = texts.select("least", "base", F.col("t1").alias("f1"), F.col("t2").alias("f2"))
    of_first = (F.col("t1") == F.col("f1")) & (F.col("t2") == F.col("f2")) & F.col("k").eqNullSafe(F.col("least"))
    copies = materialize(lines.where("i = 0").join(firsts, of_first, "left_anti").select("k", "t1", "t2").distinct(), "copies")
    # a line counts as repeated only beyond the copies of its text
    place = F.xxhash64("t1", "t2", "i")
    named = lines.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(place).alias("low"), F.max(place).alias("high"))
    named = _ranked(named.where("low <> high").select("h1", "h2", "n"), ["h1", "h2"])
    shared = hot_join(lines, named, ["h1", "h2"], lines.count()).join(firsts, of_first)
    shared = shared.select((F.col("base") + F.col("i")).alias("g"), F.col("rank").alias("r"), "w", "k", "t1", "t2", "i")
    shared = materialize(shared.dropDuplicates(["g"]), "suffixes")
    discard(lines, texts, named)
    return shared, copies


def doubled(first: DataFrame) -> list[DataFrame]:
    """(g, r, w) for prefixes of 1, 2, 4, ... lines: suffixes whose prefix is shared, its rank and its words.

    A prefix cannot reach beyond its document, as the gap behind has no rank.
    """
    levels, total = [first.select("g", "r", "w")], first.count()
    while True:
        half = levels[-1]
        step = 1 << (len(levels) - 1)
        ahead = half.select((F.col("g") - step).alias("g"), F.col("r").alias("ahead"), F.col("w").alias("more"))
        pairs = materialize(half.join(ahead, "g").select("g", "r", "ahead", (F.col("w") + F.col("more")).alias("w")), "pairs")
        named = _ranked(pairs.groupBy("r", "ahead").agg(F.count("*").alias("n")).where("n > 1"), ["r", "ahead"])
        last = named.isEmpty()
        if not last:
            level = hot_join(pairs, named, ["r", "ahead"], total).select("g", F.col("rank").alias("r"), "w")
            levels.append(materialize(level, "ranks"))
        discard(pairs, named)
        if last:
            return levels


def longest_earlier(levels: list[DataFrame]) -> DataFrame:
    """(g, length, words) of every suffix: its longest prefix that also begins at a smaller g.

    A row (n, c, g) is a member of the interval of the suffixes that begin as
    c does, with n lines. The first of a narrower interval stays in the wider
    one too, where it stands for the others: whatever they share with a row
    there in fewer lines, it shares. own marks the one row of each suffix that
    looks for its length.
    """
    tops = None
    for j, level in enumerate(levels):
        top = level.select("g", F.lit(j).alias("top"))
        tops = top if tops is None else tops.union(top)
    tops = materialize(tops.groupBy("g").agg(F.max("top").alias("top")), "tops")
    state, total = None, 2 * tops.count()  # rows of a state at most: of each suffix, and of the first of each interval
    for j in range(len(levels) - 1, -1, -1):
        # suffixes that share no 2 << j lines with any other come in here
        new = tops.where(F.col("top") == j).select(
            "g", F.lit(0).alias("n"), F.lit(-1).cast("long").alias("c"), F.lit(0).cast("long").alias("words"), F.lit(True).alias("own")
        )
        members = new if state is None else state.unionByName(new)
        follow = levels[j].select(F.col("g").alias("at"), F.col("r").alias("next"), F.col("w").alias("more"))
        seen = materialize(members.join(follow, members["g"] + members["n"] == follow["at"], "left").drop("at"), "seen")
        groups = seen.where("next IS NOT NULL").groupBy("n", "c", "next").agg(F.min("g").alias("first"), F.count("*").alias("size"))
        groups = materialize(groups.where("size > 1"), "groups")
        # what has no rank, which is below no number, has no group
        placed = hot_join(seen.withColumn("next", F.coalesce(F.col("next"), -1 - F.col("g"))), groups, ["n", "c", "next"], total, "left", "size")
        stays = F.col("first").isNull() | (F.col("first") == F.col("g"))
        here = F.struct("g", "n", "c", "words", "own")
        deeper = F.struct(
            "g",
            (F.col("n") + (1 << j)).alias("n"),
            F.col("first").alias("c"),
            (F.col("words") + F.col("more")).alias("words"),
            (F.col("own") & ~stays).alias("own"),
        )
        rows = F.array_compact(F.array(F.when(stays, here), F.when(F.col("first").isNotNull(), deeper)))
        done = [seen, groups] if state is None else [seen, groups, state]
        state = materialize(placed.select(F.explode(rows).alias("row")).select("row.*"), "state")
        discard(*done)
    discard(tops)
    return state.where("own AND n > 0").select("g", F.col("n").alias("length"), "words")


def copied_runs(docs: DataFrame, id_col: str, text_col: str, min_words: int = MIN_WORDS) -> tuple[DataFrame, DataFrame]:
    """(k, t1, t2, start, length): maximal runs of lines that occur earlier; and the copies of whole texts (k, t1, t2).

    Documents are known by k = id and t1, t2 = hashes of the text. Lines
    without words are passed over; start and length count the others. Earlier:
    smaller id (null last), then smaller place in the document. Rows equal in
    id and text are one document.
    """
    shared, copies = suffixes(docs, id_col, text_col)
    levels = doubled(shared)
    runs = longest_earlier(levels).where(F.col("words") >= min_words)
    longer = runs.select((F.col("g") + 1).alias("g"), (F.col("length") - 1).alias("length"))
    maximal = runs.join(longer, ["g", "length"], "left_anti")
    found = maximal.join(shared.drop("w", "r"), "g").select("k", "t1", "t2", F.col("i").alias("start"), "length")
    found = materialize(found, "runs")
    discard(shared, *levels[1:])
    return found, copies


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """docs with later copies of line runs deleted from the text, and two more columns, n_lines and n_removed.

    n_lines counts all lines of the text before. Lines without words stay. A
    null text stays null, with 0 lines; a text of which nothing but copies was
    there becomes empty or blank. Rows equal in id and text change alike.
    All other columns stay as they are, whatever their names; where docs has
    an n_lines or n_removed of its own, the new one is called _n_lines or
    _n_removed. Empty table: no rows.
    """
    runs, copies = copied_runs(docs, id_col, text_col, min_words)
    none = F.lit(None).cast("array<struct<start:int,length:int>>")
    gone = runs.groupBy("k", "t1", "t2").agg(F.collect_list(F.struct("start", "length")).alias("runs"))
    gone = gone.withColumn("whole", F.lit(False)).unionByName(copies.withColumn("runs", none).withColumn("whole", F.lit(True)))
    text = F.col(f"_doc.`{text_col}`")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"))
    h1, h2 = _hashes(text)
    on = F.col(f"_doc.`{id_col}`").eqNullSafe(F.col("k")) & (h1 == F.col("t1")) & (h2 == F.col("t2"))
    joined = packed.join(gone.hint("merge"), on, "left")  # gone grows with docs, so it is never broadcast
    lines = _lines(text)

    def without(lines: Column) -> Column:
        # places of lines with words, and the lines of the copies among them
        every = F.sequence(F.lit(0), F.size(lines) - 1)
        wordy = F.filter(every, lambda i: _has_word(F.get(lines, i)))

        def kept(wordy: Column) -> Column:
            spans = F.transform("runs", lambda r: F.slice(wordy, r["start"] + 1, r["length"]))
            left = F.array_except(every, F.flatten(spans))
            return F.transform(left, lambda i: F.get(lines, i))

        return let(wordy, kept)

    blank = F.filter(lines, lambda x: ~_has_word(x))
    kept = F.when(F.col("whole") & (word_count(text) >= min_words), blank).when(F.col("runs").isNotNull(), let(lines, without))
    joined = joined.withColumn("_kept", kept)
    n = F.when(text.isNull(), 0).otherwise(F.size(lines)).cast("long")
    fields = [
        F.coalesce(F.array_join("_kept", "\n"), text).alias(c) if c == text_col else F.col(f"_doc.`{c}`").alias(c) for c in docs.columns
    ]
    removed = F.when(F.col("_kept").isNull(), 0).otherwise(n - F.size("_kept")).cast("long")
    return joined.select(*fields, n.alias(free_name(docs, "n_lines")), removed.alias(free_name(docs, "n_removed")))


def drop_copied_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """docs, with its columns, without later copies of line runs; texts of which no word is left go, others without words stay."""
    kept = dedup_lines(docs, id_col, text_col, min_words)
    removed = F.col(kept.columns[-1])
    return kept.where((removed == 0) | F.rlike(text_col, F.lit(WORD))).select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: every document's text without later copies of its runs."""
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: Written from the definition: all pairs of equal lines are followed as long as they stay equal.
SQL = f"""
WITH RECURSIVE l AS (
  SELECT doc_id, p, t, len(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+')) AS w,
         row_number() OVER (ORDER BY doc_id, p) + dense_rank() OVER (ORDER BY doc_id) AS g
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS p
        FROM documents WHERE text IS NOT NULL)
  WHERE regexp_matches(t, '[^\\x20\\x09-\\x0D]')
), same(a, b, n) AS (
  SELECT x.g, y.g, 1 FROM l x JOIN l y ON x.t = y.t AND y.g < x.g
  UNION ALL
  SELECT a, b, n + 1 FROM same JOIN l x ON x.g = a + n JOIN l y ON y.g = b + n AND y.t = x.t
), longest AS (
  SELECT a, max(n) AS n FROM same GROUP BY a
), copies AS (
  SELECT a, n FROM longest JOIN l ON g >= a AND g < a + n GROUP BY a, n HAVING sum(w) >= {MIN_WORDS}
), gone AS (
  SELECT DISTINCT unnest(range(a, a + n)) AS g FROM copies
), kept AS (
  SELECT x.doc_id, string_agg(x.t, chr(10) ORDER BY x.p) AS text, count(*) AS n
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS p FROM documents) x
  LEFT JOIN l ON x.doc_id = l.doc_id AND x.p = l.p
  WHERE l.g IS NULL OR l.g NOT IN (SELECT g FROM gone)
  GROUP BY x.doc_id
)
SELECT o.doc_id, CASE WHEN o.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text,
       coalesce(len(string_split(o.text, chr(10))), 0)::BIGINT AS n_lines,
       (coalesce(len(string_split(o.text, chr(10))), 0) - coalesce(kept.n, 0))::BIGINT AS n_removed
FROM documents o LEFT JOIN kept USING (doc_id)
"""
