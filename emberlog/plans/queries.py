"""Queries for the driver: each operator over whole tables, and its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberlog.functions import labels, text
from emberlog.operators import engine, summary, trend
from emberlog.operators.pieces import analyze_pieces, cut
from emberlog.plans.logs import FINDINGS, LINES, RANKED, builds, host, normal, report, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
SHOWN = ("build_key", "failure_ord", "rule_ord", "category", "severity", "title", "recipe", "task", "file", "line", "confidence", "evidence", "signature", "cascade_of")


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def on_findings(select: str) -> str:
    return f"WITH {FINDINGS}\n{select}"


def on_lines(select: str) -> str:
    return f"WITH {LINES}\n{select}"


def found(spark: SparkSession, sf: str) -> DataFrame:
    """All findings, evidence as one text."""
    return report(spark, sf).findings


def flat(df: DataFrame) -> DataFrame:
    df = df.withColumn("line", F.col("line").cast("string"))
    return df.withColumn("evidence", F.array_join("evidence", "\n")).withColumns({c: F.col(c).cast("bigint") for c in ("failure_ord", "rule_ord")}).select(*SHOWN)


def failure_lines(spark: SparkSession, sf: str) -> DataFrame:
    """A row for each line of each failure."""
    f = engine.failures_of(builds(spark, sf)).select("build_key", F.col("failure_ord").cast("bigint").alias("failure_ord"), F.explode_outer(text.log_lines(F.col("log"))).alias("l")).where("l IS NOT NULL")
    return f.select("build_key", "failure_ord", F.col("l.n").cast("bigint").alias("n"), "l.level", F.col("l.text").alias("body"))


# ---- lines and text

_DOC_LINES = "SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS n, len(string_split(text, chr(10))) AS m FROM documents WHERE text IS NOT NULL"
_WHOLE = f"SELECT doc_id, n, regexp_replace(t, '\\r$', '') AS t FROM ({_DOC_LINES}) WHERE n < m OR t <> ''"


def doc_lines(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.posexplode_outer(text.log_texts(F.col("text"))).alias("i", "line")).where("i IS NOT NULL").select("doc_id", (F.col("i") + 1).cast("bigint").alias("n"), "line")


@query(f"SELECT doc_id, n, t AS line FROM ({_WHOLE})")
def line_explode(spark, sf):
    return doc_lines(spark, sf)


@query("SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN 0 ELSE len(text) - len(replace(text, chr(10), '')) + 1 END::BIGINT AS n_lines FROM documents")
def line_count(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.line_total(F.col("text")).alias("n_lines"))


@query(on_lines("SELECT build_key, failure_ord, n, level, body FROM lines"))
def level_split(spark, sf):
    return failure_lines(spark, sf)


@query(on_lines("SELECT coalesce(level, 'none') AS level, count(*) AS n FROM lines GROUP BY 1"))
def level_histogram(spark, sf):
    return failure_lines(spark, sf).groupBy(F.coalesce("level", F.lit("none")).alias("level")).agg(F.count("*").alias("n"))


@query(on_lines(f"SELECT build_key, failure_ord, n, {normal('body')} AS norm, {normal(normal('body'))} = {normal('body')} AS idempotent FROM lines"))
def normalize_text(spark, sf):
    norm = text.normalized(F.col("body"))
    return failure_lines(spark, sf).select("build_key", "failure_ord", "n", norm.alias("norm"), (text.normalized(norm) == norm).alias("idempotent"))


@query(on_lines(f"SELECT build_key, failure_ord, n, {host('body')} AS shown FROM lines"))
def redact_host(spark, sf):
    return failure_lines(spark, sf).select("build_key", "failure_ord", "n", text.redact_host(F.col("body")).alias("shown"))


_SECRET = "(?i)password|passwd|secret|token|api[_-]?key|private[_-]?key|credential"


@query(
    f"""SELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE coalesce(s, '') END AS shown FROM documents LEFT JOIN (
    SELECT doc_id, string_agg(CASE WHEN regexp_matches(t, '{_SECRET}') THEN '# [redacted secret]' ELSE t END, chr(10) ORDER BY n) AS s
    FROM ({_DOC_LINES}) WHERE n < m OR t <> '' GROUP BY doc_id) USING (doc_id)"""
)
def redact_secrets(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.redact_secrets(F.col("text")).alias("shown"))


@query(f"SELECT doc_id, n FROM ({_WHOLE}) WHERE regexp_matches(t, '{_SECRET}')")
def secret_lines(spark, sf):
    return doc_lines(spark, sf).where(text.is_secret(F.col("line"))).select("doc_id", "n")


@query("SELECT doc_id, ((len(text) + 3) // 4)::BIGINT AS tokens FROM documents")
def token_estimate(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.tokens(F.col("text")).alias("tokens"))


@query(
    on_lines(
        """SELECT DISTINCT build_key, failure_ord, kind, CASE WHEN kind = 'task' THEN task END AS task, coalesce(nullif(recipe, ''), package) AS recipe,
    regexp_extract('/in/' || u || '.json', '[^/]*$') AS source FROM lines"""
    )
)
def failure_fields(spark, sf):
    from emberlog.operators.rules import recipe, task

    b = builds(spark, sf)
    f = engine.failures_of(b).join(b.select("build_key", text.basename(F.col("source_path")).alias("source")), "build_key")
    return f.select("build_key", F.col("failure_ord").cast("bigint").alias("failure_ord"), "kind", task().alias("task"), recipe().alias("recipe"), "source")


@query(
    f"""WITH l AS ({_WHOLE}), c AS (SELECT *, {normal("t")} AS norm FROM l),
    m AS (SELECT *, CASE WHEN norm = lag(norm) OVER (PARTITION BY doc_id ORDER BY n) THEN 0 ELSE 1 END AS fresh FROM c),
    g AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY n) AS g FROM m)
    SELECT doc_id, min(n) AS n, arg_min(t, n) || CASE WHEN count(*) > 1 THEN ' (x' || count(*) || ')' ELSE '' END AS line FROM g GROUP BY doc_id, g"""
)
def collapse_repeats(spark, sf):
    """Of whole texts, by windows; findings collapse their few lines within the row."""
    w = Window.partitionBy("doc_id").orderBy("n")
    lines = doc_lines(spark, sf).withColumn("norm", text.normalized(F.col("line")))
    fresh = F.coalesce(F.col("norm") != F.lag("norm").over(w), F.lit(True)).cast("int")
    runs = lines.withColumn("fresh", fresh).withColumn("g", F.sum("fresh").over(w)).groupBy("doc_id", "g")
    runs = runs.agg(F.min("n").alias("n"), F.min_by("line", "n").alias("line"), F.count("*").alias("c"))
    more = F.when(F.col("c") > 1, F.concat(F.lit(" (x"), "c", F.lit(")"))).otherwise("")
    return runs.select("doc_id", "n", F.concat("line", more).alias("line"))


@query(on_lines("SELECT build_key, failure_ord, n FROM (SELECT *, bool_or(level IS NULL OR level NOT IN ('NOTE', 'DEBUG')) OVER (PARTITION BY build_key, failure_ord) AS s FROM lines) WHERE NOT s OR level IS NULL OR level NOT IN ('NOTE', 'DEBUG')"))
def noise_filter(spark, sf):
    from emberlog.operators.rules import quiet

    kept = engine.failures_of(builds(spark, sf)).select("build_key", F.col("failure_ord").cast("bigint").alias("failure_ord"), F.explode(quiet(text.log_lines(F.col("log")))).alias("l"))
    return kept.select("build_key", "failure_ord", F.col("l.n").cast("bigint").alias("n"))


@query(on_lines(r"SELECT build_key, failure_ord, n, last_value(nullif(regexp_extract(body, 'patching file (\S+)', 1), '') IGNORE NULLS) OVER (PARTITION BY build_key, failure_ord ORDER BY n) AS file FROM lines"))
def carry_forward_file(spark, sf):
    from emberlog.operators.rules import PATCH_FILE

    w = Window.partitionBy("build_key", "failure_ord").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    return failure_lines(spark, sf).select("build_key", "failure_ord", "n", F.last(text.captured(F.col("body"), PATCH_FILE), ignorenulls=True).over(w).alias("file"))


_FRAME_LOG = "CASE WHEN l_linenumber = 1 THEN 'Backtrace (BB generated script): ' WHEN l_quantity < 10 THEN 'noise' ELSE '  #' || l_linenumber || ': do_fn, /tmp/p' || l_partkey || '.sh, line ' || l_suppkey END"


@query(
    f"""WITH l AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n, {_FRAME_LOG} AS t FROM lineitem),
    h AS (SELECT l_orderkey, min(n) AS h FROM l WHERE starts_with(t, 'Backtrace') GROUP BY 1),
    s AS (SELECT l.l_orderkey, min(n) AS s FROM l JOIN h USING (l_orderkey) WHERE n > h AND NOT regexp_matches(t, '^\\s*#') GROUP BY 1)
    SELECT l_orderkey, regexp_extract(t, '#(\\d+)', 1)::INTEGER AS index, 'do_fn' AS func, regexp_extract(t, '(/tmp/[^,]+)', 1) AS path, regexp_extract(t, 'line (\\d+)', 1)::INTEGER AS line
    FROM l JOIN h USING (l_orderkey) LEFT JOIN s USING (l_orderkey) WHERE n > h AND (s IS NULL OR n < s)"""
)
def backtrace_frames(spark, sf):
    lines = table(spark, sf, "lineitem").selectExpr("l_orderkey", "struct(l_linenumber, l_partkey, l_suppkey) AS o", f"{_FRAME_LOG} AS t")
    logs = lines.groupBy("l_orderkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o", "t"))), lambda x: x["t"]), "\n").alias("log"))
    return logs.withColumn("lines", text.log_lines(F.col("log"))).select("l_orderkey", F.explode(text.backtrace(F.col("lines"))).alias("f")).select("l_orderkey", "f.*")


@query(
    on_lines(
        """SELECT build_key, failure_ord, arg_min(body, n) FILTER (WHERE level = 'ERROR') AS first_error,
    arg_max(body, n) FILTER (WHERE level = 'WARNING') AS last_warning FROM lines GROUP BY ALL"""
    )
)
def first_and_last_titles(spark, sf):
    of = lambda level: F.when(F.col("level") == level, F.col("n"))
    return failure_lines(spark, sf).groupBy("build_key", "failure_ord").agg(F.min_by("body", of("ERROR")).alias("first_error"), F.max_by("body", of("WARNING")).alias("last_warning"))


@query(on_findings("SELECT build_key, failure_ord, class, c AS n, first_n, body FROM qa_classes"))
def qa_class_counts(spark, sf):
    from emberlog.operators.rules import qa_class

    issues = failure_lines(spark, sf).where(F.col("body").contains("QA Issue:")).withColumn("class", qa_class(F.col("body")))
    return issues.groupBy("build_key", "failure_ord", "class").agg(F.count("*").alias("n"), F.min("n").alias("first_n"), F.min_by("body", "n").alias("body"))


# ---- findings


def _classify(category: str) -> None:
    def f(spark, sf):
        return flat(found(spark, sf).where(F.col("category") == category))

    f.__name__ = f"classify_{'fallback' if category == 'unknown' else category}"
    query(on_findings(f"SELECT {', '.join(SHOWN)} FROM findings WHERE category = '{category}'"))(f)


for _c in ("configure", "compile", "dependency", "fetch", "patch", "qa", "unknown"):
    _classify(_c)


@query(on_findings(f"SELECT {', '.join(SHOWN)} FROM findings"))
def findings_of_pieces(spark, sf):
    """All logs in pieces of 50 characters, which end within lines."""
    whole = builds(spark, sf)
    failures = engine.failures_of(whole)
    return flat(analyze_pieces(whole, failures, cut(failures, 50)).findings)


@query(on_findings("SELECT build_key, failure_ord, count(*) AS n_hits, string_agg(category, ',' ORDER BY rule_ord) AS categories FROM findings GROUP BY ALL"))
def multi_hit(spark, sf):
    hits = engine.with_hits(engine.failures_of(builds(spark, sf))).select("build_key", F.col("failure_ord").cast("bigint").alias("failure_ord"), F.transform("hits", lambda h: h["category"]).alias("c"))
    return hits.select("build_key", "failure_ord", F.size("c").cast("bigint").alias("n_hits"), F.array_join("c", ",").alias("categories"))


@query(on_findings("SELECT build_key, failure_ord, rule_ord, evidence FROM findings"))
def evidence_tail(spark, sf):
    return flat(found(spark, sf)).select("build_key", "failure_ord", "rule_ord", "evidence")


@query(
    on_findings(
        """, firsts AS (SELECT signature, recipe, min(build_key || printf('%05d', failure_ord) || rule_ord) AS p FROM findings GROUP BY ALL)
    SELECT g.signature, g.occurrences, r.affected_recipes FROM (SELECT signature, count(*) AS occurrences FROM findings GROUP BY 1) g
    LEFT JOIN (SELECT signature, string_agg(recipe, ',' ORDER BY p) AS affected_recipes FROM firsts GROUP BY 1) r USING (signature)"""
    )
)
def signature_groups(spark, sf):
    return report(spark, sf).groups.withColumn("affected_recipes", F.array_join("affected_recipes", ","))


@query(on_findings("SELECT build_key, failure_ord, rule_ord, signature FROM findings WHERE cascade_of IS NOT NULL"))
def cascade_mark(spark, sf):
    return flat(found(spark, sf)).where("cascade_of IS NOT NULL").select("build_key", "failure_ord", "rule_ord", "signature")


_PLACE = f"row_number() OVER (ORDER BY {RANKED})"


@query(on_findings(f"SELECT {_PLACE} AS rank, build_key, failure_ord, rule_ord, category, signature FROM findings"))
def rank_findings(spark, sf):
    r = engine.placed(found(spark, sf))
    return r.select("rank", "build_key", F.col("failure_ord").cast("bigint").alias("failure_ord"), F.col("rule_ord").cast("bigint").alias("rule_ord"), "category", "signature")


@query(on_findings(f"SELECT {', '.join(SHOWN)} FROM findings ORDER BY {RANKED} LIMIT 5"))
def top_k_findings(spark, sf):
    return flat(report(spark, sf).ranked().limit(summary.TOP_K))


@query(on_findings("SELECT threshold, (SELECT count(*) FROM findings WHERE severity_rank <= t) > 0 AS failed FROM (VALUES ('error', 0), ('failure', 1), ('warning', 2)) v(threshold, t)"))
def severity_gate(spark, sf):
    worst = found(spark, sf).agg(F.min(labels.severity_rank(F.col("severity"))).alias("w"))
    gates = worst.select("w", F.explode(F.create_map(*[F.lit(x) for k in ("error", "failure", "warning") for x in (k, labels.SEVERITY_RANK[k])])).alias("threshold", "t"))
    return gates.select("threshold", F.coalesce(F.col("w") <= F.col("t"), F.lit(False)).alias("failed"))


@query(on_findings("SELECT build_key, failure_ord, rule_ord, category FROM findings WHERE category IN ('qa', 'patch')"))
def category_filter(spark, sf):
    return flat(report(spark, sf).filtered(["qa", "patch"]).findings).select("build_key", "failure_ord", "rule_ord", "category")


@query(on_findings("SELECT build_key, failure_ord, rule_ord, recipe FROM findings WHERE recipe = 'recipe3'"))
def recipe_filter(spark, sf):
    return flat(report(spark, sf).filtered(recipe="recipe3").findings).select("build_key", "failure_ord", "rule_ord", "recipe")


@query(on_findings("SELECT build_key, failure_ord, rule_ord, signature, count(*) OVER (PARTITION BY signature) AS occurrences FROM findings"))
def occurrences_join(spark, sf):
    r = report(spark, sf)
    return engine.with_occurrences(r.findings, r.groups).select("build_key", *[F.col(c).cast("bigint").alias(c) for c in ("failure_ord", "rule_ord")], "signature", "occurrences")


@query(on_findings("SELECT category, count(*) AS n, count(*) FILTER (WHERE severity = 'error') AS errors, count(*) FILTER (WHERE severity = 'warning') AS warnings FROM findings GROUP BY 1"))
def category_summary(spark, sf):
    return found(spark, sf).groupBy("category").agg(F.count("*").alias("n"), F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))


@query(on_findings(f"SELECT category, row_number() OVER (ORDER BY p) AS place FROM (SELECT category, min(p) AS p FROM (SELECT category, {_PLACE} AS p FROM findings) GROUP BY 1)"))
def sarif_rules(spark, sf):
    from emberlog.sinks.documents import categories_in_order

    return categories_in_order(found(spark, sf)).select("category", F.col("place").cast("bigint").alias("place"))


_CAUSES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in labels.LIKELY_CAUSE.items())


@query(on_findings(f"SELECT build_key, failure_ord, rule_ord, CASE severity WHEN 'error' THEN 'error' WHEN 'failure' THEN 'error' WHEN 'warning' THEN 'warning' ELSE 'note' END AS level, CASE category {_CAUSES} END AS cause, file || coalesce(':' || nullif(line, '0'), '') AS place FROM findings"))
def sarif_levels(spark, sf):
    f = found(spark, sf)
    return f.select(
        "build_key", *[F.col(c).cast("bigint").alias(c) for c in ("failure_ord", "rule_ord")], labels.sarif_level(F.col("severity")).alias("level"),
        labels.likely_cause(F.col("category")).alias("cause"), text.location(F.col("file"), F.col("line")).alias("place"),
    )


@query(on_findings("SELECT greatest(0, (SELECT count(*) FROM lines) - (SELECT sum(len(string_split(evidence, chr(10)))) FROM findings))::BIGINT AS dropped, (SELECT count(*) FROM lines) AS log_lines"))
def log_lines_dropped(spark, sf):
    r = report(spark, sf)
    each = F.aggregate("failures", F.lit(0).cast("bigint"), lambda a, f: a + text.line_total(f["log"]))
    total = r.builds.agg(F.sum(each).alias("log_lines"))
    kept = r.findings.agg(F.sum(F.size("evidence")).alias("kept"))
    return total.join(F.broadcast(kept)).select(F.greatest(F.lit(0), F.col("log_lines") - F.col("kept")).alias("dropped"), "log_lines")  # one row each


@query(
    on_findings(
        f""", e AS (SELECT build_key, failure_ord, rule_ord, {host("title")} AS title, unnest(string_split(evidence, chr(10))) AS t, generate_subscripts(string_split(evidence, chr(10)), 1) AS i FROM findings),
    s AS (SELECT *, len(title) + sum(len({host("t")}) + 1) OVER (PARTITION BY build_key, failure_ord, rule_ord ORDER BY i DESC) AS size FROM e)
    SELECT build_key, failure_ord, rule_ord, coalesce(string_agg({host("t")}, chr(10) ORDER BY i) FILTER (WHERE (size + 3) // 4 <= 40), '') AS kept FROM s GROUP BY ALL"""
    )
)
def budget_fit(spark, sf):
    f = summary.shown(found(spark, sf), 0)
    kept = F.array_join(summary.fitted(F.col("title"), F.col("evidence"), 40), "\n")
    return f.select("build_key", *[F.col(c).cast("bigint").alias(c) for c in ("failure_ord", "rule_ord")], kept.alias("kept"))


_EVIDENCE = f"list_slice(list_transform(CASE WHEN evidence = '' THEN [] ELSE string_split(evidence, chr(10)) END, lambda x: {host('x')}), -8, -1)"
_SIZE = "((len(t) + coalesce(1 + len(array_to_string({0}, chr(10))) * CASE WHEN len({0}) > 0 THEN 1 ELSE NULL END, 0) + 3) // 4)"
_FITS = "list_filter(range(1, len(ev) + 1), lambda s: (len(t) + 1 + len(array_to_string(ev[s:], chr(10))) + 3) // 4 <= f.room)"


@query(
    f"""WITH RECURSIVE {FINDINGS},
    ranked AS (SELECT build_key, row_number() OVER (PARTITION BY build_key ORDER BY {RANKED}) AS place, {host("title")} AS t, {_EVIDENCE} AS ev FROM findings),
    fold AS (
      SELECT DISTINCT build_key, 0::BIGINT AS place, 60::BIGINT AS room, 0::BIGINT AS n_lines, '' AS shown FROM lines
      UNION ALL
      SELECT build_key, place, room - {_SIZE.format("kept")}, n_lines + len(kept), shown || t || chr(10) || array_to_string(kept, chr(10)) || chr(10)
      FROM (
        SELECT f.build_key, r.place, f.room, f.n_lines, f.shown, r.t,
          CASE WHEN len({_FITS}) > 0 THEN ev[list_min({_FITS}):] WHEN f.place = 0 AND len(ev) > 0 THEN ev[-1:] ELSE [] END AS kept
        FROM fold f JOIN ranked r ON r.build_key = f.build_key AND r.place = f.place + 1
        WHERE r.place <= 5 AND (f.place = 0 OR (f.room > 0 AND (len(r.t) + 3) // 4 <= f.room)))),
    last AS (SELECT build_key, max(place) AS n_shown, max(n_lines) AS n_lines, arg_max(shown, place) AS shown FROM fold GROUP BY 1)
    SELECT build_key, shown, (coalesce(n, 0) - n_shown)::BIGINT AS findings_omitted, greatest(0, n_log - n_lines)::BIGINT AS log_lines_dropped
    FROM last JOIN (SELECT build_key, count(*) AS n_log FROM lines GROUP BY 1) USING (build_key) LEFT JOIN (SELECT build_key, count(*) AS n FROM findings GROUP BY 1) USING (build_key)"""
)
def build_summaries(spark, sf):
    """Each build's first five findings within 60 tokens."""
    made = summary.summaries(report(spark, sf), budget=60)
    text = F.concat_ws("", F.transform("findings", lambda x: F.concat(x["title"], F.lit("\n"), F.array_join(x["evidence"], "\n"), F.lit("\n"))))
    return made.select("build_key", text.alias("shown"), F.col("findings_omitted").cast("bigint").alias("findings_omitted"), F.col("log_lines_dropped").cast("bigint").alias("log_lines_dropped"))


_OVER_VIEWS = """
    SELECT coalesce(f.recipe, '') AS recipe, f.category, count(*) AS n, count(DISTINCT f.build_key) AS n_builds, max(g.occurrences) AS most, max(l.n_errors) AS n_errors
    FROM findings f JOIN {groups} g ON f.signature = g.signature
    JOIN (SELECT build_key, count_if(level = 'ERROR') AS n_errors FROM {lines} GROUP BY build_key) l ON f.build_key = l.build_key
    GROUP BY 1, 2"""


@query(on_findings(_OVER_VIEWS.format(groups="(SELECT signature, count(*) AS occurrences FROM findings GROUP BY 1)", lines="lines").replace("max(l.n_errors)", "max(l.n_errors)::BIGINT")))
def sql_over_views(spark, sf):
    """The same SQL over the views of a report."""
    from emberlog import catalog

    names = catalog.register(report(spark, sf), prefix="of_report_")
    text = _OVER_VIEWS.format(groups="of_report_groups", lines="of_report_lines").replace("FROM findings", "FROM of_report_findings")
    assert "of_report_findings" in names
    return spark.sql(text)


@query(
    on_lines(
        """SELECT build_key, failure_ord, rule, title FROM (
      SELECT build_key, failure_ord, 0::BIGINT AS rule, arg_min(body, n) AS title FROM lines WHERE level = 'ERROR' GROUP BY 1, 2
      UNION ALL
      SELECT build_key, failure_ord, CASE WHEN bool_or(level = 'ERROR') THEN 1 ELSE 0 END::BIGINT, 'digits ' || sum(len(regexp_replace(text, '[^0-9]', '', 'g')))
      FROM lines GROUP BY 1, 2 HAVING sum(len(regexp_replace(text, '[^0-9]', '', 'g'))) % 3 = 0)"""
    )
)
def arrow_and_column_rules(spark, sf):
    """A Column rule and an Arrow rule, which counts the digits of a whole log, beside it."""
    import pyarrow as pa
    import pyarrow.compute as pc

    from emberlog.operators.rules import ArrowRule, Rule, hit, lines

    def digits(task, package, recipe, kind, log):
        n = pc.binary_length(pc.replace_substring_regex(log, "[^0-9]", "")).to_pylist()
        one = {"category": "custom", "severity": "error", "evidence": [], "confidence": 0.5}
        kinds = pa.struct([*[(c, pa.string()) for c in ("category", "severity", "title", "recipe", "task", "file")], ("line", pa.int32()), ("evidence", pa.list_(pa.string())), ("confidence", pa.float64())])
        return pa.array([one | {"title": f"digits {k}"} if k % 3 == 0 else None for k in n], kinds)

    errors = lambda: F.filter(lines(), lambda x: x["level"] == "ERROR")
    first_error = Rule("first", lambda: F.size(errors()) > 0, lambda: hit("custom", F.get(errors(), F.lit(0))["text"], 0.5, F.array().cast("array<string>")), order=1)
    found_ = engine.analyze(builds(spark, sf), [first_error, ArrowRule("digits", digits, order=2)]).findings
    return found_.select("build_key", *[F.col(c).cast("bigint").alias(n) for c, n in (("failure_ord", "failure_ord"), ("rule_ord", "rule"))], "title")


@query("SELECT DISTINCT '/in/' || user_id || '.json' AS path FROM events")
def distinct_paths(spark, sf):
    return builds(spark, sf).select(F.col("source_path").alias("path")).distinct()


@query(on_findings("SELECT category, title FROM findings UNION ALL SELECT 'unknown', 'Report ' || c_custkey || ' is not valid JSON' FROM customer"))
def union_findings(spark, sf):
    read = table(spark, sf, "customer").select(F.format_string("%09d", "c_custkey").alias("build_key"), F.concat(F.lit("Report "), "c_custkey", F.lit(" is not valid JSON")).alias("title"))
    hit = F.struct(F.lit("unknown").alias("category"), F.lit("error").alias("severity"), "title", F.array("title").alias("evidence"), F.lit(1.0).alias("confidence"))
    b = builds(spark, sf).select("build_key", "failures", "ingest_findings")
    broken = read.select("build_key", F.lit(None).cast(b.schema["failures"].dataType).alias("failures"), F.array(hit).alias("ingest_findings"))
    return engine.findings_of(b.unionByName(broken)).select("category", "title")


# ---- trends: a day of events is a run

_RUNS = "runs AS (SELECT dense_rank() OVER (ORDER BY cast(ts AS date)) - 1 AS run_ord, 'sha1:' || sha1(event_type || ':' || (user_id % 97)) AS signature, event_id AS place, event_type AS category, 'run' || strftime(ts, '%d') AS run_id FROM events)"
BASE = 2


def rows(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    days = e.select(F.to_date("ts").alias("day")).distinct()  # a row for each run
    days = days.withColumn("run_ord", (F.row_number().over(Window.orderBy("day")) - 1).cast("bigint"))
    e = e.withColumn("day", F.to_date("ts")).join(F.broadcast(days), "day")
    signature = F.concat(F.lit("sha1:"), F.sha1(F.concat("event_type", F.lit(":"), F.col("user_id") % 97)))
    return e.select("run_ord", signature.alias("signature"), F.col("event_id").alias("place"), F.col("event_type").alias("category"), F.concat(F.lit("run"), F.date_format("ts", "dd")).alias("run_id"), F.date_format("ts", "yyyy-MM-dd").alias("recorded_at"))


_STATUS = f"""{_RUNS}, cur AS (SELECT DISTINCT signature FROM runs WHERE run_ord = {BASE + 1}),
    status AS (SELECT signature, CASE WHEN signature IN (SELECT signature FROM runs WHERE run_ord = {BASE}) THEN 'recurring'
      WHEN signature IN (SELECT signature FROM runs WHERE run_ord < {BASE}) THEN 'regressed' ELSE 'new' END AS status FROM cur)"""


@query(f"WITH {_STATUS} SELECT signature, status FROM status")
def trend_status(spark, sf):
    r = rows(spark, sf)
    return trend.classify(r.where(F.col("run_ord") == BASE + 1), r.where(F.col("run_ord") <= BASE), BASE)


@query(f"WITH {_STATUS} SELECT signature, arg_min(category, place) AS category, min(place) AS place, any_value(run_id) AS run_id FROM runs WHERE run_ord = {BASE} AND signature NOT IN (SELECT signature FROM cur) GROUP BY 1")
def trend_fixed(spark, sf):
    r = rows(spark, sf)
    return trend.fixed(r.where(F.col("run_ord") == BASE + 1), r, BASE).select("signature", "category", "place", "run_id")


@query(f"WITH {_STATUS} SELECT status, count(*) AS n FROM status GROUP BY 1")
def trend_counts(spark, sf):
    return trend_status(spark, sf).groupBy("status").agg(F.count("*").alias("n"))


_LAST = "(SELECT max(run_ord) FROM runs)"


@query(
    f"""WITH {_RUNS}, p AS (SELECT signature, run_ord, count(*) AS n, min(run_id) AS run_id FROM runs GROUP BY ALL),
    absent AS (SELECT s.signature, max(r.run_ord) AS a FROM (SELECT DISTINCT signature FROM p) s, (SELECT DISTINCT run_ord FROM p) r
      WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.signature = s.signature AND p.run_ord = r.run_ord) GROUP BY 1)
    SELECT p.signature, arg_min(run_id, run_ord) AS first_seen_run, arg_max(run_id, run_ord) AS last_seen_run, count(*) AS runs_present,
      sum(n)::BIGINT AS total_occurrences, ({_LAST} - coalesce(any_value(a), -1))::BIGINT AS current_streak
    FROM p LEFT JOIN absent USING (signature) GROUP BY 1"""
)
def signature_history(spark, sf):
    return trend.history(rows(spark, sf)).select("signature", "first_seen_run", "last_seen_run", "runs_present", "total_occurrences", "current_streak")


@query(SQL["signature_history"])
def folded_history(spark, sf):
    """As signature_history, but of six runs at a time, each block's state merged into that of the runs before."""
    from emberlog.shared import written

    every = rows(spark, sf)
    last = every.agg(F.max("run_ord")).first()[0]
    state = None
    for at in range(0, last + 1, 6):
        block = trend.history_state(every.where(F.col("run_ord").between(at, at + 5)))
        state = written(block if state is None else trend.merge_history(state, block), "history")
    return trend.history_of(state, last).select("signature", "first_seen_run", "last_seen_run", "runs_present", "total_occurrences", "current_streak")


_SUMS = ", chr(10), ".join(f"sum(('0x' || substr(sha, {1 + 15 * i}, 15))::UBIGINT::HUGEINT)" for i in range(4))


@query(f"WITH {_RUNS} SELECT run_ord, 'set:' || sha1(concat(count(*), chr(10), {_SUMS}, chr(10), '0.1.0')) AS run_id FROM (SELECT run_ord, sha256(signature) AS sha FROM runs) WHERE run_ord IN (0, 7) GROUP BY 1")
def run_set_ids(spark, sf):
    """The ids of two runs that tables keep: sums over a run, no list of its signatures."""
    from emberlog.sinks.run_tables import set_id

    every = rows(spark, sf)
    return spark.createDataFrame([(k, set_id(every.where(F.col("run_ord") == k), "0.1.0")) for k in (0, 7)], "run_ord bigint, run_id string")


@query(f"WITH {_RUNS} SELECT run_ord, 'sha1:' || sha1(string_agg(signature, chr(10) ORDER BY signature) || chr(10) || '0.1.0') AS run_id FROM runs GROUP BY 1")
def run_ids(spark, sf):
    return trend.run_ids(rows(spark, sf), "0.1.0")


def run_heads(spark: SparkSession, sf: str) -> DataFrame:
    """A row for each run."""
    return rows(spark, sf).select("run_ord", "run_id", "recorded_at").distinct()


def _baseline(spark: SparkSession, sf: str, baseline: str | None) -> DataFrame:
    return spark.createDataFrame([trend.baseline_run(run_heads(spark, sf), baseline)], "run_ord bigint, run_id string, recorded_at string").drop("recorded_at")


@query(f"WITH {_RUNS} SELECT max(run_ord) AS run_ord, arg_max(run_id, run_ord) AS run_id FROM runs")
def previous_baseline(spark, sf):
    return _baseline(spark, sf, None)


@query(f"WITH {_RUNS} SELECT min(run_ord) AS run_ord, run_id FROM runs WHERE run_id = 'run05' GROUP BY 2")
def baseline_by_id(spark, sf):
    return _baseline(spark, sf, "run05")


@query(f"WITH {_RUNS} SELECT signature, 0::BIGINT AS current_streak, count(DISTINCT run_ord) AS runs_present FROM runs GROUP BY 1")
def streak_after_empty_run(spark, sf):
    """One more run, which found nothing: no signature is in a streak."""
    heads = run_heads(spark, sf)
    empty = heads.agg((F.max("run_ord") + 1).alias("run_ord"), F.lit("empty").alias("run_id"), F.lit("").alias("recorded_at"))
    return trend.history(rows(spark, sf), heads.unionByName(empty)).select("signature", "current_streak", "runs_present")


@query(f"WITH {_STATUS} SELECT place, signature, status FROM runs JOIN status USING (signature) WHERE run_ord = {BASE + 1}")
def status_of_findings(spark, sf):
    r = rows(spark, sf)
    return trend.with_status(r.where(F.col("run_ord") == BASE + 1), trend_status(spark, sf)).select("place", "signature", "status")


@query(f"WITH {_STATUS} SELECT count(*) FILTER (WHERE status <> 'recurring') > 0 AS failed FROM status")
def trend_gate(spark, sf):
    return spark.createDataFrame([(trend.new_findings(trend_status(spark, sf)),)], "failed boolean")


@query(f"WITH {_RUNS} SELECT DISTINCT signature FROM runs WHERE run_ord < {BASE}")
def older_signatures(spark, sf):
    return rows(spark, sf).where(F.col("run_ord") < BASE).select("signature").distinct()


# ---- sources and stores: reports and runs made of whole tables, written, and read back

_NOT_JSON = "Report is not valid JSON: Expecting property name enclosed in double quotes: line 1 column 2 (char 1)"
_JUNK = ("{oops", "[1]", "\"text\"")
_TITLES = (_NOT_JSON, "Report is not a JSON object (got list)", "Report is not a JSON object (got str)")
_PROBLEM = "CASE c_custkey % 7 " + " ".join(f"WHEN {k} THEN '{t}'" for k, t in enumerate(_TITLES)) + " END"
#: A log of a number is none; a task that is no do_ task is a message.
_CONTENT = "CASE c_custkey % 7 " + " ".join(f"WHEN {k} THEN '{t}'" for k, t in enumerate(_JUNK)) + """ WHEN 3 THEN to_json(struct(c_name AS component, c_nationkey AS machine))
    WHEN 4 THEN to_json(struct(c_name AS component, 'x' AS failures))
    ELSE to_json(struct(c_name AS component, c_mktsegment AS machine, c_acctbal AS distro,
      array(named_struct('task', if(c_custkey % 2 = 0, 'do_fetch', 'Nothing provides'), 'package', 'pkg' || c_nationkey, 'log', c_name || '\nend'),
            named_struct('task', null, 'package', c_mktsegment, 'log', null)) AS failures)) END"""
_SEGMENT = "CASE WHEN c_custkey % 7 = 3 THEN c_nationkey::VARCHAR WHEN c_custkey % 7 > 4 THEN c_mktsegment END"


def decoded_builds(spark: SparkSession, sf: str) -> DataFrame:
    """A report for each customer, some of them malformed."""
    from emberlog.sources.reports import _as_builds

    content = table(spark, sf, "customer").selectExpr("format_string('%09d', c_custkey) AS build_key", "'/in/' || c_custkey AS source_path", f"encode({_CONTENT}, 'UTF-8') AS content")
    return _as_builds(content)


@query(
    f"""SELECT printf('%09d', c_custkey) AS build_key, CASE WHEN c_custkey % 7 > 2 THEN c_name END AS component, {_SEGMENT} AS machine,
    CASE WHEN c_custkey % 7 > 4 THEN 2 ELSE 0 END::BIGINT AS n_failures, {_PROBLEM} AS problem FROM customer"""
)
def decode_builds(spark, sf):
    b = decoded_builds(spark, sf)
    return b.select("build_key", "component", "machine", F.size("failures").cast("bigint").alias("n_failures"), F.get("ingest_findings", F.lit(0))["title"].alias("problem"))


@query(
    """SELECT printf('%09d', c_custkey) AS build_key, i::BIGINT AS failure_ord, CASE WHEN i = 0 THEN CASE WHEN c_custkey % 2 = 0 THEN 'do_fetch' ELSE 'Nothing provides' END END AS task,
    CASE WHEN i = 0 THEN 'pkg' || c_nationkey ELSE c_mktsegment END AS package, CASE WHEN i = 0 THEN c_name || chr(10) || 'end' ELSE '' END AS log,
    CASE WHEN i = 0 AND c_custkey % 2 = 0 THEN 'task' ELSE 'message' END AS kind FROM customer, range(2) r(i) WHERE c_custkey % 7 > 4"""
)
def decode_failures(spark, sf):
    f = engine.failures_of(decoded_builds(spark, sf))
    return f.select("build_key", F.col("failure_ord").cast("bigint").alias("failure_ord"), "task", "package", "log", "kind")


@query(f"SELECT printf('%09d', c_custkey) AS build_key, 'unknown' AS category, 'error' AS severity, {_PROBLEM} AS title, {_PROBLEM} AS evidence, 1.0::DOUBLE AS confidence FROM customer WHERE c_custkey % 7 < 3")
def malformed_findings(spark, sf):
    f = engine.findings_of(decoded_builds(spark, sf)).where("failure_ord = -1")
    return f.select("build_key", "category", "severity", "title", F.array_join("evidence", "\n").alias("evidence"), "confidence")


_NAMES = ("CASE n_nationkey % 5 WHEN 0 THEN 'plain/r[' || n_nationkey || '].json' WHEN 1 THEN 'plain/_' || n_nationkey || '.json' "
          "WHEN 2 THEN '.hidden/' || n_nationkey || '.json' WHEN 3 THEN 'broken/' || n_nationkey || '.txt' ELSE 'plain-more/' || n_nationkey || '.json' END")


def _report_files(spark: SparkSession, sf: str) -> str:
    """A folder with a small report for each nation, hidden, bracketed and broken names among them; 25 files."""
    import json
    import os

    from emberlog.shared import shared_path

    folder = shared_path(spark, "reports").removeprefix("file:")
    for r in table(spark, sf, "nation").selectExpr("n_nationkey", "n_name", f"{_NAMES} AS path").collect():
        path = os.path.join(folder, r["path"])
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w", encoding="utf-8") as out:
            out.write("{oops" if r["n_nationkey"] % 5 == 3 else json.dumps({"component": r["n_name"], "failures": [{"task": "do_compile", "log": "x"}]}))
    return folder


def _scanned(builds_: DataFrame, folder: str) -> DataFrame:
    ordered = engine.placed(builds_.select("build_key", "source_path", "component", "ingest_findings"), [F.col("build_key")])
    path = F.substring_index("source_path", "/", -2)
    return ordered.select(F.col("rank").cast("bigint").alias("place"), path.alias("path"), "component", F.get("ingest_findings", F.lit(0))["title"].alias("problem"))


@query(f"SELECT row_number() OVER (ORDER BY string_split({_NAMES}, '/')) AS place, {_NAMES} AS path, n_name AS component, NULL::VARCHAR AS problem FROM nation WHERE n_nationkey % 5 <> 3")
def scan_folder(spark, sf):
    from emberlog.sources.reports import load_reports

    folder = _report_files(spark, sf)
    return _scanned(load_reports(spark, [folder]), folder)


@query(
    f"""SELECT row_number() OVER (ORDER BY src, string_split(path, '/')) AS place, path, CASE WHEN src = 2 THEN NULL ELSE n_name END AS component, CASE WHEN src = 2 THEN '{_NOT_JSON}' END AS problem
    FROM (SELECT n_name, {_NAMES} AS path, CASE n_nationkey % 5 WHEN 0 THEN 1 WHEN 3 THEN 2 ELSE 3 END AS src FROM nation)"""
)
def scan_globs_and_folder(spark, sf):
    """Bracketed and broken files by globs, then the folder, which has them again; and a path that is not there."""
    from emberlog.sources.reports import load_reports

    folder = _report_files(spark, sf)
    return _scanned(load_reports(spark, [f"{folder}/none.json", f"{folder}/plain/r[[]*.json", f"{folder}/broken/*.txt", folder]), folder)


@query(
    f"""SELECT path, CASE WHEN n_nationkey % 5 = 3 THEN '{_NOT_JSON}' WHEN n_nationkey % 4 = 1 THEN 'Could not read report: [Errno 2] No such file or directory: ' || chr(39) || '/' || path || chr(39) END AS problem,
    CASE WHEN n_nationkey % 5 <> 3 AND n_nationkey % 4 <> 1 THEN n_name END AS component FROM (SELECT *, {_NAMES} || CASE WHEN n_nationkey % 5 <> 3 AND n_nationkey % 4 = 1 THEN '.gone' ELSE '' END AS path FROM nation)"""
)
def missing_report(spark, sf):
    """Reports that are named one by one, of which some are not there or are no reports."""
    from emberlog.sources.reports import _with_hits, read_reports

    folder = _report_files(spark, sf)
    named = table(spark, sf, "nation").selectExpr(f"{_NAMES} || CASE WHEN n_nationkey % 5 <> 3 AND n_nationkey % 4 = 1 THEN '.gone' ELSE '' END AS path").collect()  # 25 rows
    found = _with_hits(read_reports(spark, [f"{folder}/{r.path}" for r in named], named="true"))
    bare = lambda c: F.replace(c, F.lit(f"{folder}/"), F.lit(""))
    problem = F.replace(F.get("ingest_findings", F.lit(0))["title"], F.lit(folder), F.lit(""))
    return found.select(bare(F.col("source_path")).alias("path"), problem.alias("problem"), "component")


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 'SEGMENT = ' || c_mktsegment || chr(10) || CASE WHEN c_custkey % 3 = 0 THEN '# [redacted secret]' ELSE 'NAME = ' || c_name END || CASE WHEN c_custkey % 2 = 0 THEN chr(10) || 'AUTO = 1' ELSE '' END END AS config FROM customer")
def config_extraction(spark, sf):
    local = "CASE WHEN c_custkey % 4 = 0 THEN ' ' ELSE 'SEGMENT = ' || c_mktsegment || '\n' || if(c_custkey % 3 = 0, 'DB_PASSWORD = ' || c_name, 'NAME = ' || c_name) END AS local_conf"
    auto = "CASE WHEN c_custkey % 2 = 0 AND c_custkey % 4 <> 0 THEN 'AUTO = 1' END AS auto_conf"
    return summary.config_text(table(spark, sf, "customer").selectExpr("c_custkey", local, auto)).select("c_custkey", "config")


@query(
    """SELECT (row_number() OVER (ORDER BY n_nationkey)) - 1 AS run_ord, 'run' || n_nationkey AS run_id,
    CASE WHEN n_nationkey % 3 = 0 THEN 0 ELSE n_regionkey END::INTEGER AS source_count, (n_nationkey % 3)::BIGINT AS n_findings FROM nation"""
)
def scan_run_store(spark, sf):
    """A store with a run for each nation; blank and broken lines between them, fields left out, and lines that only some readers of JSON take.

    Findings that are no objects do not count, others of their run do; numbers
    may be texts or NaN; of a repeated key the last counts; what follows an
    object makes a line no JSON.
    """
    import json

    from emberlog.shared import shared_path
    from emberlog.sources.runs import load_runs

    path = shared_path(spark, "store").removeprefix("file:")
    with open(path, "w", encoding="utf-8") as out:
        for r in table(spark, sf, "nation").orderBy("n_nationkey").collect():  # 25 rows
            k = r["n_nationkey"]
            findings = [{"signature": f"s{i}", "title": "t"} for i in range(k % 3)] + ([7, None, "text"] if k % 2 else [])
            run = {"run_id": f"run{k}", "findings": findings, "summary": {"errors": float("nan") if k % 5 == 0 else k}}
            line = json.dumps(run | ({"source_count": str(r["n_regionkey"]) if k % 6 == 1 else r["n_regionkey"]} if k % 3 else {}))
            out.write(('{"run_id": "other", ' + line[1:] if k % 7 == 2 else line) + "\n" + ("\n{oops\n[1]\n" if k % 4 == 0 else '{"run_id": "x"} }\n' if k % 4 == 1 else ""))
    return load_runs(spark, path).select("run_ord", "run_id", "source_count", F.size("findings").cast("bigint").alias("n_findings"))


_KEPT = f"SELECT row_number() OVER (ORDER BY {RANKED}) - 1 AS place, signature, category, severity, recipe, {host('title')} AS title FROM findings"


@query(on_findings(_KEPT))
def record_and_load_run(spark, sf):
    from emberlog.shared import shared_path
    from emberlog.sinks.runs import record_run
    from emberlog.sources.runs import load_store

    path = shared_path(spark, "store").removeprefix("file:")
    record_run(report(spark, sf), path, recorded_at="2024-01-31T00:00:00Z")
    kept = load_store(spark, path)[1]
    return kept.select(F.col("place").cast("bigint").alias("place"), "signature", "category", "severity", "recipe", "title")


@query(on_findings(_KEPT))
def append_and_load_run(spark, sf):
    """Written to the partition of its commit and read back from there; the second append finds it and changes nothing."""
    from emberlog.shared import shared_path
    from emberlog.sinks.run_tables import RunTables

    store = RunTables(spark, shared_path(spark, "tables"))
    made = [store.append(report(spark, sf), recorded_at="2024-01-31T00:00:00Z", key="first") for _ in range(2)]
    return store.rows(made[:1]).select("place", "signature", "category", "severity", "recipe", "title")


@query(on_findings("SELECT signature, 'run' AS first_seen_run, 2::BIGINT AS runs_present, 2 * count(*) AS total_occurrences, 2::BIGINT AS current_streak, 'recurring' AS status FROM findings GROUP BY 1"))
def stored_history(spark, sf):
    """A run that is recorded twice: the history that the store keeps, and each signature's status against the last run."""
    from emberlog.operators.engine import Report
    from emberlog.shared import shared_path, written
    from emberlog.sinks.run_tables import RunTables

    store = RunTables(spark, shared_path(spark, "tables"))
    once = Report(builds(spark, sf), written(found(spark, sf), "findings"), None)
    head = [store.append(once, recorded_at=at) for at in ("t0", "t1")][-1]
    past = trend.history_of(store.history(head), head.run_ord)
    status, _ = store.compare(once.findings, head)
    return past.join(status, "signature").select("signature", F.regexp_replace("first_seen_run", "set:.*", "run").alias("first_seen_run"), "runs_present", "total_occurrences", "current_streak", "status")


# ---- documents, as values


def _parsed(spark: SparkSession, pieces, kind: str) -> DataFrame:
    """A JSON document, which is read as it was written, as a row of its members."""
    text_ = "".join(pieces)
    return spark.createDataFrame([(text_,)], "text string").select(F.from_json("text", kind, {"mode": "FAILFAST"}).alias("d")).select("d.*")


_BLOCK = """'[' || upper(severity) || '] ' || coalesce(nullif(recipe, ''), '(unknown recipe)') || CASE WHEN coalesce(task, '') <> '' THEN ' [' || task || ']' ELSE '' END
    || ' - ' || category || ' (' || printf('%.2f', confidence) || ')' || CASE WHEN cascade_of IS NOT NULL THEN '  (cascade)' ELSE '' END || chr(10) || '    ' || title || chr(10)
    || CASE WHEN coalesce(file, '') <> '' THEN '    at ' || file || coalesce(':' || nullif(line, '0'), '') || chr(10) ELSE '' END
    || CASE WHEN evidence <> '' THEN '      | ' || replace(evidence, chr(10), chr(10) || '      | ') || chr(10) ELSE '' END || chr(10)"""


@query(
    on_findings(
        f"""SELECT sha256(text) AS sha256, len(text)::BIGINT AS n_chars FROM (SELECT string_agg({_BLOCK}, '' ORDER BY {RANKED})
        || count(*) FILTER (WHERE severity = 'error') || ' error(s), ' || count(*) FILTER (WHERE severity = 'warning') || ' warning(s) - exit 1' || chr(10) AS text FROM findings)"""
    )
)
def text_document(spark, sf):
    from emberlog.sinks import documents

    made = "".join(documents.text(report(spark, sf), 1))
    return spark.createDataFrame([(made,)], "text string").select(F.sha2("text", 256).alias("sha256"), F.char_length("text").cast("bigint").alias("n_chars"))


@query(
    on_findings(
        f""", g AS (SELECT signature, count(*) AS occurrences, count(DISTINCT nullif(recipe, '')) AS n_recipes FROM findings GROUP BY 1)
    SELECT row_number() OVER (ORDER BY {RANKED}) - 1 AS place, signature, category, severity, title, recipe, task, file, evidence, confidence, cascade_of, occurrences, n_recipes,
      count(*) FILTER (WHERE severity = 'error') OVER () AS errors, count(*) FILTER (WHERE category = 'compile') OVER () AS n_compile FROM findings JOIN g USING (signature)"""
    )
)
def analysis_document(spark, sf):
    from emberlog.sinks import documents

    finding = "struct<signature:string,category:string,severity:string,title:string,recipe:string,task:string,file:string,evidence:array<string>,confidence:double,cascade_of:string,occurrences:bigint,affected_recipes:array<string>>"
    head, each, tail = documents.analysis_pieces(report(spark, sf))
    d = _parsed(spark, [head, "[]", tail.removeprefix("[]").removeprefix("\n  ]")], "summary struct<errors:bigint,warnings:bigint,by_category:map<string,bigint>>")
    # a piece is a comma, or the array's bracket, and a finding
    each = each.select("place", F.from_json(F.expr("substring(piece, 2)"), finding, {"mode": "FAILFAST"}).alias("f"))
    rows_ = each.crossJoin(F.broadcast(d)).select("place", "f.*", F.col("summary.errors").alias("errors"), F.col("summary.by_category")["compile"].alias("n_compile"))
    return rows_.withColumns({"evidence": F.array_join("evidence", "\n"), "n_recipes": F.size("affected_recipes").cast("bigint")}).drop("affected_recipes")


@query(on_findings(f"SELECT build_key, failure_ord, rule_ord, {host('title')} AS title, {host('evidence')} AS evidence, signature FROM findings"))
def redacted_findings(spark, sf):
    return flat(report(spark, sf).redacted().findings).select("build_key", "failure_ord", "rule_ord", "title", "evidence", "signature")


@query(
    on_findings(
        f"""SELECT row_number() OVER (ORDER BY {RANKED}) - 1 AS place, category AS rule, CASE severity WHEN 'error' THEN 'error' WHEN 'failure' THEN 'error' WHEN 'warning' THEN 'warning' ELSE 'note' END AS level,
    {host("title")} AS text, nullif(file, '') AS uri, CASE WHEN file <> '' THEN nullif(line, '0') END AS line FROM findings"""
    )
)
def sarif_document(spark, sf):
    from emberlog.sinks import documents

    result = "struct<ruleId:string,level:string,message:struct<text:string>,locations:array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:int>>>>>"
    d = _parsed(spark, documents.sarif(report(spark, sf)), f"runs array<struct<results:array<{result}>>>")
    each = d.select(F.posexplode(F.col("runs")[0]["results"]).alias("place", "r"))
    at = F.get("r.locations", F.lit(0))["physicalLocation"]
    return each.select(
        F.col("place").cast("bigint").alias("place"), F.col("r.ruleId").alias("rule"), F.col("r.level").alias("level"), F.col("r.message.text").alias("text"), at["artifactLocation"]["uri"].alias("uri"), at["region"]["startLine"].cast("string").alias("line")
    )


@query(
    f"""WITH {_STATUS}, listed AS (
      SELECT status AS list, signature FROM status UNION ALL SELECT 'fixed', signature FROM runs WHERE run_ord = {BASE} AND signature NOT IN (SELECT signature FROM cur) GROUP BY signature)
    SELECT list, row_number() OVER (PARTITION BY list ORDER BY signature) - 1 AS place, signature, count(*) OVER (PARTITION BY list) AS n FROM listed"""
)
def trend_document(spark, sf):
    """The lists of a trend and their counts, as they stand in its JSON."""
    from emberlog.sinks.runs import trend_json

    r = rows(spark, sf).withColumns({c: F.lit(None).cast("string") for c in ("severity", "recipe", "title")})
    current = r.where(F.col("run_ord") == BASE + 1)
    made = trend_json("base", trend.classify(current, r, BASE), trend.fixed(current, r, BASE))
    lists = ("new", "recurring", "regressed")
    d = _parsed(spark, [made], ", ".join(f"{k} array<string>" for k in lists) + ", fixed array<struct<signature:string>>, counts map<string,bigint>")
    d = d.withColumn("fixed", F.col("fixed.signature"))
    every = [d.select(F.lit(k).alias("list"), F.posexplode(k).alias("place", "signature"), F.col("counts")[k].alias("n")) for k in (*lists, "fixed")]
    out = every[0]
    for e in every[1:]:
        out = out.unionByName(e)
    return out.withColumn("place", F.col("place").cast("bigint"))


# ---- shown results


@query(on_findings("SELECT row_number() OVER (ORDER BY count(*) DESC, signature) AS place, signature, count(*) AS occurrences FROM findings GROUP BY signature"))
def ranked_groups(spark, sf):
    return engine.placed(report(spark, sf).groups, engine.group_order()).select(F.col("rank").cast("bigint").alias("place"), "signature", "occurrences")


@query(on_findings("SELECT build_key, failure_ord, rule_ord, array_to_string(list_slice(string_split(evidence, chr(10)), -2, -1), chr(10)) AS evidence FROM findings"))
def capped_evidence(spark, sf):
    return flat(engine.cap_evidence(found(spark, sf), 2)).select("build_key", "failure_ord", "rule_ord", "evidence")


@query(on_findings(f"SELECT build_key, failure_ord, rule_ord, ((len({host('title')}) + 1 + len({host('evidence')}) + 3) // 4)::BIGINT AS tokens FROM findings"))
def finding_tokens(spark, sf):
    f = summary.shown(found(spark, sf), 0)
    return f.select("build_key", *[F.col(c).cast("bigint").alias(c) for c in ("failure_ord", "rule_ord")], summary.finding_tokens(F.col("title"), F.col("evidence")).cast("bigint").alias("tokens"))


@query(on_findings("SELECT (row_number() OVER (ORDER BY category))::BIGINT AS place, category, n FROM (SELECT category, count(*) AS n FROM findings GROUP BY 1)"))
def category_chips(spark, sf):
    by = engine.totals(found(spark, sf))["by_category"]
    return spark.createDataFrame([(i + 1, k, n) for i, (k, n) in enumerate(by.items())], "place bigint, category string, n bigint")


@query(on_lines("SELECT count(DISTINCT build_key) AS sources, count(DISTINCT (build_key, failure_ord)) AS failures FROM lines"))
def source_count(spark, sf):
    return builds(spark, sf).agg(F.count("*").alias("sources"), F.sum(F.size("failures")).cast("bigint").alias("failures"))


@query(on_lines("SELECT build_key, failure_ord, 'custom' AS category, arg_min(body, n) AS title FROM lines WHERE level = 'ERROR' GROUP BY ALL"))
def given_rules(spark, sf):
    """A rule given by hand takes the place of the registered ones and their fallback."""
    from emberlog.operators.rules import Rule

    errors = lambda: F.filter("lines", lambda x: x["level"] == "ERROR")
    hit = lambda: F.struct(
        F.lit("custom").alias("category"), F.lit("error").alias("severity"), F.get(errors(), F.lit(0))["text"].alias("title"), F.lit(None).cast("string").alias("recipe"),
        F.lit(None).cast("string").alias("task"), F.lit(None).cast("string").alias("file"), F.lit(None).cast("int").alias("line"), F.array(F.lit("x")).alias("evidence"), F.lit(0.5).alias("confidence"),
    )
    rule = Rule("custom", lambda: F.size(errors()) > 0, hit)
    return flat(engine.analyze(builds(spark, sf), [rule]).findings).select("build_key", "failure_ord", "category", "title")
