"""Build logs and runs derived from the driver's tables, alike in Spark and in DuckDB.

A user of events is a build, a third of a month of that user is a failure, an
event is a line of its log. What the lines say follows the failure's family
(f), so that every rule has failures of its own. Findings are derived twice:
by the engine here, and in FINDINGS by SQL that knows nothing of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.operators.engine import Report, analyze

#: (condition on f, k, u; text of the line): the first that holds. Both engines read this SQL.
TEXTS = (
    ("f = 0 AND k = 0", "'ERROR: Task failed in run.do_compile.' || id"),
    ("f = 0 AND k = 1 AND u % 3 = 0", "'m.o: undefined reference to sym' || (id % 4)"),
    ("f = 0 AND k = 1", "'src/m' || (id % 3) || '.c:' || (id % 500) || ':7: error: bad value at line ' || id"),
    ("f = 1 AND k = 0", "'CMake Error at CMakeLists.txt:' || (id % 90) || ' (find_package):'"),
    ("f = 1 AND k = 1 AND u % 2 = 0", "'package \"Qt' || (id % 3) || '\" is considered to be NOT FOUND'"),
    ("f = 1 AND k = 4", "'src/x.cpp:3: error: shadowed'"),
    ("f = 2 AND k = 0 AND u % 2 = 0", "'Applying patch fix-' || (id % 4) || '.patch'"),
    ("f = 2 AND k = 1", "'patching file src/lib/a' || (id % 5) || '.c'"),
    ("f = 2 AND k = 2", "'Hunk #' || (id % 3 + 1) || ' FAILED at ' || (id % 200) || '.'"),
    ("f = 2 AND k = 4 AND u % 4 = 0", "'ERROR: QA Issue: late check [patch-fuzz]'"),
    ("f = 3 AND k = 0", "'ERROR: QA Issue: contains symlink /a/b' || (id % 3) || '.so [dev-so]'"),
    ("f = 3 AND k = 1", "'ERROR: QA Issue: reference to TMPDIR [buildpaths]'"),
    ("f = 3 AND k = 3", "'ERROR: QA Issue: odd thing ' || (id % 2)"),
    ("f = 3 AND k = 4", "'ERROR: Fatal QA errors were found, failing task.'"),
    ("f = 4 AND k = 0", "'ERROR: Fetcher failure: Unable to fetch url'"),
    ("f = 4 AND k = 1 AND u % 2 = 0", "'ERROR: FetchError(' || q || 'no mirror' || q || ', ' || q || 'git://h/r' || (id % 4) || '.git' || q || ')'"),
    ("f = 4 AND k = 1", "'ERROR: Failed to get ' || q || 'https://h/r' || (id % 4) || q"),
    ("f = 4 AND k = 4", "'checksum mismatch ' || (id % 2)"),
    ("f = 5 AND k = 0", "'ERROR: No provider for libz' || (id % 3)"),
    ("f = 5", "'NOTE: resolving ' || id"),
    ("f = 6 AND k = 0 AND u % 2 = 0", "'ERROR: install failed at 0x' || lower(hex(id))"),
    ("f = 6 AND k < 2", "'WARNING: slow ' || (id % 3)"),
    ("k = 2", "'NOTE: step ' || id"),
    ("k = 3", "'DEBUG: probe 0x' || lower(hex(id)) || ' /srv/bob/2024-01-02/x'"),
    ("true", "'linking CXX ' || (id % 2)"),
)
LINE_TEXT = "CASE " + " ".join(f"WHEN {when} THEN {text}" for when, text in TEXTS) + " END"
TASK = (
    "CASE f WHEN 0 THEN 'do_compile' WHEN 1 THEN 'do_configure' WHEN 2 THEN 'do_patch' WHEN 3 THEN 'do_package_qa' WHEN 4 THEN 'do_fetch' "
    "WHEN 6 THEN 'do_install' ELSE CASE WHEN u % 2 = 0 THEN 'Nothing provides ' || q || 'lib' || (u % 6) || q ELSE 'Unbuildable target' END END"
)
RECIPE = "CASE u % 5 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'recipe' || (u % 11) END"
COLUMNS = ("event_id AS id", "user_id AS u", "user_id % 7 AS f", "event_id % 5 AS k", "chr(39) AS q", "CASE WHEN day(ts) <= 10 THEN 0 WHEN day(ts) <= 20 THEN 1 ELSE 2 END AS part")
SOURCE = ", ".join(COLUMNS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def builds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The builds that events tell of, as load_reports would give them."""
    lines = table(spark, sf_dir, "events").selectExpr(*COLUMNS)
    lines = lines.selectExpr("u", "part", "id", f"{LINE_TEXT} AS text", f"{TASK} AS task", f"{RECIPE} AS recipe")
    logs = lines.groupBy("u", "part").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", "text"))), lambda x: x["text"]), "\n").alias("log"), F.min("task").alias("task"), F.min("recipe").alias("recipe")
    )
    kind = F.when(F.col("task").startswith("do_"), "task").otherwise("message")
    failure = F.struct("task", F.format_string("pkg%d", F.col("u") % 13).alias("package"), "recipe", "log", kind.alias("kind"))
    each = logs.groupBy("u").agg(F.transform(F.sort_array(F.collect_list(F.struct("part", failure.alias("f")))), lambda x: x["f"]).alias("failures"))
    none = "array<struct<category:string,severity:string,title:string,evidence:array<string>,confidence:double>>"
    return each.select(F.format_string("%09d", "u").alias("build_key"), F.format_string("/in/%d.json", "u").alias("source_path"), "failures", F.array().cast(none).alias("ingest_findings"))


def report(spark: SparkSession, sf_dir: str) -> Report:
    return analyze(builds(spark, sf_dir))


def normal(x: str) -> str:
    """Normalisation in DuckDB."""
    for pattern, by in (
        (r"0x[0-9a-fA-F]+", "0x<HEX>"),
        (r"(run\.[A-Za-z0-9_]+\.)\d+", r"\1<PID>"),
        (r"([\w./+-]*\.[A-Za-z][A-Za-z0-9+]*):\d+(?::\d+)?", r"\1:<N>"),
        (r"\bline \d+\b", "line <N>"),
    ):
        x = f"regexp_replace({x}, '{pattern}', '{by}', 'g')"
    return x


def host(x: str) -> str:
    """Redaction of host identity in DuckDB; word characters as Unicode has them."""
    w = r"\p{L}\p{M}\p{N}\p{Pc}"
    for pattern, by in (
        ('SSH_AUTH_SOCK="[^"]*"', 'SSH_AUTH_SOCK="<redacted>"'),
        (rf"/[{w}.+-]+/[{w}.+-]+/\.(?:gnupg|ssh)/[{w}./+-]*", "<redacted-path>"),
        (rf"/[{w}.+-]+/[{w}.+-]+/\p{{Nd}}{{4}}-\p{{Nd}}{{2}}-\p{{Nd}}{{2}}", "HOSTDIR"),
    ):
        x = f"regexp_replace({x}, '{pattern}', '{by}', 'g')"
    return x


def _has(*signals: str) -> str:
    return "(" + " OR ".join(f"contains(body, '{s}')" for s in signals) + ")"


def _first(value: str, when: str) -> str:
    return f"arg_min({value}, n) FILTER (WHERE {when})"


_PKG = 'package "([^"]+)" is considered to be NOT'
_DIAG = r"(\S+\.[A-Za-z][\w+]*):(\d+):(?:\d+:)?\s*error:"
_NAME = r"(?:Nothing provides|No provider(?:s)? for|Nothing RPROVIDES|No eligible RPROVIDERs exist for)\s+''?([^''\n)]+?)''?(?:\s|$|\))"
_HUNK = r"Hunk #(\d+) FAILED at (\d+)"
_ERR = r"FetchError\(''([^'']+)'',\s*''([^'']+)''\)"
_URI = "''((?:git|https?|ftp|ssh|svn|npm|file|s3|crate)://[^'']+)''"

#: Log lines as DuckDB sees them: build, part, n, level, body, and the failure's columns.
LINES = f"""
raw AS (SELECT {SOURCE} FROM events),
texts AS (SELECT u, part, f, id, {LINE_TEXT} AS text, {TASK} AS task, {RECIPE} AS recipe FROM raw),
numbered AS (
  SELECT *, printf('%09d', u) AS build_key, dense_rank() OVER (PARTITION BY u ORDER BY part) - 1 AS failure_ord,
         row_number() OVER (PARTITION BY u, part ORDER BY id) AS n, 'pkg' || (u % 13) AS package,
         CASE WHEN starts_with(task, 'do_') THEN 'task' ELSE 'message' END AS kind FROM texts
),
lines AS (
  SELECT *, nullif(regexp_extract(text, '^(ERROR|WARNING|NOTE|DEBUG):', 1), '') AS level,
         regexp_replace(text, '^(ERROR|WARNING|NOTE|DEBUG):\\s?', '') AS body FROM numbered
)"""

#: All findings in DuckDB, by grouping and windows over the lines.
FINDINGS = f"""
{LINES},
facts AS (
  SELECT build_key, failure_ord, any_value(task) AS task, any_value(kind) AS kind, any_value(package) AS package,
    coalesce(nullif(any_value(recipe), ''), any_value(package)) AS recipe,
    bool_or({_has("CMake Error", "Configuring incomplete", "considered to be NOT", "NOT FOUND")}) AS is_configure,
    {_first(f"regexp_extract(body, '{_PKG}', 1)", f"regexp_matches(body, '{_PKG}')")} AS cfg_package,
    {_first("body", _has("CMake Error"))} AS cfg_error,
    {_first(r"regexp_extract(body, 'CMakeLists\.txt:(\d+)', 1)", r"regexp_matches(body, 'CMakeLists\.txt:(\d+)')")} AS cfg_line,
    min(n) FILTER (WHERE {_has("considered to be NOT", "CMake Error")}) AS cfg_n,
    bool_or({_has("error:", "undefined reference to", "ninja: build stopped")}) AS is_compile,
    {_first("body", _has("error:"))} AS error_body, min(n) FILTER (WHERE {_has("error:")}) AS error_n,
    {_first("body", _has("undefined reference to"))} AS undef_body, min(n) FILTER (WHERE {_has("undefined reference to")}) AS undef_n,
    {_first(f"regexp_extract(body, '{_DIAG}', 1)", f"regexp_matches(body, '{_DIAG}')")} AS diag_file,
    {_first(f"regexp_extract(body, '{_DIAG}', 2)", f"regexp_matches(body, '{_DIAG}')")} AS diag_line,
    bool_or({_has("Nothing provides", "No provider", "Nothing RPROVIDES", "No eligible RPROVIDERs")}) AS is_dependency,
    {_first(f"regexp_extract(body, '{_NAME}', 1)", f"regexp_matches(body, '{_NAME}')")} AS dep_name,
    bool_or({_has("Unable to fetch", "Fetcher failure", "FetchError", "Network is unreachable", "checksum", "Unable to find revision")}) AS is_fetch,
    coalesce(string_agg(body, chr(10) ORDER BY n) FILTER (WHERE level = 'ERROR'), string_agg(body, chr(10) ORDER BY n)) AS scope,
    {_first("body", "level = 'ERROR' AND contains(lower(body), 'fetch')")} AS fetch_body,
    min(n) FILTER (WHERE level = 'ERROR' AND contains(lower(body), 'fetch')) AS fetch_n,
    bool_or(regexp_matches(body, '{_HUNK}') OR {_has("does not apply", "rejects in file")}) AS is_patch,
    min(n) FILTER (WHERE regexp_matches(body, '{_HUNK}')) AS hunk_n, {_first("body", f"regexp_matches(body, '{_HUNK}')")} AS hunk_body,
    {_first(r"regexp_extract(body, '([\w.+-]+\.patch)', 1)", _has("does not apply", "Applying patch") + r" AND regexp_matches(body, '[\w.+-]+\.patch')")} AS patch_name,
    bool_or({_has("QA Issue:", "Fatal QA errors were found")}) AS is_qa,
    {_first("body", "level = 'ERROR'")} AS any_error, min(n) FILTER (WHERE level = 'ERROR') AS any_error_n,
    arg_max(body, n) FILTER (WHERE level = 'WARNING') AS warning, max(n) FILTER (WHERE level = 'WARNING') AS warning_n,
    bool_or(level IS NULL OR level NOT IN ('NOTE', 'DEBUG')) AS has_signal
  FROM lines GROUP BY build_key, failure_ord
),
carried AS (
  SELECT f.build_key, f.failure_ord, arg_max(regexp_extract(body, 'patching file (\\S+)', 1), n) AS path
  FROM facts f JOIN lines l ON l.build_key = f.build_key AND l.failure_ord = f.failure_ord AND l.n <= f.hunk_n
  WHERE regexp_matches(body, 'patching file (\\S+)') GROUP BY ALL
),
qa_lines AS (
  SELECT build_key, failure_ord, n, body,
    coalesce(nullif(regexp_extract(body, '\\[([\\w-]+)\\]\\s*$', 1), ''), nullif(regexp_extract(body, 'QA Issue:\\s*(\\S+)', 1), ''), 'qa') AS class
  FROM lines WHERE contains(body, 'QA Issue:')
),
qa_classes AS (
  SELECT build_key, failure_ord, class, count(*) AS c, min(n) AS first_n, arg_min(body, n) AS body FROM qa_lines GROUP BY ALL
),
qa AS (
  SELECT build_key, failure_ord, 'QA Issue: ' || string_agg(class || ' x' || c, ', ' ORDER BY c DESC, first_n) AS title,
    string_agg(body || CASE WHEN c > 1 THEN ' (x' || c || ')' ELSE '' END, chr(10) ORDER BY c DESC, first_n) AS evidence,
    arg_min(body || CASE WHEN c > 1 THEN ' (x' || c || ')' ELSE '' END, (-c) * 1000000 + first_n) AS head
  FROM qa_classes GROUP BY ALL
),
hits AS (
  SELECT build_key, failure_ord, 0 AS place, 'configure' AS category, 'error' AS severity,
    coalesce('package "' || cfg_package || '" considered NOT FOUND', cfg_error, 'Configure error') AS title, recipe, task, kind,
    CASE WHEN cfg_line IS NOT NULL THEN 'CMakeLists.txt' END AS file, cfg_line AS line, cfg_n AS focus, 0.85::DOUBLE AS confidence FROM facts WHERE is_configure
  UNION ALL SELECT build_key, failure_ord, 1, 'compile', 'error', coalesce(error_body, undef_body, 'Compilation failed'), recipe, task, kind,
    string_split(diag_file, '/')[-1], diag_line, coalesce(error_n, undef_n), 0.8::DOUBLE FROM facts WHERE is_compile AND NOT is_configure
  UNION ALL SELECT build_key, failure_ord, 2, 'dependency', 'error',
    coalesce('Nothing provides ' || chr(39) || coalesce(nullif(regexp_extract(task, '{_NAME}', 1), ''), dep_name) || chr(39), task), recipe, task, kind,
    NULL, NULL, NULL, 0.9::DOUBLE FROM facts WHERE kind = 'message' OR is_dependency
  UNION ALL SELECT build_key, failure_ord, 3, 'fetch', 'error',
    CASE WHEN regexp_matches(scope, '{_ERR}') THEN regexp_extract(scope, '{_ERR}', 1) || ' (' || regexp_extract(scope, '{_ERR}', 2) || ')'
      WHEN regexp_matches(scope, '{_URI}') THEN coalesce(fetch_body || ' (' || regexp_extract(scope, '{_URI}', 1) || ')', 'Unable to fetch ' || regexp_extract(scope, '{_URI}', 1))
      ELSE coalesce(fetch_body, 'do_fetch failed') END,
    recipe, 'do_fetch', 'task', NULL, NULL, fetch_n, 0.85::DOUBLE FROM facts WHERE task = 'do_fetch' AND is_fetch
  UNION ALL SELECT f.build_key, f.failure_ord, 4, 'patch', 'error',
    coalesce(patch_name || ' failed: Hunk #' || regexp_extract(hunk_body, '{_HUNK}', 1) || ' at ' || string_split(path, '/')[-1] || ':' || regexp_extract(hunk_body, '{_HUNK}', 2),
      'Patch hunk #' || regexp_extract(hunk_body, '{_HUNK}', 1) || ' failed at ' || string_split(path, '/')[-1] || ':' || regexp_extract(hunk_body, '{_HUNK}', 2),
      'Patch ' || patch_name || ' does not apply', 'Patch failed to apply'),
    recipe, task, kind, string_split(path, '/')[-1], regexp_extract(hunk_body, '{_HUNK}', 2), hunk_n, 0.9::DOUBLE
    FROM facts f LEFT JOIN carried USING (build_key, failure_ord) WHERE is_patch
  UNION ALL SELECT build_key, failure_ord, 5, 'qa', 'error', coalesce(qa.title, 'Fatal QA errors were found'), recipe, task, kind, NULL, NULL, NULL, 0.9::DOUBLE
    FROM facts LEFT JOIN qa USING (build_key, failure_ord) WHERE is_qa OR task = 'do_package_qa'
),
with_fallback AS (
  SELECT * FROM hits
  UNION ALL SELECT build_key, failure_ord, 9, 'unknown', CASE WHEN any_error IS NULL AND warning IS NOT NULL THEN 'warning' ELSE 'error' END,
    coalesce(any_error, warning, task), recipe, task, kind, NULL, NULL, coalesce(any_error_n, warning_n), 0.3::DOUBLE
  FROM facts f WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.build_key = f.build_key AND h.failure_ord = f.failure_ord)
),
placed AS (SELECT *, row_number() OVER (PARTITION BY build_key, failure_ord ORDER BY place) - 1 AS rule_ord FROM with_fallback),
pool AS (
  SELECT l.build_key, l.failure_ord, l.n, CASE WHEN level IS NULL THEN body ELSE level || ': ' || body END AS t,
    min(l.n) OVER (PARTITION BY l.build_key, l.failure_ord) AS first_n
  FROM lines l JOIN facts f ON f.build_key = l.build_key AND f.failure_ord = l.failure_ord WHERE NOT has_signal OR level IS NULL OR level NOT IN ('NOTE', 'DEBUG')
),
windowed AS (
  SELECT h.build_key, h.failure_ord, h.rule_ord, p.n, p.t, row_number() OVER (PARTITION BY h.build_key, h.failure_ord, h.rule_ord ORDER BY p.n DESC) AS back
  FROM placed h JOIN pool p ON p.build_key = h.build_key AND p.failure_ord = h.failure_ord AND (h.focus IS NULL OR p.n <= h.focus OR p.first_n > h.focus)
),
changed AS (
  SELECT *, {normal("t")} AS norm, CASE WHEN {normal("t")} = lag({normal("t")}) OVER (PARTITION BY build_key, failure_ord, rule_ord ORDER BY n) THEN 0 ELSE 1 END AS fresh
  FROM windowed WHERE back <= 15
),
islands AS (SELECT *, sum(fresh) OVER (PARTITION BY build_key, failure_ord, rule_ord ORDER BY n) AS g FROM changed),
squeezed AS (
  SELECT build_key, failure_ord, rule_ord, g, arg_min(t, n) || CASE WHEN count(*) > 1 THEN ' (x' || count(*) || ')' ELSE '' END AS t FROM islands GROUP BY ALL
),
evidence AS (SELECT build_key, failure_ord, rule_ord, string_agg(t, chr(10) ORDER BY g) AS evidence, arg_min(t, g) AS head FROM squeezed GROUP BY ALL),
signed AS (
  SELECT h.build_key, h.failure_ord, h.rule_ord, h.category, h.severity, h.title, h.recipe, CASE WHEN kind = 'task' THEN task END AS task, file, line::INTEGER::VARCHAR AS line, confidence,
    CASE WHEN h.category = 'qa' AND qa.title IS NOT NULL THEN qa.evidence ELSE coalesce(e.evidence, h.title) END AS evidence,
    CASE WHEN h.category = 'qa' AND qa.title IS NOT NULL THEN qa.head ELSE coalesce(e.head, h.title) END AS head
  FROM placed h LEFT JOIN evidence e USING (build_key, failure_ord, rule_ord) LEFT JOIN qa ON qa.build_key = h.build_key AND qa.failure_ord = h.failure_ord
),
hashed AS (SELECT *, 'sha1:' || sha1({normal("category || chr(10) || title || chr(10) || head")}) AS signature FROM signed),
findings AS (
  SELECT *, CASE WHEN severity = 'error' AND row_number() OVER (PARTITION BY build_key, signature, severity ORDER BY failure_ord, rule_ord) > 1 THEN signature END AS cascade_of,
    CASE severity WHEN 'error' THEN 0 WHEN 'failure' THEN 1 WHEN 'warning' THEN 2 WHEN 'anomaly' THEN 3 ELSE 9 END AS severity_rank,
    CASE category WHEN 'dependency' THEN 0 WHEN 'fetch' THEN 1 WHEN 'patch' THEN 2 WHEN 'configure' THEN 3 WHEN 'compile' THEN 4 WHEN 'qa' THEN 5 WHEN 'unknown' THEN 6 ELSE 9 END AS phase_rank
  FROM hashed
)"""
RANKED = "severity_rank, phase_rank, confidence DESC, coalesce(recipe, ''), signature, build_key, failure_ord, rule_ord"
