"""Fixed labels and ranks of severities and categories, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
SEVERITY_RANK = {"error": 0, "failure": 1, "warning": 2, "anomaly": 3}
PHASE_RANK = {"dependency": 0, "fetch": 1, "patch": 2, "configure": 3, "compile": 4, "qa": 5, "unknown": 6}
OTHER_RANK = 9
SARIF_LEVEL = {"error": "error", "failure": "error", "warning": "warning", "anomaly": "note"}
LIKELY_CAUSE = {
    "configure": "configure-time error; a dependency may be missing from the sysroot (DEPENDS)",
    "compile": "compilation error; inspect the first compiler diagnostic",
    "patch": "a patch does not apply cleanly to this source version",
    "qa": "a packaging QA check failed",
    "fetch": "the source could not be fetched (URI, network, or checksum)",
    "dependency": "unresolved provider; a required recipe/PROVIDES is missing",
    "unknown": "see the evidence for the failing step",
}


def _lookup(key: Column, table: dict, default: object) -> Column:
    pairs = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(pairs, key), F.lit(default))


def severity_rank(severity: Column) -> Column:
    return _lookup(severity, SEVERITY_RANK, OTHER_RANK)


def phase_rank(category: Column) -> Column:
    return _lookup(category, PHASE_RANK, OTHER_RANK)


def sarif_level(severity: Column) -> Column:
    return _lookup(severity, SARIF_LEVEL, "note")


def likely_cause(category: Column) -> Column:
    return _lookup(category, LIKELY_CAUSE, LIKELY_CAUSE["unknown"])
