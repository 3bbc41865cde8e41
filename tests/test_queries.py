"""The registered queries against their SQL in DuckDB."""

import os

import duckdb
import pytest

from emberlog.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in sorted(f.removesuffix(".parquet") for f in os.listdir(SF)):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    result = duck.execute(SQL[name])
    columns = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(columns)
    order = sorted(columns)
    at = [columns.index(c) for c in order]
    want = sorted(tuple(str(row[i]) for i in at) for row in result.fetchall())
    assert sorted(tuple(str(v) for v in row) for row in df.select(*order).collect()) == want


def test_analysis_document_does_not_pass_the_driver(spark, monkeypatch):
    from emberlog.plans import queries

    parsed, lengths = queries._parsed, []

    def measured(spark, pieces, kind):
        pieces = list(pieces)
        lengths.append(sum(map(len, pieces)))
        return parsed(spark, pieces, kind)

    monkeypatch.setattr(queries, "_parsed", measured)
    assert QUERIES["analysis_document"](spark, SF).count() > 5
    assert all(n < 1000 for n in lengths), lengths


def test_analysis_document_is_json_as_dumps_writes_it(spark):
    import json
    from dataclasses import replace

    from emberlog.plans.logs import report
    from emberlog.sinks import documents

    whole = report(spark, SF)
    for r in (whole, replace(whole, findings=whole.findings.where("false"))):
        made = "".join(documents.analysis_json(r))
        read = json.loads(made)
        assert made == json.dumps(read, indent=2, sort_keys=True) + "\n"
        assert len(read["findings"]) == r.findings.count() == sum(read["summary"]["by_category"].values())
