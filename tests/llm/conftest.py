"""Small helpers of the tests of this folder."""

import pytest


@pytest.fixture
def docs(spark):
    """Documents from (doc_id, text[, source]) rows."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, "doc_id bigint, text string, lang string, source string, n_chars bigint")

    return make


@pytest.fixture
def as_table(tmp_path):
    """A folder like the driver's, with one table."""

    def make(name, df):
        df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return make
