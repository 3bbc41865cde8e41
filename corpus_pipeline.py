"""The corpus pipeline: from raw documents to encoded training text.

Each stage takes (spark, docs, sf_dir), works on all rows of the stage before
it and returns a frame that is written as Parquet and read again. Columns of any
name come out of all stages but the last as they went in. Null and empty texts
go in the first stage; in later ones they are texts without words. Repeated rows
are rows like any other, and no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm import linededup, mixing, quality, sentencepiece_bpe, simhash
from emberlog.llm.common import discard, materialize, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a base rule or a certified cutoff rejects go; null and short texts are among them, repeated rows are judged alike."""
    return quality.filter_documents(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of line runs go from the texts; documents of which nothing is left go too.

    Null, empty and blank texts stay. Rows equal in id and text change alike.
    n_chars, where there is one, counts the new text.
    """
    kept = linededup.drop_copied_lines(docs)
    return kept.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else kept


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one of the least id; rows without an id stay."""
    return simhash.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy that the mix takes, dealt to shards and shuffled within; texts without words are not taken."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and hashes of ids and decoded text of every row; null and empty texts have no tokens."""
    return sentencepiece_bpe.digests(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("simhash near-dedup", near_dedup),
    ("mix sources", mix_sources),
    ("sentencepiece", encode),
]

#: The last stage, and the fingerprints of the third, are beyond SQL; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    before = None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, f"stage{k}")
            if before is not None:
                discard(before)
            before = docs
    return docs
