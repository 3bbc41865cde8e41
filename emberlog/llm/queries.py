"""Queries of this subpackage for the driver, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from emberlog.llm import collocations, html_extract, licenses, linededup, mixing, quality, secrets, sentencepiece_bpe, sharding, simhash, spelling, token_files, topk

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": sentencepiece_bpe.query,
    "op2_secrets": secrets.query,
    "op3_topk": topk.query,
    "op4_mixing": mixing.query,
    "op5_quality": quality.query,
    "op6_licenses": licenses.query,
    "op7_html": html_extract.query,
    "op8_linededup": linededup.query,
    "op9_sharding": sharding.query,
    "op10_simhash": simhash.query,
    "op11_tokenfiles": token_files.query,
    "op12_collocations": collocations.query,
    "op13_spelling": spelling.query,
}

SQL: dict[str, str] = {
    "op3_topk": topk.SQL,
    "op6_licenses": licenses.SQL,
    "op8_linededup": linededup.SQL,
    "op12_collocations": collocations.SQL,
}
