"""The corpus pipeline: language ID, near-duplicate removal, secret masking, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; docs has the columns of ``documents``
(doc_id, text, lang, source, n_chars) and perhaps others, which pass through whatever their names but
for the last stage. Stages read all rows and whole texts of any length; repeated rows are rows like any
other until near-duplicate removal keeps one; an empty table gives empty tables of the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from diskloom.llm import language_id, minhash, packing, secrets
from diskloom.llm.common import forget, written

ORACLE_SQL = None


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an accepted language go: null, empty and letterless texts, gibberish, other languages.

    Profiles come from the labelled rows among docs; equal distances go to the language first in order.
    """
    return language_id.keep_accepted(docs, language_id.fit(docs))


def remove_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the lowest id, null ids last, then the earlier row.

    Null and blank texts are in no group and stay.
    """
    return minhash.deduplicated(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; reported secrets are masked in its text, and n_chars follows it.

    Null and empty texts stay as they are; overlapping candidates are cut from left to right.
    """
    return secrets.redacted(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document has a place in a pack: (doc_id, pack_id, slot, tokens, segments, loss_tokens, oversize).

    Null and empty texts have no tokens but a place; a document over the limit has a pack of its own;
    of equal documents any may take a place that one of them has, and the order of rows changes nothing.
    """
    return packing.pack_documents(docs)


STAGES = [("language_id", identify), ("near_dedup", remove_duplicates), ("secret_scan", mask_secrets), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir))
        forget(before)
    return STAGES[-1][1](spark, docs, sf_dir)
