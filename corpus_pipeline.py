"""A corpus from raw documents to tokens: language ID, exact dedup, near dedup, mixing, encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from faktum.llm import bpe, exact_dedup, langid, mixing, ngram_join
from faktum.llm.store import released, saved


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; all columns stay, and no row is changed.

    Null, empty and letterless texts go. Repeated rows all stay or all go. An empty table gives no rows; if no row has a
    language to learn from, none stays. Very long texts are labelled whole. Other columns may have any names.
    """
    return langid.keep_identified(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text: that of the largest doc_id, a null doc_id last; all columns stay.

    Null and empty texts are one text. Of rows that are equal in doc_id and text one stays. Texts are compared whole. An
    empty table gives no rows. Other columns may have any names and aren't compared.
    """
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component: that of the smallest doc_id, a null doc_id last; all columns stay.

    Texts without words are linked with nothing and stay, but for rows that are equal in doc_id and text, of which one stays. Rows
    of one doc_id with different texts are told apart. An empty table gives no rows. Other columns may have any names.
    """
    return ngram_join.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents and parts of documents, each as often as the mix takes it, with the columns of docs; n_chars is that of the text given.

    Documents without words aren't taken. A null source is a source; ties and repeated rows count one by one; a very long document
    lies in many blocks. An empty table gives no rows. Other columns may have any names.
    """
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what the mix gave: doc_id, n_tokens, ids_sha256, decoded_sha256, a row for each row.

    Null counts as empty. Repeated rows give repeated rows, an empty table none; other columns aren't read.
    """
    return bpe.digest(docs)


STAGES = [
    ("language ID", identify_language),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing", mix_sources),
    ("BPE", encode),
]
#: The first stage is a trained model, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        released(before)
    return STAGES[-1][1](spark, docs, sf_dir)
