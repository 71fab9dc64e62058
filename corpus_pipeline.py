"""Documents to training batches: toxicity, near duplicates, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on every row that its predecessor kept; all but the
last return the columns of documents, whatever further ones there are and however they are called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scorelake.llm import minhash, mixing, packing, pii, toxicity
from scorelake.llm._common import staged, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the toxicity classifier doesn't reject, as they were.

    Null and empty texts, null ids and repeated rows stay as they come; of repeated toxic rows all go.
    Labels may be missing, null or repeated (toxic if any says so). An empty table stays empty.
    """
    return toxicity.reject(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the least id.

    Rows with a null id or text, or a text without a word, stay; rows repeated under one id all stay or
    go together. An empty table stays empty.
    """
    return minhash.deduplicate(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with personal data replaced by its kind in angle brackets and n_chars as the text's length then.

    Null and empty texts stay as they are, as does every text without a finding.
    """
    return pii.redact(docs)


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its rate says, so that tokens by domain come to the target weights.

    A null text has no tokens and counts by the classifier's prior; repeated rows have equal rates, and
    of documents that differ in their ids alone some may come once more than others. An empty table
    stays empty.
    """
    return mixing.resample(docs, table(spark, sf_dir, "labels"))


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, bucket_len, batch, slot): a place for every row; a null or blank text counts one token.

    Rows of equal length go by id, nulls first, and rows that are repeated each have a slot. An empty
    table gives no row.
    """
    return packing.pack(packing.measured(docs))


STAGES = [
    ("toxicity", reject_toxic),
    ("minhash", drop_near_duplicates),
    ("pii", redact_personal_data),
    ("mixing", mix_domains),
    ("packing", pack_batches),
]

#: Trained models and searches have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
