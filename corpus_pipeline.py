"""The corpus pipeline: quality rules, near-duplicates, secrets, mixing, packing.

Every stage takes the columns of documents and any others, whatever their names, and
all but the last return them. Nulls: a null text has no words, so the rules reject it; a null doc_id is a
document of its own for each text; a null source is a source. Repeated rows: one of them
stays after the near-duplicates. Rows of one doc_id with other texts are other documents. Ties: the smallest doc_id stays; the rest is
by hashes, so reruns agree. Empty texts and tables: no rows. Very long texts are judged, scanned and packed whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cairn.llm import minhash, mixing, packing, quality, secrets
from cairn.llm.common import drop, settle


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    return quality.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near-duplicates; of repeated rows one stays."""
    return minhash.one_of_each(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts replaced by a mark."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.remix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens and their places in sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("minhash_near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("cube_mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: Shingle hashes, randomness tests and token ids are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
        if before is not None:
            drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
