"""A corpus pipeline: language ID, exact and near deduplication, decontamination, tokenisation.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; the next one gets it written and
read again. All but the last keep the columns of ``documents``.
"""

from pyspark.sql import DataFrame, SparkSession

from sightlake.llm import byte_bpe, decontaminate, exact_dedup, language_id, simhash
from sightlake.llm.common import table, tuned
from sightlake.session import materialize


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the models accept."""
    return language_id.keep_identified(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest id."""
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicates the document with the smallest id."""
    return simhash.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text: doc_id, lang, source, ids (4 bytes each, little-endian), n_tokens."""
    return byte_bpe.tokenised(docs)


STAGES = [
    ("language_id", identify), ("exact_dedup", drop_copies), ("simhash_dedup", drop_near_copies),
    ("decontaminate", drop_leaks), ("byte_bpe", tokenise),
]
ORACLE_SQL = None  # models, fingerprints and merges have no SQL form; tests compare with a plain version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(tuned(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
