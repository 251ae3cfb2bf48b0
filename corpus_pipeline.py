"""A corpus from raw documents: known languages, no near-duplicates, no secrets, mixed sources, token ids.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage
before kept. run() writes each stage's rows as Parquet in the shared folder
and reads them again as the next one's.

Null and empty texts go with the language stage. Rows of a null doc_id are kept
apart by their texts; of repeated rows one is left by the near-duplicate stage,
and mixing repeats rows anew. Other columns pass through all stages but the
last. An empty table stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quernel.llm import bpe, langid, mixing, neardup, secretscan
from quernel.llm.common import documents, forget, materialize

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without letters, or in no language that the labelled rows show, go."""
    return langid.keep_known(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return neardup.keep_one(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, with its secrets masked."""
    return secretscan.mask(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks for, maybe never."""
    return mixing.mix(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per document and copy taken: its token ids, their number, a digest of what they decode to."""
    return bpe.encode_copies(docs, RANKS)


STAGES = [
    ("language ID", known_languages),
    ("near-duplicates", one_of_each),
    ("secrets", without_secrets),
    ("mixing", mixed_sources),
    ("token ids", token_ids),
]

#: No stage but mixing can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, materialize(stage(spark, docs, sf_dir), "stage")
        if i:
            forget(before)
    return STAGES[-1][1](spark, docs, sf_dir)
