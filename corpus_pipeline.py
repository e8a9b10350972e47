"""A training corpus from raw documents: five stages, each written as Parquet and read again.

1. language ID: documents whose language is not known well enough go
2. n-gram Jaccard join: one document of each group of near copies stays
3. secret scans: values of secrets are masked
4. temperature mixing: each document appears as often as its source's weight asks for, once at least
5. byte-level BPE: token ids of each document, as little-endian unsigned 32-bit integers
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm import bpe, jaccard, langid, mixing, secrets
from pagemill.llm.common import cut, fold, table

#: The least share of a text's n-grams that its language must contain.
LEAST_SCORE = 0.3
#: No stage but the second half of the fourth can be said in SQL: models and hashes decide.
ORACLE_SQL = None


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.accepted(docs, langid.train(docs, fold(F.col("doc_id"), 4) != 2), LEAST_SCORE)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redacted(docs, secrets.train(secrets.labelled_findings(spark), secrets.dictionary(docs)))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.drawn(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ids = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return ids.select("doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("language_id", identify),
    ("near_duplicates", deduplicate),
    ("secret_scan", mask_secrets),
    ("mixing", mix),
    ("byte_bpe", tokenise),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, name)
    return docs
