"""The registered queries of the corpus operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm import bpe, fingerprints, htmlblocks, jaccard, jpeg, langid, mixing, passages, secrets, toxicity
from pagemill.llm.common import fold, table


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def op2_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jpeg.digests(table(spark, sf_dir, "documents"))


def op3_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), 4) == 2
    return langid.predict(docs, langid.train(docs, ~held_out), held_out)


def op5_lstm_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmlblocks.extract(table(spark, sf_dir, "pages"), htmlblocks.train())


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.findings(docs, secrets.train(secrets.labelled_findings(spark), secrets.dictionary(docs)))


def op7_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 3) == 1
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels"), ~held_out), held_out)


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_fingerprints, op2_progressive_jpeg, op3_temperature_mixing, op4_language_id, op5_lstm_extraction, op6_secret_scan, op7_compact_windows, op8_toxicity, op9_jaccard_join, op10_byte_bpe)
    return {f.__name__: f for f in found}


#: Brute force over sets of word shingles: pairs that share one are compared, links are followed.
_JACCARD = r"""WITH RECURSIVE w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS l FROM documents),
 s AS (SELECT doc_id, CASE WHEN t = '' THEN [] WHEN len(l) = 0 THEN ['c:' || t] WHEN len(l) < 5 THEN ['w:' || array_to_string(l, ' ')]
  ELSE list_distinct(list_transform(range(1, len(l) - 3), lambda i: array_to_string(l[i:i + 4], ' '))) END AS sh FROM w),
 k AS (SELECT doc_id, sh, md5(array_to_string(list_sort(sh), '|')) AS h FROM s),
 c AS (SELECT h, min(doc_id) AS copy_of, count(*) AS n_copies FROM k GROUP BY h),
 n AS (SELECT c.copy_of AS node, k.sh, len(k.sh) AS size FROM c JOIN k ON k.doc_id = c.copy_of),
 e AS (SELECT node, unnest(sh) AS x FROM n),
 p AS (SELECT a.node AS a, b.node AS b, count(*) AS m FROM e a JOIN e b ON a.x = b.x AND a.node < b.node GROUP BY ALL),
 links AS (SELECT a, b FROM p JOIN n x ON x.node = a JOIN n y ON y.node = b WHERE m >= 0.8 * (x.size + y.size - m)),
 ends AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
 reach AS (SELECT copy_of AS node, copy_of AS top FROM c UNION SELECT ends.b, reach.top FROM reach JOIN ends ON ends.a = reach.node)
 SELECT k.doc_id, (SELECT min(top) FROM reach WHERE reach.node = c.copy_of) AS class_id, c.copy_of, c.n_copies, (SELECT count(*) FROM ends WHERE ends.a = c.copy_of) AS n_links FROM k JOIN c USING (h)"""


def oracle_sql() -> dict[str, str]:
    return {"op9_jaccard_join": _JACCARD}
