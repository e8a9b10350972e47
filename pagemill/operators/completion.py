"""Texts for regions: kept, translated or made by a completion service that the caller supplies.

A client is a function (system, user) -> reply. Prompts are asked once each, whatever the number of
regions that need them, and replies are kept in a Parquet cache by the hash of model and prompts.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions import text as T

Client = Callable[[str, str], str]
#: Calls at a time of a task, tries of a prompt.
CONCURRENCY, TRIES = 8, 4
CACHE = "namespace string, key string, value string"
#: Code points of context, and regions it is taken from.
CONTEXT_CHARS, CONTEXT_REGIONS = 400, 6


def key_of(model: str, system: Column, user: Column) -> Column:
    return T.cache_key(F.lit(model), system, user)


def asked(client: Client, system: str, user: str, tries: int = TRIES, pause: Callable[[float], None] = time.sleep) -> str:
    """A stripped reply; after ``tries`` failures, with waits of 1, 2, 4 ... seconds between, nothing."""
    for k in range(tries):
        if k:
            pause(2.0 ** (k - 1))
        try:
            return (client(system, user) or "").strip()
        except Exception:  # noqa: BLE001 - whatever the service raises, one region stays without a reply
            continue
    return ""


def _cached(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(CACHE).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CACHE)


def unknown(wanted: DataFrame, cached: DataFrame, key: str) -> DataFrame:
    """The rows of ``wanted`` whose key the cache lacks."""
    return wanted.join(cached.select(key).distinct(), key, "left_anti")


def complete(prompts: DataFrame, client: Client, model: str, cache: str, namespace: str = "chat", tasks: int = 8, tries: int = TRIES) -> DataFrame:
    """``prompts`` with (system, user) and a ``reply``: from the cache, or asked now and then cached.

    At most ``tasks`` x ``CONCURRENCY`` calls are open at a time. Prompts that failed have an empty reply
    and are not cached, so that the next run asks again; a null prompt has an empty reply.
    """
    spark = prompts.sparkSession
    keyed = prompts.withColumn("__key", key_of(model, F.col("system"), F.col("user")))
    known = _cached(spark, cache).where(F.col("namespace") == namespace).select(F.col("key").alias("__key"))
    new = unknown(keyed.where("__key IS NOT NULL").select("__key", "system", "user").dropDuplicates(["__key"]), known, "__key")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(CONCURRENCY) as pool:
            for rows in batches:
                replies = list(pool.map(lambda p: asked(client, *p, tries=tries), zip(rows.system, rows.user, strict=True)))
                yield pd.DataFrame({"namespace": namespace, "key": rows["__key"], "value": replies})

    new.repartition(tasks).mapInPandas(run, CACHE).where("value <> ''").write.mode("append").parquet(cache)
    known = _cached(spark, cache).where(F.col("namespace") == namespace).groupBy(F.col("key").alias("__key")).agg(F.min("value").alias("__value"))
    return keyed.join(known, "__key", "left").withColumn("reply", F.coalesce("__value", F.lit(""))).drop("__key", "__value")


def with_context(regions: DataFrame) -> DataFrame:
    """``regions`` with ``context``: the texts of the page's first regions, cut to a bounded length."""
    item = F.struct("region_idx", "text")
    first = F.transform(F.slice(F.array_sort(F.collect_list(item)), 1, CONTEXT_REGIONS), lambda s: s["text"])
    pages = regions.where(F.col("region_idx").isNotNull()).groupBy("page_id").agg(F.substring(F.array_join(first, " | "), 1, CONTEXT_CHARS).alias("context"))
    return regions.join(pages, "page_id", "left")


def keep(regions: DataFrame) -> DataFrame:
    """Shown as they are."""
    return regions.withColumn("shown", F.coalesce("text", F.lit("")))


def translate(regions: DataFrame, client: Client, model: str, cache: str, system: str, **options: int) -> DataFrame:
    """Regions with words are translated; garbage shows nothing; numbers, replies that run away and
    failed ones show the source or, as the gate says, nothing."""
    t = F.coalesce(F.col("text"), F.lit(""))
    ask = (T.py_strip(t) != "") & ~T.looks_like_garbage(t) & T.has_words(t)
    rows = regions.withColumns({"text": t, "system": F.when(ask, F.lit(system)), "user": F.when(ask, t)})
    replied = complete(rows, client, model, cache, "translate", **options)
    return replied.withColumn("shown", T.translate_gate(F.col("text"), F.col("reply"))).drop("system", "user", "reply")


def synthesise(regions: DataFrame, client: Client, model: str, cache: str, system: str, **options: int) -> DataFrame:
    """A made text for each region that has one, asked for by category, length and the page's context."""
    t = F.coalesce(F.col("text"), F.lit(""))
    user = F.concat(F.lit("Category: "), F.col("category"), F.lit("\nLength: about "), F.length(t), F.lit(" characters\nContext: "), F.coalesce("context", F.lit("")))
    rows = with_context(regions.withColumn("text", t))
    rows = rows.withColumns({"system": F.when(T.py_strip(t) != "", F.lit(system)), "user": F.when(T.py_strip(t) != "", user)})
    return complete(rows, client, model, cache, "synth", **options).withColumn("shown", T.clean_reply(F.col("reply"))).drop("system", "user", "reply", "context")
