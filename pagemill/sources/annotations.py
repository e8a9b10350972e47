"""Annotated pages from a file of JSON lines."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagemill.functions.text import py_strip

#: Keys of a record that are fields; all others are kept in ``meta``.
FIELDS = ("id", "image", "regions")
DROPPED = ("Picture",)
_RECORD = "id string, image string, regions array<struct<box:array<double>,text:string,category:string,ink_height:double>>"


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, line) of a text file, or of the files of a folder in the order of their paths, from 0.
    Blocks of the files are counted first, so that lines are numbered where they are read, in as many
    tasks as there are blocks; the running sum is over those few rows, one for each block."""
    try:
        raw = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
    except AnalysisException as e:
        raise FileNotFoundError(path) from e
    counts = raw.groupBy("file", "block").agg(F.count("*").alias("rows"), F.min("n").alias("first"))
    before = F.coalesce(F.sum("rows").over(Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.withColumn("before", before).select("file", "block", (F.col("before") - F.col("first")).alias("shift"))
    return raw.join(starts, ["file", "block"]).select((F.col("n") + F.col("shift")).alias("line_no"), "line")


def parsed(lines: DataFrame, drop_categories: Collection[str] = DROPPED) -> DataFrame:
    """(line_no, page_id, image, regions, meta) of ``lines`` (line_no, line) of JSON."""
    r = F.from_json("line", _RECORD)
    region = lambda x: F.struct(
        *[F.get(x["box"], F.lit(i)).cast("int").alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))],
        py_strip(F.coalesce(x["text"], F.lit(""))).alias("text"), F.coalesce(x["category"], F.lit("Text")).alias("category"), F.coalesce(x["ink_height"], F.lit(0.0)).alias("ink_height"),
    )
    regions = F.transform(F.coalesce(r["regions"], F.array()), region)
    if drop_categories:
        regions = F.filter(regions, lambda x: ~x["category"].isin(*drop_categories))
    meta = F.map_filter(F.from_json("line", "map<string,string>"), lambda k, _: ~k.isin(*FIELDS))
    return lines.select("line_no", F.coalesce(r["id"], F.col("line_no").cast("string")).alias("page_id"), r["image"].alias("image"), regions.alias("regions"), meta.alias("meta"))


def read_annotations(spark: SparkSession, path: str, skip: int = 0, limit: int | None = None, drop_categories: Collection[str] = DROPPED) -> DataFrame:
    """(line_no, page_id, image, regions, meta) of each page.

    Blank lines hold no page but count for ``skip``, which goes by line; ``limit`` goes by pages
    (None: all). A page without an id has its line's number; a region without a category is Text, one
    without text has an empty one, without ink height 0; coordinates lose their fractions.
    """
    lines = numbered_lines(spark, path).where((F.col("line_no") >= skip) & (py_strip(F.col("line")) != ""))
    if limit is not None:
        lines = lines.orderBy("line_no").limit(limit)
    return parsed(lines, drop_categories)


def region_rows(pages: DataFrame) -> DataFrame:
    """A row for each region, with its place in the page's reading order."""
    rows = pages.select("page_id", F.posexplode("regions").alias("region_idx", "r"))
    return rows.select("page_id", F.col("region_idx").cast("long").alias("region_idx"), "r.*")
