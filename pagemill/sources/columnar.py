"""Layout corpora in Parquet: a row for each page, its lines in arrays of equal length."""

from __future__ import annotations

from collections.abc import Collection, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.text import py_strip

DROPPED = ("Picture", "Formula")


def corner_box(box: Column, width: Column, height: Column) -> list[Column]:
    """(x1, y1, x2, y2) inside the page of a box given as x, y, width and height, without fractions."""
    x, y, w, h = (F.get(box, F.lit(i)) for i in range(4))
    return [F.greatest(F.lit(0), x.cast("int")).alias("x1"), F.greatest(F.lit(0), y.cast("int")).alias("y1"), F.least(width, (x + w).cast("int")).alias("x2"), F.least(height, (y + h).cast("int")).alias("y2")]


def columnar_pages(rows: DataFrame, names: Sequence[str], source: str, skip: int = 0, limit: int | None = None, drop_categories: Collection[str] = DROPPED) -> DataFrame:
    """(page_id, width, height, regions, meta) of ``rows`` with columns (index, page_hash, width, height,
    texts, boxes, categories, doc_category, page_no).

    ``names`` are the categories' names by number. Arrays of different lengths raise an error; null
    arrays count as empty; a category without a name and a blank text drop the region. ``skip`` and
    ``limit`` (None: all) go by ``index``, the row's place in the corpus.
    """
    chosen = rows.where(F.col("index") >= skip)
    if limit is not None:
        chosen = chosen.where(F.col("index") < skip + limit)
    lists = [F.coalesce(F.col(c), F.array().cast(rows.schema[c].dataType)) for c in ("texts", "boxes", "categories")]
    even = (F.size(lists[0]) == F.size(lists[1])) & (F.size(lists[0]) == F.size(lists[2]))
    zipped = F.when(even, F.arrays_zip(*[c.alias(n) for c, n in zip(lists, "tbc", strict=True)])).otherwise(F.raise_error(F.concat(F.lit("arrays of different lengths: row "), F.col("index"))).cast("void"))
    name = lambda c: F.get(F.array(*[F.lit(n) for n in names]), c.cast("int"))
    region = lambda z: F.struct(
        *corner_box(z["b"], F.col("width"), F.col("height")), py_strip(F.coalesce(z["t"], F.lit(""))).alias("text"), name(z["c"]).alias("category"), F.lit(0.0).alias("ink_height")
    )
    wanted = lambda r: (r["text"] != "") & r["category"].isNotNull() & ~r["category"].isin(*drop_categories)
    meta = F.create_map(F.lit("source"), F.lit(source), F.lit("doc_category"), F.col("doc_category").cast("string"), F.lit("page_no"), F.col("page_no").cast("string"))
    page_id = F.coalesce(F.substring("page_hash", 1, 16), F.col("index").cast("string"))
    return chosen.select("index", page_id.alias("page_id"), "width", "height", F.filter(F.transform(zipped, region), wanted).alias("regions"), meta.alias("meta"))
