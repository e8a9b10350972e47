"""Label records as JSON lines, layout records of a page, and the report of a run.

All are written as part files of folders by as many tasks as there are: ``labels``, ``pages``, ``info``,
``report``, ``failed``, ``rejected``.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.operators import layout

FORMAT = "pagemill/v1"
#: Ids of failed and rejected pages that a report names; the folders have all.
NAMED = 5


def _meta(meta: Column, style: Column, index: Column) -> Column:
    """One JSON object of the page's own entries, its style and its index; the last two win over own entries."""
    own = F.map_filter(F.coalesce(meta, F.create_map().cast("map<string,string>")), lambda k, _: ~k.isin("style", "index"))
    inner = F.regexp_replace(F.to_json(own), r"^\{|\}$", "")
    return F.concat(F.lit("{"), inner, F.when(inner == "", "").otherwise(","), F.lit('"style":'), F.coalesce(F.to_json(style), F.lit("{}")), F.lit(',"index":'), F.coalesce(index.cast("string"), F.lit("null")), F.lit("}"))


def label_records(labels: DataFrame, pages: DataFrame | None = None, clusters: bool = True) -> DataFrame:
    """(page_id, record): a page's labels in reading order, with its fit rate to four digits (half to even).

    ``pages`` (page_id, file, width, height and perhaps meta, style, page_idx) adds the image and what is known
    of the page; a page of several rows there has a record for each. Without ``clusters`` their boxes are left out.
    """
    box = lambda c: F.array(*[c[k] for k in layout.BOX])
    has = set(labels.columns)
    fields = [F.array(*layout.BOX).alias("box"), "category", "text", "source_text", *[c for c in ("size",) if c in has], "fit"]
    if clusters and "clusters" in has:
        fields.append(F.transform("clusters", lambda c: F.struct(c["text"].alias("text"), box(c["box"]).alias("box"))).alias("clusters"))
    grouped = labels.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("region_idx", F.struct(*fields).alias("r")))).alias("items"), F.bround(F.avg(F.col("fit").cast("double")), 4).alias("fit_rate"))
    regions = F.to_json(F.transform("items", lambda s: s["r"]))
    if pages is None:
        head = F.struct(F.col("page_id").alias("id"), "fit_rate")
        return grouped.select("page_id", F.concat(F.regexp_replace(F.to_json(head), r"\}$", ""), F.lit(',"regions":'), regions, F.lit("}")).alias("record"))
    optional = lambda c, kind: F.col(c) if c in pages.columns else F.lit(None).cast(kind)
    known = pages.select("page_id", "file", "width", "height", _meta(optional("meta", "map<string,string>"), optional("style", "map<string,string>"), optional("page_idx", "long")).alias("meta"))
    joined = known.join(grouped, "page_id", "left")
    head = F.struct(F.col("page_id").alias("id"), F.col("file").alias("image"), "width", "height", F.coalesce("fit_rate", F.lit(1.0)).alias("fit_rate"))
    return joined.select("page_id", F.concat(F.regexp_replace(F.to_json(head), r"\}$", ""), F.lit(',"meta":'), "meta", F.lit(',"regions":'), F.coalesce(regions, F.lit("[]")), F.lit("}")).alias("record"))


def write_dataset(labels: DataFrame, path: str, pages: DataFrame | None = None, clusters: bool = True) -> None:
    """``labels`` as JSON lines and ``info`` with the number of pages, in part files under ``path``."""
    records = label_records(labels, pages, clusters)
    records.select("record").write.mode("overwrite").text(f"{path}/labels")
    written = labels.sparkSession.read.text(f"{path}/labels")
    info = written.agg(F.to_json(F.struct(F.count("*").alias("pages"), F.lit(FORMAT).alias("format"))).alias("value"))
    info.write.mode("overwrite").text(f"{path}/info")


def layout_records(labels: DataFrame, width: Column, height: Column) -> DataFrame:
    """(page_id, record): the boxes of a page's texts in thousandths of it, from top to bottom."""
    rows = layout.page_records(labels, width, height)
    item = F.struct("place", F.struct(F.array(*layout.BOX).alias("bbox"), "category", "text").alias("r"))
    pages = rows.groupBy("page_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    return pages.select("page_id", F.to_json(F.struct(F.col("page_id").alias("id"), F.transform("items", lambda s: s["r"]).alias("layout"))).alias("record"))


def write_layout(labels: DataFrame, path: str, width: Column, height: Column) -> None:
    layout_records(labels, width, height).select("record").write.mode("overwrite").text(f"{path}/pages")


def write_report(report: DataFrame, failed: DataFrame, rejected: DataFrame, path: str, config: Mapping[str, Any]) -> dict:
    """Writes ``failed`` (page_id, error) and ``rejected`` (page_id) whole, and a report that counts them, names
    the first few and says how the run was set up; returns the report."""
    failed.write.mode("overwrite").json(f"{path}/failed")
    rejected.write.mode("overwrite").json(f"{path}/rejected")
    spark = report.sparkSession
    first = lambda kind: [str(r.page_id) for r in spark.read.schema("page_id string").json(f"{path}/{kind}").orderBy("page_id").limit(NAMED).collect()]
    out = report.first().asDict() | {"failed": spark.read.text(f"{path}/failed").count(), "failed_ids": first("failed"), "rejected_ids": first("rejected"), "config": dict(config)}
    spark.createDataFrame([(json.dumps(out, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/report")
    return out


def summary(report: Mapping[str, Any]) -> str:
    """A report in a few lines."""
    lines = [f"pages     {report['pages']}", f"regions   {report['regions']} ({report['empty']} empty)", f"fit rate  {report['fit_rate']:.1%}"]
    if report.get("rejected"):
        lines.append(f"rejected  {report['rejected']}: {', '.join(report.get('rejected_ids', []))}")
    if report.get("failed"):
        lines.append(f"failed    {report['failed']}: {', '.join(report.get('failed_ids', []))}")
    return "\n".join(lines)
