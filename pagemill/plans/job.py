"""The whole way of a corpus: source, layout, text, erasing, drawing, files and report."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.functions import text as T
from pagemill.operators import completion, layout, pixels, render, sampling, transforms
from pagemill.plans.registry import Registry
from pagemill.sources import annotations, records
from pagemill.sources import images as image_files

Step = Callable[[DataFrame], DataFrame]
ERASERS, TEXTS = Registry("eraser", "pagemill.erasers"), Registry("text", "pagemill.texts")
SOURCES, TRANSFORMS = Registry("source", "pagemill.sources"), Registry("transform", "pagemill.transforms")
RENDERERS, WRITERS = Registry("renderer", "pagemill.renderers"), Registry("writer", "pagemill.writers")
ERASERS.register("adaptive", lambda: pixels.erased)
ERASERS.register("none", lambda: pixels.kept)
TEXTS.register("keep", lambda: completion.keep)
TEXTS.register("translate", lambda client, model, cache, system="Translate the text into Thai.": lambda rows: completion.translate(rows, client, model, cache, system))
TEXTS.register("synth", lambda client, model, cache, system="Write a Thai text of this kind.": lambda rows: completion.synthesise(rows, client, model, cache, system))
TRANSFORMS.register("keep", lambda: transforms.keep)
TRANSFORMS.register("white-background", lambda: transforms.white_background)
TRANSFORMS.register("stack", lambda margin=transforms.MARGIN, gap=transforms.GAP: lambda images, regions: transforms.stack(images, regions, margin, gap))
SOURCES.register("jsonl", lambda spark, input, skip=0, limit=None: annotations.read_annotations(spark, f"{input}/annotations.jsonl", skip, limit))
RENDERERS.register("font", render.FontRenderer)
RENDERERS.register("glyph", render.GlyphRenderer)
RENDERERS.register("chain", render.Chain)
WRITERS.register("dataset", lambda: records.write_dataset)
WRITERS.register("pages", lambda: records.write_layout)
WRITERS.register("previews", lambda: image_files.previews)


@dataclass(frozen=True)
class Job:
    """``transforms`` map (images, regions) and ``text`` maps a region table and adds ``shown``. Pages of a lower
    share of fitting regions than ``min_fit_rate`` are rejected. A page that has no image, or that cannot be
    drawn, is told in ``failed`` with its error; the others go on."""

    text: Step = completion.keep
    erase: Callable[[DataFrame, DataFrame], DataFrame] = pixels.erased
    transforms: Sequence[transforms.Transform] = ()
    renderer: render.Renderer | None = None
    group: bool = True
    locale: bool = True
    max_side: int = layout.MAX_SIDE
    min_fit_rate: float | None = None
    seed: int = sampling.SEED
    padding: float = 0.1
    size_scale: float = 1.0

    def prepared(self, images: DataFrame, regions: DataFrame) -> DataFrame:
        """Clipped, measured and grouped regions."""
        sizes = images.select("page_id", F.col("width").alias("__w"), F.col("height").alias("__h"))
        clipped = layout.clip(regions.join(sizes, "page_id"), F.col("__w"), F.col("__h")).drop("__w", "__h")
        found = pixels.measured(images, clipped)
        return layout.normalize(found) if self.group else found

    def process(self, pages: DataFrame, images: DataFrame, regions: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(canvases, labels). ``pages`` has (page_id, page_idx); the index decides a page's draws."""
        rows = self.prepared(images, regions)
        sizes = images.select("page_id", F.col("width").alias("__w"), F.col("height").alias("__h"))
        rows = layout.downscale(rows.join(sizes, "page_id"), F.col("__w"), F.col("__h"), self.max_side).drop("__w", "__h")
        images = pixels.downscaled(images.select("page_id", "width", "height", "rgb"), self.max_side)
        for change in self.transforms:
            images, rows = change(images, rows)
        rows = self.text(rows)
        if self.locale:
            drawn = pages.select("page_id", sampling.locale_of(F.col("page_idx"), seed=self.seed).alias("__d"))
            rows = rows.join(drawn, "page_id").withColumn("shown", T.apply_locale(F.col("shown"), F.col("__d.years"), F.col("__d.digits"))).drop("__d")
        erased = self.erase(images, rows).join(pages.select("page_id", "page_idx"), "page_id")
        canvases, done = render.drawn(erased, rows, self.renderer, self.seed, self.padding, self.size_scale)
        labels = rows.join(done, ["page_id", "region_idx"]).withColumnRenamed("text", "source_text").withColumnRenamed("shown", "text")
        return canvases, labels.select("page_id", "region_idx", *layout.BOX, "category", "text", "source_text", "ink_height", "size", "fit", "clusters")

    def run(self, pages: DataFrame, images: DataFrame, regions: DataFrame, out: str, previews: int = 8, boxes: bool = False, clusters: bool = True, page_layout: bool = False, config: dict | None = None) -> dict:
        """Writes images, labels, previews and the report under ``out``; returns the report. Canvases
        and labels are written once and read again by all that follows. ``images`` may say in ``error`` why
        a page has none; ``pages`` may have ``meta``."""
        read = images.sparkSession.read
        lost = images.where("rgb IS NULL").select("page_id", (F.col("error") if "error" in images.columns else F.lit("no image")).alias("error"))
        canvases, labels = self.process(pages, images.where("rgb IS NOT NULL"), regions)
        canvases.write.mode("overwrite").parquet(f"{out}/_canvases")
        canvases = read.parquet(f"{out}/_canvases")
        failed = lost.unionByName(canvases.where("error IS NOT NULL").select("page_id", "error"))
        labels.write.mode("overwrite").parquet(f"{out}/_labels")
        labels = read.parquet(f"{out}/_labels")
        accepted, canvases = labels, canvases.where("error IS NULL").drop("error")
        rejected = labels.select("page_id").limit(0)
        if self.min_fit_rate is not None:
            rejected = layout.fit_rates(labels).where(F.col("fit_rate") < self.min_fit_rate).select("page_id")
            accepted, canvases = (x.join(rejected, "page_id", "left_anti") for x in (labels, canvases))
        written = image_files.write_images(canvases, f"{out}/images").withColumn("file", F.concat(F.lit("images/"), "file"))
        known = canvases.select("page_id", "width", "height", "style").join(pages, "page_id").join(written, "page_id")
        records.write_dataset(accepted, out, known, clusters)
        if page_layout:
            sized = accepted.join(canvases.select("page_id", F.col("width").alias("__w"), F.col("height").alias("__h")), "page_id")
            records.write_layout(sized, out, F.col("__w"), F.col("__h"))
        if previews:
            shown = image_files.previews(pixels.downscaled(images.where("rgb IS NOT NULL").select("page_id", "width", "height", "rgb"), self.max_side), canvases.drop("style"), accepted if boxes else None, previews)
            image_files.write_images(shown, f"{out}/previews")
        report = records.write_report(layout.run_report(labels, self.min_fit_rate), failed, rejected, out, (config or {}) | {"seed": self.seed, "min_fit_rate": self.min_fit_rate})
        return report | {"pages": canvases.count()}
