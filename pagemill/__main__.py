"""Command line: ``run`` a corpus, ``list`` components, show or scan ``fonts``, show a ``glyphs`` bank."""

from __future__ import annotations

import argparse
import json
import logging
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from pagemill.operators import fonts, glyphs, render
from pagemill.plans import job, settings
from pagemill.sources import annotations, fontfiles, images, records


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="pagemill", description=__doc__)
    top.add_argument("-v", "--verbose", action="store_true", help="log what is done")
    sub = top.add_subparsers(dest="command", required=True)
    run = sub.add_parser("run", help="erase and rewrite the pages of a corpus")
    # Names of the flags.
    run.add_argument("--source", default="jsonl", help="where pages come from")
    run.add_argument("--input", required=True, help="folder with annotations.jsonl and its images")
    run.add_argument("--out", required=True, help="folder that all executors share")
    run.add_argument("--limit", type=int)
    run.add_argument("--skip", type=int, default=0)
    run.add_argument("--text", default="keep")
    run.add_argument("--erase", default="adaptive")
    run.add_argument("--renderer", choices=["font", "glyph"], help="glyph if a bank is given, else font")
    run.add_argument("--font", help="path below the fonts folder of the one face of all pages")
    run.add_argument("--fonts-dir", dest="fonts_dir", help="folder of font files by category")
    run.add_argument("--glyph-bank", dest="glyph_bank_dir", help="folder of glyph images by character")
    run.add_argument("--no-fallback", dest="fallback", action="store_false", help="leave texts that the bank does not know without ink")
    run.add_argument("--transform", action="append", default=[], help="page transform; may be given several times")
    run.add_argument("--seed", type=int)
    run.add_argument("--min-fit-rate", type=float)
    run.add_argument("--pagejson", action="store_true", help="also write layout records")
    run.add_argument("--previews", type=int, default=8)
    run.add_argument("--boxes", action="store_true", help="show regions on previews")
    run.add_argument("--no-clusters", dest="clusters", action="store_false", help="labels without cluster boxes")
    run.add_argument("--no-group", dest="group", action="store_false", help="keep regions as annotated")
    run.add_argument("--no-locale", dest="locale", action="store_false", help="keep years and digits")
    for kind in ("source", "text", "renderer"):
        run.add_argument(f"--{kind}-opt", action="append", metavar="KEY=VALUE", help=f"an argument of the {kind}")
    sub.add_parser("list", help="known components")
    font = sub.add_parser("fonts", help="faces and families of each category, or scan a folder to a manifest")
    font.add_argument("action", nargs="?", choices=["show", "scan"], default="show")
    font.add_argument("--dir")
    font.add_argument("--license", default="")
    bank = sub.add_parser("glyphs", help="instances of each character of a bank")
    bank.add_argument("--dir", required=True)
    return top


def renderer_of(spark: SparkSession, a: argparse.Namespace, s: settings.Settings) -> render.Renderer | None:
    """A face bank, a glyph bank, or the glyph bank with faces behind it; None leaves pages erased."""
    opts = settings.options(a.renderer_opt)
    font = glyph = None
    if s.fonts_dir:
        rows = fontfiles.scan_fonts(spark, s.fonts_dir).where(F.size(F.array_except("missing", F.array(*[F.lit(c) for c in fonts.RARE]))) == 0).orderBy("path").collect()
        bank = [(r.path, r.family, r.category, r.weight, r.italic) for r in rows]
        if not bank and not a.font:
            raise ValueError(f"no face under {s.fonts_dir} has all required characters")
        font = job.RENDERERS.build("font", **({"faces": fontfiles.font_files(spark, s.fonts_dir), "bank": bank, "fixed": a.font, "seed": s.seed} | opts))
    if s.glyph_bank_dir:
        glyph = job.RENDERERS.build("glyph", **({"bank": glyphs.loaded(glyphs.scan_bank(spark, s.glyph_bank_dir))} | opts))
    if a.renderer == "glyph" and glyph is None:
        raise ValueError("the glyph renderer needs a bank")
    if a.renderer == "font" or glyph is None:
        return font
    return job.RENDERERS.create("chain", [glyph, font]) if font is not None and a.fallback else glyph


def run(spark: SparkSession, a: argparse.Namespace) -> int:
    """0 if a page was written."""
    s = settings.load(vars(a))
    pages = job.SOURCES.build(a.source, **({"spark": spark, "input": a.input, "skip": a.skip, "limit": a.limit} | settings.options(a.source_opt)))
    found = images.page_images(pages, images.scan_images(spark, a.input), a.input, strict=False)
    text = job.TEXTS.build(a.text, **({"model": s.llm_model, "cache": s.cache_dir} | settings.options(a.text_opt)))
    changes = [job.TRANSFORMS.create(name) for name in a.transform]
    todo = job.Job(text=text, erase=job.ERASERS.create(a.erase), transforms=changes, renderer=renderer_of(spark, a, s), group=a.group, locale=a.locale, min_fit_rate=a.min_fit_rate, seed=s.seed, max_side=s.max_side, padding=s.pad_fraction, size_scale=s.size_scale)
    config = {k: getattr(a, k) for k in ("source", "text", "erase", "renderer", "transform")}
    report = todo.run(pages.select("page_id", F.col("line_no").alias("page_idx"), "meta"), found, annotations.region_rows(pages), a.out, a.previews, a.boxes, a.clusters, a.pagejson, config)
    print(records.summary(report), file=sys.stderr)
    print(json.dumps(report))
    return 0 if report["pages"] else 1


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if a.verbose:
        logging.basicConfig(level=logging.INFO)
    if a.command == "list":
        for registry in (job.SOURCES, job.TRANSFORMS, job.TEXTS, job.ERASERS, job.RENDERERS, job.WRITERS):
            print(f"{registry.kind}: {', '.join(registry)}")
        return 0
    spark = SparkSession.builder.appName("pagemill").getOrCreate()
    try:
        if a.command == "run":
            return run(spark, a)
        if a.command == "fonts" and a.action == "scan":
            if not a.dir:
                raise ValueError("fonts scan needs --dir")
            fontfiles.write_manifest(fontfiles.scan_fonts(spark, a.dir, a.license), f"{a.dir.rstrip('/')}/manifest")
        elif a.command == "fonts":
            fonts.summary(fonts.bank(spark)).orderBy("category").show(100, False)
        else:
            glyphs.scan_bank(spark, a.dir).groupBy("char").count().orderBy("char").show(1000, False)
    except (FileNotFoundError, KeyError, ValueError) as e:
        print(f"pagemill: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
