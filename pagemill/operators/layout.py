"""Regions of a page: clipping, grouping, sizing, placement and normalised records.

A region table has (page_id, region_idx, x1, y1, x2, y2, text, category, ink_height); boxes are
integer pixels, right and lower edges exclusive. The order of ``region_idx`` is the reading order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions.text import py_strip

#: Gap of columns, tolerances of wrapped lines, least side, largest page.
COLUMN_GAP, MIN_SIDE, MAX_SIDE = 30, 3, 2600
SAME_EDGE, SAME_SPAN, LEAST_GAP, MOST_GAP = 8, 0.6, -3, 0.6
SMALL_SLACK, UNIT = 12, 1000
BOX = ("x1", "y1", "x2", "y2")


def clip(regions: DataFrame, width: Column, height: Column, min_side: int = MIN_SIDE) -> DataFrame:
    """Boxes clamped to the page; without blank texts and boxes of a side under ``min_side``."""
    clamp = lambda c, most: F.greatest(F.lit(0), F.least(F.col(c), most)).cast("int")
    out = regions.withColumns({"x1": clamp("x1", width), "y1": clamp("y1", height), "x2": clamp("x2", width), "y2": clamp("y2", height)})
    return out.where((py_strip(F.col("text")) != "") & (F.col("x2") - F.col("x1") >= min_side) & (F.col("y2") - F.col("y1") >= min_side))


def union_boxes(regions: DataFrame, *by: str) -> DataFrame:
    """One region for each group: the enclosing box, the texts in order, the first category and the
    least known ink height."""
    pos = "region_idx"
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(pos, "text"))), lambda s: s["text"]), " ")
    return regions.groupBy(*by).agg(
        F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"),
        py_strip(texts).alias("text"), F.min_by("category", pos).alias("category"),
        F.coalesce(F.min(F.nullif(F.col("ink_height"), F.lit(0.0))), F.lit(0.0)).alias("ink_height"),
    )


def row_segments(words: DataFrame, *row: str, gap: int = COLUMN_GAP) -> DataFrame:
    """Numbers the segments of a row: a new one begins after a gap of more than ``gap``."""
    w = Window.partitionBy(*row).orderBy("x1", "region_idx")
    new = F.when(F.col("x1") - F.lag("x2").over(w) > gap, 1).otherwise(0)
    return words.withColumn("__new", new).withColumn("segment", F.sum("__new").over(w).cast("long")).drop("__new")


_FIELDS = (*BOX, "text", "category", "ink_height")


def _union_of(members: list[tuple]) -> tuple:
    """The union of regions (x1, y1, x2, y2, text, category, ink_height), in their order."""
    inks = [m[6] for m in members if m[6]]
    text = " ".join(m[4] for m in members if m[4] is not None).strip()
    return min(m[0] for m in members), min(m[1] for m in members), max(m[2] for m in members), max(m[3] for m in members), text, members[0][5], min(inks, default=0.0)


def _folded(regions: DataFrame, order: Callable[[tuple], tuple], fold: Callable[[list[tuple]], Iterable[list[tuple]]], gathered: bool) -> DataFrame:
    """The unions of the groups that ``fold`` makes of each page's regions, numbered as they come. Pages are
    read one after the other from a sorted partition, so a task holds the regions of one page. If ``gathered``,
    a page's regions stand together already, in one partition, and are not shuffled."""
    kind = regions.schema["page_id"].dataType.simpleString()
    placed = regions.select("page_id", *[F.col(c).cast("int").alias(c) for c in BOX], "text", "category", F.coalesce(F.col("ink_height").cast("double"), F.lit(0.0)).alias("ink_height"), "region_idx")
    if not gathered:
        placed = placed.repartition("page_id").sortWithinPartitions("page_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page, held, done = None, [], []

        def ordered(items: list[tuple]) -> list[tuple]:
            items.sort(key=lambda m: (*order(m), m[7] is not None, m[7]))  # without an index first
            return [m[:7] for m in items]

        def whole() -> pa.RecordBatch:
            out = [(p, k, *_union_of(g)) for p, items in done for k, g in enumerate(fold(ordered(items)))]
            done.clear()
            cols = zip(*out, strict=True) if out else [[]] * 9
            types = [schema, pa.int64(), *[pa.int32()] * 4, pa.string(), pa.string(), pa.float64()]
            return pa.record_batch([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["page_id", "region_idx", *_FIELDS])

        schema = None
        for batch in batches:
            schema = batch.schema.field("page_id").type
            for key, *item in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and key != page:
                    done.append((page, held))
                    held = []
                page = key
                held.append(tuple(item))
            yield whole()
        if held:
            done.append((page, held))
            yield whole()

    return placed.mapInArrow(run, f"page_id {kind}, region_idx long, x1 int, y1 int, x2 int, y2 int, text string, category string, ink_height double")


def _rows_of(items: list[tuple], column_gap: int) -> list[list[tuple]]:
    """Each region with the first row of its category that it overlaps by half of the lower height; rows, in
    the order in which they began, are split where a gap is wider than ``column_gap``."""
    lowest, ahead = [0] * len(items), 1 << 62
    for k in range(len(items) - 1, -1, -1):
        ahead = lowest[k] = min(ahead, items[k][1])
    rows: list[list] = []  # [y1, y2, category, members]
    open_: list[list] = []
    for item, least in zip(items, lowest, strict=True):
        while open_ and open_[0][1] < least:  # no region to come reaches up to it
            open_.pop(0)
        _, y1, _, y2, _, category, _ = item
        for row in open_:
            if row[2] == category and min(row[1], y2) - max(row[0], y1) >= 0.5 * min(y2 - y1, row[1] - row[0]):
                row[0], row[1] = min(row[0], y1), max(row[1], y2)
                row[3].append(item)
                break
        else:
            rows.append([y1, y2, category, [item]])
            open_.append(rows[-1])
    out = []
    for *_, members in rows:
        members.sort(key=lambda m: m[0])
        begin = 0
        for k in range(1, len(members) + 1):
            if k == len(members) or members[k][0] - members[k - 1][2] > column_gap:
                out.append(members[begin:k])
                begin = k
    return out


def group_rows(regions: DataFrame, column_gap: int = COLUMN_GAP, gathered: bool = False) -> DataFrame:
    """Words or fragments joined to lines, a page at a time, in order of vertical centre, then of left edge.
    First fit depends on what rows have become, so this is a fold over the page's sorted regions. ``gathered``
    says that each page's regions stand together in one partition."""
    return _folded(regions, lambda m: (m[1] + m[3], m[0]), lambda items: _rows_of(items, column_gap), gathered)


def _blocks_of(items: list[tuple]) -> list[list[tuple]]:
    out: list[list[tuple]] = []
    box, height = (0, 0, 0), 0  # left, right and lower edge of the last block; height of its last line
    for item in items:
        x1, y1, x2, y2, _, category, _ = item
        joins = False
        if out and out[-1][0][5] == category:
            left, right, low = box
            narrow = max(min(x2 - x1, right - left), 1)
            aligned = abs(x1 - left) <= SAME_EDGE or (min(x2, right) - max(x1, left)) / narrow > SAME_SPAN
            joins = aligned and LEAST_GAP <= y1 - low <= MOST_GAP * max(y2 - y1, height, 1)
        if joins:
            out[-1].append(item)
            box = min(box[0], x1), max(box[1], x2), max(box[2], y2)
        else:
            out.append([item])
            box = x1, x2, y2
        height = y2 - y1
    return out


def merge_wrapped(regions: DataFrame, gathered: bool = False) -> DataFrame:
    """Lines of one paragraph joined to a block: each is compared with the last block as it has
    become, and with the height of its last single line."""
    return _folded(regions, lambda m: (m[1], m[0]), _blocks_of, gathered)


def normalize(regions: DataFrame) -> DataFrame:
    return merge_wrapped(group_rows(regions), gathered=True)


def downscale(regions: DataFrame, width: Column, height: Column, max_side: int = MAX_SIDE) -> DataFrame:
    """Boxes and ink heights of pages that are shrunk to ``max_side``; half goes to even."""
    scale = F.when(F.greatest(width, height) > max_side, F.lit(float(max_side)) / F.greatest(width, height)).otherwise(F.lit(1.0))
    return regions.withColumns({c: F.rint(F.col(c) * scale).cast("int") for c in BOX} | {"ink_height": F.col("ink_height") * scale})


def start_size(ink_height: Column, scale: float = 0.95) -> Column:
    """The size that drawing starts from; null where the ink height is not known."""
    return F.nullif(F.rint(ink_height * scale).cast("int"), F.lit(0))


def zip_strict(left: DataFrame, right: DataFrame, *on: str) -> DataFrame:
    """Rows of both sides by position (``on``); a position that one side lacks is an error."""
    l, r = left.withColumn("__l", F.lit(True)), right.withColumn("__r", F.lit(True))  # noqa: E741
    both = l.join(r, list(on), "full")
    even = F.when(F.col("__l").isNull() | F.col("__r").isNull(), F.raise_error(F.concat(F.lit("sides of different lengths: "), F.concat_ws("/", *[F.col(c).cast("string") for c in on]))).cast("boolean")).otherwise(F.lit(True))
    return both.where(even).drop("__l", "__r")


def request_size(side: Column, padding: Column) -> Column:
    return F.greatest(F.lit(4), F.rint(side * (1 - padding)).cast("int"))


def place(regions: DataFrame, ink_w: Column, ink_h: Column, padding: float) -> DataFrame:
    """Where ink goes in its box (columns ``x``, ``y``) and whether it fits (``fit``)."""
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    slack = h - ink_h
    low = F.when((slack >= 0) & (slack <= SMALL_SLACK), F.floor(slack / 2)).otherwise(F.greatest(F.lit(1), F.rint(h * padding / 2).cast("long")))
    return regions.withColumns({"x": (F.col("x1") + F.greatest(F.lit(0), F.floor((w - ink_w) / 2))).cast("long"), "y": (F.col("y1") + low).cast("long"), "fit": (ink_w <= w + 1) & (ink_h <= h + 1)})


def stack(regions: DataFrame, margin: int = 40, gap: int = 24) -> DataFrame:
    """Each region's top in a single column in reading order."""
    w = Window.partitionBy("page_id").orderBy("region_idx").rowsBetween(Window.unboundedPreceding, -1)
    return regions.withColumn("top", (F.lit(margin) + F.coalesce(F.sum(F.col("y2") - F.col("y1") + gap).over(w), F.lit(0))).cast("long"))


def page_records(regions: DataFrame, width: Column, height: Column) -> DataFrame:
    """A layout item for each region with text: its box in thousandths of the page, and its rank
    from top to bottom, then left to right (column ``place``)."""
    part = lambda c, side: F.rint(F.col(c) * UNIT / side).cast("int")
    w = Window.partitionBy("page_id").orderBy("y1", "x1", "region_idx")
    rows = regions.where(py_strip(F.col("text")) != "").withColumn("place", F.row_number().over(w).cast("long") - 1)
    return rows.select("page_id", "place", part("x1", width).alias("x1"), part("y1", height).alias("y1"), part("x2", width).alias("x2"), part("y2", height).alias("y2"), "category", "text")


def fit_rates(labels: DataFrame) -> DataFrame:
    """(page_id, fit_rate, regions): the share of regions that fit."""
    return labels.groupBy("page_id").agg(F.avg(F.col("fit").cast("double")).alias("fit_rate"), F.count("*").alias("regions"))


def run_report(labels: DataFrame, min_fit_rate: float | None = None) -> DataFrame:
    """One row: pages, regions, fitted, empty, rejected pages and the rate over all regions (1.0 if
    there are none). Rejected pages count in no other column."""
    pages = labels.groupBy("page_id").agg(F.count("*").alias("n"), F.count_if("fit").alias("ok"), F.count_if(py_strip(F.col("text")) == "").alias("blank"))
    out = F.lit(False) if min_fit_rate is None else F.col("ok") / F.col("n") < min_fit_rate
    total = lambda c: F.coalesce(F.sum(F.when(~out, F.col(c))), F.lit(0)).cast("long")
    sums = pages.agg(F.count_if(~out).alias("pages"), total("n").alias("regions"), total("ok").alias("fitted"), total("blank").alias("empty"), F.count_if(out).alias("rejected"))
    return sums.withColumn("fit_rate", F.coalesce(F.try_divide(F.col("fitted"), F.col("regions")), F.lit(1.0)))


def fit_size(width: Column, height: Column, chars: Column, start: int = 24, floor: int = 6) -> Column:
    """The largest size at which so many characters, half a size wide each, wrap into the box with
    lines 1.25 sizes high; the floor if none does."""
    sizes = F.sequence(F.lit(start), F.lit(floor), F.lit(-1))
    per_line = lambda s: F.floor(width * 2 / s)
    ok = F.filter(sizes, lambda s: (per_line(s) >= 1) & (F.ceil(chars / F.greatest(per_line(s), F.lit(1))) * s * 1.25 <= height))
    return F.coalesce(F.get(ok, F.lit(0)), F.lit(floor)).cast("int")


def wrap(text: Column, width: int) -> Column:
    """Greedy lines of at most ``width`` characters (their final space not counted); the space at a
    break stays on its line; a longer word has a line of its own."""
    tokens = F.regexp_extract_all(text, F.lit(r"(\S+\s?|\s)"), F.lit(1))
    start = F.array().cast("array<string>")

    def add(lines: Column, t: Column) -> Column:
        last = F.element_at(lines, -1)
        fits = (F.size(lines) > 0) & (F.length(F.rtrim(F.concat(last, t))) <= width)
        return F.when(fits, F.array_append(F.slice(lines, 1, F.size(lines) - 1), F.concat(last, t))).otherwise(F.array_append(lines, t))

    return F.aggregate(tokens, start, add)
