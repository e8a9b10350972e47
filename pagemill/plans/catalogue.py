"""All registered queries of the document-reconstruction engine, with their SQL."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagemill.functions import text as T
from pagemill.operators import completion, fonts, layout, pixels, render, sampling, transforms, typeface
from pagemill.sources import annotations, columnar, records
from pagemill.sources import images as image_files

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
WIDTH, HEIGHT = 1025, 1100
_SLICE = 1 << 20  # bytes of lines that are cut into words at a time


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- derived inputs: lines, regions and words of documents ------------------------------------


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


def page_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, pos = F.length("line"), F.col("pos")
    x1, y1 = 40 + pos % 3 * 4, 30 + pos * 22 + F.floor(pos / 5) * 20
    return lines(spark, sf_dir).where(n > 0).select(
        F.col("doc_id").alias("page_id"), pos.cast("long").alias("region_idx"),
        x1.cast("long").alias("x1"), y1.cast("long").alias("y1"), (x1 + F.least(n * 7, F.lit(900))).cast("long").alias("x2"), (y1 + 18).cast("long").alias("y2"),
        F.col("line").alias("text"), F.when(pos == 0, "Title").when(n < 30, "Caption").otherwise("Text").alias("category"),
        F.when(pos == 0, 24.0).otherwise(14.0).alias("ink_height"),
    )


def page_words(spark: SparkSession, sf_dir: str, gathered: bool = False) -> DataFrame:
    """Words of the lines, 7 pixels a character, with a wide gap after every eighth; if ``gathered``, those of a
    page together. Only the texts are shuffled for that, before they are cut into words."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    if gathered:
        docs = docs.repartition("doc_id").sortWithinPartitions("doc_id")
    rows = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).where("line <> ''")
    split = rows.mapInArrow(_words, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, pos int, wpos int, x1 long, word string")
    y1 = 30 + F.col("pos") * 22 + F.floor(F.col("pos") / 5) * 20
    return split.select(F.col("doc_id").alias("page_id"), F.col("pos").cast("long").alias("row"), (F.col("pos").cast("long") * 100000 + F.col("wpos")).alias("region_idx"), "x1", y1.cast("long").alias("y1"), (F.col("x1") + F.length("word") * 7).cast("long").alias("x2"), (y1 + 18).cast("long").alias("y2"), F.col("word").alias("text"), F.lit("Text").alias("category"), F.lit(14.0).alias("ink_height"))


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, pos, wpos, x1, word) of the words of (doc_id, pos, line) that are not empty, in their order: a word
    begins 7 pixels on for each character before it and 40 for each eight words."""
    for batch in batches:
        rows = max(1, batch.num_rows * _SLICE // max(batch.nbytes, 1))
        for k in range(0, batch.num_rows, rows):
            part = batch.slice(k, rows)
            lists = pc.split_pattern(part.column("line"), " ")
            words, line = lists.flatten(), pc.list_parent_indices(lists).to_numpy()
            first = np.searchsorted(line, np.arange(len(lists)))[line]
            wide = pc.utf8_length(words).to_numpy().astype(np.int64) + 1
            before = np.cumsum(wide) - wide
            wpos = np.arange(len(line)) - first
            x1 = 40 + (before - before[first]) * 7 + wpos // 8 * 40
            own = part.select(["doc_id", "pos"]).take(pa.array(line))
            out = pa.record_batch([*own.columns, pa.array(wpos, pa.int32()), pa.array(x1, pa.int64()), words], names=["doc_id", "pos", "wpos", "x1", "word"])
            yield out.filter(pc.not_equal(words, ""))


_LINES = "lines AS (SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS line FROM (SELECT doc_id, str_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL))"
_R = _LINES + """, r AS (SELECT doc_id AS page_id, pos AS region_idx, 40 + pos % 3 * 4 AS x1, 30 + pos * 22 + pos // 5 * 20 AS y1,
 40 + pos % 3 * 4 + least(length(line) * 7, 900) AS x2, 48 + pos * 22 + pos // 5 * 20 AS y2, line AS text,
 CASE WHEN pos = 0 THEN 'Title' WHEN length(line) < 30 THEN 'Caption' ELSE 'Text' END AS category,
 CASE WHEN pos = 0 THEN 24.0::DOUBLE ELSE 14.0::DOUBLE END AS ink_height FROM lines WHERE length(line) > 0)"""
_WORDS = _LINES + """, w0 AS (SELECT doc_id, pos, unnest(range(len(l))) AS wpos, unnest(l) AS word FROM (SELECT doc_id, pos, str_split(line, ' ') AS l FROM lines)),
 w1 AS (SELECT *, 40 + coalesce(sum(length(word) * 7 + 7 + CASE WHEN wpos % 8 = 7 THEN 40 ELSE 0 END) OVER (PARTITION BY doc_id, pos ORDER BY wpos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS x1 FROM w0),
 words AS (SELECT doc_id AS page_id, pos AS row, pos * 100000 + wpos AS region_idx, x1, x1 + length(word) * 7 AS x2, word AS text FROM w1 WHERE word <> '')"""


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^[\p{{Z}}\t-\r\x1c-\x20\x{{85}}]+|[\p{{Z}}\t-\r\x1c-\x20\x{{85}}]+$', '', 'g')"


# -- text -------------------------------------------------------------------------------------


@query(f"WITH {_LINES} SELECT doc_id, pos::BIGINT AS pos, regexp_matches(line, '[A-Za-z{T.THAI}]{{2,}}') AS has_words FROM lines")
def q_has_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select("doc_id", F.col("pos").cast("long").alias("pos"), T.has_words(F.col("line")).alias("has_words"))


_GARBAGE = "CASE WHEN length(t) < 3 THEN false WHEN len(regexp_extract_all(t, '[A-Za-z]{3,}|[" + T.THAI + "]{3,}')) >= 2 THEN false ELSE len(list_filter(regexp_split_to_array(t, '[\\p{Z}\\t-\\r\\x1c-\\x20\\x{85}]+'), lambda x: regexp_full_match(x, '[" + T.MOJIBAKE + "]'))) >= 3 OR (length(t) - length(regexp_replace(t, '[" + T.MOJIBAKE + "]', '', 'g'))) / length(t) > 0.25 END"
_MANGLED = f"CASE WHEN pos % 3 = 1 THEN translate(line, 'aeioutnrs', '{T.MOJIBAKE[:9]}') ELSE line END"


@query(f"WITH {_LINES}, m AS (SELECT doc_id, pos, {_strip(_MANGLED)} AS t FROM lines) SELECT doc_id, pos::BIGINT AS pos, {_GARBAGE} AS garbage FROM m")
def q_looks_like_garbage(spark: SparkSession, sf_dir: str) -> DataFrame:
    mangled = F.when(F.col("pos") % 3 == 1, F.translate("line", "aeioutnrs", T.MOJIBAKE[:9])).otherwise(F.col("line"))
    return lines(spark, sf_dir).select("doc_id", F.col("pos").cast("long").alias("pos"), T.looks_like_garbage(mangled).alias("garbage"))


@query("SELECT conv_id, turn, length(reply) > 3 * length(text) + 10 AS disproportionate FROM (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS reply FROM conversations)")
def q_disproportionate(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    reply = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return turns.withColumn("reply", reply).select("conv_id", "turn", T.is_disproportionate(F.col("text"), F.col("reply")).alias("disproportionate"))


_REPLY = "CASE turn % 4 WHEN 0 THEN '  \"' || text || '\"' WHEN 1 THEN '“' || text || '”' WHEN 2 THEN 'Please provide the text. ' || text ELSE text END"


@query(f"WITH a AS (SELECT conv_id, turn, {_strip(_REPLY)} AS t FROM conversations), b AS (SELECT conv_id, turn, CASE WHEN length(t) >= 2 AND regexp_matches(t, '^[\"''“”„«»]') AND t[1] = t[-1] THEN {_strip('substr(t, 2, length(t) - 2)')} ELSE t END AS t FROM a) SELECT conv_id, turn, CASE WHEN regexp_matches(t, '(?i){T.REFUSAL}') THEN '' ELSE t END AS cleaned FROM b")
def q_clean_reply(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, k = F.col("text"), F.col("turn") % 4
    reply = F.when(k == 0, F.concat(F.lit('  "'), t, F.lit('"'))).when(k == 1, F.concat(F.lit("“"), t, F.lit("”"))).when(k == 2, F.concat(F.lit("Please provide the text. "), t)).otherwise(t)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.clean_reply(reply).alias("cleaned"))


_THAI = ["แล้ว ปุ๋ยเคมี", "รายงานประจำปี ๒๕๖๗", "น้ำใจ คำ สำหรับ", "เก่ง ที่สุด 2023", "ไทย and 1999"]
_THAI_SQL = "thai AS (SELECT doc_id, CASE doc_id % 5 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(_THAI)) + " END AS text FROM documents)"


def _thai(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = F.element_at(F.array(*[F.lit(t) for t in _THAI]), (F.col("doc_id") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", pick.alias("text"))


_SPANS = f"WITH {_THAI_SQL}, c AS (SELECT doc_id, length(text) AS n, unnest(range(len(l))) AS pos, unnest(l) AS cluster FROM (SELECT doc_id, text, regexp_extract_all(text, '{T.CLUSTER}') AS l FROM thai)), s AS (SELECT *, coalesce(sum(length(cluster)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM c)"


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = _thai(spark, sf_dir).select("doc_id", F.length("text").cast("long").alias("n"), F.posexplode(T.clusters(F.col("text"))).alias("pos", "cluster"))
    return rows.withColumn("start", F.coalesce(F.sum(F.length("cluster")).over(w), F.lit(0)).cast("long"))


@query(_SPANS + " SELECT doc_id, start::INT AS start, cluster FROM s")
def q_cluster_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _thai(spark, sf_dir).select("doc_id", F.explode(T.cluster_spans(F.col("text"))).alias("s"))
    return rows.select("doc_id", "s.start", F.col("s.text").alias("cluster"))


@query(_SPANS + ' SELECT doc_id, start, coalesce(lead(start) OVER (PARTITION BY doc_id ORDER BY start), n)::BIGINT AS "end" FROM s')
def q_span_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fonts.span_ends(_spans(spark, sf_dir), "doc_id").select("doc_id", "start", F.col("end").cast("long").alias("end"))


@query(_SPANS + f" SELECT doc_id, start, (1 + regexp_matches(cluster, '[{T.BELOW}]')::INT + regexp_matches(cluster, '[{T.ABOVE_VOWELS}]')::INT + regexp_matches(cluster, '[{T.TONES}{T.THANTHAKHAT}]')::INT)::INT AS depth FROM s")
def q_stack_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans(spark, sf_dir).select("doc_id", "start", T.stack_depth(F.col("cluster")).cast("int").alias("depth"))


@query(f"WITH {_THAI_SQL}, c AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?s).')) AS ch FROM thai) SELECT doc_id, CASE WHEN regexp_full_match(ch, '[{T.ABOVE}]') THEN 'above' WHEN regexp_full_match(ch, '[{T.BELOW}]') THEN 'below' ELSE 'main' END AS band, count(*) AS n FROM c GROUP BY ALL")
def q_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    chars = _thai(spark, sf_dir).select("doc_id", F.explode(F.split("text", "")).alias("ch")).where("ch <> ''")
    return chars.groupBy("doc_id", T.band(F.col("ch")).alias("band")).agg(F.count("*").alias("n"))


_YEARS = "'in ' || (1900 + doc_id % 200) || ' and ' || n_chars || ' or ' || (19000 + doc_id % 7)"
_BE = "array_to_string(list_transform(regexp_extract_all(t, '[0-9]+|[^0-9]+'), lambda x: CASE WHEN regexp_full_match(x, '(19|20)[0-9]{2}') THEN (x::INT + 543)::VARCHAR ELSE x END), '')"
_TH = f"translate({{}}, '0123456789', '{T.THAI_DIGITS}')"


def _years() -> F.Column:
    return F.concat(F.lit("in "), 1900 + F.col("doc_id") % 200, F.lit(" and "), F.col("n_chars"), F.lit(" or "), 19000 + F.col("doc_id") % 7)


@query(f"WITH y AS (SELECT doc_id, {_YEARS} AS t FROM documents) SELECT doc_id, {_BE} AS be FROM y")
def q_years_to_be(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.years_to_be(_years()).alias("be"))


@query(f"SELECT doc_id, {_TH.format(_YEARS)} AS digits FROM documents")
def q_thai_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.to_thai_digits(_years()).alias("digits"))


@query(f"WITH y AS (SELECT doc_id, {_YEARS} AS t FROM documents), e AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN {_BE} ELSE t END AS t FROM y) SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN {_TH.format('t')} ELSE t END AS local FROM e")
def q_apply_locale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.apply_locale(_years(), F.col("doc_id") % 2 == 0, F.col("doc_id") % 3 == 0).alias("local"))


_JSON = r"""replace(replace(replace(replace(replace({}, '\', '\\'), '"', '\"'), chr(10), '\n'), chr(13), '\r'), chr(9), '\t')"""


@query(f"SELECT doc_id, sha256('\"' || lang || '\"' || '\"' || {_JSON.format('text')} || '\"')[1:20] AS cache_key FROM documents")
def q_cache_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.cache_key(F.col("lang"), F.col("text")).alias("cache_key"))


@query("WITH c AS (SELECT conv_id, left(string_agg(text, ' | ' ORDER BY turn), 400) AS context FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations) WHERE k <= 6 GROUP BY conv_id) SELECT conv_id, turn, context FROM conversations JOIN c USING (conv_id)")
def q_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("page_id"), F.col("turn").alias("region_idx"), "text")
    return completion.with_context(rows).select(F.col("page_id").alias("conv_id"), F.col("region_idx").alias("turn"), "context")


@query(f"WITH {_LINES}, a AS (SELECT doc_id, pos, line, {_strip('line')} AS t, {_strip("CASE WHEN pos % 4 = 0 THEN '\"' || line || '\"' WHEN pos % 4 = 1 THEN repeat(line, 5) ELSE line || '.' END")} AS r0 FROM lines), b AS (SELECT *, CASE WHEN length(r0) >= 2 AND regexp_matches(r0, '^[\"''“”„«»]') AND r0[1] = r0[-1] THEN {_strip('substr(r0, 2, length(r0) - 2)')} ELSE r0 END AS r1 FROM a), c AS (SELECT *, CASE WHEN regexp_matches(r1, '(?i){T.REFUSAL}') THEN '' ELSE r1 END AS r FROM b) SELECT doc_id, pos::BIGINT AS pos, CASE WHEN t = '' OR {_GARBAGE} THEN '' WHEN NOT regexp_matches(line, '[A-Za-z{T.THAI}]{{2,}}') THEN line WHEN length(r) > 3 * length(line) + 10 THEN line ELSE r END AS shown FROM c")
def q_translate_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, k = F.col("line"), F.col("pos") % 4
    reply = F.when(k == 0, F.concat(F.lit('"'), line, F.lit('"'))).when(k == 1, F.repeat(line, 5)).otherwise(F.concat(line, F.lit(".")))
    return lines(spark, sf_dir).select("doc_id", F.col("pos").cast("long").alias("pos"), T.translate_gate(line, reply).alias("shown"))


@query("SELECT d.doc_id, d.n_chars FROM documents d WHERE NOT EXISTS (SELECT 1 FROM documents k WHERE k.doc_id % 2 = 0 AND sha256(k.text) = sha256(d.text))")
def q_cache_miss(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.sha2("text", 256).alias("key"))
    return completion.unknown(docs, docs.where("doc_id % 2 = 0"), "key").select("doc_id", "n_chars")


@query("SELECT doc_id, coalesce(CASE WHEN doc_id % 3 = 0 THEN 'glyph' END, CASE WHEN doc_id % 2 = 0 THEN 'font' END) AS renderer, CASE WHEN doc_id % 3 = 0 THEN 'bank' ELSE lang END AS font, source AS category, 'b' AS glyph_bank FROM documents")
def q_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = render.first_made(F.when(F.col("doc_id") % 3 == 0, "glyph"), F.when(F.col("doc_id") % 2 == 0, "font"))
    glyph = F.when(F.col("doc_id") % 3 == 0, F.create_map(F.lit("font"), F.lit("bank"), F.lit("glyph_bank"), F.lit("b"))).otherwise(F.create_map(F.lit("glyph_bank"), F.lit("b")))
    style = render.merged_style(glyph, F.create_map(F.lit("font"), "lang", F.lit("category"), "source"))
    return table(spark, sf_dir, "documents").select("doc_id", made.alias("renderer"), style.alias("s")).select("doc_id", "renderer", *[F.col("s")[k].alias(k) for k in ("font", "category", "glyph_bank")])


# -- layout -----------------------------------------------------------------------------------


@query(f"WITH {_R}, c AS (SELECT page_id, region_idx, text, greatest(0, least(x1 - 45, 900)) AS x1, greatest(0, least(y1, 600)) AS y1, greatest(0, least(x2 - 45, 900)) AS x2, greatest(0, least(y2, 600)) AS y2 FROM r) SELECT page_id, region_idx, x1::INT AS x1, y1::INT AS y1, x2::INT AS x2, y2::INT AS y2 FROM c WHERE {_strip('text')} <> '' AND x2 - x1 >= 3 AND y2 - y1 >= 3")
def q_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = page_regions(spark, sf_dir).withColumns({"x1": F.col("x1") - 45, "x2": F.col("x2") - 45})
    return layout.clip(moved, F.lit(900), F.lit(600)).select("page_id", "region_idx", *layout.BOX)


@query(f"WITH {_WORDS}, g AS (SELECT *, CASE WHEN x1 - lag(x2) OVER (PARTITION BY page_id, row ORDER BY x1, region_idx) > 30 THEN 1 ELSE 0 END AS new FROM words) SELECT page_id, row, region_idx, (sum(new) OVER (PARTITION BY page_id, row ORDER BY x1, region_idx))::BIGINT AS segment FROM g")
def q_row_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.row_segments(page_words(spark, sf_dir), "page_id", "row").select("page_id", "row", "region_idx", "segment")


@query(f"WITH {_R} SELECT page_id, category, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, {_strip("string_agg(text, ' ' ORDER BY region_idx)")} AS text, coalesce(min(nullif(ink_height, 0)), 0) AS ink_height FROM r GROUP BY page_id, category")
def q_union_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = page_regions(spark, sf_dir)
    return layout.union_boxes(r.withColumn("kind", F.col("category")), "page_id", "kind").drop("category").withColumnRenamed("kind", "category")


@query(f"WITH {_R} SELECT page_id, region_idx, round_even(x1 * (700.0::DOUBLE / 1100), 0)::INT AS x1, round_even(y1 * (700.0::DOUBLE / 1100), 0)::INT AS y1, round_even(x2 * (700.0::DOUBLE / 1100), 0)::INT AS x2, round_even(y2 * (700.0::DOUBLE / 1100), 0)::INT AS y2 FROM r")
def q_downscale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.downscale(page_regions(spark, sf_dir), F.lit(WIDTH), F.lit(HEIGHT), 700).select("page_id", "region_idx", *layout.BOX)


@query(f"WITH {_R} SELECT page_id, region_idx, greatest(4, round_even((x2 - x1) * 0.9::DOUBLE, 0)::INT) AS width, greatest(4, round_even((y2 - y1) * 0.9::DOUBLE, 0)::INT) AS height FROM r")
def q_request_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = page_regions(spark, sf_dir)
    return r.select("page_id", "region_idx", layout.request_size(F.col("x2") - F.col("x1"), F.lit(0.1)).alias("width"), layout.request_size(F.col("y2") - F.col("y1"), F.lit(0.1)).alias("height"))


_PLACE = f"WITH {_R}, i AS (SELECT *, length(text) * 6 AS iw, 10 + (region_idx * 5) % 14 AS ih FROM r), s AS (SELECT *, y2 - y1 - ih AS slack FROM i), p AS (SELECT page_id, region_idx, text, x1 + greatest(0, floor((x2 - x1 - iw) / 2))::BIGINT AS x, y1 + CASE WHEN slack BETWEEN 0 AND 12 THEN slack // 2 ELSE greatest(1, round_even((y2 - y1) * 0.1::DOUBLE / 2, 0)::BIGINT) END AS y, iw <= x2 - x1 + 1 AND ih <= y2 - y1 + 1 AS fit FROM s)"


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.place(page_regions(spark, sf_dir), F.length("text") * 6, 10 + F.col("region_idx") * 5 % 14, 0.1)


@query(_PLACE + " SELECT page_id, region_idx, x, y::BIGINT AS y, fit FROM p")
def q_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _placed(spark, sf_dir).select("page_id", "region_idx", "x", "y", "fit")


@query(f"WITH {_R} SELECT page_id, region_idx, (40 + coalesce(sum(y2 - y1 + 24) OVER (PARTITION BY page_id ORDER BY region_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS top FROM r")
def q_stack_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.stack(page_regions(spark, sf_dir)).select("page_id", "region_idx", "top")


@query(f"WITH {_R} SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY y1, x1, region_idx) - 1 AS place, round_even(x1 * 1000 / 1025.0::DOUBLE, 0)::INT AS x1, round_even(y1 * 1000 / 1100.0::DOUBLE, 0)::INT AS y1, round_even(x2 * 1000 / 1025.0::DOUBLE, 0)::INT AS x2, round_even(y2 * 1000 / 1100.0::DOUBLE, 0)::INT AS y2, category, text FROM r WHERE {_strip('text')} <> ''")
def q_page_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.page_records(page_regions(spark, sf_dir), F.lit(WIDTH), F.lit(HEIGHT))


@query(_PLACE + " SELECT page_id, avg(fit::INT)::DOUBLE AS fit_rate, count(*) AS regions FROM p GROUP BY page_id")
def q_fit_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.fit_rates(_placed(spark, sf_dir))


@query(_PLACE + " SELECT page_id, count(*) AS regions FROM p GROUP BY page_id HAVING avg(fit::INT) >= 0.5")
def q_min_fit_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.fit_rates(_placed(spark, sf_dir)).where("fit_rate >= 0.5").select("page_id", "regions")


@query(_PLACE + f", g AS (SELECT page_id, count(*) AS n, sum(fit::INT) AS ok, sum(({_strip('text')} = '')::INT) AS blank FROM p GROUP BY page_id), o AS (SELECT *, ok / n < 0.5 AS rejected FROM g) SELECT count(*) FILTER (NOT rejected) AS pages, coalesce(sum(n) FILTER (NOT rejected), 0)::BIGINT AS regions, coalesce(sum(ok) FILTER (NOT rejected), 0)::BIGINT AS fitted, coalesce(sum(blank) FILTER (NOT rejected), 0)::BIGINT AS empty, count(*) FILTER (rejected) AS rejected, coalesce(sum(ok) FILTER (NOT rejected) / sum(n) FILTER (NOT rejected), 1)::DOUBLE AS fit_rate FROM o")
def q_run_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.run_report(_placed(spark, sf_dir), 0.5)


@query(f"WITH {_R}, s AS (SELECT page_id, region_idx, max(size) AS size FROM (SELECT *, unnest(range(6, 25)) AS size FROM r) WHERE floor((x2 - x1) * 2 / size) >= 1 AND ceil(length(text) / greatest(floor((x2 - x1) * 2 / size), 1)) * size * 1.25 <= (y2 - y1) * 3 GROUP BY ALL) SELECT r.page_id, r.region_idx, coalesce(s.size, 6)::INT AS size FROM r LEFT JOIN s USING (page_id, region_idx)")
def q_fit_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = page_regions(spark, sf_dir)
    return r.select("page_id", "region_idx", layout.fit_size(F.col("x2") - F.col("x1"), (F.col("y2") - F.col("y1")) * 3, F.length("text")).alias("size"))


@query(f"WITH {_R} SELECT page_id, region_idx, text || '/' || length(text) AS joined FROM r")
def q_zip_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An error if a region had no text, or a text no region."""
    regions = page_regions(spark, sf_dir).select("page_id", "region_idx", "text")
    texts = lines(spark, sf_dir).where("line <> ''").select(F.col("doc_id").alias("page_id"), F.col("pos").cast("long").alias("region_idx"), F.length("line").cast("string").alias("shown"))
    return layout.zip_strict(regions, texts, "page_id", "region_idx").select("page_id", "region_idx", F.concat("text", F.lit("/"), "shown").alias("joined"))


@query(f"""WITH RECURSIVE {_R}, t AS (SELECT page_id, region_idx, unnest(range(1, len(l) + 1)) AS k, unnest(l) AS tok FROM (SELECT page_id, region_idx, regexp_extract_all(text, '[^ \\t-\\r]+[ \\t-\\r]?|[ \\t-\\r]') AS l FROM r)),
 f AS (SELECT page_id, region_idx, k, 0 AS line, tok AS cur FROM t WHERE k = 1 UNION ALL
 SELECT page_id, region_idx, k, CASE WHEN fits THEN line ELSE line + 1 END, CASE WHEN fits THEN cur || tok ELSE tok END FROM (SELECT t.*, f.line, f.cur, length(rtrim(f.cur || t.tok)) <= 60 AS fits FROM f JOIN t ON t.page_id = f.page_id AND t.region_idx = f.region_idx AND t.k = f.k + 1))
 SELECT page_id, region_idx, line, arg_max(cur, k) AS text FROM f GROUP BY page_id, region_idx, line""")
def q_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_regions(spark, sf_dir).select("page_id", "region_idx", F.posexplode(layout.wrap(F.col("text"), 60)).alias("line", "text"))


@query(f"""WITH {_WORDS}, g AS (SELECT *, CASE WHEN x1 - lag(x2) OVER (PARTITION BY page_id, row ORDER BY x1, region_idx) > 30 THEN 1 ELSE 0 END AS new FROM words), n AS (SELECT *, sum(new) OVER (PARTITION BY page_id, row ORDER BY x1, region_idx) AS segment FROM g),
 u AS (SELECT page_id, row, segment, min(x1)::INT AS x1, (30 + row * 22 + row // 5 * 20)::INT AS y1, max(x2)::INT AS x2, (48 + row * 22 + row // 5 * 20)::INT AS y2, {_strip("string_agg(word, ' ' ORDER BY region_idx)")} AS text FROM (SELECT *, text AS word FROM n) GROUP BY page_id, row, segment)
 SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY row, segment) - 1 AS region_idx, x1, y1, x2, y2, text, 'Text' AS category, 14.0::DOUBLE AS ink_height FROM u""")
def q_group_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.group_rows(page_words(spark, sf_dir, gathered=True), gathered=True)


@query(f"""WITH RECURSIVE {_R}, o AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY y1, x1, region_idx) AS k FROM r),
 f AS (SELECT page_id, k, 0 AS blk, x1 AS bx1, x2 AS bx2, y2 AS by2, y2 - y1 AS h, category AS bc FROM o WHERE k = 1 UNION ALL
 SELECT page_id, k, CASE WHEN j THEN blk ELSE blk + 1 END, CASE WHEN j THEN least(bx1, x1) ELSE x1 END, CASE WHEN j THEN greatest(bx2, x2) ELSE x2 END, CASE WHEN j THEN greatest(by2, y2) ELSE y2 END, y2 - y1, category FROM
 (SELECT o.*, f.blk, f.bx1, f.bx2, f.by2, o.category = f.bc AND o.y1 - f.by2 >= -3 AND o.y1 - f.by2 <= 0.6::DOUBLE * greatest(o.y2 - o.y1, f.h, 1) AND (abs(o.x1 - f.bx1) <= 8 OR (least(o.x2, f.bx2) - greatest(o.x1, f.bx1)) / greatest(least(o.x2 - o.x1, f.bx2 - f.bx1), 1) > 0.6::DOUBLE) AS j FROM f JOIN o ON o.page_id = f.page_id AND o.k = f.k + 1))
 SELECT page_id, blk::BIGINT AS region_idx, min(x1)::INT AS x1, min(y1)::INT AS y1, max(x2)::INT AS x2, max(y2)::INT AS y2, {_strip("string_agg(text, ' ' ORDER BY k)")} AS text, arg_min(category, k) AS category, coalesce(min(nullif(ink_height, 0)), 0)::DOUBLE AS ink_height FROM o JOIN f USING (page_id, k) GROUP BY page_id, blk""")
def q_merge_wrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.merge_wrapped(page_regions(spark, sf_dir))


# -- sources ----------------------------------------------------------------------------------


@query("SELECT event_id AS line_no, event_id::VARCHAR AS page_id, event_type AS image, trunc(coalesce(json_extract_string(props, '$.k')::DOUBLE, 0) / 8)::INT AS x1, 20 AS x2, trunc(value)::INT AS y2, event_type AS text, 'Text' AS category, 0.0::DOUBLE AS ink_height, json_extract_string(props, '$.k') AS k FROM events")
def q_json_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as annotation records: spaces around texts, coordinates with fractions, a category that is
    dropped, a key that is no field."""
    k = F.coalesce(F.get_json_object("props", "$.k").cast("double"), F.lit(0.0)) / 8
    line = F.format_string('{"image": "%s", "regions": [{"box": [%s, 1.9, 20.5, %s], "text": " %s "}, {"box": [0, 0, 9, 9], "text": "x", "category": "Picture"}], "extra": %s}', "event_type", k.cast("string"), F.col("value").cast("string"), "event_type", F.coalesce("props", F.lit("{}")))
    pages = annotations.parsed(table(spark, sf_dir, "events").select(F.col("event_id").alias("line_no"), line.alias("line")))
    rows = pages.select("line_no", "page_id", "image", F.get_json_object(F.col("meta")["extra"], "$.k").alias("k"), F.explode("regions").alias("r"))
    return rows.select("line_no", "page_id", "image", *[F.col(f"r.{c}").alias(c) for c in ("x1", "x2", "y2", "text", "category", "ink_height")], "k")


@query(f"WITH {_R}, k AS (SELECT *, {_strip('text')} AS t FROM r WHERE category <> 'Caption') SELECT lpad(page_id::VARCHAR, 16, '0') AS page_id, row_number() OVER (PARTITION BY page_id ORDER BY region_idx) - 1 AS region_idx, t AS text, category, x1::INT AS x1, y1::INT AS y1, least(x2, 1025)::INT AS x2, least(y2, 1100)::INT AS y2 FROM k WHERE t <> ''")
def q_columnar_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as rows of arrays, as layout corpora hold them, back to regions."""
    names = ["Title", "Caption", "Text"]
    box = F.array(*[F.col(c).cast("double") for c in ("x1", "y1")], (F.col("x2") - F.col("x1")).cast("double"), (F.col("y2") - F.col("y1")).cast("double"))
    number = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("category")).cast("int") - 1
    pages = page_regions(spark, sf_dir).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("region_idx", F.col("text").alias("t"), box.alias("b"), number.alias("c")))).alias("rows"))
    of = lambda c: F.transform("rows", lambda r: r[c])
    rows = pages.select(F.col("page_id").alias("index"), F.lpad(F.col("page_id").cast("string"), 16, "0").alias("page_hash"), F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height"), of("t").alias("texts"), of("b").alias("boxes"), of("c").alias("categories"), F.lit("law").alias("doc_category"), F.lit(1).alias("page_no"))
    found = annotations.region_rows(columnar.columnar_pages(rows, names, "corpus", drop_categories=("Caption",)))
    return found.select("page_id", "region_idx", "text", "category", *layout.BOX)


@query(f"WITH {_R}, b AS (SELECT page_id, region_idx, (x1 - 50.5)::DOUBLE AS x, (y1 * 1.25)::DOUBLE AS y, (x2 - x1 + 0.75)::DOUBLE AS w, 18.5::DOUBLE AS h FROM r) SELECT page_id, region_idx, greatest(0, trunc(x)::INT) AS x1, greatest(0, trunc(y)::INT) AS y1, least(1025, trunc(x + w)::INT) AS x2, least(1100, trunc(y + h)::INT) AS y2 FROM b")
def q_xyxy(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = F.array((F.col("x1") - 50.5).cast("double"), (F.col("y1") * 1.25).cast("double"), (F.col("x2") - F.col("x1") + 0.75).cast("double"), F.lit(18.5))
    return page_regions(spark, sf_dir).select("page_id", "region_idx", *columnar.corner_box(box, F.lit(WIDTH), F.lit(HEIGHT)))


@query("SELECT event_type, round(quantile_cont(value, 0.85), 6) AS p85, round(quantile_cont(value, 0.15), 6) AS p15, round(median(value), 6) AS p50, round(stddev_pop(value), 6) AS spread FROM events GROUP BY event_type")
def q_percentile_ink(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = lambda q: F.round(F.percentile("value", F.lit(q)), 6)
    return table(spark, sf_dir, "events").groupBy("event_type").agg(p(0.85).alias("p85"), p(0.15).alias("p15"), p(0.5).alias("p50"), F.round(F.stddev_pop("value"), 6).alias("spread"))


# -- dimensions -------------------------------------------------------------------------------

_BANK = "bank AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{f}', '{c}', {w}, {str(it).lower()})" for i, (f, c, w, it) in enumerate(fonts.FACES)) + ") t(pos, family, category, weight, italic))"
_NAMES = ["sarabun", "NOTO-sans thai", "Tlwg_Mono", "no such family"]
_GLYPHS = "glyphs AS (SELECT DISTINCT char FROM (SELECT unnest(regexp_extract_all(text, '(?s).')) AS char FROM benchmark))"


def _glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", "")).alias("char")).where("char <> ''").distinct()


@query(f"WITH {_BANK}, k AS (SELECT *, regexp_replace(lower(family), '[^a-z0-9]', '', 'g') AS key FROM bank), b AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY key ORDER BY italic, abs(weight - 400), pos) = 1), w AS (SELECT doc_id, CASE doc_id % 4 " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(_NAMES)) + " END AS name FROM documents) SELECT doc_id, name, family, category, weight FROM w LEFT JOIN b ON regexp_replace(lower(name), '[^a-z0-9]', '', 'g') = key")
def q_font_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.element_at(F.array(*[F.lit(n) for n in _NAMES]), (F.col("doc_id") % 4 + 1).cast("int"))
    return fonts.find(table(spark, sf_dir, "documents").select("doc_id", name.alias("name")), fonts.bank(spark))


@query(f"WITH {_BANK}, h AS (SELECT category, family, italic, max(weight) AS bold FROM bank WHERE weight >= 600 GROUP BY ALL) SELECT pos::BIGINT AS pos, family, category, weight, coalesce(bold, weight) AS bold_weight FROM bank LEFT JOIN h USING (category, family, italic)")
def q_font_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fonts.bold_variant(fonts.bank(spark))


@query(f"WITH {_BANK} SELECT category, count(*) AS faces, count(DISTINCT family) AS families FROM bank GROUP BY ROLLUP (category)")
def q_font_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fonts.summary(fonts.bank(spark))


@query(f"WITH {_GLYPHS}, c AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '(?s).')) AS char FROM documents), n AS (SELECT doc_id, count(*) AS n FROM c WHERE char NOT IN (SELECT char FROM glyphs) GROUP BY doc_id) SELECT doc_id, coalesce(n, 0)::INT AS code_points FROM documents LEFT JOIN n USING (doc_id)")
def q_missing_cp(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = fonts.inventory(_glyphs(spark, sf_dir))
    return table(spark, sf_dir, "documents").select("doc_id", fonts.missing_of(F.col("text"), known).alias("code_points"))


@query(f"WITH {_GLYPHS}, c AS (SELECT lang, unnest(regexp_extract_all(text, '[^ \\t\\n\\x0b\\f\\r]')) AS char FROM documents) SELECT lang, round(avg((char IN (SELECT char FROM glyphs WHERE char < 'n'))::INT), 9)::DOUBLE AS coverage FROM c GROUP BY lang")
def q_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fonts.coverage(table(spark, sf_dir, "documents"), _glyphs(spark, sf_dir).where("char < 'n'"), "lang")
    return found.select("lang", F.round("coverage", 9).alias("coverage"))


# -- pixels -----------------------------------------------------------------------------------

_STRIPES = "s AS (SELECT doc_id, 210 + doc_id % 40 AS paper, doc_id % 60 AS ink, 6 + doc_id % 5 AS rows FROM documents)"


def _rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grey page of 40 x 32 pixels for each document, with 6 to 10 rows of vertical strokes."""
    paper, ink, rows = (F.lit(210) + F.col("doc_id") % 40, F.col("doc_id") % 60, F.lit(6) + F.col("doc_id") % 5)
    two = lambda c: F.lpad(F.hex(c.cast("long")), 2, "0")
    blank = F.repeat(two(paper), 40 * 3)
    stroked = F.repeat(F.concat(F.repeat(two(paper), 6 * 3), F.repeat(two(ink), 2 * 3)), 5)
    n = rows.cast("int")
    rgb = F.unhex(F.concat(F.repeat(blank, 8), F.repeat(stroked, n), F.repeat(blank, F.lit(24) - n)))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), F.lit(40).alias("width"), F.lit(32).alias("height"), rgb.alias("rgb"))


def _whole(images: DataFrame) -> DataFrame:
    return images.select("page_id", F.lit(0).cast("long").alias("region_idx"), F.lit(0).alias("x1"), F.lit(0).alias("y1"), F.col("width").alias("x2"), F.col("height").alias("y2"), F.lit("").alias("text"), F.lit("Text").alias("category"), F.lit(0.0).alias("ink_height"))


@query(f"WITH {_STRIPES} SELECT doc_id AS page_id, rows::DOUBLE AS ink_height FROM s")
def q_measure_ink(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = _rasters(spark, sf_dir)
    return pixels.measured(images, _whole(images)).select("page_id", "ink_height")


@query(f"WITH {_STRIPES} SELECT doc_id AS page_id, ink::INT AS r, sha256(unhex(repeat(lpad(to_hex(paper), 2, '0'), 40 * 32 * 3))) AS clean FROM s")
def q_erase(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = _rasters(spark, sf_dir)
    return pixels.erased(images, _whole(images)).select("page_id", F.col("colours")[0]["r"].alias("r"), F.sha2("rgb", 256).alias("clean"))


@query(f"WITH {_STRIPES}, h AS (SELECT doc_id, rows // 2 AS n, rows % 2 AS odd, lpad(to_hex(paper), 2, '0') AS p, lpad(to_hex(ink), 2, '0') AS i, lpad(to_hex(round_even((paper + ink) / 2.0::DOUBLE, 0)::INT), 2, '0') AS m FROM s) SELECT doc_id AS page_id, 20 AS width, 16 AS height, sha256(unhex(repeat(p, 20 * 3 * 4) || repeat(repeat(p, 9) || repeat(i, 3), 5 * n) || repeat(repeat(p, 9) || repeat(m, 3), 5 * odd) || repeat(p, 20 * 3 * (12 - n - odd)))) AS pixels FROM h")
def q_downscale_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.downscaled(_rasters(spark, sf_dir), 20).select("page_id", "width", "height", F.sha2("rgb", 256).alias("pixels"))


# -- typefaces --------------------------------------------------------------------------------

_METRICS = "metrics AS (SELECT DISTINCT char, 300 + unicode(char) % 7 * 50 AS advance FROM (SELECT unnest(regexp_extract_all(text, '(?s).')) AS char FROM benchmark))"
_WIDE = "coalesce(m.advance, 500)"


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Advances for the characters of the benchmark texts, in thousandths of the em."""
    return _glyphs(spark, sf_dir).select("char", (300 + F.ascii("char") % 7 * 50).cast("int").alias("advance"))


@query(f"WITH {_LINES}, {_METRICS}, c AS (SELECT doc_id, pos, unnest(regexp_extract_all(line, '(?s).')) AS char FROM lines) SELECT doc_id, pos::BIGINT AS pos, sum({_WIDE})::BIGINT AS advance FROM c LEFT JOIN metrics m USING (char) GROUP BY doc_id, pos")
def q_line_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir).select("doc_id", F.col("pos").cast("long").alias("pos"), F.col("line").alias("token"))
    return typeface.measured(rows, _metrics(spark, sf_dir), 500, "doc_id", "pos").select("doc_id", "pos", "advance")


_TOKENS = f"""t AS (SELECT doc_id, pos, unnest(range(1, len(l) + 1)) AS k, unnest(l) AS tok FROM (SELECT doc_id, pos, regexp_extract_all(line, '[^ \\t-\\r]+[ \\t-\\r]?|[ \\t-\\r]') AS l FROM lines)),
 c AS (SELECT doc_id, pos, k, length(rtrim(tok)) AS n, unnest(range(length(tok))) AS i, unnest(regexp_extract_all(tok, '(?s).')) AS char FROM t),
 w AS (SELECT doc_id, pos, k, sum({_WIDE})::BIGINT AS advance, coalesce(sum({_WIDE}) FILTER (i < n), 0)::BIGINT AS kept FROM c LEFT JOIN metrics m USING (char) GROUP BY doc_id, pos, k)"""


@query(f"""WITH RECURSIVE {_LINES}, {_METRICS}, {_TOKENS},
 f AS (SELECT doc_id, pos, k, 0 AS line, advance AS pen FROM w WHERE k = 1 UNION ALL
 SELECT w.doc_id, w.pos, w.k, CASE WHEN f.pen + w.kept <= 24000 THEN f.line ELSE f.line + 1 END, CASE WHEN f.pen + w.kept <= 24000 THEN f.pen ELSE 0 END + w.advance FROM f JOIN w ON w.doc_id = f.doc_id AND w.pos = f.pos AND w.k = f.k + 1)
 SELECT doc_id, pos::BIGINT AS pos, line, count(*) AS tokens FROM f GROUP BY doc_id, pos, line""")
def q_wrap_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many tokens stand on each line of a column 24 em wide."""
    rows = lines(spark, sf_dir).select("doc_id", F.col("pos").cast("long").alias("pos"), "line")
    wide = typeface.token_widths(rows, _metrics(spark, sf_dir), 500, "doc_id", "pos")
    placed = wide.select("doc_id", "pos", F.explode(typeface.wrap_lines(F.col("tokens"), F.lit(24000))).alias("line"))
    return placed.groupBy("doc_id", "pos", "line").agg(F.count("*").alias("tokens"))


@query(_SPANS + f", {_METRICS}, c AS (SELECT doc_id, start, cluster, unnest(regexp_extract_all(cluster, '(?s).')) AS char FROM s), w AS (SELECT doc_id, start, cluster, sum({_WIDE}) AS w FROM c LEFT JOIN metrics m USING (char) GROUP BY doc_id, start, cluster), e AS (SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY start) AS x2 FROM w) SELECT doc_id, start, cluster, (x2 - w)::BIGINT AS x1, x2::BIGINT AS x2 FROM e".replace("c AS (SELECT doc_id, start", "ch AS (SELECT doc_id, start").replace("FROM c LEFT JOIN metrics", "FROM ch LEFT JOIN metrics"))
def q_render_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typeface.placed(_spans(spark, sf_dir), _metrics(spark, sf_dir), 500, "doc_id")


@query(f"WITH {_THAI_SQL}, ch AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?s).')) AS c FROM thai) SELECT doc_id, count(*) FILTER (regexp_full_match(c, '[{T.THAI}]')) AS thai, count(*) AS n FROM ch GROUP BY doc_id")
def q_is_thai(spark: SparkSession, sf_dir: str) -> DataFrame:
    chars = _thai(spark, sf_dir).select("doc_id", F.explode(F.split("text", "")).alias("ch")).where("ch <> ''")
    return chars.groupBy("doc_id").agg(F.count_if(T.is_thai(F.col("ch"))).alias("thai"), F.count("*").alias("n"))


# -- pages and labels -------------------------------------------------------------------------


@query(f"WITH {_R} SELECT page_id, region_idx, {_strip('text')} <> '' AND x2 - x1 - 60 >= 3 AND y2 - y1 >= 3 AS renderable, nullif(round_even(ink_height * 0.95::DOUBLE, 0)::INT, 0) AS start_size FROM r")
def q_renderable(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = page_regions(spark, sf_dir)
    return r.select("page_id", "region_idx", render.renderable(F.col("text"), F.col("x2") - F.col("x1") - 60, F.col("y2") - F.col("y1")).alias("renderable"), layout.start_size(F.col("ink_height")).alias("start_size"))


@query(_PLACE + ", k AS (SELECT * FROM p JOIN (SELECT page_id, region_idx, x1, y1, x2, y2 FROM r) USING (page_id, region_idx)) SELECT page_id, region_idx, text, x, (x + length(text) * 6)::BIGINT AS x2 FROM k WHERE x < x1 - 2 OR y < y1 - 2 OR x + length(text) * 6 > x2 + 2 OR y + 10 > y2 + 2")
def q_outside(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = F.struct(F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + F.length("text") * 6).alias("x2"), (F.col("y") + 10).alias("y2"))
    labels = _placed(spark, sf_dir).withColumn("clusters", F.array(F.struct("text", box.alias("box"))))
    return render.outside(labels).select("page_id", "region_idx", "text", F.col("box.x1").alias("x"), F.col("box.x2").cast("long").alias("x2"))


@query(_PLACE + ", g AS (SELECT p.page_id, count(*) AS regions, round_even(avg(fit::INT)::DOUBLE, 4) AS fit_rate, arg_max(r.y2, p.region_idx) AS last_y2, arg_min(p.text, p.region_idx) AS first_text FROM p JOIN r USING (page_id, region_idx) GROUP BY p.page_id) SELECT page_id, regions::INT AS regions, fit_rate, last_y2::INT AS last_y2, first_text, 'a.png' AS image, page_id::INT AS idx, lang AS lang, 'f' AS font FROM g JOIN documents d ON d.doc_id = g.page_id")
def q_dataset_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label records, read back from their JSON."""
    labels = _placed(spark, sf_dir).withColumns({"source_text": F.col("text"), "size": F.lit(9)})
    meta = F.create_map(F.lit("lang"), "lang", F.lit("index"), F.lit("own"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), F.lit("a.png").alias("file"), F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height"), meta.alias("meta"), F.create_map(F.lit("font"), F.lit("f")).alias("style"), F.col("doc_id").alias("page_idx"))
    rows = records.label_records(labels, docs.join(labels.select("page_id").distinct(), "page_id", "left_semi"))
    r = F.from_json("record", "image string, fit_rate double, meta struct<lang:string,index:int,style:struct<font:string>>, regions array<struct<box:array<int>,text:string>>")
    read = rows.select("page_id", r.alias("r"))
    last = F.element_at("r.regions", -1)["box"][3]
    return read.select("page_id", F.size("r.regions").alias("regions"), "r.fit_rate", last.alias("last_y2"), F.col("r.regions")[0]["text"].alias("first_text"), "r.image", F.col("r.meta.index").alias("idx"), F.col("r.meta.lang").alias("lang"), F.col("r.meta.style.font").alias("font"))


@query(f"WITH {_R}, k AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY y1, x1, region_idx) AS n, count(*) OVER (PARTITION BY page_id) AS items FROM r WHERE {_strip('text')} <> '') SELECT page_id, items::INT AS items, text AS top_text, round_even(x2 * 1000 / 1025.0::DOUBLE, 0)::INT AS top_x2 FROM k WHERE n = 1")
def q_layout_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records.layout_records(page_regions(spark, sf_dir), F.lit(WIDTH), F.lit(HEIGHT))
    read = rows.select("page_id", F.from_json("record", "layout array<struct<bbox:array<int>,text:string>>").alias("r"))
    return read.select("page_id", F.size("r.layout").alias("items"), F.col("r.layout")[0]["text"].alias("top_text"), F.col("r.layout")[0]["bbox"][2].alias("top_x2"))


@query("SELECT doc_id AS page_id, CASE WHEN doc_id % 2 = 1 THEN 'no image: ' || doc_id || '.png' END AS error FROM documents")
def q_failed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of which every second names an image that there is not."""
    docs = table(spark, sf_dir, "documents")
    pages = docs.select(F.col("doc_id").alias("page_id"), F.concat(F.col("doc_id").cast("string"), F.lit(".png")).alias("image"))
    images = docs.where("doc_id % 2 = 0").select(F.concat(F.lit("/corpus/"), F.col("doc_id").cast("string"), F.lit(".png")).alias("path"), F.lit(1).alias("width"), F.lit(1).alias("height"), F.unhex(F.lit("FFFFFF")).alias("rgb"))
    return image_files.page_images(pages, images, "/corpus", strict=False).select("page_id", "error")


def _strokes(images: DataFrame) -> DataFrame:
    """The region of each raster that holds three of its strokes."""
    rows = F.lit(6) + F.col("page_id") % 5
    return images.select("page_id", F.lit(0).cast("long").alias("region_idx"), F.lit(8).alias("x1"), F.lit(8).alias("y1"), F.lit(32).alias("x2"), (8 + rows).cast("int").alias("y2"), F.lit("t").alias("text"), F.lit("Text").alias("category"), F.lit(3.0).alias("ink_height"))


_HEXES = _STRIPES + ", x AS (SELECT doc_id, rows, repeat(repeat(lpad(to_hex(paper), 2, '0'), 18) || repeat(lpad(to_hex(ink), 2, '0'), 6), 3) AS line FROM s)"


@query(f"WITH {_HEXES} SELECT doc_id AS page_id, sha256(unhex(repeat('ff', 40 * 3 * 8) || repeat(repeat('ff', 24) || line || repeat('ff', 24), rows) || repeat('ff', 40 * 3 * (24 - rows)))) AS pixels FROM x")
def q_white_background(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = _rasters(spark, sf_dir)
    return transforms.white_background(images, _strokes(images))[0].select("page_id", F.sha2("rgb", 256).alias("pixels"))


@query(f"WITH {_HEXES} SELECT doc_id AS page_id, (6 + rows)::INT AS height, 4 AS x1, 4 AS y1, 28 AS x2, (4 + rows)::INT AS y2, sha256(unhex(repeat('ff', 40 * 3 * 4) || repeat(repeat('ff', 12) || line || repeat('ff', 36), rows) || repeat('ff', 40 * 3 * 2))) AS pixels FROM x")
def q_stack_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = _rasters(spark, sf_dir)
    canvases, regions = transforms.stack(images, _strokes(images), 4, 2)
    return canvases.select("page_id", "height", F.sha2("rgb", 256).alias("pixels")).join(regions.select("page_id", *layout.BOX), "page_id")


# -- draws ------------------------------------------------------------------------------------


def _page_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of the test data are numbered by their ids, which are dense."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_idx"))


@query()
def q_sample_locale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page_index(spark, sf_dir).select("page_idx", sampling.locale_of(F.col("page_idx")).alias("d")).select("page_idx", "d.*")


@query()
def q_sample_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    faces = [(f"{c}/{f}-{w}", f, c, w, it) for f, c, w, it in fonts.FACES]
    return _page_index(spark, sf_dir).select("page_idx", sampling.style_of(F.col("page_idx"), (F.col("page_idx") % 40).cast("int"), faces).alias("d")).select("page_idx", "d.*")


@query()
def q_flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of each page clipped, joined to paragraphs, localised by page and normalised."""
    blocks = layout.merge_wrapped(layout.clip(page_regions(spark, sf_dir), F.lit(WIDTH), F.lit(HEIGHT)))
    drawn = blocks.withColumn("d", sampling.locale_of(F.col("page_id"))).withColumn("text", T.apply_locale(F.col("text"), F.col("d.years"), F.col("d.digits"))).drop("d")
    return layout.page_records(drawn, F.lit(WIDTH), F.lit(HEIGHT))
