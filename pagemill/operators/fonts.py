"""The font bank as a small dimension table, and glyph inventories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagemill.functions.text import folded

# The bundled faces, (family, category, weight, italic).
FACES = [
    ("Chonburi", "display", 400, False),
    ("Pattaya", "display", 400, False),
    ("Purisa", "handwriting", 400, False),
    ("Sawasdee", "handwriting", 400, False),
    ("Charm", "handwriting", 400, False),
    ("Charmonman", "handwriting", 400, False),
    ("Itim", "handwriting", 400, False),
    ("Mali", "handwriting", 400, False),
    ("Sriracha", "handwriting", 400, False),
    ("Tlwg Mono", "monospace", 400, False),
    ("Tlwg Typewriter", "monospace", 400, False),
    ("Tlwg Typist", "monospace", 400, False),
    ("Garuda", "sans", 400, False),
    ("Umpush", "sans", 400, False),
    ("Kanit", "sans", 400, False),
    ("Noto Sans Thai", "sans", 400, False),
    ("Noto Sans Thai", "sans", 700, False),
    ("Prompt", "sans", 400, False),
    ("Sarabun", "sans", 400, False),
    ("Sarabun", "sans", 700, False),
    ("Kinnari", "serif", 400, False),
    ("Norasi", "serif", 400, False),
    ("Maitree", "serif", 400, False),
    ("Noto Serif Thai", "serif", 400, False),
    ("Noto Serif Thai", "serif", 700, False),
]


# Code points of modern Thai, in the order of the script, and those that a face may lack.
THAI = [*range(0x0E01, 0x0E3B), *range(0x0E3F, 0x0E5C)]
RARE = (0x0E3A, 0x0E3F, 0x0E45, 0x0E4E, 0x0E4F, 0x0E5A, 0x0E5B)
#: What a face must have to be used.
REQUIRED = [c for c in dict.fromkeys(THAI) if c not in RARE]


class UnknownFamily(KeyError):
    def __init__(self, name: str, known: list[str]) -> None:
        super().__init__(f"no family named {name!r}; there are: {', '.join(known) or 'none'}")


def families(faces: DataFrame, category: str | None = None) -> DataFrame:
    """The families, of one category or of all, in order."""
    found = faces if category is None else faces.where(F.col("category") == category)
    return found.select("family").distinct().orderBy("family")


def by_category(faces: DataFrame, category: str) -> DataFrame:
    return faces.where(F.col("category") == category)


def named(faces: DataFrame, name: str) -> DataFrame:
    """The one face of a family (see ``find``); an error that lists all families where there is none."""
    spark = faces.sparkSession
    found = find(spark.createDataFrame([(name,)], "name string"), faces).where("family IS NOT NULL")
    if found.isEmpty():
        raise UnknownFamily(name, [r.family for r in families(faces).collect()])
    return found


def shaping_face(faces: DataFrame, name: str | None = None) -> DataFrame:
    """The face that gives a glyph bank its proportions: the named one, or the first handwriting one, or the first."""
    if name is not None:
        return named(faces, name).select("family", "category", "weight")
    return faces.orderBy(F.col("category") != "handwriting", "pos").limit(1).select("family", "category", "weight")


def bank(spark: SparkSession) -> DataFrame:
    """(pos, family, category, weight, italic) of the bundled faces."""
    return spark.createDataFrame([(i, *f) for i, f in enumerate(FACES)], "pos long, family string, category string, weight int, italic boolean")


def find(wanted: DataFrame, faces: DataFrame) -> DataFrame:
    """The face of each wanted ``name``: upright and nearest to regular first; null if unknown."""
    best = faces.withColumn("key", folded(F.col("family"))).groupBy("key").agg(F.min_by(F.struct("family", "category", "weight", "italic"), F.struct("italic", F.abs(F.col("weight") - 400), "pos")).alias("f"))
    return wanted.join(F.broadcast(best), folded(wanted["name"]) == best["key"], "left").select(*wanted.columns, "f.family", "f.category", "f.weight")


def bold_variant(faces: DataFrame) -> DataFrame:
    """Each face with the weight of its family's heaviest bold of the same slant, or its own."""
    heavy = faces.where("weight >= 600").groupBy("category", "family", "italic").agg(F.max("weight").alias("bold"))
    return faces.join(F.broadcast(heavy), ["category", "family", "italic"], "left").select("pos", "family", "category", "weight", F.coalesce("bold", "weight").alias("bold_weight"))


def summary(faces: DataFrame) -> DataFrame:
    """Faces and families of each category, and of all (category null)."""
    return faces.rollup("category").agg(F.count("*").alias("faces"), F.countDistinct("family").alias("families"))


def missing_of(text: Column, glyphs: Column) -> Column:
    """How many distinct characters of a text are not in the array ``glyphs``; null and empty texts lack none."""
    return F.size(F.array_except(F.array_distinct(F.filter(F.split(F.coalesce(text, F.lit("")), ""), lambda c: c != "")), glyphs))


def inventory(glyphs: DataFrame, most: int = 1 << 17) -> Column:
    """The distinct ``char`` of ``glyphs`` as a literal array, after a check of their number."""
    found = [r.char for r in glyphs.select("char").distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"more than {most} characters")
    return F.array(*[F.lit(c) for c in sorted(found)]).cast("array<string>")


def missing(texts: DataFrame, glyphs: DataFrame, *by: str) -> DataFrame:
    """(by, code_points): how many distinct characters of the group's texts have no glyph."""
    chars = texts.select(*by, F.explode(F.split("text", "")).alias("char")).where("char <> ''").distinct()
    return chars.join(F.broadcast(glyphs.select("char").distinct()), "char", "left_anti").groupBy(*by).agg(F.count("*").alias("code_points"))


def coverage(texts: DataFrame, glyphs: DataFrame, *by: str, within: Column | None = None) -> DataFrame:
    """(by, coverage): the share of the characters, white space left out, that have a glyph."""
    chars = texts.select(*by, F.explode(F.split("text", "")).alias("char")).where(F.col("char").rlike(r"^\S$"))
    chars = chars if within is None else chars.where(within)
    counted = chars.groupBy(*by, "char").agg(F.count("*").alias("n"))  # one row for each character before the join
    known = counted.join(F.broadcast(glyphs.select("char").distinct().withColumn("has", F.lit(True))), "char", "left")
    return known.groupBy(*by).agg((F.sum(F.when(F.col("has"), F.col("n")).otherwise(0)) / F.sum("n")).alias("coverage"))


def span_ends(spans: DataFrame, *by: str, length: str = "n") -> DataFrame:
    """Each span's end: the start of the next, or the text's length."""
    return spans.withColumn("end", F.coalesce(F.lead("start").over(Window.partitionBy(*by).orderBy("start")), F.col(length)))
