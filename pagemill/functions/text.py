"""Text analysis and Thai script as column functions; null in, null out unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters and patterns that results depend on.
THAI = "฀-๿"
LEADING_VOWELS = "เแโใไ"
ABOVE_VOWELS = "ิีึืั็ํ"
TONES = "่้๊๋"
THANTHAKHAT = "์"
YAMAKKAN = "๎"
BELOW = "ฺุู"
THAI_DIGITS = "๐๑๒๓๔๕๖๗๘๙"
MOJIBAKE = "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞßµ"
QUOTES = "\"'“”„«»"
REFUSAL = (
    r"please\s+(?:provide|specify|supply)\s+(?:me\s+)?(?:with\s+)?(?:the\s+)?(?:text|content)"
    r"|there\s+is\s+no\s+text|i\s+need\s+the\s+text|no\s+text\s+(?:was\s+)?provided"
    r"|กรุณาระบุข้อความ|โปรดระบุข้อความ|ไม่มีข้อความ"
)
#: The offset of the Buddhist era.
ERA = 543

ABOVE = ABOVE_VOWELS + TONES + THANTHAKHAT + YAMAKKAN
CLUSTER = f"(?s)[{LEADING_VOWELS}]*.[{ABOVE}{BELOW}]*"


def py_strip(c: Column) -> Column:
    """Without the white space (any that Unicode knows, and U+001C to U+001F) at either end."""
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def is_thai(ch: Column) -> Column:
    return ch.rlike(f"^[{THAI}]$")


def has_words(c: Column) -> Column:
    """Whether two letters, Latin or Thai, stand together."""
    return c.rlike(f"[A-Za-z{THAI}]{{2,}}")


def looks_like_garbage(c: Column) -> Column:
    """Whether a text reads as wrongly decoded: no two words, and single marks or many of them."""
    t = py_strip(c)
    words = F.size(F.regexp_extract_all(t, F.lit(f"([A-Za-z]{{3,}}|[{THAI}]{{3,}})"), F.lit(1)))
    single = F.size(F.filter(F.split(t, r"(?U)[\s\x1c-\x1f]+"), lambda x: x.rlike(f"^[{MOJIBAKE}]$")))
    share = (F.length(t) - F.length(F.regexp_replace(t, f"[{MOJIBAKE}]", ""))) / F.length(t)
    return F.when(F.length(t) < 3, False).when(words >= 2, False).otherwise((single >= 3) | (share > 0.25))


def is_disproportionate(source: Column, reply: Column) -> Column:
    return F.length(reply) > 3 * F.length(source) + 10


def clean_reply(c: Column) -> Column:
    """Stripped, unquoted if it ends with the quote it begins with, empty if it is a refusal."""
    t = py_strip(c)
    quoted = (F.length(t) >= 2) & t.rlike(f"^[{QUOTES}]") & (F.substring(t, 1, 1) == F.substring(t, -1, 1))
    t = F.when(quoted, py_strip(t.substr(F.lit(2), F.length(t) - 2))).otherwise(t)
    return F.when(t.rlike(f"(?i){REFUSAL}"), "").otherwise(t)


def clusters(c: Column) -> Column:
    """The text in clusters: leading vowels, a base, the marks on it."""
    return F.regexp_extract_all(c, F.lit(f"({CLUSTER})"), F.lit(1))


def cluster_spans(c: Column) -> Column:
    """The clusters as an array of (text, start, end), ends exclusive."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<text:string,start:int,end:int>>").alias("out"))
    add = lambda acc, x: F.struct((acc["at"] + F.length(x)).alias("at"), F.array_append(acc["out"], F.struct(x.alias("text"), acc["at"].alias("start"), (acc["at"] + F.length(x)).alias("end"))).alias("out"))
    return F.when(c.isNotNull(), F.aggregate(clusters(c), start, add)["out"])


def stack_depth(cluster: Column) -> Column:
    has = lambda chars: cluster.rlike(f"[{chars}]").cast("int")
    return 1 + has(BELOW) + has(ABOVE_VOWELS) + has(TONES + THANTHAKHAT)


def band(ch: Column) -> Column:
    return F.when(ch.rlike(f"^[{ABOVE}]$"), "above").when(ch.rlike(f"^[{BELOW}]$"), "below").otherwise("main")


def to_thai_digits(c: Column) -> Column:
    return F.translate(c, "0123456789", THAI_DIGITS)


def years_to_be(c: Column) -> Column:
    """Years from 1900 to 2099 that stand alone, in the Buddhist era. Any Unicode digit next to one
    makes it part of a longer number; its last two digits may be Thai."""
    ascii_of = lambda x: F.translate(x, THAI_DIGITS, "0123456789")
    runs = F.regexp_extract_all(c, F.lit(r"(?U)(\d+|\D+)"), F.lit(1))
    year = lambda x: F.when(x.rlike(f"^(?:19|20)[0-9{THAI_DIGITS}]{{2}}$"), (F.try_to_number(ascii_of(x), F.lit("9999")) + ERA).cast("int").cast("string")).otherwise(x)
    return F.array_join(F.transform(runs, year), "")


def apply_locale(c: Column, years: Column, digits: Column) -> Column:
    """Years first, so that their digits can follow."""
    t = F.when(years, years_to_be(c)).otherwise(c)
    return F.when(digits, to_thai_digits(t)).otherwise(t)


def folded(family: Column) -> Column:
    return F.regexp_replace(F.lower(family), "[^a-z0-9]", "")


def json_quoted(c: Column) -> Column:
    """A JSON string with only quotes, backslashes and control characters escaped."""
    for raw, esc in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f"), *((chr(i), f"\\u{i:04x}") for i in range(32) if i not in (8, 9, 10, 12, 13))):
        c = F.replace(c, F.lit(raw), F.lit(esc))
    return F.concat(F.lit('"'), c, F.lit('"'))


def cache_key(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat(*[json_quoted(p) for p in parts]), 256), 1, 20)


def translate_gate(source: Column, reply: Column) -> Column:
    """What a translated region shows: nothing for garbage, the source where there is nothing to
    translate or the reply runs away, else the cleaned reply."""
    cleaned = clean_reply(reply)
    return (
        F.when((py_strip(source) == "") | looks_like_garbage(source), "")
        .when(~has_words(source), source)
        .when(is_disproportionate(source, cleaned), source)
        .otherwise(cleaned)
    )
