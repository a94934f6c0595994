"""Text functions as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters that the soft method ignores.
IGNORED = "()[] •*,:;?.!/-−–\"“”'‘’`$♦♥♣♠\u00a0\t\n\r"


def normalize_whitespace(s: Column) -> Column:
    """Each run of white space, no-break spaces too, as one space; ends aren't trimmed."""
    return F.regexp_replace(s, r"(?U)\s+", " ")


def normalize(s: Column, lower: bool = False) -> Column:
    s = normalize_whitespace(s)
    return F.lower(s) if lower else s


def strip_punctuation(s: Column) -> Column:
    return F.translate(s, IGNORED, "")


def person_name(s: Column) -> Column:
    """Initials without stops, and without blanks before them."""
    s = F.regexp_replace(F.regexp_replace(s, r"(?U)(\p{Lu})\.\s?", "$1 "), r"(?U)^\s+|\s+$", "")
    return F.regexp_replace(s, r"(?U)(?<=\p{Lu})\s(?=\p{Lu}\b)", "")


def doi_from_url(s: Column) -> Column:
    """The identifier in a link to it; null without one."""
    return F.nullif(F.regexp_extract(s, r"(?d)doi.org/(10\..*)", 1), F.lit(""))


def normalize_list(xs: Column, lower: bool = False, nested: bool = False) -> Column:
    """normalize() of each text of a list, or of each in a list of lists."""
    return F.transform(xs, lambda x: normalize_list(x, lower) if nested else normalize(x, lower))


def split_with_index(s: Column, pattern: str) -> Column:
    """array<struct<at, piece>>: what stands between matches of a pattern that hold no groups, without empty pieces, with its offset."""
    pieces = F.split(s, pattern)
    gaps = F.regexp_extract_all(s, F.lit(f"({pattern})"), 1)
    both = F.zip_with(pieces, gaps, lambda p, g: F.struct(p.alias("p"), F.coalesce(F.char_length(g), F.lit(0)).alias("g")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<at:int,piece:string>>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        n = F.char_length(x["p"])
        more = F.array(F.struct(a["at"].alias("at"), x["p"].alias("piece")))
        return F.struct((a["at"] + n + x["g"]).alias("at"), F.when(n > 0, F.concat(a["out"], more)).otherwise(a["out"]).alias("out"))

    return F.aggregate(both, start, step, lambda a: a["out"])


def last_page(first: Column, last: Column) -> Column:
    """An abbreviated last page, filled up from the first page."""
    more = F.char_length(first) - F.char_length(last)
    return F.when(F.coalesce(last, F.lit("")) == "", first).when(more > 0, F.concat(F.substring(first, F.lit(1), more), last)).otherwise(last)
