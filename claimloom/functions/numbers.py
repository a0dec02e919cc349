"""Reading numbers out of text, as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .months import lookup

# Scale words and what they multiply by.
SCALE_WORDS = {
    "hundred": 1e2, "thousand": 1e3, "k": 1e3, "lakh": 1e5, "lakhs": 1e5, "lac": 1e5, "lacs": 1e5, "million": 1e6, "millions": 1e6, "mn": 1e6, "mln": 1e6, "m": 1e6,
    "crore": 1e7, "crores": 1e7, "cr": 1e7, "billion": 1e9, "billions": 1e9, "bn": 1e9, "b": 1e9, "trillion": 1e12, "tn": 1e12, "tr": 1e12,
}
# Words before a figure that make it approximate.
HEDGES = ("about", "approximately", "approx", "around", "nearly", "roughly", "circa", "~", "over", "more than", "almost", "close to", "in excess of")

BLANK = r"\s\x{00a0}\x{2007}\x{2009}\x{202f}"
#: Plain digits come before grouped ones only where no group follows, so a long ungrouped number stays whole.
BODY = rf"(?:\d{{1,3}}(?:[,{BLANK}]\d{{2,3}})+(?:\.\d+)?|\d+(?:\.\d+)?|\.\d+)"
#: The ordered alternatives of the original grammar, which cut ungrouped numbers after three digits.
STRICT_BODY = rf"(?:\d{{1,3}}(?:[,{BLANK}]\d{{2,3}})*(?:\.\d+)?|\d+(?:\.\d+)?|\.\d+)"


def number_pattern(strict: bool = False) -> str:
    return rf"(\(?)[{BLANK}]*([-−+]?)[{BLANK}]*({STRICT_BODY if strict else BODY})[{BLANK}]*(\)?)"


_SCALES = "|".join(sorted(SCALE_WORDS, key=lambda w: (-len(w), w)))


def strip_grouping(body: Column) -> Column:
    return F.regexp_replace(body, rf"[,{BLANK}]", "")


def plausible_grouping(body: Column) -> Column:
    """Whether the comma groups of a number body follow the Western (3, 3, ...) or Indian (..., 2, 2, 3) habit."""
    parts = F.split(F.substring_index(body, ".", 1), ",")
    rest = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    western = F.forall(rest, lambda g: F.length(g) == 3)
    indian = (F.length(F.element_at(parts, -1)) == 3) & F.forall(F.slice(rest, 1, F.greatest(F.size(rest) - 1, F.lit(0))), lambda g: F.length(g) == 2)
    return ~body.contains(",") | (F.length(parts[0]).between(1, 3) & (western | indian))


def scale_for(token: Column) -> Column:
    """Multiplier of a scale word, null of any other; case, outer blanks and a final point do not count."""
    return lookup(SCALE_WORDS, F.regexp_replace(F.lower(F.trim(token)), r"\.+$", ""), "double")


def scale_suffix(tail: Column) -> Column:
    """The scale word right at the start of the text after a number, in lower case; '' where there is none."""
    return F.lower(F.regexp_extract(tail, rf"(?i)^[{BLANK}]*({_SCALES})(?![A-Za-z])", 1))


def is_hedged(prefix: Column, strict: bool = False) -> Column:
    """Whether the 24 characters before a figure hold a hedge: as a word, or anywhere under ``strict``."""
    near = F.lower(F.substring(prefix, F.greatest(F.length(prefix) - 23, F.lit(1)), F.lit(24)))
    if strict:
        found = F.lit(False)
        for w in HEDGES:
            found = found | near.contains(w)
        return found
    words = "|".join(w for w in HEDGES if w != "~")
    return near.rlike(rf"(?:\b(?:{words})\b|~)")


def parse_number(text: Column, strict: bool = False) -> Column:
    """The first plausibly grouped number: ``struct<value, approximate, prefix, body, tail>``, null if there is none.

    A number in matched brackets is negative. Text before it decides whether it is approximate.
    """
    pattern = number_pattern(strict)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    bodies = F.regexp_extract_all(text, F.lit(pattern), F.lit(3))
    both = F.arrays_zip(hits.alias("hit"), bodies.alias("body"))
    start = F.struct(F.lit(1).alias("at"), F.lit(0).alias("found"), F.lit("").alias("hit"), F.lit("").alias("body"))

    def step(s: Column, x: Column) -> Column:
        at = F.call_function("locate", x["hit"], text, s["at"])
        good = plausible_grouping(x["body"])
        return F.when(s["found"] > 0, s).otherwise(F.struct((at + F.length(x["hit"])).alias("at"), F.when(good, at).otherwise(0).alias("found"), x["hit"].alias("hit"), x["body"].alias("body")))

    def finish(s: Column) -> Column:
        prefix = F.substring(text, F.lit(1), s["found"] - 1)
        size = strip_grouping(s["body"]).try_cast("double")
        paren = s["hit"].rlike(r"^\(") & s["hit"].rlike(r"\)$")
        signed = F.when(paren, -F.abs(size)).when(s["hit"].rlike(r"^\(?[\s\x{00a0}]*[-−]"), -size).otherwise(size)
        tail = F.substring(text, s["found"] + F.length(s["hit"]), F.length(text))
        made = F.struct(signed.alias("value"), is_hedged(prefix, strict).alias("approximate"), prefix.alias("prefix"), s["body"].alias("body"), tail.alias("tail"))
        return F.when((s["found"] > 0) & size.isNotNull(), made)

    return F.aggregate(both, start, step, finish)


def format_compact(value: Column) -> Column:
    """A short form with T, B, M or K and four significant digits."""
    size = F.abs(value)
    out = F.when(value.isNull(), F.lit(None).cast("string"))
    for limit, mark in ((1e12, "T"), (1e9, "B"), (1e6, "M"), (1e3, "K")):
        out = out.when(size >= limit, F.concat(significant(value / limit, 4), F.lit(mark)))
    return out.otherwise(significant(value, 4))


def significant(value: Column, digits: int) -> Column:
    """A number with so many significant digits and no trailing zeros."""
    places = F.lit(digits - 1) - F.floor(F.log10(F.greatest(F.abs(value), F.lit(1e-300)))).cast("int")
    power = F.pow(F.lit(10.0), F.abs(places))
    rounded = F.when(value == 0, F.lit(0.0)).when(places < 0, F.rint(value / power) * power).otherwise(F.rint(value * power) / power)
    return F.regexp_replace(F.regexp_replace(F.format_string("%.10f", rounded), r"(\.\d*?)0+$", "$1"), r"\.$", "")
