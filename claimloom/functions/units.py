"""Classifying a number by the words around it, as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .months import let, lookup
from .numbers import BLANK, SCALE_WORDS, parse_number, scale_for, scale_suffix

# Currency markers and their codes.
CURRENCY_CODES = {
    "₹": "INR", "rs": "INR", "rs.": "INR", "inr": "INR", "rupee": "INR", "rupees": "INR", "$": "USD", "us$": "USD", "usd": "USD", "dollars": "USD", "€": "EUR", "eur": "EUR",
    "£": "GBP", "gbp": "GBP", "¥": "JPY", "jpy": "JPY", "aed": "AED", "sgd": "SGD", "cny": "CNY", "rmb": "CNY",
}
# Nouns of mass (in kg) and of duration (in days).
MASS = {"kg": 1.0, "kgs": 1.0, "kilogram": 1.0, "kilograms": 1.0, "ton": 1000.0, "tons": 1000.0, "tonne": 1000.0, "tonnes": 1000.0, "mt": 1000.0}
DURATION = {"day": 1.0, "days": 1.0, "week": 7.0, "weeks": 7.0, "month": 30.436875, "months": 30.436875, "year": 365.25, "years": 365.25}

_MARKERS = r"us\$|[₹$€£¥]|(?<![A-Za-z])(?:rs\.?|inr|usd|eur|gbp|jpy|aed|sgd|cny|rmb)(?![A-Za-z])"
_STRICT_MARKERS = r"us\$|[₹$€£¥]|rs\.?|inr|usd|eur|gbp|jpy|aed|sgd|cny|rmb"
_WORDS = "|".join(sorted(SCALE_WORDS, key=lambda w: (-len(w), w)))


# Scale words that headings use, and what a unit hint may name as a percentage.
_HEADER_WORDS = "hundred|thousand|lakhs?|lacs?|millions?|crores?|billions?|trillions?"
_PERCENT_HINT = r"%|per cent|percent|pp|bps|basis points"


def _currency(text: Column, strict: bool, first: bool = False) -> Column:
    found = F.regexp_extract_all(F.lower(text), F.lit(f"({_STRICT_MARKERS if strict else _MARKERS})"), F.lit(1))
    return lookup(CURRENCY_CODES, F.try_element_at(found, F.lit(1 if first else -1)), "string")


def detect_currency(before: Column, strict: bool = False) -> Column:
    """Code of the last currency marker in the 40 characters before a number; codes of letters only as whole words,
    unless ``strict``."""
    return _currency(F.substring(before, F.greatest(F.length(before) - 39, F.lit(1)), F.lit(40)), strict)


def detect_percent(after: Column) -> Column:
    """'percent' or 'basis_points' from the 24 characters after a number, else null."""
    near = F.ltrim(F.lower(F.substring(after, 1, 24)))
    return F.when(near.rlike(r"^(?:%|per\s*cent|percent|percentage point)"), "percent").when(near.rlike(r"^(?:bps\b|basis points?)"), "basis_points")


def singularise(token: Column) -> Column:
    return F.when((F.length(token) > 4) & token.endswith("ies"), F.regexp_replace(token, "ies$", "y")).when(token.rlike("(?:ses|xes)$"), F.regexp_replace(token, "es$", "")).when(token.rlike("[^s]s$"), F.regexp_replace(token, "s$", "")).otherwise(token)


def magnitude_from_header(text: Column) -> Column:
    """Scale that a heading announces: "in <scale>" anywhere, else a currency before a scale; null where none does."""
    low = F.lower(text)
    first = F.regexp_extract(low, rf"(?U)\bin\s+({_HEADER_WORDS})\b", 1)
    second = F.regexp_extract(low, r"(?U)(?:₹|rs\.?|inr|usd|\$)\s*(?:in\s*)?(thousand|lakhs?|lacs?|millions?|crores?|billions?)\b", 1)
    return scale_for(F.when(first != "", first).otherwise(second))


def page_unit_hint(text: Column) -> Column:
    """The first "currency [in] scale" of a page with its brackets, as written; null where there is none."""
    found = F.regexp_extract(text, r"(?iU)(\(?\s*(?:₹|(?<![a-z])rs\.?|(?<![a-z])inr|(?<![a-z])usd|\$|€|£)\s*(?:in\s+)?(?:hundred|thousand|lakhs?|millions?|crores?|billions?)\s*\)?)", 1)
    return F.when(found != "", found)


def build_quantity(text: Column, unit_hint: Column, magnitude_hint: Column, strict: bool = False, hint_scales_money_only: bool = False) -> Column:
    """``struct<raw, value, unit, magnitude, kind, canonical_value, canonical_unit, approximate>``; null without a number.

    Order of decisions: percent after the number, basis points, currency before it, the first currency in the hint, a
    noun of mass or duration after it, percent in the hint, otherwise no unit. A scale word after the number counts,
    else the hint, else 1; basis points take no scale. A page's scale note multiplies whatever stands on the page, as
    the note says; ``hint_scales_money_only`` keeps it from percentages and durations. ``strict`` takes letters inside
    words for currencies, looks at the second word for a noun and cuts ungrouped digits.
    """

    hint = F.coalesce(unit_hint, F.lit(""))
    known = lambda w: lookup(MASS | DURATION, w, "double").isNotNull()

    def made(n: Column) -> Column:
        word = scale_suffix(n["tail"])
        after = F.regexp_replace(n["tail"], rf"(?i)^[{BLANK}]*(?:{_WORDS})(?![A-Za-z])\.?", "")
        return F.when(n.isNotNull(), let(F.struct(word.alias("word"), F.when(word != "", after).otherwise(n["tail"]).alias("rest")), lambda t: classified(n, t)))

    def classified(n: Column, t: Column) -> Column:
        nouns = let(F.struct(singularise(F.lower(F.regexp_extract(t["rest"], r"^[\s-]*([A-Za-z]+)", 1))).alias("near"), singularise(F.lower(F.regexp_extract(t["rest"], r"^[\s-]*[A-Za-z]+\.?\s+([A-Za-z]+)", 1))).alias("next")), lambda x: F.when(x["next"] != "", x["next"]).otherwise(x["near"]) if strict else F.when(known(x["near"]), x["near"]).otherwise(x["next"]))
        said = {
            "pct": F.coalesce(detect_percent(n["tail"]), detect_percent(t["rest"])),
            "cur": F.coalesce(detect_currency(n["prefix"], strict), _currency(hint, strict, first=True)),
            "noun": nouns,
            "own": scale_for(t["word"]),
        }
        return let(F.struct(*[v.alias(k) for k, v in said.items()]), lambda x: let(F.struct(lookup(MASS, x["noun"], "double").alias("mass"), lookup(DURATION, x["noun"], "double").alias("days")), lambda f: finished(n, x, f)))

    def finished(n: Column, x: Column, f: Column) -> Column:
        kind = F.when(x["pct"].isNotNull(), "percent").when(x["cur"].isNotNull(), "currency").when(f["mass"].isNotNull(), "count").when(f["days"].isNotNull(), "duration").when(F.lower(hint).rlike(_PERCENT_HINT), "percent").otherwise("other")
        return let(kind, lambda k: told(n, x, f, k))

    def told(n: Column, x: Column, f: Column, kind: Column) -> Column:
        canonical = F.when(kind == "percent", "percent").when(kind == "currency", x["cur"]).when(kind == "count", "kg").when(kind == "duration", "days")
        printed = F.when(x["pct"] == "basis_points", "bps").when(kind == "percent", "%").when(kind == "currency", x["cur"]).when(kind.isin("count", "duration"), x["noun"])
        hinted = F.when(kind == "currency", magnitude_hint) if hint_scales_money_only else magnitude_hint
        magnitude = F.coalesce(x["own"], F.nullif(hinted, F.lit(0.0)), F.lit(1.0))
        factor = F.when(kind == "count", f["mass"]).when(kind == "duration", f["days"]).otherwise(F.lit(1.0))
        value = F.when(kind == "other", F.lit(None).cast("double")).when(x["pct"] == "basis_points", n["value"] * 0.01).otherwise(n["value"] * magnitude * factor)
        fields = {"raw": F.substring(F.trim(text), 1, 120), "value": n["value"], "unit": printed, "magnitude": magnitude, "kind": kind, "canonical_value": value, "canonical_unit": canonical, "approximate": n["approximate"]}
        return F.struct(*[v.alias(k) for k, v in fields.items()])

    return let(parse_number(text, strict), made)


def comparable(a: Column, b: Column) -> Column:
    """Whether two quantities are in one unit and both have a value."""
    return F.coalesce((a["canonical_unit"] == b["canonical_unit"]) & a["canonical_value"].isNotNull() & b["canonical_value"].isNotNull(), F.lit(False))
