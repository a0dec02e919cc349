"""Reading windows of time out of text, as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..session import strip_blanks
from .months import date_of, first_of, let, lookup

# English month names and their short forms.
_MONTHS = {m: i for i, names in enumerate(("january jan", "february feb", "march mar", "april apr", "may", "june jun", "july jul", "august aug", "september sep sept", "october oct", "november nov", "december dec"), 1) for m in names.split()}
_NAMES = "|".join(sorted(_MONTHS, key=lambda w: (-len(w), w)))
_DIGITS = "".join(chr(zero + i) for zero in (0x0660, 0x06F0, 0x0966, 0x09E6, 0x0E50, 0xFF10) for i in range(10))
# How much each wording says about the month in which a fiscal year ends.
FISCAL_HINTS = (
    (rf"(?iU)(?:financial|fiscal)\s+year\s+ende[dr]\s+(?:on\s+)?(?:\d{{1,2}}\s+)?({_NAMES})\b", 5.0),
    (rf"(?iU)\byear\s+ended\s+(?:\d{{1,2}}\s+)?({_NAMES})\s+\d{{1,2}},?\s*\d{{4}}\b", 1.0),
    (rf"(?iU)\byear\s+ending\s+(?:\d{{1,2}}\s+)?({_NAMES})\b", 1.0),
    (rf"(?iU)\bas\s+(?:on|at)\s+(?:\d{{1,2}}\s+)?({_NAMES})\s+\d{{1,2}},?\s*\d{{4}}\b", 0.25),
)
#: How much the best month must outweigh the second.
FISCAL_MARGIN = 1.25


def month_of(name: Column) -> Column:
    return lookup(_MONTHS, F.lower(name), "int")


def last_day_of(year: Column, month: Column) -> Column:
    return F.last_day(date_of(year, month, F.lit(1)))


def expand_year(text: Column) -> Column:
    """Four digits as they are; otherwise from 70 on 19xx, below 20xx (a three-digit year lands in 2xxx)."""
    n = text.cast("int")
    return F.when(F.length(text) == 4, n).when(n >= 70, n + 1900).otherwise(n + 2000)


def span_end(first: Column, second: Column) -> Column:
    """The year a span such as 2023-24 ends in: a short second year takes the century of the first, or the next."""
    start = expand_year(first)
    short = start - start % 100 + second.cast("int")
    return F.when(F.coalesce(second, F.lit("")) == "", start).when(F.length(second) > 2, expand_year(second)).otherwise(F.when(short < start, short + 100).otherwise(short))


def _span(start: Column, months: Column) -> Column:
    return F.struct(start.alias("start"), F.last_day(F.add_months(start, months - 1)).alias("end"))


def fiscal_year_window(end_year: Column, fy_end_month: Column) -> Column:
    """``struct<start, end>`` of the fiscal year that closes with a month of ``end_year``."""
    return _span(F.add_months(date_of(end_year, fy_end_month, F.lit(1)), -11), F.lit(12))


def fiscal_quarter_window(end_year: Column, quarter: Column, fy_end_month: Column) -> Column:
    return _span(F.add_months(date_of(end_year, fy_end_month, F.lit(1)), (quarter - 1) * 3 - 11), F.lit(3))


def fiscal_half_window(end_year: Column, half: Column, fy_end_month: Column) -> Column:
    return _span(F.add_months(date_of(end_year, fy_end_month, F.lit(1)), (half - 1) * 6 - 11), F.lit(6))


def calendar_quarter_window(year: Column, quarter: Column) -> Column:
    return _span(date_of(year, (quarter - 1) * 3 + 1, F.lit(1)), F.lit(3))


def parse_period(text: Column, fy_end_month: Column, strict: bool = False) -> Column:
    """``struct<raw, kind, start, end, label>`` of the first pattern that holds, tried in a fixed order; else null.

    Patterns are tried one after the other over the whole text, not by position: fiscal quarters, halves, calendar
    quarters, fiscal years, calendar years, instants, "year ended", months, bare years. A pattern whose first match
    names no month or no day is passed over. Digits of other scripts are read, and shown, as plain ones. Unless
    ``strict``, a full ISO date is an instant before any span of years is seen in it.
    """
    int_ = lambda c: c.cast("int")

    def made(raw: Column, kind: str, window: Column, label: Column) -> Column:
        return let(window, lambda w: F.when(w["start"].isNotNull() & w["end"].isNotNull(), F.struct(strip_blanks(raw).alias("raw"), F.lit(kind).alias("kind"), w["start"].alias("start"), w["end"].alias("end"), label.alias("label"))))

    def quarter(raw, q, year):
        return made(raw, "fiscal_quarter", fiscal_quarter_window(year, q, fy_end_month), F.format_string("Q%d FY%d", q, year))

    def half(raw, h, year):
        return made(raw, "fiscal_half", fiscal_half_window(year, h, fy_end_month), F.format_string("H%d FY%d", h, year))

    def cal_quarter(raw, year, q):
        return made(raw, "calendar_quarter", calendar_quarter_window(year, q), F.format_string("%dQ%d", year, q))

    def year_of(raw, year, month=None):
        return made(raw, "fiscal_year", fiscal_year_window(year, fy_end_month if month is None else month), F.format_string("FY%d", year))

    def calendar_year(raw, year):
        return made(raw, "calendar_year", fiscal_year_window(year, F.lit(12)), F.format_string("CY%d", year))

    def month(raw, name, year):
        return let(month_of(name), lambda m: made(raw, "month", _span(date_of(year, m, F.lit(1)), F.lit(1)), F.format_string("%d-%02d", year, m)))

    def instant(raw, year, month, day):
        at = date_of(year, month, F.least(day, F.day(last_day_of(year, month))))
        return made(raw, "instant", F.struct(at.alias("start"), at.alias("end")), F.date_format(at, "yyyy-MM-dd"))

    day = lambda a, b: F.coalesce(F.nullif(a, F.lit("")), F.nullif(b, F.lit("")), F.lit("1")).cast("int")
    # The notations, the most telling first. A slash or a hyphen joins the years of a span.
    span = r"([0-9]{2,4})(?:\s*[-/]\s*([0-9]{2,4}))?"
    find = lambda body: rf"(?isU)^.*?({body}).*$"
    iso = (find(r"(?<!\d)((?:19|20)[0-9]{2})-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])(?!\d)"), 4, lambda g: instant(g[0], int_(g[1]), int_(g[2]), int_(g[3])))
    steps = [
        (find(rf"\bq([1-4])\s*[:\-]?\s*fy\s*{span}\b"), 4, lambda g: quarter(g[0], int_(g[1]), span_end(g[2], g[3]))),
        (find(rf"\b([1-4])\s*q\s*fy\s*{span}\b"), 4, lambda g: quarter(g[0], int_(g[1]), span_end(g[2], g[3]))),
        (find(rf"\bq([1-4])\s+of\s+(?:fy|fiscal(?:\s+year)?)\s*{span}\b"), 4, lambda g: quarter(g[0], int_(g[1]), span_end(g[2], g[3]))),
        (find(r"\bq([1-4])\s*[:\s]\s*([0-9]{4})\s*[-/]\s*([0-9]{2,4})\b"), 4, lambda g: quarter(g[0], int_(g[1]), span_end(g[2], g[3]))),
        (find(rf"\bh([12])\s*[:\-]?\s*(?:fy\s*)?{span}\b"), 4, lambda g: half(g[0], int_(g[1]), span_end(g[2], g[3]))),
        (find(r"\b(?:cy)?([0-9]{4})\s*[:\-]?\s*q([1-4])\b"), 3, lambda g: cal_quarter(g[0], int_(g[1]), int_(g[2]))),
        (find(r"\bq([1-4])\s*[,\s]\s*(?:cy\s*)?([0-9]{4})\b(?!\s*[-/]\s*\d)"), 3, lambda g: cal_quarter(g[0], int_(g[2]), int_(g[1]))),
        *([] if strict else [iso]),
        (find(r"\bfy\s*([0-9]{2,4})\s*[-/]\s*([0-9]{2,4})\b"), 3, lambda g: year_of(g[0], span_end(g[1], g[2]))),
        (find(r"\b(?:fy|fiscal(?:\s+year)?)\s*([0-9]{2,4})\b(?!\s*[-/]\s*\d)"), 2, lambda g: year_of(g[0], expand_year(g[1]))),
        (find(r"\b((?:19|20)[0-9]{2})\s*[-/]\s*([0-9]{2})\b"), 3, lambda g: year_of(g[0], span_end(g[1], g[2]))),
        (find(r"\b(?:cy|calendar\s+year)\s*([0-9]{4})\b"), 2, lambda g: calendar_year(g[0], int_(g[1]))),
        (find(r"\bas\s+(?:on|at|of)\s+([0-9]{1,2})?\s*([a-z]{3,9})\.?,?\s*([0-9]{1,2})?,?\s*([0-9]{4})\b"), 5, lambda g: instant(g[0], int_(g[4]), month_of(g[2]), day(g[1], g[3]))),
        (find(r"\b(?:year|period)\s+ended\s+(?:[0-9]{1,2})?\s*([a-z]{3,9})\.?,?\s*(?:[0-9]{1,2})?,?\s*([0-9]{4})\b"), 3, lambda g: year_of(g[0], int_(g[2]), month_of(g[1]))),
        (find(r"\b([a-z]{3,9})\.?\s+((?:19|20)[0-9]{2})\b"), 3, lambda g: month(g[0], g[1], int_(g[2]))),
        (find(r"\b((?:19|20)[0-9]{2})\b"), 2, lambda g: calendar_year(g[0], int_(g[1]))),
    ]
    return let(F.translate(text, _DIGITS, "0123456789" * (len(_DIGITS) // 10)), lambda t: first_of(t, steps))


def period_or_unknown(text: Column, fy_end_month: Column) -> Column:
    """``parse_period``, and kind 'unknown' with the trimmed text for anything else that is not blank."""
    none = F.lit(None)
    unknown = F.struct(strip_blanks(text).alias("raw"), F.lit("unknown").alias("kind"), none.cast("date").alias("start"), none.cast("date").alias("end"), none.cast("string").alias("label"))
    return F.when(strip_blanks(F.coalesce(text, F.lit(""))) != "", F.coalesce(parse_period(text, fy_end_month), unknown))


def resolved(p: Column) -> Column:
    return p["start"].isNotNull() & p["end"].isNotNull()


def overlaps(a: Column, b: Column) -> Column:
    """Whether two closed windows share a day; null where one is not resolved."""
    return F.when(resolved(a) & resolved(b), (a["start"] <= b["end"]) & (b["start"] <= a["end"]))


def same_window(a: Column, b: Column) -> Column:
    return F.when(resolved(a) & resolved(b), (a["start"] == b["start"]) & (a["end"] == b["end"]))


def days(p: Column) -> Column:
    """Days of a window, both ends counted."""
    return F.datediff(p["end"], p["start"]) + 1


def fiscal_votes(text: Column) -> Column:
    """All mentions that hint at the month a fiscal year ends in: ``array<struct<month, weight>>``."""
    found = []
    for pattern, weight in FISCAL_HINTS:
        found.append(_votes(text, pattern, weight))
    return F.concat(*found)


def _votes(text: Column, pattern: str, weight: float) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda m: F.struct(month_of(m).alias("month"), F.lit(weight).alias("weight")))


def infer_fiscal_year_end(text: Column) -> Column:
    """The month most mentions agree on, null unless it outweighs the second by ``FISCAL_MARGIN``."""

    def decide(votes: Column) -> Column:
        totals = F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: F.struct(F.aggregate(votes, F.lit(0.0), lambda s, v: s + F.when(v["month"] == i, v["weight"]).otherwise(0.0)).alias("w"), (-i).alias("neg")))
        return let(F.sort_array(totals, asc=False), lambda t: F.when((t[0]["w"] > 0) & (t[0]["w"] >= FISCAL_MARGIN * t[1]["w"]), -t[0]["neg"]))

    return let(fiscal_votes(text), decide)
