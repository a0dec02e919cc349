"""Document text functions, as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..session import strip_blanks
from .months import date_of
from .periods import month_of

# Words that make a passage dense in facts, as whole words in any case. A percent sign counts between two
# letters or figures only.
DENSE_WORDS = (
    r"per cent|percent|crore|lakh|million|billion|trillion|revenue|growth|increased?|decreased?|total|net|margin|ratio|rate|share|as on|as at|"
    r"appointed|resigned|ceased|effective from|compared|versus|vs|estimated|projected|stood at|reached|declined|rose|fell"
)
# Title lines that say nothing about a document.
GENERIC_TITLES = (
    "contents", "table of contents", "what's inside", "whats inside", "index", "annual report", "introduction", "overview", "disclaimer", "notice",
    "about this report", "highlights", "appendix", "glossary", "abbreviations",
)
_FULL_MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"


def clean_text(text: Column) -> Column:
    """Ligatures spelt out, soft hyphens and zero-width spaces dropped, quotes straightened, blanks collapsed, at most
    one empty line in a row."""
    t = F.replace(F.replace(text, F.lit("ﬁ"), F.lit("fi")), F.lit("ﬂ"), F.lit("fl"))
    t = F.translate(t, "‘’“”­​", "''\"\"")
    return F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r"\n{3,}", "\n\n")


def looks_like_heading(text: Column) -> Column:
    """At most 120 characters and 14 words, no closing mark, and mostly capitals or one plain line that begins with a
    capital or a section number and a capital."""
    t = strip_blanks(text)
    words = F.filter(F.split(t, r"(?U)\s+"), lambda w: w != "")
    letters = F.length(F.regexp_replace(t, r"[^\p{L}]", ""))
    upper = F.length(F.regexp_replace(t, r"[^\p{Lu}]", ""))
    plain = t.rlike(r"^(?:(?U:\d+(?:\.\d+)*\.?\s+))?[A-Z][A-Za-z ,'\-&/()]+$")
    return (t != "") & (F.length(t) <= 120) & ~t.rlike(r"[.;,]$") & (F.size(words) <= 14) & (((letters > 0) & (upper > letters * 0.6)) | plain)


def looks_like_table(text: Column) -> Column:
    """At least two lines, half of them (two at least) with three digits or 60 % with wide gaps."""
    lines = F.filter(F.split(text, "\n"), lambda x: strip_blanks(x) != "")
    n = F.size(lines)
    digits = F.size(F.filter(lines, lambda x: F.length(F.regexp_replace(x, r"\P{Nd}", "")) >= 3))
    gaps = F.size(F.filter(lines, lambda x: x.rlike(r"(?U)\S {2,}\S")))
    return (n >= 2) & ((digits >= F.greatest(F.lit(2.0), n * 0.5)) | (gaps >= F.greatest(F.lit(2.0), n * 0.6)))


def block_kind(text: Column) -> Column:
    return F.when(looks_like_heading(text), "heading").when(looks_like_table(text), "table").otherwise("prose")


def density_score(text: Column) -> Column:
    """How many facts a passage is likely to hold, 0 to 1: digits and telling words; passages under 60 characters
    count 0.4, blank ones nothing."""
    n = F.length(text)
    digits = F.length(F.regexp_replace(text, r"\P{Nd}", ""))
    marks = F.regexp_count(text, F.lit(rf"(?i)(?<![\p{{L}}\p{{N}}_])(?:{DENSE_WORDS})(?![\p{{L}}\p{{N}}_])|(?<=[\p{{L}}\p{{N}}_])%(?=[\p{{L}}\p{{N}}_])"))
    score = 0.55 * F.least(F.lit(1.0), 6.0 * digits / n) + 0.45 * F.least(F.lit(1.0), marks / 6.0)
    scaled = F.when(n < 60, score * 0.4).otherwise(score)
    return F.when(strip_blanks(text) != "", F.rint(F.least(F.lit(1.0), scaled) * 10_000) / 10_000).otherwise(0.0)


def published_date(first_pages: Column, meta: Column) -> Column:
    """The latest "[d] Month [d], yyyy" in the first 4,000 characters (days beyond 28 count as 28), else ``meta``.

    Months are written out in English; a day 0 names no date."""
    near = F.substring(first_pages, 1, 4000)
    pattern = rf"(?iU)\b([0-9]{{1,2}})?\s*({_FULL_MONTHS})\s+([0-9]{{1,2}})?,?\s*((?:19|20)[0-9]{{2}})\b"
    every = [F.regexp_extract_all(near, F.lit(pattern), F.lit(i)) for i in (1, 2, 3, 4)]
    day = lambda a, b: F.least(F.coalesce(F.nullif(a, F.lit("")), F.nullif(b, F.lit("")), F.lit("1")).cast("int"), F.lit(28))
    zipped = F.arrays_zip(every[0].alias("a"), every[1].alias("m"), every[2].alias("b"), every[3].alias("y"))
    return F.coalesce(F.array_max(F.transform(zipped, lambda g: date_of(g["y"].cast("int"), month_of(g["m"]), day(g["a"], g["b"])))), meta)


def pdf_date(value: Column) -> Column:
    """The day of a ``D:YYYYMMDD...`` value, else null."""
    return F.try_to_timestamp(F.regexp_extract(value, r"^D:(\d{8})", 1), F.lit("yyyyMMdd")).cast("date")


def iso_date(value: Column, partial: bool = False) -> Column:
    """A full ISO date from the first ten characters, else null; with ``partial`` a bare year or month counts as its
    first day."""
    head = F.substring(strip_blanks(value), 1, 10)
    full = F.when(head.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), head)
    if partial:
        full = full.when(head.rlike(r"^[0-9]{4}-[0-9]{2}$"), F.concat(head, F.lit("-01"))).when(head.rlike(r"^[0-9]{4}$"), F.concat(head, F.lit("-01-01")))
    return F.try_to_timestamp(full, F.lit("yyyy-MM-dd")).cast("date")


def is_generic_title(text: Column) -> Column:
    """Whether a title says nothing: furniture of a cover page, or under six letters."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z' ]", " "), " +", " "))
    return plain.isin(*GENERIC_TITLES) | (F.length(plain) < 6)


def title_line(text: Column) -> Column:
    """A line that could be a title: clean, 6 to 140 characters, at least half of them letters; else null."""
    t = strip_blanks(clean_text(text))
    return F.when(F.length(t).between(6, 140) & (F.length(F.regexp_replace(t, r"[^\p{L}]", "")) >= F.length(t) * 0.5), t)


def guess_title(meta: Column, largest: Column, first_page: Column, filename: Column) -> Column:
    """The metadata title, the first of the ``largest`` lines (an array, one a page) that says something, the first of
    them at all, the first line of 8 to 140 characters that is mostly letters, or the file name in words."""
    t = F.trim(F.coalesce(meta, F.lit("")))
    shown = F.filter(F.coalesce(largest, F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))
    lines = F.filter(F.transform(F.split(first_page, "\n"), strip_blanks), lambda x: F.length(x).between(8, 140) & (F.length(F.regexp_replace(x, r"[^\p{L}]", "")) > F.length(x) * 0.5))
    stem = F.translate(F.regexp_replace(F.regexp_extract(filename, "([^/]*)$", 1), r"(?<=.)\.[^.]*$", ""), "-_", "  ")
    best = F.coalesce(F.when((F.length(t) > 4) & ~F.lower(t).endswith(".pdf"), t), F.get(F.filter(shown, lambda x: ~is_generic_title(x)), F.lit(0)), F.get(shown, F.lit(0)), F.get(lines, F.lit(0)), stem)
    return F.substring(best, 1, 200)


def contains_value(quote: Column, raw: Column) -> Column:
    """Whether the digits of ``raw`` stand in the digits of ``quote``; true where ``raw`` has none."""
    digits = F.regexp_replace(F.coalesce(raw, F.lit("")), r"[^0-9]", "")
    return (digits == "") | F.regexp_replace(F.coalesce(quote, F.lit("")), r"[^0-9]", "").contains(digits)
