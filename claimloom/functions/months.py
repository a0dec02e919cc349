"""Month names and digits of several languages as literal Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names in order, as words and their short forms, in the languages of the sources.
MONTHS = (
    "january jan januar jänner janvier enero ene января январь янв जनवरी",
    "february feb februar février févr fevrier fév febrero февраля февраль фев फरवरी फ़रवरी",
    "march mar märz marz mär mrz mars marzo марта март मार्च",
    "april apr avril avr abril abr апреля апрель अप्रैल",
    "may mai mayo мая май मई",
    "june jun juni juin junio июня июнь जून",
    "july jul juli juillet juil julio июля июль जुलाई",
    "august aug août aout agosto ago августа август авг अगस्त",
    "september sep sept septembre septiembre setiembre сентября сентябрь сен सितंबर सितम्बर",
    "october oct oktober okt octobre octubre октября октябрь окт अक्टूबर अक्तूबर",
    "november nov novembre noviembre ноября ноябрь नवंबर नवम्बर",
    "december dec dezember dez décembre decembre déc diciembre dic декабря декабрь дек दिसंबर दिसम्बर",
)
# Digits and separators of other widths and scripts, and their plain form.
WIDE = "０１２３４５６７８９०१२३४५६७८९๐๑๒๓๔๕๖๗๘๙／：．，－（）＋％" + "‐‑−​‌‍⁠﻿­"
PLAIN = "012345678901234567890123456789/:.,-()+%" + "---"

#: Every month name, longest first, for use inside a pattern.
NAMES = "|".join(sorted((w for line in MONTHS for w in line.split()), key=lambda w: (-len(w), w)))


def lookup(table: dict, key: Column, kind: str) -> Column:
    """The value of ``key`` in a small fixed table, null if it has none. The table travels as one literal, which keeps
    plans small where a map literal would add two nodes an entry."""
    packed = F.lit("|" + "".join(f"{k}={v}|" for k, v in table.items()))
    mark = F.concat(F.lit("|"), key, F.lit("="))
    return F.when(packed.contains(mark) & ~key.rlike("[|=]"), F.substring_index(F.call_function("substring_index", packed, mark, F.lit(-1)), "|", 1).cast(kind))


def listed(items: list[str], key: Column) -> Column:
    """Whether ``key`` is one of many fixed strings, which travel as one literal."""
    return F.lit("|" + "|".join(items) + "|").contains(F.concat(F.lit("|"), key, F.lit("|"))) & ~key.contains("|")


def month_number(name: Column) -> Column:
    """1 to 12 of a lower-case month name, null of any other word."""
    return lookup({w: i for i, line in enumerate(MONTHS, 1) for w in line.split()}, name, "int")


def tidy(text: Column) -> Column:
    """Plain digits and separators, single plain blanks, none outside; invisible characters are dropped."""
    return F.regexp_replace(F.regexp_replace(F.translate(text, WIDE, PLAIN), r"(?U)\s+", " "), "^ | $", "")


def groups(text: Column, pattern: str, count: int) -> Column:
    """All groups of an anchored pattern from one evaluation: an array of ``count`` strings, or of one if no match."""
    return F.split(F.regexp_replace(text, pattern, "\x01".join(f"${i}" for i in range(1, count + 1))), "\x01", count)


def date_of(y: Column, m: Column, d: Column) -> Column:
    """The date of three integers; null, not an error, where there is no such day."""
    zero = F.lit(0)
    return F.try_make_timestamp_ntz(y, m, d, zero, zero, zero).cast("date")


def full_year(text: Column) -> Column:
    """A year of two or four digits as an integer: 70 to 99 are 19xx, other two-digit years 20xx."""
    n = text.cast("int")
    return F.when(F.length(text) > 2, n).when(n >= 70, n + 1900).otherwise(n + 2000)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def cascade(text: Column, steps: list[tuple]) -> Column:
    """First step ``(pattern, groups, result)`` whose anchored pattern holds decides, even with a null result; null
    where none holds. Steps stand side by side, not nested, so that the plan grows in proportion to their number."""

    def step(result):
        return lambda g: F.when(F.size(g) > 1, F.struct(result(g).alias("v")))

    return F.coalesce(*[let(groups(text, pattern, count), step(result)) for pattern, count, result in steps])["v"]


def first_of(text: Column, steps: list[tuple]) -> Column:
    """As ``cascade``, but a step whose result is null is passed over, and the next one is tried."""

    def step(result):
        return lambda g: F.when(F.size(g) > 1, result(g))

    return F.coalesce(*[let(groups(text, pattern, count), step(result)) for pattern, count, result in steps])
