"""Moments in many notations and clocks, normalised to milliseconds since 1970-01-01 UTC.

An ordered cascade of anchored patterns with strict parsing, all in JVM expressions. Policy for local times: one that
occurs twice (clocks set back) means the first, one that is skipped (clocks set forward) moves on by the gap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.months import NAMES, cascade, date_of, full_year, groups, let, listed, lookup, month_number, tidy

# Zone abbreviations and their offsets from UTC in minutes.
ZONES = {
    "z": 0, "utc": 0, "gmt": 0, "wet": 0, "west": 60, "bst": 60, "cet": 60, "cest": 120, "eet": 120, "eest": 180, "msk": 180,
    "gst": 240, "pkt": 300, "ist": 330, "npt": 345, "ict": 420, "hkt": 480, "sgt": 480, "jst": 540, "kst": 540, "aest": 600, "aedt": 660, "nzst": 720, "nzdt": 780,
    "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420,
}
# What stands for a missing value.
PLACEHOLDERS = ("", "-", "--", "—", "–", "n/a", "na", "n.a.", "n. a.", "nil", "none", "null", "nan", "nat", "?", "tbd", "unknown", "not available", "not applicable", ".", "..", "...")

_DAY_MS = 86_400_000
_CLOCK = (
    r"(?i)^([^:\[]*?)(?:(?:[t\s,]|(?<=日))\s*(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?\s*([ap]\.?m\.?)?"
    r"\s*(z|[a-z]{3,4}|[+-]\d{2}(?::?\d{2})?)?)?(?:\[([A-Za-z_]+(?:/[A-Za-z_+\-0-9]+)*)\])?$"
)
_COMPACT = r"(?i)^(\d{8})t(\d{2}):?(\d{2}):?(\d{2})?(?:[.,](\d{1,9}))?()\s*(z|[a-z]{3,4}|[+-]\d{2}(?::?\d{2})?)?(?:\[([A-Za-z_]+(?:/[A-Za-z_+\-0-9]+)*)\])?$"


def is_blank(text: Column) -> Column:
    """Whether a field says nothing: null, blank or a placeholder."""
    return text.isNull() | F.lower(tidy(text)).isin(*PLACEHOLDERS)


def _int(text: Column) -> Column:
    return text.cast("int")


def day_of(text: Column, order: Column) -> Column:
    """The day that a tidy, lower-case date text names; null where no pattern holds or there is no such day.

    Tried in order: year first, all-digit by ``order`` (DMY or MDY), day before month name, ISO week, ordinal day,
    month name before day, and eight digits.
    """

    def by_order(g: Column) -> Column:
        return F.when(order == "MDY", date_of(full_year(g[3]), _int(g[0]), _int(g[2]))).when(order == "DMY", date_of(full_year(g[3]), _int(g[2]), _int(g[0])))

    def by_ordinal(g: Column) -> Column:
        first = date_of(_int(g[0]), F.lit(1), F.lit(1))
        return F.when(F.year(F.date_add(first, _int(g[1]) - 1)) == F.year(first), F.date_add(first, _int(g[1]) - 1))

    return cascade(
        text,
        [
            (r"^(\d{4})([-/. 年])(\d{1,2})(?:\2|月)(\d{1,2})日?$", 4, lambda g: date_of(_int(g[0]), _int(g[2]), _int(g[3]))),
            (r"^(\d{1,2})([-/. ])(\d{1,2})\2(\d{4}|\d{2})$", 4, by_order),
            (
                rf"^(?:[^\d\s,]+,\s*|[a-z]{{3}} )?(\d{{1,2}})(?:st|nd|rd|th|er|º|ª|\.)?[-\s/.]*(?:de |of )?({NAMES})\.?,?[-\s/.]*(?:de |del )?(\d{{4}}|\d{{2}})(?: ?г\.?| года)?$",
                3,
                lambda g: date_of(full_year(g[2]), month_number(g[1]), _int(g[0])),
            ),
            (r"^(\d{4})-?w(\d{2})-?([1-7])$", 3, lambda g: F.when(_int(g[1]).between(1, 53), _week_day(_int(g[0]), _int(g[1]), _int(g[2])))),
            (r"^(\d{4})[-./](\d{3})$", 2, by_ordinal),
            (rf"^(?:[^\d\s,]+,\s*)?({NAMES})\.?[-\s]*(\d{{1,2}})(?:st|nd|rd|th)?,?[-\s]*(\d{{4}})$", 3, lambda g: date_of(_int(g[2]), month_number(g[0]), _int(g[1]))),
            (r"^(\d{4})(\d{2})(\d{2})$", 3, lambda g: date_of(_int(g[0]), _int(g[1]), _int(g[2]))),
        ],
    )


def _week_day(year: Column, week: Column, day: Column) -> Column:
    """A day of an ISO week: week 1 holds 4 January. A 53rd week the year lacks gives null."""
    fourth = date_of(year, F.lit(1), F.lit(4))
    got = F.date_add(fourth, -F.weekday(fourth) + (week - 1) * 7 + day - 1)
    return F.when(F.year(F.date_add(got, 4 - day)) == year, got)


def local_to_utc(local_ms: Column, zone: Column) -> Column:
    """Milliseconds on the clock of ``zone`` as UTC: the first of two, and past the gap of a skipped one."""
    return F.unix_millis(F.to_utc_timestamp(F.timestamp_millis(local_ms), zone))


def known_zones(spark: SparkSession) -> list[str]:
    """Zone names that the JVM can resolve."""
    return sorted(spark._jvm.java.time.ZoneId.getAvailableZoneIds())


def _number(text: Column, home: Column) -> Column:
    """The moment of a bare number by its digits."""
    whole, rest = F.substring_index(text, ".", 1), F.when(text.contains("."), F.substring_index(text, ".", -1)).otherwise("")
    digits = F.length(whole)
    day_count = (whole.cast("bigint") - 25569) * _DAY_MS + F.round(F.concat(F.lit("0."), rest, F.lit("0")).cast("double") * _DAY_MS).cast("bigint")
    return (
        F.when(digits.isin(9, 10), whole.cast("bigint") * 1000 + F.substring(F.rpad(rest, 3, "0"), 1, 3).cast("bigint"))
        .when(digits.isin(12, 13), whole.cast("bigint"))
        .when(digits == 5, local_to_utc(day_count, home))
        .when(digits.isin(15, 16), F.floor(whole.cast("bigint") / 1000).cast("bigint"))
        .when(digits.isin(18, 19), F.floor(whole.cast("decimal(20,0)") / 1_000_000).cast("bigint"))
    )


def _offset_minutes(zone: Column) -> Column:
    """Minutes of an offset such as +05:30, +0530 or +05, or of a zone abbreviation."""
    hhmm = F.regexp_replace(zone, ":", "")
    sign = F.when(F.substring(zone, 1, 1) == "-", -1).otherwise(1)
    minutes = F.when(F.length(hhmm) > 3, F.substring(hhmm, 4, 2).cast("int")).otherwise(0)
    return F.when(zone.rlike("^[+-]"), sign * (F.substring(hhmm, 2, 2).cast("int") * 60 + minutes)).otherwise(lookup(ZONES, zone, "int"))


def _time_of_day(part: Column) -> Column:
    """Milliseconds since midnight of the clock groups; null for a time no clock shows. No time is midnight."""
    number = lambda i: F.when(part[i] == "", 0).otherwise(part[i].cast("int"))
    half = F.lower(F.regexp_replace(part[5], r"\.", ""))
    hours = F.when(half == "", number(1)).when(number(1).between(1, 12), F.when(half == "am", number(1) % 12).otherwise(number(1) % 12 + 12))
    good = ((hours < 24) & (number(2) < 60) & (number(3) < 60)) | ((hours == 24) & (number(2) == 0) & (number(3) == 0))
    return F.when(good, hours.cast("bigint") * 3_600_000 + number(2) * 60_000 + number(3) * 1000 + F.substring(F.rpad(part[4], 3, "0"), 1, 3).cast("bigint"))


def moment(text: Column, order: Column, home_tz: Column, zones: list[str]) -> Column:
    """The moment a text states, in UTC milliseconds, or null where it cannot be told.

    Bare numbers are dates without separators (8 digits), spreadsheet day counts (5), or Unix times in seconds
    (9 or 10, with or without decimals), milliseconds (12 or 13), microseconds (16) or nanoseconds (19). A day without
    a time is midnight. What carries no zone is on the clock of ``home_tz``; with neither, it is null.
    """
    home = F.when(listed(zones, home_tz), home_tz)

    def placed(part: Column, local: Column) -> Column:
        zone = F.lower(part[6])
        return F.when(zone != "", local - _offset_minutes(zone).cast("bigint") * 60_000).when(part[7] != "", F.when(listed(zones, part[7]), local_to_utc(local, part[7]))).otherwise(local_to_utc(local, home))

    def clocked(part: Column) -> Column:
        day = day_of(F.regexp_replace(F.lower(part[0]), "[, t]+$", ""), order)
        return F.when(F.size(part) > 1, let(F.unix_date(day).cast("bigint") * _DAY_MS + _time_of_day(part), lambda local: placed(part, local)))

    def read(s: Column) -> Column:
        bare = s.rlike(r"^\d{5,7}(\.\d+)?$|^\d{9,19}(\.\d+)?$")
        parts = F.when(s.rlike(r"^\d{8}[tT]\d{4}"), groups(s, _COMPACT, 8)).otherwise(groups(s, _CLOCK, 8))
        return F.when(bare, _number(s, home)).otherwise(let(parts, clocked))

    return let(tidy(text), read)


def with_moments(df: DataFrame, fields: list[str], order: str, home_tz: str) -> DataFrame:
    """Adds ``<field>_ms``, the ``moment`` of each text field."""
    zones = known_zones(df.sparkSession)
    return df.withColumns({f"{f}_ms": moment(F.col(f), F.col(order), F.col(home_tz), zones) for f in fields})


def window_days(raw: Column, order: Column, fy_end: Column) -> Column:
    """First and last day of a window named in words: ``struct<first date, last date>``, or null for vague words.

    FY, fiscal and spans of years name the fiscal year that ends in the (last) year, closing with month ``fy_end``;
    a quarter or half of these is counted from the fiscal year's start; a quarter with a bare year is a calendar
    quarter; "year ended" and "N months to" a day are the months up to it; "as on" a day is that day.
    """
    fy = r"(?:fy|fiscal(?: year)?|financial year|f\.y\.)"
    span = r"(\d{2,4})(?:[-/](\d{2,4}))?"

    def last_year(a: Column, b: Column) -> Column:
        """The year a span ends in: a two-digit second year lies in the century of the first or the next."""
        first = full_year(a)
        short = first - first % 100 + b.cast("int")
        return F.when(b == "", first).when(F.length(b) > 2, b.cast("int")).otherwise(F.when(short < first, short + 100).otherwise(short))

    def months_from(start: Column, months: Column) -> Column:
        return F.struct(start.alias("first"), F.last_day(F.add_months(start, months - 1)).alias("last"))

    def fiscal(year: Column, months: Column, index: Column) -> Column:
        return months_from(F.add_months(date_of(year, fy_end, F.lit(1)), (index - 1) * months - 11), months)

    def calendar(year: Column, months: Column, index: Column) -> Column:
        return months_from(F.add_months(date_of(year, F.lit(1), F.lit(1)), (index - 1) * months), months)

    def part(letter: Column, index: Column, year: Column) -> Column:
        return F.when((letter == "q") | (index <= 2), fiscal(year, F.when(letter == "q", 3).otherwise(6), index))

    def whole(day: Column) -> Column:
        return F.struct(day.alias("first"), day.alias("last"))

    def up_to(g: Column) -> Column:
        lengths = {"year": 12, "half-year": 6, "half year": 6, "quarter": 3, "month": 1, "twelve": 12, "nine": 9, "six": 6, "three": 3, "12": 12, "9": 9, "6": 6, "3": 3}
        months = lookup(lengths, F.concat(g[0], g[1]), "int")
        return let(day_of(g[2], order), lambda end: F.struct(F.add_months(F.date_add(end, 1), -months).alias("first"), end.alias("last")))

    three, twelve, one = F.lit(3), F.lit(12), F.lit(1)
    steps = [
        (rf"^([qh])([1-4])(?: of)? ?{fy} ?'?{span}$", 4, lambda g: part(g[0], _int(g[1]), last_year(g[2], g[3]))),
        (rf"^{fy} ?'?{span}$", 2, lambda g: fiscal(last_year(g[0], g[1]), twelve, one)),
        (rf"^({NAMES})\.?,?[- ]?(?:de |del )?(\d{{4}})(?: г\.?| года)?$", 2, lambda g: calendar(_int(g[1]), one, month_number(g[0]))),
        (r"^(\d{4})(?:-|/|年)(0?[1-9]|1[0-2])月?$", 2, lambda g: calendar(_int(g[0]), one, _int(g[1]))),
        (r"^(?:cy|calendar year|year)? ?(\d{4})(?:年|年度)?()$", 2, lambda g: calendar(_int(g[0]), twelve, one)),
        (rf"^([1-4])([qh]) ?{fy} ?'?{span}$", 4, lambda g: part(g[1], _int(g[0]), last_year(g[2], g[3]))),
        (r"^([qh])([1-4])[: ] ?(\d{4})[-/](\d{2,4})$", 4, lambda g: part(g[0], _int(g[1]), last_year(g[2], g[3]))),
        (r"^(?:cy)? ?(\d{4})[- ]?q([1-4])$", 2, lambda g: calendar(_int(g[0]), three, _int(g[1]))),
        (r"^(?:q|t|т)([1-4])[: ]?(?:de )?(?:cy ?)?(\d{4})$", 2, lambda g: calendar(_int(g[1]), three, _int(g[0]))),
        (r"^(\d{4})[-/](\d{4}|\d{2})$", 2, lambda g: F.when(last_year(g[0], g[1]) == _int(g[0]) + 1, fiscal(last_year(g[0], g[1]), twelve, one))),
        (r"^as (?:on|at|of) (.+)()$", 2, lambda g: let(day_of(g[0], order), whole)),
        (r"^(?:the )?(?:(year|half[- ]year|quarter|month)|(twelve|nine|six|three|12|9|6|3) months?) (?:ended|ending|to|up to)(?: on)? (.+)$", 3, up_to),
        (r"^(h)([12])[: ] ?(\d{4})$", 3, lambda g: part(g[0], _int(g[1]), _int(g[2]))),
        (r"^([1-4])(?:\.|º|er|e|ème|-й)? ?(?:quartal|trimestre|trim\.|квартал|кв\.|तिमाही|ไตรมาส)(?: de| del)? ?(\d{4})(?: г\.?| года)?$", 2, lambda g: calendar(_int(g[1]), three, _int(g[0]))),
        (r"^(\d{4})年第?([1-4一二三四])(?:季度|四半期)$", 2, lambda g: calendar(_int(g[0]), three, F.translate(g[1], "一二三四", "1234").cast("int"))),
    ]
    return let(F.regexp_replace(F.lower(tidy(raw)), "[–—]", "-"), lambda s: cascade(s, steps))


def fact_windows(facts: DataFrame, documents: DataFrame, sources: DataFrame) -> DataFrame:
    """The window of every fact whose window can be told: ``id, start_utc_ms, end_utc_ms``, once per ``id``.

    ``period_start`` and ``period_end`` count where given; only where both say nothing does ``period.raw``. Of rows
    delivered twice the one extracted last counts. Facts without a known source keep windows that carry their own
    zone; a null id, a vague or broken text, or only one of the two moments gives no row. Empty tables give no rows;
    columns other than those named are not read.
    """
    habits = documents.select("doc_id", "source").join(sources.select("source", "home_tz", "date_order", "fy_end_month"), "source").dropDuplicates(["doc_id"]).drop("source")
    said = facts.where("id is not null").select("id", "doc_id", "extracted_at", F.col("period.raw").alias("raw"), "period_start", "period_end")
    blank = is_blank(F.col("period_start")) & is_blank(F.col("period_end"))
    stated = said.withColumn("in_words", blank).where(~(F.col("in_words") & is_blank(F.col("raw"))))
    df = stated.join(habits, "doc_id", "left")
    df = with_moments(df, ["period_start", "period_end"], "date_order", "home_tz")
    df = df.withColumn("w", F.when(F.col("in_words"), window_days(F.col("raw"), F.col("date_order"), F.col("fy_end_month"))))
    zones = known_zones(facts.sparkSession)
    midnight = lambda d: F.when(listed(zones, F.col("home_tz")), local_to_utc(F.unix_date(d).cast("bigint") * _DAY_MS, F.col("home_tz")))
    df = df.select(
        "id",
        "extracted_at",
        F.when(F.col("in_words"), midnight("w.first")).otherwise(F.col("period_start_ms")).alias("start_utc_ms"),
        F.when(F.col("in_words"), midnight("w.last")).otherwise(F.col("period_end_ms")).alias("end_utc_ms"),
    )
    last = df.groupBy("id").agg(F.max_by(F.struct("start_utc_ms", "end_utc_ms"), F.coalesce("extracted_at", F.lit("1900-01-01").cast("timestamp"))).alias("w"))
    return last.selectExpr("id", "w.start_utc_ms", "w.end_utc_ms").where("start_utc_ms is not null and end_utc_ms is not null")
