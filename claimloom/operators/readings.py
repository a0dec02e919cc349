"""Facts as the project reads them: windows and values normalised from all their notations, in the linker's shape."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from ..functions.months import listed
from ..functions.periods import period_or_unknown
from ..functions.unitwords import figure
from ..session import materialise, tidied
from .quantities import settled
from .timestamps import fact_windows, known_zones

_DAY_MS = 86_400_000


def plain_raw(raw: str | None, lang: str | None) -> str | None:
    """A quantity's text with its figure in plain digits and a decimal point, its printed decimals kept."""
    got = figure(raw, lang)
    if got is None:
        return raw
    value, around = got
    text = "".join(str(unicodedata.decimal(c)) if c.isdecimal() else c for c in unicodedata.normalize("NFKC", raw))
    decimals = 0
    for m in re.finditer(r"[.,](\d+)(?!\d)", text):
        if f"{abs(value):.{len(m[1])}f}".endswith("." + m[1]):
            decimals = len(m[1])
    return f"{value:.{decimals}f} {" ".join(around.split())}".strip()


@pandas_udf(StringType())
def _plain_raw(raw: pd.Series, lang: pd.Series) -> pd.Series:
    return pd.Series([plain_raw(r, x) for r, x in zip(raw, lang, strict=True)], dtype=object)


def local_day(ms: Column, zone: Column, zones: list[str]) -> Column:
    """The day that a moment falls on by the clock of ``zone``; by UTC where the zone is not known."""
    at = F.timestamp_millis(ms)
    local = F.unix_millis(F.when(listed(zones, zone), F.from_utc_timestamp(at, zone)).otherwise(at))
    return F.date_from_unix_date(F.floor(local / _DAY_MS).cast("int"))


@tidied
def read_facts_of(facts: DataFrame, documents: DataFrame, sources: DataFrame) -> DataFrame:
    """The facts table in the linker's shape, with windows of ``fact_windows`` and values of ``settled``.

    Windows are days on the clock of the fact's source. A quantity's magnitude is all that its figure is multiplied
    by; one without a readable figure or a settled unit keeps its text and has no canonical value. A missing or unknown
    kind of period is read from its text. Of rows delivered twice the one extracted last counts.
    """
    order = F.coalesce("extracted_at", F.lit("1900-01-01").cast("timestamp"))
    last = facts.where("id is not null").groupBy("id").agg(F.max_by(F.struct(*[c for c in facts.columns if c != "id"]), order).alias("r")).select("id", "r.*")
    base, _ = materialise(last, "latest")
    zones = known_zones(facts.sparkSession)
    habits = documents.select("doc_id", "source").join(sources.select("source", "lang", "home_tz", "fy_end_month"), "source").dropDuplicates(["doc_id"]).drop("source")
    values = settled(base, documents, sources)[0].selectExpr("id", "canonical_unit as cu", "canonical_value as cv", "unit as u", "multiplier as m")
    df = base.join(habits, "doc_id", "left").join(fact_windows(base, documents, sources), "id", "left").join(values, "id", "left")
    q, p = F.col("quantity"), F.col("period")
    approx = F.coalesce(F.lower(q["raw"]).rlike(r"(about|approx|nearly|over|~)"), F.lit(False))
    quantity = F.when(q.isNotNull(), F.struct(_plain_raw(q["raw"], F.col("lang")).alias("raw"), q["value"].alias("value"), F.coalesce("u", q["unit"]).alias("unit"), F.coalesce("m", q["magnitude"]).alias("magnitude"), q["kind"].alias("kind"), F.col("cv").alias("canonical_value"), F.col("cu").alias("canonical_unit"), approx.alias("approximate")))
    day = lambda ms: local_day(F.col(ms), F.col("home_tz"), zones)
    df = df.withColumns({"words": period_or_unknown(p["raw"], F.coalesce("fy_end_month", F.lit(3))), "first": day("start_utc_ms"), "last": day("end_utc_ms")})
    kind = F.coalesce(F.when(p["kind"] != "unknown", p["kind"]), F.col("words.kind"), F.lit("unknown"))
    period = F.when(p.isNotNull() | F.col("first").isNotNull(), F.struct(p["raw"].alias("raw"), kind.alias("kind"), F.col("first").alias("start"), F.col("last").alias("end"), F.col("words.label").alias("label")))
    shaped = df.select(
        "id", "doc_id", "fact_type", "measure_key", "measure_raw", "entity", "entity_key", quantity.alias("quantity"), "value_text", period.alias("period"), "basis", "estimate_type", "as_of", "page", F.lit(None).cast("string").alias("quote"), "confidence"
    )
    return shaped
