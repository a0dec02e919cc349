"""Comparing two facts and classifying the pair: an ordered ladder in which every explanation precedes a contradiction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import significant
from ..functions.periods import overlaps, resolved, same_window

# Tolerances, the gap in days that makes a revision plausible, and how firm each kind of figure is.
RELATIVE_TOLERANCE = 0.005
HEDGED_TOLERANCE = 0.05
REVISION_DAYS = 45
FIRMNESS = {"advance_estimate": 0, "projection": 0, "target": 0, "provisional": 1, "revised": 2, "actual": 3, "unknown": -1}


def rounding_tolerance(q: Column) -> Column:
    """Half a unit in the last printed decimal of the raw text, times the magnitude."""
    decimals = F.length(F.regexp_extract(F.coalesce(q["raw"], F.lit("")), r"\d\.(\d+)", 1))
    return 0.5 * F.pow(F.lit(10.0), -decimals) * F.coalesce(F.nullif(q["magnitude"], F.lit(0.0)), F.lit(1.0))


def value_tolerance(a: Column, b: Column) -> Column:
    hedged = F.coalesce(a["approximate"], F.lit(False)) | F.coalesce(b["approximate"], F.lit(False))
    relative = F.when(hedged, HEDGED_TOLERANCE).otherwise(RELATIVE_TOLERANCE)
    return F.greatest(rounding_tolerance(a), rounding_tolerance(b), relative * F.greatest(F.abs(a["canonical_value"]), F.abs(b["canonical_value"])))


def compare_values(a: Column, b: Column) -> Column:
    """``struct<comparable, a_value, b_value, unit, delta, relative_delta, tolerance, agree, exact, converted>``."""
    both = F.coalesce((a["canonical_unit"] == b["canonical_unit"]) & a["canonical_value"].isNotNull() & b["canonical_value"].isNotNull(), F.lit(False))
    delta = F.abs(a["canonical_value"] - b["canonical_value"])
    largest = F.greatest(F.abs(a["canonical_value"]), F.abs(b["canonical_value"]))
    tolerance = value_tolerance(a, b)
    converted = ~a["magnitude"].eqNullSafe(b["magnitude"]) | ~a["unit"].eqNullSafe(b["unit"])
    only = lambda c: F.when(both, c)
    return F.struct(
        both.alias("comparable"), only(a["canonical_value"]).alias("a_value"), only(b["canonical_value"]).alias("b_value"), only(a["canonical_unit"]).alias("unit"), only(delta).alias("delta"),
        only(delta / F.when(largest == 0, 1.0).otherwise(largest)).alias("relative_delta"), only(tolerance).alias("tolerance"), only(delta <= tolerance).alias("agree"), only(delta == 0).alias("exact"), only(converted).alias("converted"),
    )


def _marks(p: Column) -> Column:
    """Quarter and half-year labels in a period's text, such as q2 or h1."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(p["raw"], F.lit(""))), F.lit(r"(?<![a-z])(q[1-4]|h[12])(?![a-z])"), F.lit(1)))


def compare_periods(a: Column, b: Column) -> Column:
    """``struct<status, overlaps, shared_tokens>``; status is same, different, label_collision or unknown."""
    shared = F.array_intersect(_marks(a), _marks(b))
    meet = overlaps(a, b)
    collide = (F.size(shared) > 0) & (~a["kind"].eqNullSafe(b["kind"]) | ~meet)
    same_text = F.lower(F.trim(a["raw"])) == F.lower(F.trim(b["raw"]))
    status = (
        F.when(a.isNull() | b.isNull(), "unknown")
        .when(resolved(a) & resolved(b), F.when(same_window(a, b), "same").when(collide, "label_collision").otherwise("different"))
        .when(F.coalesce(same_text, F.lit(False)), "same")
        .otherwise("unknown")
    )
    return F.struct(status.alias("status"), meet.alias("overlaps"), shared.alias("shared_tokens"))


def normal_basis(values: Column) -> Column:
    trimmed = F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.lower(F.trim(v)))
    return F.array_sort(F.array_distinct(F.filter(trimmed, lambda v: v.isNotNull() & (v != ""))))


def compare_basis(a: Column, b: Column) -> Column:
    """``struct<a_basis, b_basis, only_a, only_b, differs>`` of two lists of qualifiers."""
    x, y = normal_basis(a), normal_basis(b)
    return F.struct(x.alias("a_basis"), y.alias("b_basis"), F.array_except(x, y).alias("only_a"), F.array_except(y, x).alias("only_b"), ((F.size(F.array_except(x, y)) > 0) | (F.size(F.array_except(y, x)) > 0)).alias("differs"))


def firmness(kind: Column) -> Column:
    out = F.lit(-1)
    for name, level in FIRMNESS.items():
        out = F.when(kind == name, level).otherwise(out)
    return out


def compare_vintage(a_type: Column, a_as_of: Column, b_type: Column, b_as_of: Column) -> Column:
    """``struct<a_estimate_type, b_estimate_type, estimate_differs, firmer, as_of_gap_days, later_fact, revision_plausible>``."""
    x, y = F.coalesce(a_type, F.lit("unknown")), F.coalesce(b_type, F.lit("unknown"))
    gap = F.abs(F.datediff(a_as_of, b_as_of))
    fa, fb = firmness(x), firmness(y)
    differs = (x != y) & (x != "unknown") & (y != "unknown")
    return F.struct(
        x.alias("a_estimate_type"), y.alias("b_estimate_type"), differs.alias("estimate_differs"), F.when(differs & (fa > fb), "a").when(differs & (fb > fa), "b").alias("firmer"), gap.alias("as_of_gap_days"),
        F.when(gap.isNotNull(), F.when(a_as_of > b_as_of, "a").otherwise("b")).alias("later_fact"), F.coalesce(gap >= REVISION_DAYS, F.lit(False)).alias("revision_plausible"),
    )


def same_sentence(a: Column, b: Column) -> Column:
    """Whether two facts of one page quote the same sentence, or one quote holds the other."""
    norm = lambda q: F.trim(F.regexp_replace(F.lower(F.coalesce(q, F.lit(""))), r"(?U)\s+", " "))
    x, y = norm(a["quote"]), norm(b["quote"])
    return F.coalesce((a["doc_id"] == b["doc_id"]) & (a["page"] == b["page"]) & (x != "") & (y != "") & (x.contains(y) | y.contains(x)), F.lit(False))


def text_overlap(a: Column, b: Column) -> Column:
    """Share of words longer than two characters that two texts have in common."""
    words = lambda t: F.array_distinct(F.filter(F.regexp_extract_all(F.lower(F.coalesce(t, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1)), lambda w: F.length(w) > 2))
    x, y = words(a), words(b)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def relation_id(a_id: Column, b_id: Column) -> Column:
    return F.concat(F.lit("r_"), F.substring(F.sha1(F.concat_ws("|", F.least(a_id, b_id), F.greatest(a_id, b_id))), 1, 16))


def describe(f: Column) -> Column:
    """A fact in words: its value and the period it stands for."""
    value = F.coalesce(f["quantity"]["raw"], f["value_text"], F.lit(""))
    return F.concat(value, F.lit(" for "), F.coalesce(f["period"]["label"], f["period"]["raw"], F.lit("an unstated period")))


#: Columns a fact needs to be adjudicated; ``facts_of`` gives them.
FACT_FIELDS = ("id", "doc_id", "fact_type", "quantity", "value_text", "period", "basis", "estimate_type", "as_of", "page", "quote", "confidence")


def adjudicate(pairs: DataFrame, a: str = "a", b: str = "b", keep_silent: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """Relations of fact pairs held in two struct columns, one row per pair that earns one.

    First hit wins. Numeric pairs: a missing quantity, other units, agreement (with or without a shared period), label
    collision, other period, other basis, other firmness, later revision, one sentence, unknown period, and only then
    contradiction. Pairs of statements: overlap of words, supersession by date, little overlap; in between, and with a
    blank text, they give no row (``keep_silent`` keeps them, with a null type). Columns named in ``carry`` go along. A fact paired with itself gives none.
    """
    fa, fb = F.col(a), F.col(b)
    base = pairs.where(fa["id"] != fb["id"]).withColumns(
        {
            "__v": compare_values(fa["quantity"], fb["quantity"]),
            "__p": compare_periods(fa["period"], fb["period"]),
            "__b": compare_basis(fa["basis"], fb["basis"]),
            "__w": compare_vintage(fa["estimate_type"], fa["as_of"], fb["estimate_type"], fb["as_of"]),
            "__s": same_sentence(fa, fb),
            "__o": text_overlap(fa["value_text"], fb["value_text"]),
        }
    )
    v, p, basis, w = (F.col(c) for c in ("__v", "__p", "__b", "__w"))
    numeric = (fa["quantity"].isNotNull() & fb["quantity"].isNotNull()) | ((fa["fact_type"] == "numeric") & (fb["fact_type"] == "numeric"))
    hit = lambda kind, reason, conf: F.struct(F.lit(kind).alias("type"), F.lit(reason).alias("reason_code"), (conf if isinstance(conf, Column) else F.lit(float(conf))).alias("conf"))
    lowered = lambda base_: F.lit(base_) - F.when(p["status"] == "unknown", 0.20).otherwise(0.0) - F.when(basis["differs"], 0.10).otherwise(0.0)
    agree, apart = F.coalesce(v["agree"], F.lit(False)), p["status"].isin("different", "label_collision")
    number_case = (
        F.when(fa["quantity"].isNull() | fb["quantity"].isNull(), hit("undetermined", "insufficient_context", 0.30))
        .when(~v["comparable"], hit("related", "insufficient_context", 0.25))
        .when(agree & apart, hit("related", "period_mismatch", 0.40))
        .when(agree & v["exact"] & ~v["converted"], hit("corroborates", "exact_match", lowered(0.95)))
        .when(agree & v["converted"], hit("corroborates", "unit_converted_match", lowered(0.90)))
        .when(agree, hit("corroborates", "rounded_match", lowered(0.85)))
        .when(p["status"] == "label_collision", hit("reconciled", "period_label_collision", 0.85))
        .when(p["status"] == "different", hit("reconciled", "period_mismatch", 0.80))
        .when(basis["differs"], hit("reconciled", "basis_mismatch", 0.75))
        .when(w["estimate_differs"], hit("reconciled", "estimate_vs_actual", 0.70))
        .when(w["revision_plausible"], hit("reconciled", "vintage_revision", 0.60))
        .when(F.col("__s"), hit("undetermined", "shared_sentence_ambiguity", 0.45))
        .when(p["status"] == "unknown", hit("undetermined", "insufficient_context", 0.40))
        .otherwise(hit("contradicts", "value_divergence", 0.60 + F.least(F.lit(0.35), 2.0 * v["relative_delta"])))
    )
    blank = (F.trim(F.coalesce(fa["value_text"], F.lit(""))) == "") | (F.trim(F.coalesce(fb["value_text"], F.lit(""))) == "")
    text_case = (
        F.when(blank, F.lit(None))
        .when(F.col("__o") >= 0.6, hit("corroborates", "exact_match", 0.70))
        .when(w["revision_plausible"], hit("supersedes", "state_superseded", 0.70))
        .when(F.col("__o") < 0.2, hit("undetermined", "insufficient_context", 0.35))
    )
    judged = base.withColumn("__r", F.when(F.coalesce(numeric, F.lit(False)), number_case).otherwise(text_case))
    if not keep_silent:
        judged = judged.where("__r is not null")
    conf = F.bround(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("__r.conf"))), 3)
    says = F.concat(describe(fa), F.lit(" against "), describe(fb), F.when(v["comparable"], F.concat(F.lit("; apart by "), significant(v["delta"], 4), F.lit(" where "), significant(v["tolerance"], 4), F.lit(" is allowed"))).otherwise(""))
    return judged.select(
        relation_id(fa["id"], fb["id"]).alias("id"), fa["id"].alias("a_id"), fb["id"].alias("b_id"), F.col("__r.type").alias("type"), F.col("__r.reason_code").alias("reason_code"), conf.alias("confidence"), says.alias("explanation"),
        F.struct(v.alias("values"), p.alias("periods"), basis.alias("basis"), w.alias("vintage"), F.bround(F.col("__o"), 3).alias("text_overlap")).alias("analysis"), F.lit("deterministic").alias("adjudicator"), (fa["doc_id"] != fb["doc_id"]).alias("cross_document"), *carry,
    )
