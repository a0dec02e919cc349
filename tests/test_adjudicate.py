"""The ladder on hand-made pairs, and what must hold of any pairs."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from claimloom.operators.adjudicate import adjudicate, rounding_tolerance
from claimloom.schemas import FACTS

D = dt.date


def fact(i, value=6.4, unit="percent", raw=None, magnitude=1.0, period=("FY25", "fiscal_year", D(2024, 4, 1), D(2025, 3, 31), "FY2025"), basis=(), estimate="actual", as_of=None, text=None, kind="numeric", doc=None, quote=None, page=1, src_unit=None):
    q = None if value is None else (raw or str(value), value / magnitude if magnitude else value, src_unit or unit, magnitude, "percent", value, unit, False)
    return (i, doc or f"d_{i}", kind, "m", "m", "E", "e", q, text, period, list(basis), estimate, as_of, page, quote, 0.9)


FY24 = ("FY24", "fiscal_year", D(2023, 4, 1), D(2024, 3, 31), "FY2024")
CASES = [
    (fact("a"), fact("b"), "corroborates", "exact_match"),
    (fact("a"), fact("b", 6.37, raw="6.37"), "corroborates", "rounded_match"),
    (fact("a", 8142e7, "INR", "8142", 1e7), fact("b", 81420e6, "INR", "81420", 1e6), "corroborates", "unit_converted_match"),
    (fact("a"), fact("b", 7.2), "contradicts", "value_divergence"),
    (fact("a"), fact("b", 9.2, period=FY24), "reconciled", "period_mismatch"),
    (fact("a", 5.4, period=("Q2 FY25", "fiscal_quarter", D(2024, 7, 1), D(2024, 9, 30), "Q2 FY2025")), fact("b", 7.8, period=("2025Q2", "calendar_quarter", D(2025, 4, 1), D(2025, 6, 30), "2025Q2")), "reconciled", "period_label_collision"),
    (fact("a", 10.0, basis=["consolidated"]), fact("b", 7.5, basis=["standalone"]), "reconciled", "basis_mismatch"),
    (fact("a", 6.4, estimate="advance_estimate"), fact("b", 6.5), "reconciled", "estimate_vs_actual"),
    (fact("a", 6.4, as_of=D(2025, 1, 31)), fact("b", 6.9, as_of=D(2025, 8, 30)), "reconciled", "vintage_revision"),
    (fact("a", period=("last year", "unknown", None, None, None)), fact("b", 7.2), "undetermined", "insufficient_context"),
    (fact("a"), fact("b", 6.4, "INR"), "related", "insufficient_context"),
    (fact("a"), fact("b", period=FY24), "related", "period_mismatch"),
    (fact("a", None), fact("b"), "undetermined", "insufficient_context"),
    (fact("a", doc="d", quote="rose 6.4 and 7.2"), fact("b", 7.2, doc="d", quote="Rose  6.4 and 7.2"), "undetermined", "shared_sentence_ambiguity"),
    (fact("a", None, text="appointed director", kind="state", as_of=D(2022, 5, 1)), fact("b", None, text="ceased to serve", kind="state", as_of=D(2024, 8, 1)), "supersedes", "state_superseded"),
    (fact("a", None, text="appointed director", kind="state"), fact("b", None, text="appointed director", kind="state"), "corroborates", "exact_match"),
    (fact("a", None, text="appointed director", kind="state"), fact("b", None, text="mine closed", kind="state"), "undetermined", "insufficient_context"),
    (fact("a", None, text=" ", kind="state"), fact("b", None, text="mine closed", kind="state"), None, None),
    (fact("a", None, text="plant opened today", kind="state"), fact("b", None, text="plant closed today again", kind="state"), None, None),
    (fact("a", 100.0, period=FY24), fact("b", 999.0), "reconciled", "period_mismatch"),
]


def pairs_of(spark, cases, swap=False):
    schema = f"k int, a struct<{_fields()}>, b struct<{_fields()}>"
    return spark.createDataFrame([(i, *((c[1], c[0]) if swap else (c[0], c[1]))) for i, c in enumerate(cases)], schema)


def _fields():
    out, depth, cur = [], 0, ""
    for ch in FACTS:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            out.append(cur.strip())
            cur = ""
        else:
            cur += ch
    return ", ".join(":".join(x.split(" ", 1)) for x in [*out, cur.strip()])


@pytest.mark.parametrize("swap", [False, True])
def test_ladder(spark, swap):
    for k, c in enumerate(CASES):
        c[0]
    ids = [((f"a{k}", *c[0][1:]), (f"b{k}", *c[1][1:]), *c[2:]) for k, c in enumerate(CASES)]
    got = {r.a_id[1:]: (r.type, r.reason_code) for r in adjudicate(pairs_of(spark, ids, swap)).select("a_id", "type", "reason_code").collect()}
    for k, c in enumerate(CASES):
        assert got.get(str(k), (None, None)) == (c[2], c[3]), k


def test_confidence_and_identity(spark):
    got = adjudicate(pairs_of(spark, CASES[3:4])).first()
    assert got.confidence == pytest.approx(0.822) and got.cross_document and got.id.startswith("r_")
    assert adjudicate(pairs_of(spark, CASES[3:4], True)).first().id == got.id


def test_a_fact_with_itself_gives_no_row(spark):
    assert adjudicate(pairs_of(spark, [(fact("a"), fact("a"), None, None)])).count() == 0


def test_tolerance(spark):
    df = spark.createDataFrame([("6.4", 1.0), ("6.437", 1.0), ("5", 1e6)], "raw string, magnitude double").select(F.struct("raw", "magnitude").alias("q"))
    assert [round(r[0], 6) for r in df.select(rounding_tolerance(F.col("q"))).collect()] == [0.05, 0.0005, 5e5]
