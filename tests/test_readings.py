"""Facts in notations that SQL cannot follow, linked as their plain windows and values say."""

import datetime as dt
from itertools import combinations

from pyspark.sql import functions as F

from claimloom.operators.adjudicate import compare_periods
from claimloom.operators.linking import candidate_pairs, link
from claimloom.operators.readings import plain_raw, read_facts_of

D, AT = dt.date, dt.datetime(2024, 1, 1)
SCHEMA = (
    "id string, doc_id long, fact_type string, measure_key string, measure_raw string, entity string, entity_key string, quantity struct<raw:string,value:double,unit:string,magnitude:double,kind:string>, header string,"
    "canonical_value double, canonical_unit string, value_text string, period struct<raw:string,kind:string>, period_start string, period_end string, basis array<string>, estimate_type string, as_of date, page int, confidence double, extracted_at timestamp"
)
FY25, FY24 = (D(2024, 4, 1), D(2025, 3, 31)), (D(2023, 4, 1), D(2024, 3, 31))
# id, doc (1: Kolkata, DMY, March; 2: Berlin, German, December), raw, unit, magnitude, period.raw, start, end; then window and value in INR.
ROWS = [
    ("a", 1, "₹ 8,142 crore", None, None, "FY25", None, "-", FY25, 8142e7),
    ("b", 1, "8142", "INR", 1e7, None, "2024-03-31T18:30:00Z", "31/03/2025", FY25, 8142e7),
    ("c", 1, "₹ 8,142 crore", None, None, "FY2023-24", "n/a", None, FY24, 8142e7),
    ("d", 2, "8.142,00 crore", "INR", 1.0, "2024", " ", None, (D(2024, 1, 1), D(2024, 12, 31)), 8142e7),
    ("e", 2, "9.000 crore", "INR", None, "Q2 2024", "", "", (D(2024, 4, 1), D(2024, 6, 30)), 9000e7),
    ("f", 1, "८१४२ crore", "₹", None, "Q2 FY25", "1 July 2024", "30.09.2024", (D(2024, 7, 1), D(2024, 9, 30)), 8142e7),
    ("g", 1, "₹ 8,142 crore", None, None, "last year", "-", None, None, 8142e7),
    ("h", 1, "₹ 9,000 crore", None, None, "FY25", "2024-04-01", "2025-03-31", FY25, 9000e7),
]


def frames(spark):
    rows = [(i, doc, "numeric", "m", "revenue", "E", "e", (raw, None, unit, mag, None), None, 1.0, None, None, (p, None), s, e, [], "actual", None, 1, 0.9, AT) for i, doc, raw, unit, mag, p, s, e, _, _ in ROWS]
    docs = spark.createDataFrame([(1, "in"), (2, "de")], "doc_id long, source string")
    sources = spark.createDataFrame([("in", "en", "Asia/Kolkata", "DMY", 3), ("de", "de", "Europe/Berlin", "DMY", 12)], "source string, lang string, home_tz string, date_order string, fy_end_month int")
    return spark.createDataFrame(rows, SCHEMA), docs, sources


def expected(x, y):
    """Status and verdict of two rows by their plain windows and values."""
    (wx, vx), (wy, vy) = x[-2:], y[-2:]
    shared = {m for m in ("Q2",) if m in (x[5] or "") and m in (y[5] or "")}
    if wx and wy:
        status = "same" if wx == wy else "label_collision" if shared else "different"
    else:
        status = "same" if x[5] == y[5] else "unknown"
    if abs(vx - vy) <= 0.005 * max(vx, vy):
        kind = "related" if status in ("different", "label_collision") else "corroborates"
    elif status == "unknown":
        kind = "undetermined"
    else:
        kind = "contradicts" if status == "same" else "reconciled"
    reason = {"label_collision": "period_label_collision", "different": "period_mismatch"}.get(status) if kind == "reconciled" else None
    return status, kind, reason


def test_every_notation_is_read(spark):
    read = read_facts_of(*frames(spark)).cache()
    got = {r.id: ((r.period.start, r.period.end) if r.period.start else None, r.quantity.canonical_value, r.quantity.canonical_unit) for r in read.collect()}
    assert got == {r[0]: (r[-2], r[-1], "INR") for r in ROWS}
    want = {(x[0], y[0]): expected(x, y) for x, y in combinations(ROWS, 2)}
    pairs = candidate_pairs(read).select("a.id", F.col("b.id").alias("other"), compare_periods(F.col("a.period"), F.col("b.period"))["status"].alias("s"))
    assert {(r.id, r.other): r.s for r in pairs.collect()} == {k: v[0] for k, v in want.items()}
    judged = link(read).collect()
    assert {(r.a_id, r.b_id): r.type for r in judged} == {k: v[1] for k, v in want.items()}
    assert {(r.a_id, r.b_id): r.reason_code for r in judged if r.type == "reconciled"} == {k: v[2] for k, v in want.items() if v[2]}


def test_plain_raw():
    cases = [("-384,99 млн ₽", "ru", "-384.99 млн ₽"), ("८.४", "hi", "8.4"), ("6.40 %", "en", "6.40 %"), ("10.358 t", "de", "10358 t"), ("INR 2,972.80 Cr.", "en", "2972.80 INR Cr."), ("none", "en", "none"), (None, "en", None)]
    assert [plain_raw(r, x) for r, x, _ in cases] == [w for _, _, w in cases]
