"""Stated units exactly, missing units by held-out accuracy."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from claimloom.functions.unitwords import figure
from claimloom.operators.quantities import common_unit, convert, isotonic, measured_facts, predict, read_facts, read_one, settled, train, words_of
from claimloom.session import table

SF = "/root/testdata/sf0.01"
READ = [
    (("₹8,142 Cr", None, None, None, "m", "en"), "INR", "8.1420e+10"),
    (("81,415.38", None, None, "(₹ in Million)", "m", "en"), "INR", "8.1415e+10"),
    (("Rs 1.01 lakh crore", None, None, None, "m", "hi"), "INR", "1.0100e+12"),
    (("२,८४०.७ करोड़ रुपये", None, None, None, "m", "hi"), "INR", "2.8407e+10"),
    (("2 lakh kg", "kg", 1e5, None, "m", "en"), "kg", "2.0000e+05"),
    (("130", "kg", 1e6, None, "m", "en"), "kg", "1.3000e+08"),
    (("2.635,1 MJ", None, 1.0, None, "m", "de"), "kWh", "7.3197e+02"),
    (("1 247,49", "RUB", None, None, "m", "ru"), "RUB", "1.2475e+03"),
    (("(32.4)", None, 1.0, "(in %)", "m", "en"), "percent", "-3.2400e+01"),
    (("536 bps", "%", 1.0, None, "m", "en"), "percent", "5.3600e+00"),
    (("0.3010", "fraction", None, None, "m", "en"), "percent", "3.0100e+01"),
    (("49.6 °F", None, None, None, "m", "en"), "celsius", "9.7778e+00"),
    (("511.0 K", None, None, None, "m", "en"), "celsius", "2.3785e+02"),
    (("USD 966.2 k", None, None, None, "m", "en"), "USD", "9.6620e+05"),
    (("9 mil millones euros", None, None, None, "m", "es"), "EUR", "9.0000e+09"),
    (("307亿吨", None, None, None, "m", "zh"), "kg", "3.0700e+13"),
    (("75พันล้านบาท", None, None, None, "m", "th"), "THB", "7.5000e+10"),
    (("14 sq. m", "sq. m", None, None, "m", "en"), "ha", "1.4000e-03"),
    (("23", None, 1.0, None, "land (in acres)", "en"), "ha", "9.3078e+00"),
    (("100", None, None, None, "m (in lbs)", "en"), "kg", "4.5359e+01"),
    (("5", "$", 1e9, None, "m", "en"), "USD", "5.0000e+09"),
]


@pytest.mark.parametrize("args,unit,sci", READ)
def test_read(args, unit, sci):
    """What stands beside the figure is read; what only a neighbouring field names is left to the forest and its check."""
    got = read_one(*args)
    if got[0] is not None:
        assert got[1:3] == (unit, sci)
    else:
        kind, name, factor = got[6].split("|")
        assert (common_unit((kind, name)), f"{convert(got[3], got[4], args[2], (kind, name, float(factor))):.4e}") == (unit, sci) and got[7]


def test_no_figure():
    assert read_one(None, "kg", None, None, None, "en") == (None,) * 8
    assert read_one("", None, None, None, None, None)[0] is None
    assert read_one("n/a", None, None, None, None, "xx")[0] is None
    assert figure("9" * 400, "en")[0] > 1e300


def facts(spark, rows):
    return spark.createDataFrame(rows, "id string, doc_id long, extracted_at timestamp, quantity struct<raw:string,unit:string,magnitude:double,kind:string>, header string, measure_raw string, measure_key string, source string")


def side(spark):
    return spark.createDataFrame([(1, "s")], "doc_id long, source string"), spark.createDataFrame([("s", "en")], "source string, lang string")


def test_cases(spark):
    t = dt.datetime
    rows = [
        ("a", 1, t(2024, 1, 1), ("5 kg", None, None, None), None, None, None, "clash"),
        ("a", 1, t(2024, 2, 1), ("6 kg", None, None, None), None, None, None, "clash"),
        ("b", None, None, ("7 %", None, None, None), None, None, None, None),
        ("c", 1, t(2024, 1, 1), None, None, None, None, None),
        (None, 1, t(2024, 1, 1), ("5 kg", None, None, None), None, None, None, None),
        ("d", 1, t(2024, 1, 1), ("12", None, None, None), None, "x", "x", None),
        ("e", 1, t(2024, 1, 1), ("9 shipments", None, None, None), None, "x", "x", None),
    ]
    done, review = settled(facts(spark, rows), *side(spark))
    assert {tuple(r) for r in done.select("id", "canonical_unit", "canonical_sci").collect()} == {("a", "kg", "6.0000e+00"), ("b", "percent", "7.0000e+00"), ("e", "count", "9.0000e+00")}
    assert [r.id for r in review.collect()] == ["d"]
    assert {r.id for r in measured_facts(facts(spark, rows), *side(spark)).collect()} == {"a", "b"}
    assert measured_facts(facts(spark, []), *side(spark)).count() == 0


def test_classifier_on_held_out_rows(spark):
    """Units hidden from rows that state them: confident predictions must be right."""
    read = read_facts(*(table(spark, SF, n) for n in ("facts", "documents", "sources"))).where("kind is not null").cache()
    fold = F.pmod(F.xxhash64("id"), F.lit(5)) == 0
    fitted = train(read.where(~fold))
    got = predict(read.where(fold).withColumnRenamed("label", "truth"), fitted).select("truth", "label", "probability").collect()
    sure = [r for r in got if r.probability >= 0.95]
    assert sum(r.truth.split("|")[0] == r.label.split("|")[0] for r in got) / len(got) > 0.8
    assert sure and sum(r.truth == r.label for r in sure) / len(sure) > 0.9
    # Each kind is right where it is held out, not only the frequent ones.
    assert all(right / n > 0.8 for right, n in fitted.accuracy.values() if n >= 10), fitted.accuracy


def test_units_of_neighbouring_fields_come_by_the_forest(spark):
    """Rows of several kinds get their unit from the forest, and the check agrees with what the heading says."""
    done, review = settled(*(table(spark, SF, n) for n in ("facts", "documents", "sources")))
    ways = {(r.kind, r.way): r.n for r in done.groupBy("kind", "way").agg(F.count("*").alias("n")).collect()}
    assert sum(n for (_, w), n in ways.items() if w == "confirmed") > 1000
    assert {k for k, w in ways if w == "confirmed"} >= {"money", "percent", "mass", "duration"}
    assert review.count() < 0.02 * done.count() and set(review.columns) == {"id", "label", "probability", "named"}


def test_curve_and_words():
    assert isotonic([(0.1, 0.0), (0.4, 1.0), (0.5, 0.0), (0.9, 1.0)]) == [(0.1, 0.0), (0.4, 0.5), (0.9, 1.0)]
    assert isotonic([]) == [] and words_of(None, "") == []
    assert words_of("(RMB in 亿元)") == ["rmb", "in", "亿元", "亿", "元"]
