"""Scalar functions against stated cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from claimloom.functions import entities, loosejson, measures, numbers, periods, text, units


def values(spark, rows, schema, **columns):
    df = spark.createDataFrame(rows, schema)
    return df.select(*[c.alias(k) for k, c in columns.items()]).collect()


def test_numbers(spark):
    """Digits as they stand, grouped in thousands or in lakhs, signed by a dash or by brackets; text around them is no matter."""
    cases = [
        ("£73.5 bn was lent", 73.5), ("net loss (617)", -617.0), ("US$ (9.25) m", -9.25), ("98,76,54,321 shares", 987654321.0), ("up .75 points", 0.75), ("−48 °C", -48.0), ("+3,250", 3250.0),
        ("77 000 tonnes", 77000.0), ("20261 units", 20261.0), ("lot 1,23,45 then 56", 56.0), ("Q", None), ("  ", None), (None, None),
    ]
    got = values(spark, cases, "t string, want double", v=numbers.parse_number(F.col("t"))["value"], want=F.col("want"))
    assert [r.v for r in got] == [r.want for r in got]


def test_strict_numbers_cut_ungrouped_digits(spark):
    assert values(spark, [("58213",)], "t string", v=numbers.parse_number(F.col("t"), strict=True)["value"])[0].v == 582.0


def test_hedges(spark):
    """A hedge counts within 24 characters before the figure, as a word; ``strict`` finds it inside words too."""
    rows = [("nearly 19 wagons",), ("in excess of 4.2 km",), ("19 wagons, nearly",), ("~6",), ("nearly all of the loaded barges, 19",), ("handover 19",)]
    got = values(spark, rows, "t string", a=numbers.parse_number(F.col("t"))["approximate"], s=numbers.parse_number(F.col("t"), True)["approximate"])
    assert [r.a for r in got] == [True, True, False, True, False, False] and got[5].s


def test_grouping(spark):
    rows = [("9,87,65",), ("4,300,200,100",), ("6,54,32,100",), ("7",), ("1234,567",), ("9,8765",), ("5,000.25",)]
    got = values(spark, rows, "t string", p=numbers.plausible_grouping(F.col("t")))
    assert [r.p for r in got] == [False, True, True, True, False, False, True]


def test_quantities(spark):
    rows = [
        ("Rs. 46 lakh", None), ("460", "figures in Rs. '000 and in thousand"), ("12.5 %", "(€ in lakhs)"), ("(77.1)", "(£ in millions)"), ("EUR 2.5 bn", None), ("85 basis points", "in crore"), ("3 kgs", None), ("2 weeks later", None),
        ("drivers 91", None), ("14", "share, per cent"), ("6 mn tonnes", None), ("none", "(₹ in lakh)"),
    ]
    q = units.build_quantity(F.col("t"), F.col("h"), units.magnitude_from_header(F.col("h")))
    got = [r.q for r in values(spark, rows, "t string, h string", q=q)]
    assert (got[0].canonical_unit, got[0].canonical_value) == ("INR", 4.6e6)
    assert (got[1].canonical_unit, got[1].magnitude, got[1].canonical_value) == ("INR", 1e3, 4.6e5)
    # The page's scale note multiplies whatever stands on the page.
    assert (got[2].kind, got[2].unit, got[2].canonical_value) == ("percent", "%", 1.25e6)
    assert (got[3].canonical_unit, got[3].canonical_value) == ("GBP", pytest.approx(-7.71e7))
    assert (got[4].canonical_unit, got[4].canonical_value) == ("EUR", 2.5e9)
    assert (got[5].unit, got[5].canonical_unit, got[5].canonical_value) == ("bps", "percent", pytest.approx(0.85))
    assert (got[6].kind, got[6].unit, got[6].canonical_value) == ("count", "kg", 3.0)
    assert (got[7].kind, got[7].canonical_unit, got[7].canonical_value) == ("duration", "days", 14.0)
    assert (got[8].kind, got[8].canonical_value) == ("other", None)
    assert (got[9].kind, got[9].canonical_value) == ("percent", 14.0)
    assert (got[10].canonical_unit, got[10].canonical_value) == ("kg", 6e9)
    assert got[11] is None
    plain = units.build_quantity(F.col("t"), F.col("h"), units.magnitude_from_header(F.col("h")), hint_scales_money_only=True)
    assert [r.q.canonical_value for r in values(spark, rows[2:4], "t string, h string", q=plain)] == [12.5, pytest.approx(-7.71e7)]


def test_headers(spark):
    rows = [("Rs. in crores", 1e7), ("values in lacs", 1e5), ("USD thousand", 1e3), ("inr in billions", 1e9), ("the trains ran in March", None), ("£ million", None), ("in trillions", None)]
    got = values(spark, rows, "t string, want double", m=units.magnitude_from_header(F.col("t")), want=F.col("want"))
    assert [r.m for r in got] == [r.want for r in got]
    got = values(spark, [("Table 3 (Rs. in lakhs) and USD million",), ("all workers in thousands",), ("nothing",)], "t string", h=units.page_unit_hint(F.col("t")))
    assert [r.h for r in got] == ["(Rs. in lakhs)", None, None]


def test_periods(spark):
    d = dt.date
    cases = [
        ("Q3 FY19", 3, "fiscal_quarter", "Q3 FY2019", d(2018, 10, 1), d(2018, 12, 31)),
        ("Q1-FY22", 3, "fiscal_quarter", "Q1 FY2022", d(2021, 4, 1), d(2021, 6, 30)),
        ("Q2: FY17", 6, "fiscal_quarter", "Q2 FY2017", d(2016, 10, 1), d(2016, 12, 31)),
        ("Q4:FY2018-19", 3, "fiscal_quarter", "Q4 FY2019", d(2019, 1, 1), d(2019, 3, 31)),
        ("3QFY2015", 3, "fiscal_quarter", "Q3 FY2015", d(2014, 10, 1), d(2014, 12, 31)),
        ("in Q3 of fiscal year 2014", 12, "fiscal_quarter", "Q3 FY2014", d(2014, 7, 1), d(2014, 9, 30)),
        ("Q1 2009/10", 3, "fiscal_quarter", "Q1 FY2010", d(2009, 4, 1), d(2009, 6, 30)),
        ("H1-FY13", 3, "fiscal_half", "H1 FY2013", d(2012, 4, 1), d(2012, 9, 30)),
        ("h2 2016-17", 3, "fiscal_half", "H2 FY2017", d(2016, 10, 1), d(2017, 3, 31)),
        ("2012:Q3", 3, "calendar_quarter", "2012Q3", d(2012, 7, 1), d(2012, 9, 30)),
        ("2011-Q1", 3, "calendar_quarter", "2011Q1", d(2011, 1, 1), d(2011, 3, 31)),
        ("Q4, 2010", 3, "calendar_quarter", "2010Q4", d(2010, 10, 1), d(2010, 12, 31)),
        ("FY1998-99", 3, "fiscal_year", "FY1999", d(1998, 4, 1), d(1999, 3, 31)),
        ("fiscal 2006", 9, "fiscal_year", "FY2006", d(2005, 10, 1), d(2006, 9, 30)),
        ("1999-00", 3, "fiscal_year", "FY2000", d(1999, 4, 1), d(2000, 3, 31)),
        ("FY71", 3, "fiscal_year", "FY1971", d(1970, 4, 1), d(1971, 3, 31)),
        ("calendar year 2003", 3, "calendar_year", "CY2003", d(2003, 1, 1), d(2003, 12, 31)),
        ("as at 31 February 2016", 3, "instant", "2016-02-29", d(2016, 2, 29), d(2016, 2, 29)),
        ("as of June 2007", 3, "instant", "2007-06-01", d(2007, 6, 1), d(2007, 6, 1)),
        ("2005-08-09", 3, "instant", "2005-08-09", d(2005, 8, 9), d(2005, 8, 9)),
        ("period ended 30 June, 2008", 3, "fiscal_year", "FY2008", d(2007, 7, 1), d(2008, 6, 30)),
        ("Sept. 2004", 3, "month", "2004-09", d(2004, 9, 1), d(2004, 9, 30)),
        ("as on Monday 2013", 3, "calendar_year", "CY2013", d(2013, 1, 1), d(2013, 12, 31)),
        ("२०१८", 3, "calendar_year", "CY2018", d(2018, 1, 1), d(2018, 12, 31)),
        ("some time ago", 3, "unknown", None, None, None),
    ]
    got = values(spark, [(c[0], c[1]) for c in cases], "t string, m int", p=periods.period_or_unknown(F.col("t"), F.col("m")))
    for c, r in zip(cases, got, strict=True):
        assert (r.p.kind, r.p.label, r.p.start, r.p.end) == c[2:], c[0]
    assert values(spark, [(" ", 3)], "t string, m int", p=periods.period_or_unknown(F.col("t"), F.col("m")))[0].p is None
    got = values(spark, [("Q1-FY22 and H1-FY22",), ("2005-08-09",)], "t string", p=periods.parse_period(F.col("t"), F.lit(3), strict=True))
    assert (got[0].p.raw, got[0].p.kind, got[1].p.kind) == ("Q1-FY22", "fiscal_quarter", "fiscal_year")


def test_fiscal_hints(spark):
    rows = [("the financial year ended on 30 June, as at December 31, 2011",), ("year ended December 31, 2011 and year ended 2011",), ("year ending May or year ending 3 October",), ("as on August 4, 2010 and as at July 4, 2010",), ("nothing of the kind",)]
    got = values(spark, rows, "t string", m=periods.infer_fiscal_year_end(F.col("t")))
    assert [r.m for r in got] == [6, 12, None, None, None]


def test_entities(spark):
    rows = [("The Larch Trust Holdings Ltd.", "larch trust PLC"), ("Prof. Berta Maria Keller", "B. M. Keller"), ("Crème Brûlée SARL", "Creme Brulee Sarl"), ("Of The", "Group"), ("", "."), ("Larch", "Larch Logistics"), ("Ash", "Ash Works")]
    got = values(spark, rows, "a string, b string", x=entities.entity_key(F.col("a")), y=entities.entity_key(F.col("b")), same=entities.same_entity(F.col("a"), F.col("b")))
    assert got[0].x == got[0].y == "larch trust" and got[0].same
    assert got[1].x == "berta maria keller" and got[1].same
    assert got[2].x == got[2].y
    assert (got[3].x, got[3].y) == ("of the", "")
    # Empty keys are nobody's; a first word of three letters is too short to stand for a longer name.
    assert [r.same for r in got[3:]] == [False, False, True, False]


def test_measures(spark):
    got = values(spark, [("Growth in Revenues from Operations",), ("GDP at constant prices",), ("the of",)], "t string", t=measures.tokenise_measure(F.col("t")), m=measures.markers_of(measures.tokenise_measure(F.col("t"))), s=measures.slug(measures.tokenise_measure(F.col("t"))))
    assert got[0].t == ["growth", "operation", "revenue"] and got[0].m == ["growth"]
    assert got[1].t == ["constant", "gdp", "price"]
    assert got[2].s == "unnamed"


def test_json():
    p = loosejson.parse_loose
    assert p('[{"a": 1}]') == '[{"a": 1}]'
    assert p('```json\n{"a": 1}\n```') == '{"a": 1}'
    assert p('Sure: [{"a": 1}] done') == '[{"a": 1}]'
    assert p('[{"a": 1,},]') == '[{"a": 1}]'
    assert p('[{"a": 1}, {"b": "x') == '[{"a": 1}]'
    assert p("only prose") is None and p("") is None and p(None) is None


def test_text(spark):
    got = values(spark, [("OVERVIEW OF RESULTS",), ("The plant, opened in 1980, makes a lot of steel for export.",), ("a 100 200\nb 300 400",)], "t string", k=text.block_kind(F.col("t")), d=text.density_score(F.col("t")))
    assert [r.k for r in got] == ["heading", "prose", "table"]
    assert all(0 <= r.d <= 1 for r in got)
    assert values(spark, [("12 of 1, 200", "12"), ("none", "7"), ("x", "no digits")], "q string, r string", c=text.contains_value(F.col("q"), F.col("r")))[1].c is False


def test_density_counts_the_surveyed_words(spark):
    """0.55 for digits and 0.45 for telling words, each up to a limit; phrases count, a sign between blanks does not."""
    text_ = "As on Friday the ratio stood at 12 per cent, compared with 9 % in May; the estimated share rose versus plan."
    rows = [(text_,), ("   ",), ("5 5 5",), ("Nothing here tells a figure or fact of any sort whatsoever, so it goes.",)]
    got = [r.d for r in values(spark, rows, "t string", d=text.density_score(F.col("t")))]
    digits, marks = 3, 8  # as on, ratio, stood at, per cent, compared, estimated, share, rose, versus: capped at six
    assert got[0] == round(0.55 * min(1, 6 * digits / len(text_)) + 0.45 * min(1, marks / 6), 4)
    assert got[1] == 0.0 and got[2] == round(0.55 * 0.4, 4) and got[3] == 0.0


def test_headings(spark):
    rows = [("4.2 Port traffic and dues",), ("Port traffic, by line",), ("PORT TRAFFIC 2020",), ("The port was closed.",), ("the port",), ("Öffnung des Hafens",), ("A" * 121,), (" ".join(["Word"] * 15),)]
    got = values(spark, rows, "t string", h=text.looks_like_heading(F.col("t")))
    assert [r.h for r in got] == [True, True, True, False, False, False, False, False]


def test_dates_titles_and_short_forms(spark):
    d = dt.date
    rows = [("Lisbon, 9 August 2013; revised September 30, 2014.", d(2000, 1, 1)), ("Sept 2015 is no date here", d(2000, 1, 1)), ("", None), ("0 May 2018 and July 2017", None)]
    got = values(spark, rows, "t string, m date", p=text.published_date(F.col("t"), F.col("m")))
    assert [r.p for r in got] == [d(2014, 9, 28), d(2000, 1, 1), None, d(2017, 7, 1)]
    got = values(spark, [("D:20190605083000", " 2019-06-05T"), ("x", "2019-06"), (None, "2019")], "a string, b string", a=text.pdf_date(F.col("a")), b=text.iso_date(F.col("b")), c=text.iso_date(F.col("b"), partial=True))
    assert [(r.a, r.b, r.c) for r in got] == [(d(2019, 6, 5), d(2019, 6, 5), d(2019, 6, 5)), (None, None, d(2019, 6, 1)), (None, None, d(2019, 1, 1))]
    rows = [
        ("Port Survey", ["Harbour dues"], "x", "in/a.pdf"), ("scan.PDF", ["Contents", "Harbour dues"], "x", "a.pdf"), (None, ["Index", None], "x", "a.pdf"), (None, None, "1\nThe first real line", "a.pdf"),
        (None, [], "7 8 9 10 11", "in/port-dues_2019.pdf"),
    ]
    got = values(spark, rows, "m string, l array<string>, p string, f string", t=text.guess_title(F.col("m"), F.col("l"), F.col("p"), F.col("f")))
    assert [r.t for r in got] == ["Port Survey", "Harbour dues", "Index", "The first real line", "port dues 2019"]
    got = values(spark, [("Table of Contents!",), ("ABC 12",), ("Overviews",), (None,)], "t string", g=text.is_generic_title(F.col("t")))
    assert [r.g for r in got] == [True, True, False, True]
    got = values(spark, [(8765432.0,), (-4.25e12,), (0.0,), (731.0,), (None,), (61.0e3,)], "v double", s=numbers.format_compact(F.col("v")))
    assert [r.s for r in got] == ["8.765M", "-4.25T", "0", "731", None, "61K"]
