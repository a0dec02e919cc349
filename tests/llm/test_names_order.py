"""Turned names and short forms outside the names met in the tables."""

from tests.llm.test_names_reach import groups


def test_order_needs_no_list(spark):
    assert groups(spark, "Ruvonka Halvorsen", "Halvorsen Ruvonka", "Ruvonka Dellmark") == [["Halvorsen Ruvonka", "Ruvonka Halvorsen"], ["Ruvonka Dellmark"]]
    assert groups(spark, "Ruvonka Ilse Halvorsen", "Halvorsen Ruvonka Ilse", "Halvorsen Ilsabet Ruvonka") == [["Halvorsen Ilsabet Ruvonka"], ["Halvorsen Ruvonka Ilse", "Ruvonka Ilse Halvorsen"]]


def test_more_short_forms(spark):
    assert groups(spark, "Tony Halvorsen", "Anthony Halvorsen", "Becky Halvorsen") == [["Anthony Halvorsen", "Tony Halvorsen"], ["Becky Halvorsen"]]
