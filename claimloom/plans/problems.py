"""Queries of the two general problems: moments and quantities."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quantities, timestamps
from ..session import table


def _tables(spark, sf_dir):
    return (table(spark, sf_dir, n) for n in ("facts", "documents", "sources"))


def p4_found(spark, sf_dir):
    return timestamps.fact_windows(*_tables(spark, sf_dir))


def p5_found(spark, sf_dir):
    return quantities.measured_facts(*_tables(spark, sf_dir))


def p5_review(spark, sf_dir):
    return quantities.settled(*_tables(spark, sf_dir))[1]


def p5_ways(spark, sf_dir):
    """How many quantities of each kind came by each way: stated beside the figure, confirmed or predicted by the forest."""
    return quantities.settled(*_tables(spark, sf_dir))[0].groupBy("kind", "way").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (p4_found, p5_found, p5_review, p5_ways)}
