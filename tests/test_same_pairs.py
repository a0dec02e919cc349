"""Pairs of one entity come from joins on what makes them the same, not from every pair of a first word."""

import time
from itertools import combinations

from pyspark.sql import functions as F

from claimloom.functions import entities

NAMES = [
    "Harbour Trust of Ostrel", "harbour trust of ostrel ltd.", "Harbour", "Harbour Trust", "Harbor Trust", "Anna Maria Keller", "A. M. Keller", "Arno Mills Keller", "Keller", "A", "The", "Ltd", "",
    "IBM", "IBM Norden", "Ost Bank", "Óst Bank", "Ost Bank Norden", "Óst", "Ostb Bank", "Harbour Trade Ostrel", "Dr. Anna Keller", "Anna Keller", "A Keller",
]


def keyed(spark, names):
    return spark.createDataFrame([(n,) for n in names], "entity string").withColumn("key", entities.entity_key(F.col("entity")))


def test_pairs_are_those_of_the_rule(spark):
    both = spark.createDataFrame(list(combinations(sorted(NAMES), 2)), "a string, b string")
    want = sorted((r.a, r.b) for r in both.where(entities.same_entity(F.col("a"), F.col("b"))).collect())
    got = sorted((r.a, r.b) for r in entities.same_pairs(keyed(spark, NAMES)).collect())
    assert got == want and len(want) > 12


def test_a_common_first_word_costs_nothing(spark, tmp_path):
    """12,000 names of one first word are 72 million pairs; only 12,000 hold."""
    from claimloom.plans import surface

    names = [f"Department of x{i} y{i} z{i}" for i in range(12_000)] + ["Department"]
    spark.createDataFrame([(n,) for n in names], "entity string").write.parquet(f"{tmp_path}/facts.parquet")
    began = time.time()
    found = surface.same_entities(spark, str(tmp_path))
    # x1 y1 z12 and the like share no initials form: the last word is whole.
    assert found.count() == 12_000 and time.time() - began < 60
