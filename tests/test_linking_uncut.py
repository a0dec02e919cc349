"""Blocks beyond the cap: named with their sizes, and paired whole where asked."""

from itertools import combinations

from pyspark.sql import functions as F

from claimloom.operators.linking import candidate_pairs, oversized


def facts(spark, n=9):
    rows = [(f"f{i}", i % 4, "big", "e", i / 10) for i in range(n)] + [("g0", 1, "small", "e", 0.5), ("g1", 2, "small", "e", 0.5), ("h", 3, None, "e", 0.5)]
    return spark.createDataFrame(rows, "id string, doc_id long, measure_key string, entity_key string, confidence double"), rows


def test_whole_blocks_are_paired(spark):
    df, rows = facts(spark)
    brute = {tuple(sorted((x[0], y[0]))): {x[1], y[1]} for x, y in combinations(rows, 2) if x[2] is not None and x[2:4] == y[2:4]}
    got = lambda **o: sorted(tuple(r) for r in candidate_pairs(df, fields=("id", "doc_id"), **o).select(F.col("a.id"), F.col("b.id").alias("o")).collect())
    assert got(max_block=None) == sorted(brute)
    assert got(max_block=None, new_doc=2) == sorted(k for k, d in brute.items() if 2 in d)
    assert got(max_block=None, new_doc=2, cross_document_only=True) == sorted(k for k, d in brute.items() if 2 in d and len(d) == 2)
    assert len(got(max_block=4)) == 7


def test_cut_blocks_are_named(spark):
    assert [tuple(r) for r in oversized(facts(spark)[0], 4).collect()] == [("big", "e", 9, 5)]
    assert oversized(facts(spark)[0], 9).count() == 0
