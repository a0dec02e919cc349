"""Whole blocks are paired tile by tile: every pair once, however tiles and bands fall, and written small."""

from hashlib import sha1
from itertools import combinations

from pyspark.sql import functions as F

from claimloom.operators import linking

FACTS = "id string, doc_id long, measure_key string, entity_key string, confidence double"


def made(sizes):
    return [(f"f_{sha1(f'{b}-{i}'.encode()).hexdigest()[:16]}", i % 7, f"m{b}", "e", 0.5) for b, n in enumerate(sizes) for i in range(n)]


def test_every_pair_comes_once(spark, monkeypatch):
    monkeypatch.setattr(linking, "TILE", 4)
    monkeypatch.setattr(linking, "BAND", 2)
    rows = made([1, 2, 4, 5, 8, 9, 16, 17, 41])
    # Ids that recur in their block, one of them across tiles, and a fact without a key.
    rows += [rows[-1], *[rows[-9]] * 6, ("f_x", 1, None, "e", 0.5), ("f_y", 1, None, "e", 0.5)]
    want = sorted((min(x[0], y[0]), max(x[0], y[0])) for x, y in combinations(rows, 2) if x[2] is not None and x[2] == y[2] and x[0] != y[0])
    pairs = linking.candidate_pairs(spark.createDataFrame(rows, FACTS), max_block=None, fields=("id", "doc_id"))
    assert sorted(tuple(r) for r in pairs.select(F.col("a.id"), F.col("b.id").alias("o")).collect()) == want


def test_pairs_of_a_large_block_are_written_small(spark, tmp_path):
    """4.5 million pairs; in the order of the join they took 6.2 MB."""
    pairs = linking.candidate_pairs(spark.createDataFrame(made([3_000]), FACTS), max_block=None, fields=("id", "doc_id"))
    pairs.select(F.col("a.id").alias("a_id"), F.col("b.id").alias("b_id")).write.parquet(f"{tmp_path}/out")
    written = sum(p.stat().st_size for p in (tmp_path / "out").glob("*.parquet"))
    assert spark.read.parquet(f"{tmp_path}/out").count() == 3_000 * 2_999 // 2 and written < 3_000_000
