"""Consolidating pairwise matches into groups by hash-to-min."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, materialise

#: Rows from which a vertex counts as hot, and the most hot vertices there can be: their minima are broadcast.
HOT_ROWS = 100_000
MOST_HOT = 10_000


def _flagged(pairs: DataFrame) -> DataFrame:
    """``v, m, n, done``: the minimum and size of each vertex' cluster, and whether its component is a finished star.

    Rows are symmetric, so a minimum whose members all hold nothing but it is a whole component.
    """
    least = pairs.groupBy("v").agg(F.min("u").alias("u"), F.count("*").alias("n")).selectExpr("v", "least(v, u) as m", "n")
    leaves = least.where("n = 1 and v <> m").groupBy("m").agg(F.count("*").alias("leaves"))
    stars = least.where("v = m").join(leaves, "m").where("n = leaves").selectExpr("m", "true as done")
    return least.join(stars, "m", "left").selectExpr("v", "m", "n", "coalesce(done, false) as done")


def _both_ways(pairs: DataFrame) -> DataFrame:
    """Distinct pairs ``m < u`` as rows ``(v, u)`` in both directions, distinct as well."""
    return pairs.select(F.explode(F.array(F.struct(F.col("m").alias("v"), "u"), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))).alias("p")).select("p.v", "p.u")


def _size(table: DataFrame) -> tuple[int, int]:
    """Sum and largest of ``n``."""
    row = table.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.max("n"), F.lit(0)).alias("most")).first()
    return row["rows"], row["most"]


def _looked_up(rows: DataFrame, key: str, table: DataFrame, hot_rows: int, size: tuple[int, int]) -> DataFrame:
    """``rows`` joined by ``key`` with a table of one row a key and ``n``, how many of ``rows`` have it (``size``: sum and
    largest); ``n`` is dropped.

    A key with more than ``hot_rows`` rows, or a ten-thousandth of all, would make a skewed partition. There are
    ``MOST_HOT`` such keys at most by construction: they are broadcast, and their rows stay where they are."""
    limit = max(hot_rows, size[0] // MOST_HOT)
    if size[1] <= limit:
        return rows.join(table.drop("n"), key)
    hot = F.broadcast(table.where(F.col("n") > limit).drop("n"))
    cold = rows.join(hot.select(key), key, "left_anti").join(table.where(F.col("n") <= limit).drop("n"), key)
    return rows.join(hot, key).unionByName(cold)


def hash_to_min(edges: DataFrame, a: str, b: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Group identifier of every vertex that has a link: columns ``id`` and ``group_id``.

    ``group_id`` is the smallest vertex (by code point) of the connected component. Vertices are numbered once, and the
    rounds work on these numbers. Cluster sets are kept as rows ``(v, u)``, "u belongs to the cluster of v", never as
    collected arrays, so a component of any size is spread over the cluster. In each round a vertex sends its cluster to
    the cluster's minimum and that minimum to the members. Components that have become a star around their minimum are
    finished: they are set apart and their rows leave the loop, which ends when no row is left, after rounds that grow
    with the logarithm of the longest chain.

    Minima are combined before the shuffle; where they are joined back, hot vertices are broadcast (``_looked_up``), so
    a giant component makes no giant task. The distinct rows are shuffled by both columns.

    Cases: rows with a null on either side and self links join nothing and are dropped; repeated and reversed links
    count once; an empty table gives an empty result; other columns of ``edges`` are ignored, whatever their names.
    """
    spark = edges.sparkSession
    links = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null and x <> y").selectExpr("least(x, y) as x", "greatest(x, y) as y").distinct()
    links, links_path = materialise(links, "links")
    degrees = links.select(F.explode(F.array("x", "y")).alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    vertices, vertices_path = materialise(degrees.withColumn("k", F.monotonically_increasing_id()), "vertices")
    size = _size(vertices)
    by_x = _looked_up(links, "x", vertices.selectExpr("id as x", "k as kx", "n"), hot_rows, size)
    numbered = _looked_up(by_x.select("kx", "y"), "y", vertices.selectExpr("id as y", "k as ky", "n"), hot_rows, size)
    pairs, path = materialise(_both_ways(numbered.selectExpr("least(kx, ky) as m", "greatest(kx, ky) as u")), "pairs")
    rounds: list[tuple[DataFrame, str]] = []
    while True:
        flagged, flagged_path = materialise(_flagged(pairs), "minima")
        rounds.append((flagged, flagged_path))
        open_ = flagged.where("not done").select("v", "m", "n")
        size = _size(open_)
        if not size[0]:
            break
        known = _looked_up(pairs, "v", open_, hot_rows, size).select("m", "u")
        met = known.where("m <> u").unionAll(open_.selectExpr("m", "v as u").where("m <> u")).distinct()
        after, new_path = materialise(_both_ways(met), "pairs")
        discard(spark, path)
        pairs, path = after, new_path
    found = reduce(DataFrame.unionAll, [f.where("done").select("v", "m") for f, _ in rounds])
    named, named_path = materialise(found.join(vertices.selectExpr("k as v", "id"), "v").select("id", "m"), "members")
    smallest, smallest_path = materialise(named.groupBy("m").agg(F.min("id").alias("group_id"), F.count("*").alias("n")), "smallest")
    groups, _ = materialise(_looked_up(named, "m", smallest, hot_rows, _size(smallest)).select("id", "group_id"), "groups")
    for p in [links_path, vertices_path, path, named_path, smallest_path, *(p for _, p in rounds)]:
        discard(spark, p)
    return groups


def corroborated_groups(relations: DataFrame, kind: str = "corroborates") -> DataFrame:
    """``hash_to_min`` over the relations of one type, whose case and outer blanks do not count."""
    same = F.lower(F.regexp_replace("type", r"(?U)^\s+|\s+$", "")) == kind
    return hash_to_min(relations.where(same).select("a_id", "b_id"), "a_id", "b_id")
