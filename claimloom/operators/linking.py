"""Pairing facts inside blocks of one measure and one entity, and writing what the pairs mean."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .adjudicate import FACT_FIELDS, adjudicate

#: Facts a block keeps: its pairs are bounded by MAX_BLOCK * (MAX_BLOCK - 1) / 2 whatever the key's share of all rows.
MAX_BLOCK = 120
KEYS = ["measure_key", "entity_key"]
#: Facts of a tile's side, and tiles of a band. A run of bit-packed Parquet values is 504 long, so that tiles of that side
#: repeat byte for byte in a dictionary-encoded column.
TILE = 504
BAND = 8
RELATION_RANK = ("contradicts", "reconciled", "supersedes", "corroborates", "related", "undetermined")


def blocks(facts: DataFrame, min_size: int = 2) -> DataFrame:
    """Blocks of at least ``min_size`` facts: keys and ``n``."""
    return facts.groupBy(*KEYS).agg(F.count("*").alias("n")).where(F.col("n") >= min_size)


def oversized(facts: DataFrame, max_block: int = MAX_BLOCK) -> DataFrame:
    """Blocks that the cap cuts: keys, ``n`` and the facts ``beyond`` the cap, which get no pair; the largest first."""
    sizes = blocks(facts.where("measure_key is not null and entity_key is not null"), max_block + 1)
    return sizes.withColumn("beyond", F.col("n") - max_block).orderBy(F.desc("n"), *KEYS)


def capped(facts: DataFrame, max_block: int | None = MAX_BLOCK) -> DataFrame:
    """Facts ranked in their block by falling confidence (ties by id), and only the first ``max_block`` of each.

    The cap is a feature of the linker: it keeps the most trusted facts of a block. The rank is limited on the map side
    too, so a block of a third of all rows never gathers in one task. None keeps every fact, unranked.
    """
    if max_block is None:
        return facts.where("measure_key is not null and entity_key is not null")
    rank = F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.col("confidence").desc_nulls_last(), F.col("id")))
    return facts.where("measure_key is not null and entity_key is not null").withColumn("rank", rank).where(F.col("rank") <= max_block)


def _sided(facts: DataFrame, name: str, fields: tuple[str, ...]) -> DataFrame:
    return facts.select(*KEYS, F.struct(*fields).alias(name))


def _inside(kept: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """All pairs inside blocks whose size is bounded: a block is gathered where the cap has ranked it already, so facts
    are shuffled by their keys once, not once for each side of a join."""
    gathered = kept.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("fs")).where(F.size("fs") > 1)
    first = gathered.select(*KEYS, "fs", F.posexplode("fs").alias("i", "a"))
    return first.select(*KEYS, "a", F.explode(F.slice("fs", F.col("i") + 2, F.size("fs"))).alias("b")).where("a.id < b.id")


def _whole(kept: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """All pairs inside blocks of any size, as tiles of ``TILE`` by ``TILE`` facts in order of id.

    Facts of a block are numbered once and gathered by ``TILE``; every two bands of such rows meet under a key of their own,
    so that a large block is spread over tasks and no side of it is buffered fact by fact. Pairs come out tile by tile, one
    fact against a whole side, and large blocks first in each task: a written result then keeps to its dictionaries and
    compresses to a small part.
    """
    at = F.row_number().over(Window.partitionBy(*KEYS).orderBy("id")) - 1
    rows = kept.select(*KEYS, "id", F.struct(*fields).alias("f")).withColumn("row", F.floor(at / TILE).cast("int"))
    rows = rows.groupBy(*KEYS, "row").agg(F.array_sort(F.collect_list(F.struct("id", "f"))).alias("fs"))
    rows = rows.select((-F.max("row").over(Window.partitionBy(*KEYS))).alias("large"), *KEYS, F.floor(F.col("row") / BAND).cast("int").alias("band"), "row", F.col("fs.f").alias("fs"))
    on = ["large", *KEYS, "low", "high"]
    left = rows.select("large", *KEYS, F.col("band").alias("low"), F.explode(F.sequence("band", F.floor(-F.col("large") / BAND).cast("int"))).alias("high"), F.col("row").alias("i"), F.col("fs").alias("x"))
    right = rows.select("large", *KEYS, F.explode(F.sequence(F.lit(0), F.col("band"))).alias("low"), F.col("band").alias("high"), F.col("row").alias("j"), F.col("fs").alias("y"))
    tiles = left.join(right, on).where("i <= j and (i < j or size(x) > 1)")
    return tiles.select(*KEYS, "y", F.explode("x").alias("a")).select(*KEYS, "a", F.explode("y").alias("b")).where("a.id < b.id")


def candidate_pairs(facts: DataFrame, new_doc: int | None = None, cross_document_only: bool = False, max_block: int | None = MAX_BLOCK, fields: tuple[str, ...] = FACT_FIELDS) -> DataFrame:
    """All pairs ``a.id < b.id`` inside capped blocks, as two structs.

    With ``new_doc`` only blocks that the document touches are read further (a semi join on the keys comes first), and
    pairs must touch it. Null keys block nothing; a repeated id is not paired with itself. ``max_block`` None pairs
    whole blocks: with ``new_doc`` its facts are then set against all others, else pairs grow with the square of a block.
    """
    if new_doc is not None:
        touched = facts.where(F.col("doc_id") == new_doc).select(*KEYS).distinct()
        facts = facts.join(touched, KEYS, "left_semi")
    kept = capped(facts, max_block)
    if max_block is None and new_doc is not None:
        # Only the new document's facts look for partners; each pair inside it comes once.
        other = _sided(kept, "y", fields)
        met = _sided(kept.where(F.col("doc_id") == new_doc), "x", fields).join(other, KEYS).where(F.col("x.id") != F.col("y.id"))
        met = met.where(~F.col("y.doc_id").eqNullSafe(F.lit(new_doc)) | F.expr("x.id < y.id"))
        first = F.col("x.id") < F.col("y.id")
        pairs = met.select(*KEYS, F.when(first, F.col("x")).otherwise(F.col("y")).alias("a"), F.when(first, F.col("y")).otherwise(F.col("x")).alias("b"))
        return pairs.where("a.doc_id <> b.doc_id") if cross_document_only else pairs
    pairs = _whole(kept, fields) if max_block is None else _inside(kept, fields)
    if new_doc is not None:
        pairs = pairs.where((F.col("a.doc_id") == new_doc) | (F.col("b.doc_id") == new_doc))
    if cross_document_only:
        pairs = pairs.where("a.doc_id <> b.doc_id")
    return pairs


def pair_key(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")]


def without_existing(pairs: DataFrame, relations: DataFrame) -> DataFrame:
    """Pairs that no relation holds yet, in either order."""
    known = relations.where("a_id is not null and b_id is not null").select(*pair_key(F.col("a_id"), F.col("b_id"))).distinct()
    keyed = pairs.withColumns({"lo": F.least("a.id", "b.id"), "hi": F.greatest("a.id", "b.id")})
    return keyed.join(known, ["lo", "hi"], "left_anti").drop("lo", "hi")


def link(facts: DataFrame, existing: DataFrame | None = None, **options) -> DataFrame:
    """Relations of all new pairs; options as for ``candidate_pairs``."""
    pairs = candidate_pairs(facts, **options)
    return adjudicate(without_existing(pairs, existing) if existing is not None else pairs)


def link_report(facts: DataFrame, existing: DataFrame, max_block: int = MAX_BLOCK) -> DataFrame:
    """One row of counters: blocks examined and oversized, pairs considered, skipped as known, relations written, and
    ``by_type``. The pairs are made and judged once."""
    sizes = blocks(facts.where("measure_key is not null and entity_key is not null"))
    counts = sizes.agg(F.count("*").alias("blocks_examined"), F.coalesce(F.sum((F.col("n") > max_block).cast("bigint")), F.lit(0)).alias("oversized_blocks"))
    known = existing.where("a_id is not null and b_id is not null").select(*pair_key(F.col("a_id"), F.col("b_id"))).distinct().withColumn("known", F.lit(True))
    flagged = candidate_pairs(facts, max_block=max_block).withColumns({"lo": F.col("a.id"), "hi": F.col("b.id")}).join(known, ["lo", "hi"], "left")
    judged = adjudicate(flagged, keep_silent=True, carry=("known",)).groupBy("known", "type").agg(F.count("*").alias("n"))
    fresh = F.col("known").isNull() & F.col("type").isNotNull()
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
    totals = judged.agg(
        zero(F.sum("n")).alias("pairs_considered"), zero(F.sum(F.when(F.col("known"), F.col("n")))).alias("pairs_skipped_existing"), zero(F.sum(F.when(fresh, F.col("n")))).alias("relations_written"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(fresh, F.struct("type", "n"))))).alias("by_type"),
    )
    return counts.crossJoin(totals)


def relink(facts: DataFrame, **options) -> DataFrame:
    """Relations of all pairs as if none were known: what replaces the relations table after the ladder has changed."""
    return link(facts, None, **options)


def relation_rank(kind: Column) -> Column:
    out = F.lit(len(RELATION_RANK))
    for i, name in enumerate(RELATION_RANK):
        out = F.when(kind == name, i).otherwise(out)
    return out


def interesting(relations: DataFrame) -> DataFrame:
    """Relations most worth reading first: by type, then falling confidence, then id."""
    return relations.orderBy(relation_rank(F.col("type")), F.col("confidence").desc(), F.col("id"))


def pair_priority(pairs: DataFrame) -> DataFrame:
    """Pairs across documents first, then falling joint confidence."""
    return pairs.orderBy((F.col("a.doc_id") != F.col("b.doc_id")).desc(), (F.col("a.confidence") + F.col("b.confidence")).desc(), F.col("a.id"), F.col("b.id"))
