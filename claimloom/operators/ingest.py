"""From text blocks to extraction units: headings, offsets, reading order, packing, budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import block_kind, density_score

#: Limits of a batch and of a unit, smallest density, units per document.
BATCH_CHARS = 16_000
BATCH_PAGES = 10
UNIT_CHARS = 2_600
MIN_DENSITY = 0.12
MAX_UNITS = 14


def split_blocks(pages: DataFrame, text: str = "text") -> DataFrame:
    """Non-blank blocks of a page text, parted by blank lines: ``doc_id, page, idx, text, kind, density``."""
    parts = F.filter(F.split(text, r"\n[ \t]*\n\s*"), lambda b: F.trim(b) != "")
    blocks = pages.where(F.col(text).isNotNull()).select("doc_id", "page", F.posexplode(parts).alias("idx", "text"))
    return blocks.withColumns({"kind": block_kind(F.col("text")), "density": density_score(F.col("text"))})


def keep_text_blocks(blocks: DataFrame) -> DataFrame:
    """Layout blocks that are text (type 0) and not blank."""
    return blocks.where((F.col("block_type") == 0) & (F.trim("text") != ""))


def with_offsets(blocks: DataFrame) -> DataFrame:
    """Adds ``char_start, char_end`` of each block in its page, blocks being joined by one line break."""
    before = Window.partitionBy("doc_id", "page").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0))
    return blocks.withColumn("char_start", start.cast("int")).withColumn("char_end", F.col("char_start") + F.length("text"))


def with_heading(blocks: DataFrame) -> DataFrame:
    """Adds ``section``: the last heading up to the block on its page, '' before the first; pages start afresh."""
    upto = Window.partitionBy("doc_id", "page").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return blocks.withColumn("section", F.coalesce(F.last(F.when(F.col("kind") == "heading", F.trim("text")), ignorenulls=True).over(upto), F.lit("")))


def with_reading_order(blocks: DataFrame, page_width: str = "page_width") -> DataFrame:
    """Adds ``gutter`` (null for one column) and ``read_idx``, the place of a block in reading order.

    Two columns need six blocks, at least a quarter of the sided blocks on either side and no more than 35 % straddling
    the middle; straddling blocks keep to the left flow.
    """
    page = Window.partitionBy("doc_id", "page")
    middle, margin = F.col(page_width) / 2, F.col(page_width) * 0.04
    left, right = F.col("x1") <= middle + margin, F.col("x0") >= middle - margin
    side = F.when(left & ~right, "left").when(right & ~left, "right").otherwise("both")
    b = blocks.withColumn("side", side)
    count = lambda s: F.sum(F.when(F.col("side") == s, 1).otherwise(0)).over(page)
    b = b.withColumns({"__l": count("left"), "__r": count("right"), "__s": count("both"), "__n": F.count("*").over(page)})
    sided = F.col("__l") + F.col("__r")
    two = (F.col("__n") >= 6) & (sided > 0) & (F.least("__l", "__r") >= 0.25 * sided) & (F.col("__s") <= 0.35 * F.col("__n"))
    b = b.withColumns({"gutter": F.when(two, middle), "__c": F.when(two & (F.col("side") == "right"), 1).otherwise(0)})
    order = page.orderBy("__c", F.round("y0", 1), F.round("x0", 1), "block_no")
    return b.withColumn("read_idx", (F.row_number().over(order) - 1).cast("int")).drop("__l", "__r", "__s", "__n", "__c", "side")


def dense_pages(blocks: DataFrame, min_density: float = MIN_DENSITY) -> DataFrame:
    """Pages whose densest block reaches ``min_density``: ``doc_id, page, density, chars``."""
    pages = blocks.groupBy("doc_id", "page").agg(F.max("density").alias("density"), (F.sum(F.length("text") + 1) - 1).cast("int").alias("chars"))
    return pages.where(F.col("density") >= min_density)


def _pack(items: Column, target: Column | int, most: int) -> Column:
    """Greedy packing of ``array<struct<page, chars>>`` in order: the batch number of each."""
    start = F.struct(F.lit(0).alias("batch"), F.lit(0).alias("size"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        full = (s["n"] > 0) & ((s["size"] + x["chars"] > target) | (s["n"] >= most))
        batch = F.when(full, s["batch"] + 1).otherwise(s["batch"])
        return F.struct(batch.alias("batch"), (F.when(full, 0).otherwise(s["size"]) + x["chars"]).cast("int").alias("size"), (F.when(full, 0).otherwise(s["n"]) + 1).cast("int").alias("n"), F.concat(s["out"], F.array(batch)).alias("out"))

    return F.aggregate(items, start, step, lambda s: s["out"])


def pack_batches(pages: DataFrame, hints: DataFrame | None = None, target_chars: int = BATCH_CHARS, max_pages: int = BATCH_PAGES) -> DataFrame:
    """Batches of consecutive pages: ``doc_id, batch, pages, chars, density, magnitude_hint, unit_hint``.

    A batch is closed before a page that would take it over ``target_chars``, or when it holds ``max_pages``. A hint is
    kept only where all pages of the batch agree on it, nothing counting as a value of its own.
    """
    per_doc = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "chars", "density"))).alias("items"))
    numbered = per_doc.withColumn("batches", _pack(F.col("items"), target_chars, max_pages)).select("doc_id", F.explode(F.arrays_zip("items", "batches")).alias("z")).select("doc_id", "z.items.*", F.col("z.batches").alias("batch"))
    if hints is not None:
        numbered = numbered.join(hints.select("doc_id", "page", "magnitude_hint", "unit_hint"), ["doc_id", "page"], "left")
    else:
        numbered = numbered.withColumns({"magnitude_hint": F.lit(None).cast("double"), "unit_hint": F.lit(None).cast("string")})
    alike = lambda c: F.when((F.count_distinct(c) <= 1) & ((F.count(c) == F.count("*")) | (F.count(c) == 0)), F.first(c, ignorenulls=True)).alias(c)
    return numbered.groupBy("doc_id", "batch").agg(F.array_sort(F.collect_list("page")).alias("pages"), F.sum("chars").alias("chars"), F.max("density").alias("density"), alike("magnitude_hint"), alike("unit_hint"))


def pack_units(blocks: DataFrame, target_chars: int = UNIT_CHARS, min_density: float = MIN_DENSITY, overlap: int = 1) -> DataFrame:
    """Units of consecutive non-heading blocks of a page that share ``overlap`` blocks: ``doc_id, page, unit, idxs, density``.

    Units under ``min_density`` are dropped and kept ones are numbered over the document.
    """
    body = blocks.where("kind <> 'heading'").groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("idx", F.length("text").alias("chars"), "density"))).alias("items"))
    start = F.expr("named_struct('done', cast(array() as array<array<struct<idx:int,chars:int,density:double>>>), 'cur', cast(array() as array<struct<idx:int,chars:int,density:double>>), 'size', 0)")

    def step(s: Column, x: Column) -> Column:
        full = (F.size(s["cur"]) > 0) & (s["size"] + x["chars"] > target_chars)
        carried = F.slice(s["cur"], F.greatest(F.size(s["cur"]) - overlap + 1, F.lit(1)), F.lit(overlap)) if overlap else F.slice(s["cur"], 1, 0)
        cur = F.when(full, F.concat(carried, F.array(x))).otherwise(F.concat(s["cur"], F.array(x)))
        return F.struct(F.when(full, F.concat(s["done"], F.array(s["cur"]))).otherwise(s["done"]).alias("done"), cur.alias("cur"), F.aggregate(cur, F.lit(0), lambda t, b: t + b["chars"]).alias("size"))

    packed = body.withColumn("units", F.aggregate("items", start, step, lambda s: F.when(F.size(s["cur"]) > 0, F.concat(s["done"], F.array(s["cur"]))).otherwise(s["done"])))
    units = packed.select("doc_id", "page", F.posexplode("units").alias("k", "u")).select("doc_id", "page", "k", F.transform("u", lambda b: b["idx"]).alias("idxs"), F.array_max(F.transform("u", lambda b: b["density"])).alias("density"))
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "k")) - 1
    return units.where(F.col("density") >= min_density).withColumn("unit", number).drop("k")


def within_budget(units: DataFrame, cap: int | None = MAX_UNITS, order: str = "batch") -> DataFrame:
    """The densest ``cap`` units of each document, ties by order; 0 or None keeps all."""
    if not cap:
        return units
    return units.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("density"), order))).where(F.col("rank") <= cap)


def unit_span(blocks: DataFrame) -> Column:
    """Characters a unit spans in its page: smallest start and largest end of its blocks."""
    return F.struct(F.min("char_start").alias("char_start"), F.max("char_end").alias("char_end"))


def unit_stats(units: DataFrame) -> DataFrame:
    """One row: ``n_units, n_chars, mean_chars, mean_density``; means of nothing are null."""
    return units.agg(F.count("*").alias("n_units"), F.coalesce(F.sum("chars"), F.lit(0)).alias("n_chars"), F.round(F.avg("chars"), 1).alias("mean_chars"), F.round(F.avg("density"), 3).alias("mean_density"))


def unit_prompt(units: DataFrame) -> DataFrame:
    """Adds ``prompt``: heading, scale note and the text with page marks, for an extractor."""
    scale = F.when(F.col("magnitude_hint").isNotNull(), F.concat(F.lit("Figures are in units of "), F.col("magnitude_hint").cast("string")))
    return units.withColumn("prompt", F.concat_ws("\n", F.when(F.col("section") != "", F.concat(F.lit("Section: "), F.col("section"))), scale, F.col("marked_text")))


def marked_text(page: Column, text: Column) -> Column:
    return F.concat(F.lit("[[PAGE "), page.cast("string"), F.lit("]]\n"), text)
