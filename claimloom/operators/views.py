"""The read side: lists of facts, relations, failures, documents, measures, and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .linking import interesting
from .registry import measures


def display_value() -> Column:
    """What a fact shows: the raw figure, else its text, else nothing."""
    return F.coalesce("quantity.raw", "value_text", F.lit(""))


def search(facts: DataFrame, doc_id=None, measure_key: str | None = None, q: str | None = None) -> DataFrame:
    """Facts of a document, of a measure, or whose measure or entity holds ``q`` in any case; all filters are pushed
    to the scan where it can take them."""
    if doc_id is not None:
        facts = facts.where(F.col("doc_id") == doc_id)
    if measure_key:
        facts = facts.where(F.col("measure_key") == measure_key)
    if q:
        needle = q.lower()
        facts = facts.where(F.lower(F.coalesce("measure_raw", F.lit(""))).contains(needle) | F.lower(F.coalesce("entity", F.lit(""))).contains(needle))
    return facts


def list_facts(facts: DataFrame, limit: int = 500, **filters) -> DataFrame:
    """The first ``limit`` matching facts by document and page, with label, shown value and ``total`` matches."""
    found = search(facts, **filters)
    top = found.orderBy("doc_id", "page", "id")
    top = top.limit(limit) if limit else top
    # Only the measures that are shown get a label.
    named = facts.join(top.select("measure_key").distinct(), "measure_key", "left_semi") if limit else facts
    labels = measures(named).select(F.col("key").alias("measure_key"), F.col("label").alias("measure_label"))
    shown = top.join(labels, "measure_key", "left").withColumns({"measure_label": F.coalesce("measure_label", "measure_raw"), "display_value": display_value()})
    return shown.crossJoin(found.agg(F.count("*").alias("total")))


def fact_rows(facts: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Facts as flat rows of the API: label, shown and canonical value, period, context and evidence.

    ``labels``: measure_key, measure_label. Columns that the facts lack are null."""
    has = set(facts.columns)
    col = lambda c, kind="string": F.col(c) if c.split(".")[0] in has else F.lit(None).cast(kind)
    q = facts.schema["quantity"].dataType.fieldNames() if "quantity" in has else []
    p = facts.schema["period"].dataType.fieldNames() if "period" in has else []
    canonical = lambda c, kind: F.col(f"quantity.{c}") if c in q else col(c, kind)
    window = lambda c, kind: (F.col(f"period.{c}") if c in p else col(f"period_{c}", kind)).cast("string").alias(f"period_{c}")
    named = facts.join(labels, "measure_key", "left") if labels is not None else facts.withColumn("measure_label", F.lit(None).cast("string"))
    return named.select(
        "id", "doc_id", "fact_type", F.col("measure_raw").alias("measure"), "measure_key", F.coalesce("measure_label", "measure_raw").alias("measure_label"), "entity", "entity_key", display_value().alias("value"), canonical("canonical_value", "double").alias("canonical_value"),
        canonical("canonical_unit", "string").alias("canonical_unit"), F.col("period.raw").alias("period_raw"), F.col("period.kind").alias("period_kind"), window("label", "string"), window("start", "string"), window("end", "string"), F.col("basis"), "estimate_type", col("attributed_to").alias("attributed_to"),
        F.col("as_of").cast("string").alias("as_of"), "confidence", "page", col("quote").alias("quote"), col("char_start", "int").alias("char_start"), col("char_end", "int").alias("char_end"), F.concat(F.col("doc_id").cast("string"), F.lit("#p"), F.col("page").cast("string")).alias("locator"),
    )


def one_fact(facts: DataFrame, relations: DataFrame, fact_id: str) -> DataFrame:
    """A fact beside each of its relations, the surest first; one row with a null relation where it has none.

    The id is pushed to both scans; the partners of its relations are the only other facts read on."""
    fact = fact_rows(facts.where(F.col("id") == fact_id)).select(F.struct("*").alias("fact"), F.lit(1).alias("__one"))
    mine = with_facts(relations_for_fact(relations, fact_id), facts).select(F.struct("*").alias("relation"), F.lit(1).alias("__one"))
    return fact.join(mine, "__one", "left").drop("__one").orderBy(F.desc("relation.confidence"), "relation.id")


def list_relations(relations: DataFrame, facts: DataFrame, types: str | None = None, cross_document_only: bool = False, limit: int = 200) -> DataFrame:
    """The most interesting relations with both facts and the ``total`` that match; the limit comes before the joins,
    missing facts are null."""
    kinds = [t.strip() for t in types.split(",") if t.strip()] if types else None
    if kinds:
        relations = relations.where(F.col("type").isin(kinds))
    if cross_document_only:
        relations = relations.where("cross_document")
    top = interesting(relations)
    return with_facts(top.limit(limit) if limit else top, facts).crossJoin(relations.agg(F.count("*").alias("total")))


def with_facts(relations: DataFrame, facts: DataFrame) -> DataFrame:
    """Relations with their facts as structs ``a`` and ``b``."""
    quote = F.col("quote") if "quote" in facts.columns else F.lit(None).cast("string")
    side = facts.select(F.col("id").alias("k"), F.struct("id", "doc_id", "measure_raw", "entity", F.col("quantity.raw").alias("raw"), "value_text", "page", quote.alias("quote")).alias("f"))
    return relations.join(side.select(F.col("k").alias("a_id"), F.col("f").alias("a")), "a_id", "left").join(side.select(F.col("k").alias("b_id"), F.col("f").alias("b")), "b_id", "left")


def relations_for_fact(relations: DataFrame, fact_id: str) -> DataFrame:
    return relations.where((F.col("a_id") == fact_id) | (F.col("b_id") == fact_id)).orderBy(F.desc("confidence"), "id")


def list_failures(failures: DataFrame, doc_id=None, limit: int = 200) -> DataFrame:
    chosen = failures if doc_id is None else failures.where(F.col("doc_id") == doc_id)
    ordered = chosen.orderBy("id")
    return ordered.limit(limit) if limit else ordered


def failures_with_summary(failures: DataFrame, doc_id=None, limit: int = 200) -> DataFrame:
    """``list_failures`` with ``summary``, the counts by kind over all documents, whatever the filter."""
    counts = failure_summary(failures).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("summary"))
    return list_failures(failures, doc_id, limit).crossJoin(counts)


def failure_summary(failures: DataFrame) -> DataFrame:
    return failures.groupBy("kind").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "kind")


def relations_by_type(relations: DataFrame) -> DataFrame:
    return relations.groupBy("type").agg(F.count("*").alias("n"))


def layer_stats(documents: DataFrame, facts: DataFrame, relations: DataFrame, failures: DataFrame) -> DataFrame:
    """One row of table counts with the relations by type and, where failures have kinds, the failures by kind."""
    one = lambda df, name: df.agg(F.count("*").alias(name))
    kinds = relations_by_type(relations).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("relations_by_type"))
    by_kind = failure_summary(failures) if "kind" in failures.columns else failures.select(F.lit("any").alias("kind"), F.lit(0).alias("n")).where("false")
    failed = by_kind.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("failures_by_kind"))
    return one(documents, "documents").crossJoin(one(facts, "facts")).crossJoin(one(relations, "relations")).crossJoin(one(failures, "failures")).crossJoin(kinds).crossJoin(failed)


def show(relations: DataFrame, facts: DataFrame, types: str | None = None, cross_document_only: bool = False, limit: int = 20) -> DataFrame:
    """Relations as lines of text: verdict, explanation, both facts and both quotes on one line of 200 characters at most."""
    found = list_relations(relations, facts, types, cross_document_only, limit)
    line = lambda s: F.concat_ws(" | ", F.col(f"{s}.entity"), F.col(f"{s}.measure_raw"), F.coalesce(F.col(f"{s}.raw"), F.col(f"{s}.value_text")))
    cut = lambda c: F.substring(F.regexp_replace(c, r"(?U)\s+", " "), 1, 200)
    explained = F.col("explanation") if "explanation" in relations.columns else F.lit(None).cast("string")
    return found.select(F.concat(F.upper("type"), F.lit(" / "), F.col("reason_code")).alias("verdict"), explained.alias("explanation"), cut(line("a")).alias("fact_a"), cut(F.col("a.quote")).alias("quote_a"), cut(line("b")).alias("fact_b"), cut(F.col("b.quote")).alias("quote_b"))


def as_json(df: DataFrame) -> DataFrame:
    """Rows as JSON documents, for an API."""
    return df.select(F.to_json(F.struct("*")).alias("json"))
