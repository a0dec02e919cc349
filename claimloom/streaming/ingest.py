"""Incremental ingest: landed extractor answers become facts, failures and relations, batch by batch."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.loosejson import parse_json_loose
from ..operators import claims, linking, registry
from ..operators.store import Store
from ..session import discard, materialise


def process(batch: DataFrame, store: Store, pages: DataFrame, meta: DataFrame, max_block: int = linking.MAX_BLOCK, strict: bool = False) -> None:
    """One batch: claims are checked and grounded, facts registered and stored, and linked with what is there.

    A batch that is delivered again adds nothing: facts, failures and relations are keyed by content.
    """
    parsed = batch.withColumn("payload", parse_json_loose(F.col("payload")))
    checked, checked_path = materialise(claims.check_claims(claims.explode_claims(parsed), pages, meta, strict), "checked")
    known = registry.load_registry(batch.sparkSession, store.path("registry")) if store.version("registry") else registry.MeasureRegistry()
    facts = claims.accepted_facts(checked)
    if (old := store.read("facts")) is not None:
        facts = facts.join(old.select("id"), "id", "left_anti")
    facts, facts_path = materialise(facts, "facts")
    keys = registry.assign_names(facts, known, ["doc_id", "uid"])
    stored = facts.join(keys, "id").drop("uid", "seq")
    spark = batch.sparkSession
    store.write("registry", spark.createDataFrame([(json.dumps(known.to_dict()),)], "payload string").coalesce(1))
    store.add_facts(stored)
    store.add_failures(claims.failures(checked))
    every = store.read("facts")
    touched = stored.select(*linking.KEYS).distinct()
    relations = linking.link(every.join(F.broadcast(touched) if touched.count() < 10_000 else touched, linking.KEYS, "left_semi"), store.read("relations"), max_block=max_block)
    made, made_path = materialise(relations.withColumn("analysis", F.to_json("analysis")), "relations")
    store.add_relations(made)
    discard(spark, made_path)
    discard(spark, checked_path)
    discard(spark, facts_path)
    store.vacuum()


def start(units: DataFrame, store: Store, pages: DataFrame, meta: DataFrame, checkpoint: str, **options) -> StreamingQuery:
    """Run ``process`` over a stream of landed answers until all of them are taken in."""
    return units.writeStream.foreachBatch(lambda batch, _: process(batch, store, pages, meta, **options)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
