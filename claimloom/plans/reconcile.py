"""Queries of linking, adjudication and the read side over the test tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import adjudicate as adj
from ..operators import linking, readings, registry, store, views
from ..session import table
from . import written as w


def latest_facts(facts: DataFrame) -> DataFrame:
    """Facts once per id, the row extracted last."""
    rows = facts.groupBy("id").agg(F.max_by(F.struct(*[c for c in facts.columns if c != "id"]), "extracted_at").alias("r"))
    return rows.select("id", "r.*")


def _day(text: str) -> Column:
    iso = F.trim(F.col(text))
    return F.when(iso.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_timestamp(iso, F.lit("yyyy-MM-dd")).cast("date"))


#: What the linker needs of a fact; other columns are cut off before the facts are shuffled by id.
_NEEDED = ("id", "doc_id", "fact_type", "measure_key", "measure_raw", "entity", "entity_key", "quantity", "canonical_value", "canonical_unit", "value_text", "period", "period_start", "period_end", "basis", "estimate_type", "as_of", "page", "confidence", "extracted_at")
_KEYED = ("id", "doc_id", "measure_key", "entity_key", "confidence", "extracted_at")


def facts_of(facts: DataFrame, evidence: DataFrame | None = None) -> DataFrame:
    """The facts table in the shape the linker takes: windows are those given as plain ISO days, values as received, the
    quote that of the fact's first evidence.

    This is what the SQL states; ``readings.read_facts_of`` gives the windows and values of every notation."""
    q = F.col("quantity")
    approx = F.lower(q["raw"]).rlike(r"(about|approx|nearly|over|~)")
    quantity = F.when(q.isNotNull(), F.struct(q["raw"].alias("raw"), q["value"].alias("value"), q["unit"].alias("unit"), q["magnitude"].alias("magnitude"), q["kind"].alias("kind"), F.col("canonical_value"), F.col("canonical_unit"), F.coalesce(approx, F.lit(False)).alias("approximate")))
    period = F.when(F.col("period").isNotNull(), F.struct(F.col("period.raw").alias("raw"), F.col("period.kind").alias("kind"), _day("period_start").alias("start"), _day("period_end").alias("end"), F.lit(None).cast("string").alias("label")))
    base = latest_facts(facts.select(*_NEEDED))
    if evidence is None:
        base = base.withColumn("quote", F.lit(None).cast("string"))
    else:
        quotes = evidence.where("quote is not null").groupBy(F.col("fact_id").alias("id")).agg(F.min_by("quote", "evidence_id").alias("quote"))
        base = base.join(quotes, "id", "left")
    return base.select(
        "id", "doc_id", "fact_type", "measure_key", "measure_raw", "entity", "entity_key", quantity.alias("quantity"), "value_text", period.alias("period"), "basis", "estimate_type", "as_of", "page", "quote", "confidence"
    )


#: The same shape in SQL: facts as received, ranked in their block, and their pairs with every comparison.
FACTS_SQL = r"""
latest as (select * from facts qualify row_number() over (partition by id order by extracted_at desc) = 1),
shaped as (
    select id, doc_id, fact_type, measure_key, measure_raw, entity, entity_key, quantity is not null has_q, quantity.raw q_raw, quantity.unit q_unit, quantity.magnitude q_mag,
        canonical_value cv, canonical_unit cu, coalesce(regexp_matches(lower(quantity.raw), '(about|approx|nearly|over|~)'), false) apx, value_text, period is not null has_p, period.raw p_raw, period.kind p_kind,
        case when regexp_matches(trim(period_start, ' '), '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') then try_cast(trim(period_start, ' ') as date) end p_start,
        case when regexp_matches(trim(period_end, ' '), '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') then try_cast(trim(period_end, ' ') as date) end p_end,
        list_sort(list_distinct(list_filter(list_transform(coalesce(basis, []), lambda x: lower(trim(x, ' '))), lambda x: x is not null and x <> ''))) bs,
        coalesce(estimate_type, 'unknown') est, as_of, page, confidence, lower(trim(regexp_replace(quote, '[\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g'), ' ')) quote
    from latest left join (select fact_id, arg_min(quote, evidence_id) quote from evidence where quote is not null group by 1) on fact_id = latest.id),
ranked as (select *, row_number() over (partition by measure_key, entity_key order by confidence desc nulls last, id) as rank from shaped where measure_key is not null and entity_key is not null),
kept as (select * from ranked where rank <= 120)"""

PAIRS_SQL = (
    FACTS_SQL
    + r""",
pairs as (select a, b from kept a join kept b on a.measure_key = b.measure_key and a.entity_key = b.entity_key and a.id < b.id),
marked as (
    select a, b,
        coalesce(a.cu = b.cu and a.cv is not null and b.cv is not null, false) comparable,
        abs(a.cv - b.cv) delta, greatest(abs(a.cv), abs(b.cv)) largest,
        greatest(0.5::double * pow(10.0::double, -length(regexp_extract(coalesce(a.q_raw, ''), '[0-9]\.([0-9]+)', 1))) * coalesce(nullif(a.q_mag, 0), 1),
                 0.5::double * pow(10.0::double, -length(regexp_extract(coalesce(b.q_raw, ''), '[0-9]\.([0-9]+)', 1))) * coalesce(nullif(b.q_mag, 0), 1),
                 (case when a.apx or b.apx then 0.05::double else 0.005::double end) * greatest(abs(a.cv), abs(b.cv))) tolerance,
        a.q_mag is distinct from b.q_mag or a.q_unit is distinct from b.q_unit converted,
        a.p_start is not null and a.p_end is not null ra, b.p_start is not null and b.p_end is not null rb,
        case when a.p_start is not null and a.p_end is not null and b.p_start is not null and b.p_end is not null then a.p_start <= b.p_end and b.p_start <= a.p_end end meet,
        list_distinct(regexp_extract_all(' ' || regexp_replace(lower(coalesce(a.p_raw, '')), '([^a-z])', '\1\1', 'g') || ' ', '[^a-z](q[1-4]|h[12])[^a-z]', 1)) ma,
        list_distinct(regexp_extract_all(' ' || regexp_replace(lower(coalesce(b.p_raw, '')), '([^a-z])', '\1\1', 'g') || ' ', '[^a-z](q[1-4]|h[12])[^a-z]', 1)) mb,
        list_filter(a.bs, lambda x: not list_contains(b.bs, x)) only_a, list_filter(b.bs, lambda x: not list_contains(a.bs, x)) only_b,
        a.est <> b.est and a.est <> 'unknown' and b.est <> 'unknown' est_differs,
        abs(datediff('day', b.as_of, a.as_of)) gap,
        list_distinct(list_filter(regexp_extract_all(lower(coalesce(a.value_text, '')), '([a-z0-9]+)', 1), lambda x: length(x) > 2)) wa,
        list_distinct(list_filter(regexp_extract_all(lower(coalesce(b.value_text, '')), '([a-z0-9]+)', 1), lambda x: length(x) > 2)) wb
    from pairs),
compared as (
    select *, delta <= tolerance agree, delta / (case when largest = 0 then 1 else largest end) rel, len(only_a) > 0 or len(only_b) > 0 basis_differs, coalesce(gap >= 45, false) revised,
        case when not a.has_p or not b.has_p then 'unknown'
             when ra and rb then case when a.p_start = b.p_start and a.p_end = b.p_end then 'same'
                                      when len(list_intersect(ma, mb)) > 0 and (a.p_kind is distinct from b.p_kind or not meet) then 'label_collision' else 'different' end
             when lower(trim(a.p_raw, ' ')) = lower(trim(b.p_raw, ' ')) then 'same' else 'unknown' end p_status,
        case when len(wa) = 0 or len(wb) = 0 then 0.0::double else len(list_intersect(wa, wb))::double / len(list_distinct(list_concat(wa, wb))) end overlap,
        (a.has_q and b.has_q) or coalesce(a.fact_type = 'numeric' and b.fact_type = 'numeric', false) numeric_pair
    from marked),
judged as (
    select *, case
        when not numeric_pair then case
            when trim(coalesce(a.value_text, ''), ' ') = '' or trim(coalesce(b.value_text, ''), ' ') = '' then null
            when overlap >= 0.6 then 'corroborates|exact_match' when revised then 'supersedes|state_superseded' when overlap < 0.2 then 'undetermined|insufficient_context' end
        when not a.has_q or not b.has_q then 'undetermined|insufficient_context '
        when not comparable then 'related|insufficient_context'
        when agree and p_status in ('different', 'label_collision') then 'related|period_mismatch'
        when agree and delta = 0 and not converted then 'corroborates|exact_match'
        when agree and converted then 'corroborates|unit_converted_match'
        when agree then 'corroborates|rounded_match'
        when p_status = 'label_collision' then 'reconciled|period_label_collision'
        when p_status = 'different' then 'reconciled|period_mismatch'
        when basis_differs then 'reconciled|basis_mismatch'
        when est_differs then 'reconciled|estimate_vs_actual'
        when revised then 'reconciled|vintage_revision'
        when a.doc_id = b.doc_id and a.page = b.page and a.quote <> '' and b.quote <> '' and (contains(a.quote, b.quote) or contains(b.quote, a.quote)) then 'undetermined|shared_sentence_ambiguity'
        when p_status = 'unknown' then 'undetermined|insufficient_context  '
        else 'contradicts|value_divergence' end verdict
    from compared),
relations_made as (
    select 'r_' || substr(sha1(a.id || '|' || b.id), 1, 16) id, a.id a_id, b.id b_id, split_part(verdict, '|', 1) as type, trim(split_part(verdict, '|', 2), ' ') reason_code,
        round_even(least(1.0, greatest(0.0, case
            when not numeric_pair then case when split_part(verdict, '|', 1) = 'undetermined' then 0.35::double else 0.70::double end
            when verdict = 'undetermined|insufficient_context ' then 0.30::double
            when verdict = 'related|insufficient_context' then 0.25::double
            when verdict = 'related|period_mismatch' then 0.40::double
            when type_of_agreement is not null then type_of_agreement - (case when p_status = 'unknown' then 0.20::double else 0 end) - (case when basis_differs then 0.10::double else 0 end)
            when verdict = 'reconciled|period_label_collision' then 0.85::double
            when verdict = 'reconciled|period_mismatch' then 0.80::double
            when verdict = 'reconciled|basis_mismatch' then 0.75::double
            when verdict = 'reconciled|estimate_vs_actual' then 0.70::double
            when verdict = 'reconciled|vintage_revision' then 0.60::double
            when verdict = 'undetermined|shared_sentence_ambiguity' then 0.45::double
            when verdict = 'undetermined|insufficient_context  ' then 0.40::double
            else 0.60::double + least(0.35::double, 2.0::double * rel) end)), 3) confidence,
        a.doc_id <> b.doc_id cross_document, p_status, overlap, rel
    from (select *, case when verdict = 'corroborates|exact_match' then 0.95::double when verdict = 'corroborates|unit_converted_match' then 0.90::double when verdict = 'corroborates|rounded_match' then 0.85::double end type_of_agreement from judged)
    where verdict is not null)"""
)


def _facts(spark, sf_dir):
    return facts_of(table(spark, sf_dir, "facts"), table(spark, sf_dir, "evidence"))


def _pairs(spark, sf_dir, **options):
    return linking.candidate_pairs(facts_of(table(spark, sf_dir, "facts")), **options)


def _relations(spark, sf_dir):
    """Relations once per id, the row adjudicated first."""
    r = table(spark, sf_dir, "relations")
    kept = r.groupBy("id").agg(F.min_by(F.struct(*[c for c in r.columns if c != "id"]), F.struct("adjudicated_at", "type", "a_id")).alias("r"))
    return kept.select("id", "r.*")


def _keyed(spark, sf_dir):
    """Keys alone, for queries about which facts meet."""
    return latest_facts(table(spark, sf_dir, "facts").select(*_KEYED))


def _id_pairs(spark, sf_dir, **options):
    return linking.candidate_pairs(_keyed(spark, sf_dir), fields=("id", "doc_id"), **options)


def relations_by_type(spark, sf_dir):
    return linking.link(_facts(spark, sf_dir)).groupBy("type", "reason_code").agg(F.count("*").alias("n"))


def adjudicate_pairs(spark, sf_dir):
    return linking.link(_facts(spark, sf_dir)).select("id", "a_id", "b_id", "type", "reason_code", "confidence", "cross_document")


def adjudicate_state(spark, sf_dir):
    facts = _facts(spark, sf_dir).where("fact_type <> 'numeric' and quantity is null")
    return linking.link(facts).select("a_id", "b_id", "type", "reason_code", "confidence")


def _read(spark, sf_dir):
    return readings.read_facts_of(*(table(spark, sf_dir, n) for n in ("facts", "documents", "sources")))


def relations_by_type_read(spark, sf_dir):
    """As ``relations_by_type``, over windows and values in every notation the project reads; SQL cannot follow."""
    return linking.link(_read(spark, sf_dir)).groupBy("type", "reason_code").agg(F.count("*").alias("n"))


def adjudicate_pairs_read(spark, sf_dir):
    return linking.link(_read(spark, sf_dir)).select("id", "a_id", "b_id", "type", "reason_code", "confidence", "cross_document")


def compare_values_read(spark, sf_dir):
    v = adj.compare_values(F.col("a.quantity"), F.col("b.quantity"))
    return linking.candidate_pairs(_read(spark, sf_dir)).select(F.col("a.id").alias("a_id"), F.col("b.id").alias("b_id"), v.alias("v")).where("v.comparable").select("a_id", "b_id", "v.delta", "v.tolerance", "v.agree", "v.exact", "v.converted")


def compare_periods_read(spark, sf_dir):
    p = adj.compare_periods(F.col("a.period"), F.col("b.period"))
    return linking.candidate_pairs(_read(spark, sf_dir)).groupBy(p["status"].alias("status"), p["overlaps"].alias("overlaps")).agg(F.count("*").alias("n"))


def link_pairs(spark, sf_dir):
    return _id_pairs(spark, sf_dir).select(F.col("a.id").alias("a_id"), F.col("b.id").alias("b_id"))


def link_cap(spark, sf_dir):
    return linking.capped(_keyed(spark, sf_dir), 20).select("id", "measure_key", "entity_key", F.col("rank").cast("bigint").alias("rank"))


def link_pairs_uncut(spark, sf_dir):
    """Pairs of whole blocks, without the linker's cap."""
    return _id_pairs(spark, sf_dir, max_block=None).select(F.col("a.id").alias("a_id"), F.col("b.id").alias("b_id"))


def link_oversized(spark, sf_dir):
    return linking.oversized(_keyed(spark, sf_dir))


def link_cross_doc(spark, sf_dir):
    return _id_pairs(spark, sf_dir, cross_document_only=True).select(F.col("a.id").alias("a_id"), F.col("b.id").alias("b_id"))


def link_incremental(spark, sf_dir):
    """Pairs of the document that arrived last, by id."""
    newest = table(spark, sf_dir, "facts").agg(F.max("doc_id")).first()[0]
    return _id_pairs(spark, sf_dir, new_doc=newest).select(F.col("a.id").alias("a_id"), F.col("b.id").alias("b_id"))


def link_anti_existing(spark, sf_dir):
    return linking.without_existing(_id_pairs(spark, sf_dir), table(spark, sf_dir, "relations")).select(F.col("a.id").alias("a_id"), F.col("b.id").alias("b_id"))


def link_report(spark, sf_dir):
    report = linking.link_report(_facts(spark, sf_dir), table(spark, sf_dir, "relations"))
    return report.withColumn("by_type", F.array_join(F.transform(F.map_entries("by_type"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ","))


def compare_values(spark, sf_dir):
    v = adj.compare_values(F.col("a.quantity"), F.col("b.quantity"))
    return _pairs(spark, sf_dir).select(F.col("a.id").alias("a_id"), F.col("b.id").alias("b_id"), v.alias("v")).where("v.comparable").select("a_id", "b_id", "v.delta", "v.tolerance", "v.agree", "v.exact", "v.converted")


def compare_periods(spark, sf_dir):
    p = adj.compare_periods(F.col("a.period"), F.col("b.period"))
    return _pairs(spark, sf_dir).groupBy(p["status"].alias("status"), p["overlaps"].alias("overlaps")).agg(F.count("*").alias("n"))


def compare_basis(spark, sf_dir):
    b = adj.compare_basis(F.col("a.basis"), F.col("b.basis"))
    return _pairs(spark, sf_dir).groupBy(F.array_join(b["only_a"], ",").alias("only_a"), F.array_join(b["only_b"], ",").alias("only_b")).agg(F.count("*").alias("n"))


def compare_vintage(spark, sf_dir):
    v = adj.compare_vintage(F.col("a.estimate_type"), F.col("a.as_of"), F.col("b.estimate_type"), F.col("b.as_of"))
    return _pairs(spark, sf_dir).groupBy(v["estimate_differs"].alias("estimate_differs"), v["revision_plausible"].alias("revision_plausible"), v["later_fact"].alias("later_fact")).agg(F.count("*").alias("n"))


def text_overlap(spark, sf_dir):
    o = adj.text_overlap(F.col("a.value_text"), F.col("b.value_text"))
    return _pairs(spark, sf_dir).where("a.value_text is not null and b.value_text is not null").select(F.col("a.id").alias("a_id"), F.col("b.id").alias("b_id"), F.bround(o, 3).alias("overlap"))


def blocks_having(spark, sf_dir):
    return linking.blocks(table(spark, sf_dir, "facts")).orderBy(F.desc("n"), "measure_key", "entity_key")


def facts_search(spark, sf_dir):
    return views.search(table(spark, sf_dir, "facts"), q="Chemicals").select("id", "measure_raw", "entity", "extracted_at")


def list_facts(spark, sf_dir):
    return views.list_facts(latest_facts(table(spark, sf_dir, "facts"))).select("id", "doc_id", "page", "measure_label", "display_value", "total")


def relations_ranked(spark, sf_dir):
    return linking.interesting(_relations(spark, sf_dir)).limit(200).select("id", "type", "confidence")


def relation_with_facts(spark, sf_dir):
    shown = views.with_facts(_relations(spark, sf_dir), latest_facts(table(spark, sf_dir, "facts")))
    return shown.select("id", F.col("a.doc_id").alias("a_doc"), F.col("b.doc_id").alias("b_doc"), F.col("a.measure_raw").alias("a_measure"), F.col("b.measure_raw").alias("b_measure"))


def relations_cross_doc(spark, sf_dir):
    return table(spark, sf_dir, "relations").where("cross_document").where(F.col("type").isin("contradicts", "reconciled")).select("id", "type", "confidence")


def relation_counts(spark, sf_dir):
    return views.relations_by_type(table(spark, sf_dir, "relations"))


def show_relations(spark, sf_dir):
    return views.show(_relations(spark, sf_dir), _facts(spark, sf_dir)).select("verdict", "fact_a", "quote_a", "fact_b", "quote_b")


def layer_stats(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    return views.layer_stats(t("documents"), t("facts"), t("relations"), t("evidence")).select("documents", "facts", "relations", F.col("failures").alias("evidence"))


def measures_listing(spark, sf_dir):
    return registry.measures(table(spark, sf_dir, "facts"))


def documents_list(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "title", "source", "published", "n_pages").orderBy("doc_id")


def fact_dedupe(spark, sf_dir):
    from ..operators.claims import dedupe_facts

    return dedupe_facts(table(spark, sf_dir, "facts").withColumn("seq", F.unix_micros("extracted_at"))).select("id", "confidence", F.col("seq").cast("bigint").alias("seq"))


def upsert_documents(spark, sf_dir):
    """Documents upserted with the same titles in capitals and one document more: titles change, sources stay."""
    old = table(spark, sf_dir, "documents").select("doc_id", "title", "source", "n_pages")
    new = old.select(F.col("doc_id"), F.upper("title").alias("title"), F.lit("moved").alias("source"), "n_pages").unionByName(old.agg((F.max("doc_id") + 1).alias("doc_id")).selectExpr("doc_id", "'NEW' title", "'new' source", "cast(1 as int) n_pages"))
    return store.upsert(old, new, "doc_id", ["title", "n_pages"])


def delete_cascade(spark, sf_dir):
    """Rows left after the smallest document id is deleted."""
    t = {n: table(spark, sf_dir, n) for n in ("documents", "facts", "relations")}
    t["failures"] = table(spark, sf_dir, "evidence").select("evidence_id", "doc_id")
    first = t["documents"].agg(F.min("doc_id")).first()[0]
    left = store.delete_cascade(t, first)
    one = lambda n: left[n].agg(F.count("*").alias("n")).select(F.lit(n).alias("table_name"), "n")
    return one("documents").unionAll(one("facts")).unionAll(one("relations")).unionAll(one("failures"))


def insert_new_facts(spark, sf_dir):
    facts = table(spark, sf_dir, "facts").select("id", "doc_id", "extracted_at")
    middle = facts.agg(F.percentile_approx("doc_id", 0.5)).first()[0]
    return store.insert_new(latest_facts(facts.where(F.col("doc_id") <= middle)).select("id", "doc_id"), facts.select("id", "doc_id")).groupBy().agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"))


_NAMES = (
    relations_by_type, adjudicate_pairs, adjudicate_state, relations_by_type_read, adjudicate_pairs_read, compare_values_read, compare_periods_read, link_pairs, link_pairs_uncut, link_oversized, link_cap, link_cross_doc, link_incremental, link_anti_existing, link_report, compare_values, compare_periods, compare_basis, compare_vintage, text_overlap, blocks_having, facts_search,
    list_facts, relations_ranked, relation_with_facts, relations_cross_doc, relation_counts, show_relations, layer_stats, measures_listing, documents_list, fact_dedupe, upsert_documents, delete_cascade, insert_new_facts,
)
QUERIES = {f.__name__: f for f in _NAMES}

_RANK = "case type when 'contradicts' then 0 when 'reconciled' then 1 when 'supersedes' then 2 when 'corroborates' then 3 when 'related' then 4 when 'undetermined' then 5 else 6 end"
_ONE_RELATION = "one as (select * from relations qualify row_number() over (partition by id order by adjudicated_at, type, a_id) = 1)"
SQL = {
    "relations_by_type": f"with {PAIRS_SQL} select type, reason_code, count(*) as n from relations_made group by all",
    "adjudicate_pairs": f"with {PAIRS_SQL} select id, a_id, b_id, type, reason_code, confidence, cross_document from relations_made",
    "adjudicate_state": f"with {PAIRS_SQL.replace('on fact_id = latest.id),', "on fact_id = latest.id where fact_type <> 'numeric' and quantity is null),", 1)} select a_id, b_id, type, reason_code, confidence from relations_made",
    "link_pairs": f"with {FACTS_SQL} select a.id a_id, b.id b_id from kept a join kept b on a.measure_key = b.measure_key and a.entity_key = b.entity_key and a.id < b.id",
    "link_pairs_uncut": "with one as (select * from facts where measure_key is not null and entity_key is not null qualify row_number() over (partition by id order by extracted_at desc) = 1) select a.id a_id, b.id b_id from one a join one b on a.measure_key = b.measure_key and a.entity_key = b.entity_key and a.id < b.id",
    "link_oversized": "select measure_key, entity_key, count(distinct id) as n, count(distinct id) - 120 as beyond from facts where measure_key is not null and entity_key is not null group by 1, 2 having count(distinct id) > 120",
    "link_cap": f"with {FACTS_SQL} select id, measure_key, entity_key, rank from ranked where rank <= 20",
    "link_cross_doc": f"with {FACTS_SQL} select a.id a_id, b.id b_id from kept a join kept b on a.measure_key = b.measure_key and a.entity_key = b.entity_key and a.id < b.id where a.doc_id <> b.doc_id",
    "link_incremental": f"with {FACTS_SQL} select a.id a_id, b.id b_id from kept a join kept b on a.measure_key = b.measure_key and a.entity_key = b.entity_key and a.id < b.id where (select max(doc_id) from facts) in (a.doc_id, b.doc_id)",
    "link_anti_existing": f"""with {FACTS_SQL} select a.id a_id, b.id b_id from kept a join kept b on a.measure_key = b.measure_key and a.entity_key = b.entity_key and a.id < b.id
        where not exists (select 1 from relations r where least(r.a_id, r.b_id) = a.id and greatest(r.a_id, r.b_id) = b.id)""",
    "link_report": f"""with {PAIRS_SQL}, sizes as (select count(*) n from shaped where measure_key is not null and entity_key is not null group by measure_key, entity_key having count(*) >= 2),
        known as (select distinct least(a_id, b_id) lo, greatest(a_id, b_id) hi from relations where a_id is not null and b_id is not null)
        select (select count(*) from sizes) as blocks_examined, (select count(*) from sizes where n > 120) as oversized_blocks, (select count(*) from pairs) as pairs_considered,
            (select count(*) from pairs join known on a.id = lo and b.id = hi) as pairs_skipped_existing,
            (select count(*) from relations_made where not exists (select 1 from known where lo = a_id and hi = b_id)) as relations_written,
            (select string_agg(type || '=' || n, ',' order by type) from (select type, count(*) n from relations_made where not exists (select 1 from known where lo = a_id and hi = b_id) group by 1)) as by_type""",
    "compare_values": f"with {PAIRS_SQL} select a.id a_id, b.id b_id, delta, tolerance, agree, delta = 0 as exact, converted from compared where comparable",
    "compare_periods": f"with {PAIRS_SQL} select p_status as status, meet as overlaps, count(*) as n from compared group by all",
    "compare_basis": f"with {PAIRS_SQL} select array_to_string(only_a, ',') as only_a, array_to_string(only_b, ',') as only_b, count(*) as n from compared group by all",
    "compare_vintage": f"with {PAIRS_SQL} select est_differs as estimate_differs, revised as revision_plausible, case when gap is null then null when a.as_of > b.as_of then 'a' else 'b' end as later_fact, count(*) as n from compared group by all",
    "text_overlap": f"with {PAIRS_SQL} select a.id a_id, b.id b_id, round_even(overlap, 3) as overlap from compared where a.value_text is not null and b.value_text is not null",
    "blocks_having": "select measure_key, entity_key, count(*) as n from facts group by all having count(*) >= 2",
    "facts_search": "select id, measure_raw, entity, extracted_at from facts where contains(lower(coalesce(measure_raw, '')), 'chemicals') or contains(lower(coalesce(entity, '')), 'chemicals')",
    "list_facts": f"""with {FACTS_SQL}, forms as (select measure_key, measure_raw, count(*) n from latest where measure_key is not null group by all),
        labels as (select measure_key, arg_min(measure_raw, (-n, measure_raw)) as label from forms group by 1),
        top as (select * from latest order by doc_id, page, id limit 500)
        select id, doc_id, page, coalesce(label, measure_raw) as measure_label, coalesce(quantity.raw, value_text, '') as display_value, (select count(*) from latest) as total from top left join labels using (measure_key)""",
    "relations_ranked": f"with {_ONE_RELATION} select id, type, confidence from one order by {_RANK}, confidence desc, id limit 200",
    "relation_with_facts": f"with {_ONE_RELATION}, latest as (select * from facts qualify row_number() over (partition by id order by extracted_at desc) = 1) select r.id, a.doc_id as a_doc, b.doc_id as b_doc, a.measure_raw as a_measure, b.measure_raw as b_measure from one r left join latest a on r.a_id = a.id left join latest b on r.b_id = b.id",
    "relations_cross_doc": "select id, type, confidence from relations where cross_document and type in ('contradicts', 'reconciled')",
    "relation_counts": "select type, count(*) as n from relations group by 1",
    "show_relations": rf"""with {_ONE_RELATION}, latest as (select * from facts left join (select fact_id, arg_min(quote, evidence_id) quote from evidence where quote is not null group by 1) on fact_id = id qualify row_number() over (partition by id order by extracted_at desc) = 1),
        top as (select * from one order by {_RANK}, confidence desc, id limit 20)
        select upper(type) || ' / ' || reason_code as verdict, left(regexp_replace(concat_ws(' | ', a.entity, a.measure_raw, coalesce(a.quantity.raw, a.value_text)), '{w.BLANK}+', ' ', 'g'), 200) as fact_a, left(regexp_replace(a.quote, '{w.BLANK}+', ' ', 'g'), 200) as quote_a,
            left(regexp_replace(concat_ws(' | ', b.entity, b.measure_raw, coalesce(b.quantity.raw, b.value_text)), '{w.BLANK}+', ' ', 'g'), 200) as fact_b, left(regexp_replace(b.quote, '{w.BLANK}+', ' ', 'g'), 200) as quote_b from top left join latest a on a_id = a.id left join latest b on b_id = b.id""",
    "layer_stats": "select (select count(*) from documents) as documents, (select count(*) from facts) as facts, (select count(*) from relations) as relations, (select count(*) from evidence) as evidence",
    "measures_listing": "with forms as (select measure_key, measure_raw, count(*) n from facts where measure_key is not null group by all) select measure_key as key, arg_min(measure_raw, (-n, measure_raw)) as label, sum(n)::bigint as support, count(*) as forms from forms group by 1",
    "documents_list": "select doc_id, title, source, published, n_pages from documents",
    "fact_dedupe": "select id, confidence, epoch_us(extracted_at) as seq from facts qualify row_number() over (partition by id order by confidence desc nulls last, extracted_at) = 1",
    "upsert_documents": "select doc_id, upper(title) as title, source, n_pages from documents union all select max(doc_id) + 1, 'NEW', 'new', 1::int from documents",
    "delete_cascade": """with gone as (select min(doc_id) d from documents), ids as (select distinct id from facts, gone where doc_id = d)
        select 'documents' as table_name, count(*) as n from documents, gone where doc_id is distinct from d
        union all select 'facts', count(*) from facts, gone where doc_id is distinct from d
        union all select 'relations', count(*) from relations where not exists (select 1 from ids where ids.id = a_id) and not exists (select 1 from ids where ids.id = b_id)
        union all select 'failures', count(*) from evidence, gone where doc_id is distinct from d""",
    "insert_new_facts": "select count(distinct id) as n, count(distinct id) as ids from facts",
}
