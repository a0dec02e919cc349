"""Queries of the API's and command line's lists, of the store's rules and of layout, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import entities, loosejson, numbers, text
from ..operators import adjudicate as adj
from ..operators import claims, ingest, linking, registry, store, views
from ..session import table
from ..sources.files import cached_answers, openings
from ..sources.files import document_metadata as document_fields
from . import written as w
from .functions import _BLOCKS, _CHECKED, _TOKENS, _UNITS, _blocks, _checked, _claims
from .reconcile import _ONE_RELATION, _RANK, FACTS_SQL, PAIRS_SQL, _facts, _relations, latest_facts


def _latest(spark, sf_dir):
    return latest_facts(table(spark, sf_dir, "facts"))


def fact_rows(spark, sf_dir):
    """All facts as the flat rows of the API."""
    f = _latest(spark, sf_dir)
    labels = registry.measures(f).select(F.col("key").alias("measure_key"), F.col("label").alias("measure_label"))
    rows = views.fact_rows(f, labels)
    return rows.select("id", "doc_id", "measure_label", "value", "canonical_value", "canonical_unit", "period_raw", "period_kind", "period_start", "period_end", F.array_join("basis", ",").alias("basis"), "estimate_type", "as_of", "confidence", "locator")


def _linked_fact(spark, sf_dir):
    return table(spark, sf_dir, "relations").where("b_id is not null and a_id <> b_id").agg(F.min("a_id")).first()[0]


def relations_of_fact(spark, sf_dir):
    """Relations of the smallest fact id that starts one, on either side."""
    return views.relations_for_fact(_relations(spark, sf_dir), _linked_fact(spark, sf_dir)).select("id", "a_id", "b_id", "type", "confidence")


def one_fact(spark, sf_dir):
    """That fact as a flat row beside each of its relations and their other facts."""
    rows = views.one_fact(_latest(spark, sf_dir), _relations(spark, sf_dir), _linked_fact(spark, sf_dir))
    return rows.select("fact.id", "fact.value", "fact.locator", F.col("relation.id").alias("relation_id"), F.col("relation.type").alias("type"), F.col("relation.a.measure_raw").alias("a_measure"), F.col("relation.b.measure_raw").alias("b_measure"))


def facts_of_document(spark, sf_dir):
    """Facts of the smallest document id that has some, in page order."""
    f = _latest(spark, sf_dir)
    first = f.agg(F.min("doc_id")).first()[0]
    return views.list_facts(f, limit=0, doc_id=first).select("id", "page", "measure_label", "display_value", "total")


def relations_list(spark, sf_dir):
    """The relations list of the API for two types named in one text, with the total before the limit."""
    return views.list_relations(_relations(spark, sf_dir), _latest(spark, sf_dir), " contradicts, supersedes ", limit=200).select("id", "type", "confidence", F.col("a.doc_id").alias("a_doc"), F.col("b.doc_id").alias("b_doc"), "total")


def failures_list(spark, sf_dir):
    """The failures list of the API: the first 200 by id, with counts by kind over all of them."""
    found = views.failures_with_summary(claims.failures(_checked(spark, sf_dir, fuzzy=False)), limit=200)
    return found.select("id", "doc_id", "page", "stage", "kind", F.array_join(F.transform(F.map_entries("summary"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias("summary"))


def measures_in_full(spark, sf_dir):
    m = registry.measures_in_full(table(spark, sf_dir, "facts"))
    forms = F.array_join(F.transform(F.array_sort(F.map_entries("surface_forms")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), "|")
    return m.select("key", "label", "kind", F.array_join("tokens", " ").alias("tokens"), forms.alias("forms"), "support")


def stats_in_full(spark, sf_dir):
    """Counts of all tables with relations by type and failures by kind."""
    t = lambda n: table(spark, sf_dir, n)
    row = views.layer_stats(t("documents"), t("facts"), t("relations"), claims.failures(_checked(spark, sf_dir, fuzzy=False)))
    flat = lambda c: F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return row.select("documents", "facts", "relations", "failures", flat("relations_by_type").alias("relations_by_type"), flat("failures_by_kind").alias("failures_by_kind"))


def relink(spark, sf_dir):
    """Relations after the old ones are cleared and every pair is judged anew, counted by type and document side."""
    return linking.relink(_facts(spark, sf_dir)).groupBy("type", "cross_document").agg(F.count("*").alias("n"))


def pair_priority(spark, sf_dir):
    """The 200 pairs that are judged first: across documents, then by joint confidence."""
    pairs = linking.candidate_pairs(_latest(spark, sf_dir).select("id", "doc_id", "measure_key", "entity_key", "confidence"), fields=("id", "doc_id", "confidence"))
    return linking.pair_priority(pairs).limit(200).select(F.col("a.id").alias("a_id"), F.col("b.id").alias("b_id"))


def relation_explanations(spark, sf_dir):
    """What each relation says in words."""
    return linking.link(_facts(spark, sf_dir)).select("id", "explanation")


def relation_analysis(spark, sf_dir):
    """The typed evidence of each relation: values, windows, qualifiers and vintage."""
    a = F.col("analysis")
    return linking.link(_facts(spark, sf_dir)).select("id", a["values"]["comparable"].alias("comparable"), a["values"]["delta"].alias("delta"), a["periods"]["status"].alias("periods"), F.array_join(a["basis"]["only_a"], ",").alias("only_a"), F.array_join(a["basis"]["only_b"], ",").alias("only_b"), a["vintage"]["as_of_gap_days"].cast("bigint").alias("gap"), a["text_overlap"].alias("overlap"))


def same_sentence(spark, sf_dir):
    """Pairs of facts that quote one sentence of one page."""
    pairs = linking.candidate_pairs(_facts(spark, sf_dir), max_block=None, fields=("id", "doc_id", "page", "quote"))
    return pairs.where(adj.same_sentence(F.col("a"), F.col("b"))).select(F.col("a.id").alias("a_id"), F.col("b.id").alias("b_id"))


def upsert_relations(spark, sf_dir):
    """Relations upserted with their types in capitals and their sides turned: types change, sides stay."""
    old = _relations(spark, sf_dir).select("id", "a_id", "b_id", "type", "reason_code", "confidence", "adjudicator", "cross_document")
    new = old.select("id", F.col("b_id").alias("a_id"), F.col("a_id").alias("b_id"), F.upper("type").alias("type"), "reason_code", F.lit(0.5).alias("confidence"), F.lit("again").alias("adjudicator"), (~F.col("cross_document")).alias("cross_document"))
    return store.upsert(old, new, "id", [c for c in store.RELATION_UPDATES if c in old.columns])


def insert_failures(spark, sf_dir):
    """Failures added to those of the documents with even ids: known ids stay as they are."""
    all_ = claims.failures(_checked(spark, sf_dir, fuzzy=False)).select("id", "doc_id", "kind")
    return store.insert_new(all_.where("doc_id % 2 = 0"), all_.withColumn("kind", F.upper("kind"))).select("id", "doc_id", "kind")


def documents_forced(spark, sf_dir):
    """Documents to delete before a forced ingest of the English ones: those with one of their texts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.sha2("text", 256).alias("sha256")).where("sha256 is not null")
    return store.known_copies(docs.where("lang = 'en'"), docs, "doc_id")


def cached_answers_used(spark, sf_dir):
    """Answers with a cache that holds those of the documents with even ids: cached ones first, the rest extracted."""
    units = _claims(spark, sf_dir).select("doc_id", F.get("pages", F.lit(0)).alias("batch"), "pages", F.col("payload").alias("prompt"))
    key = F.sha2(F.concat_ws("\x00", F.lit("m"), "prompt"), 256)
    cache = units.where("doc_id % 2 = 0").select(key.alias("key"), F.lit("cached").alias("payload")).dropDuplicates(["key"])
    answers, fresh = cached_answers(units, cache, "m", lambda u: u.select("doc_id", "batch", "pages", F.lit("extracted").alias("payload")))
    return answers.groupBy("payload").agg(F.count("*").alias("n"), F.count_distinct("key").alias("keys"))


def text_blocks(spark, sf_dir):
    """Layout blocks without images and blanks; here blocks of headings stand for images."""
    b = _blocks(spark, sf_dir).withColumn("block_type", F.when(F.col("kind") == "heading", 1).otherwise(0))
    return ingest.keep_text_blocks(b).groupBy("doc_id", "page").agg(F.count("*").alias("n"))


def reading_order(spark, sf_dir):
    """Reading order of the blocks of each page, set in two columns by their numbers, on a page 600 wide."""
    b = _blocks(spark, sf_dir).withColumn("block_no", F.col("idx"))
    right = (F.col("idx") % 2 == 1) & (F.col("doc_id") % 3 != 0)
    b = b.withColumns({"x0": F.when(right, 320.0).otherwise(40.0), "x1": F.when(right, 560.0).when(F.col("doc_id") % 3 == 0, 560.0).otherwise(280.0), "y0": F.floor(F.col("idx") / 2) * 20.0, "page_width": F.lit(600.0)})
    return ingest.with_reading_order(b).select("doc_id", "page", "idx", "read_idx", F.col("gutter").isNotNull().alias("two_columns"))


def unit_spans(spark, sf_dir):
    """Characters that each batch of blocks spans in its page."""
    blocks = ingest.with_offsets(_blocks(spark, sf_dir))
    units = ingest.pack_units(_blocks(spark, sf_dir), 600, 0.0).select("doc_id", "page", "unit", F.explode("idxs").alias("idx"))
    return units.join(blocks, ["doc_id", "page", "idx"]).groupBy("doc_id", "page", "unit").agg(ingest.unit_span(blocks).alias("s")).select("doc_id", "page", F.col("unit").cast("bigint").alias("unit"), "s.char_start", "s.char_end")


def unit_prompts(spark, sf_dir):
    """The prompt of each page: heading, scale note and marked text."""
    pages = table(spark, sf_dir, "doc_pages").withColumns({"section": F.when(F.col("page") > 1, F.lit("Results")).otherwise(""), "marked_text": ingest.marked_text(F.col("page"), F.coalesce("text", F.lit("")))})
    return ingest.unit_prompt(pages).select("doc_id", "page", F.length("prompt").alias("chars"), F.sha2("prompt", 256).alias("digest"))


def scale_suffix(spark, sf_dir):
    """The scale word right after the first number of each figure."""
    raws = table(spark, sf_dir, "facts").where("quantity.raw is not null").select(F.col("quantity.raw").alias("raw")).distinct()
    n = numbers.parse_number(F.col("raw"))
    return raws.withColumn("n", n).select("raw", F.coalesce(numbers.scale_suffix(F.col("n.tail")), F.lit("")).alias("word"))


def same_entities(spark, sf_dir):
    """Entities that are the same: equal keys, one beginning with the other's words, or equal initials forms."""
    e = table(spark, sf_dir, "facts").where("entity is not null").select("entity").distinct()
    return entities.same_pairs(e.withColumn("key", entities.entity_key(F.col("entity"))))


def titles(spark, sf_dir):
    """A title for each document from its title field, its first page and a file name."""
    first = table(spark, sf_dir, "doc_pages").where("page = 1").select("doc_id", F.col("text").alias("head"))
    d = table(spark, sf_dir, "documents").select("doc_id", "title").join(first, "doc_id", "left")
    meta = F.when(F.col("doc_id") % 2 == 0, F.col("title"))
    largest = F.array(F.lit("Contents"), text.title_line(F.when(F.col("doc_id") % 3 == 0, F.substring_index("head", "\n", 1))))
    name = F.concat(F.lit("in/annual-report_"), F.col("doc_id").cast("string"), F.lit(".pdf"))
    shown = F.when(F.col("doc_id") % 3 == 0, largest)
    return d.select("doc_id", text.guess_title(meta, shown, F.col("head"), name).alias("guess"), text.is_generic_title(F.col("title")).alias("generic"))


def meta_dates(spark, sf_dir):
    """Dates as PDF metadata and extractors write them: whole ones are read, partial ones are null unless asked for."""
    d = table(spark, sf_dir, "documents").where("published is not null").select("doc_id", "published")
    written = F.when(F.col("doc_id") % 2 == 0, F.date_format("published", "yyyy-MM-dd")).otherwise(F.date_format("published", "yyyy-MM"))
    return d.select("doc_id", text.pdf_date(F.concat(F.lit("D:"), F.date_format("published", "yyyyMMdd"), F.lit("120000"))).alias("pdf"), text.iso_date(F.concat(written, F.lit(" "))).alias("iso"), text.iso_date(written, partial=True).alias("partial"))


def json_repair(spark, sf_dir):
    """Answers cut off inside their last claim: the whole claims before it are kept."""
    cut = _claims(spark, sf_dir).select("doc_id", F.get("pages", F.lit(0)).alias("page"), F.expr("left(payload, length(payload) - 2)").alias("payload"))
    return cut.select("doc_id", "page", F.coalesce(F.size(F.from_json(loosejson.parse_json_loose(F.col("payload")), "array<string>")), F.lit(0)).alias("n"))


def coercions(spark, sf_dir):
    """Fields of an answer as they are taken: blank texts, pages out of the unit, lists and lone texts of qualifiers."""
    f = table(spark, sf_dir, "facts").select("id", "extracted_at", "page", "basis", "value_text")
    lone = F.when(F.size("basis") == 1, F.get("basis", F.lit(0))).otherwise(F.to_json("basis"))
    pages = F.array(F.lit(1), F.lit(2), F.lit(3))
    return f.select("id", "extracted_at", claims.page_in_unit(F.col("page").cast("string"), pages).alias("page"), F.array_join(claims.basis_of(claims.as_list(lone)), ",").alias("basis"), claims.blank_to_null(F.col("value_text")).alias("value_text"))


def document_metadata(spark, sf_dir):
    """Fields of an extractor's answers about documents: every third is whole, others are broken or missing."""
    d = table(spark, sf_dir, "documents")
    good = F.to_json(F.struct("title", F.col("source").alias("publisher"), F.date_format("published", "yyyy-MM").alias("published"), F.lit(" ").alias("principal_entity")))
    answers = d.where("doc_id % 3 < 2").select("doc_id", F.when(F.col("doc_id") % 3 == 0, good).otherwise(F.lit("[1")).alias("payload"))
    return document_fields(d, answers)


def document_openings(spark, sf_dir):
    return openings(table(spark, sf_dir, "doc_pages")).select("doc_id", F.sha2("opening", 256).alias("digest"), F.length("opening").alias("chars"))


def pages_to_relations(spark, sf_dir):
    """The whole way: claims checked and grounded on their pages with the fuzzy search, made into facts, registered, linked."""
    facts = claims.accepted_facts(_checked(spark, sf_dir))
    keys = registry.assign_batch(facts)
    named = facts.withColumn("kind", F.coalesce("quantity.kind", F.lit("other"))).join(keys, ["measure_raw", "kind"]).drop("kind")
    return linking.link(named).groupBy("type", "reason_code").agg(F.count("*").alias("n"))


_NAMES = (
    pages_to_relations, document_metadata, document_openings, fact_rows, relations_of_fact, one_fact, facts_of_document, relations_list, failures_list, measures_in_full, stats_in_full, relink, pair_priority, relation_explanations, relation_analysis, same_sentence, upsert_relations, insert_failures, documents_forced, cached_answers_used,
    text_blocks, reading_order, unit_spans, unit_prompts, scale_suffix, same_entities, titles, meta_dates, json_repair, coercions,
)
QUERIES = {f.__name__: f for f in _NAMES}

_LATEST = "latest as (select * from facts qualify row_number() over (partition by id order by extracted_at desc) = 1)"
_LABELS = "forms as (select measure_key, measure_raw, count(*) n from latest where measure_key is not null group by all), labels as (select measure_key, arg_min(measure_raw, (-n, measure_raw)) as label from forms group by 1)"
_ONE = _ONE_RELATION
_FIRST = "pick as (select min(a_id) as pick from relations where b_id is not null and a_id <> b_id)"
_FAILED = f"{_CHECKED}, failed as (select *, 'x_' || doc_id || '_' || page || '_' || failure || '_' || (row_number() over (partition by doc_id, page, failure order by uid) - 1) as fid from checked where failure is not null)"
_DESCRIBED = "coalesce({x}.q_raw, {x}.value_text, '') || ' for ' || coalesce({x}.p_raw, 'an unstated period')"
SQL = {
    "document_metadata": f"select doc_id, case when doc_id % 3 = 0 then nullif({w.trimmed('title')}, '') end as title, case when doc_id % 3 = 0 then nullif({w.trimmed('source')}, '') end as publisher, case when doc_id % 3 = 0 then date_trunc('month', published)::date end as published, null::varchar as principal_entity from documents",
    "document_openings": "with o as (select doc_id, left(string_agg(coalesce(text, ''), chr(10) || chr(10) order by page), 9000) t from doc_pages where page <= 3 group by 1) select doc_id, sha256(t) as digest, length(t)::int as chars from o",
    "fact_rows": f"""with {_LATEST}, {_LABELS} select id, doc_id, coalesce(label, measure_raw) as measure_label, coalesce(quantity.raw, value_text, '') as value, canonical_value, canonical_unit, period.raw as period_raw, period.kind as period_kind, period_start, period_end,
        array_to_string(basis, ',') as basis, estimate_type, as_of::varchar as as_of, confidence, doc_id || '#p' || page as locator from latest left join labels using (measure_key)""",
    "relations_of_fact": f"with {_ONE}, {_FIRST} select id, a_id, b_id, type, confidence from one, pick where a_id = pick or b_id = pick",
    "one_fact": f"""with {_ONE}, {_FIRST}, {_LATEST} select f.id, coalesce(f.quantity.raw, f.value_text, '') as value, f.doc_id || '#p' || f.page as locator, r.id as relation_id, r.type, a.measure_raw as a_measure, b.measure_raw as b_measure
        from pick join latest f on f.id = pick left join one r on r.a_id = pick or r.b_id = pick left join latest a on a.id = r.a_id left join latest b on b.id = r.b_id""",
    "facts_of_document": f"with {_LATEST}, {_LABELS}, mine as (select * from latest where doc_id = (select min(doc_id) from facts)) select id, page, coalesce(label, measure_raw) as measure_label, coalesce(quantity.raw, value_text, '') as display_value, (select count(*) from mine) as total from mine left join labels using (measure_key)",
    "relations_list": f"""with {_ONE}, {_LATEST}, chosen as (select * from one where type in ('contradicts', 'supersedes')), top as (select * from chosen order by {_RANK}, confidence desc, id limit 200)
        select t.id, t.type, t.confidence, a.doc_id as a_doc, b.doc_id as b_doc, (select count(*) from chosen) as total from top t left join latest a on a.id = a_id left join latest b on b.id = b_id""",
    "failures_list": f"with {_FAILED} select fid as id, doc_id, page, 'extract' as stage, failure as kind, (select string_agg(failure || '=' || n, ',' order by failure) from (select failure, count(*) n from failed group by 1)) as summary from failed order by fid limit 200",
    "measures_in_full": f"""with m as (select measure_key, measure_raw, nullif(quantity.kind, 'other') kind, count(*) n from facts where measure_key is not null group by all), forms as (select measure_key, measure_raw, sum(n) n from m group by all),
        kinds as (select measure_key, arg_min(kind, (-n, kind)) kind from (select measure_key, kind, sum(n) n from m where kind is not null group by all) group by 1),
        listed as (select measure_key, arg_min(measure_raw, (-n, measure_raw)) as label, sum(n)::bigint support, string_agg(measure_raw || '=' || n, '|' order by measure_raw) forms from forms group by 1)
        select measure_key as key, label, coalesce(kind, 'other') as kind, array_to_string({_TOKENS.replace('measure_raw', 'label')}, ' ') as tokens, forms, support from listed left join kinds using (measure_key)""",
    "stats_in_full": f"""with {_CHECKED} select (select count(*) from documents) as documents, (select count(*) from facts) as facts, (select count(*) from relations) as relations, (select count(*) from checked where failure is not null) as failures,
        (select string_agg(type || '=' || n, ',' order by type) from (select type, count(*) n from relations group by 1)) as relations_by_type, (select string_agg(failure || '=' || n, ',' order by failure) from (select failure, count(*) n from checked where failure is not null group by 1)) as failures_by_kind""",
    "relink": f"with {PAIRS_SQL} select type, cross_document, count(*) as n from relations_made group by all",
    "pair_priority": f"with {FACTS_SQL} select a.id a_id, b.id b_id from kept a join kept b on a.measure_key = b.measure_key and a.entity_key = b.entity_key and a.id < b.id order by a.doc_id <> b.doc_id desc, a.confidence + b.confidence desc, a.id, b.id limit 200",
    "relation_explanations": f"""with {PAIRS_SQL} select 'r_' || substr(sha1(a.id || '|' || b.id), 1, 16) as id, {_DESCRIBED.format(x='a')} || ' against ' || {_DESCRIBED.format(x='b')}
        || case when comparable then '; apart by ' || {w.significant('delta')} || ' where ' || {w.significant('tolerance')} || ' is allowed' else '' end as explanation from judged where verdict is not null""",
    "relation_analysis": f"""with {PAIRS_SQL} select 'r_' || substr(sha1(a.id || '|' || b.id), 1, 16) as id, comparable, case when comparable then delta end as delta, p_status as periods, array_to_string(list_sort(only_a), ',') as only_a, array_to_string(list_sort(only_b), ',') as only_b,
        gap, round_even(overlap, 3) as overlap from judged where verdict is not null""",
    "same_sentence": f"""with {FACTS_SQL}, all_of as (select * from shaped where measure_key is not null and entity_key is not null) select a.id a_id, b.id b_id from all_of a join all_of b on a.measure_key = b.measure_key and a.entity_key = b.entity_key and a.id < b.id
        where a.doc_id = b.doc_id and a.page = b.page and a.quote <> '' and b.quote <> '' and (contains(a.quote, b.quote) or contains(b.quote, a.quote))""",
    "upsert_relations": f"with {_ONE} select id, a_id, b_id, upper(type) as type, reason_code, 0.5::double as confidence, 'again' as adjudicator, cross_document from one",
    "insert_failures": f"with {_FAILED} select fid as id, doc_id, case when doc_id % 2 = 0 then failure else upper(failure) end as kind from failed",
    "documents_forced": "select doc_id from documents where text is not null and text in (select text from documents where lang = 'en' and text is not null)",
    "cached_answers_used": "with u as (select distinct doc_id, page from evidence join (select distinct id from facts) f on fact_id = f.id) select case when doc_id % 2 = 0 then 'cached' else 'extracted' end as payload, count(*) as n, count(*) as keys from u group by 1",
    "text_blocks": f"with {_BLOCKS} select doc_id, page, count(*) as n from blocks where not {w.heading('text')} group by 1, 2",
    "reading_order": f"""with {_BLOCKS}, s as (select doc_id, page, idx, case when doc_id % 3 = 0 then 'both' when idx % 2 = 1 then 'right' else 'left' end side, count(*) over (partition by doc_id, page) n from blocks),
        c as (select *, sum((side = 'left')::int) over p l, sum((side = 'right')::int) over p r, sum((side = 'both')::int) over p b from s window p as (partition by doc_id, page)),
        t as (select *, n >= 6 and l + r > 0 and least(l, r) >= 0.25 * (l + r) and b <= 0.35 * n as two from c)
        select doc_id, page, idx::int as idx, (row_number() over (partition by doc_id, page order by case when two and side = 'right' then 1 else 0 end, idx // 2, case when side = 'right' then 1 else 0 end, idx) - 1)::int as read_idx, two as two_columns from t""",
    "unit_prompts": "with p as (select doc_id, page, concat_ws(chr(10), case when page > 1 then 'Section: Results' end, 'Figures are in units of ' || case when magnitude_hint >= 1e7 then replace(format('{:.1E}', magnitude_hint), 'E+0', 'E') else format('{:.1f}', magnitude_hint) end, '[[PAGE ' || page || ']]' || chr(10) || coalesce(text, '')) t from doc_pages) select doc_id, page, length(t)::int as chars, sha256(t) as digest from p",
    "scale_suffix": f"with raws as (select distinct quantity.raw as raw from facts where quantity.raw is not null), {w.numbers('raws')} select raw, coalesce(lower(regexp_extract(tail, '(?i)^[\\s\\x{{a0}}\\x{{2007}}\\x{{2009}}\\x{{202f}}]*({w.SCALE_WORDS})(?:[^A-Za-z]|$)', 1)), '') as word from numbers",
    "same_entities": f"""with names as (select distinct entity from facts where entity is not null), {w.entity_keys('names')}, e as (select entity, key k, string_split(key, ' ') ws, array_to_string(list_concat(list_transform(string_split(key, ' ')[:-2], lambda x: x[1]), string_split(key, ' ')[-1:]), ' ') ini from entity_keys where key <> '')
        select a.entity as a, b.entity as b from e a join e b on a.entity < b.entity and (a.ws[1] = b.ws[1] or a.ini = b.ini) where a.k = b.k or (length(a.ws[1]) > 3 and (a.ws[:len(b.ws)] = b.ws or b.ws[:len(a.ws)] = a.ws)) or (len(a.ws) >= 2 and len(b.ws) >= 2 and a.ini = b.ini)""",
    "meta_dates": "select doc_id, published as pdf, case when doc_id % 2 = 0 then published end as iso, case when doc_id % 2 = 0 then published else date_trunc('month', published)::date end as partial from documents where published is not null",
    "json_repair": "select doc_id, page, (count(*) - 1)::int as n from evidence join (select distinct id from facts) f on fact_id = f.id group by 1, 2",
    "coercions": f"""select id, extracted_at, case when page between 1 and 3 then page else 1 end::int as page, array_to_string(list_sort(list_distinct(list_transform(list_filter(coalesce(basis, []), lambda x: {w.trimmed('x')} <> ''), lambda x: regexp_replace(lower({w.trimmed('x')}), '^[ .;]+|[ .;]+$', '', 'g')))), ',') as basis,
        nullif({w.trimmed('value_text')}, '') as value_text from facts""",
    "unit_spans": f"with recursive {_UNITS}, b as (select doc_id, page, idx, coalesce(sum(length(text) + 1) over (partition by doc_id, page order by idx rows between unbounded preceding and 1 preceding), 0) s, length(text) n from blocks) select d.doc_id, d.page, unit, min(s)::int as char_start, max(s + n)::int as char_end from (select doc_id, page, unit, unnest(list_transform(u, lambda x: x.idx)) idx from units) d join b on b.doc_id = d.doc_id and b.page = d.page and b.idx = d.idx group by all",
    "titles": f"""with d as (select doc_id, title, p.text as head, case when doc_id % 2 = 0 then trim(coalesce(title, ''), ' ') else '' end meta from documents left join (select doc_id, text from doc_pages where page = 1) p using (doc_id)),
        t as (select *, {w.trimmed(w.clean("split_part(head, chr(10), 1)"))} top from d),
        l as (select *, case when length(top) between 6 and 140 and {w.letters('top')} >= length(top) * 0.5 then top end line, list_filter(list_transform(string_split(head, chr(10)), lambda x: {w.trimmed('x')}), lambda x: length(x) between 8 and 140 and {w.letters('x')} > length(x) * 0.5)[1] as body from t)
        select doc_id, left(case when length(meta) > 4 and lower(meta) not like '%.pdf' then meta when doc_id % 3 = 0 and line is not null and not {w.generic('line')} then line when doc_id % 3 = 0 then 'Contents' when body is not null then body else 'annual report ' || doc_id end, 200) as guess,
            {w.generic('title')} as generic from l""",
}
