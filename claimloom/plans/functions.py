"""Queries of the scalar functions and of ingest over the test tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import entities, loosejson, measures, numbers, periods, text, units
from ..operators import adjudicate as adj
from ..operators import claims, grounding, ingest, registry, store
from ..session import materialise, table
from . import written as w


def _raws(spark, sf_dir):
    return table(spark, sf_dir, "facts").where("quantity.raw is not null").select(F.col("quantity.raw").alias("raw")).distinct()


def parse_number(spark, sf_dir):
    n = numbers.parse_number(F.col("raw"))
    return _raws(spark, sf_dir).withColumn("n", n).select("raw", F.col("n.value").alias("value"), F.coalesce("n.approximate", F.lit(False)).alias("approximate"))


def plausible_grouping(spark, sf_dir):
    body = F.regexp_extract("raw", "([0-9][0-9,.]*)", 1)
    return _raws(spark, sf_dir).withColumn("body", body).where("body <> ''").select("raw", "body", numbers.plausible_grouping(F.col("body")).alias("plausible"))


def scale_words(spark, sf_dir):
    word = F.regexp_extract("raw", "([A-Za-z]+)[.]?$", 1)
    return _raws(spark, sf_dir).select("raw", numbers.scale_for(word).alias("scale"))


def build_quantity(spark, sf_dir):
    """Quantities read by the linker's own grammar, from the raw text and the column heading."""
    rows = table(spark, sf_dir, "facts").where("quantity.raw is not null").select(F.col("quantity.raw").alias("raw"), "header").distinct()
    q = units.build_quantity(F.col("raw"), F.col("header"), units.magnitude_from_header(F.col("header")))
    return rows.withColumn("q", q).select("raw", "header", "q.kind", "q.canonical_unit", "q.canonical_value", "q.magnitude", "q.approximate")


def magnitude_hint(spark, sf_dir):
    return table(spark, sf_dir, "facts").where("header is not null").select("header").distinct().select("header", units.magnitude_from_header(F.col("header")).alias("magnitude"))


def detect_currency(spark, sf_dir):
    return _raws(spark, sf_dir).select("raw", units.detect_currency(F.col("raw")).alias("currency"))


def detect_percent(spark, sf_dir):
    after = F.regexp_extract("raw", "[0-9]([^0-9]*)$", 1)
    return _raws(spark, sf_dir).select("raw", units.detect_percent(after).alias("unit"))


def format_compact(spark, sf_dir):
    return table(spark, sf_dir, "facts").where("canonical_value is not null").select("id", "extracted_at", numbers.format_compact(F.col("canonical_value")).alias("short"))


def singularise(spark, sf_dir):
    words = table(spark, sf_dir, "facts").select(F.explode(F.regexp_extract_all(F.lower("measure_raw"), F.lit("([a-z]+)"), F.lit(1))).alias("word")).distinct()
    return words.select("word", units.singularise(F.col("word")).alias("noun"), measures.singular(F.col("word")).alias("token"))


def fiscal_windows(spark, sf_dir):
    """Fiscal years, halves and quarters of each source for the years its documents were published in."""
    docs = table(spark, sf_dir, "documents").where("published is not null").join(table(spark, sf_dir, "sources").select("source", "fy_end_month"), "source")
    rows = docs.select(F.year("published").alias("y"), "fy_end_month", F.quarter("published").alias("q")).distinct()
    y, q, m = F.col("y"), F.col("q"), F.col("fy_end_month")
    f, k, h, c = periods.fiscal_year_window(y, m), periods.fiscal_quarter_window(y, q, m), periods.fiscal_half_window(y, F.ceil(q / 2).cast("int"), m), periods.calendar_quarter_window(y, q)
    return rows.select(
        "y", "fy_end_month", "q", f["start"].alias("fy_start"), f["end"].alias("fy_end"), k["start"].alias("q_start"), k["end"].alias("q_end"), h["start"].alias("h_start"), h["end"].alias("h_end"), c["start"].alias("c_start"), c["end"].alias("c_end"), periods.days(f).cast("int").alias("fy_days")
    )


def parse_period(spark, sf_dir):
    """Windows of all period texts by the habits of each source, with the linker's ordered patterns."""
    facts = table(spark, sf_dir, "facts").where("period.raw is not null").select("doc_id", F.col("period.raw").alias("raw"))
    fy = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "sources").select("source", "fy_end_month"), "source").select("doc_id", "fy_end_month")
    rows = facts.join(fy, "doc_id").select("raw", "fy_end_month").distinct()
    return rows.withColumn("p", periods.period_or_unknown(F.col("raw"), F.col("fy_end_month"))).select("raw", "fy_end_month", "p.kind", "p.start", "p.end", "p.label")


def fy_end_vote(spark, sf_dir):
    """The month each document's text names as the end of its fiscal year."""
    return table(spark, sf_dir, "documents").select("doc_id", periods.infer_fiscal_year_end(F.col("text")).cast("int").alias("month"))


def entity_keys(spark, sf_dir):
    return table(spark, sf_dir, "facts").where("entity is not null").select("entity").distinct().select("entity", entities.entity_key(F.col("entity")).alias("key"), entities.is_pointing(F.col("entity")).alias("pointing"))


def entity_initials(spark, sf_dir):
    return table(spark, sf_dir, "facts").where("entity_key <> ''").select("entity_key").distinct().select("entity_key", entities.initials_form(F.col("entity_key")).alias("initials"))


def measure_tokens(spark, sf_dir):
    rows = table(spark, sf_dir, "facts").where("measure_raw is not null").select("measure_raw").distinct().withColumn("t", measures.tokenise_measure(F.col("measure_raw")))
    return rows.select("measure_raw", F.array_join("t", " ").alias("tokens"), F.array_join(F.array_sort(measures.markers_of(F.col("t"))), " ").alias("markers"), measures.slug(F.col("t")).alias("slug"))


def token_frequency(spark, sf_dir):
    return registry.token_frequencies(table(spark, sf_dir, "facts"))


def measure_similarity(spark, sf_dir):
    return registry.similar_names(table(spark, sf_dir, "facts")).select("a", "kind_a", "b", "kind_b", F.round("similarity", 6).alias("similarity"))


def registry_batch(spark, sf_dir):
    return registry.assign_batch(table(spark, sf_dir, "facts"))


def registry_exact(spark, sf_dir):
    """The order-dependent registry: one call a fact, in order of extraction."""
    return registry.assign_sequential(table(spark, sf_dir, "facts"), registry.MeasureRegistry(), ["extracted_at", "id"])


def registry_names(spark, sf_dir):
    """The order-dependent registry with one call a distinct name, as the stream uses it."""
    return registry.assign_names(table(spark, sf_dir, "facts"), registry.MeasureRegistry(), ["extracted_at", "id"])


def _blocks(spark, sf_dir):
    return ingest.split_blocks(table(spark, sf_dir, "doc_pages"))


def block_offsets(spark, sf_dir):
    return ingest.with_offsets(_blocks(spark, sf_dir)).select("doc_id", "page", "idx", "char_start", "char_end")


def block_kinds(spark, sf_dir):
    return _blocks(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n"))


def density_score(spark, sf_dir):
    return _blocks(spark, sf_dir).select("doc_id", "page", "idx", "density")


def running_heading(spark, sf_dir):
    return ingest.with_heading(_blocks(spark, sf_dir)).select("doc_id", "page", "idx", "section")


def pack_batches(spark, sf_dir):
    """Pages packed into batches of 1,500 characters and at most 10 pages, with the hints all pages agree on."""
    pages = ingest.dense_pages(_blocks(spark, sf_dir), 0.0)
    b = ingest.pack_batches(pages, table(spark, sf_dir, "doc_pages"), 1500)
    return b.select("doc_id", "batch", F.array_join("pages", ",").alias("pages"), "chars", "density", "magnitude_hint", "unit_hint")


def pack_units(spark, sf_dir):
    return ingest.pack_units(_blocks(spark, sf_dir), 600, 0.0).select("doc_id", "page", "unit", F.array_join("idxs", ",").alias("idxs"), "density")


def unit_stats(spark, sf_dir):
    return ingest.unit_stats(ingest.pack_batches(ingest.dense_pages(_blocks(spark, sf_dir))))


def budget_cap(spark, sf_dir):
    pages = ingest.dense_pages(_blocks(spark, sf_dir), 0.0).withColumnRenamed("page", "batch")
    return ingest.within_budget(pages, 2).select("doc_id", "batch", F.col("rank").cast("bigint").alias("rank"))


def clean_text(spark, sf_dir):
    return table(spark, sf_dir, "doc_pages").select("doc_id", "page", text.clean_text(F.col("text")).alias("clean"))


def published_dates(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.published_date(F.col("text"), F.col("published")).alias("published"))


def page_hints(spark, sf_dir):
    return table(spark, sf_dir, "doc_pages").select("doc_id", "page", units.page_unit_hint(F.col("text")).alias("hint"))


def ground_exact(spark, sf_dir):
    """Where quotes stand on their page character for character."""
    found = grounding.ground(table(spark, sf_dir, "evidence").select("evidence_id", "doc_id", "page", "quote"), table(spark, sf_dir, "doc_pages"), fuzzy=False)
    hit = F.col("how") == "exact"
    return found.select("evidence_id", F.when(hit, F.col("char_start")).alias("char_start"), F.when(hit, F.col("char_end")).alias("char_end"))


def ground_fuzzy(spark, sf_dir):
    found = grounding.ground(table(spark, sf_dir, "evidence").select("evidence_id", "doc_id", "page", "quote"), table(spark, sf_dir, "doc_pages"))
    return found.select("evidence_id", "char_start", "char_end", "ratio", "how")


def contains_value(spark, sf_dir):
    e = table(spark, sf_dir, "evidence").where("fact_id is not null").select("evidence_id", F.col("fact_id").alias("id"), "quote")
    f = table(spark, sf_dir, "facts").groupBy("id").agg(F.max_by("quantity.raw", "extracted_at").alias("raw"))
    return e.join(f, "id").select("evidence_id", text.contains_value(F.col("quote"), F.col("raw")).alias("held"))


def ground_blanks(spark, sf_dir):
    """How each quote is found on its page without the fuzzy search: as it is, or with other blanks."""
    found = grounding.ground(table(spark, sf_dir, "evidence").select("evidence_id", "doc_id", "page", "quote"), table(spark, sf_dir, "doc_pages"), fuzzy=False)
    return found.select("evidence_id", "how", "ratio")


def _claims(spark, sf_dir):
    """Claims as an extractor would answer, from the facts and their evidence, as JSON per page, with the page's hints."""
    f = table(spark, sf_dir, "facts").groupBy("id").agg(F.max_by(F.struct("fact_type", "entity", "measure_raw", F.col("quantity.raw").alias("raw"), "value_text", F.col("period.raw").alias("period"), "basis", "estimate_type", "confidence"), "extracted_at").alias("f"))
    e = table(spark, sf_dir, "evidence").select(F.col("fact_id").alias("id"), "doc_id", "page", "quote", "evidence_id")
    c = F.struct(F.col("f.fact_type").alias("fact_type"), F.col("f.entity").alias("subject"), F.col("f.measure_raw").alias("measure"), F.col("f.raw").alias("value_raw"), F.col("f.value_text").alias("value_text"), F.col("f.period").alias("period"), F.col("f.basis").alias("basis"), F.col("f.estimate_type").alias("estimate_type"), F.col("quote").alias("quote"), F.col("page").cast("string").alias("page"), F.col("f.confidence").cast("string").alias("confidence"))
    per_page = e.join(f, "id").groupBy("doc_id", "page").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("evidence_id", c.alias("c")))), lambda x: x["c"])).alias("payload"))
    hints = table(spark, sf_dir, "doc_pages").select("doc_id", "page", "magnitude_hint", "unit_hint")
    return per_page.join(hints, ["doc_id", "page"], "left").select("doc_id", F.array("page").alias("pages"), "payload", "magnitude_hint", "unit_hint")


def _documents(spark, sf_dir):
    sources = table(spark, sf_dir, "sources").select("source", "fy_end_month", F.col("publisher").alias("principal_entity"))
    return table(spark, sf_dir, "documents").join(sources, "source", "left").select("doc_id", "principal_entity", "published", "fy_end_month")


def _checked(spark, sf_dir, fuzzy=True):
    return materialise(claims.check_claims(claims.explode_claims(_claims(spark, sf_dir)), table(spark, sf_dir, "doc_pages"), _documents(spark, sf_dir), fuzzy=fuzzy), "checked")[0]


def claims_validate(spark, sf_dir):
    """Every claim with its rejection, grounded as it is or with other blanks; SQL cannot follow the fuzzy search."""
    return _checked(spark, sf_dir, fuzzy=False).select("uid", "failure", "fact_type", "measure_raw", "entity", "estimate_type", "confidence", "page", "match_method", "as_of", "scale_note_applied")


def claims_facts(spark, sf_dir):
    facts = claims.accepted_facts(_checked(spark, sf_dir, fuzzy=False))
    return facts.select("doc_id", "page", "measure_raw", "entity_key", F.col("quantity.kind").alias("kind"), F.col("quantity.canonical_unit").alias("unit"), F.col("quantity.canonical_value").alias("value"), F.col("period.label").alias("period"), F.array_join("basis", ",").alias("basis"), F.regexp_replace("quote", r"(?U)\s+", " ").alias("quote"), "confidence")


def failure_summary(spark, sf_dir):
    from ..operators.views import failure_summary as summary

    return summary(claims.failures(_checked(spark, sf_dir, fuzzy=False)))


def claims_fuzzy(spark, sf_dir):
    """``claims_validate`` with the fuzzy search, as the stream runs it."""
    return _checked(spark, sf_dir).select("uid", "failure", "match_method", "match_score", "confidence", "page")


def claims_on_other_pages(spark, sf_dir):
    """The page on which each quote is found when a unit holds all pages of its document: the reported one, else the first that has it."""
    every = table(spark, sf_dir, "doc_pages").groupBy("doc_id").agg(F.array_sort(F.collect_list("page")).alias("pages"))
    quotes = table(spark, sf_dir, "evidence").select("doc_id", F.to_json(F.array(F.struct("quote", F.col("page").cast("string").alias("page"), F.col("evidence_id").cast("string").alias("measure")))).alias("payload"))
    units = quotes.join(every, "doc_id")
    checked = claims.check_claims(claims.explode_claims(units).withColumn("seq", F.col("claim.measure").cast("bigint")), table(spark, sf_dir, "doc_pages"), _documents(spark, sf_dir), fuzzy=False)
    return checked.select(F.col("measure_raw").cast("bigint").alias("evidence_id"), F.when(F.col("match_method").isNotNull() & (F.col("failure") == "missing_subject"), F.lit("hit")).otherwise(F.coalesce("failure", F.lit("hit"))).alias("outcome"), "char_start")


def json_loose(spark, sf_dir):
    """Answers as models write them (fenced, with prose and trailing commas), parsed back."""
    broken = _claims(spark, sf_dir).select("doc_id", "pages", F.concat(F.lit("Here are the facts:\n```json\n"), F.regexp_replace("payload", "\\]$", ",]"), F.lit("\n```")).alias("payload"))
    parsed = broken.withColumn("payload", loosejson.parse_json_loose(F.col("payload")))
    return parsed.select("doc_id", F.get("pages", F.lit(0)).alias("page"), F.size(F.from_json("payload", "array<string>")).alias("n"))


def relation_ids(spark, sf_dir):
    return table(spark, sf_dir, "relations").where("a_id is not null and b_id is not null").select(adj.relation_id(F.col("a_id"), F.col("b_id")).alias("id"), "a_id", "b_id").distinct()


def document_dedupe(spark, sf_dir):
    """Documents whose text no earlier id carries, by content hash."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
    return docs.groupBy("sha256").agg(F.min("doc_id").alias("doc_id"))


def documents_new(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.sha2("text", 256).alias("sha256")).where("sha256 is not null")
    return store.new_documents(docs, docs.where("lang = 'en'")).agg(F.count("*").alias("n"))


def period_overlaps(spark, sf_dir):
    """Pairs of sources' fiscal years of one year that overlap, by the closing months."""
    s = table(spark, sf_dir, "sources").select("fy_end_month").distinct()
    window = lambda m: periods.fiscal_year_window(F.lit(2024), m)
    pairs = s.withColumnRenamed("fy_end_month", "m1").join(s.withColumnRenamed("fy_end_month", "m2"), F.col("m1") < F.col("m2"))
    return pairs.select("m1", "m2", periods.overlaps(window(F.col("m1")), window(F.col("m2"))).alias("overlaps"), periods.same_window(window(F.col("m1")), window(F.col("m2"))).alias("same"))


_NAMES = (
    parse_number, plausible_grouping, scale_words, build_quantity, magnitude_hint, detect_currency, detect_percent, format_compact, singularise, fiscal_windows, parse_period, fy_end_vote, entity_keys, entity_initials, measure_tokens, token_frequency, measure_similarity, registry_batch, registry_exact, registry_names, block_offsets,
    block_kinds, density_score, running_heading, pack_batches, pack_units, unit_stats, budget_cap, clean_text, published_dates, page_hints, ground_exact, ground_blanks, ground_fuzzy, contains_value, claims_validate, claims_facts, claims_fuzzy, failure_summary, json_loose, relation_ids, document_dedupe, documents_new, period_overlaps,
)
QUERIES = {f.__name__: f for f in _NAMES}

_RAWS = "raws as (select distinct quantity.raw as raw from facts where quantity.raw is not null)"


_plausible = w.plausible
_SCALE_MAP = w.SCALE_MAP
_BLOCKS = r"""blocks as (
    select doc_id, page, u.i - 1 as idx, u.t as text from (
        select doc_id, page, unnest(list_transform(list_filter(regexp_split_to_array(text, '\n[ \t]*\n[ \t\n\x0b\f\r]*'), lambda b: trim(b, ' ') <> ''), lambda t, i: {'t': t, 'i': i})) as u from doc_pages where text is not null))"""
_STOPS = w.STOPWORDS
_SINGULAR = """case when {x} = 'indices' then 'index' when {x} = 'analyses' then 'analysis' when length({x}) <= 3 then {x} when {x} like '%ies' then regexp_replace({x}, 'ies$', 'y')
    when regexp_matches({x}, '(?:ses|xes)$') then regexp_replace({x}, 'es$', '') when regexp_matches({x}, '[^s]s$') then regexp_replace({x}, 's$', '') else {x} end"""
_TOKENS = "list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(lower(strip_accents(replace(measure_raw, '²', '2'))), '([a-z0-9]+)', 1), lambda w: " + _SINGULAR.format(x="w") + f"), lambda w: w not in ({_STOPS}))))"
_MARKS, _POINT = w.MARKERS, w.POINTING
_ALIKE = f"""m0 as (select {_TOKENS} t, coalesce(quantity.kind, 'other') kind from facts where measure_raw is not null), m1 as (select t, kind, count(*) n from m0 where len(t) > 0 group by all),
        obs as (select sum(n) as o from m1), d as (select token, sum(n) df from (select unnest(t) token, n from m1) group by 1), wt as (select token, greatest(0.15, ln((o + 1)::double / (df + 1)::double) + 1) w from d, obs),
        m as (select array_to_string(t, '_') s, t, list_sort(list_filter(t, lambda x: x in ({_MARKS}))) k, (select sum(w) from wt where list_contains(t, token)) mass from (select distinct t from m1)),
        p as (select a.s a, b.s b, a.mass ma, b.mass mb, (select sum(w) from wt where list_contains(a.t, token) and list_contains(b.t, token)) sh from m a join m b on a.s < b.s and a.k = b.k and list_has_any(a.t, b.t)),
        q as (select a, b, greatest(sh / (ma + mb - sh), 0.85 * sh / least(ma, mb)) v from p), k as (select distinct array_to_string(t, '_') s, kind from m1),
        alike as (select a, x.kind kind_a, b, y.kind kind_b, v from q join k x on x.s = a join k y on y.s = b where v >= 0.68 and (x.kind = y.kind or 'other' in (x.kind, y.kind))
            union all select x.s, x.kind, x.s, y.kind, 1.0::double from k x join k y on x.s = y.s and x.kind < y.kind where 'other' in (x.kind, y.kind))"""
SQL = {
    "parse_number": f"with {_RAWS}, {w.numbers('raws')} select raw, v as value, coalesce(v is not null and hedged, false) as approximate from numbers",
    "plausible_grouping": f"with {_RAWS}, b as (select raw, regexp_extract(raw, '([0-9][0-9,.]*)', 1) as body from raws) select raw, body, {_plausible('body')} as plausible from b where body <> ''",
    "scale_words": f"with {_RAWS} select raw, {_SCALE_MAP}[lower(regexp_extract(raw, '([A-Za-z]+)[.]?$', 1))] as scale from raws",
    "magnitude_hint": f"with h as (select distinct header from facts where header is not null) select header, {w.magnitude('header')} as magnitude from h",
    "detect_percent": rf"""with {_RAWS}, a as (select raw, ltrim(lower(left(regexp_extract(raw, '[0-9]([^0-9]*)$', 1), 24)), ' ') s from raws)
        select raw, case when regexp_matches(s, '^(?:%|per\s*cent|percent|percentage point)') then 'percent' when regexp_matches(s, '^(?:bps\b|basis points?)') then 'basis_points' end as unit from a""",
    "singularise": f"""with w as (select distinct unnest(regexp_extract_all(lower(measure_raw), '([a-z]+)', 1)) as word from facts)
        select word, case when length(word) > 4 and word like '%ies' then regexp_replace(word, 'ies$', 'y') when regexp_matches(word, '(?:ses|xes)$') then regexp_replace(word, 'es$', '') when regexp_matches(word, '[^s]s$') then regexp_replace(word, 's$', '') else word end as noun,
            {_SINGULAR.format(x="word")} as token from w""",
    "fiscal_windows": """with r as (select distinct year(published)::int y, fy_end_month, quarter(published)::int q from documents join sources using (source) where published is not null),
        s as (select *, (make_date(y, fy_end_month, 1) - interval 11 month)::date f, make_date(y, (q - 1) * 3 + 1, 1) c from r)
        select y, fy_end_month, q, f as fy_start, last_day(make_date(y, fy_end_month, 1)) as fy_end, (f + to_months((q - 1) * 3))::date as q_start, last_day((f + to_months(q * 3 - 1))::date) as q_end,
            (f + to_months(((q + 1) // 2 - 1) * 6))::date as h_start, last_day((f + to_months((q + 1) // 2 * 6 - 1))::date) as h_end, c as c_start, last_day((c + interval 2 month)::date) as c_end, (last_day(make_date(y, fy_end_month, 1)) - f + 1)::int as fy_days from s""",
    "entity_keys": f"with names as (select distinct entity from facts where entity is not null), {w.entity_keys('names')} select entity, key, lower(trim(entity, ' ')) in ({_POINT}) as pointing from entity_keys",
    "entity_initials": "with e as (select distinct entity_key from facts where entity_key <> '') select entity_key, array_to_string(list_concat(list_transform(string_split(entity_key, ' ')[:-2], lambda x: x[1]), string_split(entity_key, ' ')[-1:]), ' ') as initials from e",
    "measure_tokens": f"with m as (select distinct measure_raw from facts where measure_raw is not null), t as (select measure_raw, {_TOKENS} t from m) select measure_raw, array_to_string(t, ' ') as tokens, array_to_string(list_sort(list_filter(t, lambda x: x in ({_MARKS}))), ' ') as markers, case when len(t) > 0 then array_to_string(t, '_') else 'unnamed' end as slug from t",
    "token_frequency": f"with t as (select unnest({_TOKENS}) as token from facts where measure_raw is not null) select token, count(*) as df from t group by 1",
    "measure_similarity": f"with recursive {_ALIKE} select a, kind_a, b, kind_b, round(v, 6) as similarity from alike",
    # Groups of one kind first; a group without a kind then joins the likest group of another kind.
    "registry_batch": f"""with recursive {_ALIKE}, nodes as (select measure_raw, coalesce(quantity.kind, 'other') kind, case when len({_TOKENS}) > 0 then array_to_string({_TOKENS}, '_') else 'unnamed' end s, count(*) n from facts where measure_raw is not null group by all
            union all select null, coalesce(quantity.kind, 'other'), 'unnamed', count(*) from facts where measure_raw is null group by all),
        ids as (select distinct s || chr(31) || kind as node from nodes), e as (select a || chr(31) || kind_a x, b || chr(31) || kind_b y, v from alike where kind_a = kind_b),
        reach as (select node, node as other from ids union select r.node, case when e.x = r.other then e.y else e.x end from reach r join e on r.other in (e.x, e.y)),
        labels as (select node, min(other) as label from reach group by 1), weight as (select label, sum(n) n from nodes join labels on node = s || chr(31) || kind group by 1),
        across as (select case when kind_a = 'other' then a || chr(31) || kind_a else b || chr(31) || kind_b end node, case when kind_a = 'other' then b || chr(31) || kind_b else a || chr(31) || kind_a end other, v from alike where kind_a <> kind_b),
        placed as (select l.label, t.label target, v, w.n from across join labels l using (node) join labels t on t.node = across.other join weight w on w.label = t.label),
        best as (select label, arg_min(target, (-round(v, 9), -n, target)) target from placed group by 1),
        final as (select node, coalesce(target, label) as label from labels left join best using (label)), uses as (select split_part(label, chr(31), 1) s, count(distinct label) u from final group by 1)
        select measure_raw, kind, 'm_' || u.s || case when u > 1 then '_' || split_part(f.label, chr(31), 2) else '' end as measure_key from nodes n join final f on f.node = n.s || chr(31) || n.kind join uses u on u.s = split_part(f.label, chr(31), 1)""",
    "block_offsets": f"with {_BLOCKS}, o as (select *, (coalesce(sum(length(text) + 1) over (partition by doc_id, page order by idx rows between unbounded preceding and 1 preceding), 0))::int as char_start from blocks) select doc_id, page, idx::int as idx, char_start, (char_start + length(text))::int as char_end from o",
    "density_score": f"with {_BLOCKS} select doc_id, page, idx::int as idx, {w.density('text')} as density from blocks",
    "clean_text": f"select doc_id, page, {w.clean('text')} as clean from doc_pages",
    "ground_exact": f"select e.evidence_id, case when pos > 0 then (pos - 1)::int end as char_start, case when pos > 0 then (pos - 1 + length(q))::int end as char_end from (select e.evidence_id, {w.trimmed('e.quote')} q, case when length({w.trimmed('e.quote')}) >= 8 then strpos(p.text, {w.trimmed('e.quote')}) else 0 end as pos from evidence e left join doc_pages p on e.doc_id = p.doc_id and e.page = p.page) e",
    "contains_value": r"with f as (select id, arg_max(quantity.raw, extracted_at) raw from facts group by 1), d as (select evidence_id, regexp_replace(coalesce(quote, ''), '[^0-9]', '', 'g') q, regexp_replace(coalesce(raw, ''), '[^0-9]', '', 'g') r from evidence join f on fact_id = id) select evidence_id, r = '' or contains(q, r) as held from d",
    "relation_ids": "select distinct 'r_' || substr(sha1(least(a_id, b_id) || '|' || greatest(a_id, b_id)), 1, 16) as id, a_id, b_id from relations where a_id is not null and b_id is not null",
    "document_dedupe": "select sha256(text) as sha256, min(doc_id) as doc_id from documents group by 1",
    "documents_new": "select count(distinct text) as n from documents where text is not null and text not in (select text from documents where lang = 'en' and text is not null)",
    "period_overlaps": """with s as (select distinct fy_end_month m, (make_date(2024, fy_end_month, 1) - interval 11 month)::date f, last_day(make_date(2024, fy_end_month, 1)) t from sources)
        select a.m as m1, b.m as m2, a.f <= b.t and b.f <= a.t as overlaps, a.f = b.f and a.t = b.t as same from s a join s b on a.m < b.m""",
    "budget_cap": f"""with {_BLOCKS}, p as (select doc_id, page as batch, max({w.density('text')}) density from blocks group by 1, 2)
        select doc_id, batch, row_number() over (partition by doc_id order by density desc, batch) as rank from p qualify rank <= 2""",
}

SQL |= {
    "detect_currency": f"with {_RAWS} select raw, {w.currency('right(raw, 40)', -1)} as currency from raws",
    "json_loose": "select doc_id, page, count(*)::int as n from evidence join (select distinct id from facts) f on fact_id = f.id group by 1, 2",
    "block_kinds": f"with {_BLOCKS} select case when {w.heading('text')} then 'heading' when {w.tabular('text')} then 'table' else 'prose' end as kind, count(*) as n from blocks group by 1",
    "unit_stats": rf"""with {_BLOCKS},
        p as (select doc_id, page, max({w.density('text')}) density, (sum(length(text) + 1) - 1)::bigint chars from blocks group by 1, 2),
        o as (select *, row_number() over (partition by doc_id order by page) i from p where density >= 0.12),
        b as (with recursive walk as (
            select doc_id, i, chars, density, chars as size, 1 as pages, 0 as batch from o where i = 1
            union all
            select o.doc_id, o.i, o.chars, o.density, case when w.size + o.chars > 16000 or w.pages >= 10 then o.chars else w.size + o.chars end, case when w.size + o.chars > 16000 or w.pages >= 10 then 1 else w.pages + 1 end,
                case when w.size + o.chars > 16000 or w.pages >= 10 then w.batch + 1 else w.batch end from walk w join o on o.doc_id = w.doc_id and o.i = w.i + 1)
            select doc_id, batch, sum(chars) chars, max(density) density from walk group by 1, 2)
        select count(*) as n_units, sum(chars)::bigint as n_chars, round(avg(chars), 1) as mean_chars, round(avg(density), 3) as mean_density from b""",
    "running_heading": f"""with {_BLOCKS}, h as (select *, case when {w.heading('text')} then {w.trimmed('text')} end head from blocks)
        select doc_id, page, idx::int as idx, coalesce(last_value(head ignore nulls) over (partition by doc_id, page order by idx rows between unbounded preceding and current row), '') as section from h""",
}

_VOTES = " union all ".join(f"select doc_id, {w.MONTH_MAP}[lower(unnest(regexp_extract_all(text, '{w.hint(pattern)}', 1)))] as m, {weight}::double as w from documents where text is not null" for pattern, weight in w.HINTS)
_PAGE_DENSITY = f"{_BLOCKS}, p as (select doc_id, page, max({w.density('text')}) density, (sum(length(text) + 1) - 1)::bigint chars from blocks group by 1, 2)"
SQL |= {
    "fy_end_vote": f"""with votes as ({_VOTES}), sums as (select doc_id, m, sum(w) s from votes group by 1, 2),
        best as (select doc_id, list(struct_pack(s := s, n := -m) order by s desc, -m desc) t from sums group by 1)
        select d.doc_id, case when t[1].s > 0 and t[1].s >= 1.25 * coalesce(t[2].s, 0) then -t[1].n end as month from documents d left join best using (doc_id)""",
    # Letters before a code are consumed and cut off again, because this engine's patterns cannot look behind.
    "page_hints": rf"select doc_id, page, nullif(regexp_replace(regexp_extract(text, '(?i)((?:^|[^a-z(\s])?\(?{w.BLANK}*(?:₹|\$|€|£|(?:^|[^a-z])(?:rs\.?|inr|usd)){w.BLANK}*(?:in{w.BLANK}+)?(?:hundred|thousand|lakhs?|millions?|crores?|billions?){w.BLANK}*\)?)', 1), 'x', 'x'), '') as hint from doc_pages",
    "pack_batches": f"""with {_PAGE_DENSITY}, o as (select *, row_number() over (partition by doc_id order by page) i from p),
        walk as (with recursive w as (
            select doc_id, i, page, chars, density, chars as size, 1 as n, 0 as batch from o where i = 1
            union all
            select o.doc_id, o.i, o.page, o.chars, o.density, case when w.size + o.chars > 1500 or w.n >= 10 then o.chars else w.size + o.chars end, case when w.size + o.chars > 1500 or w.n >= 10 then 1 else w.n + 1 end,
                case when w.size + o.chars > 1500 or w.n >= 10 then w.batch + 1 else w.batch end from w join o on o.doc_id = w.doc_id and o.i = w.i + 1) select * from w)
        select w.doc_id, batch, string_agg(w.page::varchar, ',' order by w.page) as pages, sum(chars)::bigint as chars, max(density) as density,
            case when count(distinct magnitude_hint) <= 1 and count(magnitude_hint) in (0, count(*)) then max(magnitude_hint) end as magnitude_hint,
            case when count(distinct unit_hint) <= 1 and count(unit_hint) in (0, count(*)) then max(unit_hint) end as unit_hint
        from walk w left join doc_pages d on w.doc_id = d.doc_id and w.page = d.page group by 1, 2""",
    "published_dates": rf"""with f as (select doc_id, published, list_zip(regexp_extract_all(t, '{w.DATE}', 1), regexp_extract_all(t, '{w.DATE}', 2), regexp_extract_all(t, '{w.DATE}', 3), regexp_extract_all(t, '{w.DATE}', 4)) h from (select doc_id, published, left(text, 4000) t from documents))
        select doc_id, coalesce(list_max(list_transform(h, lambda x: try_cast(format('{{:04d}}-{{:02d}}-{{:02d}}', x[4]::int, {w.MONTH_MAP}[lower(x[2])], least(28, coalesce(nullif(x[1], ''), nullif(x[3], ''), '1')::int)) as date))), published) as published from f""",
    "parse_period": f"""with src as (select distinct period.raw as raw, fy_end_month from facts join documents using (doc_id) join sources using (source) where period.raw is not null and fy_end_month is not null), {w.periods('src')}
        select s.raw, s.fy_end_month, p_kind as kind, p_start as start, p_end as "end", p_label as label from src s left join read r on s.raw = r.raw and s.fy_end_month = r.fy_end_month""",
    "format_compact": f"select id, extracted_at, {w.compact('canonical_value')} as short from facts where canonical_value is not null",
    "build_quantity": f"""with src as (select distinct quantity.raw as raw, header as unit_hint, {w.magnitude('header')} as magnitude_hint from facts where quantity.raw is not null), {w.quantities('src')}
        select raw, unit_hint as header, kind, canonical_unit, canonical_value, magnitude, approximate from quantities""",
    "ground_blanks": f"""with g as ({w.GROUNDED}) select evidence_id, how, case how when 'exact' then 1.0::double when 'whitespace' then 0.99::double end as ratio from g""",
}
# Blocks without headings walked in order; a unit ends before the block that would make it too long, and its last block is carried on.
_UNITS = f"""{_BLOCKS}, o as (select doc_id, page, {{'idx': idx, 'chars': length(text), 'density': {w.density('text')}}} x, row_number() over (partition by doc_id, page order by idx) i, count(*) over (partition by doc_id, page) n from blocks where not {w.heading('text')}),
    walk as (select doc_id, page, i, n, [x] cur, [x][:0] done from o where i = 1
        union all select o.doc_id, o.page, o.i, o.n, case when list_sum(list_transform(w.cur, lambda b: b.chars)) + x.chars > 600 then list_concat(w.cur[-1:], [x]) else list_append(w.cur, x) end,
            case when list_sum(list_transform(w.cur, lambda b: b.chars)) + x.chars > 600 then w.cur else w.cur[:0] end from walk w join o on o.doc_id = w.doc_id and o.page = w.page and o.i = w.i + 1),
    ended as (select doc_id, page, i, 0 z, done u from walk where len(done) > 0 union all select doc_id, page, i, 1, cur from walk where i = n),
    units as (select doc_id, page, row_number() over (partition by doc_id order by page, i, z) - 1 as unit, u from ended)"""
_CHECKED = f"""f as (select * from facts qualify row_number() over (partition by id order by extracted_at desc) = 1), g as ({w.GROUNDED}),
    c0 as (select g.evidence_id, g.doc_id, g.page, g.q, g.how, row_number() over (partition by g.doc_id, g.page order by g.evidence_id) - 1 as seq, f.*exclude (id, doc_id, page, canonical_value, canonical_unit), p.magnitude_hint, p.unit_hint, d.published, s.publisher, coalesce(s.fy_end_month, 3) fy
        from g join f on g.fact_id = f.id left join doc_pages p on p.doc_id = g.doc_id and p.page = g.page left join documents d on d.doc_id = g.doc_id left join sources s on s.source = d.source),
    c as (select *, nullif({w.trimmed('measure_raw')}, '') m, nullif({w.trimmed('entity')}, '') subject, nullif({w.trimmed('quantity.raw')}, '') raw, nullif({w.trimmed('value_text')}, '') vt from c0),
    src as (select distinct raw, unit_hint, magnitude_hint from c where raw is not null), {w.quantities('src')},
    who as (select *, case when subject is null or lower(trim(subject, ' ')) in ({_POINT}) then coalesce(nullif({w.trimmed('publisher')}, ''), subject) else subject end who from c),
    checked as (select who.doc_id || '/' || who.page || '/' || seq as uid, who.*, q.kind, q.canonical_unit, q.canonical_value, q.magnitude, q.v,
        case when q is null then 'missing_quote' when how is null then 'ungrounded_quote' when m is null then 'missing_measure' when who is null then 'missing_subject'
             when who.raw is not null and regexp_replace(who.raw, '[^0-9]', '', 'g') <> '' and not contains(regexp_replace(who.q, '[^0-9]', '', 'g'), regexp_replace(who.raw, '[^0-9]', '', 'g')) then 'value_not_in_quote'
             when who.raw is not null and q.v is null then 'unparseable_value' when who.raw is null and vt is null then 'empty_value' end as failure,
        case when lower(fact_type) in ('numeric', 'state', 'event', 'attribute') then lower(fact_type) else 'numeric' end ft,
        case when lower(estimate_type) in ('actual', 'provisional', 'revised', 'advance_estimate', 'projection', 'target', 'unknown') then lower(estimate_type) else 'unknown' end est,
        round_even(least(1.0::double, greatest(0.0::double, coalesce(who.confidence, 0.6::double))), 3) conf
        from who left join quantities q on q.raw = who.raw and q.unit_hint is not distinct from who.unit_hint and q.magnitude_hint is not distinct from who.magnitude_hint)"""
SQL["pack_units"] = f"with recursive {_UNITS} select doc_id, page, unit::int as unit, array_to_string(list_transform(u, lambda b: b.idx), ',') as idxs, list_max(list_transform(u, lambda b: b.density)) as density from units"
SQL |= {
    "claims_validate": f"""with {_CHECKED} select uid, failure, ft as fact_type, m as measure_raw, who as entity, est as estimate_type, conf as confidence, page, how as match_method, published as as_of,
        coalesce(magnitude_hint <> 0 and magnitude = magnitude_hint, false) as scale_note_applied from checked""",
    "failure_summary": f"with {_CHECKED} select failure as kind, count(*) as n from checked where failure is not null group by 1",
    "claims_facts": f"""with {_CHECKED}, said as (select distinct period.raw as raw, fy as fy_end_month from c where period.raw is not null), {w.periods('said')},
        names as (select distinct who as entity from checked where who is not null), {w.entity_keys('names')},
        ok as (select k.*, p_raw, p_label, e.key, list_sort(list_distinct(list_transform(list_filter(coalesce(basis, []), lambda x: {w.trimmed('x')} <> ''), lambda x: regexp_replace(lower({w.trimmed('x')}), '^[ .;]+|[ .;]+$', '', 'g')))) bs
            from checked k left join read r on r.raw = k.period.raw and r.fy_end_month = k.fy left join entity_keys e on e.entity = who where failure is null)
        select doc_id, page, m as measure_raw, key as entity_key, kind, canonical_unit as unit, canonical_value as value, p_label as period, array_to_string(bs, ',') as basis, regexp_replace(q, '{w.BLANK}+', ' ', 'g') as quote, conf as confidence
        from ok qualify row_number() over (partition by doc_id, page, lower(trim(m, ' ')), lower(trim(who, ' ')), coalesce(p_raw, ''), v, coalesce(raw, vt, ''), array_to_string(bs, ',') order by conf desc nulls last, seq) = 1""",
}
