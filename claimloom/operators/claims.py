"""Raw claims to facts: ordered checks, grounding, normalisation; rejected claims are rows too."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.entities import entity_key, is_pointing
from ..functions.periods import period_or_unknown
from ..functions.text import contains_value
from ..functions.units import build_quantity
from ..session import strip_blanks
from .grounding import ground

FACT_TYPES = ["numeric", "state", "event", "attribute"]
ESTIMATE_TYPES = ["actual", "provisional", "revised", "advance_estimate", "projection", "target", "unknown"]
#: Kinds of rejection, in the order of the checks.
FAILURES = ["malformed_item", "missing_quote", "ungrounded_quote", "missing_measure", "missing_subject", "value_not_in_quote", "unparseable_value", "empty_value", "llm_call_failed", "unexpected_shape", "no_llm_backend"]

# What a claim object may hold. ``basis`` may be one text or a list, figures may be numbers or texts.
CLAIM = "struct<fact_type:string,subject:string,measure:string,value_raw:string,value_text:string,period:string,basis:string,estimate_type:string,attributed_to:string,quote:string,page:string,confidence:string>"
#: Optional columns of a unit and their types: absent ones count as null.
UNIT_CONTEXT = {"magnitude_hint": "double", "unit_hint": "string", "section": "string", "error": "string"}


def blank_to_null(c: Column) -> Column:
    plain = strip_blanks(c)
    return F.when(plain != "", plain)


def as_list(value: Column) -> Column:
    """A JSON list of texts, or a lone text as a list of one; null gives an empty list."""
    listed = F.when(F.ltrim(value).startswith("["), F.from_json(value, "array<string>")).otherwise(F.array(value))
    return F.coalesce(F.when(value.isNotNull(), listed), F.array().cast("array<string>"))


def basis_of(values: Column) -> Column:
    """Qualifiers lower-cased, without outer blanks, points and semicolons, distinct and in order; blank ones are left out."""
    trimmed = F.transform(F.filter(F.coalesce(values, F.array().cast("array<string>")), lambda v: blank_to_null(v).isNotNull()), lambda v: F.regexp_replace(F.lower(strip_blanks(v)), r"^[ .;]+|[ .;]+$", ""))
    return F.array_sort(F.array_distinct(trimmed))


def page_in_unit(page: Column, pages: Column) -> Column:
    """The reported page where the unit has it, else the unit's first page."""
    said = page.try_cast("int")
    return F.when(F.array_contains(pages, said), said).otherwise(F.get(pages, F.lit(0)))


def fact_id(doc: Column, page: Column, measure: Column, entity: Column, period: Column, value: Column, raw: Column, basis: Column) -> Column:
    """Content address of a fact. The printed value is hashed with the raw text, so 5 Mn and 5 Bn differ."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.concat(F.lit("f_"), F.substring(F.sha1(F.concat_ws("|", text(doc), text(page), F.lower(F.trim(text(measure))), F.lower(F.trim(text(entity))), text(period), text(value), text(raw), F.array_join(basis, ","))), 1, 16))


def explode_claims(units: DataFrame, payload: str = "payload") -> DataFrame:
    """One row per claim of a unit, ``seq, item, claim``, and one with a ``broken`` reason where an answer has none.

    An answer is a JSON list, or an object whose ``facts`` is one; an object without ``facts`` and an empty list hold no
    claims. No answer with an ``error`` is a failed call; any other shape is unexpected.
    """
    for name, kind in UNIT_CONTEXT.items():
        if name not in units.columns:
            units = units.withColumn(name, F.lit(None).cast(kind))
    body = F.ltrim(F.col(payload))
    clean = F.try_parse_json(F.col(payload)).isNotNull()
    inside = F.get_json_object(payload, "$.facts")
    items = F.when(clean & body.startswith("["), F.from_json(payload, "array<string>")).when(clean & body.startswith("{"), F.when(inside.isNull(), F.array().cast("array<string>")).when(F.ltrim(inside).startswith("["), F.from_json(inside, "array<string>")))
    broken = F.when(F.col(payload).isNull() & F.col("error").isNotNull(), "llm_call_failed").when(items.isNull(), "unexpected_shape")
    entry = lambda reason, item: F.struct(reason.cast("string").alias("broken"), item.cast("string").alias("item"))
    entries = F.when(broken.isNotNull(), F.array(entry(broken, F.coalesce(F.col("error"), F.col(payload))))).otherwise(F.transform(items, lambda x: entry(F.lit(None), x)))
    rows = units.select("*", F.posexplode(entries).alias("seq", "e")).select("*", "e.broken", "e.item").drop("e")
    return rows.withColumn("claim", F.when(F.col("broken").isNull() & F.ltrim("item").startswith("{"), F.from_json("item", CLAIM)))


def check_claims(claims: DataFrame, pages: DataFrame, documents: DataFrame, strict: bool = False, fuzzy: bool = True) -> DataFrame:
    """Every claim with ``failure`` (null where accepted), its normalised fields and its evidence.

    ``claims``: rows of ``explode_claims``. ``documents``: doc_id, principal_entity, published, fy_end_month. A quote is
    looked for on the reported page, then on the other pages of its unit in order; the first hit counts. The text found
    on the page, not the text claimed, is what must hold the value and what is kept as evidence. Scale and unit notes of
    the unit go into each quantity; ``scale_note_applied`` says where one gave the magnitude.
    """
    c = F.col("claim")
    rows = claims.withColumn("uid", F.concat_ws("/", "doc_id", F.array_join("pages", "-"), F.col("seq").cast("string")))
    first = rows.withColumn("reported", page_in_unit(strip_blanks(c["page"]), F.col("pages")))
    tried = first.select("uid", "doc_id", "reported", c["quote"].alias("quote"), F.posexplode("pages").alias("pos", "page")).where(blank_to_null(F.col("quote")).isNotNull())
    found = ground(tried, pages, fuzzy=fuzzy)
    order = Window.partitionBy("uid").orderBy((F.col("page") == F.col("reported")).desc(), "pos")
    best = found.where("how is not null").withColumn("rn", F.row_number().over(order)).where("rn = 1").select("uid", F.col("page").alias("hit_page"), "char_start", "char_end", "ratio", "how", "located")
    meta = documents.select("doc_id", "principal_entity", "published", "fy_end_month")
    j = first.join(best, "uid", "left").join(meta, "doc_id", "left")
    subject = blank_to_null(c["subject"])
    entity = F.when(subject.isNull() | is_pointing(subject), F.coalesce(blank_to_null(F.col("principal_entity")), subject)).otherwise(subject)
    said = lambda name: F.lower(blank_to_null(c[name]))
    raw = blank_to_null(c["value_raw"])
    q = build_quantity(raw, F.col("unit_hint"), F.col("magnitude_hint"), strict)
    period = period_or_unknown(c["period"], F.coalesce(F.col("fy_end_month"), F.lit(3)))
    j = j.withColumns(
        {"entity": entity, "fact_type": F.when(said("fact_type").isin(FACT_TYPES), said("fact_type")).otherwise("numeric"), "quantity": F.when(raw.isNotNull(), q), "period": period, "basis": basis_of(as_list(c["basis"])), "estimate_type": F.when(said("estimate_type").isin(ESTIMATE_TYPES), said("estimate_type")).otherwise("unknown")}
    )
    failure = (
        F.when(F.col("broken").isNotNull(), F.col("broken"))
        .when(c.isNull(), "malformed_item")
        .when(blank_to_null(c["quote"]).isNull(), "missing_quote")
        .when(F.col("how").isNull(), "ungrounded_quote")
        .when(blank_to_null(c["measure"]).isNull(), "missing_measure")
        .when(F.col("entity").isNull(), "missing_subject")
        .when(raw.isNotNull() & ~contains_value(F.col("located"), raw), "value_not_in_quote")
        .when(raw.isNotNull() & F.col("quantity").isNull(), "unparseable_value")
        .when(raw.isNull() & blank_to_null(c["value_text"]).isNull(), "empty_value")
    )
    sure = F.coalesce(c["confidence"].try_cast("double"), F.lit(0.6))
    conf = F.bround(F.least(F.lit(1.0), F.greatest(F.lit(0.0), sure)) * F.when(F.col("how") == "fuzzy", 0.85).otherwise(1.0), 3)
    hinted = F.coalesce((F.col("magnitude_hint") != 0) & (F.col("quantity.magnitude") == F.col("magnitude_hint")), F.lit(False))
    return j.select(
        "doc_id", "uid", "seq", failure.alias("failure"), "item", "fact_type", blank_to_null(c["measure"]).alias("measure_raw"), "entity", "quantity", blank_to_null(c["value_text"]).alias("value_text"), "period", "basis", "estimate_type",
        blank_to_null(c["attributed_to"]).alias("attributed_to"), F.col("published").alias("as_of"), F.when(failure.isNull(), F.col("hit_page")).otherwise(F.get("pages", F.lit(0))).alias("page"),
        strip_blanks(F.col("located")).alias("quote"), "char_start", "char_end", F.col("how").alias("match_method"), F.bround("ratio", 3).alias("match_score"), hinted.alias("scale_note_applied"), F.col("unit_hint").alias("scale_note"), "section", conf.alias("confidence"),
    )


def with_block(facts: DataFrame, blocks: DataFrame) -> DataFrame:
    """Facts with ``block_id`` and ``bbox`` of the block their quote begins in; null where no block holds it.

    ``blocks``: doc_id, page, block_id, char_start, char_end and, optionally, bbox. Blocks of one page do not overlap, so
    a fact keeps one row."""
    box = F.col("bbox") if "bbox" in blocks.columns else F.lit(None).cast("struct<x0:double,y0:double,x1:double,y1:double>")
    b = blocks.select(F.col("doc_id").alias("__d"), F.col("page").alias("__p"), F.col("char_start").alias("__s"), F.col("char_end").alias("__e"), "block_id", box.alias("bbox"))
    inside = (F.col("doc_id") == F.col("__d")) & (F.col("page") == F.col("__p")) & (F.col("char_start") >= F.col("__s")) & (F.col("char_start") <= F.col("__e"))
    return facts.join(b, inside, "left").drop("__d", "__p", "__s", "__e").dropDuplicates(["id"])


def accepted_facts(checked: DataFrame) -> DataFrame:
    """Facts of accepted claims with content-addressed ids and entity keys, one per id: the most confident, then first."""
    facts = checked.where("failure is null").drop("failure", "item")
    facts = facts.withColumns({"entity_key": entity_key(F.col("entity")), "id": fact_id(F.col("doc_id"), F.col("page"), F.col("measure_raw"), F.col("entity"), F.col("period.raw"), F.col("quantity.value"), F.coalesce(F.col("quantity.raw"), F.col("value_text")), F.col("basis"))})
    return dedupe_facts(facts)


def dedupe_facts(facts: DataFrame, order: str = "seq") -> DataFrame:
    """One fact per id: highest confidence, then first by ``order``."""
    return facts.withColumn("__rn", F.row_number().over(Window.partitionBy("id").orderBy(F.col("confidence").desc_nulls_last(), F.col(order)))).where("__rn = 1").drop("__rn")


#: What each kind of rejection means.
DETAILS = {
    "malformed_item": "the answer holds an element that is no object", "missing_quote": "no quote, so nothing to ground the claim on", "ungrounded_quote": "the quote stands on no page of its unit", "missing_measure": "no measure named",
    "missing_subject": "no subject, and the document has none to fall back on", "value_not_in_quote": "the value's digits are not in the text found on the page", "unparseable_value": "no number in the value", "empty_value": "neither a figure nor a text",
    "llm_call_failed": "the extractor's call failed", "unexpected_shape": "the answer is neither a list nor an object with a list of facts", "no_llm_backend": "no extractor is configured",
}


def _detail(kind: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in DETAILS.items() for x in pair]), kind)


def failures(checked: DataFrame) -> DataFrame:
    """Rejected claims: ``id, doc_id, page, stage, kind, detail, sample``; samples hold 400 characters at most."""
    bad = checked.where("failure is not null")
    i = F.row_number().over(Window.partitionBy("doc_id", "page", "failure").orderBy("uid")) - 1
    return bad.select(F.concat_ws("_", F.lit("x"), F.col("doc_id").cast("string"), F.col("page").cast("string"), "failure", i.cast("string")).alias("id"), "doc_id", "page", F.lit("extract").alias("stage"), F.col("failure").alias("kind"), _detail(F.col("failure")).alias("detail"), F.substring(F.coalesce("item", F.lit("")), 1, 400).alias("sample"))


def without_extractor(documents: DataFrame) -> DataFrame:
    """The failure each document gets where no extractor is configured, in the columns of ``failures``."""
    kind = F.lit("no_llm_backend")
    return documents.select(F.concat_ws("_", F.lit("x"), F.col("doc_id").cast("string"), F.lit("0"), kind, F.lit("0")).alias("id"), "doc_id", F.lit(None).cast("int").alias("page"), F.lit("extract").alias("stage"), kind.alias("kind"), _detail(kind).alias("detail"), F.lit("").alias("sample")).dropDuplicates(["doc_id"])
