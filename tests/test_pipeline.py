"""Claims, registry, linking, store, layout and streaming on small made-up rows."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from claimloom.operators import claims, grounding, ingest, linking, registry, store
from claimloom.sources.files import Settings, cached_answers, landed_units, no_extractor, pages_of, pdf_files, read_env_file
from claimloom.streaming.ingest import start
from tests.test_adjudicate import FACTS, fact

PAGE = "Acme Limited reported revenue of ₹7,356 Cr in FY24. The board met  in March 2024 and appointed Mr. Rao as director. Freight carried on the eastern line stood at 1,234 for the year."


def claim(**kw):
    base = {"fact_type": "numeric", "subject": "Acme Limited", "measure": "revenue", "value_raw": "₹7,356 Cr", "value_text": None, "period": "FY24", "basis": ["Consolidated."], "estimate_type": "actual", "quote": "reported revenue of ₹7,356 Cr in FY24", "page": "1", "confidence": "0.9"}
    return base | kw


CLAIMS = [
    (claim(), None),
    (claim(quote=None), "missing_quote"),
    (claim(quote="not in the text at all anywhere"), "ungrounded_quote"),
    (claim(measure=" "), "missing_measure"),
    (claim(value_raw="9,999"), "value_not_in_quote"),
    (claim(value_raw=None), "empty_value"),
    (claim(value_raw="Cr"), "unparseable_value"),
    # The page says 1,234: a claim whose own quote says 9,999 is not grounded by it.
    (claim(quote="Freight carried on the eastern line stood at 9,999 for the year", value_raw="9,999"), "value_not_in_quote"),
    (claim(quote="Freight carried on the eastern line stood at 1,234 in the year", value_raw="1,234", fact_type="Numeric", estimate_type="ACTUAL", basis="Gross ;", attributed_to=" the board "), None),
    (claim(value_raw=None, value_text="Mr. Rao director", fact_type="state", quote="The board met in March 2024 and appointed", subject="the Company", page="7"), None),
]


def checked(spark):
    units = spark.createDataFrame([("d1", [1], json.dumps([c for c, _ in CLAIMS]))], "doc_id string, pages array<int>, payload string")
    pages = spark.createDataFrame([("d1", 1, PAGE)], "doc_id string, page int, text string")
    docs = spark.createDataFrame([("d1", "Acme Ltd", dt.date(2024, 5, 1), 3)], "doc_id string, principal_entity string, published date, fy_end_month int")
    return claims.check_claims(claims.explode_claims(units), pages, docs)


def test_claims(spark):
    got = checked(spark).orderBy("seq").collect()
    assert [r.failure for r in got] == [f for _, f in CLAIMS]
    assert got[0].quantity.canonical_value == pytest.approx(7.356e10) and got[0].basis == ["consolidated"] and got[0].period.label == "FY2024"
    assert got[9].entity == "Acme Ltd" and got[9].page == 1 and got[9].as_of == dt.date(2024, 5, 1) and got[9].quote == "The board met  in March 2024 and appointed"
    fuzzy = got[8]
    # What is kept as evidence is the page's own text; enumerations are read in any case.
    assert (fuzzy.quote, fuzzy.match_method, fuzzy.estimate_type, fuzzy.fact_type, fuzzy.basis, fuzzy.attributed_to) == ("Freight carried on the eastern line stood at 1,234 for the year"[:-1], "fuzzy", "actual", "numeric", ["gross"], "the board")
    assert fuzzy.confidence == 0.765 and PAGE[fuzzy.char_start : fuzzy.char_end] == fuzzy.quote
    facts = claims.accepted_facts(checked(spark))
    assert facts.count() == 3 and facts.select("entity_key").distinct().collect()[0][0] == "acme"
    assert {r.kind for r in claims.failures(checked(spark)).collect()} == {f for _, f in CLAIMS if f}


def test_answers_of_any_shape(spark):
    rows = [("a", [1], "3", None), ("b", [2], None, None), ("c", [3], '{"facts": [{"quote": "x"}]}', None), ("d", [4], '{"other": 1}', None), ("e", [5], "[]", None), ("f", [6], '[{"quote": "y"}, "text", 7, null]', None), ("g", [7], None, "timeout"), ("h", [8], '{"facts": 5}', None), ("i", [9], "prose", None)]
    units = spark.createDataFrame(rows, "doc_id string, pages array<int>, payload string, error string")
    got = claims.explode_claims(units).select("doc_id", "seq", "broken", "claim.quote", "item").orderBy("doc_id", "seq").collect()
    assert [(r.doc_id, r.broken, r.quote) for r in got] == [
        ("a", "unexpected_shape", None), ("b", "unexpected_shape", None), ("c", None, "x"), ("f", None, "y"), ("f", None, None), ("f", None, None), ("f", None, None), ("g", "llm_call_failed", None), ("h", "unexpected_shape", None), ("i", "unexpected_shape", None),
    ]
    pages = spark.createDataFrame([("a", 1, PAGE)], "doc_id string, page int, text string")
    docs = spark.createDataFrame([("a", "Acme Ltd", dt.date(2024, 5, 1), 3)], "doc_id string, principal_entity string, published date, fy_end_month int")
    failed = claims.failures(claims.check_claims(claims.explode_claims(units), pages, docs))
    assert {(r.kind, r.detail != "") for r in failed.collect()} == {(k, True) for k in ("unexpected_shape", "ungrounded_quote", "malformed_item", "llm_call_failed")}
    none = claims.without_extractor(docs)
    assert none.columns == failed.columns and [(r.kind, r.page) for r in none.collect()] == [("no_llm_backend", None)]


def test_page_notes_reach_the_quantity(spark):
    """A figure of a table headed in crores is in crores, and the fact says that the note gave the scale."""
    page = "Income (₹ in Crores) 2019\n\nSales of the yard 41.5 and costs of the yard ₹12 lakh"
    answer = [claim(quote="Sales of the yard 41.5", value_raw="41.5"), claim(quote="costs of the yard ₹12 lakh", value_raw="₹12 lakh")]
    units = spark.createDataFrame([("d", [1], json.dumps(answer), 1e7, "(₹ in Crores)", "Income")], "doc_id string, pages array<int>, payload string, magnitude_hint double, unit_hint string, section string")
    docs = spark.createDataFrame([("d", "Yard", None, 3)], "doc_id string, principal_entity string, published date, fy_end_month int")
    got = claims.check_claims(claims.explode_claims(units), spark.createDataFrame([("d", 1, page)], "doc_id string, page int, text string"), docs).orderBy("seq").collect()
    assert [(r.quantity.canonical_unit, r.quantity.canonical_value, r.scale_note_applied, r.section) for r in got] == [("INR", 4.15e8, True, "Income"), ("INR", 1.2e6, False, "Income")]
    blocks = spark.createDataFrame([("d", 1, "b0", 0, 25), ("d", 1, "b1", 27, 90)], "doc_id string, page int, block_id string, char_start int, char_end int")
    facts = claims.accepted_facts(claims.check_claims(claims.explode_claims(units), spark.createDataFrame([("d", 1, page)], "doc_id string, page int, text string"), docs))
    assert {r.block_id for r in claims.with_block(facts, blocks).collect()} == {"b1"}


def test_quotes():
    assert grounding.locate_quote(PAGE, "reported revenue")[2:] == (1.0, "exact")
    s, e, ratio, how = grounding.locate_quote(PAGE, "board met in   March")
    assert (how, ratio, PAGE[s:e]) == ("whitespace", 0.99, "board met  in March")
    s, e, ratio, how = grounding.locate_quote(PAGE, "appointed Mr. Rao as direktor")
    assert how == "fuzzy" and ratio >= 0.82 and PAGE[s:e] == "appointed Mr. Rao as director"
    for text in ("", " a", "a  b\n c ", "\n\nxy z"):
        kept = grounding.flat(text)
        assert [text[grounding.original_offset(text, i)] for i, c in enumerate(kept) if c != " "] == list(kept.replace(" ", ""))
    assert grounding.locate_quote(PAGE, "short") is None and grounding.locate_quote(None, PAGE) is None and grounding.locate_quote(PAGE, "completely different words here") is None


def test_registry_sequence_and_round_trip(spark):
    rows = [(f"f{i}", m, (None, None, None, None, "currency", None, None, None)) for i, m in enumerate(["Revenue from operations", "revenue from operation", "growth in revenue", "Total assets", ""])]
    facts = spark.createDataFrame(rows, "id string, measure_raw string, quantity struct<raw:string,value:double,unit:string,magnitude:double,kind:string,canonical_value:double,canonical_unit:string,approximate:boolean>")
    reg = registry.MeasureRegistry()
    keys = {r.id: r.measure_key for r in registry.assign_sequential(facts, reg, ["id"]).collect()}
    assert keys["f0"] == keys["f1"] and len({keys["f0"], keys["f2"], keys["f3"], keys["f4"]}) == 4
    again = registry.MeasureRegistry.from_dict(reg.to_dict())
    assert again.to_dict() == reg.to_dict() and reg.label_for("m_x") == "m_x" and reg.kind_for("m_x") == "other"
    long = registry.MeasureRegistry(threshold=2.0)
    long_tokens = [frozenset({"x" * 90}), frozenset({"x" * 90})]
    assert len({long.assign("x", "other", t) for t in long_tokens}) == 2
    with pytest.raises(ValueError):
        registry.assign_sequential(facts, reg, ["id"], max_rows=2)


def test_batch_registry_is_exact(spark):
    names = ["revenue operation", "revenue operation net", "growth revenue operation", "total asset", "asset total fixed", "profit", "profit tax after"]
    facts = spark.createDataFrame([(n,) for n in names for _ in range(3)], "measure_raw string")
    got = {(r.a, r.b) for r in registry.similar_names(facts).collect() if r.kind_a == r.kind_b == "other"}
    reg = registry.MeasureRegistry()
    from claimloom.functions.measures import tokenise_measure

    tokens = {r.measure_raw: frozenset(r.t) for r in facts.distinct().select("measure_raw", tokenise_measure(F.col("measure_raw")).alias("t")).collect()}
    reg.observations = len(names) * 3
    for t in tokens.values():
        reg.df.update({x: 3 for x in t})
    want = set()
    for a in tokens.values():
        for b in tokens.values():
            x, y = "_".join(sorted(a)), "_".join(sorted(b))
            if x < y and (a & registry._MARKERS) == (b & registry._MARKERS) and reg.similarity(a, b) >= 0.68:
                want.add((x, y))
    assert got == want
    assert registry.assign_batch(facts).count() == len(names)


def test_kinds_keep_measures_apart(spark):
    """A percentage and an amount of one name are two measures; one of unknown kind joins the likeliest, never ties both."""
    kinds = [*[("port dues paid", "currency")] * 3, ("port dues paid", "percent"), ("paid port dues", None), ("port dues paid fully", "percent"), ("berth count", None)]
    facts = spark.createDataFrame([(f"f{i}", m, (k,)) for i, (m, k) in enumerate(kinds)], "id string, measure_raw string, quantity struct<kind:string>")
    keys = {(r.measure_raw, r.kind): r.measure_key for r in registry.assign_batch(facts).collect()}
    assert keys["port dues paid", "currency"] != keys["port dues paid", "percent"] == keys["port dues paid fully", "percent"]
    assert keys["paid port dues", "other"] == keys["port dues paid", "currency"]
    assert keys["berth count", "other"] == "m_berth_count"
    chain = spark.createDataFrame([(f"n{i:03}", f"n{i + 1:03}") for i in range(200)], "x string, y string")
    nodes = spark.createDataFrame([(f"n{i:03}",) for i in range(201)] + [("z",)], "node string")
    assert {(r.node, r.label) for r in registry.smallest_of_groups(chain, nodes).collect()} == {(f"n{i:03}", "n000") for i in range(201)} | {("z", "z")}


def test_names_are_registered_once(spark):
    rows = [(i, "Revenue", "currency") for i in range(5)] + [(9, "Revenues", "currency")]
    facts = spark.createDataFrame([(f"f{i}", m, (k,)) for i, m, k in rows], "id string, measure_raw string, quantity struct<kind:string>")
    one, each = registry.MeasureRegistry(), registry.MeasureRegistry()
    keys = {r.id: r.measure_key for r in registry.assign_names(facts, one, ["id"]).collect()}
    assert keys == {r.id: r.measure_key for r in registry.assign_sequential(facts, each, ["id"]).collect()} and len(set(keys.values())) == 1
    assert one.to_dict() == each.to_dict() and one.observations == 6
    with pytest.raises(ValueError):
        registry.assign_names(facts, one, ["id"], max_names=1)


def facts_df(spark, rows):
    return spark.createDataFrame(rows, FACTS)


def test_linking(spark):
    rows = [fact("a"), fact("b"), fact("c", 7.2), fact("d", 9.0)]
    rows[3] = (*rows[3][:6], "other", *rows[3][7:])
    df = facts_df(spark, rows)
    full = linking.link(df)
    assert full.count() == 3
    assert linking.candidate_pairs(df, max_block=2).count() == 1
    assert linking.candidate_pairs(df, new_doc="d_c").count() == 2
    assert linking.candidate_pairs(df, cross_document_only=True).count() == 3
    first = full.limit(1)
    assert linking.link(df, existing=first.select("a_id", "b_id")).count() == 2
    assert linking.link(df, existing=full).count() == 0
    report = linking.link_report(df, first.select("a_id", "b_id")).first()
    assert (report.blocks_examined, report.pairs_considered, report.pairs_skipped_existing, report.relations_written) == (1, 3, 1, 2)
    # Incremental over each document in turn finds what one full run finds.
    union = {r.id for d in ("d_a", "d_b", "d_c", "d_d") for r in linking.link(df, new_doc=d).collect()}
    assert union == {r.id for r in full.collect()}
    assert linking.link(facts_df(spark, [])).count() == 0


def test_store(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/layer")
    docs = "id string, filename string, title string, publisher string, published date, n_pages int, sha256 string, status string, stats string"
    s.upsert_documents(spark.createDataFrame([("d1", "a.pdf", "Old", None, None, 1, "x", "new", None)], docs))
    s.upsert_documents(spark.createDataFrame([("d1", "b.pdf", "New", None, None, 2, "y", "done", None), ("d2", "c.pdf", "C", None, None, 1, "z", "new", None)], docs))
    got = {r.id: r for r in s.read("documents").collect()}
    assert (got["d1"].title, got["d1"].filename, got["d1"].sha256) == ("New", "a.pdf", "x") and len(got) == 2
    f = spark.createDataFrame([("f1", "d1", 1), ("f2", "d2", 1)], "id string, doc_id string, v int")
    assert s.add_facts(f) == 2 and s.add_facts(f.withColumn("v", F.lit(9))) == 2
    assert {r.v for r in s.read("facts").collect()} == {1}
    rel = "id string, a_id string, b_id string, type string, reason_code string, confidence double, explanation string, analysis string, adjudicator string, cross_document boolean"
    s.add_relations(spark.createDataFrame([("r1", "f1", "f2", "related", "x", 0.1, None, None, "deterministic", True)], rel))
    s.add_relations(spark.createDataFrame([("r1", "f9", "f2", "contradicts", "y", 0.2, None, None, "deterministic", False)], rel))
    r = s.read("relations").first()
    assert (r.type, r.a_id, r.cross_document) == ("contradicts", "f1", True)
    s.add_failures(spark.createDataFrame([("x1", "d1"), ("x2", "d2")], "id string, doc_id string"))
    s.delete_document("d1")
    assert [s.read(n).count() for n in ("documents", "facts", "relations", "failures")] == [1, 1, 0, 1]
    s.vacuum(1)
    assert s.read("facts").count() == 1 and s.document_by_sha("z").count() == 1


def layout(spark, spots, width=600.0):
    rows = [("d", 1, i, 0, float(x0), float(y0), float(x1), float(y0 + 10), f"t{i}", 10.0) for i, (x0, x1, y0) in enumerate(spots)]
    from claimloom.schemas import BLOCKS

    return spark.createDataFrame(rows, BLOCKS).withColumn("page_width", F.lit(width))


def test_reading_order(spark):
    two = [(310, 580, y) for y in (0, 20, 40, 60)] + [(20, 290, y) for y in (0, 20, 40, 60)]
    got = ingest.with_reading_order(layout(spark, two)).orderBy("read_idx").collect()
    assert [r.block_no for r in got] == [4, 5, 6, 7, 0, 1, 2, 3] and got[0].gutter == 300
    one = ingest.with_reading_order(layout(spark, [(20, 580, y) for y in range(80, 0, -10)])).orderBy("read_idx").collect()
    assert [r.block_no for r in one] == list(range(7, -1, -1)) and one[0].gutter is None
    banner = ingest.with_reading_order(layout(spark, [(20, 580, 0)] + [(310, 580, y) for y in (20, 40, 60)] + [(20, 290, y) for y in (20, 40, 60)])).orderBy("read_idx").collect()
    assert banner[0].block_no == 0
    assert pages_of(layout(spark, two)).first().text.startswith("t4\nt5")


def test_packing(spark):
    pages = spark.createDataFrame([("d", p, 600, 0.5) for p in range(1, 6)], "doc_id string, page int, chars int, density double")
    hints = spark.createDataFrame([("d", p, 1e6 if p < 4 else None, "₹") for p in range(1, 6)], "doc_id string, page int, magnitude_hint double, unit_hint string")
    got = ingest.pack_batches(pages, hints, 1300, 10).orderBy("batch").collect()
    assert [r.pages for r in got] == [[1, 2], [3, 4], [5]]
    assert [r.magnitude_hint for r in got] == [1e6, None, None] and {r.unit_hint for r in got} == {"₹"}
    assert [r.pages for r in ingest.pack_batches(pages, None, 10**6, 2).orderBy("batch").collect()] == [[1, 2], [3, 4], [5]]
    assert ingest.within_budget(got and ingest.pack_batches(pages, None, 10, 1), 2).count() == 2
    stats = ingest.unit_stats(ingest.pack_batches(pages)).first()
    assert (stats.n_units, stats.n_chars, stats.mean_density) == (1, 3000, 0.5)
    blocks = spark.createDataFrame([("d", 1, i, "x" * 400, "prose", 0.5) for i in range(4)], "doc_id string, page int, idx int, text string, kind string, density double")
    assert [r.idxs for r in ingest.pack_units(blocks, 900).orderBy("unit").collect()] == [[0, 1], [1, 2], [2, 3]]


def test_sources(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF a")
    (tmp_path / "b.txt").write_bytes(b"no")
    assert pdf_files(spark, f"file://{tmp_path}").select("id").first()[0].startswith("d_")
    assert Settings.from_env({"CLAIMLOOM_MAX_BLOCK": "7"}).max_block == 7
    (tmp_path / ".env").write_text("# x\nA=1\nB='2'\nA=3\n")
    assert read_env_file(str(tmp_path / ".env"), {"B": "9"}) == {"A": "1", "B": "9"}
    units = spark.createDataFrame([("d", 0, [1], "p"), ("d", 1, [2], "q")], "doc_id string, batch int, pages array<int>, prompt string")
    key = units.where("batch = 0").select(F.sha2(F.concat_ws("\x00", F.lit("m"), "prompt"), 256).alias("key"), F.lit("[]").alias("payload"))
    answers, fresh = cached_answers(units, key, "m", lambda u: u.select("doc_id", "batch", "pages", F.lit("[1]").alias("payload")))
    assert {(r.batch, r.payload) for r in answers.collect()} == {(0, "[]"), (1, "[1]")} and fresh.count() == 1
    assert no_extractor(units).count() == 0


def test_streaming_twice_is_the_same(spark, tmp_path):
    folder, root = tmp_path / "in", f"file://{tmp_path}/layer"
    folder.mkdir()
    pages = spark.createDataFrame([("d1", 1, PAGE), ("d2", 1, PAGE.replace("7,356", "7,360"))], "doc_id string, page int, text string")
    meta = spark.createDataFrame([(d, "Acme Ltd", dt.date(2024, 5, 1), 3) for d in ("d1", "d2")], "doc_id string, principal_entity string, published date, fy_end_month int")
    line = lambda d, c: json.dumps({"doc_id": d, "batch": 0, "pages": [1], "payload": "```json\n" + json.dumps([c]) + "\n```"})
    (folder / "1.json").write_text(line("d1", claim()))
    s = store.Store(spark, root)
    run = lambda: start(landed_units(spark, f"file://{folder}"), s, pages, meta, f"file://{tmp_path}/cp").awaitTermination()
    run()
    assert s.read("facts").count() == 1
    (folder / "2.json").write_text(line("d2", claim(value_raw="₹7,360 Cr", quote="reported revenue of ₹7,360 Cr in FY24")))
    (folder / "3.json").write_text(line("d1", claim()))
    run()
    assert s.read("facts").count() == 2
    rel = s.read("relations").collect()
    assert [(r.type, r.reason_code) for r in rel] == [("corroborates", "rounded_match")]
