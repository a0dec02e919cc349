"""Table schemas."""

from __future__ import annotations

QUANTITY = "struct<raw:string,value:double,unit:string,magnitude:double,kind:string,canonical_value:double,canonical_unit:string,approximate:boolean>"
PERIOD = "struct<raw:string,kind:string,start:date,end:date,label:string>"

DOCUMENTS = "id string, filename string, title string, publisher string, published date, n_pages int, sha256 string, ingested_at timestamp, status string, stats map<string,string>"
BLOCKS = "doc_id string, page int, block_no int, block_type int, x0 double, y0 double, x1 double, y1 double, text string, size double"
PAGES = "doc_id string, page int, text string, magnitude_hint double, unit_hint string"
UNITS = "doc_id string, batch int, pages array<int>, payload string"
FACTS = (
    "id string, doc_id string, fact_type string, measure_key string, measure_raw string, entity string, entity_key string, "
    f"quantity {QUANTITY}, value_text string, period {PERIOD}, basis array<string>, estimate_type string, as_of date, page int, quote string, confidence double"
)
RELATIONS = "id string, a_id string, b_id string, type string, reason_code string, confidence double, explanation string, analysis string, adjudicator string, cross_document boolean"
FAILURES = "id string, doc_id string, page int, stage string, kind string, sample string"
