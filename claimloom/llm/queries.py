"""Queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

import unicodedata

from ..session import table
from . import components, leaks, lookalikes, names, packing, sentences


def p1_found(spark, sf_dir):
    return names.same_names(table(spark, sf_dir, "facts"))


def p1_groups(spark, sf_dir):
    return names.spelling_groups(table(spark, sf_dir, "facts"))


def p2_found(spark, sf_dir):
    return lookalikes.recovered_quotes(table(spark, sf_dir, "evidence"), table(spark, sf_dir, "doc_pages"))


def p2_pages(spark, sf_dir):
    return lookalikes.consistent_pages(table(spark, sf_dir, "doc_pages"))


def p3_found(spark, sf_dir):
    return components.corroborated_groups(table(spark, sf_dir, "relations"))


def p6_packed(spark, sf_dir):
    return packing.packed(table(spark, sf_dir, "documents"))


def p7_found(spark, sf_dir):
    return leaks.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p7_spans(spark, sf_dir):
    return leaks.leaked_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p7_cleaned(spark, sf_dir):
    return leaks.without_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_found(spark, sf_dir):
    return sentences.sentences(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_groups, p2_found, p2_pages, p3_found, p6_packed, p7_found, p7_spans, p7_cleaned, p8_found)}


def _widths() -> tuple[str, str]:
    """Characters of other widths and radicals, and their plain form, one for one."""
    found = [(chr(c), unicodedata.normalize("NFKC", chr(c))) for c in (*range(0x2E80, 0x2FD6), *range(0xFF01, 0xFFEF)) if len(unicodedata.normalize("NFKC", chr(c))) == 1]
    return "".join(a for a, _ in found), "".join(b for _, b in found)


# Letters that look like Latin ones, written out again for the SQL.
_LIKE = "аеорсухіјѕһԁԛԝӏАВЕКМНОРСТУХІЈЅԌԚԜӀονραιυΑΒΕΖΗΙΚΜΝΟΡΤΥΧ"
_LATIN = "aeopcyxijshdqwlABEKMHOPCTYXIJSGQWlovpaiuABEZHIKMNOPTYX"
_UNSEEN = r"[\x{ad}\x{34f}\x{61c}\x{180e}\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{2064}\x{2066}-\x{2069}\x{feff}\x{fe00}-\x{fe0f}]"
_BLANK = r"[\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _one_look(x: str) -> str:
    """A text in characters of one look, as SQL: widths, invisible characters, blanks, hyphens, look-alikes, ligatures, composition."""
    wide, plain = (w.replace("'", "''") for w in _widths())
    bare = f"regexp_replace(regexp_replace({x}, '{_UNSEEN}', '', 'g'), '{_BLANK}', ' ', 'g')"
    spelt = f"replace(replace(replace(replace(replace(replace({bare}, 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ﬀ', 'ff'), 'ﬃ', 'ffi'), 'ﬄ', 'ffl'), '…', '...')"
    return f"nfc_normalize(translate(translate(nfc_normalize({spelt}), '{wide}', '{plain}'), '{_LIKE}‐‑', '{_LATIN}--'))"


def _folded(x: str) -> str:
    """Words of a text without case, punctuation, symbols and looks, as an SQL list."""
    upper = _one_look(f"upper({_one_look(x)})")
    return f"list_filter(string_split(regexp_replace(lower({upper}), '[\\p{{P}}\\p{{S}}]', '', 'g'), ' '), lambda w: w <> '')"


_GRAMS = "select {key}, array_to_string(w[i:i + 7], ' ') g from (select {key}, w, unnest(range(1, len(w) - 6)) i from (select {key}, {words} w from {table} where text is not null))"
SQL = {
    "p2_found": f"select distinct evidence_id from evidence e join doc_pages p on e.doc_id = p.doc_id and e.page = p.page where not contains(p.text, e.quote) and trim({_one_look('e.quote')}, ' ') <> '' and contains({_one_look('p.text')}, {_one_look('e.quote')})",
    "p2_pages": f"select doc_id, page, {_one_look('text')} as text from doc_pages",
    "p7_found": f"with d as ({_GRAMS.format(key='doc_id', words=_folded('text'), table='documents')}), t as ({_GRAMS.format(key='item_id', words=_folded('text'), table='eval_items')}) select distinct doc_id, item_id from d join t using (g)",
    "p3_found": r"""
with recursive links as (
    select a_id a, b_id b from relations
    where lower(regexp_replace(type, '^\s+|\s+$', '', 'g')) = 'corroborates' and a_id is not null and b_id is not null and a_id <> b_id),
edges as (select a, b from links union select b, a from links),
reach as (
    select a id, b other from edges
    union
    select r.id, e.b from reach r join edges e on r.other = e.a)
select id, least(id, min(other)) as group_id from reach group by id""",
}
