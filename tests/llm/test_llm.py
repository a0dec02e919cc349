"""Operators for training data against brute force, round trips and stated cases."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from claimloom.llm import components, leaks, lookalikes, names, packing, queries, sentences
from tests.compare import compare, connect

SF = "/root/testdata/sf0.001"


def union_find(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    return {x: find(x) for x in parent}


def test_components(spark):
    rng = random.Random(1)
    pairs = [(f"{rng.randrange(90):03}", f"{rng.randrange(90):03}") for _ in range(60)] + [(f"c{i:03}", f"c{i + 1:03}") for i in range(50)] + [("hub", f"s{i:03}") for i in range(200)]
    rows = [(a, b, "x") for a, b in pairs] + [(b, a, "y") for a, b in pairs[:20]] + [("n", None, "z"), (None, "n", "z"), ("self", "self", "z")]
    df = spark.createDataFrame(rows, "a string, b string, v string")
    got = {r.id: r.group_id for r in components.hash_to_min(df, "a", "b").collect()}
    assert got == union_find([p for p in pairs if p[0] != p[1]])
    assert components.hash_to_min(df.where("false"), "a", "b").count() == 0


def test_components_match_sql(spark):
    same, _, _, detail = compare(spark, connect(SF), "p3_found", queries.QUERIES["p3_found"], queries.SQL["p3_found"], SF)
    assert same, detail


def test_lookalikes():
    one = lookalikes.one_look
    same = [("ﬁne", "fine"), ("Ｗｉｄｅ", "Wide"), ("é", "é"), ("a​b­c", "abc"), ("a b c", "a b c"), ("Соmраny", "Company"), ("ｶﾞ", "ガ"), ("が", "が"), ("⽣", "生"), ("co‑op", "co-op"), ("น้ํา", "น้ำ")]
    for a, b in same:
        assert one(a) == one(b), (a, b)
    for a, b in [("é", "e"), ("A", "a"), ("2", "²"), ("२", "2"), ("x y", "xy"), ("5", "6")]:
        assert one(a) != one(b)
    text = "Соmраny ﬁne é " * 2000
    assert one(one(text)) == one(text)
    assert one(None) is None and one("") == ""


def test_recovered_quotes(spark):
    ev = [(1, "d", 1, "Ｗide fine"), (2, "d", 1, "Wide fine"), (3, "d", 1, "wide fine"), (4, "d", 1, None), (5, "d", 2, "Ｗide"), (6, "d", 1, ""), (7, "d", 1, "​"), (8, None, 1, "Ｗide"), (1, "d", 1, "Ｗide fine")]
    pages = [("d", 1, "so Wide fine day", "clash"), ("d", 3, None, None)]
    evidence = spark.createDataFrame(ev, "evidence_id long, doc_id string, page int, quote string").withColumn("text", F.lit("clash"))
    got = lookalikes.recovered_quotes(evidence, spark.createDataFrame(pages, "doc_id string, page int, text string, quote string")).collect()
    assert [r.evidence_id for r in got] == [1]
    assert lookalikes.recovered_quotes(evidence.where("false"), spark.createDataFrame(pages, "doc_id string, page int, text string, quote string")).count() == 0


ITEM = "The lighthouse keeper shipped back exactly 5039 sacks of signal flags inside Bamar after dark."


def leak_tables(spark):
    docs = [(1, f"Intro. {ITEM} End."), (2, "the LIGHTHOUSE kеeper shippеd back — exactly 5039, sacks!"), (3, "lighthouse keeper shipped back exactly 5039"), (4, None), (5, ""), (6, "x " * 50_000 + ITEM), (7, ITEM[:60] + " and then " + ITEM[40:]), (1, f"Intro. {ITEM} End.")]
    return spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash")), spark.createDataFrame([(10, ITEM), (11, ITEM), (12, "too short"), (13, None)], "item_id long, text string")


def test_leaks(spark):
    docs, items = leak_tables(spark)
    want = {(d, i) for d in (1, 2, 6, 7) for i in (10, 11)}
    assert {tuple(r) for r in leaks.leaks(docs, items).collect()} == want
    both = [{tuple(r) for r in leaks.leaked_spans(docs, items, max_windows=m, max_vocabulary=v).collect()} for m, v in ((10**6, 10**6), (3, 0))]
    assert both[0] == both[1]
    clean = {r.doc_id: r for r in leaks.without_leaks(docs, items).collect()}
    assert clean[1].text == "Intro.  End." and clean[3].removed_chars == 0 and clean[4].text is None
    assert leaks.leaks(docs, items.where("false")).count() == 0 and leaks.leaks(docs.where("false"), items).count() == 0


def test_texts_of_one_id_are_not_mixed(spark):
    words = "one two three four five six seven eight nine ten eleven twelve".split()
    docs = spark.createDataFrame([(1, " ".join(words[:8])), (1, "so then " + " ".join(words[3:12])), (1, " ".join(words[:8]))], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, " ".join(words))], "item_id bigint, text string")
    want = {(1, 7, 0, len(" ".join(words[:8]))), (1, 7, 8, 8 + len(" ".join(words[3:12])))}
    for m, v in ((10**6, 10**6), (2, 0)):
        assert {tuple(r) for r in leaks.leaked_spans(docs, items, max_windows=m, max_vocabulary=v).collect()} == want
    assert sorted(r.text.strip() for r in leaks.without_leaks(docs, items).collect()) == ["", "", "so then"]


def test_leaks_against_brute_force(spark):
    docs, items = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "eval_items"))
    grams = {r.item_id: set(leaks.windows([w for w, _, _ in leaks.words_of(r.text)])) for r in items.collect()}
    want = set()
    for r in docs.where("text is not null").collect():
        seen = set(leaks.windows([w for w, _, _ in leaks.words_of(r.text)]))
        want |= {(r.doc_id, i) for i, g in grams.items() if g & seen}
    assert {tuple(r) for r in leaks.leaks(docs, items).collect()} == want and want


def first_fit(sizes, capacity):
    bins, out = [], []
    for s in sizes:
        k = next((i for i, b in enumerate(bins) if b >= s), None)
        if k is None:
            bins.append(capacity)
            k = len(bins) - 1
        bins[k] -= s
        out.append(k)
    return out


def test_first_fit_tree():
    rng = random.Random(2)
    for _ in range(50):
        items = [(i, rng.choice([0, 1, rng.randrange(1, 300), 100, 250])) for i in range(rng.randrange(1, 60))]
        got = packing.first_fit_decreasing(items, 100)
        assert [g[3] for g in got] == first_fit([g[2] for g in got], 100)
        total = {}
        for doc, part, size, _ in got:
            total.setdefault(doc, []).append((part, size))
        assert {d: sum(s for _, s in p) for d, p in total.items()} == dict(items)
        assert all(len(p) == max(1, -(-dict(items)[d] // 100)) for d, p in total.items())


def test_packed(spark):
    docs = spark.createDataFrame([(1, "word " * 5000), (2, ""), (3, None), (4, "a b c"), (5, "hello world " * 700), (4, "a b"), (None, "x")], "doc_id long, text string").withColumn("part", F.lit("clash"))
    got = packing.packed(docs).collect()
    per = {}
    for r in got:
        per.setdefault(r.container, 0)
        per[r.container] += r.n_tokens
    assert max(per.values()) <= 2048 and {r.doc_id for r in got} == {1, 2, 3, 4, 5}
    assert sum(r.doc_id == 1 for r in got) == -(-sum(r.n_tokens for r in got if r.doc_id == 1) // 2048)
    assert sum(r.doc_id == 5 for r in got) == 1
    assert packing.packed(docs.where("false")).count() == 0
    small = packing.packed(spark.read.parquet(f"{SF}/documents.parquet"), group_tokens=20_000)
    fill = small.groupBy("container").agg(F.sum("n_tokens").alias("t")).agg(F.avg("t"), F.max("t")).first()
    assert fill[1] <= 2048 and fill[0] > 1700


SENTENCES = [
    ("Dr. Rao met Mr. Li at 6 p.m. on Friday. They paid Rs. 76 cr. in all.", ["Dr. Rao met Mr. Li at 6 p.m. on Friday.", "They paid Rs. 76 cr. in all."]),
    ("“Yes. At once!” came the reply. Fees fell.", ["“Yes. At once!” came the reply.", "Fees fell."]),
    ("9. Overview of results\n\nThe plant covers 4.0 km² of land.\n- wagons leased\n- stock (Rs. 9)\n\nAnnex 3", ["9. Overview of results", "The plant covers 4.0 km² of land.", "- wagons leased", "- stock (Rs. 9)", "Annex 3"]),
    ("Am 9. März wurde die Straße gesperrt. War das zu erwarten? Nein!", ["Am 9. März wurde die Straße gesperrt.", "War das zu erwarten?", "Nein!"]),
    ("L’art. 3 du décret précise, p. ex. ici. Rien !", ["L’art. 3 du décret précise, p. ex. ici.", "Rien !"]),
    ("没有人解释！“要重述吗？”主席问道。见图1。", ["没有人解释！", "“要重述吗？”主席问道。", "见图1。"]),
    ("「再集計しますか？」と議長が尋ねた。図6を参照。", ["「再集計しますか？」と議長が尋ねた。", "図6を参照。"]),
    ("डॉ. राव ने रु. 17 दिए। दर क्यों गिरी?", ["डॉ. राव ने रु. 17 दिए।", "दर क्यों गिरी?"]),
    ("การตรวจสอบที่Abuใช้เวลา5วัน สินเชื่อไม่เปลี่ยนแปลง", ["การตรวจสอบที่Abuใช้เวลา5วัน", "สินเชื่อไม่เปลี่ยนแปลง"]),
    ("В 2013 г. вклады выросли. См. рис. 6 на с. 761.", ["В 2013 г. вклады выросли.", "См. рис. 6 на с. 761."]),
    ("A line\nbreak inside. Split by district.Orders came.", ["A line\nbreak inside.", "Split by district.", "Orders came."]),
    ("लाभ २३.५ थी (अवधि)? दर क्यों गिरी?", ["लाभ २३.५ थी (अवधि)?", "दर क्यों गिरी?"]),
    ("The rain stopped.Prof. R. V. Hiwo left. Er zahlte 850 Tsd. € sofort.", ["The rain stopped.", "Prof. R. V. Hiwo left.", "Er zahlte 850 Tsd. € sofort."]),
    ("Area was over 113 sq. m. Ticket sales rose by 5 sq. m (FY20) in all.", ["Area was over 113 sq. m.", "Ticket sales rose by 5 sq. m (FY20) in all."]),
    ("For May. 2022: T H. Tuho paid Rs 8,490Cr. in Q1. It ended in May. So be it.", ["For May. 2022: T H. Tuho paid Rs 8,490Cr. in Q1.", "It ended in May.", "So be it."]),
    ("a block without any mark at all", ["a block without any mark at all"]),
]


@pytest.mark.parametrize("text,want", SENTENCES)
def test_sentences(text, want):
    assert [text[a:b] for a, b in sentences.sentence_spans(text)] == want


def test_sentences_cover_everything(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    spans = {}
    for r in sentences.sentences(docs).collect():
        spans.setdefault(r.doc_id, []).append((r.sent_start, r.sent_end))
    for d, t in texts.items():
        got = sorted(spans.get(d, []))
        assert all(a < b and t[a:b] == t[a:b].strip() for a, b in got) and all(x[1] <= y[0] for x, y in itertools.pairwise(got))
        assert "".join("".join(t[a:b] for a, b in got).split()) == "".join(t.split())
    assert sentences.sentence_spans(None) == sentences.sentence_spans("") == sentences.sentence_spans(" \n ") == []
    assert sentences.sentence_spans("​") == [(0, 1)]
    assert len(sentences.sentence_spans("One two three. " * 20_000)) == 20_000
    assert sentences.sentences(docs.where("false")).count() == 0


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        after = [i]
        for j, y in enumerate(b, 1):
            after.append(min(row[j] + 1, after[-1] + 1, row[j - 1] + (x != y)))
        row = after
    return row[-1]


def test_radius_join_is_exact(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("abcde") for _ in range(rng.randrange(3, 8))) for _ in range(350)]
    rows = {("k" if i % 3 else "q", w) for i, w in enumerate(base)} | {("k", "")}
    got = {tuple(r) for r in names.radius_join(spark.createDataFrame(list(rows) * 2, "cls string, head string")).collect()}
    want = {(c, *sorted((a, b))) for (c, a), (d, b) in itertools.combinations(sorted(rows), 2) if c == d and levenshtein(a, b) <= names.RADIUS}
    assert got == want


def test_names(spark):
    same = [["Acme Steel Private Limited", "ACME  STEEL PVT LTD", "The Acme Steel Private Limited", "M/s Acme Stl. Private Limited"], ["Dorothy Lasan Zofafazo", "Zofafazo, Dorothy Lasan", "Dolly Lasan Zofafazo", "Dorothy L. Zofafazo", "Dorothy Lasan Zofafzao"], ["Ministry of Roads, Bamapekos", "ROADS MINISTRY, BAMAPEKOS", "Ministry of Roads (Bamappekos)"]]
    apart = ["Acme Foods Private Limited", "Giuseppe Lasan Zofafazo", "Department of Fisheries, Bamapekos"]
    rows = [(n,) for g in same for n in g] * 3 + [(n,) for n in apart] + [(None,), ("the Company",), ("we",), ("",), ("  ",), ("x" * 20_000,)]
    df = spark.createDataFrame(rows, "entity string").withColumn("key", F.lit("clash"))
    want = {tuple(sorted(p)) for g in same for p in itertools.combinations(g, 2)}
    assert {tuple(r) for r in names.same_names(df).collect()} == want
    assert names.same_names(df.where("false")).count() == 0
