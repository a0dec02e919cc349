"""Evaluation passages inside corpus documents: broadcast n-gram hashes, window scan, verified spans, removal."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise, spread, tidied
from .lookalikes import one_look

#: Consecutive words that make a leak.
N_WORDS = 8
#: Most window hashes that are broadcast at once, 8 bytes each; a larger set is scanned for in blocks of this size.
MAX_WINDOWS = 8_000_000
#: Most characters of distinct item words that are broadcast as a first filter; beyond it every window is hashed.
MAX_VOCABULARY = 8_000_000

_TOKEN = re.compile(r"\S+")
_HITS = "doc_id bigint, t bigint, h bigint, gram string, at int, char_start int, char_end int"


class WordForms(dict):
    """Normalised form of each spelling met: one look, one case, no punctuation and no symbols."""

    LIMIT = 300_000

    def __missing__(self, raw: str) -> str:
        # A letter and its capital may resemble different letters, so both are brought to one look.
        word = one_look(one_look(raw).upper()).lower()
        if not word.isalnum():
            word = "".join(c for c in word if unicodedata.category(c)[0] not in "PSZ")
        if len(self) < self.LIMIT and len(raw) < 60:
            self[raw] = word
        return word


_FORMS = WordForms()


def words_of(text: str) -> list[tuple[str, int, int]]:
    """Normalised words with their offsets in ``text``; words that normalise to nothing are left out."""
    return [(w, m.start(), m.end()) for m in _TOKEN.finditer(text) if (w := _FORMS[m[0]])]


def windows(words: list[str]) -> list[str]:
    return [" ".join(words[i : i + N_WORDS]) for i in range(len(words) - N_WORDS + 1)]


def _key(window: str) -> int:
    return xxhash.xxh3_64_intdigest(window) - (1 << 63)


def scan(text: str, hashes: np.ndarray, vocabulary: frozenset[str] | None) -> list[tuple[int, str, int, int, int]]:
    """``(hash, window, at, char_start, char_end)`` of every window of a text whose hash is among the sorted ``hashes``.

    With a vocabulary a window is only built where all its words occur in some item, so ordinary text costs one set
    test a word.
    """
    words = words_of(text)
    tried: list[tuple[str, int]] = []
    run = 0
    for i, (w, _, _) in enumerate(words):
        run = run + 1 if vocabulary is None or w in vocabulary else 0
        if run >= N_WORDS:
            tried.append((" ".join([x[0] for x in words[i - N_WORDS + 1 : i + 1]]), i - N_WORDS + 1))
    if not tried or not len(hashes):
        return []
    keys = np.fromiter((_key(g) for g, _ in tried), dtype=np.int64, count=len(tried))
    place = np.minimum(np.searchsorted(hashes, keys), len(hashes) - 1)
    return [(int(keys[i]), tried[i][0], at, words[at][1], words[at + N_WORDS - 1][2]) for i in np.flatnonzero(hashes[place] == keys) for at in (tried[i][1],)]


def _scanner(hashes, vocabulary):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, words = hashes.value, vocabulary.value
        for b in batches:
            rows = [(d, t, *hit) for d, t, text in zip(b["doc_id"], b["t"], b["text"], strict=True) for hit in scan(text, known, words)]
            yield pd.DataFrame(rows, columns=["doc_id", "t", "h", "gram", "at", "char_start", "char_end"])

    return run


def _grams_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = [(k, w, _key(w)) for k, t in zip(b["item_id"], b["text"], strict=True) for w in set(windows([x[0] for x in words_of(t)]))]
        yield pd.DataFrame(rows, columns=["item_id", "gram", "h"])


def _spans(documents: DataFrame, items: DataFrame, max_windows: int, max_vocabulary: int) -> DataFrame:
    """``doc_id, t, item_id, char_start, char_end``: maximal runs, apart for each text ``t`` (its hash) under one id."""
    spark = documents.sparkSession
    corpus = spread(documents.select("doc_id", "text", F.xxhash64("text").alias("t")).where("doc_id is not null and text is not null"))
    tests = items.select("item_id", "text").where("item_id is not null and text is not null")
    grams, _ = materialise(tests.mapInPandas(_grams_of, "item_id bigint, gram string, h bigint"), "grams")
    words = grams.select(F.explode(F.split("gram", " ")).alias("w")).distinct()
    size = words.agg(F.coalesce(F.sum(F.length("w") + 1), F.lit(0)).alias("chars")).first()["chars"]
    vocabulary = frozenset(r["w"] for r in words.collect()) if size <= max_vocabulary else None
    blocks = max(1, -(-grams.agg(F.count_distinct("h").alias("n")).first()["n"] // max_windows))
    send = spark.sparkContext.broadcast
    sent = send(vocabulary)
    hits = None
    for k in range(blocks):
        part = grams.where(F.pmod(F.xxhash64("h"), F.lit(blocks)) == k) if blocks > 1 else grams
        hashes = np.sort(part.select("h").distinct().toPandas()["h"].to_numpy(dtype=np.int64))
        found = corpus.mapInPandas(_scanner(send(hashes), sent), _HITS)
        hits = found if hits is None else hits.unionAll(found)
    verified = hits.join(grams, ["h", "gram"])
    by = "partition by doc_id, t, item_id order by at"
    begun = verified.selectExpr("*", f"if(at <= lag(at) over ({by}) + {N_WORDS}, 0, 1) begins")
    runs = begun.selectExpr("*", f"sum(begins) over ({by}) run")
    return runs.groupBy("doc_id", "t", "item_id", "run").agg(F.min("char_start").alias("char_start"), F.max("char_end").alias("char_end")).drop("run")


@tidied
def leaked_spans(documents: DataFrame, items: DataFrame, max_windows: int = MAX_WINDOWS, max_vocabulary: int = MAX_VOCABULARY) -> DataFrame:
    """Spans of documents that repeat at least eight consecutive words of an item.

    Columns ``doc_id, item_id, char_start, char_end`` (offsets in code points of the stored text, end exclusive).
    What is broadcast is the sorted 64-bit hashes of the items' windows, ``max_windows`` at most: a larger set is split
    into blocks by hash, and the corpus is scanned once a block. Only windows whose hash is found leave the scan; they
    are verified on their words by a join with the items' windows, and neighbouring ones are merged. The corpus itself
    is never shuffled, and the result does not depend on either bound.

    Cases: null or empty texts and texts of fewer than eight words share nothing; repeated documents each get their
    rows, and two texts under one id are kept apart; items with one text all match; no items or no documents give no
    rows. Whole texts are scanned.
    """
    return _spans(documents, items, max_windows, max_vocabulary).select("doc_id", "item_id", "char_start", "char_end").distinct()


@tidied
def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Every document with every item leaked into it: ``doc_id, item_id``, distinct."""
    return _spans(documents, items, MAX_WINDOWS, MAX_VOCABULARY).select("doc_id", "item_id").distinct()


@tidied
def without_leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Every document with its leaked spans cut out: ``doc_id, text, removed_chars``; untouched texts are as stored."""
    spans = _spans(documents, items, MAX_WINDOWS, MAX_VOCABULARY).groupBy("doc_id", "t").agg(F.sort_array(F.collect_set(F.struct("char_start", "char_end"))).alias("spans"))
    joined = documents.select("doc_id", "text", F.xxhash64("text").alias("t")).join(spans, ["doc_id", "t"], "left")
    step = """aggregate(spans, named_struct('kept', '', 'at', 0, 'cut', 0),
        (s, x) -> named_struct('kept', s.kept || if(x.char_start > s.at, substring(text, s.at + 1, x.char_start - s.at), ''),
                               'at', greatest(s.at, x.char_end),
                               'cut', s.cut + greatest(0, x.char_end - greatest(s.at, x.char_start))),
        s -> named_struct('text', s.kept || substring(text, s.at + 1), 'cut', s.cut))"""
    done = joined.selectExpr("doc_id", "text", f"if(spans is null, null, {step}) as r")
    return done.selectExpr("doc_id", "coalesce(r.text, text) as text", "coalesce(r.cut, 0) as removed_chars")
