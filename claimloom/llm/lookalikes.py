"""One consistent form for text that looks the same: a longest-match transducer over grapheme clusters."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BooleanType, StringType

# Letters of other scripts that are drawn like a Latin letter, and the letter they are drawn like.
LOOKALIKES = (
    # Cyrillic
    ("аеорсухіјѕһԁԛԝӏ", "aeopcyxijshdqwl"),
    ("АВЕКМНОРСТУХІЈЅԌԚԜӀ", "ABEKMHOPCTYXIJSGQWl"),
    # Greek
    ("ονραιυϲϳ", "ovpaiucj"),
    ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹ", "ABEZHIKMNOPTYXC"),
    # Armenian
    ("օհոսցզ", "ohnugq"),
    ("ՕՏԼՍ", "OSLU"),
    # Cherokee
    ("ᎠᎡᎢᎪᎫᎬᎳᎷᎻᏀᏃᏎᏏᏒᏔᏙᏚᏞᏟᏢᏦᏴ", "DRTAJEWMHGZ4bRWVSLCPKB"),
    # Letters of phonetic writing
    ("ɑɡɩ", "agi"),
)
# Marks drawn as a plain hyphen.
HYPHENS = "\u2010\u2011"
# Characters without any width of their own.
UNSEEN = "\u00ad\u034f\u061c\u180e\u200b\u200c\u200d\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2060\u2061\u2062\u2063\u2064\u2066\u2067\u2068\u2069\ufeff" + "".join(map(chr, range(0xFE00, 0xFE10)))
# Code point ranges in which a mapping can occur, and those where a compatibility form keeps its look.
SCANNED = ((0x00, 0x33FF), (0xA640, 0xA69F), (0xF900, 0xFFFF), (0x2F800, 0x2FA1F))
SAME_LOOK = ((0x00B5, 0x00B5), (0x0132, 0x0133), (0x01C4, 0x01CC), (0x01F1, 0x01F3), (0x2024, 0x2026), (0x2160, 0x217F), (0x2E80, 0x2FDF), (0xFB00, 0xFB06))


def _one(ch: str, letters: dict[str, str]) -> str:
    """What a single code point is written as."""
    if ch in UNSEEN:
        return ""
    if ch in HYPHENS:
        return "-"
    if unicodedata.category(ch) in ("Zs", "Zl", "Zp") or ch in "\t\n\r\x0b\x0c\x85":
        return " "
    tag = unicodedata.decomposition(ch).partition(" ")[0]
    if tag in ("<wide>", "<narrow>") or any(lo <= ord(ch) <= hi for lo, hi in SAME_LOOK):
        ch = unicodedata.normalize("NFKC", ch)
    return "".join(letters.get(x, x) for x in unicodedata.normalize("NFD", ch))


def _scanned() -> Iterator[str]:
    for lo, hi in SCANNED:
        for cp in range(lo, hi + 1):
            if not 0xD800 <= cp <= 0xDFFF:
                yield chr(cp)


def compile_transducer() -> tuple[re.Pattern, dict[str, str], frozenset[str]]:
    """The pattern of clusters, the mapping of clusters to their one form, and the marks that follow a base.

    Compiled beforehand are all single code points and all clusters of a base and the marks it can be composed with, the
    base in each of its looks (accents written apart, look-alike bases, both). Conflicts raise ``ValueError``: a letter or
    a cluster with two outputs, an output that would itself be rewritten, a character that is both removed and mapped.
    The mapping must be a function, and applying it twice must change nothing.
    """
    letters: dict[str, str] = {}
    for sources, targets in LOOKALIKES:
        for s, t in zip(sources, targets, strict=True):
            if letters.setdefault(s, t) != t:
                raise ValueError(f"two outputs for {s!r}")
    looks: dict[str, list[str]] = {}
    for s, t in letters.items():
        looks.setdefault(t, []).append(s)
    marks = set("\u0e4d\uff9e\uff9f")
    table: dict[str, str] = {}
    clusters: dict[str, str] = {}

    def put(key: str, value: str) -> None:
        if clusters.setdefault(key, value) != value:
            raise ValueError(f"two outputs for {key!r}")

    for ch in _scanned():
        if (out := unicodedata.normalize("NFC", _one(ch, letters))) != ch:
            table[ch] = out
        apart = unicodedata.normalize("NFD", ch)
        if len(apart) > 1 and all(unicodedata.combining(x) for x in apart[1:]):
            marks |= set(apart[1:])
            one = unicodedata.normalize("NFC", letters.get(apart[0], apart[0]) + apart[1:])
            for base in (apart[0], *looks.get(apart[0], ())):
                put(base + apart[1:], unicodedata.normalize("NFC", one))
    marks |= {chr(c) for c in range(0x300, 0x370)} - set(UNSEEN)
    for s, out in table.items():
        if any(x in table for x in out):
            raise ValueError(f"the output of {s!r} is itself rewritten")
        if s in UNSEEN and out:
            raise ValueError(f"{s!r} is both removed and mapped")
    follow = "".join(map(re.escape, sorted(marks | set(UNSEEN))))
    heads = "".join(map(re.escape, sorted(table)))
    # Thai sara am is drawn the same as nikhahit before sara aa, so the latter belongs to the cluster.
    return re.compile(f"(?:[{heads}]|.[{follow}])[{follow}]*\u0e32?", re.DOTALL), clusters | table, frozenset(marks)


class Clusters(dict):
    """The compiled mapping; a cluster outside it (marks on a base they make no letter with) is composed on first sight."""

    LIMIT = 200_000

    def __init__(self, compiled: dict[str, str]):
        super().__init__(compiled)
        self.singles = {k: v for k, v in compiled.items() if len(k) == 1}

    def __missing__(self, cluster: str) -> str:
        plain = "".join(self.singles.get(ch, ch) for ch in cluster)
        letters = (self.singles.get(x, x) for x in unicodedata.normalize("NFD", plain))
        out = unicodedata.normalize("NFC", "".join(letters)).replace("\u0e4d\u0e32", "\u0e33")
        if len(self) < self.LIMIT:
            self[cluster] = out
        return out


_PATTERN, _COMPILED, _MARKS = compile_transducer()
_TABLE = Clusters(_COMPILED)
_ORDS = {ord(k): v for k, v in _TABLE.singles.items()}
_LAYOUT = re.compile(r"[\t\n\r\x0b\x0c]")
_FOLLOW = re.compile("[" + "".join(map(re.escape, sorted(_MARKS))) + "]")


class Words(dict):
    """Outputs of the words met so far, so that a word written often is rewritten once in each worker."""

    LIMIT = 100_000

    def __missing__(self, word: str) -> str:
        if word.isascii() and not _LAYOUT.search(word):
            return word
        # Without a combining mark every cluster is one code point (and invisible ones), which a table can rewrite.
        out = _PATTERN.sub(lambda m: _TABLE[m[0]], word) if _FOLLOW.search(word) else word.translate(_ORDS)
        if len(self) < self.LIMIT and len(word) < 40:
            self[word] = out
        return out


_WORDS = Words()


def one_look(text: str | None) -> str | None:
    """``text`` in characters of one look, in a single pass. Null stays null, empty stays empty.

    Widths, blanks of every kind, invisible characters, composed and decomposed accents, ligatures and look-alike
    letters of other scripts become one form. Case, accents, digits of another script and raised digits stay.
    """
    if text is None or (text.isascii() and not _LAYOUT.search(text)):
        return text
    return " ".join([_WORDS[w] for w in text.split(" ")])


@pandas_udf(StringType())
def one_look_udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Arrow-batched ``one_look``."""
    for s in batches:
        yield pd.Series([one_look(x) if isinstance(x, str) else None for x in s], dtype=object)


@pandas_udf(BooleanType())
def _holds(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Whether the page holds the quote once both have one look. Rows come sorted by page out of the join, so each page is
    rewritten once and forgotten when the next comes, however its rows fall into batches."""
    last, page = None, None
    for texts, quotes in batches:
        out = []
        for t, q in zip(texts, quotes, strict=True):
            if last is None or t != last:
                last, page = t, one_look(t)
            q = one_look(q)
            out.append(bool(q.strip()) and q in page)
        yield pd.Series(out, dtype=bool)


def consistent_pages(pages: DataFrame) -> DataFrame:
    """Every page in one consistent form: ``doc_id``, ``page``, ``text``; a null text stays null."""
    return pages.select("doc_id", "page", one_look_udf("text").alias("text"))


def recovered_quotes(evidence: DataFrame, pages: DataFrame) -> DataFrame:
    """Evidence whose quote is on its page only once both are written in characters of one look: ``evidence_id``.

    The exact test runs in the JVM and settles most rows; only the rest reach the transducer. Rows without a quote,
    a page or a page text, and quotes of nothing visible, give no row; repeated evidence gives one row; only the named
    columns are read, so extra columns cannot clash.
    """
    quotes = evidence.select("evidence_id", "doc_id", "page", "quote").where("quote is not null and quote <> ''")
    texts = pages.select("doc_id", "page", F.col("text").alias("page_text")).where("page_text is not null")
    missed = quotes.join(texts.hint("merge"), ["doc_id", "page"]).where(~F.contains("page_text", "quote"))
    return missed.where(_holds("page_text", "quote")).select("evidence_id").distinct()
