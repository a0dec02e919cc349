"""Sentence spans in many scripts: semi-Markov dynamic programming over whole candidate sentences."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame

from ..session import spread
from .lookalikes import UNSEEN, one_look


def _listed(words: str) -> frozenset[str]:
    """A word list in the form in which tokens are compared."""
    return frozenset(one_look(w).lower() for w in words.split())


# Abbreviations. Those that stand before a name or a number, and never end a sentence before one.
LEADING = _listed(
    "mr m/s mrs ms dr prof st shri smt sri messrs hon capt col gen rev fr sr sra srta m mme mlle mm hr frl fa "
    "no nos nr fig figs p pp vol ch sec art arts abb tab s núm num pág págs рис с стр табл ст см г гл п "
    "ca rd approx aprox est bzw vorl vgl cf vs e.g i.e z.b d.h u.a p.ex т.е т.к डॉ श्री श्रीमती पृ रु rs "
    "eg ie ex viz inst dept deptt govt min dir ref para cl reg sq cu кв"
)
# Those that may close a sentence as well as stand inside one.
TRAILING = _listed(
    "etc inc ltd co corp bros pvt plc llp llc cr mio mrd tsd usw a.m p.m u.s u.k h hrs min sec тыс руб млн млрд трлн д т.д т.п "
    "jan feb mar apr jun jul aug sep sept oct nov dec cont ibid al g.m.b.h s.a b.v n.v pty jr kg km"
)
# Those of trades and bodies inside names of organisations, where another part of the name follows.
NAME_PARTS = frozenset(
    "acad agr agri agro assn assoc auto bk bldg cem chem chems cmt comm const constr corpn devt dist distr elec elect electr eng engg engr eqpt exp fds fin fdn hldg hldgs hosp ind inds indus infra ins insur intl inv invest lab labs log "
    "logist mach manuf mfg mfrs mgmt min mls mng mtls mktg natl petro pharm pharma pharmas pkg prod prods prop props pub pwr ren res rly rlys ry semicond serv shpg soc solns stl svc svcs sys tech tel telecom telecoms tex textl trans transm trd trdg univ util wks".split()
)
# Scales, and the currencies that follow them.
SCALES = _listed("mio mrd tsd cr тыс млн млрд трлн mn bn")
CURRENCIES = _listed("eur euro euros usd gbp inr rub руб рублей")
# What follows such an abbreviation when the name goes on.
NAME_ENDS = frozenset("company private limited incorporated corporation gmbh holdings pvt ltd co inc corp plc llp and &".split())
MONTHS = _listed(
    "januar februar märz april mai juni juli august september oktober november dezember jänner "
    "january february march may june july october december jan feb mar apr jun jul aug sep sept oct nov dec"
)
# How a reporting clause goes on after a quotation in scripts without letter case.
REPORTS = re.compile(r"^[^。！？!?]{0,80}?(?:[说說]|问道|問道|写道|寫道|道[。（(]|称|稱|表示|指出|と(?:議長|[^。！？]{0,70}(?:述べ|尋ね|言|語|話|答え|書)))")

TERMINALS = ".!?…。！？।॥؟"
CLOSERS = "\"'”’»)]」』）】›“"
OPEN_OF = {"”": "“", "»": "«", "」": "「", "』": "『", "’": "‘", ")": "(", "）": "（", "]": "[", "】": "【"}
QUOTES = frozenset("“„«「『‘")
BRACKETS = frozenset("(（[【")

_BREAK = re.compile(r"\n[^\S\n]*(?:\n\s*)+")
_ITEM = re.compile(r"\n[^\S\n]*(?=(?:[-–—•*‣▪·◦][^\S\n]+|\(?(?:\d{1,2}|[a-z])\)[^\S\n])\S)")
_ITEM_HEAD = re.compile(r"\s*(?:[-–—•*‣▪·◦]|\(?(?:\d{1,2}|[a-z])\))\s")
_END = re.compile(f"[{re.escape(TERMINALS)}]+[{re.escape(CLOSERS)}]*")
_THAI_GAP = re.compile("(?<=[\\u0e00-\\u0e7f0-9)）%\\]A-Za-z])\\s+(?=[\\u0e00-\\u0e7f])|(?<=[\\u0e00-\\u0e7f])\\s+(?=\\S)")
_THAI = re.compile("[\u0e01-\u0e4e]")
_MARK = re.compile("[" + re.escape("".join(sorted(QUOTES | BRACKETS | set(OPEN_OF))) + '"') + "]")
_LONE = re.compile(f"(?<!\\S)[{UNSEEN}]+(?!\\S)")
_TOKEN = re.compile(r"[^\s(\[（“„«「‘\"]+$")
_GLUED = re.compile(r"^.*[^\W\d_]{3}[.!?](?=[^\W\d_]+$)")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_HIDDEN = re.compile(f"[{UNSEEN}]")
_PLAIN_END = re.compile(f"[{re.escape(TERMINALS)}:;,][{re.escape(CLOSERS)}\\s]*$")

NEVER = -9.0


@lru_cache(maxsize=50_000)
def _plain(token: str) -> str:
    """A token as abbreviations are listed: one look, lower case."""
    return one_look(token).lower().strip("\"'”’»()[]“„«").removeprefix("l’").removeprefix("d’").removeprefix("l'").removeprefix("d'")


def _is_thai(text: str) -> bool:
    return _THAI.search(text) is not None


def blocks(text: str) -> Iterator[tuple[int, int, bool]]:
    """``(start, end, is_item)`` of blocks parted by blank lines, and of the list items in them."""
    at = 0
    for m in [*_BREAK.finditer(text), None]:
        end = m.start() if m else len(text)
        starts, item_before = [at], False
        for i in _ITEM.finditer(text, max(0, at - 1), end):
            if i.start() < at:
                continue
            before = text[starts[-1] : i.start()]
            # A dash at a line's start is a marker only after a finished line or another item: names hold dashes too.
            if item_before or _ITEM_HEAD.match(before) or _PLAIN_END.search(before) or "\n" not in before.strip() and len(before.strip()) < 50:
                starts.append(i.end())
                item_before = True
        for k, s in enumerate(starts):
            e = starts[k + 1] if k + 1 < len(starts) else end
            yield s, e, k > 0 or bool(_ITEM_HEAD.match(text[s : s + 12]))
        at = m.end() if m else end


def _pairs(s: str) -> list[tuple[int, int, bool]]:
    """Matched quotations and brackets of a block: ``(open, close, is_quote)``. Unmatched marks count as none."""
    stack: list[tuple[str, int]] = []
    out = []
    held: Counter[str] = Counter()

    def pop(k: int) -> None:
        held.subtract(x for x, _ in stack[k:])
        del stack[k:]

    # A closing mark without a partner is known by the counts; else all that is searched is taken off.
    for m in _MARK.finditer(s):
        i, c = m.start(), m[0]
        if c in QUOTES or c in BRACKETS:
            if c == "“" and stack and stack[-1][0] == "„":
                out.append((stack[-1][1], i, True))
                pop(len(stack) - 1)
            else:
                stack.append((c, i))
                held[c] += 1
        elif c in OPEN_OF:
            want = OPEN_OF[c]
            if not held[want] and not (c == "”" and held["„"]):
                continue
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == want or (c == "”" and stack[k][0] == "„"):
                    out.append((stack[k][1], i, stack[k][0] in QUOTES))
                    pop(k)
                    break
        elif c == '"':
            if not held[c]:
                stack.append((c, i))
                held[c] += 1
                continue
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == '"':
                    out.append((stack[k][1], i, True))
                    pop(k)
                    break
    return out


def _closing(s: str, m: re.Match, follows: str, glued: bool) -> float:
    """How well the text up to the mark ends a sentence, given what follows."""
    mark = m[0]
    ends = mark.rstrip(CLOSERS)
    closers = mark[len(ends) :]
    first = follows[:1]
    if ends[-1] in "。！？":
        if closers and REPORTS.match(follows):
            return NEVER
        return 4.0
    if ends[-1] in "!?؟।॥":
        if first.islower() and closers:
            return NEVER
        return 4.0 if not glued or first.isupper() or ord(first or "a") > 0x300 else NEVER
    if glued and first.isdigit():
        return NEVER
    if glued and not (first.isupper() or first in "“„«" or "ऀ" <= first <= "෿"):
        return NEVER
    if first.islower() and (closers or len(ends) > 1 or ends == "…"):
        # A quotation or an ellipsis inside a sentence: the sentence goes on in lower case.
        return NEVER
    if len(ends) > 1 or ends == "…":
        return 2.5
    token = _TOKEN.search(s, max(0, m.start() - 40), m.start())
    if token is None:
        return 3.0 if closers or m.start() and s[m.start() - 1] in CLOSERS else NEVER
    # A sentence that begins right after a mark shares its token with the one before.
    word = _plain(_GLUED.sub("", token[0]))
    if word[:1].isdigit() and not word[-1:].isdigit():
        # A unit written right after its figure.
        word = word.lstrip("0123456789.,") or word
    initial = len(word) == 1 and token[0][-1:].isupper()
    upper = first.isupper() or first in "“„«‘¿¡\"" or not (first.islower() or first.isdigit()) and first.isalpha()
    number = first.isdigit() or first in "₹$€£¥₽−"
    nxt = _WORD.match(follows)
    after = _plain(nxt[0]) if nxt else ""
    if not word:
        return 3.0
    if glued and (len(word) < 2 or "." in word or word in LEADING):
        return NEVER
    if word[-1].isdigit():
        if after in MONTHS and not glued and word.isdigit() and len(word) < 3 and s[: m.start()].rstrip("0123456789").endswith((" ", "\n")):
            return NEVER
        if first.islower() and word.isdigit() and len(word) < 3:
            return 1.0 if re.search(r"(?i)\b(?:fig|tab|abb|p|pp|s|vol|ch|no|nr|annex|table|note)\.? *\d*$", s[max(0, m.start() - 12) : m.start()]) else NEVER
        return 4.0 if not first.islower() else 2.0
    letters = word.replace(".", "")
    if word in ("m", "t", "g", "h", "м", "т") and not initial and re.search(r"(?:\b(?:sq|cu|кв)\.|\d)\s*\w$", s[max(0, m.start() - 8) : m.start()]):
        # A unit after a figure ends a sentence before a capital.
        return 3.0 if upper else NEVER
    if word in MONTHS and number:
        return NEVER
    if word in LEADING and not initial:
        if word == one_look("г") and upper and re.search(r"\d\s*г$", s[max(0, m.start() - 7) : m.start()]):
            return 2.0
        return 0.6 if word in ("no", "s", "p", "art", "min", "par") and upper and len(nxt[0] if nxt else "") > 1 and after in OPENERS else NEVER
    if word in NAME_PARTS:
        return NEVER if after in NAME_ENDS or first.islower() else 0.2 if after in OPENERS else -2.5
    if word in TRAILING and not initial or "." in word and len(letters) < 6:
        if first.islower() or word in SCALES and (first in "€$£₽₹¥" or after in CURRENCIES) or number and word in MONTHS or after in NAME_ENDS and word not in ("etc", "cr"):
            return NEVER
        if "." in word and len(letters) < 3 and word not in TRAILING:
            return 0.5 if after in OPENERS else NEVER
        return 1.5 if upper or number else NEVER
    if len(letters) == 1 and letters.isalpha() and not "ऀ" <= letters <= "࿿":
        # An initial, unless it is a unit or grade after a figure.
        before = s[max(0, m.start() - 8) : m.start()]
        return 2.0 if re.search(r"[\d°]\s*\w$", before) or re.search(r"(?:deg|grade|class)\s\w$", before) else 0.3 if after in OPENERS and not before.rstrip().endswith(".") and len(nxt[0]) > 1 and letters not in "abcdefghijklmnopqrstuvwxyz" else NEVER
    if first in ",;:)]”»":
        return NEVER
    return 4.0 if not first.islower() or len(letters) > 3 else 3.3


# Function words that open sentences: articles, pronouns, prepositions, conjunctions, question words and forms
# of "be", "do" and "see", of the languages with capitals.
OPENERS = _listed(
    "a an the this that these those it its he she they we i you his her their our my your there here in on at by for from of to with without under over between among during since until after before about against as if when while where why who what "
    "which how although though because but and or so yet nor both either neither each every all some any no not is are was were be been do does did has have had can could may might must shall should will would according however moreover see note "
    "der die das den dem des ein eine einer einem einen dieser diese dieses es er sie wir ihr im am in an auf bei mit nach von vor zu zum zur aus um für gegen ohne unter über zwischen seit während wegen als wenn weil dass ob doch aber und oder auch nicht kein keine laut wie was wer wo warum siehe "
    "le la les l un une des du de ce cet cette ces il elle ils elles on nous vous son sa ses leur leurs en au aux dans par pour sur sous avec sans chez entre selon depuis pendant avant après contre si quand comme que qui où pourquoi mais et ou donc ni ne voir "
    "el los las lo una unos unas este esta estos estas ese esa ello ella ellos su sus en al del por para con sin sobre bajo entre desde hasta según durante tras ante contra si cuando como que quien donde pero y o ni no se véase ¿por ¿qué ¿cuándo "
    "в во на по к ко от до из за с со у о об при для без под над между через после перед это этот эта эти он она оно они мы вы его её их не ни но и или а что кто как где когда почему если чтобы также см"
)


def _opening(follows: str) -> float:
    """How well the text opens a sentence."""
    c = follows[:1]
    if c in ",;:)]}”»’」』）】、，；：%":
        return NEVER
    if c in "“„«「『¿¡‘\"" or c.isupper():
        return 1.0
    if c.islower():
        return -1.0
    return 0.5


def _length(words: int) -> float:
    return (-1.0 if words == 1 else 0.0) - 0.02 * max(0, words - 45)


def block_spans(s: str, is_item: bool = False) -> list[tuple[int, int]]:
    """Sentence spans of one block, best total score over all ways to cut it at candidate ends.

    The score of a span adds its length, its opening and closing words, and whether quotations and brackets are
    balanced inside it. Every span scores as a whole; the best chain of spans is found in one pass.
    """
    n = len(s)
    if is_item:
        return [(0, n)]
    ends: dict[int, tuple[int, float]] = {}
    thai = _is_thai(s)
    for m in _END.finditer(s):
        stop = m.end()
        mark = m[0]
        while mark and mark[-1] in "“\"" and stop < n and not s[stop].isspace() and s[stop].isalpha() and mark[-1] != "”":
            # The last mark opens the next quotation rather than closing this one.
            mark, stop = mark[:-1], stop - 1
        nxt = stop
        while nxt < n and s[nxt].isspace():
            nxt += 1
        if nxt >= n:
            continue
        if thai and m[0][0] == "." and "฀" <= s[m.start() - 1 : m.start()] <= "๿":
            continue
        score = _closing(s, m, s[nxt : nxt + 100], nxt == stop)
        if score > NEVER:
            ends[stop] = (nxt, score)
    if thai:
        for m in _THAI_GAP.finditer(s):
            near = s[m.end() : m.end() + 1]
            if re.fullmatch(r"\s*\d+[.)]?", s[: m.start()]):
                continue
            score = 3.5 if "฀" <= near <= "๿" else 2.0 if near.isupper() else -3.0
            ends.setdefault(m.start(), (m.end(), score))
    if not ends:
        return [(0, n)]
    marks = _pairs(s)
    cuts = sorted(ends)
    points = [(0, 0, 0.0), *((e, *ends[e]) for e in cuts), (n, n, 4.0)]
    inside = [0.0] * len(points)
    for lo, hi, quote in marks:
        for k in range(1, len(points) - 1):
            e = points[k][0]
            if e > hi:
                break
            if lo < e <= hi:
                inside[k] += 7.0 if quote else 5.0
    opening = [1.0, *(_opening(s[p[1] : p[1] + 2]) for p in points[1:])]
    # Words up to each point, so that the length of any span is a difference.
    starts = [w.start() for w in _WORD.finditer(s)] if not thai else list(range(0, n, 4))
    upto = [bisect_left(starts, p[0]) for p in points]
    best = [0.0] * len(points)
    back = [0] * len(points)
    # The most that a span from a point, or from one before it, can start with.
    most = [0.0] * len(points)
    for j in range(1, len(points)):
        top, at = -1e18, j - 1
        if j > 1:
            most[j - 1] = max(most[j - 2], best[j - 1] + opening[j - 1] - inside[j - 1])
        else:
            most[0] = best[0] + opening[0] - inside[0]
        # From the shortest span to the longest, until the bound shows that no longer one can win.
        for i in range(j - 1, -1, -1):
            words = upto[j] - upto[i]
            if most[i] - 0.02 * max(0, words - 45) - 2.0 < top - 1e-9:
                break
            if 1 < words <= 45:
                length = 0.0
            elif not words:
                length = -4.0
            else:
                length = _length(words)
            # A cut costs as much as an average boundary earns, so weak boundaries are left inside.
            value = best[i] + opening[i] + length - inside[i] - 2.0
            if value >= top:
                top, at = value, i
        best[j] = top + points[j][2] - inside[j]
        back[j] = at
    spans, j = [], len(points) - 1
    while j:
        i = back[j]
        spans.append((points[i][1], points[j][0]))
        j = i
    return spans[::-1]


def sentence_spans(text: str | None) -> list[tuple[int, int]]:
    """Spans ``(start, end)`` in code points of every sentence unit of a text, in order; null or blank gives none."""
    if not text or text.isspace():
        return []
    kept: list[int] | None = None
    s = text
    if _HIDDEN.search(text):
        # Invisible characters take no part in the decision; offsets lead back to the stored text.
        kept = [i for i, c in enumerate(text) if c not in UNSEEN]
        s = "".join([text[i] for i in kept])
    out: list[tuple[int, int]] = []
    covered = 0
    for start, end, is_item in blocks(s):
        for lo, hi in block_spans(s[start:end], is_item):
            a, b = start + lo, start + hi
            while a < b and s[a].isspace():
                a += 1
            while b > a and s[b - 1].isspace():
                b -= 1
            if a == b:
                continue
            if kept is None:
                out.append((a, b))
                continue
            # Invisible characters next to a sentence belong to it, those between two to the earlier one.
            x, y = kept[a], kept[b - 1] + 1
            while x > covered and text[x - 1] in UNSEEN:
                x -= 1
            while y < len(text) and text[y] in UNSEEN:
                y += 1
            covered = y
            out.append((x, y))
    if kept is not None:
        taken = {x for x, _ in out} | {y for _, y in out}
        out += [(m.start(), m.end()) for m in _LONE.finditer(text) if m.start() not in taken and m.end() not in taken and not any(x < m.end() and m.start() < y for x, y in out)]
        out.sort()
    return out


def sentences(documents: DataFrame) -> DataFrame:
    """Every sentence unit of every document: ``doc_id, sent_start, sent_end``, distinct.

    Offsets count code points of the stored text from 0, the end is exclusive, outer white space is left out, closing
    marks and quotes are kept. Headings, list items and blocks without punctuation are units of their own; a text is
    processed whole, whatever its length. Null, empty and blank texts have no units; a document stored twice under one
    id gives the units of each text once; extra columns are not read.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(d, x, y) for d, t in zip(b["doc_id"], b["text"], strict=True) for x, y in dict.fromkeys(sentence_spans(t))]
            yield pd.DataFrame(rows, columns=["doc_id", "sent_start", "sent_end"])

    texts = documents.select("doc_id", "text").where("doc_id is not null and text is not null")
    # Doubles are dropped among the narrow spans: the texts themselves are never shuffled.
    return spread(texts).mapInPandas(run, "doc_id bigint, sent_start int, sent_end int").distinct()
