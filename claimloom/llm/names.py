"""Variant spellings of names: exact radius joins in metric-space cells, then groups of spellings."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import IntegerType

from ..session import materialise, tidied
from .components import hash_to_min
from .lookalikes import one_look

#: Least radius of the exact join on the distinctive part of a name, in edits (insert, delete, replace: a true metric).
RADIUS = 2
#: Lengths of the shorter string from which the join must reach further, so that every pair ``verdict`` can take is met:
#: it takes ``_most`` edits with a swap as one, and a swap is two edits of the metric.
REACH = ((14, 6), (7, 4))
#: Strings from which a cell is split, the most pivots of one split, and the most levels of splits.
CELL = 400
FANOUT = 64
LEVELS = 6
#: Most pivots that are broadcast; a larger table is joined by shuffle.
MAX_BROADCAST_PIVOTS = 100_000

# Words before and after a name that do not tell entities apart.
FRONT = frozenset("the m/s messrs mr mrs ms miss dr prof shri sri smt sh hon sir capt col gen rev govt government kumari".split())
LEGAL = {
    "limited": "ltd lmtd", "private": "pvt pte", "incorporated": "inc incorp", "corporation": "corp corpn", "company": "co comp", "holdings": "hldgs hldg holding",
    "gmbh": "", "llp": "", "llc": "", "plc": "", "sa": "", "nv": "", "bv": "", "ag": "", "group": "grp",
}
# Kinds of offices and what they deal with; words of business; short forms after each. The lists are general;
# short forms that are the beginning of a word need no entry.
OFFICES = {
    "ministry": "min", "department": "dept deptt dpt", "directorate": "dte dir", "institute": "inst", "board": "bd", "bureau": "", "authority": "auth", "commission": "comm", "council": "", "agency": "",
    "secretariat": "", "inspectorate": "", "tribunal": "", "registry": "",
}
BUSINESS = {
    "manufacturing": "mfg mfr manuf manufg", "industries": "ind inds industry", "power": "pwr", "metals": "mtls metal", "development": "dev devt dvlpt", "bank": "bk", "foods": "fds food", "mills": "mls",
    "mining": "mng min", "ports": "pts", "trading": "trdg trd", "transmission": "transm trans", "agro": "agr", "works": "wks", "shipping": "shpg ship", "textile": "tex textiles txt", "international": "intl int",
    "cement": "cmt cem", "railways": "rly rlys rlwys railway", "engineering": "eng engg engrg", "chemicals": "chem chems", "logistics": "logist logs log", "finance": "fin", "steel": "stl", "telecommunications": "telecom telecoms tel",
    "products": "prod prods", "renewables": "renew renewable ren", "infrastructure": "infra infrastr infrast", "pharmaceuticals": "pharm pharma pharmas", "insurance": "ins insur", "energy": "enrg",
    "semiconductors": "semicond semiconductor semicon", "technologies": "techn technology", "systems": "syst", "services": "svcs svc", "solutions": "soln solns", "airlines": "airl airline", "automotive": "automot", "breweries": "brew brewery", "broadcasting": "bcast",
    "construction": "constr", "consulting": "consult", "electronics": "electr electron", "entertainment": "entmt", "fertilisers": "fert fertilizers", "hospitals": "hosp hospital", "hotels": "hotel", "laboratories": "labs lab laboratory", "machinery": "mach",
    "packaging": "pkg packg", "petroleum": "petrol petr", "plastics": "plast", "properties": "props", "publishing": "publ", "refineries": "refin refinery", "software": "softw", "transport": "transp", "investments": "invest invts", "securities": "secs",
}
SUBJECTS = {
    "water": "wtr", "supply": "sup", "roads": "rds", "public": "pub", "health": "hlth", "census": "cens", "prices": "prc", "revenue": "rev", "credit": "cr", "rural": "rur", "fisheries": "fish fshrs", "statistics": "stats", "labour": "lab", "trade": "", "planning": "",
    "defence": "defense", "education": "educ", "transport": "transp", "environment": "environ", "justice": "", "agriculture": "agric", "housing": "", "taxes": "tax", "customs": "", "forests": "forestry", "tourism": "", "culture": "", "research": "res",
}
# Given names with their short and foreign forms. A list is never whole: of other names, short forms that are
# the beginning of the name are read as such.
GIVEN = {
    "dorothy": "dolly dot dottie dorothea", "alexander": "alex sandy sasha aleksandr alec", "francisco": "pancho paco frank francesco cisco", "vijay": "bijoy wijay vijai veejay", "giuseppe": "beppe jino gino peppe gius", "robert": "bob robt rob bobby bert",
    "jose": "pepe joe", "mohammed": "mohd muhammad mohamed md mohammad", "susanna": "sue susie suzanna susan", "venkatesh": "venky venkat venkatesan", "ekaterina": "yekaterina katya caterina", "elizabeth": "liz beth betty eliza lizzie elisabeth",
    "theodore": "theo ted teddy", "johannes": "hans hannes jan johann johan", "william": "will bill wm billy", "natalia": "nataliya natasha natalya nathalie", "katherine": "catherine kate kathy kathryn katharine kitty", "margaret": "meg peggy maggie marge",
    "chandrashekhar": "chandru chandra shekhar chandrasekhar", "lakshmi": "laxmi lakshmy", "richard": "dick rick", "james": "jim jimmy", "john": "jack johnny", "michael": "mike", "thomas": "tom",
    "anthony": "tony antony", "andrew": "andy", "charles": "charlie chuck", "daniel": "danny", "frederick": "fred freddie", "gregory": "greg", "jennifer": "jenny", "joseph": "joey", "kenneth": "kenny", "lawrence": "larry laurence",
    "matthew": "matt", "nicholas": "nick nicolas", "patricia": "patty", "peter": "pete pyotr", "philip": "phil phillip", "rebecca": "becky", "samuel": "sammy", "stephen": "steve steven", "victoria": "vicky", "dmitri": "dmitry dima", "sergei": "sergey sergio serge",
    "christopher": "chris topher", "edward": "eddie ned", "david": "dave", "benjamin": "benny", "timothy": "timmy", "donald": "donny", "gerald": "gerry", "walter": "wally", "harold": "harry", "henry": "hank", "ernest": "ernie", "jeffrey": "geoffrey geoff", "patrick": "paddy",
    "deborah": "debbie", "judith": "judy", "cynthia": "cindy", "christine": "christina kristina", "jacqueline": "jackie", "theresa": "teresa", "virginia": "ginny", "isabella": "isabel", "mikhail": "misha", "vladimir": "volodya vova", "tatiana": "tanya tatyana",
    "anastasia": "nastya", "ignacio": "nacho", "guillermo": "memo", "rafael": "rafa", "manuel": "manolo", "giovanni": "gianni", "friedrich": "fritz", "heinrich": "heinz", "srinivasan": "srini", "balakrishnan": "balu", "subramaniam": "subbu",
}


# Words that stand together in a field or a subject.
TOGETHER = [("mining", "metals"), ("power", "transmission"), ("textile", "mills"), ("development", "bank"), ("engineering", "works"), ("shipping", "ports"), ("international", "trading"), ("agro", "products"), ("water", "supply"), ("public", "health"), ("rural", "credit")]


def _forms(table: dict[str, str]) -> dict[str, str]:
    return {form: word for word, forms in table.items() for form in (word, *forms.split())}


_LEGAL, _OFFICE, _BUSINESS, _SUBJECT, _GIVEN = map(_forms, (LEGAL, OFFICES, BUSINESS, SUBJECTS, GIVEN))
_LINKING = frozenset("of for and the an de".split())


def edits(a: str, b: str, most: int) -> int:
    """Edits between two words, a swap of neighbours counting one; ``most + 1`` when there are more."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    before: list[int] = []
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        after = [i]
        for j, y in enumerate(b, 1):
            v = min(row[j] + 1, after[-1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, before[j - 2] + 1)
            after.append(v)
        if min(after) > most:
            return most + 1
        before, row = row, after
    return min(row[-1], most + 1)


def _sound(word: str) -> str:
    for written, heard in (("ee", "i"), ("oo", "u"), ("ph", "f"), ("y", "i")):
        word = word.replace(written, heard)
    return word


def _partner(found: set[str], words: list[str], forms: dict[str, str], keep: int) -> None:
    """Adds to ``found`` the other half of a pair such as "water supply" when a word is written nearly like it.

    The first ``keep`` words set the name apart and are taken only when they are very nearly the lacking one.
    """
    for pair in TOGETHER:
        for have, lack in (pair, pair[::-1]):
            if have in found and lack not in found:
                near = [(edits(w, form, 2), w) for w in words[keep:] for form, canon in forms.items() if canon == lack and len(w) > 2 and len(form) > 2]
                best = min((x for x in near if x[0] <= (2 if len(x[1]) > 3 else 1)), default=None)
                if best is None and keep and len(words[0]) > 4 and edits(words[0], lack, 2) <= (2 if len(words[0]) > 8 else 1):
                    best = (1, words[0])
                if best:
                    found.add(lack)
                    words.remove(best[1])


@lru_cache(maxsize=100_000)
def _known(word: str, which: str) -> str | None:
    """The listed word that ``word`` is a form or a misspelling of."""
    forms = {"legal": _LEGAL, "office": _OFFICE, "business": _BUSINESS, "subject": _SUBJECT, "given": _GIVEN}[which]
    if word in forms:
        return forms[word]
    sounds = _sound(word)
    if len(word) > 4 and (heard := next((canon for form, canon in forms.items() if len(form) > 4 and _sound(form) == sounds), None)):
        return heard
    if len(word) < 3 or len(word) < 4 and which != "given":
        return None
    for read, meant in (("cl", "d"), ("rn", "m"), ("vv", "w")):
        if read in word and (fixed := word.replace(read, meant)) in forms:
            return forms[fixed]
    best, at = 3, None
    for form, canon in forms.items():
        n = min(len(form), len(word))
        most = 2 if n >= 9 or n >= 7 and which == "given" else 1 if n >= 5 or n == 4 and (form == canon and which == "business" or which == "given" and len(form) == 5) or which == "given" and form == "jose" else 0
        if most and (d := edits(word, form, most)) <= most and d < best and (n > 5 or word[0] == form[0] or d == 1 and word[1:2] == form[1:2]):
            best, at = d, canon
    return at


def _words(name: str) -> tuple[list[str], bool]:
    """Words of a name as typed, accents and case folded, and whether a comma inverts it."""
    text = unicodedata.normalize("NFD", one_look(name))
    text = "".join(c for c in text if not unicodedata.combining(c))
    text = re.sub(r"(?i)\bm\s*/\s*s\b\.?", " messrs ", text)
    text = re.sub(r"\(\s*[Pp]\s*\)", " private ", text)
    text = re.sub(r"(?<=[a-z]{2})(?=[A-Z][a-z])", " ", text)
    text = re.sub(r"\b((?:\w\.){2,})", lambda m: m[1].replace(".", "") + " " if len(m[1]) > 6 else m[1], text)
    text = re.sub(r"(?<=\w\w)\.(?=\w{1,2}\b)", "", text)
    text = text.lower().replace("'", "").replace("’", "").replace("&", " and ")
    text = re.sub(r"(?<=[a-z])[015]|[015](?=[a-z])", lambda m: {"0": "o", "1": "l", "5": "s"}[m[0]], text)
    head, comma, tail = text.partition(",")
    split = lambda s: re.findall(r"[^\W_]+", s)
    if comma and len(split(head)) == 1 and split(tail):
        return split(tail) + split(head), True
    return split(text), False


@lru_cache(maxsize=50_000)
def profile(name: str) -> tuple[str, str, str, str] | None:
    """``(class, first, second, last)`` of a name, or None where it names nobody.

    A class is what must agree word for word: the field of a firm, the kind and subject of an office, "p" for persons.
    The rest is compared with tolerance: the distinctive words of a firm, the place of an office, the given, middle
    and family name of a person.
    """
    words, inverted = _words(name)
    while words and words[0] in FRONT or words[:2] == ["office", "of"] or words[:1] == ["of"]:
        words = words[2:] if words[0] == "office" else words[1:]
    words = [w for w in words if w not in _LINKING]
    if not words:
        return None
    kinds = [w for w in words if _known(w, "office")]
    if len(words) == 2 and kinds == words[:1] and words[1] not in _LEGAL and words[1] not in _BUSINESS:
        # An office known by its subject alone.
        return (f"o|{_known(words[0], 'office')}", "", "", _known(words[1], "subject") or words[1])
    if kinds and (any(_known(w, "subject") for w in words) or any(w in OFFICES and w != "agency" for w in kinds) and len(words) > 2):
        seen, place = {_known(w, "office") for w in kinds}, []
        for w in words:
            if w in kinds or w in ("office", "govt", "government"):
                continue
            part = _known(w, "subject")
            (seen.add(part) if part else place.append(w))
        _partner(seen, place, _SUBJECT, 0)
        if not any(x in SUBJECTS for x in seen) and len(place) > 1:
            near = {_SUBJECT[f]: w for w in place for f in _SUBJECT if len(w) > 3 and len(f) > 3 and edits(w, f, 1) <= 1}
            if len(near) == 1:
                part, w = next(iter(near.items()))
                seen.add(part)
                place.remove(w)
        return ("o|" + " ".join(sorted(seen)), "", "", "".join(place)) if place else None
    legal = [w for w in words if _known(w, "legal")]
    left = [w for w in words if not _known(w, "legal")]
    given_here = not legal and any(w in _GIVEN for w in left)
    exact = {w: _BUSINESS[w] for i, w in enumerate(left) if w in _BUSINESS and len(w) > 1 and (i or w not in ("dev", "min"))} if not given_here else {}
    fields = set(exact.values())
    core = [w for w in left if w not in exact]
    _partner(fields, core, _BUSINESS, 1 if len(core) > 1 else 0)
    if not fields and not given_here:
        # No field is written out: take the words that are nearly one, but never the first.
        close = {w: f for w in core[1:] if (f := _known(w, "business"))} or {w: f for w in core[:1] if len(core) > 1 and len(w) > 5 and (f := _known(w, "business"))}
        if not close and legal and len(core) > 1 and len(core[-1]) > 2:
            near = {c for f, c in _BUSINESS.items() if len(f) > 2 and edits(core[-1], f, 1) <= 1}
            close = {core[-1]: next(iter(near))} if len(near) == 1 else {}
        fields = set(close.values())
        core = [w for w in core if w not in close]
        _partner(fields, core, _BUSINESS, 1 if len(core) > 1 else 0)
    if legal or fields:
        if not core or all(len(w) < 2 for w in core) or core in (["our"], ["we"], ["this"], ["said"], ["issuer"]):
            return None
        # "Pharmaceutical" words of one firm are one set, so their order and case do not count.
        return ("c|" + " ".join(sorted(fields)), *(core + ["", ""])[:2], "".join(core[2:]))
    if words in (["we"], ["us"], ["our"], ["it"], ["they"]) or words[0] in ("our", "this", "said") or len(words) == 1 and (_known(words[0], "office") or words[0] in ("issuer", "organisation", "organization", "entity", "firm", "management")):
        return None
    given = next((i for i, w in enumerate(words) if w in _GIVEN), None)
    if given is None:
        given = next((i for i, w in enumerate(words) if _known(w, "given")), None)
    if given is None:
        given = next((i for i, w in enumerate(words) if len(w) == 1), 0)
    words = words[given:] + words[:given]
    first = _known(words[0], "given") or words[0]
    if len(words) == 1:
        return ("p", "", "", words[0])
    return ("p", first, "".join(words[1:-1]), words[-1])


def heads(p: tuple[str, str, str, str]) -> list[str]:
    """The distinctive strings of a profile, at most four; related profiles have two within ``RADIUS``, or ``REACH`` for long ones."""
    cls, first, second, last = p
    if cls == "p" and len(first) > 1 and first not in GIVEN:
        # Which outer word is the family name is not known: either may be the other's.
        return sorted({first, last})
    if cls[0] != "c":
        return [last]
    found = {w for w in (first, second) if len(w) > 1} | {first + second + last}
    if second and len(second) > 1:
        found.add(second + first + last)
    return sorted(found)


def level(p: tuple[str, str, str, str]) -> int:
    """0: a whole name, 1: a name with a part left out, 2: a name with initials."""
    cls, first, second, last = p
    if cls[0] == "o":
        return 0
    if len(first) == 1 or len(second) == 1:
        return 2
    return 0 if second else 1


def _most(n: int) -> int:
    return 0 if n < 4 else 1 if n < 7 else 2 if n < 14 else 3


def _near(a: str, b: str) -> bool:
    return edits(a, b, m := _most(min(len(a), len(b)))) <= m


def _covers(whole: str, part: str) -> bool:
    """Whether ``part`` can stand for ``whole``: left out, an initial, its beginning, or a near spelling."""
    return not part or (whole[:1] == part if len(part) == 1 else _near(whole, part) or _begins(whole, part))


def _begins(whole: str, part: str) -> bool:
    """Whether ``part`` is ``whole`` cut short: at least four letters, and at least three are gone."""
    return len(part) > 3 and len(whole) > len(part) + 2 and whole.startswith(part)


def verdict(a: tuple[str, str, str, str], b: tuple[str, str, str, str]) -> int:
    """1: spellings of one name at the same level. 2: the one with more left out may be the other. 0: neither."""
    if a[0] != b[0]:
        return 0
    la, lb = level(a), level(b)
    if a[0][0] == "o":
        return int(_near(a[3], b[3]))
    if a[0][0] == "c":
        joined = [x[1] + x[2] + x[3] for x in (a, b)]
        turned = a[2] + a[1] + a[3]
        if 2 not in (la, lb) and (_near(*joined) or a[2] and _near(turned, joined[1])):
            return 1
        if la == lb == 2:
            return int(_near(*joined))
        if la == lb:
            return 0
        whole, part = (a, b) if la < lb else (b, a)
        straight = _covers(whole[1], part[1]) and (not part[2] or _covers(whole[2], part[2])) and (len(part[1]) > 1 or len(part[2]) > 1)
        swapped = bool(part[2]) and _covers(whole[2], part[1]) and _covers(whole[1], part[2]) and (len(part[1]) > 1 or len(part[2]) > 1)
        return 2 if straight or swapped else 0
    straight = _person(a, b, la, lb)
    if straight or la != lb or la == 2 or not (a[1] and b[1]) or a[1] in GIVEN or b[1] in GIVEN:
        return straight
    # Without a listed given name either may have its family name first.
    return _person(a, _turned(b), la, lb) or _person(_turned(a), b, la, lb)


def _turned(p: tuple[str, str, str, str]) -> tuple[str, str, str, str]:
    """A person's name read with the family name first."""
    return (p[0], p[2], p[3], p[1]) if p[2] else (p[0], p[3], "", p[1])


def _person(a: tuple[str, str, str, str], b: tuple[str, str, str, str], la: int, lb: int) -> int:
    """``verdict`` of two persons, in the order they are written."""
    if not _near(a[3], b[3]):
        return 0
    if la == lb:
        one = (a[1] == b[1] or len(a[1]) > 1 and len(b[1]) > 1 and (_near(a[1], b[1]) or _begins(a[1], b[1]) or _begins(b[1], a[1])) and not (a[1] in GIVEN and b[1] in GIVEN)) and (a[2] == b[2] or _near(a[2], b[2]) and min(len(a[2]), len(b[2])) > 1)
        if la == 2:
            one = a[1] == b[1] and a[2] == b[2]
        return int(one and edits(a[2], b[2], 3) + edits(a[3], b[3], 3) <= 3)
    whole, part = (a, b) if la < lb else (b, a)
    return 2 if part[1] and _covers(whole[1], part[1]) and (_covers(whole[2], part[2]) if whole[2] else not part[2]) else 0


_PARSED = "entity string, cls string, key string, level int, heads array<string>"
_SEP = "\x1f"


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for e in b["entity"]:
            p = profile(e)
            if p:
                rows.append((e, p[0], _SEP.join(p), level(p), heads(p)))
        yield pd.DataFrame(rows, columns=["entity", "cls", "key", "level", "heads"])


@pandas_udf(IntegerType())
def _verdict_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([verdict(tuple(x.split(_SEP)), tuple(y.split(_SEP))) for x, y in zip(a, b, strict=True)], dtype="int32")


def _split(home: DataFrame, probe: DataFrame, level: int) -> tuple[DataFrame, DataFrame, bool]:
    """One level of cells: parts of more than ``CELL`` strings are divided among pivots of their own.

    ``home``: part, y. ``probe``: part, x, r. A string belongs to the cell of its nearest pivot. Each cell knows the
    least and the greatest distance of its strings to the pivot. A probe is copied to a cell only where, by the triangle
    inequality, a partner can live: its own distance lies within ``r`` of those two, and is at most ``2 r`` above its
    distance to the nearest pivot. Pivots travel as one array a part, so no pair of string and pivot becomes a row.
    """
    sizes = home.groupBy("part").agg(F.count("*").alias("n"))
    big, _ = materialise(sizes.where(F.col("n") > CELL), "big")
    if big.isEmpty():
        return home, probe, False
    chosen = home.join(big, "part").withColumn("z", F.xxhash64("y", F.lit(level)))
    share = f"greatest(2, n div {FANOUT} + 1, {CELL // 4})"
    pivots = chosen.groupBy("part").agg(F.expr(f"collect_list(if(pmod(z, {share}) = 0, y, null))").alias("p"), F.min("y").alias("least")).selectExpr("part", "if(size(p) = 0, array(least), array_sort(p)) as pivots")
    pivots, _ = materialise(pivots, "pivots")
    small = pivots.agg(F.coalesce(F.sum(F.size("pivots")), F.lit(0)).alias("n")).first()["n"] <= MAX_BROADCAST_PIVOTS
    hint = F.broadcast if small else (lambda df: df)
    placed = home.join(hint(pivots), "part").withColumn("d", F.expr("transform(pivots, p -> levenshtein(y, p))")).selectExpr("part", "y", "cast(array_position(d, array_min(d)) as int) as cell", "array_min(d) as dy")
    placed, _ = materialise(placed, "cells")
    cover = placed.groupBy("part", "cell").agg(F.min("dy").alias("lo"), F.max("dy").alias("hi")).groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("cell", F.struct("lo", "hi")))).alias("cover"))
    # Only parts that were divided have a row here.
    met = probe.join(hint(pivots.join(cover, "part")), "part", "left")
    copies = met.where("pivots is not null").withColumn("ds", F.expr("transform(pivots, p -> levenshtein(x, p))")).withColumn("least", F.expr("array_min(ds)"))
    copies = copies.selectExpr("part", "x", "r", "explode(filter(transform(ds, (v, i) -> struct(i + 1 as cell, v as dx)), s -> s.dx <= least + 2 * r and s.dx <= cover[s.cell].hi + r and s.dx >= cover[s.cell].lo - r)) as s")
    new_part = lambda cell: F.concat_ws(".", "part", F.col(cell).cast("string"))
    home_after = home.join(hint(pivots.select("part")), "part", "left_anti").unionByName(placed.select(new_part("cell").alias("part"), "y"))
    probe_after = met.where("pivots is null").select("part", "x", "r").unionByName(copies.select(new_part("s.cell").alias("part"), "x", "r"))
    return materialise(home_after, "home")[0], materialise(probe_after, "probe")[0], True


def radius_join(points: DataFrame, radius: int = RADIUS, reach: tuple[tuple[int, int], ...] = ()) -> DataFrame:
    """All pairs ``(cls, x, y)``, ``x < y``, of distinct strings of one class within ``radius`` edits. Exact.

    ``reach`` gives a larger radius, as ``(least length, radius)`` from the longest on, to pairs whose shorter string
    has that length.

    Strings are parted by class and length first, because lengths differ by no more than the edits: the longer string of
    a pair (of two equally long ones the greater) visits the parts of its partner's possible lengths. Parts of more than
    ``CELL`` strings are divided into cells around pivots, and so are these cells with pivots of their own, until all
    are small enough or ``LEVELS`` deep; ``_split`` says which cells a string visits. The edit distance itself is
    computed inside the cells. A string has one home cell, so no pair is met twice.
    """
    distinct = points.select("cls", "head").where("head is not null and head <> ''").distinct()
    by = "case " + " ".join(f"when l >= {least} then {r}" for least, r in reach) + f" else {radius} end" if reach else str(radius)
    widest = max([radius, *(r for _, r in reach)])
    points_, _ = materialise(distinct.withColumn("n", F.length("head")), "points")
    home = points_.selectExpr("concat(cls, '|', n) as part", "head as y")
    probe = points_.selectExpr("cls", "head as x", "n", f"explode(sequence(greatest(1, n - {widest}), n)) as l").selectExpr("concat(cls, '|', l) as part", "x", f"{by} as r", "n - l as apart").where("apart <= r").drop("apart")
    for level in range(LEVELS):
        home, probe, divided = _split(home, probe, level)
        if not divided:
            break
    met = probe.join(home, "part").where("(length(y) < length(x) or y < x) and levenshtein(x, y, cast(r as int)) >= 0")
    return met.selectExpr("regexp_extract(part, '^(.*)[|][0-9]+[.0-9]*$', 1) as cls", "least(x, y) as x", "greatest(x, y) as y")


@tidied
def spelling_groups(names: DataFrame, column: str = "entity") -> DataFrame:
    """Group of every distinct spelling that names somebody: ``entity, group_id``.

    Spellings are parsed once each and folded into profiles; profiles are paired by ``radius_join`` on their
    distinctive parts and verified. Whole names link to whole names. A name with a part left out or with initials
    joins the group of whole names it may stand for only when there is exactly one such group: otherwise it could name
    any of several relatives, and stays apart.

    Cases: null, blank and pointing words ("the Company", "we") have no row; equal spellings count once however many
    rows carry them; very long names are parsed like others; no names give no rows; other columns are not read.
    """
    spellings = names.select(F.col(column).alias("entity")).where("entity is not null").distinct()
    parsed, _ = materialise(spellings.mapInPandas(_parse, _PARSED), "names")
    profiles = parsed.groupBy("cls", "key", "level").agg(F.first("heads").alias("heads"))
    by_head = profiles.select("cls", "key", "level", F.explode("heads").alias("head"))
    near = radius_join(by_head, reach=REACH)
    left, right = by_head.selectExpr("cls", "head as x", "key as k1"), by_head.selectExpr("cls", "head as y", "key as k2")
    alike = left.join(near, ["cls", "x"]).join(right, ["cls", "y"]).select("k1", "k2")
    same_head = left.join(right.withColumnRenamed("y", "x"), ["cls", "x"]).where("k1 < k2").select("k1", "k2")
    pairs = alike.unionAll(same_head).where("k1 <> k2").selectExpr("least(k1, k2) as k1", "greatest(k1, k2) as k2").distinct()
    judged, _ = materialise(pairs.withColumn("v", _verdict_udf("k1", "k2")).where("v > 0"), "judged")
    keys = profiles.select("key", "level")

    def grouped(links: DataFrame) -> DataFrame:
        found = hash_to_min(links, "k1", "k2").withColumnRenamed("id", "key")
        return keys.join(found, "key", "left").selectExpr("key", "level", "coalesce(group_id, key) as g")

    first, _ = materialise(grouped(judged.where("v = 1")), "whole")
    # A partial group joins the one group it may stand for, at the lowest level where it may stand for any.
    both = judged.where("v = 2").select(F.explode(F.expr("array(struct(k1 as p, k2 as w), struct(k2 as p, k1 as w))")).alias("s")).select("s.p", "s.w")
    part = first.selectExpr("key as p", "level as lp", "g as gp")
    whole = first.selectExpr("key as w", "level as lw", "g as gw")
    stands = both.join(part, "p").join(whole, "w").where("lw < lp and gp <> gw").groupBy("gp", "lw").agg(F.min("gw").alias("gw"), F.max("gw").alias("other"))
    chosen = stands.groupBy("gp").agg(F.min_by(F.struct("gw", "other"), "lw").alias("t")).where("t.gw = t.other").selectExpr("gp as k1", "t.gw as k2")
    links = judged.where("v = 1").select("k1", "k2").unionAll(chosen)
    return parsed.select("entity", "key").join(grouped(links), "key").selectExpr("entity", "g as group_id")


@tidied
def same_names(facts: DataFrame, column: str = "entity") -> DataFrame:
    """Every pair of different spellings of one entity: ``entity_a < entity_b`` by code point, distinct."""
    groups, _ = materialise(spelling_groups(facts, column), "spellings")
    a, b = groups.withColumnRenamed("entity", "entity_a"), groups.withColumnRenamed("entity", "entity_b")
    return a.join(b, "group_id").where("entity_a < entity_b").select("entity_a", "entity_b")
