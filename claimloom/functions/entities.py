"""Entity keys, as Spark expressions over an accent-free name."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from ..session import materialise, tidied

# Words dropped before a name, after it, and inside it; names that only point.
HONORIFICS = "mr mrs ms miss dr prof shri smt sri sh hon justice capt col gen rev sir".split()
SUFFIXES = "limited ltd llp llc inc incorporated corp corporation plc pvt private co company gmbh sa nv bv ag holdings group and &".split()
ARTICLES = ["the", "of", "a", "an"]
POINTING = ["the company", "our company", "the group", "the bank", "the issuer", "the corporation", "we", "us", "the organisation", "the organization"]


def _plain(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


@pandas_udf(StringType())
def _strip_accents(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else x if x.isascii() else _plain(x))


def strip_accents(text: Column) -> Column:
    """Compatibility decomposition without combining marks; plain ASCII values never leave the JVM's fast path."""
    return F.when(text.rlike(r"^\p{ASCII}*$"), text).otherwise(_strip_accents(text))


def key_of_plain(name: Column) -> Column:
    """Entity key of an accent-free name: lower case, no punctuation, no honorifics in front, no corporate suffixes
    behind, no articles unless nothing else is left."""
    text = F.regexp_replace(F.translate(F.lower(name), "‘’“”", "''''"), r"(?U)[^\w\s&']", " ")
    words = F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")
    in_list = lambda w, items: w.isin(items)

    def front(ws: Column) -> Column:
        # Index of the first word that is no honorific.
        first = F.array_position(F.transform(ws, lambda w: F.when(in_list(w, HONORIFICS), 1).otherwise(0)), 0)
        return F.when(first > 0, F.slice(ws, first.cast("int"), F.size(ws))).otherwise(F.array().cast("array<string>"))

    def back(ws: Column) -> Column:
        last = F.array_position(F.transform(F.reverse(ws), lambda w: F.when(in_list(w, SUFFIXES), 1).otherwise(0)), 0)
        return F.when(last > 0, F.slice(ws, F.lit(1), F.size(ws) - last.cast("int") + 1)).otherwise(F.array().cast("array<string>"))

    def inner(ws: Column) -> Column:
        kept = F.filter(ws, lambda w: ~in_list(w, ARTICLES))
        return F.array_join(F.when(F.size(kept) > 0, kept).otherwise(ws), " ")

    return inner(back(front(words)))


def entity_key(name: Column) -> Column:
    return key_of_plain(strip_accents(name))


def is_pointing(name: Column) -> Column:
    """Whether a name only points ("the Company", "we")."""
    return F.lower(F.trim(name)).isin(POINTING)


def initials_form(key: Column) -> Column:
    """Initials of all words but the last, then the last: "anna maria keller" gives "a m keller"."""
    w = F.split(key, " ")
    return F.array_join(F.concat(F.transform(F.slice(w, 1, F.size(w) - 1), lambda x: F.substring(x, 1, 1)), F.slice(w, -1, 1)), " ")


def _begins(x: Column, y: Column) -> Column:
    """Equal keys, or one key beginning with the other's words (first word longer than three)."""
    wx, wy = F.split(x, " "), F.split(y, " ")
    shorter = F.when(F.size(wx) <= F.size(wy), wx).otherwise(wy)
    longer = F.when(F.size(wx) <= F.size(wy), wy).otherwise(wx)
    return (x == y) | ((F.slice(longer, 1, F.greatest(F.size(shorter), F.lit(1))) == shorter) & (F.length(shorter[0]) > 3))


def same_entity(a: Column, b: Column) -> Column:
    """Equal keys, one key beginning with the other's words (first word longer than three), or equal initials forms.
    An empty key is nobody's."""
    # No ``let`` here: the accent-folding UDF may not stand inside a lambda.
    x, y = entity_key(a), entity_key(b)
    several = (F.size(F.split(x, " ")) >= 2) & (F.size(F.split(y, " ")) >= 2)
    return F.when((x == "") | (y == ""), False).otherwise(_begins(x, y) | (several & (initials_form(x) == initials_form(y))))


@tidied
def same_pairs(keyed: DataFrame) -> DataFrame:
    """Pairs ``a < b`` of distinct ``entity`` values with their ``key`` that ``same_entity`` holds for, each once.

    A key meets the keys that are one of its own beginnings, and those of its initials form, so that the joins give little
    but pairs of the result however many names share a first word. Keys are written first, and
    filtered only then: else each use computes them, and a filter on them passes below the ``distinct`` of the names.
    """
    written, _ = materialise(keyed.select("entity", "key"), "entities")
    named = written.where("key <> ''")
    words = F.split("key", " ")
    begun = F.transform(F.sequence(F.lit(1), F.size(words)), lambda n: F.array_join(F.slice(words, 1, n), " "))
    longer = named.select(F.col("entity").alias("y"), F.col("key").alias("whole"), F.explode(begun).alias("key"))
    first = F.split("key", " ")[0]
    met = named.withColumnRenamed("entity", "x").join(longer, "key").where(F.when(F.col("key") == F.col("whole"), F.col("x") < F.col("y")).otherwise(F.length(first) > 3))
    several = named.where(F.size(words) >= 2).withColumn("ini", initials_form(F.col("key")))
    short = several.selectExpr("entity as x", "key as kx", "ini").join(several.selectExpr("entity as y", "key as ky", "ini"), "ini").where("x < y").where(~_begins(F.col("kx"), F.col("ky")))
    return met.select("x", "y").unionAll(short.select("x", "y")).selectExpr("least(x, y) as a", "greatest(x, y) as b")
