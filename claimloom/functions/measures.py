"""Tokens and similarity of measure names, as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .entities import strip_accents

# Words that carry no meaning in a measure name, and words that make it a different measure.
STOPWORDS = "a an the of in for on at to from by with and or as its their this that these those rate value amount figure level number quantum size is was are were be been being".split()
MARKERS = "growth change increase decrease decline rise fall expansion contraction reduction addition accretion drawdown depletion share proportion percentage margin ratio contribution weight per capita average mean median cumulative incremental net gross forecast projection target estimate".split()


def singular(token: Column) -> Column:
    return (
        F.when(token == "indices", "index")
        .when(token == "analyses", "analysis")
        .when(F.length(token) <= 3, token)
        .when(token.endswith("ies"), F.regexp_replace(token, "ies$", "y"))
        .when(token.rlike("(?:ses|xes)$"), F.regexp_replace(token, "es$", ""))
        .when(token.rlike("[^s]s$"), F.regexp_replace(token, "s$", ""))
        .otherwise(token)
    )


def tokens_of_plain(text: Column) -> Column:
    words = F.transform(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1)), singular)
    kept = F.array_sort(F.array_distinct(F.filter(words, lambda w: ~w.isin(STOPWORDS))))
    return kept


def tokenise_measure(text: Column) -> Column:
    """Distinct tokens of a measure name in order: accents folded, singular first, stop words then dropped."""
    return tokens_of_plain(strip_accents(text))


def markers_of(tokens: Column) -> Column:
    """Tokens that make a derived measure (growth, share, per, capita, ...)."""
    return F.array_intersect(tokens, F.array(*map(F.lit, MARKERS)))


def slug(tokens: Column) -> Column:
    return F.when(F.size(tokens) > 0, F.array_join(tokens, "_")).otherwise("unnamed")


def token_weight(observations: Column, df: Column) -> Column:
    """Rarity of a token among the names seen so far, at least 0.15."""
    return F.greatest(F.lit(0.15), F.log((observations + 1) / (df + 1)) + 1)
