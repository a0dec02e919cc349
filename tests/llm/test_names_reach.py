"""Spellings further apart than the least radius, with no spelling in between."""

import itertools
import random

from claimloom.llm import names


def groups(spark, *spellings):
    rows = names.spelling_groups(spark.createDataFrame([(x,) for x in spellings], "entity string")).collect()
    found: dict[str, set[str]] = {}
    for r in rows:
        found.setdefault(r.group_id, set()).add(r.entity)
    return sorted(map(sorted, found.values()))


def test_two_swaps_are_met(spark):
    assert groups(spark, "Robert Giarsela", "Robert Giraseal", "Robert Halvorsen") == [["Robert Giarsela", "Robert Giraseal"], ["Robert Halvorsen"]]


def test_every_pair_within_the_edit_limit_is_met(spark):
    rng = random.Random(3)
    words = {("p", "".join(rng.choice("abcd") for _ in range(n))) for n in (5, 8, 15) for _ in range(6)}
    for cls, w in list(words):
        for _ in range(12):
            x = list(w)
            for _ in range(rng.randint(1, 3)):
                i = rng.randrange(len(x) - 1)
                x[i], x[i + 1] = x[i + 1], x[i]
            words.add((cls, "".join(x)))
    got = {(r.x, r.y) for r in names.radius_join(spark.createDataFrame(sorted(words), "cls string, head string"), reach=names.REACH).collect()}
    lost = [(a, b) for (_, a), (_, b) in itertools.combinations(sorted(words), 2) if names._near(a, b) and (a, b) not in got]
    assert got and not lost
