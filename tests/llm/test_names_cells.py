"""Cells of many levels against brute force, and names outside every table."""

import random

import pytest

from claimloom.llm import names


def levenshtein(a, b, most):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        after = [i]
        for j, y in enumerate(b, 1):
            after.append(min(row[j] + 1, after[-1] + 1, row[j - 1] + (x != y)))
        if min(after) > most:
            return most + 1
        row = after
    return row[-1]


def test_divided_cells_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(names, "CELL", 24)
    monkeypatch.setattr(names, "FANOUT", 8)
    rng = random.Random(3)
    base = ["".join(rng.choice("aeiou" if i % 2 else "bdfkmnrst") for i in range(rng.randrange(3, 17))) for _ in range(220)]
    words = set(base)
    for w in base:
        for _ in range(2):
            v = list(w)
            for _ in range(rng.randrange(1, 4)):
                i = rng.randrange(len(v))
                v[i : i + rng.randrange(2)] = rng.choice(["", "x", "ea"])
                v = v or ["a"]
            words.add("".join(v))
    words = sorted(words)
    reach = {14: 6, 7: 4, 0: 2}
    want = set()
    for i, x in enumerate(words):
        for y in words[i + 1 :]:
            r = next(v for k, v in reach.items() if min(len(x), len(y)) >= k)
            if abs(len(x) - len(y)) <= r and levenshtein(x, y, r) <= r:
                want.add(("p|x", x, y))
    points = spark.createDataFrame([("p|x", w) for w in words] + [("q", words[0]), ("q", ""), ("q", None), ("p|x", words[0])], "cls string, head string")
    got = [tuple(r) for r in names.radius_join(points, reach=names.REACH).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert names.radius_join(points.where("false")).count() == 0


ALIKE = [
    ("Anthony Brown", "Tony Brown"), ("Christopher Lee", "Chris Lee"), ("Edward Hall", "Ned Hall"), ("Rebecca Jones", "Becky Jones"), ("Sergio Martinez", "Serge Martinez"), ("Wang Xiaoming", "Xiaoming Wang"),
    ("Acme Semiconductor Ltd", "Acme Semicond. Limited"), ("Ministry of Defence", "Min. of Defence"), ("Bartholomew Quist", "Quist, Barth"),
]
APART = [("Edward Hall", "Edwina Hall"), ("Ministry of Defence", "Ministry of Justice"), ("Acme Semiconductor Ltd", "Acme Hotels Ltd"), ("Wang Xiaoming", "Wang Xiaohua"), ("Ministry of Defence", "Board of Defence")]


@pytest.mark.parametrize("a,b", ALIKE)
def test_names_of_no_table_are_linked(a, b):
    assert names.verdict(names.profile(a), names.profile(b)) > 0


@pytest.mark.parametrize("a,b", APART)
def test_others_of_no_table_stay_apart(a, b):
    assert names.verdict(names.profile(a), names.profile(b)) == 0
