"""Tables in the shared folder are deleted once nothing reads them."""

import os

import pytest

from claimloom.session import materialise, shared_folder, tidied


def tables(spark):
    return set(os.listdir(shared_folder(spark).removeprefix("file://")))


def test_only_results_are_kept(spark):
    before = tables(spark)

    @tidied
    def inner(n):
        return materialise(spark.range(n), "inner")[0]

    @tidied
    def outer(n):
        a, _ = materialise(inner(n), "a")
        return a.join(inner(n), "id"), a.limit(1)

    x, y = outer(5)
    assert len(tables(spark) - before) == 2 and (x.count(), y.count()) == (5, 1)

    @tidied
    def broken():
        materialise(spark.range(3), "lost")
        raise KeyError("no")

    left = tables(spark)
    with pytest.raises(KeyError):
        broken()
    assert tables(spark) == left
