"""Settings, landing, metadata, title lines and calling extractors."""

import os

import pytest

from claimloom.operators import claims
from claimloom.schemas import BLOCKS
from claimloom.sources.files import Settings, calling, chosen, document_metadata, land, landed_files, largest_lines, no_extractor, openings, project_env


def test_settings_of_a_project(tmp_path):
    deep = tmp_path / "a" / "b"
    deep.mkdir(parents=True)
    (tmp_path / ".env").write_text("CLAIMLOOM_BATCH_PAGES=3\nCLAIMLOOM_MAX_BLOCK=9\n# no\nCLAIMLOOM_ROOT=layer\n")
    got = Settings.of_project(str(deep), {"CLAIMLOOM_MAX_BLOCK": "4"})
    assert (got.batch_pages, got.max_block, got.root, got.cache) == (3, 4, str(tmp_path / "layer"), str(tmp_path / "data/cache"))
    assert project_env(str(deep)) == str(tmp_path / ".env") and Settings().max_output_tokens == 32_000


def test_landing(spark, tmp_path):
    with pytest.raises(ValueError):
        land("x.exe", b"", str(tmp_path))
    path = land("../Report.PDF", b"%PDF-1.4", str(tmp_path / "in"))
    assert os.path.dirname(path) == str(tmp_path / "in") and path.endswith("-Report.PDF") and os.listdir(tmp_path / "in") == [os.path.basename(path)]
    seen = []
    landed_files(spark, f"file://{tmp_path}/in").writeStream.foreachBatch(lambda b, _: seen.extend(r.id for r in b.collect())).option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    assert len(seen) == 1 and seen[0].startswith("d_") and len(seen[0]) == 14


def test_metadata(spark):
    docs = spark.createDataFrame([(i,) for i in range(5)], "doc_id int")
    answers = spark.createDataFrame([(0, '{"title": " Port ", "published": "2019-05", "principal_entity": "Yard", "other": 1}'), (1, "[]"), (2, None), (3, "{broken")], "doc_id int, payload string")
    got = {r.doc_id: r for r in document_metadata(docs, answers).collect()}
    assert len(got) == 5 and (got[0].title, str(got[0].published), got[0].principal_entity, got[0].publisher) == ("Port", "2019-05-01", "Yard", None)
    assert all(got[i].title is None and got[i].published is None for i in range(1, 5))
    pages = spark.createDataFrame([("d", 2, "b" * 6000), ("d", 1, "a" * 6000), ("d", 4, "z"), ("e", 1, None)], "doc_id string, page int, text string")
    assert {r.doc_id: r.opening for r in openings(pages).collect()} == {"d": "a" * 6000 + "\n\n" + "b" * 2998, "e": ""}


def test_largest_lines(spark):
    rows = [("d", 1, 0, 0, 0.0, 0.0, 1.0, 1.0, "Small print here\nMore of it", 8.0), ("d", 1, 1, 0, 0.0, 0.0, 1.0, 1.0, "2020\nHarbour dues", 20.0), ("d", 2, 0, 0, 0.0, 0.0, 1.0, 1.0, "Contents", 14.0), ("d", 9, 0, 0, 0.0, 0.0, 1.0, 1.0, "Not looked at", 90.0)]
    assert largest_lines(spark.createDataFrame(rows, BLOCKS)).first().largest == ["Harbour dues", "Contents"]


def test_calls_are_tried_again_and_failures_are_rows(spark, tmp_path):
    tries = str(tmp_path)

    def complete(prompt):
        path = os.path.join(tries, prompt)
        n = len(os.listdir(tries))
        if prompt == "never" or prompt == "later" and not os.path.exists(path):
            open(path, "a").close()
            raise OSError(f"try {n >= 0}")
        return '[{"quote": "q"}]'

    units = spark.createDataFrame([("a", 0, [1], "once"), ("a", 1, [2], "later"), ("a", 2, [3], "never")], "doc_id string, batch int, pages array<int>, prompt string")
    got = {r.batch: r for r in calling(complete, pause=0.01, workers=2)(units).collect()}
    assert [got[i].payload is not None for i in range(3)] == [True, True, False] and got[2].error.startswith("OSError")
    broken = claims.explode_claims(calling(complete, retries=0, pause=0.0)(units.where("batch = 2"))).collect()
    assert [r.broken for r in broken] == ["llm_call_failed"]


def test_choice_of_backends():
    a, b = (lambda u: u), (lambda u: u)
    backends = [("first", lambda: False, a), ("second", lambda: True, b)]
    assert chosen(backends) is b and chosen(backends, "first") is a and chosen([], "auto") is no_extractor and chosen(backends, "none") is no_extractor
    with pytest.raises(ValueError):
        chosen(backends, "third")
