"""Compiled clusters of the look-alike mapping, and the bytes of packed parts."""

import unicodedata

import pytest

from claimloom.llm import lookalikes, packing


def test_every_compiled_cluster_is_a_fixed_point():
    pattern, compiled, marks = lookalikes.compile_transducer()
    assert len(compiled) > 3000 and len(marks) > 112
    for cluster, out in compiled.items():
        assert lookalikes.one_look(out) == out, cluster
        if cluster not in "\t\n\r\x0b\x0c":
            assert lookalikes.one_look(f"q{cluster}q" if not unicodedata.combining(cluster[0]) else cluster) is not None


@pytest.mark.parametrize(
    "a,b", [("Ӏnk", "lnk"), ("Օslo", "Oslo"), ("ᎪᏢ", "AP"), ("να", "va"), ("é", "é"), ("е́", "é"), ("Ǻ", "Ǻ"), ("क़", "क़"), ("が", "が"), ("ｶﾞ", "ガ")]
)
def test_pairs_of_one_look(a, b):
    assert lookalikes.one_look(a) == lookalikes.one_look(b)


@pytest.mark.parametrize("a,b", [("é", "e"), ("A", "a"), ("1", "²"), ("O", "0"), ("ह", "ह़")])
def test_what_a_reader_sees_stays(a, b):
    assert lookalikes.one_look(a) != lookalikes.one_look(b)


def test_bytes_of_parts_make_up_the_text(spark):
    texts = [(1, "harbour dues 12 € – ü " * 700), (2, "short"), (3, ""), (4, None), (5, "ab " * 90)]
    df = spark.createDataFrame(texts, "doc_id bigint, text string")
    path = f"{packing.tokenizer_folder()}/byte_bpe_50k.tiktoken"
    parts: dict[int, list] = {}
    for r in packing.packed(df, capacity=64).collect():
        parts.setdefault(r.doc_id, []).append(r)
    for doc, text in texts:
        raw = (text or "").encode()
        rows = sorted(parts[doc], key=lambda r: r.part)
        assert b"".join(raw[r.byte_start : r.byte_end] for r in rows) == raw
        assert sum(r.n_tokens for r in rows) == packing.count_tokens(text, path)
        assert all(r.n_tokens == 64 for r in rows[:-1])
    assert len(parts[1]) > 10
