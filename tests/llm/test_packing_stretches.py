"""Counting a text in stretches gives the tokenizer's count of the whole."""

import random

from claimloom.llm import packing

PATH = f"{packing.tokenizer_folder()}/byte_bpe_50k.tiktoken"


def test_sum_is_the_count_of_the_whole(monkeypatch):
    rng = random.Random(5)
    pieces = ["reconciliation", " of", "  ", "\n\n", " \n", "don't", "'s", " 12345", "…", "\t", " ", " आंकड़े", "数字", " !!'ll", "\x1c", "　x", " "]
    for _ in range(40):
        text = "".join(rng.choice(pieces) for _ in range(400))
        whole = len(packing.encoder(PATH).encode_ordinary(text))
        for length in (1, 7, 64):
            monkeypatch.setattr(packing, "STRETCH", length)
            assert "".join(packing.stretches(text)) == text
            assert packing.count_tokens(text, PATH) == whole


def test_words_across_the_length_stay_whole(monkeypatch):
    monkeypatch.setattr(packing, "STRETCH", 5)
    assert list(packing.stretches("reconciliation of claims")) == ["reconciliation", " of claims"]
