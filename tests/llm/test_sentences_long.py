"""Spans over many candidate ends, and partners of marks far down the stack."""

from claimloom.llm.sentences import _pairs, block_spans


def test_long_quotation_is_one_span():
    text = "He wrote: “" + "Rain fell again. " * 70 + "It ended.” Then nothing more was said."
    assert [text[a:b].strip() for a, b in block_spans(text)] == [text[: text.index("”") + 1], "Then nothing more was said."]


def test_long_run_of_words_in_brackets():
    text = "The list (" + "item one of the many kinds. " * 80 + "Last one.) is long. Next one begins here."
    assert len(block_spans(text)) == 2


def test_partner_below_three_open_marks():
    assert (0, 16, False) in _pairs("(a «b „c [d ‘e f)")
    assert _pairs(") a ] b ”") == []
    assert _pairs("“a (b” c)") == [(0, 5, True)]
