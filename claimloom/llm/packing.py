"""Filling fixed-capacity containers: first-fit decreasing on a tournament tree, in randomised groups of documents."""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise, spread, tidied

CAPACITY = 2048
#: Tokens that one group packs: about 2,000 containers, so a group is one small task at any corpus size.
GROUP_TOKENS = 4_000_000
#: Length from which a text is cut before it is counted, at the next place where a blank follows something else.
STRETCH = 200_000
# The tokenizer's words end before a blank whatever stands around, so tokens on both sides are those of the whole text.
_CUT = re.compile(r"(?<=\S)(?=[ \n])")

_PARTS = "doc_id bigint, part int, n_tokens int, container string, byte_start bigint, byte_end bigint"


def tokenizer_folder() -> str:
    return os.environ.get("CLAIMLOOM_TOKENIZERS", "/opt/tokenizers")


_encoders: dict[str, object] = {}


def encoder(path: str):
    """The public byte-level BPE of ``path``, loaded once per worker process."""
    if path not in _encoders:
        import sys

        import tiktoken

        folder = os.path.dirname(os.path.realpath(path))
        if os.path.dirname(folder) not in sys.path:
            sys.path.append(os.path.dirname(folder))
        import public_tokenizers

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def count_tokens(text: str | None, path: str) -> int:
    """Tokens of a whole text; null counts as none. Texts beyond ``STRETCH`` are counted stretch by stretch."""
    if not text:
        return 0
    enc = encoder(path)
    return sum(len(enc.encode_ordinary(part)) for part in stretches(text))


def stretches(text: str, length: int | None = None) -> Iterator[str]:
    """A text in parts of about ``length`` (``STRETCH``) characters that no word of the tokenizer crosses; one without blanks stays whole."""
    length, at = length or STRETCH, 0
    while at < len(text):
        cut = _CUT.search(text, at + length)
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end


def measured(text: str | None, path: str, capacity: int) -> tuple[int, int, list[int]]:
    """Tokens and UTF-8 bytes of a text and, where it is longer than ``capacity`` tokens, the byte at which each full part ends."""
    if not text:
        return 0, 0, []
    n, size, cuts, at = 0, 0, [], 0
    enc = encoder(path)
    parts = [enc.encode_ordinary(part) for part in stretches(text)]
    n = sum(map(len, parts))
    if n > capacity:
        for ids in parts:
            for token in ids:
                size += len(enc.decode_single_token_bytes(token))
                at += 1
                if at % capacity == 0 and at < n:
                    cuts.append(size)
    return n, len(text.encode()), cuts


def token_counts(documents: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, n_tokens, n_bytes, cuts`` of every document; of two texts under one id the one with more tokens counts
    (ties: more bytes, then the later cuts)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [measured(t, path, capacity) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_tokens": [r[0] for r in rows], "n_bytes": [r[1] for r in rows], "cuts": [r[2] for r in rows]})

    counted = spread(documents.select("doc_id", "text").where("doc_id is not null")).mapInPandas(run, "doc_id bigint, n_tokens bigint, n_bytes bigint, cuts array<bigint>")
    return counted.groupBy("doc_id").agg(F.max(F.struct("n_tokens", "n_bytes", "cuts")).alias("m")).select("doc_id", "m.*")


class FirstFit:
    """Tournament tree over bin capacities: the leftmost bin with room is found and updated in O(log n)."""

    def __init__(self, capacity: int, most: int):
        self.leaves = 1 << max(0, (max(1, most) - 1).bit_length())
        self.tree = [capacity] * (2 * self.leaves)

    def put(self, size: int) -> int:
        tree, node = self.tree, 1
        while node < self.leaves:
            node *= 2
            if tree[node] < size:
                node += 1
        bin_no = node - self.leaves
        tree[node] -= size
        node //= 2
        while node:
            best = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == best:
                break
            tree[node] = best
            node //= 2
        return bin_no


def first_fit_decreasing(items: list[tuple[int, int]], capacity: int) -> list[tuple[int, int, int, int]]:
    """``(doc_id, part, size, bin)``: items by falling size, ties by id; longer items are cut into full parts first."""
    parts: list[tuple[int, int, int]] = []
    for doc, size in items:
        full, rest = divmod(size, capacity)
        parts += [(doc, p, capacity) for p in range(full)]
        if rest or not full:
            parts.append((doc, full, rest))
    parts.sort(key=lambda x: (-x[2], x[0], x[1]))
    tree = FirstFit(capacity, len(parts))
    return [(doc, part, size, tree.put(size)) for doc, part, size in parts]


@tidied
def packed(documents: DataFrame, capacity: int = CAPACITY, vocabulary: str = "byte_bpe_50k.tiktoken", group_tokens: int = GROUP_TOKENS, seed: int = 17) -> DataFrame:
    """The container of every document: ``doc_id, part, n_tokens, container, byte_start, byte_end``.

    The bytes are those of the UTF-8 text that the part takes, so a container can be filled without tokenising again: the
    parts of a document are its bytes in order (a cut may fall inside a character that spans tokens).

    Texts are tokenised once into a table. Its total sets the number of groups, so a group holds about
    ``group_tokens`` tokens whatever the corpus size; documents fall into groups by a seeded hash of their id, which no
    source or length can skew. Each group is packed on its own.

    Cases: a document longer than a container is cut into full containers and a rest (``part`` 0, 1, ...); no other
    is split. Null and empty texts have 0 tokens and take the first container of their group. Equal lengths are taken
    by id, so the result is the same on every run. A repeated ``doc_id`` is packed once; a null one not at all. No
    documents give no rows. Extra columns are not read.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least one token")
    counts, _ = materialise(token_counts(documents, f"{tokenizer_folder()}/{vocabulary}", capacity), "tokens")
    total = counts.agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n")).first()
    groups = max(1, -(-int(total["t"] or 0) // group_tokens), -(-total["n"] // (group_tokens // 16)))

    def pack(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        rows = first_fit_decreasing(list(zip(group["doc_id"].tolist(), group["n_tokens"].tolist(), strict=True)), capacity)
        ends = {d: [0, *c, n] for d, c, n in zip(group["doc_id"].tolist(), group["cuts"], group["n_bytes"].tolist(), strict=True)}
        placed = [(d, p, s, f"g{key[0]}-{b}", ends[d][p], ends[d][p + 1]) for d, p, s, b in rows]
        return pd.DataFrame(placed, columns=["doc_id", "part", "n_tokens", "container", "byte_start", "byte_end"])

    grouped = counts.withColumn("g", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(groups)))
    return grouped.groupBy("g").applyInPandas(pack, _PARTS)
