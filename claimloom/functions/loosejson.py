"""JSON as language models write it: fenced, wrapped in prose, with trailing commas, or cut off."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

_FENCE = re.compile(r"```(?:json)?\s*(.*?)```", re.DOTALL | re.IGNORECASE)


def _outer(text: str, left: str, right: str) -> str | None:
    a, b = text.find(left), text.rfind(right)
    return text[a : b + 1] if 0 <= a < b else None


def _last_whole(text: str) -> str | None:
    """A top-level array cut off in the middle, closed after its last complete element."""
    begin = text.find("[")
    if begin < 0:
        return None
    depth, quoted, escaped, last = 0, False, False, -1
    for i in range(begin, len(text)):
        c = text[i]
        if quoted:
            if escaped:
                escaped = False
            elif c == "\\":
                escaped = True
            elif c == '"':
                quoted = False
            continue
        if c == '"':
            quoted = True
        elif c in "[{":
            depth += 1
        elif c in "]}":
            depth -= 1
            if depth == 1 and c == "}":
                last = i
    return text[begin : last + 1] + "]" if last > 0 else None


def repaired(text: str) -> list[str]:
    """Readings of a broken text, likeliest first."""
    tidy = re.sub(r",(\s*[\]}])", r"\1", text)
    cut = _last_whole(tidy)
    return [tidy, *([cut] if cut else [])]


def parse_loose(text: str | None) -> str | None:
    """The JSON value in a text, compact; null for prose, blanks and scalars that are not JSON containers."""
    if not text or not text.strip():
        return None
    tried = [text.strip(), *_FENCE.findall(text), _outer(text, "[", "]"), _outer(text, "{", "}"), text[text.find("[") :] if "[" in text else None]
    for body in filter(None, tried):
        for candidate in (body, *repaired(body)):
            try:
                value = json.loads(candidate)
            except ValueError:
                continue
            if isinstance(value, (list, dict)):
                return json.dumps(value, ensure_ascii=False)
    return None


@pandas_udf(StringType())
def _parse_udf(s: pd.Series) -> pd.Series:
    return s.map(parse_loose, na_action="ignore")


def parse_json_loose(text: Column) -> Column:
    """JVM parsing where the text is JSON already; the repairing parser only for the rest."""
    clean = F.try_parse_json(text)
    container = F.trim(text).rlike(r"^[\[{]")
    return F.when(container & clean.isNotNull(), F.to_json(clean)).otherwise(_parse_udf(text))
