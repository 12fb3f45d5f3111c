"""Snippets around a match, bounded in UTF-16 units and in UTF-8 bytes."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from loomspark.functions.text import SPACE, single_spaced

#: The bounds of a snippet and of a clipped prefix, in UTF-16 units and bytes.
SNIPPET, CLIP = (320, 1280), (256, 1024)
DOTS = "…"


def _sums(text: str) -> tuple[list[int], list[int]]:
    units = list(accumulate((1 + (c > "\uffff") for c in text), initial=0))
    octets = list(accumulate((len(c.encode()) for c in text), initial=0))
    return units, octets


def snippet(text: str, at: int, length: int, bounds: tuple[int, int] = SNIPPET) -> str:
    """The part of text around the match at UTF-16 unit `at`, with as much on both sides as fits; dots mark cut ends.
    A match that doesn't fit gives way to its middle."""
    units, octets = _sums(text)
    n = len(text)

    def fits(i: int, j: int) -> bool:
        cuts = (i > 0) + (j < n)
        return units[j] - units[i] + cuts <= bounds[0] and octets[j] - octets[i] + 3 * cuts <= bounds[1]

    if fits(0, n):
        return text
    middle = at + length / 2
    i = min(bisect_right(units, at) - 1, n - 1)
    j = max(i + 1, min(n, bisect_left(units, at + length)))
    if not fits(i, j):
        i = min(max(bisect_left(units, middle) - 1, 0), n - 1)
        j = i + 1
    while True:
        ways = [(middle - units[i], i - 1, j)] if i and fits(i - 1, j) else []
        ways += [(units[j] - middle, i, j + 1)] if j < n and fits(i, j + 1) else []
        if not ways:
            return DOTS * (i > 0) + text[i:j] + DOTS * (j < n)
        _, i, j = min(ways, key=lambda w: w[0])  # the left one comes first in ties


def clip(text: str, bounds: tuple[int, int] = CLIP) -> str:
    """The longest prefix that fits, with dots if it was cut; white space before them goes."""
    units, octets = _sums(text)
    if units[-1] <= bounds[0] and octets[-1] <= bounds[1]:
        return text
    n = min(bisect_right(units, bounds[0] - 1), bisect_right(octets, bounds[1] - 3)) - 1
    return text[:n].rstrip(SPACE) + DOTS


def find(text: str, literal: str) -> tuple[int, int] | None:
    """UTF-16 place and length of the first match, without regard to case."""
    m = re.search(re.escape(literal), text, re.IGNORECASE)
    return m and (sum(1 + (c > "\uffff") for c in text[: m.start()]), sum(1 + (c > "\uffff") for c in m[0]))


@F.pandas_udf(StringType())
def _snippets(text: pd.Series, literal: pd.Series) -> pd.Series:
    found = [(t, find(t, x)) if t is not None and x is not None else (None, None) for t, x in zip(text, literal, strict=True)]
    return pd.Series([snippet(t, *m) if m else None for t, m in found], dtype=object)


def snippets(text: Column, literal: Column) -> Column:
    """Null where the literal is not in the text. White space is single before the search."""
    return _snippets(single_spaced(text), single_spaced(literal))


@F.pandas_udf(StringType())
def _clips(text: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else clip(t) for t in text], dtype=object)


def clips(text: Column) -> Column:
    """Prefixes with dots, of text with single white space."""
    return _clips(single_spaced(text))
