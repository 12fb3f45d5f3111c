"""Line-first cleaning: rules judge lines, failing lines go, and documents that lose too much text are rejected."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from loomspark.llm.common import pick_row, small_batches, trimmed, unrow

SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
#: Phrases of page furniture, matched in short lines, A-Z lower-cased.
BOILERPLATE = (
    "all rights reserved", "accept cookies", "click here", "cookie policy", "enable javascript", "log in to",
    "privacy policy", "read more", "share this", "sign up for", "skip to content", "subscribe to", "terms of use",
)
_BOILERPLATE = re.compile("|".join(BOILERPLATE).encode())
_UPPER, _LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class LineRules:
    """Percentages are of a line's bytes that are no white space."""

    symbol_percent: int = 8  # more of SYMBOLS and "!" fails
    separators: int = 3  # this many "|" or ">" make a navigation line
    capital_percent: int = 60  # more A-Z, in lines of over capital_bytes, fails
    capital_bytes: int = 20
    boilerplate_words: int = 20  # lines of no more words fail on a phrase
    lost_percent: int = 30  # a document that loses more of its bytes is rejected


def line_fails(line: bytes, n_words: int, rules: LineRules) -> bool:
    solid = len(line) - _count(line, SPACE)
    if 100 * _count(line, SYMBOLS + b"!") > rules.symbol_percent * solid:
        return True
    if _count(line, b"|>") >= rules.separators:
        return True
    if solid > rules.capital_bytes and 100 * _count(line, _UPPER) > rules.capital_percent * solid:
        return True
    return n_words <= rules.boilerplate_words and _BOILERPLATE.search(line.lower()) is not None


def _count(text: bytes, characters: bytes) -> int:
    return len(text) - len(text.translate(None, characters))


def repeated_words(words: list[bytes], k: int = 3) -> int:
    """Words in k-word windows that occur twice or more."""
    windows = list(zip(*(words[i:] for i in range(k)), strict=False))
    if len(set(windows)) == len(windows):
        return 0
    often = {w for w, n in Counter(windows).items() if n > 1}
    marked = bytearray(len(words))
    for i, w in enumerate(windows):
        if w in often:
            marked[i : i + k] = b"\1" * k
    return sum(marked)


def judge(text: str | None, rules: LineRules) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, lines removed, cleaned text."""
    raw = (text or "").encode()
    words = raw.split()
    n = len(words)
    solid = len(raw) - _count(raw, SPACE)
    chars = len(text or "") - (len(raw) - solid)
    repeats = repeated_words(words)
    lines, full, left, removed, lost = raw.split(b"\n"), [], [], 0, 0
    for line in lines:
        here = len(line.split())
        if here:
            full.append(line)
            if line_fails(line, here, rules):
                removed += 1
                lost += len(line) - _count(line, SPACE)
                continue
        left.append(line)
    failed = n < 50 or 100 * repeats > 50 * n
    kept = not failed and 100 * lost <= rules.lost_percent * solid
    cleaned = text if not removed else b"\n".join(left).decode()
    return n, chars, _count(raw, SYMBOLS), len(full) - len(set(full)), repeats, failed, kept, removed, cleaned


COLUMNS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, n_lines_removed long, cleaned string"
)


def line_first_quality(docs: DataFrame, text: str = "text", rules: LineRules = LineRules()) -> DataFrame:
    """The rows of docs as the struct `_row` beside the columns of COLUMNS; one scan, no shuffle.

    A null text counts as empty: no words, so it fails. An empty table gives an empty result. Repeated rows are
    judged alike, each for itself. Very long texts are judged whole, one at a time.
    """
    small_batches(docs.sparkSession)
    source = pick_row(docs, _text=text)

    def run(batches):
        for batch in batches:
            step = 256
            for i in range(0, batch.num_rows, step):
                part = batch.slice(i, step)
                got = [judge(t.as_py(), rules) for t in part.column("_text")]
                columns = list(zip(*got, strict=True))
                types = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("_row"), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]],
                    ["_row", *[c.split()[0] for c in COLUMNS.split(", ")]],
                )

    schema = f"_row {source.schema['_row'].dataType.simpleString()}, {COLUMNS}"
    return source.mapInArrow(trimmed(run), schema)


def keep_clean(docs: DataFrame, text: str = "text", rules: LineRules = LineRules()) -> DataFrame:
    """docs without rejected documents, failing lines removed; the same columns."""
    judged = line_first_quality(docs, text, rules).filter("kept")
    return unrow(judged, docs.columns, **{text: "cleaned"})
