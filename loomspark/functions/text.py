"""Scalar functions over text: tokens, digests, keys, coercions. All are built-in expressions."""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

SCOPE_DOMAIN, DIGEST_DOMAIN = "loomspark/scope/v1", "loomspark/document/v1"


#: The white space that single_spaced and clips know, as the inside of a character class and as text.
SPACE_CLASS = r"\t-\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
SPACE = "\t\n\x0b\x0c\r \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
#: Combining marks that belong to the token before them and are dropped.
MARKS = r"\u0300-\u0331"


def _folds() -> tuple[str, str]:
    """Lower-case Latin letters with one mark and the letters that they fold to; the final sigma folds to the other one.
    Letters of other scripts, and those with two marks, keep theirs."""
    places = [*range(0xDF, 0x250), *range(0x1E00, 0x1F00)]
    pairs = [(c, unicodedata.normalize("NFD", c)) for c in map(chr, places) if c == c.lower()]
    some = [(c, d[0]) for c, d in pairs if len(d) == 2 and d[0].isascii() and unicodedata.combining(d[1])] + [("ς", "σ")]
    return "".join(c for c, _ in some), "".join(d for _, d in some)


ACCENTED, PLAIN = _folds()


def tokens(text: Column) -> Column:
    """Maximal runs of letters, digits and private characters, in lower case, Latin marks folded. Marks of other scripts
    separate tokens."""
    marked = F.regexp_replace(text, rf"(?<=[\p{{L}}\p{{N}}\p{{Co}}])[{MARKS}]+", "")
    folded = F.translate(F.lower(F.when(F.contains(F.encode(text, "UTF-8"), F.unhex(F.lit("CC"))), marked).otherwise(text)), ACCENTED, PLAIN)
    return F.regexp_extract_all(folded, F.lit(r"([\p{L}\p{N}\p{Co}]+)"), F.lit(1))


def token_list(text: str) -> list[str]:
    """tokens, of one text on the driver."""
    marked = re.sub(rf"(?<=\w)(?<!_)[{MARKS}]+", "", text)
    folded = marked.lower().translate(str.maketrans(ACCENTED, PLAIN))
    kept = "".join(c if unicodedata.category(c)[0] in "LN" or unicodedata.category(c) == "Co" else " " for c in folded)
    return [t for t in kept.split(" ") if t]


def scope_token(workspace: Column) -> Column:
    """`w` and 63 hexadecimal digits of a domain-separated SHA-256."""
    return F.concat(F.lit("w"), F.substring(F.sha2(F.concat(F.lit(SCOPE_DOMAIN), F.char(F.lit(0)), workspace), 256), 1, 63))


def digest(*parts: Column) -> Column:
    joined = [x for p in parts for x in (F.char(F.lit(0)), p)]
    return F.sha2(F.concat(F.lit(DIGEST_DOMAIN), *joined), 256)


def row_key(session: Column, seq: Column) -> Column:
    """A key whose parts can't run into each other: the session's length in bytes comes first."""
    return F.concat_ws(":", F.lit("row"), F.octet_length(session).cast("string"), session, seq.cast("string"))


def document_key(session: Column, seq: Column, fingerprint: Column) -> Column:
    """A key that changes with the document's content."""
    return F.concat_ws(":", F.lit("document-v1"), F.octet_length(session).cast("string"), session, seq.cast("string"), fingerprint)


def canonical_digest(domain: str, *fields: Column) -> Column:
    """SHA-256 of a domain, NUL and the fields as JSON in their order, nulls included."""
    return F.sha2(F.concat(F.lit(domain), F.char(F.lit(0)), F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})), 256)


def manifest_digest(manifest: dict) -> str:
    """SHA-256 of a manifest as JSON with sorted keys, its own digest left out."""
    own = {k: v for k, v in manifest.items() if k != "digest"}
    return "sha256:" + hashlib.sha256(json.dumps(own, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def single_spaced(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, f"[{SPACE_CLASS}]+", " "))


def bounded(text: Column, least: int, most: int) -> Column:
    """Whether text is there, has no NUL, and its UTF-8 bytes number least to most."""
    ok = (F.instr(text, "\0") == 0) & F.octet_length(text).between(least, most)
    return F.coalesce(ok, F.lit(False))


def first_string(*values: Column) -> Column:
    """The first that is not null."""
    return F.coalesce(*values)


def unsigned(text: Column) -> Column:
    """A whole number in decimal digits without leading zeros, up to 2^63 - 1; else null."""
    return F.when(text.rlike("^(0|[1-9][0-9]{0,18})$"), text.try_cast("long"))


def event_time(*aliases: Column) -> Column:
    """Milliseconds from the first alias that is not null: a whole number, or an ISO time, without a zone in UTC; else
    null."""
    raw = F.coalesce(*[a.cast("string") for a in aliases])
    iso = F.regexp_replace(raw, r"^(\d{4}-\d{2}-\d{2}T[\d:.]+)$", "$1Z")
    dated = F.when(iso.rlike(r"^\d{4}-\d{2}-\d{2}"), F.unix_millis(F.try_to_timestamp(iso)))
    return F.when(raw.rlike(r"^-?\d{1,16}$"), raw.try_cast("long")).otherwise(dated)


def code_point_prefix(text: Column, most: int) -> Column:
    return F.substring(text, 1, most)


def json_string(text: Column) -> Column:
    """Text as a JSON string, quotes included."""
    listed = F.to_json(F.array(text))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def error_field(text: Column, other: str) -> Column:
    """At most 64 characters of a safe alphabet."""
    safe = F.regexp_replace(F.substring(text, 1, 64), r"[^A-Za-z0-9_.:-]", "_")
    return F.when(F.length(text) > 0, safe).otherwise(other)
