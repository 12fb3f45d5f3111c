"""Readme texts: where Markdown can be cut, what fits into a bounded projection, which links hold."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from loomspark.functions.paths import normalized
from loomspark.functions.text import SPACE, SPACE_CLASS

#: Code points of a projection, and what is at the end of one that was cut.
BUDGET = 10_000
MARKER = "> **Truncated:** This excerpt is incomplete. Read the full [README.md](README.md)."

_HEADING = re.compile(r" {0,3}#{1,6}(?:[\t ]+|$)")
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})(.*)$")
_CLOSE = re.compile(r" {0,3}(`{3,}|~{3,})[\t ]*$")
_BLANK = re.compile(r"[\t ]*$")


@dataclass
class Boundaries:
    """Places in code points: before later headings, after blocks, after lines; and the sign of a fence left open."""

    section: list[int] = field(default_factory=list)
    block: list[int] = field(default_factory=list)
    line: list[int] = field(default_factory=list)
    open_fence: str | None = None


def boundaries(markdown: str) -> Boundaries:
    """Nothing within a fence is a boundary but its end. The first heading is the title and starts no section."""
    found, at, fence, headings = Boundaries(), 0, None, 0
    for line in re.findall(r"[^\n]*\n|[^\n]+$", markdown):
        whole, text = line.endswith("\n"), line.rstrip("\n").removesuffix("\r")
        end = at + len(line)
        if fence:
            closing = _CLOSE.match(text)
            if closing and closing[1][0] == fence[0] and len(closing[1]) >= len(fence):
                fence = None
                if whole:
                    found.line.append(end)
                    found.block.append(end)
        else:
            if _HEADING.match(text):
                headings += 1
                if headings > 1:
                    found.section.append(at)
            opening = _FENCE.match(text)
            if opening:
                fence = opening[1]
            elif whole:
                found.line.append(end)
                if _BLANK.match(text):
                    found.block.append(end)
        at = end
    found.open_fence = fence and fence[0]
    return found


def _indented(source: str, most: int, sign: str) -> str:
    """As much of the source as fits, indented in a fence of the other sign."""
    wrap = ("~" if sign == "`" else "`") * 3
    head, tail = f"{wrap}text\n", f"\n{wrap}\n"
    out, used, fresh = [head], len(head) + len(tail), True
    for c in source:
        need = 5 if fresh else 1
        if fresh and used + 4 > most:
            break
        if used + need > most:
            out.append("    " if fresh else "")
            break
        out.append("    " + c if fresh else c)
        used += need
        fresh = c == "\n"
    return "".join(out) + tail


def projection(markdown: str, most: int = BUDGET) -> str:
    """The text, or as much of it as fits with the marker: up to the last section, block or line that ends within."""
    if len(markdown) <= most:
        return markdown
    room = most - len(f"\n\n{MARKER}\n")
    if room <= 0:
        raise ValueError("the marker doesn't fit")
    part = markdown[:room]
    found = boundaries(part)
    for places in (found.section, found.block, found.line):
        if places and part[: places[-1]].strip(SPACE):
            body = part[: places[-1]]
            break
    else:
        body = _indented(part, room, found.open_fence) if found.open_fence else part
    body = body.rstrip(SPACE)
    return f"{body}\n\n{MARKER}\n" if body else f"{MARKER}\n"


@F.pandas_udf(StringType())
def _projections(text: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else projection(t) for t in text], dtype=object)


def projections(text: Column) -> Column:
    """Only BUDGET code points and one more go to Python."""
    return _projections(F.substring(text, 1, BUDGET + 1))


#: Inline links and link references.
INLINE = rf"""!?\[[^\]\n]*\]\([{SPACE_CLASS}]*(?:<([^>\n]+)>|([^{SPACE_CLASS})]+))(?:[{SPACE_CLASS}]+["'][^\n)]*["'])?[{SPACE_CLASS}]*\)"""
REFERENCE = rf"""(?m)^[{SPACE_CLASS}]{{0,3}}\[[^\]\n]+\]:[{SPACE_CLASS}]*(?:<([^>\n]+)>|([^{SPACE_CLASS}]+))"""
SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"


def destinations(markdown: Column) -> Column:
    """Where links lead, inline ones first, each once."""

    def found(pattern):
        angled, bare = (F.regexp_extract_all(markdown, F.lit(pattern), F.lit(i)) for i in (1, 2))
        return F.zip_with(angled, bare, lambda a, b: F.when(a != "", a).otherwise(b))

    return F.array_distinct(F.concat(found(INLINE), found(REFERENCE)))


def local_path(destination: Column) -> Column:
    """A struct: status is skip (an anchor or another site's), local or invalid; path is the decoded path of a local one."""
    raw = F.regexp_replace(destination, f"^[{SPACE_CLASS}]+|[{SPACE_CLASS}]+$", "")
    part = F.regexp_extract(raw, r"^([^?#]*)", 1)
    skip = (raw == "") | raw.startswith("#") | raw.rlike(SCHEME) | raw.startswith("//") | (part == "")
    path = F.try_url_decode(F.replace(part, F.lit("+"), F.lit("%2B")))
    broken = path.isNull() | (F.contains(path, F.lit("�")) & ~F.contains(part, F.lit("�")) & ~F.lower(part).contains("%ef%bf%bd"))
    bad = broken | (path == "") | (F.instr(path, "\0") > 0) | F.contains(path, F.lit("\\")) | path.startswith("/") | path.rlike(SCHEME)
    status = F.when(skip, "skip").when(bad, "invalid").otherwise("local")
    return F.struct(status.alias("status"), F.when(status == "local", path).alias("path"))


def link_problems(readmes: DataFrame, tracked: DataFrame) -> DataFrame:
    """repository, destination, problem (invalid, escapes or missing) of the links of whole readmes (repository, text);
    tracked has repository and path of regular files."""
    links = readmes.select("repository", F.explode(destinations(F.col("text"))).alias("destination"))
    links = links.withColumn("local", local_path(F.col("destination"))).filter("local.status <> 'skip'")
    target = normalized(F.col("local.path"))
    links = links.select("repository", "destination", F.col("local.status").alias("status"), target.alias("path"))
    files = tracked.select("repository", "path").distinct().withColumn("there", F.lit(True))
    escapes = (F.col("path") == "..") | F.col("path").startswith("../")
    problem = F.when(F.col("status") == "invalid", "invalid").when(escapes, "escapes").when(F.col("there").isNull(), "missing")
    return links.join(files, ["repository", "path"], "left").withColumn("problem", problem).filter("problem IS NOT NULL").select("repository", "destination", "problem")
