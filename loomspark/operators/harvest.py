"""Evidence of a repository: change heat, import fan-in, and the packet that holds them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.functions.paths import MODULE, module_base, module_candidates
from loomspark.functions.text import SPACE_CLASS, json_string

#: Revisions that heat is counted over, and the patterns of module specifiers.
HEAT_REVISIONS = 200
_S = f"[{SPACE_CLASS}]"
SPECIFIERS = (
    rf"""\b(?:import|export){_S}+(?:[^"'\n]*?{_S}+from{_S}*)?["']([^"'\n]+)["']""",
    rf"""\bimport{_S}*\({_S}*["']([^"'\n]+)["']{_S}*\)""",
    rf"""\brequire{_S}*\({_S}*["']([^"'\n]+)["']{_S}*\)""",
)


def specifiers(source: Column) -> Column:
    """The different module specifiers of a source text."""
    found = [F.regexp_extract_all(source, F.lit(p), F.lit(1)) for p in SPECIFIERS]
    return F.array_distinct(F.concat(*found))


def imports(modules: DataFrame, tracked: DataFrame) -> DataFrame:
    """importer, target: which tracked files the tracked modules (path, source) import; the first candidate that is
    tracked counts. Imports of oneself don't."""
    wanted = modules.filter(F.col("path").rlike(MODULE)).select(F.col("path").alias("importer"), F.explode(specifiers(F.col("source"))).alias("specifier"))
    named = wanted.withColumn("base", module_base(F.col("importer"), F.col("specifier"))).filter("base <> ''")
    tried = named.select("importer", "specifier", F.posexplode(module_candidates(F.col("base"))).alias("place", "target"))
    files = tracked.select(F.col("path").alias("target")).distinct()
    found = tried.join(files, "target").groupBy("importer", "specifier").agg(F.min_by("target", "place").alias("target"))
    return found.filter("target <> importer").select("importer", "target").distinct()


def fan_in(modules: DataFrame, tracked: DataFrame) -> DataFrame:
    """path, count of distinct importers."""
    return imports(modules, tracked).groupBy(F.col("target").alias("path")).agg(F.count("*").alias("count"))


def heat(revisions: DataFrame, tracked: DataFrame, last: int = HEAT_REVISIONS) -> DataFrame:
    """path, count: in how many of the newest revisions (pos, paths) each tracked path was touched."""
    newest = revisions.select("pos", "paths").orderBy("pos").limit(last)
    touched = newest.select(F.explode("paths").alias("path"))
    return touched.join(tracked.select("path").distinct(), "path", "left_semi").groupBy("path").agg(F.count("*").alias("count"))


def _block(rows: DataFrame, name: str) -> DataFrame:
    """The rows by falling count and path, a line each; `(none)` without rows."""
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("count")).alias("c"), "path")))
    lines = F.transform(ordered, lambda x: F.concat((-x["c"]).cast("string"), F.lit("\t"), json_string(x["path"])))
    return rows.agg(F.when(F.count("*") == 0, "(none)").otherwise(F.array_join(lines, "\n")).alias(name))


def packet(revision: str, manifest: str | None, tracked: DataFrame, heat_rows: DataFrame, fan_in_rows: DataFrame) -> DataFrame:
    """One row, `packet`: a text that depends on nothing but its parts. All lists are of one repository's files."""
    paths = tracked.agg(F.array_join(F.transform(F.sort_array(F.collect_set("path")), json_string), "\n").alias("paths"))
    parts = paths.join(_block(heat_rows, "heat")).join(_block(fan_in_rows, "fan_in"))
    head = ["# Evidence packet", "", "Paths are JSON strings, so that unusual names can't change the packet's structure.", f"Revision: {revision}", ""]
    head += ["## package.json", "", "```json", manifest if manifest is not None else "(package.json is not tracked)", "```", ""]

    def section(title: str, rows: Column) -> list[Column]:
        return [F.lit(f"## {title}\n\n```text"), rows, F.lit("```\n")]

    lines = [F.lit("\n".join(head)), *section("Tracked files", F.col("paths")), *section(f"Change heat (in the last {HEAT_REVISIONS} revisions)", F.col("heat"))]
    lines += section("Import fan-in (distinct tracked relative importers)", F.col("fan_in"))
    return parts.select(F.concat_ws("\n", *lines).alias("packet"))
