"""Paths with slashes: their parts, their normal form, module files they may stand for, and why they are left out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions of modules, in the order in which they are tried.
EXTENSIONS = (".mjs", ".js", ".cjs", ".json", ".ts", ".tsx", ".jsx")
MODULE = r"(?i)\.([cm]?js|json|tsx?|jsx)$"


@dataclass(frozen=True)
class Exclusions:
    """What is no one's own work. `own` are the files that the evidence itself is written to."""

    own: tuple[str, ...] = ("README.md",)
    own_prefixes: tuple[str, ...] = ()
    lockfiles: tuple[str, ...] = (
        "Cargo.lock", "Gemfile.lock", "Pipfile.lock", "bun.lock", "bun.lockb", "composer.lock",
        "npm-shrinkwrap.json", "package-lock.json", "pnpm-lock.yaml", "poetry.lock", "uv.lock", "yarn.lock",
    )
    generated: tuple[str, ...] = ("build", "coverage", "dist", "node_modules")
    vendored: tuple[str, ...] = ("third_party", "vendor", "vendored")
    generated_attributes: tuple[str, ...] = ("generated", "linguist-generated")
    vendored_attributes: tuple[str, ...] = ("vendored", "linguist-vendored")


#: Reasons in the order in which they are tested.
REASONS = ("own", "lockfile", "generated-contract", "vendored-contract", "generated-attribute", "vendored-attribute")


def dirname(path: Column) -> Column:
    bare = F.regexp_replace(path, "(?<=.)/+$", "")
    found = F.regexp_extract(bare, "^(.*)/[^/]*$", 1)
    return F.when(found != "", found).when(bare.startswith("/"), "/").otherwise(".")


def basename(path: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(path, "/+$", ""), "([^/]*)$", 1)


def extname(path: Column) -> Column:
    base = basename(path)
    return F.when(base == "..", "").otherwise(F.regexp_extract(base, r"^.+(\.[^.]*)$", 1))


def normalized(path: Column) -> Column:
    """Without empty parts, `.`, and `..` after a part; a slash at the end stays."""
    rooted = path.startswith("/")

    def step(parts, part):
        climbs = (part == "..") & (F.size(parts) > 0) & (F.element_at(parts, -1) != "..")
        kept = F.when((part == "") | (part == "."), parts).when(climbs, F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))))
        return kept.when((part == "..") & rooted, parts).otherwise(F.array_append(parts, part))

    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    joined = F.concat(F.when(rooted, "/").otherwise(""), F.array_join(parts, "/"))
    ends = F.when(path.endswith("/") & (F.size(parts) > 0), "/").otherwise("")
    return F.when(joined == "", F.when(path.endswith("/"), "./").otherwise(".")).otherwise(F.concat(joined, ends))


def joined(folder: Column, path: Column) -> Column:
    return normalized(F.concat(folder, F.lit("/"), path))


def module_base(importer: Column, specifier: Column) -> Column:
    """The path that a relative specifier names; null for other specifiers and for paths outside the root."""
    base = F.when(specifier.startswith("."), joined(dirname(importer), specifier))
    return F.regexp_extract(base, r"^(?!\.\.$|\.\./|/)(?s:.*)$", 0)


def module_candidates(base: Column) -> Column:
    """The files that it may mean, best first. `base` should be a column, for each candidate reads it."""
    more = [F.concat(base, F.lit(e)) for e in EXTENSIONS] + [F.concat(base, F.lit("/index" + e)) for e in EXTENSIONS]
    return F.when(extname(base) == "", F.array(base, *more)).otherwise(F.array(base))


def exclusion(path: Column, attributes: Column | None = None, rules: Exclusions = Exclusions()) -> Column:
    """One of REASONS or null. `attributes` is a map of names to values; `set` and `true` are on."""
    folders = F.split(F.regexp_extract(path, "^(.*)/[^/]*$", 1), "/")

    def among(names):
        return F.arrays_overlap(folders, F.array(*[F.lit(n) for n in names]))

    own = path.isin(*rules.own)
    for prefix in rules.own_prefixes:
        own = own | path.startswith(prefix)
    out = F.when(own, "own").when(basename(path).isin(*rules.lockfiles), "lockfile")
    out = out.when(among(rules.generated), "generated-contract").when(among(rules.vendored), "vendored-contract")
    if attributes is not None:
        for names, reason in ((rules.generated_attributes, REASONS[4]), (rules.vendored_attributes, REASONS[5])):
            values = [F.coalesce(F.try_element_at(attributes, F.lit(n)), F.lit("")) for n in names]
            on = values[0].isin("set", "true")
            for v in values[1:]:
                on = on | v.isin("set", "true")
            out = out.when(on, reason)
    return out
