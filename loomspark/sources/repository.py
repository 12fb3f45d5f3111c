"""Repositories as tables: tracked files, their attributes, the paths of revisions. What `git` prints is read as bytes with
NUL ends; everything else is DataFrames."""

from __future__ import annotations

import json
import os
import re
import subprocess
import tempfile
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions.paths import MODULE, Exclusions
from loomspark.operators import harvest, history

#: Bytes of one command's output, its seconds, bytes and entries of a registry, bytes of a report.
MAX_OUTPUT, SECONDS, MAX_REGISTRY, MAX_REPOSITORIES, MAX_REPORT = 32 << 20, 5, 64 << 10, 100, 16 << 20
REGULAR = ("100644", "100755")
ATTRIBUTES = (*Exclusions().generated_attributes, *Exclusions().vendored_attributes)


class RepositoryError(RuntimeError):
    """A repository, or what is known of it, outside its contract."""


def nul_strings(data: bytes, what: str = "output") -> list[str]:
    """UTF-8 strings with a NUL after each."""
    if data and not data.endswith(b"\0"):
        raise RepositoryError(f"{what} does not end with NUL")
    try:
        return [x.decode() for x in data[:-1].split(b"\0")] if data else []
    except UnicodeDecodeError as e:
        raise RepositoryError(f"{what} is not UTF-8") from e


def nul_column(data: Column) -> Column:
    """The same of a binary column: null where a NUL is missing at the end or the bytes are no UTF-8."""
    text = F.try_validate_utf8(data.cast("string"))
    parts = F.split(text, "\0")
    return F.when(F.length(data) == 0, F.array().cast("array<string>")).when(text.endswith("\0"), F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(1))))


def regular_files(tree: DataFrame) -> DataFrame:
    """path of the regular files of a tree (mode, type, path), in bytewise order."""
    return tree.filter(F.col("mode").isin(*REGULAR) & (F.col("type") == "blob")).select("path").orderBy("path")


def tree_rows(records: list[str]) -> list[tuple[str, str, str]]:
    """mode, type, path of the records of a tree listing."""
    found = [re.fullmatch(r"([^ \t]+) ([^ \t]+) [^ \t]+\t(.*)", r, re.DOTALL) for r in records]
    if not all(found):
        raise RepositoryError("a malformed tree")
    return [m.groups() for m in found]


def registry(lines: DataFrame) -> DataFrame:
    """place, repository of a registry's lines (place, value): trimmed, without blank ones and those that begin with #, each
    once, where it is first."""
    trimmed = lines.select("place", F.trim("value").alias("repository")).filter("repository <> '' AND NOT startswith(repository, '#')")
    return trimmed.groupBy("repository").agg(F.min("place").alias("place")).select("place", "repository")


def read_registry(spark: SparkSession, path: str) -> list[str]:
    """The repositories of a registry file, of at most MAX_REGISTRY bytes."""
    whole = spark.read.text(path, wholetext=True).select("value", F.octet_length("value").alias("n")).first()
    if whole is None:
        return []
    if whole.n > MAX_REGISTRY:
        raise RepositoryError("the registry is too long")
    rows = spark.createDataFrame(list(enumerate(whole.value.splitlines())), "place int, value string")
    found = [r.repository for r in registry(rows).orderBy("place").collect()]
    if len(found) > MAX_REPOSITORIES:
        raise RepositoryError("too many repositories")
    return found


def read_prefix(path: str, most: int) -> tuple[str, bool]:
    """The first `most` code points of a UTF-8 file and one more if there is one, and whether there is."""
    text = ""
    with open(path, encoding="utf-8", errors="replace", newline="") as f:
        text = f.read(most + 1)
    return text, len(text) > most


@dataclass(frozen=True)
class Repository:
    """tracked (path), attributes (path, attribute, value), revisions (pos, revision, paths), newest first, and modules (path,
    source) of a repository at its head."""

    root: str
    head: str
    tracked: DataFrame
    attributes: DataFrame
    revisions: DataFrame
    modules: DataFrame
    manifest: str | None


def _git(root: str, *args: str, stdin: bytes | None = None, index: str | None = None) -> bytes:
    env = {k: v for k, v in os.environ.items() if not k.startswith("GIT_")}
    env |= {"GIT_CONFIG_GLOBAL": "/dev/null", "GIT_CONFIG_NOSYSTEM": "1", "GIT_OPTIONAL_LOCKS": "0", "GIT_PAGER": "cat", "GIT_TERMINAL_PROMPT": "0", "LC_ALL": "C"}
    env |= {"GIT_INDEX_FILE": index} if index else {}
    command = ["git", "--no-pager", "--no-replace-objects", "-c", "core.attributesFile=/dev/null", "-C", root, *args]
    try:
        done = subprocess.run(command, env=env, input=stdin, capture_output=True, timeout=SECONDS, check=True)
    except (subprocess.SubprocessError, OSError) as e:
        raise RepositoryError(f"git {args[0]}: {(getattr(e, 'stderr', None) or str(e).encode())[:4096].decode(errors='replace').strip()}") from e
    if len(done.stdout) > MAX_OUTPUT:
        raise RepositoryError(f"git {args[0]} prints too much")
    return done.stdout


def read_repository(spark: SparkSession, root: str) -> Repository:
    """Reads a local repository without writing to it. One repository's files and revisions are bounded by the limits above."""
    head = _git(root, "rev-parse", "--verify", "HEAD^{commit}").decode().strip()
    if not re.fullmatch(r"[0-9a-f]{40}|[0-9a-f]{64}", head):
        raise RepositoryError("HEAD")
    tree = tree_rows(nul_strings(_git(root, "ls-tree", "-r", "--full-tree", "-z", head), "the tree"))
    paths = sorted((p for mode, kind, p in tree if mode in REGULAR and kind == "blob"), key=str.encode)
    listed = "".join(f"{p}\0" for p in paths).encode()
    with tempfile.TemporaryDirectory() as folder:  # an index of the head, for the attribute files that are in it
        index = f"{folder}/index"
        _git(root, "read-tree", head, index=index)
        values = nul_strings(_git(root, "check-attr", "--cached", "-z", *ATTRIBUTES, "--stdin", stdin=listed, index=index), "attributes") if paths else []
    if len(values) != 3 * len(paths) * len(ATTRIBUTES):
        raise RepositoryError("malformed attributes")
    attributes = [tuple(values[i : i + 3]) for i in range(0, len(values), 3)]
    lines = _git(root, "rev-list", "--first-parent", f"--max-count={history.SCANNED}", "--parents", head).decode().split("\n")
    revisions = []
    for pos, line in enumerate(x for x in lines if x):
        revision, *parents = line.split(" ")
        since = [parents[0]] if parents else ["--root"]
        changed = _git(root, "diff-tree", "--no-commit-id", "--name-only", "--no-renames", "--no-ext-diff", "-r", "-z", *since, revision)
        revisions.append((pos, revision, nul_strings(changed, f"revision {revision}")))
    sources = []
    for p in paths:
        if re.search(MODULE[4:], p, re.IGNORECASE):
            with open(os.path.join(root, p), encoding="utf-8", errors="replace", newline="") as f:
                sources.append((p, f.read()))
    manifest = None
    if "package.json" in paths:
        with open(os.path.join(root, "package.json"), encoding="utf-8") as f:
            try:
                manifest = json.dumps(json.load(f), indent=2, ensure_ascii=False)
            except ValueError as e:
                raise RepositoryError("package.json is not JSON") from e
    return Repository(
        root, head, spark.createDataFrame([(p,) for p in paths], "path string"),
        spark.createDataFrame(attributes, "path string, attribute string, value string"),
        spark.createDataFrame(revisions, "pos long, revision string, paths array<string>"),
        spark.createDataFrame(sources, "path string, source string"), manifest,
    )


def harvest_repository(spark: SparkSession, root: str) -> str:
    """The evidence packet of a repository."""
    r = read_repository(spark, root)
    fan_in = harvest.fan_in(r.modules, r.tracked)
    return harvest.packet(r.head, r.manifest, r.tracked, harvest.heat(r.revisions, r.tracked), fan_in).first()[0]


def analyze_repository(spark: SparkSession, root: str) -> dict:
    """What history.analyze finds, with the repository and its head."""
    r = read_repository(spark, root)
    return {"repository": r.root, "head": r.head, **history.analyze(r.tracked, r.revisions, r.attributes)}


def report(analyses: list[dict]) -> str:
    """Analyses as JSON of at most MAX_REPORT bytes."""

    def plain(x):
        if isinstance(x, dict):
            return {"/".join(k) if isinstance(k, tuple) else k: plain(v) for k, v in x.items()}
        if hasattr(x, "asDict"):
            return x.asDict()
        return [plain(y) for y in x] if isinstance(x, list | tuple) else x

    text = json.dumps(plain(analyses), sort_keys=True, indent=2, ensure_ascii=False) + "\n"
    if len(text.encode()) > MAX_REPORT:
        raise RepositoryError("the report is too long")
    return text
