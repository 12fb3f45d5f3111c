"""Queries of repository evidence, over a repository that the tables stand for: the newest documents are its revisions, the
common words in them the paths that these touch; documents are its modules, pages its readmes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions import paths as P
from loomspark.operators import cochange, harvest, history, readme
from loomspark.sources import repository
from loomspark.sources.tables import table

#: The path that each word stands for.
PATHS = {w: f"{w[0]}/{w}" for w in ("a", "and", "for", "from", "in", "is", "it", "of", "on", "that", "the", "to")}
PATHS |= {"with": "gone/with", "as": "vendor/as", "at": "dist/at", "by": "b/yarn.lock", "is": "README.md"}
GONE, ATTRIBUTES = ("gone/with",), (("o/on", "linguist-generated", "set"), ("o/of", "vendored", "unset"))
ROUTES = (("t/the", True), ("o/of", True), ("a/a", False), ("i/in", True), ("t/to", True))
PREFIXES = ("", "src/", "a/dist/", "vendor/", "lib/node_modules/x/", "third_party/", "coverage/", "src/vendored.d/")
NORMAL = (
    ("a/b/../N", "a/N"), ("./N", "N"), ("../N", "../N"), ("a//N/", "a/N/"), ("/N/../..", "/"), ("N/..", "."), ("N/./x.js", "N/x.js"),
    ("x/../../N", "../N"), ("a/b/c/../../N", "a/N"), ("/a/../N", "/N"),
)


def _revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    newest = table(spark, sf_dir, "documents").select("doc_id", "text").orderBy(F.col("doc_id").desc()).limit(history.SCANNED)
    words = F.array_distinct(F.split(F.lower(F.coalesce("text", F.lit(""))), "[^a-z]+"))
    known = F.create_map(*[F.lit(x) for pair in PATHS.items() for x in pair])
    paths = F.transform(F.filter(words, lambda w: w.isin(*PATHS)), lambda w: F.element_at(known, w))
    return newest.select((-F.col("doc_id")).alias("pos"), paths.alias("paths"))


def _current(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p,) for p in sorted(set(PATHS.values()) - set(GONE))], "path string")


def retained(spark: SparkSession, sf_dir: str) -> history.Retained:
    attributes = spark.createDataFrame(list(ATTRIBUTES), "path string, attribute string, value string")
    return history.retain_eligible(_current(spark), _revisions(spark, sf_dir), attributes)


def retention_audit(spark, sf_dir):
    return retained(spark, sf_dir).audit


def candidate_status(spark, sf_dir):
    events = retained(spark, sf_dir).events
    found = {name: cochange.select_candidates(events, mode) for name, mode in cochange.MODES.items()}
    rows = [(name, f["status"], f["observations"], f["qualified"], len(f["candidates"])) for name, f in found.items()]
    return spark.createDataFrame(rows, "selector string, status string, observations long, qualified long, selected int")


def selected_candidates(spark, sf_dir):
    rows = cochange.select_candidates(retained(spark, sf_dir).events, False)["candidates"]
    return spark.createDataFrame([(i, r.a, r.b, r.support) for i, r in enumerate(rows)], "place int, a string, b string, support long")


def future_annotations(spark, sf_dir):
    kept = retained(spark, sf_dir).events
    support = cochange.pair_support(kept).filter(F.col("support") >= cochange.MIN_SHARED)
    gated = cochange.gated(cochange.pair_stats(kept, support, False)).join(support, ["a", "b"])
    return spark.createDataFrame(cochange.annotations(list(ROUTES), gated), "route string, companion string")


def change_heat(spark, sf_dir):
    return harvest.heat(_revisions(spark, sf_dir), _current(spark))


def _modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("lang", F.lit("xx")).alias("lang"))
    kind = F.element_at(F.array(*[F.lit(x) for x in (".js", ".ts", "/index.mjs")]), (F.col("doc_id") % 3 + 1).cast("int"))
    path = F.concat(F.lit("src/"), "lang", F.lit("/m"), F.col("doc_id").cast("string"), kind)
    n, m = (F.col("doc_id") % 40).cast("string"), (F.col("doc_id") % 25).cast("string")
    up = F.when(F.col("doc_id") % 3 == 2, "../..").otherwise("..")  # an index file is one folder further down
    here = F.when(F.col("doc_id") % 3 == 2, "../m").otherwise("./m")
    source = F.concat(
        F.lit("import x from '"), here, n, F.lit("';\nconst y = require( \""), up, F.lit("/en/m"), m, F.lit(".js\");\nimport 'os';\nimport('"), here, n, F.lit("')"),
    )
    return d.select("doc_id", "lang", path.alias("path"), source.alias("source"))


def module_specifiers(spark, sf_dir):
    return _modules(spark, sf_dir).select("path", F.explode(harvest.specifiers(F.col("source"))).alias("specifier"))


def module_imports(spark, sf_dir):
    modules = _modules(spark, sf_dir)
    return harvest.imports(modules, modules)


def import_fan_in(spark, sf_dir):
    modules = _modules(spark, sf_dir)
    return harvest.fan_in(modules, modules)


def evidence_packet(spark, sf_dir):
    modules = _modules(spark, sf_dir)
    packet = harvest.packet("r", "{}", _current(spark), change_heat(spark, sf_dir), harvest.fan_in(modules, modules))
    return packet.select(F.octet_length("packet").alias("n_bytes"), F.sha2("packet", 256).alias("sha256"))


def path_exclusions(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id")
    i = F.col("page_id")
    prefix = F.element_at(F.array(*[F.lit(x) for x in PREFIXES]), (i % len(PREFIXES) + 1).cast("int"))
    name = F.when(i % 13 == 0, "yarn.lock").otherwise(F.concat(F.lit("f"), i.cast("string"), F.lit(".js")))
    path = F.when(i % 17 == 0, "README.md").otherwise(F.concat(prefix, name))
    on = F.when(i % 11 == 0, F.create_map(F.lit("linguist-generated"), F.lit("true"))).when(i % 19 == 0, F.create_map(F.lit("vendored"), F.lit("set")))
    return pages.select("page_id", path.alias("path"), P.exclusion(path, on).alias("reason"))


def path_forms(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.explode(F.array(*[F.lit(t) for t, _ in NORMAL])).alias("form"))
    path = F.replace(F.col("form"), F.lit("N"), F.concat(F.lit("p"), F.col("page_id").cast("string")))
    return pages.select(
        "page_id", "form", P.normalized(path).alias("normal"), P.dirname(path).alias("folder"), P.basename(path).alias("base"), P.extname(path).alias("ext")
    )


def _readmes(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("page_id").cast("string")
    text = F.concat(
        F.lit("# T\n[x]("), F.coalesce("url", F.lit("#")), F.lit(") [y](../a/"), i, F.lit(".md#s) ![i](<img "), (F.col("page_id") % 7).cast("string"),
        F.lit('.png> "t")\n[r]: docs/f%20'), (F.col("page_id") % 9).cast("string"), F.lit(".md\n [k]: #top\n[z](/abs) [q](b\\c) [w](%zz) [v](c+d?e)\n"),
    )
    return table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("r"), i).alias("repository"), text.alias("text"))


def markdown_links(spark, sf_dir):
    links = _readmes(spark, sf_dir).select("page_id", F.explode(readme.destinations(F.col("text"))).alias("destination"))
    return links.select("page_id", "destination", readme.local_path(F.col("destination")).alias("l")).select("page_id", "destination", "l.status", "l.path")


def link_problems(spark, sf_dir):
    pages = _readmes(spark, sf_dir)
    docs = F.concat(F.lit("docs/f "), (F.col("page_id") % 9).cast("string"), F.lit(".md"))
    files = pages.select("repository", F.explode(F.array(docs, F.when(F.col("page_id") % 2 == 0, "c+d").otherwise("c"))).alias("path"))
    return readme.link_problems(pages, files)


def readme_projection(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    out = d.select("doc_id", readme.projections(F.col("text")).alias("projected"))
    return out.select("doc_id", F.length("projected").alias("n"), F.sha2("projected", 256).alias("sha256"))


def tree_scan(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    mode = F.element_at(F.array(*[F.lit(x) for x in ("100644", "100755", "120000", "160000")]), (F.col("n_nationkey") % 4 + 1).cast("int"))
    kind = F.when(F.col("n_nationkey") % 4 == 3, "commit").otherwise("blob")
    return repository.regular_files(n.select(mode.alias("mode"), kind.alias("type"), F.concat(F.lit("n/"), "n_name").alias("path")))


def registry_scan(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("place"), "n_name")
    line = F.when(F.col("place") % 5 == 0, F.concat(F.lit(" # "), "n_name")).when(F.col("place") % 5 == 1, "  ")
    return repository.registry(n.select("place", line.otherwise(F.concat(F.lit(" "), F.right("n_name", F.lit(1)), F.lit("  "))).alias("value")))


def nul_decoded(spark, sf_dir):
    """A NUL after each string, but for every third row."""
    n = table(spark, sf_dir, "nation").withColumn("end", F.when(F.col("n_nationkey") % 3 == 0, "").otherwise("\0"))
    data = F.encode(F.concat(F.col("n_name"), F.lit("\0é\0"), F.col("n_name"), F.col("end")), "UTF-8")
    return n.select("n_nationkey", F.array_join(repository.nul_column(data), "|").alias("decoded"))


def queries():
    plain = (
        retention_audit, candidate_status, selected_candidates, future_annotations, change_heat, module_specifiers, module_imports, import_fan_in,
        evidence_packet, path_exclusions, path_forms, markdown_links, link_problems, readme_projection, tree_scan, registry_scan, nul_decoded,
    )
    return {f.__name__: f for f in plain}
