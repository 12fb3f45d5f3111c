"""Literal search: phrase frequencies from postings, BM25, bounded sources, reciprocal-rank fusion; one plan for all
literals.

What is searched is a `Stored` corpus, whose postings and statistics a store has written when documents were appended, or
a `Scanned` one, documents with tokens for which both are made on the spot.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from loomspark.functions.text import document_key, token_list
from loomspark.sources.store import DocumentStore

#: Rows read for a literal, the constant of rank fusion, and BM25's parameters.
BUDGET, FUSION, K1, B = 256, 60, 1.2, 0.75
MAX_LITERALS, MAX_LITERAL_BYTES, MAX_VIEW_LITERAL_BYTES, MAX_DEPTH, MAX_IDS, MAX_LIST, MAX_SCOPES = 5, 500, 512, 100, 128, 32, 16


class RequestError(ValueError):
    """A request outside its bounds."""


@dataclass(frozen=True)
class Filters:
    """Empty lists don't restrict. Bounds are inclusive. seq_bounds gives sessions a smallest sequence number."""

    scopes: tuple[str, ...] = ()
    workspaces: tuple[str, ...] = ()
    surfaces: tuple[str, ...] = ()
    event_types: tuple[str, ...] = ()
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    time_from: int | None = None
    time_to: int | None = None
    seq_bounds: dict[str, int] = field(default_factory=dict)

    def __post_init__(self):
        if max(map(len, (self.include, self.exclude, self.seq_bounds))) > MAX_IDS:
            raise RequestError("too many sessions")
        if max(map(len, (self.workspaces, self.surfaces, self.event_types))) > MAX_LIST or len(self.scopes) > MAX_SCOPES:
            raise RequestError("a list is too long")
        for values, most in ((self.include, 128), (self.exclude, 128), (self.workspaces, 4096), (self.surfaces, 64), (self.event_types, 96), (self.scopes, 64)):
            if len(set(values)) < len(values) or any(not 1 <= len(v.encode()) <= most or "\0" in v for v in values):
                raise RequestError("a list has repeated, empty or too long values")
        if any(n < 0 for n in self.seq_bounds.values()):
            raise RequestError("a sequence number is negative")
        if self.time_from is not None and self.time_to is not None and self.time_from > self.time_to:
            raise RequestError("an inverted range of time")

    def predicate(self) -> Column:
        out = F.lit(True)
        if self.scopes:
            out = out & F.arrays_overlap("scope_tokens", F.array(*[F.lit(s) for s in self.scopes]))
        named = (("workspace_id", self.workspaces), ("surface", self.surfaces), ("event_type", self.event_types), ("session_id", self.include))
        for name, values in named:
            if values:
                out = out & F.col(name).isin(*values)
        if self.exclude:
            out = out & ~F.col("session_id").isin(*self.exclude)
        if self.time_from is not None:
            out = out & (F.col("event_time_unix_ms") >= self.time_from)
        if self.time_to is not None:
            out = out & (F.col("event_time_unix_ms") <= self.time_to)
        for session, seq in self.seq_bounds.items():
            out = out & ~((F.col("session_id") == session) & (F.col("seq") < seq))
        return out


@dataclass(frozen=True)
class Request:
    literals: tuple[str, ...]
    depth: int = 100
    limit: int = 20
    filters: Filters = Filters()
    minimum_watermark: int | None = None
    most_bytes: int = MAX_LITERAL_BYTES

    def __post_init__(self):
        if not 1 <= len(self.literals) <= MAX_LITERALS or len(set(self.literals)) < len(self.literals):
            raise RequestError("one to five different literals are allowed")
        if any(not 1 <= len(x.encode()) <= self.most_bytes or "\0" in x for x in self.literals):
            raise RequestError("a literal is empty, too long or has a NUL")
        if not 1 <= self.depth <= MAX_DEPTH or not 1 <= self.limit <= MAX_DEPTH:
            raise RequestError("depth and limit are from 1 to 100")


class Corpus(Protocol):
    """keys name a document; `positions` gives term, keys, size, positions and other columns of the documents that have one
    of the terms; `stats` gives the number of documents and their mean size."""

    spark: SparkSession
    keys: tuple[str, ...]

    def positions(self, terms: list[str]) -> DataFrame: ...
    def stats(self) -> tuple[int, float]: ...


class Scanned:
    """Documents with tokens; a document's size is that of its tokens and its scope tokens."""

    def __init__(self, docs: DataFrame, keys: tuple[str, ...] = ("session_id", "seq"), scoped: bool = True):
        self.docs, self.keys, self.spark = docs, tuple(keys), docs.sparkSession
        self.size = "size(tokens)" + (" + coalesce(size(scope_tokens), 0)" if scoped else "")

    def positions(self, terms: list[str]) -> DataFrame:
        rest = [c for c in self.docs.columns if c not in (*self.keys, "tokens", "body")]
        rows = self.docs.selectExpr(*self.keys, *rest, f"{self.size} AS size", "posexplode(tokens) AS (pos, term)")
        rows = rows.filter(F.col("term").isin(terms) if terms else F.lit(False))
        held = rows.groupBy("term", *self.keys).agg(F.collect_list("pos").alias("positions"), F.first(F.struct("size", *rest)).alias("m"))
        return held.selectExpr("term", *self.keys, "positions", "m.*")

    def stats(self) -> tuple[int, float]:
        n, total = self.docs.selectExpr("count(*)", f"sum({self.size})").first()
        return n, float(total or 0) / n if n else 0.0


class Stored:
    """A store at its present generation."""

    keys = ("session_id", "seq")

    def __init__(self, store: DocumentStore):
        self.store = store if store.pinned is not None else store.reader()
        self.spark = store.spark

    def positions(self, terms: list[str]) -> DataFrame:
        return self.store.postings(terms)

    def stats(self) -> tuple[int, float]:
        n, total = self.store.stats()
        return n, float(total) / n if n else 0.0


Corpora = DataFrame | DocumentStore | Corpus


def corpus_of(docs: Corpora) -> Corpus:
    if isinstance(docs, DataFrame):
        return Scanned(docs)
    return Stored(docs) if isinstance(docs, DocumentStore) else docs


def phrase_frequencies(corpus: Corpus, literals: list[list[str]], rest: bool = False) -> DataFrame:
    """keys, ordinal, tf, and with `rest` size and the other columns. A phrase's terms meet once, by document and literal:
    their positions, each less its place in the phrase, have the phrase's starts in common. Single terms need no shuffle."""
    rows = [(o, i, term, len(terms)) for o, terms in enumerate(literals) for i, term in enumerate(terms)]
    found = corpus.positions(sorted({r[2] for r in rows}))
    others = [c for c in found.columns if c not in ("term", "positions", *corpus.keys)] if rest else []
    keys = [*corpus.keys, "ordinal"]

    def uses(wanted) -> str:
        cases = []
        for term in sorted({r[2] for r in wanted}):
            places = ", ".join(f"named_struct('ordinal', {o}, 'i', {i})" for o, i, x, _ in wanted if x == term)
            cases.append(f"WHEN '{term}' THEN array({places})")  # a term is of letters and digits
        return f"explode(CASE term {' '.join(cases)} END) AS a"

    single, many = [r for r in rows if r[3] == 1], [r for r in rows if r[3] > 1]
    parts = []
    if single or not many:
        ones = found.selectExpr(*corpus.keys, *others, "positions", uses(single) if single else "named_struct('ordinal', 0, 'i', 0) AS a")
        ones = ones.selectExpr(*corpus.keys, "a.ordinal AS ordinal", "CAST(size(positions) AS long) AS tf", *others)
        parts.append(ones if single else ones.filter("false"))
    if many:
        starts = found.selectExpr(*corpus.keys, *others, "positions", uses(many))
        starts = starts.selectExpr(*corpus.keys, "a.ordinal", "transform(positions, p -> p - a.i) AS starts", *others)
        n = "CASE ordinal " + " ".join(f"WHEN {o} THEN {len(t)}" for o, t in enumerate(literals) if len(t) > 1) + " END"
        met = starts.groupBy(*keys).agg(F.expr("collect_list(starts) AS all"), *[F.expr(f"first({c}) AS {c}") for c in others]).filter(f"size(all) = {n}")
        shared = "aggregate(slice(all, 2, 1000000), all[0], (x, y) -> array_intersect(x, y))"
        parts.append(met.selectExpr(*keys, f"CAST(size({shared}) AS long) AS tf", *others).filter("tf > 0"))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def corpus_stats(docs: Corpora) -> DataFrame:
    """n and avgdl over all documents."""
    corpus = corpus_of(docs)
    n, avgdl = corpus.stats()
    return corpus.spark.sql(f"SELECT CAST({n} AS long) AS n, CAST('{avgdl!r}' AS double) AS avgdl")


def scored(docs: Corpora, literals: tuple[str, ...], filters: Column | None = None) -> DataFrame:
    """All matches that pass the filters, with tf and score. Frequencies are over the whole corpus, before any filter: a
    first job counts each literal's documents, a number for each literal."""
    corpus = corpus_of(docs)
    terms = [token_list(x) for x in literals]
    counts = phrase_frequencies(corpus, terms).groupBy("ordinal").count().collect()
    n, avgdl = corpus.stats()
    weights = ["WHEN -1 THEN 0D"]
    for r in counts:
        idf = math.log((n - r["count"] + 0.5) / (r["count"] + 0.5))
        weights.append(f"WHEN {r['ordinal']} THEN CAST('{idf if idf > 0 else 1e-6!r}' AS double)")
    norm = f"(tf + {K1}D * ({1 - B}D + {B}D * size / CAST('{avgdl or 1.0!r}' AS double)))"
    hits = phrase_frequencies(corpus, terms, rest=True)
    hits = hits if filters is None else hits.filter(filters)
    return hits.selectExpr("*", f"(CASE ordinal {' '.join(weights)} END) * (tf * {K1 + 1}D) / {norm} AS score")


HIT = "session_id string, seq long, event_time_unix_ms long, event_type string, surface string, ordinal int, tf long, score double, place int"


def _hits(corpus: Corpus, request: Request) -> list[Row]:
    """For each literal the best BUDGET matches that pass the filters, with their place, in order. Each task keeps the best of
    its own; what comes to the driver, 1,280 rows at most, is all that ranking and fusion read."""
    if request.minimum_watermark is not None and isinstance(corpus, Stored):
        corpus.store.require(request.minimum_watermark)
    hits = scored(corpus, request.literals, request.filters.predicate())
    place = "row_number() OVER (PARTITION BY ordinal ORDER BY score DESC, session_id, seq) AS place"
    names = [c.split()[0] for c in HIT.split(", ")]
    rows = hits.selectExpr(*names[:-1], place).filter(f"place <= {BUDGET}").collect()
    return sorted(rows, key=lambda r: (r["ordinal"], r["place"]))


@dataclass(frozen=True)
class Found:
    """The hits of a request by literal, and by literal its first hit of each session up to the depth."""

    spark: SparkSession
    request: Request
    hits: list[list[Row]]
    ranked: list[list[Row]]


def find(docs: Corpora, request: Request) -> Found:
    corpus = corpus_of(docs)
    hits: list[list[Row]] = [[] for _ in request.literals]
    for r in _hits(corpus, request):
        hits[r["ordinal"]].append(r)
    ranked = []
    for rows in hits:
        first = {}
        for r in rows:
            first.setdefault(r["session_id"], r)
        ranked.append(list(first.values())[: request.depth])
    return Found(corpus.spark, request, hits, ranked)


def raw_hits(docs: Corpora, request: Request) -> DataFrame:
    """For each literal the best BUDGET matches that pass the filters, with their place in it."""
    found = find(docs, request)
    return found.spark.createDataFrame([r for rows in found.hits for r in rows], HIT)


def sources(docs: Corpora, request: Request, found: Found | None = None) -> DataFrame:
    """For each literal its first `depth` distinct sessions, each with its best hit."""
    found = found or find(docs, request)
    rows = [(*r, rank) for hits in found.ranked for rank, r in enumerate(hits, 1)]
    return found.spark.createDataFrame(rows, f"{HIT}, rank int")


def truncations(found: Found) -> list[tuple[int, str, int]]:
    """ordinal, reason, scanned for each literal: depth reached, budget used up, or neither, tested in this order."""
    out = []
    for i, (hits, ranked) in enumerate(zip(found.hits, found.ranked, strict=True)):
        full = len(ranked) == found.request.depth
        reason = "source-depth" if full else "posting-budget" if len(hits) >= BUDGET else "exhausted"
        out.append((i, reason, ranked[-1]["place"] if full else len(hits)))
    return out


def truncation(docs: Corpora, request: Request) -> DataFrame:
    found = find(docs, request)
    return found.spark.createDataFrame(truncations(found), "ordinal int, reason string, scanned long")


EVIDENCE = "struct<rank:int,ordinal:int,seq:long,event_type:string,surface:string,event_time_unix_ms:long>"
FUSED = f"session_id string, score double, parts array<struct<ordinal:int,rank:int>>, evidence {EVIDENCE}, position int, fused_truncated boolean"


def fuse(found: Found) -> list[tuple]:
    """Rows of FUSED, of at most five times a hundred sessions: each one's score is the sum over literals, in their order."""
    parts: dict[str, list[tuple]] = {}
    for ordinal, hits in enumerate(found.ranked):
        for rank, r in enumerate(hits, 1):
            parts.setdefault(r["session_id"], []).append((rank, ordinal, r["seq"], r["event_type"], r["surface"], r["event_time_unix_ms"]))
    scores = {s: sum((1.0 / (FUSION + p[0]) for p in p_), 0.0) for s, p_ in parts.items()}
    order = sorted(parts, key=lambda s: (-scores[s], s.encode()))
    more = len(order) > found.request.limit
    return [(s, scores[s], [(p[1], p[0]) for p in parts[s]], min(parts[s], key=lambda p: p[:3]), i, more) for i, s in enumerate(order[: found.request.limit], 1)]


def fused(docs: Corpora, request: Request, found: Found | None = None) -> DataFrame:
    """position, session_id, score, parts (contributions by ordinal), evidence (the best by rank, ordinal, seq) and
    fused_truncated (whether more sessions were found than the limit) of the fused sessions."""
    found = found or find(docs, request)
    return found.spark.createDataFrame(fuse(found), FUSED)


def search_batch(store: DocumentStore, request: Request) -> dict:
    """The whole answer of a request over one generation of a store: snapshot, sources with their truncation, the fused
    sessions with their contributions, and whether there were more. Bounded by the request's depth and limit."""
    corpus = Stored(store)
    found = find(corpus, request)
    generation, watermark = corpus.store.head()
    rows = [r for hits in found.ranked for r in hits]
    sessions = sorted({r["session_id"] for r in rows})  # at most five times the depth
    key = document_key(F.col("session_id"), F.col("seq"), F.col("fingerprint")).alias("key")
    wanted = found.spark.createDataFrame(sorted({(r["session_id"], r["seq"]) for r in rows}), "session_id string, seq long")
    keyed = corpus.store.documents().filter(F.col("session_id").isin(sessions)).select("session_id", "seq", key)
    keys = {(r["session_id"], r["seq"]): r["key"] for r in keyed.join(F.broadcast(wanted), ["session_id", "seq"], "left_semi").collect()}
    top = fuse(found)
    answers = []
    for (i, reason, scanned), hits in zip(truncations(found), found.ranked, strict=True):
        ranked = [r.asDict() | {"rank": k, "key": keys[r["session_id"], r["seq"]]} for k, r in enumerate(hits, 1)]
        answers.append({"literal": request.literals[i], "truncation": reason, "scanned": scanned, "ranked": ranked})
    return {
        "generation": generation, "watermark": watermark, "sources": answers,
        "fused": [{"session_id": r[0], "score": r[1], "contributions": r[2]} for r in top], "fused_truncated": bool(top and top[0][5]),
    }
