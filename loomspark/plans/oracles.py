"""DuckDB SQL for the catalogue, written apart from the plans."""

from loomspark.plans import catalogue as q
from loomspark.plans import evidence as e

_LIT = ", ".join(f"({i}, '{x}')" for i, x in enumerate(q.LITERALS))
DOCS = r"""
c AS (
    SELECT 'conv-' || lpad(conv_id::VARCHAR, 8, '0') AS session_id, turn AS seq, role || '/message' AS event_type,
        CASE WHEN role = 'system' THEN 'log-only' ELSE 'current' END AS surface, '/ws/' || (conv_id % 7) AS workspace_id,
        1700000000000 + conv_id * 60000 + turn * 1000 AS event_time_unix_ms, coalesce(text, '') AS body,
        'w' || substr(sha256('loomspark/scope/v1' || chr(0) || '/ws/' || (conv_id % 7)), 1, 63) AS scope FROM conversations
)"""
TOKENS = r"regexp_extract_all(strip_accents(lower({})), '[\p{{L}}\p{{N}}]+')"
TK = DOCS + f", tk AS (SELECT *, {TOKENS.format('body')} AS tokens FROM c)"
TF = f"""{TK}, lit AS (SELECT ordinal, {TOKENS.format('x')} AS terms FROM (VALUES {_LIT}) v(ordinal, x)), st AS (
    SELECT count(*) AS n, sum(len(tokens) + 1)::DOUBLE / count(*) AS avgdl FROM tk
), tf AS (
    SELECT * FROM (SELECT ordinal, tk.*, len(list_filter(range(1, len(tokens) - len(terms) + 2), lambda i: tokens[i:i + len(terms) - 1] = terms)) AS tf FROM tk, lit)
    WHERE tf > 0
), df AS (SELECT ordinal, count(*) AS df FROM tf GROUP BY ordinal), idf AS (
    SELECT ordinal, n, avgdl, ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) AS idf FROM df, st
), scored AS (
    SELECT tf.*, CASE WHEN idf <= 0 THEN 1e-6::DOUBLE ELSE idf END * (tf * 2.2::DOUBLE)
        / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * (len(tokens) + 1) / avgdl)) AS score FROM tf JOIN idf USING (ordinal)
)"""


def ranked(where: str = "true", depth: int = 100, only: str = "true") -> str:
    return f"""{TF}, raw AS (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ordinal ORDER BY score DESC, session_id, seq) AS place
        FROM scored WHERE ({where}) AND ({only})) WHERE place <= 256
), firsts AS (
    SELECT *, row_number() OVER (PARTITION BY ordinal ORDER BY place) AS rank FROM (
        SELECT *, row_number() OVER (PARTITION BY ordinal, session_id ORDER BY place) AS k FROM raw) WHERE k = 1
), src AS (SELECT * FROM firsts WHERE rank <= {depth}), fused AS (
    SELECT session_id, list_reduce(list_prepend(0.0::DOUBLE, list(1.0::DOUBLE / (60 + rank) ORDER BY ordinal)), lambda a, b: a + b) AS score,
        string_agg(ordinal::VARCHAR, ',' ORDER BY ordinal) AS ordinals,
        min({{'rank': rank, 'ordinal': ordinal, 'seq': seq, 'event_type': event_type}}) AS e FROM src GROUP BY session_id
), top AS (SELECT *, row_number() OVER (ORDER BY score DESC, session_id) AS position FROM fused)"""


def sources(where: str = "true") -> str:
    return f"WITH {ranked(where)} SELECT ordinal, rank, session_id, seq, round(score, 12) AS score FROM src"


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _where(f) -> str:
    parts = [f"{c} IN {_in(v)}" for c, v in (("workspace_id", f.workspaces), ("surface", f.surfaces), ("event_type", f.event_types), ("session_id", f.include)) if v]
    parts += [f"session_id NOT IN {_in(f.exclude)}"] * bool(f.exclude)
    parts += [f"event_time_unix_ms >= {f.time_from}"] * (f.time_from is not None) + [f"event_time_unix_ms <= {f.time_to}"] * (f.time_to is not None)
    parts += [f"NOT (session_id = '{s}' AND seq < {n})" for s, n in f.seq_bounds.items()]
    return " AND ".join(parts)


def _words() -> str:
    reason = {"vendor/as": "vendored-contract", "dist/at": "generated-contract", "b/yarn.lock": "lockfile", "README.md": "own", "o/on": "generated-attribute"}
    rows = [f"('{w}', '{p}', {repr(reason[p]) if p in reason else 'NULL'}, {p not in e.GONE})" for w, p in e.PATHS.items()]
    return ", ".join(rows)


RETAINED = rf"""
m(word, path, reason, there) AS (VALUES {_words()}),
d400 AS (SELECT row_number() OVER (ORDER BY doc_id DESC) AS pos, list_distinct(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z]+')) AS w
    FROM (SELECT doc_id, text FROM documents ORDER BY doc_id DESC LIMIT 400)),
touch AS (SELECT DISTINCT pos, path, reason, there FROM d400, m WHERE list_contains(w, word)),
seen400 AS (SELECT d400.pos, count(path) AS n, count(*) FILTER (there) AS nc, list_sort(list(path) FILTER (there AND reason IS NULL)) AS paths
    FROM d400 LEFT JOIN touch USING (pos) GROUP BY d400.pos),
told AS (SELECT *, CASE WHEN n = 0 THEN 'empty' WHEN nc = 0 THEN 'no-current-regular-path' WHEN paths IS NULL THEN 'excluded-only'
    WHEN len(paths) > 20 THEN 'bulk' ELSE 'retained' END AS first_outcome FROM seen400),
outc AS (SELECT *, CASE WHEN coalesce(sum((first_outcome = 'retained')::INT) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) >= 200
    THEN 'older-after-retention' ELSE first_outcome END AS outcome FROM told),
kept AS (SELECT row_number() OVER (ORDER BY pos) - 1 AS p, paths FROM outc WHERE outcome = 'retained'),
ev AS (SELECT p, unnest(paths) AS path FROM kept), sup AS (
    SELECT x.path AS a, y.path AS b, count(*) AS support FROM ev x JOIN ev y USING (p)
    WHERE x.path < y.path AND split_part(x.path, '/', 1) <> split_part(y.path, '/', 1) GROUP BY ALL HAVING count(*) >= 6
)"""
_GATES = """opportunities >= 12 AND shared >= 6 AND shared * 5 >= least("left", "right") * 3 AND shared * 10 >= opportunities * 3
    AND band0 > 0 AND band1 > 0 AND band2 > 0"""
_CAND = f"""cand AS (SELECT a, b, support, row_number() OVER (ORDER BY support DESC, shared / opportunities DESC, shared / least("left", "right") DESC, a, b) AS k
    FROM stats JOIN sup USING (a, b) WHERE {_GATES})"""
_SEL = """sel(k, used, n) AS (SELECT 0::BIGINT, []::VARCHAR[], 0 UNION ALL
    SELECT cand.k, CASE WHEN n < 4 AND NOT list_contains(used, a) AND NOT list_contains(used, b) THEN list_concat(used, [a, b]) ELSE used END,
        n + (n < 4 AND NOT list_contains(used, a) AND NOT list_contains(used, b))::INT FROM sel JOIN cand ON cand.k = sel.k + 1)"""
_REASONS = ("own", "lockfile", "generated-contract", "vendored-contract", "generated-attribute", "vendored-attribute")


def _audit() -> str:
    current = len(set(e.PATHS.values()) - set(e.GONE))
    looked = "outc JOIN touch USING (pos) WHERE outcome <> 'older-after-retention'"
    rows = {
        ("summary", "revisionsScanned"): "SELECT count(*) FROM outc", ("summary", "scanLimitReached"): "SELECT (count(*) = 400)::INT FROM outc",
        ("summary", "retentionLimitReached"): "SELECT (count(*) = 200)::INT FROM kept", ("summary", "retainedEligibleDiffs"): "SELECT count(*) FROM kept",
        ("summary", "changedPathsExamined"): "SELECT coalesce(sum(n), 0) FROM outc WHERE outcome <> 'older-after-retention'",
        ("summary", "bulkPathLimit"): "SELECT 20", ("summary", "trackedRegularFiles"): f"SELECT {current}",
        ("summary", "eligibleCurrentFiles"): "SELECT count(*) FROM m WHERE there AND reason IS NULL",
        ("excludedPathTouches", "nonCurrent"): f"SELECT count(*) FROM {looked} AND NOT there",
    }
    rows |= {("excludedCurrentFiles", r): f"SELECT count(*) FROM m WHERE there AND reason = '{r}'" for r in _REASONS}
    rows |= {("excludedPathTouches", r): f"SELECT count(*) FROM {looked} AND there AND reason = '{r}'" for r in _REASONS}
    names = ("empty", "no-current-regular-path", "excluded-only", "bulk", "older-after-retention")
    rows |= {("omittedDiffs", o): f"SELECT count(*) FROM outc WHERE outcome = '{o}'" for o in names}
    return f"WITH {RETAINED} " + " UNION ALL ".join(f"SELECT '{p}' AS part, '{k}' AS key, ({q})::BIGINT AS n" for (p, k), q in rows.items())


def pair_stats(relative: bool) -> str:
    place = "row_number() OVER (PARTITION BY a, b ORDER BY p) - 1" if relative else "p"
    limit = "WHERE q < 24" if relative else ""
    total = "count(*) OVER (PARTITION BY a, b)" if relative else "(SELECT count(*) FROM kept)"
    bands = ", ".join(f"sum(CASE WHEN band = {i} THEN l * r ELSE 0 END)::BIGINT AS band{i}" for i in range(3))
    return f"""{RETAINED}, seen AS (
    SELECT a, b, p, max((path = a)::INT) AS l, max((path = b)::INT) AS r FROM sup JOIN ev ON path = a OR path = b GROUP BY a, b, p
), placed AS (SELECT *, {place} AS q FROM seen), dealt AS (SELECT *, {total} AS n FROM placed {limit}), banded AS (
    SELECT *, CASE WHEN q < n // 3 THEN 0 WHEN q < 2 * n // 3 THEN 1 ELSE 2 END AS band FROM dealt
), stats AS (
    SELECT a, b, sum(l)::BIGINT AS "left", sum(r)::BIGINT AS "right", sum(l * r)::BIGINT AS shared, count(*) AS opportunities, {bands}
    FROM banded GROUP BY a, b
)"""


_CURSORS = f"{DOCS}, now AS (SELECT session_id, max(seq) + 1 AS next_seq FROM c GROUP BY session_id)"


MODULES = """mods AS (SELECT doc_id, coalesce(lang, 'xx') AS lang, 'src/' || coalesce(lang, 'xx') || '/m' || doc_id ||
    CASE doc_id % 3 WHEN 0 THEN '.js' WHEN 1 THEN '.ts' ELSE '/index.mjs' END AS path FROM documents),
imp AS (SELECT DISTINCT importer, target FROM (
    SELECT x.path AS importer, y.path AS target FROM mods x JOIN mods y ON y.lang = x.lang AND y.doc_id = x.doc_id % 40
    UNION ALL SELECT x.path, y.path FROM mods x JOIN mods y ON y.lang = 'en' AND y.doc_id = x.doc_id % 25 AND y.doc_id % 3 = 0) WHERE importer <> target),
fan AS (SELECT target AS path, count(*) AS count FROM imp GROUP BY 1)"""
HEAT = """heat AS (SELECT path, count(*) AS count FROM touch WHERE there AND pos <= 200 GROUP BY 1)"""
_BLOCK = "(SELECT coalesce(string_agg(count || chr(9) || '\"' || path || '\"', chr(10) ORDER BY count DESC, path), '(none)') FROM {})"


def _evidence() -> dict[str, str]:
    routes = ", ".join(f"({i + 1}, '{r}', {j})" for i, (r, j) in enumerate(e.ROUTES))
    prefixes = " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(e.PREFIXES))
    forms = ", ".join(f"('{a}', '{b}')" for a, b in e.NORMAL)
    head = "# Evidence packet\n\nPaths are JSON strings, so that unusual names can''t change the packet''s structure.\nRevision: r\n\n## package.json\n\n```json\n{}\n```\n\n"
    paths = "\n".join(f'"{p}"' for p in sorted(set(e.PATHS.values()) - set(e.GONE)))
    packet = f"""'{head}## Tracked files\n\n```text\n{paths}\n```\n\n## Change heat (in the last 200 revisions)\n\n```text\n' || {_BLOCK.format('heat')}
        || '\n```\n\n## Import fan-in (distinct tracked relative importers)\n\n```text\n' || {_BLOCK.format('fan')} || '\n```\n'"""
    support = "(SELECT coalesce(sum(s), 0)::BIGINT FROM (SELECT count(*) AS s FROM ev x JOIN ev y USING (p) WHERE x.path < y.path AND split_part(x.path, '/', 1) <> split_part(y.path, '/', 1)))"
    status = " UNION ALL ".join(
        f"""SELECT * FROM (WITH RECURSIVE {pair_stats(mode)}, {_CAND}, {_SEL} SELECT '{name}' AS selector, 'ok' AS status, {support} AS observations,
            (SELECT count(*) FROM cand) AS qualified, (SELECT max(n) FROM sel)::INT AS selected)"""
        for name, mode in (("pair-relative-v1", True), ("repository-window-v1", False))
    )
    return {
        "retention_audit": _audit(),
        "candidate_status": status,
        "selected_candidates": f"""WITH RECURSIVE {pair_stats(False)}, {_CAND}, {_SEL} SELECT (sel.n - 1)::INT AS place, a, b, support
            FROM sel JOIN cand USING (k) WHERE list_contains(used, a) AND used[-2] = a AND used[-1] = b""",
        "future_annotations": f"""WITH RECURSIVE {pair_stats(False)}, {_CAND}, r(i, route, justified) AS (VALUES {routes}),
            ch AS (SELECT i, route, justified, CASE WHEN a = route THEN b ELSE a END AS companion, support,
                row_number() OVER (PARTITION BY i ORDER BY k) AS c, lead(support) OVER (PARTITION BY i ORDER BY k) AS next FROM r JOIN cand ON a = route OR b = route),
            best AS (SELECT r.i, r.route, ch.companion, r.justified AND ch.companion IS NOT NULL AND (next IS NULL OR support - next >= 2) AS fit
                FROM r LEFT JOIN ch ON ch.i = r.i AND c = 1),
            walk(i, used, n, took) AS (SELECT 0, []::VARCHAR[], 0, false UNION ALL SELECT best.i,
                CASE WHEN fit AND n < 2 AND NOT list_contains(used, route) AND NOT list_contains(used, companion) THEN list_concat(used, [route, companion]) ELSE used END,
                n + (fit AND n < 2 AND NOT list_contains(used, route) AND NOT list_contains(used, companion))::INT,
                fit AND n < 2 AND NOT list_contains(used, route) AND NOT list_contains(used, companion) FROM walk JOIN best ON best.i = walk.i + 1)
            SELECT route, companion FROM walk JOIN best USING (i) WHERE took""",
        "change_heat": f"WITH {RETAINED}, {HEAT} SELECT path, count FROM heat",
        "module_specifiers": f"""WITH {MODULES} SELECT path, unnest(list_distinct([CASE doc_id % 3 WHEN 2 THEN '../m' ELSE './m' END || (doc_id % 40),
            CASE doc_id % 3 WHEN 2 THEN '../..' ELSE '..' END || '/en/m' || (doc_id % 25) || '.js', 'os'])) AS specifier FROM mods""",
        "module_imports": f"WITH {MODULES} SELECT importer, target FROM imp",
        "import_fan_in": f"WITH {MODULES} SELECT path, count FROM fan",
        "evidence_packet": f"WITH {RETAINED}, {HEAT}, {MODULES}, t AS (SELECT {packet} AS x) SELECT strlen(x)::INT AS n_bytes, sha256(x) AS sha256 FROM t",
        "path_exclusions": f"""SELECT page_id, path, CASE WHEN path = 'README.md' THEN 'own' WHEN path LIKE '%yarn.lock' THEN 'lockfile'
            WHEN path LIKE '%dist/%' OR path LIKE '%node_modules/%' OR path LIKE 'coverage/%' THEN 'generated-contract'
            WHEN path LIKE 'vendor/%' OR path LIKE 'third_party/%' THEN 'vendored-contract'
            WHEN page_id % 11 = 0 THEN 'generated-attribute' WHEN page_id % 19 = 0 THEN 'vendored-attribute' END AS reason FROM (
            SELECT page_id, CASE WHEN page_id % 17 = 0 THEN 'README.md' ELSE CASE page_id % 8 {prefixes} END ||
                CASE WHEN page_id % 13 = 0 THEN 'yarn.lock' ELSE 'f' || page_id || '.js' END END AS path FROM pages)""",
        "path_forms": f"""WITH f(form, expected) AS (VALUES {forms}), x AS (SELECT page_id, form, replace(form, 'N', 'p' || page_id) AS path,
                replace(expected, 'N', 'p' || page_id) AS normal FROM pages, f), y AS (SELECT *, regexp_replace(path, '(.)/+$', '\\1') AS bare FROM x)
            SELECT page_id, form, normal, CASE WHEN NOT contains(bare, '/') THEN '.' WHEN regexp_extract(bare, '^(.*)/[^/]*$', 1) = '' THEN '/'
                ELSE regexp_extract(bare, '^(.*)/[^/]*$', 1) END AS folder, regexp_extract(bare, '([^/]*)$', 1) AS base,
                CASE WHEN bare LIKE '%x.js' THEN '.js' ELSE '' END AS ext FROM y""",
        "markdown_links": """SELECT page_id, unnest.destination, unnest.status, unnest.path FROM (SELECT page_id, unnest(list_distinct([
                {'destination': coalesce(url, '#'), 'status': 'skip', 'path': NULL}, {'destination': '../a/' || page_id || '.md#s', 'status': 'local', 'path': '../a/' || page_id || '.md'},
                {'destination': 'img ' || (page_id % 7) || '.png', 'status': 'local', 'path': 'img ' || (page_id % 7) || '.png'},
                {'destination': 'docs/f%20' || (page_id % 9) || '.md', 'status': 'local', 'path': 'docs/f ' || (page_id % 9) || '.md'},
                {'destination': '#top', 'status': 'skip', 'path': NULL}, {'destination': '/abs', 'status': 'invalid', 'path': NULL},
                {'destination': 'b\\c', 'status': 'invalid', 'path': NULL}, {'destination': '%zz', 'status': 'invalid', 'path': NULL},
                {'destination': 'c+d?e', 'status': 'local', 'path': 'c+d'}])) AS unnest FROM pages)""",
        "link_problems": """SELECT 'r' || page_id AS repository, unnest.d AS destination, unnest.p AS problem FROM (SELECT page_id, unnest([
                {'d': '../a/' || page_id || '.md#s', 'p': 'escapes'}, {'d': 'img ' || (page_id % 7) || '.png', 'p': 'missing'}, {'d': '/abs', 'p': 'invalid'},
                {'d': 'b\\c', 'p': 'invalid'}, {'d': '%zz', 'p': 'invalid'}, {'d': 'c+d?e', 'p': CASE WHEN page_id % 2 = 0 THEN 'none' ELSE 'missing' END}]) AS unnest FROM pages)
            WHERE unnest.p <> 'none'""",
        "tree_scan": "SELECT 'n/' || n_name AS path FROM nation WHERE n_nationkey % 4 < 2",
        "registry_scan": "SELECT min(n_nationkey) AS place, right(n_name, 1) AS repository FROM nation WHERE n_nationkey % 5 > 1 GROUP BY 2",
        "nul_decoded": "SELECT n_nationkey, CASE WHEN n_nationkey % 3 <> 0 THEN n_name || '|é|' || n_name END AS decoded FROM nation",
    }


def _records() -> dict[str, str]:
    literals = "(0, 'the'), (1, 'of the'), (2, 'in')"
    search = ranked("event_type = 'user/message' AND workspace_id IN ('/ws/1', '/ws/2') AND event_time_unix_ms >= 1700000000000").replace(_LIT, literals)
    fields = "{'session_id': session_id, 'seq': seq, 'event_time_unix_ms': event_time_unix_ms, 'event_type': event_type, 'surface': surface, 'workspace_id': workspace_id, 'body': body}"
    event, revision = (f"sha256('loomspark/{d}/v1' || chr(0) || to_json({fields})::VARCHAR)" for d in ("event", "revision"))
    document = ("{'session_id': session_id, 'seq': seq, 'event_time_unix_ms': event_time_unix_ms, 'event_type': event_type, 'surface': surface, "
        f"'workspace_id': workspace_id, 'scope_tokens': [scope], 'body': body, 'fingerprint': {event}, 'source_revision': {revision}}}")  # fmt: skip
    return {
        "exact_range": """SELECT 'o' || o_orderkey AS row_key, o_orderkey % 5000 AS ordinal, o_orderpriority AS value FROM orders
            WHERE o_orderstatus = 'O' AND o_custkey % 3 <> 1 AND o_orderkey % 5000 BETWEEN 100 AND 4000 ORDER BY 2, 1 LIMIT 32""",
        "view_status": "SELECT 'ready' AS state, 'f2' AS fence, 20::BIGINT AS lag_ms",
        "view_checkpoints": """SELECT * FROM (VALUES ('F', 'orders', 'r0', 0::BIGINT, 'f0', 0::BIGINT), ('P', 'orders', 'r2', 2, 'f2', 20))
            t("partition", source_identity, revision, "cursor", fence, lag_ms)""",
        "view_partition_rows": """SELECT o_orderstatus AS "partition", count(*) AS n, sum(o_orderkey % 5000)::BIGINT AS ordinals FROM orders GROUP BY 1""",
        "view_reconcile": """SELECT * FROM (VALUES ('F', 'delete'), ('O', 'skip'), ('P', 'replace'), ('X', 'replace')) t("partition", action)""",
        "view_session_search": f"""WITH {search}, last AS (SELECT session_id, max(event_time_unix_ms) AS updated FROM c GROUP BY 1)
            SELECT position AS rank, session_id, round(score, 9) AS score, ordinals, updated, e.seq AS seq, (SELECT max(position) > 30 FROM top) AS truncated
            FROM top JOIN last USING (session_id) WHERE position <= 30""",
        "store_cursors": f"WITH {DOCS} SELECT session_id, any_value(workspace_id) AS workspace_id, max(seq) + 1 AS next_seq FROM c GROUP BY 1",
        "store_source_state": f"""WITH {DOCS} SELECT session_id, max(seq) + 1 AS next_seq, any_value(workspace_id) AS workspace_id FROM c
            WHERE session_id IN ('conv-00000001', 'conv-00000003', 'conv-00000005', 'conv-10000000') GROUP BY 1""",
        "store_documents": f"""WITH {DOCS} SELECT session_id, seq, 'document-v1:' || strlen(session_id) || ':' || session_id || ':' || seq || ':' || sha256(body) AS key,
            scope AS scopes FROM c""",
        "store_head": f"WITH {TK} SELECT 1::BIGINT AS generation, 1::BIGINT AS watermark, count(*) AS documents, sum(len(tokens) + 1)::BIGINT AS tokens FROM tk",
        "store_postings": f"""WITH {TK}, x AS (SELECT unnest(['the', 'la']) AS term, tokens FROM tk), y AS (SELECT term, len(list_filter(tokens, lambda t: t = term)) AS n,
            len(tokens) + 1 AS size FROM x) SELECT term, count(*) AS df, sum(n)::BIGINT AS cf, sum(size)::BIGINT AS sizes FROM y WHERE n > 0 GROUP BY 1""",
        "sync_status": f"""WITH {DOCS}, x AS (SELECT session_id, substr(session_id, 6)::BIGINT AS i, count(*) AS n,
                count(*) FILTER (seq <> 0 OR substr(session_id, 6)::BIGINT % 5 <> 0) + count(*) FILTER (seq = 1 AND substr(session_id, 6)::BIGINT % 11 = 0) AS have FROM c GROUP BY 1)
            SELECT session_id, CASE WHEN n > have THEN 'cursor-ahead' WHEN i % 7 = 0 THEN 'workspace-mismatch' WHEN n = have THEN 'unchanged' ELSE 'new' END AS status
            FROM x WHERE have > 0""",
        "replay_delta": f"WITH {DOCS} SELECT session_id, seq FROM c WHERE seq >= 2",
        "batch_chunks": f"""WITH RECURSIVE {DOCS}, sz AS (SELECT session_id, seq, strlen(to_json({document})::VARCHAR) + 1 AS bytes FROM c),
            run(session_id, seq, chunk, held, total) AS (
                SELECT session_id, seq, CASE WHEN bytes > 100000 THEN NULL ELSE 0 END::BIGINT, (bytes <= 100000)::INT, CASE WHEN bytes > 100000 THEN 2 ELSE 2 + bytes END FROM sz WHERE seq = 0
                UNION ALL SELECT sz.session_id, sz.seq, chunk + (held >= 3 OR total + bytes > 100000)::INT,
                    CASE WHEN held >= 3 OR total + bytes > 100000 THEN 1 ELSE held + 1 END, CASE WHEN held >= 3 OR total + bytes > 100000 THEN 2 + bytes ELSE total + bytes END
                FROM run JOIN sz ON sz.session_id = run.session_id AND sz.seq = run.seq + 1)
            SELECT session_id, seq, chunk FROM run""",
        "log_projection": r"""SELECT 'conv-' || lpad(conv_id::VARCHAR, 8, '0') AS session_id, turn::BIGINT AS seq, 1700000000000 + turn AS event_time_unix_ms,
            role || '/message' AS event_type, 'current' AS surface, CASE WHEN conv_id % 2 = 0 THEN '/ws/' || (conv_id % 7) ELSE 'g' || (conv_id % 3) END AS workspace_id,
            sha256(CASE WHEN role = 'system' THEN '' ELSE coalesce(text, '') END) AS body_sha256 FROM conversations""",
        "corpus_listing": f"WITH {DOCS} SELECT DISTINCT session_id FROM c",
        "coerced_times": f"""WITH {DOCS} SELECT session_id, seq, CASE substr(session_id, 6)::BIGINT % 4 WHEN 0 THEN event_time_unix_ms
            WHEN 1 THEN event_time_unix_ms // 1000 * 1000 WHEN 3 THEN event_time_unix_ms // 86400000 * 86400000 END AS at FROM c""",
        "parsed_numbers": """SELECT page_id, unnest.k::INT AS k, unnest.v AS value FROM (SELECT page_id, unnest([{'k': 0, 'v': page_id}, {'k': 1, 'v': CASE WHEN page_id IS NULL THEN 0 END},
            {'k': 2, 'v': NULL}, {'k': 3, 'v': NULL}, {'k': 4, 'v': NULL}, {'k': 5, 'v': 0}]) AS unnest FROM pages)""",
        "text_fields": r"""SELECT page_id, to_json('q"' || u || '\')::VARCHAR AS quoted, CASE WHEN u = '' THEN 'none' ELSE regexp_replace(substr(u, 1, 64), '[^A-Za-z0-9_.:-]', '_', 'g') END AS field,
            substr('é😀' || u, 1, 5) AS prefix, strlen(u) BETWEEN 1 AND 40 AS fits, 'a ' || trim(regexp_replace(u, '\s+', ' ', 'g')) AS spaced
            FROM (SELECT page_id, coalesce(url, '') AS u FROM pages)""",
        "canonical_digests": """SELECT n_nationkey, sha256('loomspark/test/v1' || chr(0) || '{"key":' || n_nationkey || ',"name":"' || n_name || '"}') AS digest FROM nation""",
        "prefix_clips": r"""SELECT doc_id, CASE WHEN length(t) <= 256 THEN t ELSE rtrim(substr(t, 1, 255)) || '…' END AS clip
            FROM (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS t FROM documents)""",
    }


def oracles() -> dict[str, str]:
    found = {
        "tokenize_stats": f"WITH {TK} SELECT event_type, count(*) AS n, sum(len(tokens))::BIGINT AS n_tokens, max(len(tokens))::INT AS longest FROM tk GROUP BY 1",
        "corpus_stats": f"WITH {TK} SELECT count(*) AS n, round(sum(len(tokens) + 1)::DOUBLE / count(*), 9) AS avgdl FROM tk",
        "phrase_tf": f"WITH {TF} SELECT ordinal, session_id, seq, tf FROM tf",
        "bm25_single": f"WITH {ranked(only='ordinal = 1')} SELECT place, session_id, seq, tf, round(score, 12) AS score FROM raw",
        "truncation_report": f"""WITH {ranked(depth=40)} SELECT lit.ordinal, CASE WHEN reached IS NOT NULL THEN 'source-depth'
            WHEN coalesce(c, 0) >= 256 THEN 'posting-budget' ELSE 'exhausted' END AS reason, coalesce(reached, c, 0)::BIGINT AS scanned
            FROM lit LEFT JOIN (SELECT ordinal, count(*) AS c FROM raw GROUP BY 1) USING (ordinal)
            LEFT JOIN (SELECT ordinal, place AS reached FROM firsts WHERE rank = 40) USING (ordinal)""",
        "rrf_fused": f"WITH {ranked()} SELECT position, session_id, round(score, 9) AS score FROM top WHERE position <= 20",
        "rrf_contributions": f"WITH {ranked()} SELECT session_id, ordinal, rank FROM src JOIN top USING (session_id) WHERE position <= 20",
        "view_conversation_search": f"WITH {ranked()} SELECT position, session_id, ordinals, e.rank AS rank, e.ordinal AS ordinal, e.seq AS seq, e.event_type AS event_type FROM top WHERE position <= 20",
        "scope_restricted": sources("workspace_id IN ('/ws/0', '/ws/4')"),
        "bm25_five_sources": sources(),
        "session_best_top101": f"""WITH d AS (SELECT doc_id, source, {TOKENS.format("coalesce(text, '')")} AS tokens FROM documents WHERE text IS NOT NULL OR true),
            s AS (SELECT count(*) AS n, sum(len(tokens))::DOUBLE / count(*) AS avgdl FROM d),
            t AS (SELECT * FROM (SELECT *, len(list_filter(tokens, lambda x: x = 'the')) AS tf FROM d) WHERE tf > 0),
            i AS (SELECT n, avgdl, ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) AS idf FROM s, (SELECT count(*) AS df FROM t)),
            g AS (SELECT doc_id, source, CASE WHEN idf <= 0 THEN 1e-6::DOUBLE ELSE idf END * (tf * 2.2::DOUBLE) / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len(tokens) / avgdl)) AS score FROM t, i),
            r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id DESC) AS k FROM g)
            SELECT source, doc_id, round(score, 12) AS score FROM r WHERE k = 1 ORDER BY r.score DESC, source LIMIT 101""",
        "session_cursors": f"WITH {DOCS} SELECT session_id, max(seq) + 1 AS next_seq, arg_max(event_type, seq) AS last_type FROM c GROUP BY 1",
        "session_last_update": f"WITH {DOCS} SELECT session_id, seq, max(event_time_unix_ms) OVER (PARTITION BY session_id) AS session_updated_at_unix_ms FROM c",
        "contiguity_check": f"""WITH {DOCS}, g AS (SELECT session_id, seq <> row_number() OVER (PARTITION BY session_id ORDER BY seq) - 1 AS wrong,
            seq <> coalesce(lag(seq) OVER (PARTITION BY session_id ORDER BY seq) + 1, 0) AS gap FROM c) SELECT session_id, count(*) AS n, sum(gap::INT)::BIGINT AS gaps FROM g GROUP BY 1""",
        "retained_events": f"WITH {RETAINED} SELECT p, array_to_string(paths, ' ') AS paths FROM kept",
        "pair_support": f"WITH {RETAINED} SELECT a, b, support FROM sup",
        "pair_stats_repository_window": f"WITH {pair_stats(False)} SELECT * FROM stats",
        "pair_stats_pair_relative": f"WITH {pair_stats(True)} SELECT * FROM stats",
        "gated_candidates": f"WITH {pair_stats(False)} SELECT * FROM stats WHERE {_GATES}",
        "verified_candidates": rf"""WITH {ranked()}, texts AS (SELECT ordinal, x FROM (VALUES {_LIT}) v(ordinal, x)), held AS (
            SELECT position, session_id, src.seq, contains(lower(trim(regexp_replace(body, '\s+', ' ', 'g'))), x) AS ok
            FROM src JOIN top USING (session_id) JOIN texts USING (ordinal) WHERE position <= 20)
            SELECT position, session_id, count(DISTINCT seq) AS evidence FROM held GROUP BY ALL HAVING bool_and(ok)""",
        "shadow_parity": f"""SELECT position, coalesce(x.session_id = y.session_id, false) AS equal FROM
            (WITH {ranked()} SELECT position, session_id FROM top WHERE position <= 20) x
            FULL JOIN (WITH {ranked(depth=40)} SELECT position, session_id FROM top WHERE position <= 20) y USING (position)""",
        "view_after_delta": f"""WITH {DOCS} SELECT 'row:' || strlen(session_id) || ':' || session_id || ':' || seq AS row_key, event_type,
            sha256(CASE WHEN event_type = 'user/message' THEN 'again: ' ELSE '' END || body) AS body_sha256 FROM c WHERE event_type <> 'assistant/message'""",
        "document_digests": f"""WITH {DOCS} SELECT 'row:' || strlen(session_id) || ':' || session_id || ':' || seq AS row_key, scope,
            sha256('loomspark/document/v1' || chr(0) || session_id || chr(0) || seq || chr(0) || body) AS fingerprint FROM c""",
        "latency_percentiles": """SELECT quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99,
            min(value) AS least, max(value) AS most, round(avg(value), 6) AS mean FROM events""",
        "checkpoint_skip": f"WITH {_CURSORS} SELECT session_id, next_seq FROM now WHERE substr(session_id, 6)::BIGINT % 3 = 0",
    }
    found |= _evidence() | _records()
    return found | {name: sources(_where(f)) for name, f in q.FILTERS.items()}
