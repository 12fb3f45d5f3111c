"""DuckDB SQL for the queries that SQL can express."""

from loomspark.llm import quality, urlfilter

_RULES = "\n    UNION ALL ".join(
    f"SELECT {i} AS i, '{r.name}' AS name, '{r.action}' AS action, '{r.name.split('/')[0]}' AS h, "
    f"'/{r.name.partition('/')[2]}' AS p"
    for i, r in enumerate(urlfilter.BASE_RULES)
)
_HOST_WORDS = "|".join(urlfilter.HOST_WORDS)

URL_FILTERS = rf"""
WITH u AS (
    SELECT page_id, url, row_number() OVER () AS k,
        CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), hp AS (
    SELECT page_id, k, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), rules AS (
    {_RULES}
), fits AS (
    SELECT k, name, action, row_number() OVER (PARTITION BY k ORDER BY length(name) DESC, i) AS place
    FROM hp JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
)
SELECT page_id, host, path, name AS rule,
    coalesce(action, CASE WHEN regexp_matches(host, '(^|[^0-9a-z])({_HOST_WORDS})([^0-9a-z]|$)') THEN 'block' ELSE 'allow' END) AS verdict
FROM hp LEFT JOIN fits ON hp.k = fits.k AND place = 1
"""

MIX = r"""
WITH d AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
        ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT AS h FROM documents
), s AS (
    SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place
    FROM d GROUP BY source
), sw AS (
    SELECT *, CASE place % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w,
        source_size::DOUBLE * 2 AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS total FROM s
), steps AS (
    SELECT *, total - coalesce(sum(cap) OVER (ORDER BY cap / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
        sum(w) OVER (ORDER BY cap / w, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight FROM sw
), level AS (
    SELECT rest, weight FROM steps WHERE cap / w > rest / weight ORDER BY cap / w, place LIMIT 1
), t AS (
    SELECT source, source_size, least(cap, coalesce(level.rest * w / level.weight, cap)) AS target
    FROM sw LEFT JOIN level ON true
), e AS (
    SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t
), b AS (
    SELECT *, floor(target)::BIGINT - epochs * source_size AS budget FROM e
), c AS (
    SELECT d.doc_id, d.source, d.size, d.h, b.source_size, b.target, b.epochs, b.budget,
        sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h RANGE UNBOUNDED PRECEDING) AS upto
    FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source
), g AS (
    SELECT *, budget - coalesce(max(upto) FILTER (upto <= budget) OVER (PARTITION BY source), 0) AS rest FROM c
), x AS (
    SELECT source, arg_min({'h': h, 'size': size}, {'gap': abs(rest - size), 'h': h, 'size': size}) AS extra
    FROM g WHERE upto > budget AND size > 0 AND size < 2 * rest GROUP BY source
)
SELECT doc_id, size, source_size, target,
    (size * (epochs + CASE WHEN upto <= budget OR coalesce(extra.h = h AND extra.size = size, false) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM g LEFT JOIN x ON g.source IS NOT DISTINCT FROM x.source
"""

_R = quality.LineRules()
_SPACE = r"[ \t\n\x0B\x0C\r]"
QUALITY = rf"""
WITH d AS (
    SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text,
        regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), lines AS (
    SELECT k, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n, strlen(regexp_replace(line, '{_SPACE}', '', 'g')) AS solid
    FROM (SELECT k, unnest(string_split(text, chr(10))) AS line FROM d)
), judged AS (
    SELECT *, 100 * (strlen(line) - strlen(regexp_replace(line, '[#*$%&|<>!]', '', 'g'))) > {_R.symbol_percent} * solid
        OR strlen(line) - strlen(regexp_replace(line, '[|>]', '', 'g')) >= {_R.separators}
        OR (solid > {_R.capital_bytes} AND 100 * (strlen(line) - strlen(regexp_replace(line, '[A-Z]', '', 'g'))) > {_R.capital_percent} * solid)
        OR (n <= {_R.boilerplate_words} AND regexp_matches(line, '(?i)({"|".join(quality.BOILERPLATE)})')) AS fails
    FROM lines WHERE n > 0
), per_line AS (
    SELECT k, count(*) - count(DISTINCT line) AS n_dup_lines, count(*) FILTER (fails) AS n_lines_removed,
        coalesce(sum(solid) FILTER (fails), 0) AS lost, sum(solid) AS solid FROM judged GROUP BY k
), tri AS (
    SELECT k, i, {{'a': words[i], 'b': words[i + 1], 'c': words[i + 2]}} AS g FROM (SELECT k, words, unnest(range(1, len(words) - 1)) AS i FROM d)
), often AS (
    SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS c FROM tri) WHERE c > 1
), repeats AS (
    SELECT k, count(DISTINCT i + o) AS n FROM often, (SELECT unnest([0, 1, 2]) AS o) GROUP BY k
), v AS (
    SELECT doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(text, '{_SPACE}', '', 'g'))::BIGINT AS word_chars,
        (strlen(text) - strlen(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(repeats.n, 0)::BIGINT AS n_repeat_words,
        coalesce(n_lines_removed, 0)::BIGINT AS n_lines_removed, coalesce(lost, 0) AS lost, coalesce(solid, 0) AS solid
    FROM d LEFT JOIN per_line USING (k) LEFT JOIN repeats USING (k)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * lost <= {_R.lost_percent} * solid AS kept, n_lines_removed
FROM v
"""

ORACLES = {"op3_url_filters": URL_FILTERS, "op8_mix_sources": MIX, "op10_quality_rules": QUALITY}
