"""DuckDB SQL for the queries of this package that SQL can express."""

QUALITY_RULES = r"""
WITH w AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), win AS (
  SELECT rid, i, array_to_string(ws[i:i + 7], ' ') AS k
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)
), dup AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS c FROM win) WHERE c >= 2
), cov AS (
  SELECT rid, count(DISTINCT i + o) AS n FROM dup, range(0, 8) AS r(o) GROUP BY rid
), m AS (
  SELECT doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
         len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words
  FROM (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM w) AS w
  LEFT JOIN cov USING (rid)
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
       CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
       (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 100 * n_symbols > 20 * word_chars
            OR word_chars > 25 * n_words OR word_chars < 2 * n_words OR 10 * n_dup_lines > n_words) AS kept
FROM m
"""

#: Kind, its place in the order, pattern, counted group, least length.
_SECRETS = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", 0, 1),
    ("hosted_token", r"(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,})", 0, 1),
)


def _secret_kind(rank: int, kind: str, pattern: str, group: int, least: int) -> str:
    return f"""
  SELECT rid, '{kind}' AS kind, {rank} AS rank, s + list_sum(list_transform(gaps[1:i], lambda x: length(x))) AS a, length(m[i]) AS n
  FROM (SELECT rid, m, g, gaps, unnest(range(1, len(m) + 1)) AS i,
               coalesce(list_sum(list_transform(m[1:unnest(range(1, len(m) + 1)) - 1], lambda x: length(x))), 0) AS s
        FROM (SELECT rid, regexp_extract_all(t, '{pattern}') AS m, regexp_extract_all(t, '{pattern}', {group}) AS g,
                     regexp_split_to_array(t, '{pattern}') AS gaps FROM d))
  WHERE length(g[i]) >= {least}"""


SECRET_SCANS = (
    "WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents), f AS ("
    + "\n  UNION ALL".join(_secret_kind(r, *k) for r, k in enumerate(_SECRETS))
    + """
), s AS (
  SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
         count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(kind || ':' || CAST(a AS BIGINT) || ':' || CAST(a + n AS BIGINT), ',' ORDER BY a, rank) FILTER (rank < 3) AS base,
         string_agg(kind || ':' || CAST(a AS BIGINT) || ':' || CAST(a + n AS BIGINT), ',' ORDER BY a, rank) AS spans
  FROM f GROUP BY rid
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN s USING (rid)
"""
)

URL_FILTERS = r"""
WITH p AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), r AS (
  SELECT * FROM (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
                        ('net', '/es/', 'block'), ('net', '/fr/', 'block')) AS t(rh, rp, v)
), j AS (
  SELECT page_id, host, path,
         (SELECT rh || rp FROM r WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) ORDER BY length(rh || rp) DESC LIMIT 1) AS rule
  FROM p
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IS NOT NULL THEN (SELECT v FROM r WHERE rh || rp = rule)
            WHEN regexp_matches(host || path, '^([^/]*\.)?spam-farm\.') OR regexp_matches(host || path, '^([^/]*\.)?adult-[a-z0-9]+\.')
                 OR regexp_matches(host || path, '^([^/]*[.-])?casino[.-]') THEN 'block'
            ELSE 'allow' END AS verdict
FROM j
"""

WARC = """
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), o AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS original FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> original THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> original THEN original END AS refers_to
FROM o
"""

VECTOR_DEDUP = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS rid, vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), ok AS (
  SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0
    AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.rid AS x, b.rid AS y FROM ok AS a JOIN ok AS b ON a.label = b.label AND len(a.e) = len(b.e) AND a.rid <> b.rid
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), reach AS (
  SELECT rid AS x, rid AS y FROM v UNION SELECT reach.x, links.y FROM reach JOIN links ON links.x = reach.y
), c AS (
  SELECT reach.x AS rid, min(v.vec_id) AS component_id FROM reach JOIN v ON v.rid = reach.y GROUP BY reach.x
)
SELECT v.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN c USING (rid) LEFT JOIN (SELECT x, count(*) AS n FROM links GROUP BY x) AS n ON n.x = v.rid
"""
