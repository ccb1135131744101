"""DuckDB SQL for the queries of this subpackage that SQL can express."""

_NORMAL = "regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')"

OP6 = f"""
WITH d AS (SELECT doc_id, sha256({_NORMAL}) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""

OP4 = """
WITH p AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
r(kind, h, p) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
f AS (
  SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(kind, length(h || p)) AS kind
  FROM (SELECT p.page_id, r.h, r.p, r.kind FROM p JOIN r ON (p.host = r.h OR ends_with(p.host, '.' || r.h)) AND starts_with(p.path, r.p))
  GROUP BY 1)
SELECT p.page_id, host, path, rule, coalesce(kind, 'allow') AS verdict FROM p LEFT JOIN f USING (page_id)
"""

OP3 = """
WITH d AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM d GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM d JOIN f USING (payload_digest)
"""

_OP9_STATS = """
w AS (
  SELECT doc_id, source, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws, coalesce(text, '') AS t FROM documents),
g AS (
  SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, unnest(list_transform(range(1, len(ws) - 1), lambda i: [ws[i], ws[i + 1], ws[i + 2]])) AS x FROM w WHERE len(ws) >= 3),
r AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (
    SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS c FROM g) WHERE c > 1)
  GROUP BY 1),
l AS (
  SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM w),
s AS (
  SELECT w.doc_id, w.source, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM w JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s)"""

_OP9_HOSTS = """
h AS (SELECT source, count(*) AS n, sum(base_failed::INT) AS f FROM b GROUP BY 1),
m AS (SELECT (sum(f) + 0.5) / (sum(n) + 1.0) AS mean, coalesce(var_samp(f / n), 0) AS v, avg(1 / n) AS k FROM h),
q AS (SELECT mean, least(greatest(mean * (1 - mean) / greatest(v - mean * (1 - mean) * k, 1e-6) - 1, 1.0), 1000.0) AS strength FROM m),
z AS (SELECT source, (f + mean * strength) / (n + strength) > 0.6 AS bad FROM h, q)"""

OP9 = f"""
WITH {_OP9_STATS}, {_OP9_HOSTS}
SELECT b.doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND NOT bad AS kept
FROM b JOIN z ON b.source IS NOT DISTINCT FROM z.source
"""

ORACLES = {"op3_warc": OP3, "op4_url_filter": OP4, "op6_exact_dedup": OP6, "op9_quality": OP9}
