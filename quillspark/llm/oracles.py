"""DuckDB's SQL for the queries that SQL can express."""

from __future__ import annotations

import string

_UP, _LOW = string.ascii_uppercase, string.ascii_lowercase
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), '{up}', '{low}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')".format(up=_UP, low=_LOW)

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
windows AS (
  SELECT item_id, least(len(w), 8) AS size, unnest(range(1, len(w) - least(len(w), 8) + 2)) AS pos, w FROM b WHERE len(w) > 0
),
patterns AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item_id, size, array_to_string(list_slice(w, pos, pos + size - 1), ' ') AS words FROM windows),
sizes AS (SELECT DISTINCT size FROM patterns),
places AS (SELECT doc_id, size, unnest(range(1, len(w) - size + 2)) AS pos, w FROM d, sizes WHERE len(w) >= size),
keyed AS (SELECT doc_id, size, pos, array_to_string(list_slice(w, pos, pos + size - 1), ' ') AS words FROM places),
found AS (SELECT doc_id, k.size, pos, item_id FROM keyed k JOIN patterns p ON k.size = p.size AND k.words = p.words),
hits AS (SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + size)) AS word FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""

LINE_DEDUP = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
),
keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '), '{_UP}', '{_LOW}') AS key FROM lines
),
owners AS (SELECT key, min(doc_id) AS owner FROM keyed WHERE length(key) >= 10 GROUP BY key),
judged AS (SELECT doc_id, pos, line, coalesce(doc_id <> owner, false) AS gone FROM keyed LEFT JOIN owners USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

_CONTROL = r"([<\[])(\\*)(/?)(s>|INST\]|ROLE[=\]])"
CHAT_FORMAT = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
),
sized AS (
  SELECT *, length(regexp_replace(text, '{_CONTROL}', '\\1\\\\\\2\\3\\4', 'g'))
    + CASE role WHEN 'user' THEN 18 WHEN 'assistant' THEN 6 ELSE 19 + length(url_encode(role)) END AS size
  FROM rows
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(size) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""

REVISITS = r"""
WITH bare AS (
  SELECT *, md5(html) AS digest, strlen(html) AS size,
    regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?@]*@)?', '') AS u
  FROM pages
),
parts AS (
  SELECT *, regexp_replace(lower(regexp_extract(u, '^([^/?]*)', 1)), ':(80|443)?$', '') AS host,
    regexp_replace(regexp_extract(u, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
    array_to_string(list_sort(list_filter(string_split(regexp_extract(u, '\?(.*)$', 1), '&'), lambda f: f <> '' AND NOT starts_with(f, 'utm_'))), '&') AS query
  FROM bare
),
keyed AS (
  SELECT page_id, digest, size, host || path || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS url_key, substr(digest, 1, 1) AS digit,
    '"' || digest || '"' AS tag, CAST(page_id AS VARCHAR) AS date
  FROM parts
),
revisits AS (
  SELECT page_id * 2 + 1 AS record_id, url_key, CASE WHEN digit = 'f' THEN page_id * 2 - 1 ELSE page_id * 2 + 101 END AS ts,
    CASE WHEN digit BETWEEN '0' AND '5' OR digit = 'f' THEN tag WHEN digit BETWEEN '6' AND '8' THEN 'W/' || tag WHEN digit BETWEEN 'c' AND 'd' THEN '"changed"' END AS etag,
    CASE WHEN digit BETWEEN '9' AND 'b' THEN date END AS last_modified
  FROM keyed
),
responses AS (SELECT page_id * 2 AS response_id, url_key, page_id * 2 AS ts, digest, size, tag, date FROM keyed),
matched AS (
  SELECT v.*, r.response_id, r.digest, r.size, r.tag, r.date
  FROM revisits v ASOF LEFT JOIN responses r ON v.url_key = r.url_key AND v.ts > r.ts
),
judged AS (
  SELECT *, CASE WHEN response_id IS NULL THEN 'no-earlier-response'
    WHEN etag IS NOT NULL THEN CASE WHEN regexp_replace(etag, '^W/', '') = tag THEN 'resolved' ELSE 'etag-mismatch' END
    WHEN last_modified IS NOT NULL THEN CASE WHEN last_modified = date THEN 'resolved' ELSE 'date-mismatch' END
    ELSE 'no-validator' END AS status
  FROM matched
)
SELECT record_id, url_key, ts, status, CASE WHEN status = 'resolved' THEN response_id END AS response_id, CASE WHEN status = 'resolved' THEN digest END AS digest,
  CASE WHEN status = 'resolved' THEN array_to_string(['cache-control: max-age=60', 'content-length: ' || size, 'content-type: text/html', 'date: ' || ts, 'etag: ' || tag], chr(10)) END AS headers
FROM judged
"""



def _lloyd(rounds: int = 10, k: int = 8) -> str:
    """Plain Lloyd in one long list of materialised steps; sums are of 128 bits and divided downwards."""
    nearest = """(SELECT i, g, d FROM (SELECT x.i, c.g, sum((x.v - c.v) * (x.v - c.v)) AS d FROM x JOIN {c} c USING (k) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY i ORDER BY d, g) = 1)"""
    steps = [
        """e AS MATERIALIZED (SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda c: CAST(floor(1024 * CAST(c AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0)""",
        "x AS MATERIALIZED (SELECT i, unnest(range(1, 65)) AS k, unnest(v) AS v FROM e)",
        f"c0 AS MATERIALIZED (SELECT g, unnest(range(1, 65)) AS k, unnest(v) AS v FROM (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS g, v FROM e QUALIFY g < {k}))",
    ]
    for r in range(rounds):
        steps.append(f"a{r} AS MATERIALIZED {nearest.format(c=f'c{r}')}")
        steps.append(f"m{r} AS MATERIALIZED (SELECT g, k, sum(x.v) AS s, count(*) AS n FROM a{r} JOIN x USING (i) GROUP BY ALL)")
        steps.append(f"c{r + 1} AS MATERIALIZED (SELECT g, k, CAST(CASE WHEN n IS NULL THEN v ELSE (s - ((s % n) + n) % n) // n END AS BIGINT) AS v FROM c{r} LEFT JOIN m{r} USING (g, k))")
    steps.append(f"last AS MATERIALIZED {nearest.format(c=f'c{rounds}')}")
    steps.append(f"named AS (SELECT g, sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY k)) AS centroid_sha256 FROM c{rounds} GROUP BY g)")
    return "WITH " + ",\n".join(steps) + """
SELECT vec_id, CAST(g AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY g) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM last JOIN e USING (i) JOIN named USING (g)"""


TOP_SCORES = """
WITH e AS MATERIALIZED (SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda c: floor(1024 * CAST(c AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0),
scored AS (SELECT q.i, q.vec_id AS query_id, e.vec_id, CAST(list_inner_product(q.v, e.v) AS BIGINT) AS score FROM e q JOIN e ON q.i <> e.i WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM scored WINDOW w AS (PARTITION BY i ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 10
"""

ORACLES = {
    "op11_lloyd": _lloyd(),
    "op13_top_scores": TOP_SCORES,
    "op2_decontamination": DECONTAMINATION,
    "op3_revisits": REVISITS,
    "op7_line_dedup": LINE_DEDUP,
    "op9_chat_format": CHAT_FORMAT,
}
