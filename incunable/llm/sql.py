"""DuckDB SQL for the rows of the queries that SQL can express."""

from __future__ import annotations

import string

_LOWER = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"

OP2_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT item_id::VARCHAR AS item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
sized AS (SELECT item_id, w, least(len(w), 10) AS k FROM items WHERE len(w) > 0),
theirs AS (SELECT DISTINCT item_id, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS span FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM sized)),
ours AS (SELECT r, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') AS span FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM sized) WHERE len(w) >= k)),
met AS (SELECT r, i, k, item_id FROM ours JOIN theirs USING (k, span)),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS p FROM met) GROUP BY r),
which AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM met) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN which USING (r)
"""

OP5_SQL = r"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
spans AS (SELECT r, i, md5(array_to_string(list_slice(w, i, i + 19), ' ')) AS span FROM (SELECT r, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
again AS (SELECT r, i FROM (SELECT r, i, row_number() OVER (PARTITION BY span ORDER BY r, i) AS n FROM spans) WHERE n > 1),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 20)) AS p FROM again),
words AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY p) AS kept FROM words ANTI JOIN gone USING (r, p) GROUP BY r),
lost AS (SELECT r, count(*) AS n FROM gone GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r) LEFT JOIN lost USING (r)
"""

OP3_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
starts AS (SELECT r, i, count(*) OVER (PARTITION BY span) AS n FROM (SELECT r, i, md5(array_slice(b, i, i + 399)) AS span FROM (SELECT r, b, unnest(range(1, octet_length(b) - 398)) AS i FROM d WHERE octet_length(b) >= 400))),
marked AS (SELECT r, i, i > coalesce(lag(i) OVER (PARTITION BY r ORDER BY i) + 400, 0) AS opens FROM starts WHERE n > 1),
runs AS (SELECT r, min(i) AS a, max(i) + 400 AS z FROM (SELECT r, i, sum(opens::INTEGER) OVER (PARTITION BY r ORDER BY i) AS run FROM marked) GROUP BY r, run),
gaps AS (SELECT r, a AS ord, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 1) AS a, a AS z FROM runs
  UNION ALL SELECT r, 1000000000000, max(z), 1000000000000 FROM runs GROUP BY r),
kept AS (SELECT r, string_agg(hex(array_slice(b, a, least(z, octet_length(b) + 1) - 1)), '' ORDER BY ord) AS h FROM gaps JOIN d USING (r) WHERE a < least(z, octet_length(b) + 1) GROUP BY r),
lost AS (SELECT r, count(*) AS n_spans, sum(z - a)::BIGINT AS n_removed FROM runs GROUP BY r)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(CASE WHEN n_removed IS NULL THEN b ELSE unhex(coalesce(h, '')) END) AS kept_sha256
FROM d LEFT JOIN lost USING (r) LEFT JOIN kept USING (r)
"""
