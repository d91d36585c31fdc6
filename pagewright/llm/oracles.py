"""SQL of the queries whose contract SQL can express; it finds links and windows by joins on the words themselves.

op2, op3, op5, op6, op8, op9 and op10 return scores, spans, ids or draws that SQL can't express; they are tested by brute force.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase


def _words(c: str, word: str) -> str:
    return f"regexp_extract_all(translate(coalesce({c}, ''), '{ascii_uppercase}', '{ascii_lowercase}'), '{word}')"


#: RFC 4648: 32 signs for 5 bits each.
_BASE32 = ascii_uppercase + "234567"

OP1 = f"""WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS original FROM pages)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
 array_to_string(list_transform(range(0, 32), lambda k: substr('{_BASE32}', ((('0x' || substr(hex, 1 + 5 * (k // 4), 5))::BIGINT >> (15 - 5 * (k % 4))::BIGINT) & 31) + 1, 1)), '') AS payload_digest,
 CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> original THEN original END AS refers_to FROM p"""

OP4 = rf"""WITH RECURSIVE w AS (SELECT doc_id, {_words('text', r'[^\x20\x09-\x0D]+')} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(ws) - 4, 1) + 1), lambda i: array_to_string(ws[i:i + 4], ' '))) AS shingle FROM w WHERE len(ws) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * shared.n >= 75 * (x.n + y.n - shared.n)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, ways.b FROM reached r JOIN ways ON ways.a = r.other)
SELECT r.doc_id, coalesce(any_value(sizes.n), 0)::BIGINT AS n_shingles, min(other) AS component_id, r.doc_id = min(other) AS kept FROM reached r LEFT JOIN sizes ON sizes.doc_id = r.doc_id GROUP BY r.doc_id"""

_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

OP7 = f"""WITH items AS (SELECT item_id, {_words('text', _ALNUM)} AS ws FROM benchmark),
windows AS (SELECT DISTINCT item_id, least(13, len(ws)) AS k, unnest(list_transform(range(1, greatest(len(ws) - 12, 1) + 1), lambda i: array_to_string(ws[i:i + 12], ' '))) AS w FROM items WHERE len(ws) > 0),
docs AS (SELECT doc_id, {_words('text', _ALNUM)} AS ws FROM documents),
places AS (SELECT doc_id, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda p: {{'p': p, 'w': array_to_string(ws[p:p + k - 1], ' ')}})) AS x FROM docs JOIN (SELECT DISTINCT k FROM windows) ON len(ws) >= k),
found AS (SELECT doc_id, item_id, places.k AS k, x.p AS p FROM places JOIN windows ON windows.k = places.k AND windows.w = places.x.w),
hits AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS place FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS names FROM found GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(ws), false) AS contaminated
FROM docs LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    return {"op1_warc_revisits": OP1, "op4_near_duplicates": OP4, "op7_decontamination": OP7}
