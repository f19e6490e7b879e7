"""SQL that says what the corpus operators' queries return, for DuckDB."""

from __future__ import annotations

CONVERSATIONS = r"""
WITH RECURSIVE
bytes AS (SELECT list_transform(range(256), lambda b: list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS step),
given AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name
    FROM conversations),
harmed AS (
    SELECT g.*, xor(list_reduce([4294967295] || list_transform(range(1, length(name) + 1), lambda i: ascii(substr(name, i::BIGINT, 1))),
                                lambda c, b: xor(c >> 8, step[xor(c % 256, b) + 1])), 4294967295) % 20 AS harm
    FROM given g, bytes),
damaged AS (
    SELECT conv_id, turn, CASE WHEN harm = 4 THEN 'user' ELSE role END AS role,
           CASE WHEN harm = 1 THEN '' WHEN harm = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
           unnest(CASE WHEN harm = 3 THEN [0, 1] ELSE [0] END) AS copy
    FROM harmed WHERE harm > 0),
placed AS (
    SELECT *, left(role, 1) AS initial, row_number() OVER o AS place, count(*) OVER (PARTITION BY conv_id) AS n,
           row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
           regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS ending
    FROM damaged WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, left(text, 64), sha256(length(role) || ':' || role || ':' || text), copy)),
faulty AS (
    SELECT *, CASE WHEN ending = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN NOT regexp_matches(ending, '[.!?]') THEN 'truncated' ELSE '' END AS fault,
           lag(initial) OVER (PARTITION BY conv_id ORDER BY place) || initial AS pair
    FROM placed),
-- States: 1 nothing yet, 2 after s, 3 after u, 4 after a. A path is its cost in twelve digits and its letters.
arcs AS (
    SELECT conv_id, place, n, [{'q': 1, 'l': 'D', 'c': 2, 't': 1}, {'q': 2, 'l': 'D', 'c': 2, 't': 2}, {'q': 3, 'l': 'D', 'c': 2, 't': 3}, {'q': 4, 'l': 'D', 'c': 2, 't': 4}]
        || CASE WHEN fault IN ('blank', 'duplicate') THEN [] ELSE
             list_transform([{'q': 1, 'l': 'R', 'c': 1, 't': 3}, {'q': 2, 'l': 'R', 'c': 1, 't': 3}, {'q': 3, 'l': 'R', 'c': 1, 't': 4}, {'q': 4, 'l': 'R', 'c': 1, 't': 3}]
                || CASE initial WHEN 's' THEN [{'q': 1, 'l': 'K', 'c': 0, 't': 2}]
                                WHEN 'u' THEN [{'q': 1, 'l': 'K', 'c': 0, 't': 3}, {'q': 2, 'l': 'K', 'c': 0, 't': 3}, {'q': 4, 'l': 'K', 'c': 0, 't': 3}]
                                WHEN 'a' THEN [{'q': 3, 'l': 'K', 'c': 0, 't': 4}] ELSE [] END,
                lambda a: {'q': a.q, 'l': a.l, 'c': a.c + CASE fault WHEN 'truncated' THEN 5 ELSE 0 END, 't': a.t}) END AS arcs
    FROM faulty),
paths AS (
    SELECT conv_id, max(place) AS place, ['000000000000', '000000000010II', '000000000005I', '000000000000'] AS v FROM placed GROUP BY conv_id
    UNION ALL
    SELECT conv_id, place - 1, [least(b[1], i[1]), least(b[2], i[1]), i[2], i[3]] FROM (
        SELECT conv_id, place, b, [printf('%012d', left(w3, 12)::BIGINT + 5) || 'I' || substr(w3, 13), w3, w4] AS i FROM (
            SELECT conv_id, place, b, least(b[3], printf('%012d', left(b[4], 12)::BIGINT + 5) || 'I' || substr(b[4], 13)) AS w3,
                   least(b[4], printf('%012d', left(b[3], 12)::BIGINT + 5) || 'I' || substr(b[3], 13)) AS w4
            FROM (SELECT p.conv_id, p.place, list_transform([1, 2, 3, 4], lambda s: list_min(list_transform(list_filter(a.arcs, lambda x: x.q = s),
                      lambda x: printf('%012d', left(p.v[x.t], 12)::BIGINT + x.c) || x.l || substr(p.v[x.t], 13)))) AS b
                  FROM paths p JOIN arcs a ON a.conv_id IS NOT DISTINCT FROM p.conv_id AND a.place = p.place)))),
best AS (SELECT conv_id, left(v[1], 12)::BIGINT AS cost, substr(v[1], 13) AS audit FROM paths WHERE place = 0),
letters AS (
    SELECT conv_id, j, substr(audit, j, 1) AS letter, length(replace(left(audit, j), 'I', '')) AS place, length(replace(left(audit, j), 'D', '')) AS nth
    FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS j FROM best)),
lines AS (
    SELECT l.conv_id, j, letter, nth, role, text, max(CASE WHEN nth = 1 AND letter = 'K' AND initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY l.conv_id) AS led
    FROM letters l LEFT JOIN placed p ON p.conv_id IS NOT DISTINCT FROM l.conv_id AND p.place = l.place AND letter <> 'I' WHERE letter <> 'D'),
repaired AS (
    SELECT conv_id, string_agg(CASE letter WHEN 'K' THEN role ELSE CASE WHEN (nth - led) % 2 = 1 THEN 'user' ELSE 'assistant' END END || ':' || coalesce(text, ''), chr(10) ORDER BY j) AS all_lines
    FROM lines GROUP BY conv_id),
counted AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
           count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
           count(*) FILTER (place > 1 AND pair NOT IN ('su', 'ua', 'au')) AS illegal
    FROM faulty GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(all_lines, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN counted n ON n.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM c.conv_id
"""


def _nearest(turn: int) -> str:
    """Each part's nearest entry of the turn's codebook."""
    return rf"""
near{turn} AS MATERIALIZED (
    SELECT vec_id, part, arg_min(entry, d * 64 + entry) AS entry, min(d) AS d
    FROM (SELECT p.vec_id, p.part, b.entry, list_sum(list_transform(list_zip(p.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
          FROM parts p JOIN book{turn} b USING (part)) GROUP BY vec_id, part)"""


def _next_book(turn: int) -> str:
    """The codebook after the turn: means rounded down, unused entries as they were."""
    return rf"""
book{turn + 1} AS MATERIALIZED (
    SELECT part, entry, coalesce(m.v, b.v) AS v FROM book{turn} b LEFT JOIN (
        SELECT part, entry, list(mean ORDER BY place) AS v FROM (
            SELECT part, entry, place, floor(sum(v[place]) / count(*))::BIGINT AS mean
            FROM near{turn} JOIN parts USING (vec_id, part), range(1, 1 + (SELECT max(len(v)) FROM parts)) t(place) GROUP BY part, entry, place)
        GROUP BY part, entry) m USING (part, entry))"""


CODEBOOK = r"""
WITH kept AS (
    SELECT vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT vec_id, label, part::BIGINT AS part, list_slice(v, part * (len(v) // 16) + 1, (part + 1) * (len(v) // 16)) AS v FROM kept, range(16) t(part)),
book0 AS (
    SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, v FROM parts
    WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 64)),
""" + ",".join([_nearest(0), _next_book(0), _nearest(1), _next_book(1), _nearest(2)]) + r""",
coded AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM near2 GROUP BY vec_id),
digest AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book2)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded JOIN kept USING (vec_id), digest
"""  # fmt: skip
