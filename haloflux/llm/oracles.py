"""DuckDB SQL of the operators that SQL can express, by plain joins over exploded shingles."""

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _shingled(name: str, key: str, source: str) -> str:
    """CTEs giving (key, s): the distinct five-word shingles of each text, a short text being one."""
    return f"""
    {name}_words AS (
      SELECT {key}, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\\x20\\x09-\\x0D]+') AS w
      FROM {source}),
    {name} AS (
      SELECT DISTINCT {key}, array_to_string(w[i:i + 4], ' ') AS s
      FROM (SELECT {key}, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM {name}_words WHERE len(w) > 0))"""


DECONTAMINATION = f"""
WITH {_shingled("d", "doc_id", "documents")},
     {_shingled("b", "item_id", "benchmark")},
     size AS (SELECT item_id, count(*) AS n FROM b GROUP BY item_id),
     shared AS (SELECT doc_id, item_id, count(*) AS n FROM d JOIN b USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, shared.n AS n_shared, size.n AS n_item_shingles, shared.n / size.n AS containment
FROM shared JOIN size USING (item_id)
WHERE shared.n / size.n >= 0.8
"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE {_shingled("d", "doc_id", "documents")},
     size AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id),
     pair AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM d x JOIN d y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
     link AS (SELECT a, b FROM pair JOIN size p ON p.doc_id = a JOIN size q ON q.doc_id = b
              WHERE 100 * pair.n >= 85 * (p.n + q.n - pair.n)),
     reach AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
     least AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT doc_id, coalesce(size.n, 0) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id,
       doc_id = least(doc_id, coalesce(m, doc_id)) AS kept
FROM documents LEFT JOIN size USING (doc_id) LEFT JOIN least ON least.a = doc_id
"""

#: Masks of failed filters by plain expressions, then all orders of the letters by joins.
FILTER_AUDIT = r"""
WITH t AS (
       SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
     w AS (
       SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY text) AS least FROM t),
     f AS (
       SELECT doc_id, part,
         (len(w) < 100)::INT
         + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::INT
         + 4 * (100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 10 * length(text))::INT
         + 8 * regexp_matches(text, '[#$%&*|]')::INT
         + 16 * coalesce(doc_id > least, false)::INT AS mask
       FROM w),
     l AS (
       SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
     m AS (
       SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic
       FROM f LEFT JOIN l USING (doc_id) GROUP BY part, mask),
     letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS bit),
     orders AS (
       SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
       FROM letters a JOIN letters b ON b.x <> a.x JOIN letters c ON c.x NOT IN (a.x, b.x)
       JOIN letters d ON d.x NOT IN (a.x, b.x, c.x) JOIN letters e ON e.x NOT IN (a.x, b.x, c.x, d.x)),
     steps AS (
       SELECT filter_order, k AS step, own.bit, coalesce(sum(earlier.bit), 0)::INT AS done
       FROM (SELECT filter_order, unnest(range(1, 6)) AS k FROM orders)
       JOIN letters own ON own.x = filter_order[k]
       LEFT JOIN letters earlier ON strpos(filter_order, earlier.x) < k
       GROUP BY ALL),
     r AS (
       SELECT part, filter_order, step, bit,
         coalesce(sum(n) FILTER (mask & (done | bit) = 0), 0) AS kept,
         coalesce(sum(n) FILTER (mask & done = 0 AND mask & bit <> 0), 0) AS removed,
         coalesce(sum(n) FILTER (mask & done <> 0 AND mask & bit <> 0), 0) AS redundant,
         coalesce(sum(n) FILTER (mask = bit), 0) AS unique_fails,
         coalesce(sum(good) FILTER (mask & done = 0 AND mask & bit <> 0), 0) AS good_lost,
         coalesce(sum(toxic) FILTER (mask & done = 0 AND mask & bit <> 0), 0) AS toxic_lost
       FROM m, steps GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM r
"""

#: Damage by a checksum computed bit by bit, faults by windows, and edits by a recursion over rows that keeps the best way to each last role.
CONVERSATION_REPAIR = r"""
WITH RECURSIVE keyed AS (
       SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key
       FROM conversations),
     summed AS (
       SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(key) + 1), lambda k: ascii(substr(key, k, 1))::BIGINT)),
           lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 1, 2, 3, 4, 5, 6, 7]),
             lambda x, n: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT) % 20 AS kind
       FROM keyed),
     damaged AS (
       SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
       FROM (SELECT *, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM summed)),
     ordered AS (
       SELECT *, substr(role, 1, 1) AS initial, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged),
     faulty AS (
       SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS before,
         CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
              WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
              WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault
       FROM ordered),
     wanted AS (SELECT unnest(['', 's', 'u', 'a']) AS q, unnest(['u', 'u', 'a', 'u']) AS r, unnest(['user', 'user', 'assistant', 'user']) AS name),
     inserts AS (
       SELECT q AS q0, q AS q1, 0 AS c, '' AS a, []::VARCHAR[] AS o FROM wanted
       UNION ALL SELECT q, r, 2, 'I', [name || ':'] FROM wanted
       UNION ALL SELECT x.q, y.r, 4, 'II', [x.name || ':', y.name || ':'] FROM wanted x JOIN wanted y ON y.q = x.r),
     edits AS (
       SELECT f.conv_id, f.i, w.q AS q1, e.q2, e.c, e.a, e.o
       FROM faulty f, wanted w, LATERAL (
         SELECT w.q AS q2, 3 AS c, 'D' AS a, []::VARCHAR[] AS o
         UNION ALL SELECT f.initial, (f.fault = 'truncated')::INT, 'K', [f.role || ':' || f.text]
           WHERE f.fault IN ('', 'truncated') AND (f.initial = w.r OR (w.q = '' AND f.initial = 's'))
         UNION ALL SELECT w.r, 2 + (f.fault = 'truncated')::INT, 'R', [w.name || ':' || f.text] WHERE f.fault IN ('', 'truncated')) e),
     ways AS (
       SELECT DISTINCT conv_id, 0::BIGINT AS i, '' AS q, {'c': 0, 'a': '', 'o': []::VARCHAR[]} AS best FROM conversations
       UNION ALL
       SELECT w.conv_id, e.i, e.q2, min({'c': w.best.c + s.c + e.c, 'a': w.best.a || s.a || e.a, 'o': list_concat(list_concat(w.best.o, s.o), e.o)})
       FROM ways w JOIN inserts s ON s.q0 = w.q JOIN edits e ON e.conv_id IS NOT DISTINCT FROM w.conv_id AND e.i = w.i + 1 AND e.q1 = s.q1
       GROUP BY w.conv_id, e.i, e.q2),
     last AS (
       SELECT c.conv_id, coalesce(max(f.i), 0) AS n, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (f.i > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal,
         coalesce(max(f.turn) - min(f.turn) + 1 - count(DISTINCT f.turn), 0) AS gaps
       FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM c.conv_id GROUP BY c.conv_id),
     done AS (
       SELECT w.conv_id, min({'c': w.best.c + s.c, 'a': w.best.a || s.a, 'o': list_concat(w.best.o, s.o)}) AS best
       FROM ways w JOIN last l ON l.conv_id IS NOT DISTINCT FROM w.conv_id AND l.n = w.i JOIN inserts s ON s.q0 = w.q
       WHERE s.q1 IN ('', 'a') GROUP BY w.conv_id)
SELECT l.conv_id, gaps::BIGINT AS gaps, blank, duplicate, truncated, illegal, best.c::BIGINT AS cost, best.a AS audit,
  sha256(array_to_string(best.o, chr(10))) AS repaired_sha256
FROM last l JOIN done d ON d.conv_id IS NOT DISTINCT FROM l.conv_id
"""
