"""DuckDB SQL of the manifest, the secret scan and the conversations' repair, each in a way of its own: trees by recursion over
levels, spans from the pieces between matches, edits by dynamic programming over prefixes."""

OP11_SQL = r"""
WITH RECURSIVE told AS (
  SELECT doc_id, lang, text, concat('', doc_id, '') AS id, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
    || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head FROM documents
), crcs AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(id, ''), lambda c: ascii(c)::BIGINT)), lambda crc, byte:
    list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, _: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295) AS crc FROM told
), leaves AS (
  SELECT doc_id, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    sha256(head || coalesce(strlen(text) || ':' || CASE WHEN doc_id IS NOT NULL AND crc % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END, '-')) AS tampered FROM crcs
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY lang) AS n FROM leaves
), tree AS (
  SELECT 0 AS level, lang, place, leaf AS h, n FROM placed
  UNION ALL SELECT level + 1, lang, place // 8, sha256(string_agg(h, '' ORDER BY place)), (any_value(n) + 7) // 8 FROM tree WHERE n > 1 GROUP BY level, lang, place // 8
), subroots AS (
  SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM tree WHERE n = 1
), top AS (
  SELECT 0 AS level, place, subroot AS h, n FROM subroots
  UNION ALL SELECT level + 1, place // 8, sha256(string_agg(h, '' ORDER BY place)), (any_value(n) + 7) // 8 FROM top WHERE n > 1 GROUP BY level, place // 8
), runs AS (
  SELECT level, lang, place // 8 AS run, list(h ORDER BY place) AS hs FROM tree WHERE n > 1 GROUP BY level, lang, place // 8
), top_runs AS (
  SELECT level, place // 8 AS run, list(h ORDER BY place) AS hs FROM top WHERE n > 1 GROUP BY level, place // 8
), steps AS (
  SELECT p.doc_id, p.lang, p.place, r.level, (p.place // (8 ** r.level)::BIGINT) % 8 AS k, hs FROM placed p JOIN runs r ON r.lang IS NOT DISTINCT FROM p.lang AND r.run = p.place // (8 ** (r.level + 1))::BIGINT
  UNION ALL SELECT p.doc_id, p.lang, p.place, 1000 + r.level, (s.place // (8 ** r.level)::BIGINT) % 8, hs
  FROM placed p JOIN subroots s ON s.lang IS NOT DISTINCT FROM p.lang JOIN top_runs r ON r.run = s.place // (8 ** (r.level + 1))::BIGINT
), proofs AS (
  SELECT lang, place, list({'a': array_to_string(hs[:k], ''), 'z': array_to_string(hs[k + 2:], '')} ORDER BY level) AS proof FROM steps GROUP BY lang, place
), folds AS (
  SELECT p.lang, p.place, 0 AS step, tampered AS h, coalesce(proof, []) AS proof FROM placed p LEFT JOIN proofs q ON q.lang IS NOT DISTINCT FROM p.lang AND q.place = p.place
  UNION ALL SELECT lang, place, step + 1, sha256(proof[step + 1].a || h || proof[step + 1].z), proof FROM folds WHERE step < len(proof)
)
SELECT p.doc_id, p.leaf, s.subroot, t.h AS root, sha256(array_to_string(list_transform(f.proof, lambda x: x.a || x.z), '')) AS proof_sha256, f.h AS folded_root, f.h = t.h AS verified
FROM placed p JOIN subroots s ON s.lang IS NOT DISTINCT FROM p.lang JOIN (SELECT h FROM top WHERE n = 1) t ON TRUE
JOIN folds f ON f.lang IS NOT DISTINCT FROM p.lang AND f.place = p.place AND f.step = len(f.proof)
"""

OP12_SQL = r"""
WITH rules AS (
  SELECT * FROM (VALUES
    (0, 'assign', '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 6, 2),
    (1, 'access', 'AKIA[A-Z0-9]+', 20, 0),
    (2, 'hex', '[0-9a-f]+', 24, 0),
    (3, 'private_key', '-----BEGIN [A-Z ]*PRIVATE KEY-----', 0, 0),
    (4, 'github', 'gh[pousr]_[A-Za-z0-9]+', 40, 0),
    (5, 'google', 'AIza[A-Za-z0-9_-]+', 39, 0),
    (6, 'slack', 'xox[abprs]-[A-Za-z0-9-]+', 15, 0),
    (7, 'login', '(https?|ftp|postgres|postgresql|mysql|mongodb|redis|amqp)://[^\x20\x09-\x0D:/@"''<>]+:[^\x20\x09-\x0D/@"''<>]+@', 0, 0)
  ) r(place, kind, pattern, least, part)
), docs AS (
  SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS t FROM documents
), cut AS (
  SELECT id, place, kind, pattern, least, part, regexp_extract_all(t, pattern) AS matches, string_split_regex(t, pattern) AS gaps FROM docs, rules
), each AS (
  SELECT id, place, kind, pattern, least, part, unnest(matches) AS m, unnest(gaps[:len(matches)]) AS gap, generate_subscripts(matches, 1) AS i FROM cut WHERE len(matches) > 0
), spans AS (
  SELECT *, length(m) AS size, sum(length(gap) + length(m)) OVER (PARTITION BY id, place ORDER BY i) - length(m) AS start FROM each
), kept AS (
  SELECT id, place, kind, start::BIGINT AS start, size FROM spans WHERE length(CASE WHEN part = 2 THEN regexp_extract(m, pattern, 2) ELSE m END) >= least
), told AS (
  SELECT id, count(*) FILTER (place = 0) AS n0, count(*) FILTER (place = 1) AS n1, count(*) FILTER (place = 2) AS n2,
    string_agg(kind || ':' || start || ':' || (start + size), ',' ORDER BY start, place) FILTER (place < 3) AS base,
    string_agg(kind || ':' || start || ':' || (start + size), ',' ORDER BY start, place) AS spans FROM kept GROUP BY id
)
SELECT doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN told USING (id)
"""

OP13_SQL = r"""
WITH RECURSIVE told AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS id FROM conversations
), crcs AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(id, ''), lambda c: ascii(c)::BIGINT)), lambda crc, byte:
    list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, _: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295) % 20 AS kind FROM told
), damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM crcs, range(2) c(copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)
), ordered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i, substr(role, 1, 1) AS initial, right(rtrim(text, E' \t\n\x0b\f\r'), 1) AS last FROM damaged
), faulted AS (
  SELECT *, CASE WHEN last = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN last NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair FROM ordered
), convs AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM faulted GROUP BY conv_id
), parse AS (
  SELECT conv_id, 0::BIGINT AS i, '000000000' AS p, NULL::VARCHAR AS s, '000000005I' AS u, '000000010II' AS a FROM convs
  UNION ALL
  SELECT conv_id, i, p1, s1, u2, list_min([a1, lpad((substr(u2, 1, 9)::BIGINT + 5)::VARCHAR, 9, '0') || substr(u2, 10) || 'I']) FROM (
    SELECT *, list_min([u1, lpad((substr(b1, 1, 9)::BIGINT + 5)::VARCHAR, 9, '0') || substr(b1, 10) || 'I']) AS u2 FROM (
      SELECT *, list_min([p1, s1, a1]) AS b1 FROM (
        SELECT q.conv_id, f.i, lpad((substr(p, 1, 9)::BIGINT + 2)::VARCHAR, 9, '0') || substr(p, 10) || 'D' AS p1,
          list_min([lpad((substr(s, 1, 9)::BIGINT + 2)::VARCHAR, 9, '0') || substr(s, 10) || 'D', CASE WHEN fit AND initial = 's' THEN lpad((substr(p, 1, 9)::BIGINT + cost)::VARCHAR, 9, '0') || substr(p, 10) || 'K' END]) AS s1,
          list_min([lpad((substr(u, 1, 9)::BIGINT + 2)::VARCHAR, 9, '0') || substr(u, 10) || 'D', CASE WHEN fit AND initial = 'u' THEN lpad((substr(b, 1, 9)::BIGINT + cost)::VARCHAR, 9, '0') || substr(b, 10) || 'K' END,
            CASE WHEN fit THEN lpad((substr(b, 1, 9)::BIGINT + cost + 1)::VARCHAR, 9, '0') || substr(b, 10) || 'R' END]) AS u1,
          list_min([lpad((substr(a, 1, 9)::BIGINT + 2)::VARCHAR, 9, '0') || substr(a, 10) || 'D', CASE WHEN fit AND initial = 'a' THEN lpad((substr(u, 1, 9)::BIGINT + cost)::VARCHAR, 9, '0') || substr(u, 10) || 'K' END,
            CASE WHEN fit THEN lpad((substr(u, 1, 9)::BIGINT + cost + 1)::VARCHAR, 9, '0') || substr(u, 10) || 'R' END]) AS a1
        FROM (SELECT *, list_min([p, s, a]) AS b FROM parse) q
        JOIN (SELECT *, fault IS NULL OR fault = 'truncated' AS fit, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS cost FROM faulted) f ON f.conv_id IS NOT DISTINCT FROM q.conv_id AND f.i = q.i + 1
      )
    )
  )
), best AS (
  SELECT c.*, list_min([p, a]) AS value FROM parse q JOIN convs c ON c.conv_id IS NOT DISTINCT FROM q.conv_id AND c.n = q.i
), edits AS (
  SELECT conv_id, unnest(string_split(substr(value, 10), '')) AS edit, generate_subscripts(string_split(substr(value, 10), ''), 1) AS k FROM best
), taken AS (
  SELECT *, count(*) FILTER (edit <> 'I') OVER (PARTITION BY conv_id ORDER BY k) AS i FROM edits
), kept AS (
  SELECT t.conv_id, t.k, t.edit, f.role, f.text, coalesce(t.edit = 'K' AND f.initial = 's', FALSE) AS system FROM taken t
  LEFT JOIN faulted f ON f.conv_id IS NOT DISTINCT FROM t.conv_id AND f.i = t.i AND t.edit <> 'I' WHERE t.edit <> 'D' AND t.edit <> ''
), repaired AS (
  SELECT conv_id, k, CASE WHEN edit = 'K' THEN role WHEN count(*) FILTER (NOT system) OVER (PARTITION BY conv_id ORDER BY k) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, '') AS line FROM kept
), lines AS (
  SELECT conv_id, sha256(string_agg(line, chr(10) ORDER BY k)) AS h FROM repaired GROUP BY conv_id
), ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(substr(value, 1, 9)::BIGINT, 0) AS cost, coalesce(substr(value, 10), '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
FROM ids LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN lines l ON l.conv_id IS NOT DISTINCT FROM ids.conv_id
"""

ORACLE_SQL = {"op11_merkle_manifest": OP11_SQL, "op12_secret_scan": OP12_SQL, "op13_chat_repair": OP13_SQL}
