"""DuckDB SQL of the operators that SQL can express."""

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Of equal payloads of 1000 bytes and more the largest page_id is the response; every capture has a request and a metadata record.
OP4 = """WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages),
  f AS (SELECT h, n, max(page_id) AS first FROM p WHERE n >= 1000 GROUP BY ALL)
SELECT p.page_id, CAST(p.n AS BIGINT) AS payload_bytes, p.h AS payload_digest,
  CASE WHEN f.n IS NOT NULL AND p.page_id IS DISTINCT FROM f.first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN p.page_id IS DISTINCT FROM f.first THEN f.first END AS refers_to, 1 AS n_requests, 1 AS n_metadata
FROM p LEFT JOIN f ON f.h = p.h AND f.n = p.n"""

#: All pairs by shared shingles, then what links reach.
OP6 = rf"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
  e AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] END) AS s FROM d),
  s AS (SELECT DISTINCT doc_id, s FROM e),
  n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
  p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
  l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * o >= 80 * (a.n + b.n - o)),
  t AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
  r AS (SELECT x, y FROM t UNION SELECT r.x, t.y FROM r JOIN t ON t.x = r.y)
SELECT d.doc_id, coalesce(max(n.n), 0) AS n_shingles, least(d.doc_id, min(r.y)) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN r ON r.x = d.doc_id GROUP BY d.doc_id"""

#: Every pair of a label.
OP7 = """WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL),
  l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
    WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
  r AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y),
  n AS (SELECT x, count(*) AS n FROM l GROUP BY x), c AS (SELECT x, min(y) AS m FROM r GROUP BY x)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, least(e.vec_id, c.m) AS component_id, least(e.vec_id, c.m) = e.vec_id AS kept
FROM embeddings e LEFT JOIN n ON n.x = e.vec_id LEFT JOIN c ON c.x = e.vec_id"""

#: Digests of the turns; the formatted length counts the marks and a backslash before each control string.
OP9 = r"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
  s AS (SELECT *, length(regexp_replace(text, '<s>|</s>|\[/?INST|\[OUT |\\', '\\\0', 'g')) + length(regexp_replace(role, '[\\\]]', '\\\0', 'g'))
    + CASE role WHEN 'assistant' THEN 6 + 4 ELSE 7 + 7 END AS n FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(3 + sum(n) AS BIGINT) AS formatted_chars
FROM s GROUP BY conv_id"""

#: CRC-32 from its rule, byte by byte; near words share what is left without one letter, or one is left of the other.
OP11 = r"""WITH RECURSIVE steps AS (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM (SELECT unnest(range(256)) AS i)),
  tab AS (SELECT list(c ORDER BY i) AS t FROM steps),
  u AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS w FROM documents),
  c AS (SELECT doc_id, w, count(*) AS n FROM u GROUP BY ALL),
  b AS (SELECT w, n, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w, ''),
    lambda x: CASE WHEN ord(x) < 128 THEN [ord(x)] ELSE [192 + (ord(x) >> 6), 128 + (ord(x) & 63)] END)) AS bytes FROM c),
  h AS (SELECT w, n, xor(list_reduce(list_prepend(4294967295, list_transform(bytes, lambda x: CAST(x AS BIGINT))), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) AS h FROM b, tab),
  s AS (SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, CAST(h % length(w) AS BIGINT)) || substr(w, CAST(h % length(w) AS BIGINT) + 2) ELSE w END AS word, n FROM h),
  v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM s WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
  d AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS k FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
  near AS (SELECT x.word, y.word AS other, y.n AS m FROM d x JOIN d y ON x.k = y.k AND x.i = y.i AND x.word <> y.word
    UNION SELECT x.word, y.word, y.n FROM d x JOIN v y ON x.k = y.word
    UNION SELECT y.word, x.word, x.n FROM d x JOIN v y ON x.k = y.word),
  best AS (SELECT word, other, m, count(*) OVER (PARTITION BY word) AS n_near FROM near QUALIFY row_number() OVER (PARTITION BY word ORDER BY m DESC, other) = 1),
  f AS (SELECT v.word, v.n, coalesce(best.n_near, 0) AS n_near, CASE WHEN m >= 5 * v.n THEN other END AS form, CASE WHEN m >= 5 * v.n THEN m END AS form_n FROM v LEFT JOIN best ON best.word = v.word),
  r AS (SELECT word, word AS root FROM f WHERE form IS NULL UNION ALL SELECT f.word, r.root FROM f JOIN r ON f.form = r.word)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM f JOIN r ON r.word = f.word"""

#: Every mask meets every order.
OP13 = r"""WITH l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS bad FROM labels GROUP BY doc_id),
  t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
  least AS (SELECT text, min(doc_id) AS first FROM t GROUP BY text),
  w AS (SELECT t.*, regexp_extract_all(t.text, '[^\x20\x09-\x0D]+') AS w, first FROM t JOIN least ON least.text = t.text),
  m AS (SELECT w.part, coalesce(l.good, false) AS good, coalesce(l.bad, false) AS bad,
      [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w), 100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 5 * length(text),
       regexp_matches(text, '[#$%&*|]'), coalesce(w.doc_id > first, false)] AS f
    FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
  c AS (SELECT part, f, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE bad) AS bad FROM m GROUP BY part, f),
  i AS (SELECT unnest(range(1, 6)) AS i),
  o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM i a, i b, i c, i d, i e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
  x AS (SELECT part, o, s.i AS step, n, good, bad, f[o[s.i]] AS fails, len(list_filter(list_slice(o, 1, s.i - 1), lambda k: f[k])) AS before,
      len(list_filter(f, lambda k: k)) AS n_fails FROM c, o, i s),
  y AS (SELECT part, o, step, sum(CASE WHEN fails OR before > 0 THEN 0 ELSE n END) AS kept, sum(CASE WHEN fails AND before = 0 THEN n ELSE 0 END) AS removed,
      sum(CASE WHEN fails AND before > 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails AND n_fails = 1 THEN n ELSE 0 END) AS unique_fails,
      sum(CASE WHEN fails AND before = 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN fails AND before = 0 THEN bad ELSE 0 END) AS toxic_lost
    FROM x GROUP BY part, o, step)
SELECT part, array_to_string(list_transform(o, lambda k: chr(CAST(64 + k AS INTEGER))), '') AS filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, o[step]) AS BIGINT) AS shapley FROM y"""
