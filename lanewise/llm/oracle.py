"""SQL equivalents of the queries of this package that SQL can express."""

from __future__ import annotations

EMBEDDING_GROUPS = """
WITH RECURSIVE usable AS MATERIALIZED (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98
), reached AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION
  SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a
), degrees AS (
  SELECT a, count(*) AS n FROM links GROUP BY a
), firsts AS (
  SELECT a, min(b) AS component_id FROM reached GROUP BY a
)
SELECT e.vec_id, coalesce(d.n, 0) AS n_links, f.component_id, e.vec_id = f.component_id AS kept
FROM embeddings e JOIN firsts f ON f.a = e.vec_id LEFT JOIN degrees d ON d.a = e.vec_id
"""

WARC = """
WITH sized AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
    sha1(coalesce(html, '')) AS payload_digest FROM pages
), firsts AS (
  SELECT payload_digest, payload_bytes, max(page_id) AS response FROM sized
  WHERE payload_bytes >= 1000 GROUP BY ALL
)
SELECT s.page_id, s.payload_bytes, s.payload_digest,
  CASE WHEN f.response IS NULL OR f.response = s.page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN f.response <> s.page_id THEN f.response END AS refers_to
FROM sized s LEFT JOIN firsts f USING (payload_digest, payload_bytes)
"""


COLLOCATIONS = r"""
WITH pieces AS MATERIALIZED (
  SELECT row_number() OVER () AS piece, lang, part FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n-\r]')) AS part
    FROM documents)
), words AS MATERIALIZED (
  SELECT lang, piece, unnest(list) AS w, generate_subscripts(list, 1) AS i
  FROM (SELECT lang, piece, regexp_extract_all(part, '[^ \t]+') AS list FROM pieces)
), grams AS MATERIALIZED (
  SELECT lang, w AS w1, lead(w) OVER p AS w2, lead(w, 2) OVER p AS w3 FROM words WINDOW p AS (PARTITION BY piece ORDER BY i)
), f1 AS MATERIALIZED (SELECT lang, w1, count(*) AS f FROM grams GROUP BY ALL
), f2 AS MATERIALIZED (SELECT lang, w1, w2, count(*) AS f FROM grams WHERE w2 IS NOT NULL GROUP BY ALL
), f3 AS MATERIALIZED (SELECT lang, w1, w2, w3, count(*) AS f FROM grams WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10
), longer AS (
  SELECT lang, w1, w2, max(f) AS f FROM (
    SELECT lang, w1, w2, f FROM f3 UNION ALL SELECT lang, w2, w3, f FROM f3) GROUP BY ALL
), cuts AS (
  SELECT p.lang, p.w1 || ' ' || p.w2 AS phrase, p.f AS a, a.f AS l, b.f AS r, 1 AS k
  FROM f2 p JOIN f1 a ON a.lang = p.lang AND a.w1 = p.w1 JOIN f1 b ON b.lang = p.lang AND b.w1 = p.w2
  LEFT JOIN longer g ON g.lang = p.lang AND g.w1 = p.w1 AND g.w2 = p.w2
  WHERE p.f >= 10 AND NOT coalesce(100 * g.f >= 50 * p.f, false)
  UNION ALL
  SELECT p.lang, p.w1 || ' ' || p.w2 || ' ' || p.w3, p.f, a.f, b.f, 1
  FROM f3 p JOIN f1 a ON a.lang = p.lang AND a.w1 = p.w1 JOIN f2 b ON b.lang = p.lang AND b.w1 = p.w2 AND b.w2 = p.w3
  UNION ALL
  SELECT p.lang, p.w1 || ' ' || p.w2 || ' ' || p.w3, p.f, a.f, b.f, 2
  FROM f3 p JOIN f2 a ON a.lang = p.lang AND a.w1 = p.w1 AND a.w2 = p.w2 JOIN f1 b ON b.lang = p.lang AND b.w1 = p.w3
), scored AS (
  SELECT *, ((1000000::HUGEINT * a * a) // (l::HUGEINT * r))::BIGINT AS score FROM cuts
), lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM lowest
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN (SELECT lang, count(*) AS n FROM words GROUP BY lang) USING (lang)
WHERE rank <= 2000
"""

PREFIX_TRIE = r"""
WITH RECURSIVE turns AS MATERIALIZED (
  SELECT conv_id AS conv, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
  FROM conversations WHERE conv_id IS NOT NULL
), plans AS MATERIALIZED (
  SELECT conv, conv - conv % 20 AS base, length, xor(list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(string_split(conv::VARCHAR, ''), lambda d: ascii(d)::BIGINT)),
      lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)),
        lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)
    ), 4294967295::BIGINT) % 4 AS h
  FROM (SELECT conv, count(*) AS length FROM turns GROUP BY conv)
), led AS MATERIALIZED (
  SELECT p.conv, t.place AS depth, t.role, t.text FROM plans p JOIN turns t ON t.conv = p.base AND t.place <= p.h
), rebuilt AS MATERIALIZED (
  SELECT conv, depth, role, text FROM led
  UNION ALL
  SELECT p.conv, t.place - p.h + coalesce(l.n, 0), t.role, t.text
  FROM plans p JOIN turns t ON t.conv = p.conv AND t.place > p.h
  LEFT JOIN (SELECT conv, count(*) AS n FROM led GROUP BY conv) l ON l.conv = p.conv
), prefixes AS MATERIALIZED (
  SELECT conv, depth, text, list({'role': role, 'text': text}) OVER (PARTITION BY conv ORDER BY depth) AS path FROM rebuilt
  UNION ALL
  SELECT conv, 0, '', [] FROM plans
), members AS MATERIALIZED (
  SELECT conv, depth, text, min(conv) OVER (PARTITION BY depth, path) AS node,
    depth = max(depth) OVER (PARTITION BY conv) AS ends FROM prefixes
), nodes AS MATERIALIZED (
  SELECT node, depth, count(*) AS n_convs,
    (count(*) - 1) * CASE WHEN depth = 0 THEN 0 ELSE len(regexp_extract_all(any_value(text), '[^\x20\x09-\x0D]+')) END AS saved,
    sha256(coalesce(string_agg(conv::VARCHAR, ',' ORDER BY conv) FILTER (WHERE ends), '')) AS ends_sha256
  FROM members GROUP BY node, depth
), family AS MATERIALIZED (
  SELECT n.*, m.node AS parent FROM nodes n LEFT JOIN members m ON m.conv = n.node AND m.depth = n.depth - 1
), children AS MATERIALIZED (
  SELECT parent AS node, depth - 1 AS depth, count(*) AS n_children FROM family WHERE depth > 0 GROUP BY ALL
), own AS MATERIALIZED (
  SELECT f.*, coalesce(c.n_children, 0) AS n_children FROM family f LEFT JOIN children c USING (node, depth)
), under AS (
  SELECT node AS top, depth AS top_depth, node, depth FROM own
  UNION ALL
  SELECT u.top, u.top_depth, f.node, f.depth FROM under u JOIN family f ON f.parent = u.node AND f.depth = u.depth + 1
), sums AS (
  SELECT u.top AS node, u.top_depth AS depth, count(*) FILTER (WHERE o.n_children = 0) AS n_leaves,
    sum(o.saved)::BIGINT AS saved_tokens
  FROM under u JOIN own o ON o.node = u.node AND o.depth = u.depth GROUP BY ALL
)
SELECT o.node AS conv_id, o.depth, o.parent AS parent_conv_id, o.n_convs, o.n_children, s.n_leaves, s.saved_tokens, o.ends_sha256
FROM own o JOIN sums s USING (node, depth)
"""

CHAT = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL
  SELECT -7, turn, role, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(turn, role)
), placed AS (
  SELECT *, row_number() OVER w AS place, lag(role) OVER w AS earlier,
    CASE role WHEN 'system' THEN 'System' WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'Assistant'
      ELSE 'role=' || replace(url_encode(role), '%20', '+') END AS title,
    replace(replace(replace(text, '\', '\\'), '</turn>', '<\/turn>'), '###', '\###') AS hidden
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), written AS (
  SELECT *, CASE WHEN place = 1 THEN '### ' || title || ': ' WHEN role <> earlier THEN chr(10) || '### ' || title || ': '
    ELSE '' END || hidden || '</turn>' AS piece FROM placed
), joined AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY place) AS spelled,
    coalesce(string_agg(text, '' ORDER BY place) FILTER (WHERE role = 'assistant'), '') AS learned,
    string_agg(piece, '' ORDER BY place) AS formatted
  FROM written GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(spelled) AS turns_sha256, length(learned) AS loss_chars, sha256(learned) AS loss_sha256,
  length(formatted) AS formatted_chars FROM joined
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op5_warc_index": WARC,
        "op7_embedding_dedup": EMBEDDING_GROUPS,
        "op11_collocations": COLLOCATIONS,
        "op12_prefix_trie": PREFIX_TRIE,
        "op13_chat_format": CHAT,
    }
