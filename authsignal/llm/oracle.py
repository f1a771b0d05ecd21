"""SQL for the corpus queries that SQL can express, written independently of the operators."""

from __future__ import annotations

ARCHIVES = """
WITH payloads AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
     hashed AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha256(html) AS payload_digest FROM payloads),
     firsts AS (SELECT payload_digest, min(page_id) AS first_page FROM hashed WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, h.payload_digest, CASE WHEN first_page < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first_page < page_id THEN first_page END AS refers_to
FROM hashed h LEFT JOIN firsts f ON f.payload_digest = h.payload_digest AND payload_bytes >= 100"""

VECTOR_JOIN = """
WITH RECURSIVE vectors AS (
       SELECT vec_id, label, embedding::DOUBLE[] AS v,
              coalesce(len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
                       AND len(list_filter(embedding, lambda c: c <> 0)) > 0, false) AS usable
       FROM embeddings),
     links AS (
       SELECT a.vec_id AS a, b.vec_id AS b FROM vectors a JOIN vectors b
       ON a.label = b.label AND a.vec_id <> b.vec_id AND a.usable AND b.usable AND len(a.v) = len(b.v)
       WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
     reached AS (SELECT vec_id AS a, vec_id AS b FROM vectors UNION SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b)
SELECT v.vec_id, (SELECT count(*) FROM links l WHERE l.a = v.vec_id) AS n_links, c.component_id, c.component_id = v.vec_id AS kept
FROM vectors v JOIN (SELECT a, min(b) AS component_id FROM reached GROUP BY a) c ON c.a = v.vec_id"""

# the checksum of the id's digits, bit by bit: a byte is added, then eight shifts follow
CHECKSUM = """xor(list_reduce([4294967295::BIGINT]
           || flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
           lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384 ELSE 0 END) END), 4294967295)"""

PREFIX_TRIE = f"""
WITH turns AS (
       SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
              row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos
       FROM conversations WHERE conv_id IS NOT NULL),
     convs AS (SELECT conv_id, {CHECKSUM} % 6 AS h FROM (SELECT DISTINCT conv_id FROM turns)),
     rebuilt AS (
       SELECT c.conv_id, 0 AS own, t.pos, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.conv_id - c.conv_id % 100 AND t.pos < c.h
       UNION ALL SELECT c.conv_id, 1, t.pos, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.pos >= c.h),
     paths AS (
       SELECT conv_id, coalesce(list(struct_pack(role := role, text := text) ORDER BY own, pos) FILTER (WHERE pos IS NOT NULL), []) AS path
       FROM convs LEFT JOIN rebuilt USING (conv_id) GROUP BY conv_id),
     keyed AS (SELECT conv_id, path, len(path) AS n, list_transform(range(0, len(path) + 1), lambda d: sha256(path[1:d]::VARCHAR)) AS keys FROM paths),
     prefixes AS (SELECT conv_id, n, keys, path, unnest(range(0, n + 1)) AS depth FROM keyed),
     nodes AS (
       SELECT keys[depth + 1] AS key, depth, any_value(keys[1:depth + 1]) AS keys, min(conv_id) AS conv_id, count(*) AS n_convs,
              any_value(CASE WHEN depth > 0 THEN length(path[depth].text) ELSE 0 END) AS points,
              coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE n = depth), '') AS ends
       FROM prefixes GROUP BY ALL),
     counted AS (SELECT n.*, (SELECT count(*) FROM nodes c WHERE c.depth = n.depth + 1 AND c.keys[n.depth + 1] = n.key) AS n_children FROM nodes n)
SELECT a.conv_id, a.depth, any_value(p.conv_id) AS parent_conv_id, any_value(a.n_convs) AS n_convs, any_value(a.n_children) AS n_children,
       count(*) FILTER (WHERE b.n_children = 0) AS n_leaves, sum((b.n_convs - 1) * b.points)::BIGINT AS saved_tokens, sha256(any_value(a.ends)) AS ends_sha256
FROM counted a JOIN counted b ON b.depth >= a.depth AND b.keys[a.depth + 1] = a.key
LEFT JOIN nodes p ON p.depth = a.depth - 1 AND p.key = a.keys[a.depth]
GROUP BY a.conv_id, a.depth"""

LLM_ORACLE: dict[str, str] = {
    "op3_warc": ARCHIVES,
    "op8_vector_join": VECTOR_JOIN,
    "op12_prefix_trie": PREFIX_TRIE,
}
