"""SQL that gives the rows of the queries that SQL can express."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ESCAPED = "text_"
for _a, _b in (("\\", "\\\\"), ("<|", "<\\|"), ("<s>", "<\\s>"), ("</s>", "<\\/s>"), ("[INST]", "[\\INST]"), ("[/INST]", "[\\/INST]"), ("<<SYS>>", "<\\<SYS>>"), ("<</SYS>>", "<\\</SYS>>")):
    _ESCAPED = f"replace({_ESCAPED}, '{_a}', '{_b}')"

CHAT = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text_ FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text_ || chr(10), '' ORDER BY turn, role, text_)) AS turns_sha256,
  CAST(coalesce(sum(length(text_)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text_, '' ORDER BY turn, role, text_) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(13 + length(replace(replace(replace(role, '\\', '\\\\'), '|', '\\|'), '<', '\\<')) + length({_ESCAPED})) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id"""

_COMPONENTS = """, reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n p ON a = p.doc_id JOIN n q ON b = q.doc_id WHERE 100 * i >= 75 * (p.n + q.n - i)){_COMPONENTS},
c AS (SELECT a AS doc_id, min(least(a, b)) AS m FROM reach GROUP BY a)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.m, doc_id) AS component_id, coalesce(c.m, doc_id) = doc_id AS kept FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)"""

EMBEDDINGS = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.v) = len(y.v) WHERE list_cosine_similarity(x.v, y.v) >= 0.93){_COMPONENTS},
c AS (SELECT a AS vec_id, min(least(a, b)) AS m FROM reach GROUP BY a), k AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(m, vec_id) AS component_id, coalesce(m, vec_id) = vec_id AS kept FROM embeddings LEFT JOIN c USING (vec_id) LEFT JOIN k USING (vec_id)"""

_WORDS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, unnest(list_transform(range(1, len(w) - least(10, len(w)) + 2), lambda i: array_to_string(w[i:i + least(10, len(w)) - 1], ' '))) AS t FROM b WHERE len(w) > 0),
dw AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS p, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS t FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n),
hit AS (SELECT doc_id, item_id, p, dw.n FROM dw JOIN iw ON dw.n = iw.n AND dw.t = iw.t),
h AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hit) GROUP BY doc_id),
i AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM hit GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)"""
