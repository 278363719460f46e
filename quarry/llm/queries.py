"""The queries of this subpackage, and their SQL for DuckDB."""

from . import centroids, chat_format, decontaminate, language_id, license_scan, line_dedup, mixing, near_dedup, prefix_trie, quality, secret_scan, substring_dedup, toxicity

_SPACE = r"[\x20\x09-\x0D]"
_WORD = r"[^\x20\x09-\x0D]+"


def _kmeans(k: int, rounds: int) -> str:
    """Lloyd's rounds one by one, on integers."""
    near = """a{i} AS (SELECT r, vec_id, v, min_by(j, (dist, j)) AS j, min(dist) AS dist FROM
      (SELECT r, vec_id, v, j, list_sum(list_transform(list_zip(v, c), lambda x: (x[1] - x[2]) * (x[1] - x[2])))::BIGINT AS dist FROM p, c{i}) GROUP BY r, vec_id, v)"""
    move = """s{i} AS (SELECT j, q, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT j, unnest(v) AS x, generate_subscripts(v, 1) AS q FROM a{i}) GROUP BY j, q),
n{i} AS (SELECT j, list((s - ((s % n) + n) % n) // n ORDER BY q) AS c FROM s{i} GROUP BY j),
c{m} AS (SELECT j, coalesce(n{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN n{i} USING (j))"""
    steps = ",\n".join(near.format(i=i) + ",\n" + move.format(i=i, m=i + 1) for i in range(rounds))
    return f"""
WITH p AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id::VARCHAR) NULLS LAST, v) - 1 AS j, v AS c FROM p QUALIFY j < {k}),
{steps},
{near.format(i=rounds)}
SELECT vec_id, j::INTEGER AS cluster, dist AS distance, (sum(dist) OVER (PARTITION BY j))::BIGINT AS cluster_inertia, (sum(dist) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (j)"""


QUERIES = {
    "op1_substring_dedup": substring_dedup.op1_substring_dedup,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_mixing": mixing.op3_mixing,
    "op4_license_scan": license_scan.op4_license_scan,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_chat_format": chat_format.op6_chat_format,
    "op7_near_dedup": near_dedup.op7_near_dedup,
    "op8_quality": quality.op8_quality,
    "op9_language_id": language_id.op9_language_id,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_prefix_trie": prefix_trie.op11_prefix_trie,
    "op12_centroids": centroids.op12_centroids,
    "op13_secret_scan": secret_scan.op13_secret_scan,
}

ORACLE_SQL = {
    "op1_substring_dedup": f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
g AS (SELECT doc_id, r, p, list_aggregate(w[p : p + 12], 'string_agg', ' ') AS k
      FROM (SELECT doc_id, r, w, unnest(range(1, len(w) - 11)) AS p FROM d WHERE len(w) >= 13)),
m AS (SELECT k, min(doc_id) AS least FROM g GROUP BY k HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT r, unnest(range(p, p + 13)) AS i FROM g JOIN m USING (k) WHERE g.doc_id > m.least),
a AS (SELECT r, list(i) AS i FROM gone GROUP BY r),
-- A path breaks where edges stop or the source changes.
e AS (SELECT r, p, least, lag(p) OVER (PARTITION BY r ORDER BY p) AS before, lag(least) OVER (PARTITION BY r ORDER BY p) AS was
      FROM g JOIN m USING (k) WHERE g.doc_id > m.least),
n AS (SELECT r, count(*) AS n FROM e WHERE before IS NULL OR before < p - 1 OR was <> least GROUP BY r)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(a.i), 0)::BIGINT AS n_removed,
       sha256(coalesce(array_to_string(list_transform(list_filter(range(1, len(w) + 1), lambda j: NOT list_contains(coalesce(a.i, []), j)), lambda j: w[j]), ' '), '')) AS kept_sha256,
       coalesce(n.n, 0)::BIGINT AS n_paths
FROM d LEFT JOIN a USING (r) LEFT JOIN n USING (r)""",
    "op2_line_dedup": r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
x AS (SELECT r, p, l[p] AS line, translate(regexp_replace(l[p], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
      FROM (SELECT r, l, unnest(range(1, len(l) + 1)) AS p FROM d)),
hot AS (SELECT k FROM x WHERE k <> '' GROUP BY k HAVING count(DISTINCT r) >= 10),
kept AS (SELECT r, p, line, k IN (SELECT k FROM hot) AS gone FROM x)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT gone), '')) AS kept_sha256
FROM kept JOIN d USING (r) GROUP BY r, doc_id""",
    "op6_chat_format": r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'), (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')),
e AS (SELECT *, replace(replace(text, '\', '\\'), '<|', '<\|') AS et, replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\n') AS er FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(er) + length(et) + length('<|im_start|><|im_end|>') + 2)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id""",
    "op11_prefix_trie": r"""
WITH t0 AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(role)::VARCHAR || ':' || role || text)) AS p FROM t0),
-- CRC-32 of the decimal id, bit by bit.
h AS (SELECT conv_id, conv_id - conv_id % 100 AS base, n, xor(list_reduce([4294967295] || list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
        lambda c, x: list_reduce([xor(c, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, 3988292384 * (y & 1)))), 4294967295) % 6 AS h
      FROM (SELECT conv_id, count(*) AS n FROM t GROUP BY conv_id)),
c AS (SELECT h.conv_id, h.base, h.h, least(h.h, coalesce(b.n, 0)) AS head, least(h.h, coalesce(b.n, 0)) + greatest(h.n - h.h, 0) AS n FROM h LEFT JOIN h b ON b.conv_id = h.base),
r AS (SELECT c.conv_id, p AS d, role, text FROM c JOIN t ON t.conv_id = c.base AND p <= head
      UNION ALL SELECT c.conv_id, p - h + head, role, text FROM c JOIN t USING (conv_id) WHERE p > h),
x AS (SELECT conv_id, 0 AS d, 0 AS chars, [] AS k FROM c
      UNION ALL SELECT conv_id, d, length(text), list(md5(length(role)::VARCHAR || ':' || role || text)) OVER (PARTITION BY conv_id ORDER BY d) FROM r),
m AS (SELECT md5(k::VARCHAR) AS k, d, chars, conv_id, min(conv_id) OVER w AS own, count(*) OVER w AS members FROM x WINDOW w AS (PARTITION BY k)),
nodes AS (SELECT *, lag(own) OVER (PARTITION BY conv_id ORDER BY d) AS parent FROM m),
o AS (SELECT own AS conv_id, d, k, members, chars, parent FROM nodes WHERE conv_id = own),
kids AS (SELECT parent AS conv_id, d - 1 AS d, count(*) AS kids FROM o WHERE d > 0 GROUP BY ALL),
o2 AS (SELECT o.*, coalesce(kids, 0) AS kids FROM o LEFT JOIN kids USING (conv_id, d)),
-- Every node counts for all prefixes of its owner.
below AS (SELECT m.k, m.d, sum((o2.members - 1) * o2.chars) AS saved, count(*) FILTER (o2.kids = 0) AS leaves FROM m JOIN o2 ON o2.conv_id = m.conv_id AND m.d <= o2.d GROUP BY ALL),
ends AS (SELECT k, m.d, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM m JOIN c USING (conv_id) WHERE m.d = c.n GROUP BY ALL)
SELECT conv_id, d::BIGINT AS depth, parent::BIGINT AS parent_conv_id, members::BIGINT AS n_convs, kids::BIGINT AS n_children, leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM o2 JOIN below USING (k, d) LEFT JOIN ends USING (k, d)""",
    "op12_centroids": _kmeans(40, 5),
}
