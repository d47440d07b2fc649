"""DuckDB SQL of the operators that SQL can express. Windows go by DuckDB's 64-bit hash, to keep the grouping small."""

#: Words and distinct shingles, links between documents that share a shingle, and what each can reach.
NEAR_DEDUP = r"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x09-\x0D\x20]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(list_slice(ws, i, i + 4), ' ') END AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
l AS (SELECT a.doc_id AS x, b.doc_id AS y FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id JOIN n p ON p.doc_id = a.doc_id JOIN n q ON q.doc_id = b.doc_id GROUP BY a.doc_id, b.doc_id, p.n, q.n HAVING 100 * count(*) >= 75 * (p.n + q.n - count(*))),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT r.x AS doc_id, any_value(coalesce(n.n, 0)) AS n_shingles, min(r.y) AS component_id, min(r.y) = r.x AS kept FROM r LEFT JOIN n ON n.doc_id = r.x GROUP BY r.x"""

#: Windows of 35 words by their text, and the words that repeated ones cover.
SUBSTRING_DEDUP = r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x09-\x0D\x20]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, i, hash(array_to_string(list_slice(ws, i, i + 34), ' ')) AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35)),
d AS (SELECT doc_id, i FROM s WHERE g IN (SELECT g FROM s GROUP BY 1 HAVING count(*) > 1)),
c AS (SELECT DISTINCT doc_id, i + k AS p FROM d, range(35) t(k)),
x AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS word FROM w WHERE len(ws) > 0),
k AS (SELECT x.doc_id, string_agg(x.word, ' ' ORDER BY x.p) AS kept FROM x LEFT JOIN c ON x.doc_id = c.doc_id AND x.p = c.p WHERE c.p IS NULL GROUP BY 1)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(r.n, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256 FROM w LEFT JOIN k ON w.doc_id = k.doc_id LEFT JOIN (SELECT doc_id, count(*) AS n FROM c GROUP BY 1) r ON w.doc_id = r.doc_id"""

#: Strings of 50 bytes as hex, those that a smaller document has, and the runs that they cover.
SUFFIX_DEDUP = """WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS b FROM documents),
s AS (SELECT doc_id, i, hash(substr(b, 2 * i + 1, 100)) AS g FROM (SELECT doc_id, b, unnest(range(0, len(b) // 2 - 49)) AS i FROM h WHERE len(b) >= 100)),
m AS (SELECT g, min(doc_id) AS first FROM s GROUP BY 1 HAVING min(doc_id) <> max(doc_id)),
d AS (SELECT s.doc_id, s.i FROM s JOIN m ON s.g = m.g WHERE m.first < s.doc_id),
o AS (SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 OR lag(i) OVER (PARTITION BY doc_id ORDER BY i) IS NULL THEN 1 ELSE 0 END AS f FROM d),
r AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS z FROM (SELECT *, sum(f) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM o) GROUP BY doc_id, k),
p AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM r),
k AS (SELECT p.doc_id, string_agg(substr(h.b, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(h.b), 2 * max(z) + 1) AS kept, sum(z - a) AS n, count(*) AS spans FROM p JOIN h ON p.doc_id = h.doc_id GROUP BY p.doc_id)
SELECT h.doc_id, CAST(len(h.b) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(k.n, 0) AS BIGINT) AS n_removed, coalesce(k.spans, 0) AS n_spans, sha256(unhex(coalesce(k.kept, h.b))) AS kept_sha256 FROM h LEFT JOIN k ON h.doc_id = k.doc_id"""

SQL = {"op1_near_dedup": NEAR_DEDUP, "op2_substring_dedup": SUBSTRING_DEDUP, "op5_suffix_dedup": SUFFIX_DEDUP}
