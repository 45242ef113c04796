"""SQL that states what three of the queries return; DuckDB runs it on the same tables.

It compares everything with everything by hashes of strings, so it is for small tables.  The other queries have none:
they train models, encode tokens, draw by hashes that DuckDB lacks, search a graph, or label a page by a minimum cut.
"""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = f"translate({{}}, '{_UPPER}', '{_LOWER}')"

#: Two-word shingles, links by exact set sizes, the smallest id reachable.
NEAR_DUPLICATES = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_FOLD.format("COALESCE(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END)) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
sets AS (SELECT doc_id, list_sort(list(g)) AS l FROM s GROUP BY 1),
rep AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY l) AS r FROM sets),
one AS (SELECT s.doc_id, s.g FROM s JOIN (SELECT DISTINCT r AS doc_id FROM rep) USING (doc_id)),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM one a JOIN one b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
ab AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT r AS id, r AS to_ FROM (SELECT DISTINCT r FROM rep) UNION SELECT reach.id, ab.b FROM reach JOIN ab ON ab.a = reach.to_),
c AS (SELECT id, min(to_) AS component FROM reach GROUP BY 1)
SELECT d.doc_id, COALESCE(n.n, 0)::BIGINT AS n_shingles, COALESCE(c.component, d.doc_id) AS component_id, COALESCE(c.component, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN c ON c.id = rep.r"""

#: Windows of ten words (all, of shorter items) as strings, in the documents wherever they occur.
DECONTAMINATION = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all({_FOLD.format("COALESCE(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all({_FOLD.format("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
k AS (SELECT *, least(10, len(w)) AS k FROM i WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda p: array_to_string(w[p:p + k - 1], ' '))) AS g FROM k),
places AS (SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS p, w FROM w, (SELECT DISTINCT k FROM k) WHERE len(w) >= k),
hit AS (SELECT DISTINCT doc_id, p, v.k, item_id FROM places v JOIN win ON win.k = v.k AND win.g = array_to_string(v.w[p:p + v.k - 1], ' ')),
words AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM hit) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n, string_agg(s, ',' ORDER BY s COLLATE "C") AS l FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hit) GROUP BY 1)
SELECT doc_id, len(w.w)::BIGINT AS n_words, COALESCE(words.n, 0)::BIGINT AS n_hit, COALESCE(items.n, 0)::BIGINT AS n_items, sha256(COALESCE(items.l, '')) AS items_sha256, COALESCE(words.n, 0) > 0 AS contaminated
FROM w LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""

#: Every string of 100 bytes, as hexadecimal digits; what a later one covers, as runs.
SUBSTRINGS = """
WITH t AS (SELECT doc_id, hex(encode(COALESCE(text, ''))) AS x, octet_length(encode(COALESCE(text, ''))) AS n FROM documents),
s AS (SELECT doc_id, p, substr(x, 2 * p + 1, 200) AS g FROM (SELECT doc_id, x, unnest(range(0, n - 99)) AS p FROM t WHERE n >= 100)),
later AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY md5(g), length(g) ORDER BY doc_id, p) AS k FROM s) WHERE k > 1),
r AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100 THEN 0 ELSE 1 END AS new FROM later)),
cut AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS b FROM r GROUP BY doc_id, run),
gone AS (SELECT doc_id, sum(b - a)::BIGINT AS n, count(*) AS k FROM cut GROUP BY 1),
edge AS (SELECT doc_id, b AS a, COALESCE(lead(a) OVER (PARTITION BY doc_id ORDER BY a), 1000000000) AS b FROM cut UNION ALL SELECT doc_id, 0, min(a) FROM cut GROUP BY 1),
kept AS (SELECT doc_id, string_agg(substr(x, 2 * a + 1, 2 * (least(b, n) - a)), '' ORDER BY a) AS x FROM edge JOIN t USING (doc_id) GROUP BY 1)
SELECT t.doc_id, t.n::BIGINT AS n_bytes, COALESCE(gone.n, 0)::BIGINT AS n_removed, COALESCE(gone.k, 0)::BIGINT AS n_spans, sha256(unhex(COALESCE(kept.x, t.x))) AS kept_sha256
FROM t LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)"""
