"""SQL over the same tables for the queries that SQL can express; everything is compared with everything."""

from __future__ import annotations

_WORDS = r"w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents)"

_REACH = """both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT a AS x, a AS y FROM both_ways UNION SELECT r.x, g.b FROM reach r JOIN both_ways g ON g.a = r.y),
comp AS (SELECT x, min(y) AS root FROM reach GROUP BY x)"""

OP2 = f"""WITH RECURSIVE {_WORDS},
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)
  UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM w WHERE len(ws) BETWEEN 1 AND 4),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS k FROM s p JOIN s q ON p.g = q.g AND p.doc_id < q.doc_id GROUP BY p.doc_id, q.doc_id),
l AS (SELECT a, b, k = x.n AND k = y.n AS same FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 5 * k >= 4 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l),
{_REACH},
c AS (SELECT b AS doc_id, min(a) AS lead FROM l WHERE same GROUP BY b),
m AS (SELECT a AS doc_id, count(*) AS k FROM (SELECT a FROM e UNION ALL SELECT b FROM e) GROUP BY a)
SELECT w.doc_id, coalesce(comp.root, w.doc_id) AS class_id, coalesce(m.k, 0) AS n_links, coalesce(c.lead, w.doc_id) AS copy_of
FROM w LEFT JOIN comp ON comp.x = w.doc_id LEFT JOIN m ON m.doc_id = w.doc_id LEFT JOIN c ON c.doc_id = w.doc_id"""

OP7 = f"""WITH {_WORDS},
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)),
f AS (SELECT k, min(doc_id) AS lead FROM win GROUP BY k),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM win JOIN f ON f.k = win.k AND f.lead < win.doc_id, range(13) r(j)),
x AS (SELECT doc_id, unnest(ws) AS x, generate_subscripts(ws, 1) AS p FROM w),
t AS (SELECT x.doc_id, count(*) AS n_words, count(gone.p) AS n_removed, string_agg(x.x, ' ' ORDER BY x.p) FILTER (gone.p IS NULL) AS kept FROM x LEFT JOIN gone ON gone.doc_id = x.doc_id AND gone.p = x.p GROUP BY x.doc_id)
SELECT w.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN t ON t.doc_id = w.doc_id"""

OP9 = f"""WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
e AS (SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q ON p.vec_id < q.vec_id WHERE list_cosine_similarity(p.v, q.v) >= 0.9),
{_REACH},
m AS (SELECT a AS vec_id, count(*) AS k FROM both_ways GROUP BY a)
SELECT v.vec_id, coalesce(m.k, 0) AS n_links, coalesce(comp.root, v.vec_id) AS component_id, coalesce(comp.root, v.vec_id) = v.vec_id AS kept
FROM v LEFT JOIN comp ON comp.x = v.vec_id LEFT JOIN m ON m.vec_id = v.vec_id"""
