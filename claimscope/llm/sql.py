"""SQL of the llm queries that SQL can express, for comparison by DuckDB."""

SQL = {
    "p1_agreement": """
WITH a AS (SELECT DISTINCT doc_id, span.lo AS lo, span.hi AS hi, worker_id, assignment_id, created,
                  CASE WHEN weight = 0 THEN 'NONE' ELSE mention_type END AS label
           FROM evaluation_mention_response
           WHERE doc_id IS NOT NULL AND span.lo IS NOT NULL AND span.hi IS NOT NULL AND worker_id IS NOT NULL),
w AS (SELECT doc_id, lo, hi, worker_id, label FROM (SELECT doc_id, lo, hi, worker_id, label, count(*) AS n FROM a WHERE label IS NOT NULL GROUP BY ALL)
      QUALIFY row_number() OVER (PARTITION BY doc_id, lo, hi, worker_id ORDER BY n DESC, label) = 1),
l AS (SELECT doc_id, lo, hi, label, count(*) AS n FROM w GROUP BY ALL),
i AS (SELECT doc_id, lo, hi, sum(n) AS s, sum(n * (n - 1)) AS same FROM l GROUP BY ALL HAVING sum(n) > 1),
c AS (SELECT label, sum(n) AS c FROM l SEMI JOIN i USING (doc_id, lo, hi) GROUP BY label),
o AS (SELECT count(*) AS n_items, sum(s) AS n_answers, sum((s * (s - 1) - same) / (s - 1)::DOUBLE) / sum(s)::DOUBLE AS od FROM i),
e AS (SELECT sum(c * (c - 1))::DOUBLE AS e FROM c)
SELECT n_items, CAST(n_answers AS BIGINT) AS n_answers, round(od, 6) AS observed_disagreement,
       round(1 - e / (n_answers::DOUBLE * (n_answers - 1)), 6) AS expected_disagreement,
       round(1 - od / (1 - e / (n_answers::DOUBLE * (n_answers - 1))), 6) AS alpha
FROM o, e""",
    "p6_found": """
WITH RECURSIVE m AS (SELECT DISTINCT submission_id AS s, doc_id AS d, span.lo AS lo, span.hi AS hi, canonical_span.lo AS clo, canonical_span.hi AS chi FROM submission_mention),
k AS (SELECT DISTINCT s, d, lo, hi FROM m),
n AS (SELECT *, row_number() OVER (ORDER BY d, lo, hi, s) AS id FROM k),
l AS (SELECT DISTINCT n.id, submission_id AS s, link_name FROM submission_link x
      JOIN n ON n.s = x.submission_id AND n.d = x.doc_id AND n.lo = x.span.lo AND n.hi = x.span.hi
      WHERE link_name <> '' AND upper(link_name) <> 'WIKI:NULL'),
e1 AS (SELECT a.id AS u, b.id AS v FROM m JOIN n a USING (s, d, lo, hi) JOIN n b ON b.s = m.s AND b.d = m.d AND b.lo = m.clo AND b.hi = m.chi WHERE a.id <> b.id
       UNION SELECT id, min(id) OVER (PARTITION BY s, link_name) FROM l),
e AS (SELECT u, v FROM e1 UNION SELECT v, u FROM e1),
r(id, root) AS (SELECT DISTINCT u, u FROM e UNION SELECT e.v, r.root FROM r JOIN e ON e.u = r.id WHERE r.root < e.v),
g AS (SELECT id, min(root) AS root FROM r GROUP BY id)
SELECT n.s AS submission_id, n.d AS doc_id, n.lo AS span_lo, n.hi AS span_hi, t.d AS group_doc_id, t.lo AS group_span_lo, t.hi AS group_span_hi
FROM g JOIN n ON n.id = g.id JOIN n t ON t.id = g.root
WHERE g.id <> g.root OR g.id IN (SELECT root FROM g WHERE id <> root)""",
}
