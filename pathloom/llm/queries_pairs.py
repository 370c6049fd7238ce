"""Queries that compare documents or lines with each other."""

from __future__ import annotations

from pathloom.llm import linededup, neardup
from pathloom.llm.common import table
from pathloom.llm.registry import query


@query("op4_bayes_jaccard")
def bayes_jaccard(spark, sf_dir):
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


_LINES_SQL = r"""
WITH l AS (
  SELECT doc_id, i, string_split(coalesce(text, ''), chr(10))[i] AS line
  FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)),
w AS (SELECT doc_id, i, list_sort(list_distinct(regexp_extract_all(line, '[^\x20\x09-\x0D]+'))) AS words FROM l),
s AS (SELECT words, min(struct_pack(d := doc_id, i := i)) AS first, len(words) AS n FROM w WHERE len(words) > 0 GROUP BY words),
t AS (SELECT first, n, unnest(words) AS word FROM s),
df AS (SELECT word, count(*) AS c FROM t GROUP BY word),
r AS (SELECT t.*, row_number() OVER (PARTITION BY first ORDER BY c, word) AS pos FROM t JOIN df USING (word)),
p AS (SELECT * FROM r WHERE pos <= n - ceil(n * 4 / 5.0) + 1),
c AS (SELECT DISTINCT a.first AS late, b.first AS early FROM p a JOIN p b ON a.word = b.word AND b.first < a.first
      WHERE 5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n),
g AS (SELECT DISTINCT late FROM c JOIN s x ON x.first = late JOIN s y ON y.first = early
      WHERE 5 * len(list_intersect(x.words, y.words)) >= 4 * (x.n + y.n - len(list_intersect(x.words, y.words)))),
k AS (SELECT first FROM s WHERE first NOT IN (SELECT late FROM g)),
f AS (SELECT l.doc_id, l.i, l.line, len(w.words) = 0 OR k.first IS NOT NULL AS stays
      FROM l JOIN w USING (doc_id, i) LEFT JOIN k ON k.first = struct_pack(d := l.doc_id, i := l.i))
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(t, '') END AS text, coalesce(n, 0) AS n_lines, coalesce(r, 0) AS n_removed
FROM documents d LEFT JOIN (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY i) FILTER (WHERE stays) AS t, count(*) AS n, count(*) FILTER (WHERE NOT stays) AS r
  FROM f GROUP BY doc_id) USING (doc_id)
"""


@query("op10_line_dedup", _LINES_SQL)
def line_dedup(spark, sf_dir):
    return linededup.dedup_lines(table(spark, sf_dir, "documents"), from_files=True)
