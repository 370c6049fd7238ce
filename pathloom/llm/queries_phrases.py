"""The query over phrases of all documents."""

from __future__ import annotations

from pathloom.llm import collocations
from pathloom.llm.common import table
from pathloom.llm.registry import query


def _grams(k: int) -> str:
    words = " || ' ' || ".join(f"w[i + {j}]" if j else "w[i]" for j in range(k))
    return f"SELECT lang, {k} AS k, {words} AS phrase FROM (SELECT lang, w, unnest(range(1, len(w) - {k - 2})) AS i FROM p)"


_PHRASES_SQL = rf"""
WITH p AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
g AS (SELECT lang, k, phrase, count(*) AS c FROM ({" UNION ALL ".join(_grams(k) for k in range(1, 6))}) GROUP BY ALL HAVING count(*) >= 100),
t AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM p GROUP BY lang),
s AS (SELECT lang, k, phrase, c, string_split(phrase, ' ') AS w FROM g WHERE k > 1),
cuts AS (
  SELECT s.lang, s.k, s.phrase, s.c AS a, j, l.c AS l, r.c AS r, t.n, (1000::HUGEINT * s.c * t.n) // (l.c::HUGEINT * r.c) AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM s) s JOIN t USING (lang)
  JOIN g l ON l.lang = s.lang AND l.phrase = array_to_string(s.w[1:s.j], ' ')
  JOIN g r ON r.lang = s.lang AND r.phrase = array_to_string(s.w[s.j + 1:s.k], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inner_parts AS (
  SELECT lang, c, array_to_string(w[i:i + m - 1], ' ') AS phrase
  FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM s))),
kept AS (
  SELECT * FROM best b WHERE NOT EXISTS (SELECT 1 FROM inner_parts x WHERE x.lang = b.lang AND x.phrase = b.phrase AND 100 * x.c >= 100 * b.a)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r,
  CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked WHERE rank <= 2000
"""


@query("op13_collocations", _PHRASES_SQL)
def phrase_collocations(spark, sf_dir):
    return collocations.mine(table(spark, sf_dir, "documents"))
