"""op5: lines of every document, those removed, and the digest of what stays."""

from pyspark.sql import functions as F

from kgspark.llm.common import documents
from kgspark.llm.line_dedup import dedup_lines
from kgspark.llm.registry import query

SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
w AS (SELECT doc_id, unnest(generate_series(1, len(l) - 2)) AS p, l FROM d WHERE len(l) >= 3),
g AS (SELECT doc_id, p, l[p] || chr(10) || l[p + 1] || chr(10) || l[p + 2] AS body FROM w
      WHERE NOT regexp_full_match(l[p] || l[p + 1] || l[p + 2], '[ \t\r]*')),
r AS (SELECT doc_id, p, row_number() OVER (PARTITION BY body ORDER BY doc_id, p) AS nth FROM g),
c AS (SELECT DISTINCT doc_id, p + k AS p FROM r, (VALUES (0), (1), (2)) AS v(k) WHERE nth > 1),
a AS (SELECT doc_id, unnest(l) AS line, unnest(generate_series(1, len(l))) AS p FROM d)
SELECT a.doc_id, count(*)::INTEGER AS n_lines, count(c.p)::INTEGER AS n_removed,
       md5(coalesce(string_agg(a.line, chr(10) ORDER BY a.p) FILTER (c.p IS NULL), '')) AS text_md5
FROM a LEFT JOIN c ON a.doc_id = c.doc_id AND a.p = c.p GROUP BY a.doc_id
"""


@query("op5_line_dedup", SQL)
def op5_line_dedup(spark, sf_dir):
    return (dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
            .select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_removed", F.md5("text").alias("text_md5")))
