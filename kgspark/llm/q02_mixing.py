"""op2: size, target and words taken of every document."""

from pyspark.sql import functions as F

from kgspark.llm.common import documents
from kgspark.llm.mixing import with_copies
from kgspark.llm.registry import query

SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
           FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
p AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS place FROM s),
w AS (SELECT *, ((place - 1) % 3 + 1)::BIGINT AS weight, source_size * 3.0::DOUBLE AS cap,
             (sum(source_size) OVER ())::DOUBLE AS total FROM p),
b AS (SELECT *, (sum(weight) OVER ())::DOUBLE AS weights,
             coalesce(sum(cap) OVER r, 0.0::DOUBLE) AS capped_before,
             coalesce(sum(weight) OVER r, 0)::DOUBLE AS weight_before
      FROM w WINDOW r AS (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, cap / weight <= (total - capped_before) / (weights - weight_before) AS stopped FROM b),
t AS (SELECT source, source_size, CASE WHEN stopped THEN cap ELSE weight * (
             (total - coalesce(sum(cap) FILTER (stopped) OVER (), 0.0::DOUBLE))
             / (sum(weight) FILTER (NOT stopped) OVER ())::DOUBLE) END AS target FROM c),
r AS (SELECT d.*, t.source_size, t.target,
             CASE WHEN t.source_size > 0 THEN least(t.target / t.source_size, 3.0::DOUBLE) ELSE 0.0::DOUBLE END AS rate,
             ('0x' || substr(md5('mix:' || coalesce(d.doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE
                 / 4503599627370496.0::DOUBLE AS u
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       size * (floor(rate)::BIGINT + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS taken FROM r
"""


@query("op2_mixing", SQL)
def op2_mixing(spark, sf_dir):
    return with_copies(documents(spark, sf_dir)).select(
        F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target",
        (F.col("size") * F.col("copies")).alias("taken"))
