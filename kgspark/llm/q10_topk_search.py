"""op10: the five best of all vectors for every fiftieth one."""

from pyspark.sql import functions as F

from kgspark.llm.registry import query
from kgspark.llm.topk_search import top_k

SQL = """
WITH v AS (SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.i AS q, q.vec_id AS query_id, c.i, c.vec_id, list_sum(list_transform(list_zip(q.x, c.x), lambda z: z[1] * z[2]))::BIGINT AS score
      FROM v q, v c WHERE q.vec_id % 50 = 0 AND q.i <> c.i),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id, i)::INTEGER AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


@query("op10_topk_search", SQL)
def op10_topk_search(spark, sf_dir):
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 50 == 0)
