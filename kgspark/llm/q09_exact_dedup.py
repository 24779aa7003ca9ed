"""op9: one row per document with the row that stays for its text."""

from pyspark.sql import functions as F

from kgspark.llm.common import documents
from kgspark.llm.exact_dedup import exact_classes
from kgspark.llm.registry import query

SQL = """
WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                           'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""


@query("op9_exact_dedup", SQL)
def op9_exact_dedup(spark, sf_dir):
    rows = exact_classes(documents(spark, sf_dir))
    return rows.select(F.col("me.key").alias("doc_id"), F.col("keep.key").alias("keep_id"),
                       F.col("size").alias("group_size"),
                       F.col("me.key").eqNullSafe(F.col("keep.key")).alias("kept"),
                       F.col("me.sha").alias("text_sha256"))
