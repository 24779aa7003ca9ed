"""op3: predicted language of every document."""

from pyspark.sql import functions as F

from kgspark.llm.common import documents
from kgspark.llm.language_id import held_out, learn, predict
from kgspark.llm.registry import query


@query("op3_language_id")
def op3_language_id(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return (predict(docs.select("doc_id", "text"), learn(docs))
            .select(F.col("row.doc_id").alias("doc_id"), held_out(F.col("row.doc_id")).alias("held_out"),
                    "lang_pred", "score"))
