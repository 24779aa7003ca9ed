"""op7: tokens of every document under the byte-level vocabulary."""

import public_tokenizers
from pyspark.sql import functions as F

from kgspark.llm.common import documents
from kgspark.llm.registry import query
from kgspark.llm.token_counts import count_tokens

LIMIT = 512


@query("op7_token_counts")
def op7_token_counts(spark, sf_dir):
    return (count_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
            .select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens",
                    (F.col("n_tokens") > LIMIT).alias("over_limit")))
