"""op11: digests of every document's ids and decoded text under the vocabulary with word ends."""

import public_tokenizers
from pyspark.sql import functions as F

from kgspark.llm.common import documents
from kgspark.llm.registry import query
from kgspark.llm.trie_bpe import encode_and_decode


@query("op11_trie_bpe")
def op11_trie_bpe(spark, sf_dir):
    rows = encode_and_decode(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    return rows.select(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))
