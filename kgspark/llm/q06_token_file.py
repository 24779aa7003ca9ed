"""op6: documents as found in the written token files."""

import public_tokenizers

from kgspark.llm.common import documents
from kgspark.llm.registry import query
from kgspark.llm.token_file import read_documents, write_token_files

END_ID = 2


@query("op6_token_file")
def op6_token_file(spark, sf_dir):
    return read_documents(write_token_files(
        documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), END_ID))
