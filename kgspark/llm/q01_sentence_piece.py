"""op1: every whole text encoded and decoded, with the original library's ids compared."""

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kgspark.llm.common import documents, text_slices
from kgspark.llm.registry import query
from kgspark.llm.sentence_piece import _model_bytes, codec, ids_crc32

SLICE = 1 << 20  # bytes of text whose ids are held as Python numbers at once


def encoded_and_decoded(docs: DataFrame, model_file: str, check: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids_crc32, round_trip, parity) per row of docs.

    round_trip: the decoded ids are the text again, but for the model's own marking of spaces.
    parity: the original library gives the whole raw text the same ids.
    """
    data = _model_bytes(model_file)

    def run(batches):
        coder = codec(data, check, by_piece=False)
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            for first, part in text_slices(texts, SLICE):
                part = [t.decode() for t in part]
                flat, sizes = coder.encode(part)
                rows = np.split(flat, np.cumsum(sizes)[:-1])
                same = [a == coder.shown(t) for a, t in zip(coder.decode([r.tolist() for r in rows]), part)]
                agree = coder.as_original(part, rows) if check else [True] * len(part)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, len(part)), pa.array(sizes), pa.array([ids_crc32(r) for r in rows], pa.int64()),
                     pa.array(same, pa.bool_()), pa.array(agree, pa.bool_())],
                    names=["doc_id", "n_tokens", "ids_crc32", "round_trip", "parity"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
            .mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long, round_trip boolean, parity boolean"))


@query("op1_sentence_piece")
def op1_sentence_piece(spark, sf_dir):
    return encoded_and_decoded(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
