"""Token counts, token files and SentencePiece against the libraries themselves."""

import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kgspark.llm import sentence_piece as spm, token_file as tf
from kgspark.llm.q01_sentence_piece import encoded_and_decoded, op1_sentence_piece
from kgspark.llm.q06_token_file import op6_token_file
from kgspark.llm.q07_token_counts import op7_token_counts
from kgspark.llm.token_counts import TokenCounter, count_tokens, merge_count

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SIGNS = list("  \n\t'stremvld19aZéß語.!,　\x85​\xa0ª▁") + ["'s", "'re", "<|endoftext|>", " '", "'ll", "  ", "<s>", "😀"]


def fuzz(n=4000):
    rng = random.Random(7)
    return ["".join(rng.choice(SIGNS) for _ in range(rng.randrange(50))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BYTES)


def ids_of(library, texts):
    return [e.ids for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_merges():
    ranks = {("a", "b"): 1, ("b", "c"): 0, ("a", "bc"): 2, ("a", "a"): 3}
    assert merge_count(list("abc"), ranks) == 1 and merge_count(list("abab"), ranks) == 2
    assert merge_count([], ranks) == 0 and merge_count(list("aaa"), ranks) == 2


def test_fuzzed_counts_and_ids(library):
    texts = fuzz()
    with open(BYTES, encoding="utf-8") as f:
        config = f.read()
    known = ids_of(library, texts)
    assert TokenCounter(config).counts(texts) == [len(i) for i in known]
    coder = tf.LibraryEncoder(config)
    coder.memo.limit = 500  # forgets often
    flat, sizes = coder.ids(texts)
    assert sizes.tolist() == [len(i) for i in known] and flat.tolist() == [i for one in known for i in one]


def test_count_rows(spark, awkward, library):
    rows = awkward.select("doc_id", "text").collect()
    known = sorted(zip((r.doc_id for r in rows), ids_of(library, [r.text for r in rows])), key=repr)
    found = count_tokens(awkward, BYTES).collect()
    assert sorted(repr((r.id, r.n_tokens)) for r in found) == sorted(repr((k, len(i))) for k, i in known)
    assert count_tokens(awkward.limit(0), BYTES).count() == 0


def test_op7(spark, sf, library):
    rows = {r.doc_id: r for r in op7_token_counts(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    for d, ids in zip(docs, ids_of(library, [d.text for d in docs])):
        assert tuple(rows[d.doc_id])[1:] == (len((d.text or "").encode()), len(ids), len(ids) > 512)
    assert len(rows) == len(docs)


def reference_file_rows(library, rows):
    start, out = 0, []
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = ids_of(library, [text])[0] + [2]
        out.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4"))))
        start += len(ids)
    return out


def test_token_files(spark, awkward, library):
    manifest = tf.write_token_files(awkward, BYTES, 2, length=16)
    found = sorted(map(tuple, tf.read_documents(manifest).collect()), key=lambda r: r[1])
    assert found == reference_file_rows(library, [(r.doc_id, r.text) for r in awkward.collect()])
    for part in manifest.collect():  # sequences are views of the file, and the mask covers all but the padding
        file = tf.TokenFile(part.tokens_file)
        n = -(-part.n_tokens // 16)
        ids, masks = zip(*(file.sequence(i) for i in range(n)))
        assert all(len(i) == 16 and not i.flags.owndata for i in ids)
        assert np.concatenate(masks).sum() == part.n_tokens
        assert np.concatenate(ids)[:part.n_tokens].tolist() == np.concatenate(list(file.runs(0, part.n_tokens))).tolist()
    assert tf.read_documents(tf.write_token_files(awkward.limit(0), BYTES, 2)).count() == 0


def test_op6(spark, sf, library):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, op6_token_file(spark, sf).collect())) == reference_file_rows(library, docs)


def field(number, kind, data):
    head = bytes([number << 3 | kind]) if number < 16 else bytes([(number << 3 & 127) | kind | 128, number >> 4])
    return head + (bytes([len(data)]) + data if kind == 2 else data)


def unigram_model():
    """A small unigram model with byte pieces, as the bytes of a model file."""
    known = [("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3), *((f"<0x{b:02X}>", 0, 6) for b in range(256)),
             ("▁", -2, 1), ("a", -3, 1), ("b", -3.5, 1), ("ab", -4, 1), ("▁ab", -5, 1), ("▁a", -4.5, 1), ("ba", -4.25, 1)]
    out = b""
    for text, score, kind in known:
        body = field(1, 2, text.encode()) + field(2, 5, struct.pack("<f", score)) + field(3, 0, bytes([kind]))
        out += field(1, 2, body)
    out += field(2, 2, field(3, 0, b"\x01") + field(35, 0, b"\x01"))
    return out + field(3, 2, field(1, 2, b"identity") + field(3, 0, b"\x01") + field(4, 0, b"\x00") + field(5, 0, b"\x01"))


@pytest.mark.parametrize("data", [None, unigram_model()], ids=["bpe", "unigram"])
def test_sentence_piece_parity(data):
    if data is None:
        data = spm._model_bytes(PIECES)
        texts = fuzz()
    else:
        rng = random.Random(3)
        texts = ["".join(rng.choice("aab b\nß") for _ in range(rng.randrange(30))) for _ in range(2000)]
    known = sentencepiece.SentencePieceProcessor(model_proto=data)
    coder = spm.SentencePieceCodec(data, check=True)
    flat, sizes = coder.encode(texts)
    rows = [r.tolist() for r in np.split(flat, np.cumsum(sizes)[:-1])]
    assert rows == known.encode(texts) and coder.differing == 0
    assert coder.decode(rows) == known.decode(rows) == [coder.shown(t) for t in texts]


def test_sentence_piece_rows(spark, awkward):
    known = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = awkward.select("doc_id", "text").collect()
    found = spm.encode(awkward, PIECES, check=True)
    assert sorted(repr((r.id, r.ids)) for r in found.collect()) == sorted(repr((r.doc_id, known.encode(r.text or ""))) for r in rows)
    back = spm.decode(found, PIECES).collect()
    assert sorted(repr((r.id, r.text)) for r in back) == sorted(repr((r.doc_id, (r.text or "").replace("▁", " "))) for r in rows)
    digest = encoded_and_decoded(awkward, PIECES).collect()
    assert all(r.round_trip and r.parity for r in digest) and len(digest) == len(rows)
    assert encoded_and_decoded(awkward.limit(0), PIECES).count() == spm.encode(awkward.limit(0), PIECES).count() == 0


def test_op1(spark, sf):
    known = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op1_sentence_piece(spark, sf).collect()
    assert len(rows) == len(docs) and all(r.round_trip and r.parity for r in rows)
    for r in rows:
        ids = known.encode(docs[r.doc_id])
        assert (r.n_tokens, r.ids_crc32) == (len(ids), spm.ids_crc32(np.array(ids)))


@pytest.mark.parametrize("data", [None, unigram_model()], ids=["bpe", "unigram"])
def test_parity_covers_the_normaliser(data):
    from tokenizers import normalizers
    coder = spm.SentencePieceCodec(data or spm._model_bytes(public_tokenizers.path("piece_bpe_32k.model")), check=True)
    texts = ["", " ", "Plain Text", "  two  spaces ", "\uff21\ufb01 \u2163", "a\tb\nc"]

    def seen(whole):
        flat, sizes = coder.encode(texts)
        rows = np.split(flat, np.cumsum(sizes)[:-1])
        return coder.as_original(texts, rows, whole)

    assert all(seen(1 << 20)) and all(seen(0))
    coder.normalizer = normalizers.Replace("Text", "Test")
    assert not seen(1 << 20)[2] and not seen(0)[2] and coder.differing == 0
