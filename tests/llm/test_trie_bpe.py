"""Walked encodings and decodings against the tokenizers library."""

import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from kgspark.llm import q11_trie_bpe, trie_bpe
from kgspark.llm.trie_bpe import TrieEncoder, encode_and_decode

FILE = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(FILE)


@pytest.fixture(scope="module")
def coder():
    with open(FILE, encoding="utf-8") as f:
        return TrieEncoder(f.read())


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return ids, library.decode(ids, skip_special_tokens=False)


def same(coder, library, texts):
    for text, ids in zip(texts, coder.encode_batch(texts)):
        assert (ids.tolist(), coder.decode(ids).decode()) == expected(library, text), text[:200]


def test_words(coder, library):
    rng = random.Random(1)
    words = ["".join(rng.choices("aehnotsié'", k=rng.randint(1, 14))) for _ in range(6000)]
    words += ["".join(rng.choices("ab", k=rng.randint(1, 12))) for _ in range(500)] + ["a" * k for k in range(1, 60)]
    vocab = sorted(library.get_vocab())
    words += ["".join(rng.choices(vocab, k=2)).replace("</w>", "") for _ in range(6000)]
    same(coder, library, [" ".join(words), *words[:300], *words[-300:]])


def test_every_latin_character(coder, library):
    chars = [chr(i) for i in range(0x250)] + ["́", " ", "　", "語", "\U0001F600", "Σ", "ﬁ", "Ⅳ", "İ"]
    rng = random.Random(2)
    same(coder, library, [f"a{c}b {c}{c} 'S{c}" for c in chars] + ["".join(rng.choices(chars, k=40)) for _ in range(800)])


def test_special_strings(coder, library):
    same(coder, library, ["<|endoftext|>", "a<|endoftext|><|startoftext|>b", "<|ENDOFTEXT|>", "x <|endoftext|> É <|endoftext", "", " ", "\n"])


def test_long_texts(coder, library):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghij é", k=rng.randint(3, 9))) for _ in range(500)]
    text = " ".join(rng.choices(words, k=800_000))
    assert len(text) > 5_000_000
    same(coder, library, [text, "x" * 20_000 + " y"])
    run = "".join(rng.choices("abcdefgh", k=1_200_000))  # one word longer than a part
    ids = coder.encode(run)
    assert coder.decode(ids).decode().replace(" ", "") == run + "</w>" and ids[:500].tolist() == library.encode(run[:4000]).ids[:500]


def test_memo_forgets(library, monkeypatch):
    monkeypatch.setattr(trie_bpe, "KNOWN_WORDS", 50)
    with open(FILE, encoding="utf-8") as f:
        coder = TrieEncoder(f.read())
    rng = random.Random(4)
    for _ in range(30):
        same(coder, library, ["common words " + " ".join("".join(rng.choices("abcd", k=5)) for _ in range(20)) for _ in range(2)])


def test_refused_files():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f, pytest.raises(ValueError):
        TrieEncoder(f.read())


def test_awkward_rows(spark, awkward, library):
    rows = encode_and_decode(awkward, FILE).collect()
    source = awkward.collect()
    assert len(rows) == len(source)
    got = sorted((str(r.id), r.ids, r.decoded) for r in rows)
    assert got == sorted((str(r.doc_id), *expected(library, r.text)) for r in source)
    assert encode_and_decode(awkward.limit(0), FILE).collect() == []


def test_query(spark, sf, library):
    df = q11_trie_bpe.op11_trie_bpe(spark, sf)
    assert df.dtypes == [("doc_id", "bigint"), ("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")]
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = df.collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids, decoded = expected(library, texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (
            len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
