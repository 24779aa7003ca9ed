"""Words that a polynomial modulo 2^64 cannot tell apart (Thue-Morse, for every odd base), and texts beyond every internal slice."""

import random

import numpy as np
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from kgspark.llm.common import run_hashes
from kgspark.llm.jaccard_join import jaccard_groups
from kgspark.llm.license_scan import license_rows
from kgspark.llm.sentence_piece import SentencePieceCodec
from kgspark.llm.token_counts import TokenCounter
from kgspark.llm.token_file import LibraryEncoder

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def thue_morse(one, two, order=10):
    word = one
    for _ in range(order):
        word += word.translate(str.maketrans(one + two, two + one))
    return word


PAIRS = [(thue_morse(a, b), thue_morse(b, a)) for a, b in ("ab", "es", "cd")]


def test_hashes_differ():
    for order in range(3, 13):
        a, b = thue_morse("a", "b", order), thue_morse("b", "a", order)
        symbols = np.frombuffer((a + b).encode("utf-32-le"), np.uint32)
        h = run_hashes(symbols, np.array([0, len(a)]), np.array([len(a), 2 * len(a)]))
        assert h[0] != h[1]
        again = run_hashes(np.concatenate((symbols, symbols)), np.array([2 * len(a)]), np.array([3 * len(a)]))
        assert again[0] == h[0]


def test_tokenizers_keep_them_apart():
    library, original = Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    with open(BYTES, encoding="utf-8") as f:
        config = f.read()
    with open(PIECES, "rb") as f:
        codec = SentencePieceCodec(f.read())
    encoder, counter = LibraryEncoder(config), TokenCounter(config)
    for pair in PAIRS:
        texts = [f"say {word} twice {word}" for word in pair]
        known = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
        flat, sizes = encoder.ids(texts)
        assert flat.tolist() == known[0] + known[1] and sizes.tolist() == [len(i) for i in known]
        assert counter.counts(texts) == [len(i) for i in known]
        flat, sizes = codec.encode(texts)
        assert flat.tolist() == [i for t in texts for i in original.encode(t)]


def test_sets_and_words_keep_them_apart(spark):
    one, two = PAIRS[0]
    texts = [(1, f"{one} p q r {one} s"), (2, f"{two} p q r {two} s"), (3, f"{one} p q r {one} s"), (4, f"mit {one} mit license")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    groups = {r.id: r.comp_id for r in jaccard_groups(docs)[0].collect()}
    assert groups == {1: 1, 2: 2, 3: 1, 4: 4}
    rows = license_rows(docs, templates=[("odd", f"{one} p q r {one} s")]).collect()
    assert {r.doc_id: r.labels for r in rows} == {1: "odd", 2: "", 3: "odd", 4: "mit"}


def test_texts_of_five_million_characters(spark):
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdefghijklé", k=rng.randint(2, 9))) for _ in range(700)]
    text = " ".join(rng.choices(words, k=900_000)) + " mit license"
    near = text.replace(words[0], words[1])
    assert len(text) > 5_000_000
    library, original = Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    with open(BYTES, encoding="utf-8") as f:
        config = f.read()
    with open(PIECES, "rb") as f:
        codec = SentencePieceCodec(f.read(), check=True, by_piece=False)
    ids = library.encode(text, add_special_tokens=False).ids
    flat, sizes = LibraryEncoder(config).ids([text])
    assert flat.tolist() == ids and TokenCounter(config).counts([text]) == [len(ids)] == sizes.tolist()
    flat, _ = codec.encode([text])  # the original library cannot hold such a text's encoding at once
    assert flat[:100].tolist() == original.encode(text[:5000])[:100]
    assert codec.as_original([text, text], [flat, flat[:-1]]) == [True, False]
    docs = spark.createDataFrame([(1, text), (2, near), (3, text[:1000])], "doc_id long, text string")
    found = {r.id: (r.n, r.comp_id) for r in jaccard_groups(docs)[0].collect()}
    assert found[1][1] == found[2][1] == 1 and found[3][1] == 3
    assert {r.doc_id: (r.n_base, r.first_word) for r in license_rows(docs).collect()} == {1: (1, 900_000), 2: (1, 900_000), 3: (0, None)}
