"""Byte-pair encoding with word ends, by walks through a trie of distinct words, and decoding.

The encoding of a word's prefix ends in one token, and what stands before that token is again the
encoding of a prefix. So a prefix needs no more than its last token: of the tokens that end there, the
one that stays apart from the last token of the prefix before it. Distinct words are put in order and
walked depth first as a trie whose nodes are their prefixes: going down finds a node's last token, going
back up forgets it, and words that share a prefix share its nodes. A word's last symbol carries the
word-end mark and is an edge of its own.

Two tokens stay apart when merging their text alone gives just them. That is read off the merges: going
back in time, the pair that meets at the border must never have had a merge due before one of the two
was used up. It holds for files whose every token has one merge, later than those of its two parts; other
files are refused.

Texts are normalised and cut into words as the file says: Latin texts here, others by the library's own
normaliser and splitter. Special strings in a text are one token each. Decoding joins token strings by a
space, as the library does for a file without decoder.

Null text is empty and has no tokens. Ids, ties and repeated rows play no part: one row out per row in.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from kgspark.llm.common import text_slices
from kgspark.llm.token_counts import byte_symbols

KNOWN_WORDS = 400_000  # distinct words a worker remembers
PART = 1 << 20  # characters of one text handled at once
SLICE = 1 << 20  # bytes of text handled at once
NEVER = 1 << 62
#: Characters that normalisers and splitters of any version treat alike: Latin, without the odd spaces and U+0130
_OTHER = re.compile("[^\x00-\x1b\x20-\x84\x86-įı-ɏ]")


class TrieEncoder:
    """Ids of words under a BPE file of the tokenizers library with a word-end mark."""

    def __init__(self, config: str):
        from tokenizers import Regex, Tokenizer, pre_tokenizers
        spec = json.loads(config)
        model, added = spec["model"], spec["added_tokens"]
        steps = [s["type"] for s in (spec["normalizer"] or {}).get("normalizers", [])]
        cuts = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        if (model["type"], steps, [c.get("type") for c in cuts], spec["decoder"]) != (
                "BPE", ["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"], None) or not model["end_of_word_suffix"] \
                or model.get("ignore_merges") or model.get("dropout") or model.get("continuing_subword_prefix"):
            raise ValueError("only lower-casing BPE files with word ends and no decoder are encoded")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
            raise ValueError("added tokens with options are not encoded")
        pattern = cuts[0]["pattern"]["Regex"]
        self.words = regex.compile(pattern)
        self.split = pre_tokenizers.Split(Regex(pattern), "removed", invert=True)
        self.normalizer = Tokenizer.from_str(config).normalizer
        self.symbols = byte_symbols()
        self.special = {t["content"]: t["id"] for t in added}
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if added else None
        self._read_merges(model)
        self.shown = {i: t.encode() for t, i in [*model["vocab"].items(), *self.special.items()]}
        self._forget()

    def _read_merges(self, model: dict) -> None:
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        self.rank, self.made = {}, {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            a, b, whole = vocab[left], vocab[right], vocab[left + right]
            if whole in self.made or any(vocab[t] not in self.made and len(t.removesuffix(end)) > 1 for t in (left, right)):
                raise ValueError("a token needs one merge, later than those of its parts")
            self.rank[a, b], self.made[whole] = rank, (rank, a, b)
        sound = {i for i in vocab.values() if i not in self.made}  # tokens that their own text gives, parts first
        for whole, (_, a, b) in self.made.items():
            if a in sound and b in sound and self._apart(a, b, True):
                sound.add(whole)
        self.inner = {t: i for t, i in vocab.items() if i in sound and not t.endswith(end)}
        self.ending = {t.removesuffix(end): i for t, i in vocab.items() if i in sound and t.endswith(end)}
        self.size = {i: len(t) for d in (self.inner, self.ending) for t, i in d.items()}
        if any(s not in d for s in self.symbols for d in (self.inner, self.ending)):
            raise ValueError("every byte needs a token")
        self.longest = max(map(len, self.inner)), max(map(len, self.ending))
        self.apart: dict[tuple[int, int], bool] = {}

    def _apart(self, a: int, b: int, joining: bool = False) -> bool:
        """Whether no merge crosses the border of a and b (but for a merge of both as they are, if ``joining``)."""
        used_a = used_b = NEVER  # when the part at the border goes into a larger one
        while True:
            due = self.rank.get((a, b), NEVER)
            # among merges of one rank the leftmost comes first: that within the left token, then the crossing one
            if due < used_a and due <= used_b and not (joining and used_a == used_b == NEVER):
                return False
            made_a, made_b = self.made.get(a), self.made.get(b)
            if made_a is None and made_b is None:
                return True
            if made_b is None or made_a is not None and made_a[0] > made_b[0]:
                used_a, a = made_a[0], made_a[2]
            else:
                used_b, b = made_b[0], made_b[1]

    def _last(self, word: str, i: int, tokens: dict, longest: int, last: list) -> int:
        """The last token of the prefix of i symbols, whose shorter prefixes are known."""
        apart = self.apart
        for k in range(max(0, i - longest), i):
            token = tokens.get(word[k:i])
            if token is None:
                continue
            if not k:
                return token
            pair = last[k], token
            fits = apart.get(pair)
            if fits is None:
                if len(apart) > KNOWN_WORDS:
                    apart.clear()
                fits = apart[pair] = self._apart(*pair)
            if fits:
                return token
        raise AssertionError("every prefix has an encoding")

    def walk(self, words: list[str]) -> Iterator[list[int]]:
        """Ids of words in sorted order, given as byte symbols."""
        before, last, known = "", [0], 0  # last[i]: last token of the prefix of i symbols of the word before, to i = known
        for word in words:
            n, shared, limit = len(word), 0, min(known, len(word))
            while shared < limit and word[shared] == before[shared]:
                shared += 1
            del last[shared + 1:]
            for i in range(shared + 1, n):
                last.append(self._last(word, i, self.inner, self.longest[0], last))
            token = self._last(word, n, self.ending, self.longest[1], last)
            ids, i = [token], n - self.size[token]
            while i:
                ids.append(last[i])
                i -= self.size[last[i]]
            yield ids[::-1]
            before, known = word, max(n - 1, shared)

    def _forget(self) -> None:
        self.slot = {s: k for k, s in enumerate(self.special)}
        self.count = np.ones(max(len(self.slot), 1 << 12), np.int64)
        self.begin = np.arange(len(self.count))
        self.flat = np.zeros(1 << 14, np.int32)
        self.flat[:len(self.slot)] = list(self.special.values())
        self.used = len(self.slot)

    def _learn(self, words: set[str]) -> None:
        """Encode new distinct words in one walk and remember them."""
        table = self.symbols
        shown = sorted(("".join([table[b] for b in w.encode()]), w) for w in words)
        for (_, word), ids in zip(shown, self.walk([s for s, _ in shown])):
            at, end = len(self.slot), self.used + len(ids)
            if at >= len(self.count):
                self.count, self.begin = np.resize(self.count, 2 * at), np.resize(self.begin, 2 * at)
            if end > len(self.flat):
                self.flat = np.resize(self.flat, 2 * end)
            self.slot[word], self.count[at], self.begin[at] = at, len(ids), self.used
            self.flat[self.used:end] = ids
            self.used = end

    def pieces(self, text: str) -> list[str]:
        """Words and special strings of a text in order."""
        found = []
        for part in self.at_special.split(text) if self.at_special else [text]:
            if part in self.special:
                found.append(part)
            elif _OTHER.search(part):
                found += [w for w, _ in self.split.pre_tokenize_str(self.normalizer.normalize_str(part))]
            else:
                found += self.words.findall(part.lower())
        return found

    def _ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of pieces in a row, ids of each piece)."""
        new = set(pieces) - self.slot.keys()
        if len(self.slot) + len(new) > KNOWN_WORDS:
            self._forget()
            new = set(pieces) - self.slot.keys()
        self._learn(new)
        slots = np.fromiter(map(self.slot.__getitem__, pieces), np.int64, len(pieces))
        lengths = self.count[slots]
        shift = self.begin[slots] - (np.cumsum(lengths) - lengths)
        return self.flat[np.repeat(shift, lengths) + np.arange(lengths.sum())], lengths

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text; a long one goes in parts that end before a space, where a word ends."""
        out, at = [np.empty(0, np.int32)], 0
        while at < len(text):
            end = text.find(" ", at + PART)
            end = end if end > 0 else len(text)
            out.append(self._ids(self.pieces(text[at:end]))[0])
            at = end
        return np.concatenate(out)

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts, the distinct words of all met in one walk."""
        if max(map(len, texts), default=0) > PART:
            return [self.encode(t) for t in texts]
        pieces = [self.pieces(t) for t in texts]
        flat, lengths = self._ids([w for found in pieces for w in found])
        ends = np.concatenate(([0], np.cumsum(lengths)))[np.cumsum([len(found) for found in pieces])]
        return np.split(flat, ends[:-1])

    def decode(self, ids: np.ndarray) -> bytes:
        return b" ".join(map(self.shown.__getitem__, ids.tolist()))


_ENCODERS: dict[int, TrieEncoder] = {}


def trie_encoder(config: str) -> TrieEncoder:
    """One encoder per worker process and file."""
    key = hash(config)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = TrieEncoder(config)
    return _ENCODERS[key]


def encode_and_decode(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, decoded) per row. The file is read on the driver and sent with the tasks (bounded)."""
    with open(tokenizer_file, encoding="utf-8") as f:
        config = f.read()

    def work(batches):
        coder = trie_encoder(config)
        for batch in batches:
            for first, rows in text_slices(batch.column("text"), SLICE):
                found = coder.encode_batch([r.decode() for r in rows])
                ends = np.cumsum([0, *map(len, found)])
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(found), pa.int32()))
                decoded = pa.array([coder.decode(f) for f in found], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(first, len(rows)), ids, decoded],
                                                 names=["id", "ids", "decoded"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(work, "id long, ids array<int>, decoded string")
