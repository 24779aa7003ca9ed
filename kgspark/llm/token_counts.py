"""Token counts by byte-pair merging without identifiers.

A piece's symbols stand in a linked list; a heap holds its adjacent pairs by rank. The pair of
lowest rank, leftmost first, is merged until no pair has a rank: the count is the number of symbols
at the start less the merges. Distinct pieces are merged once (see ``pieces``). Special strings of
the tokenizer file count one token each, as the library does by default.

Null text is empty and counts 0. Ids, ties and repeated rows play no part: one row out per row in.
"""

from __future__ import annotations

import heapq
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kgspark.llm.pieces import PieceMemo, byte_level_starts


def byte_symbols() -> list[str]:
    """The printable stand-in of every byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table, spare = {b: chr(b) for b in shown}, 0x100
    for b in range(256):
        if b not in table:
            table[b], spare = chr(spare), spare + 1
    return [table[b] for b in range(256)]


def merge_count(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """Symbols left after all merges."""
    n = len(symbols)
    symbols, after, before = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(rank, i) for i in range(n - 1) if (rank := ranks.get((symbols[i], symbols[i + 1]))) is not None]
    heapq.heapify(heap)
    left = n
    while heap:
        rank, i = heapq.heappop(heap)
        j = after[i] if symbols[i] else n
        if j >= n or ranks.get((symbols[i], symbols[j])) != rank:
            continue  # one of the two has been merged since
        symbols[i] += symbols[j]
        symbols[j] = ""
        after[i] = k = after[j]
        left -= 1
        if k < n:
            before[k] = i
            if (rank := ranks.get((symbols[i], symbols[k]))) is not None:
                heapq.heappush(heap, (rank, i))
        h = before[i]
        if h >= 0 and (rank := ranks.get((symbols[h], symbols[i]))) is not None:
            heapq.heappush(heap, (rank, h))
    return left


class TokenCounter:
    """Counts tokens of texts under a byte-level BPE file of the tokenizers library."""

    def __init__(self, config: str):
        spec = json.loads(config)
        cut, model = spec["pre_tokenizer"], spec["model"]
        if (cut["type"], cut["add_prefix_space"], cut["use_regex"], model["type"], spec["normalizer"]) != (
                "ByteLevel", False, True, "BPE", None) or model.get("ignore_merges") or model.get("dropout"):
            raise ValueError("only plain byte-level BPE files are counted")
        special = [t["content"] for t in spec["added_tokens"]]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError("added tokens with options are not counted")
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.ranks = {tuple(pair): i for i, pair in enumerate(pairs)}
        self.symbols = byte_symbols()
        self.memo = PieceMemo(lambda pieces: [range(self.piece(p)) for p in pieces], byte_level_starts)
        self.memo._append = self._lengths_only

    def _lengths_only(self, lengths, ids):
        PieceMemo._append(self.memo, lengths, ids[:0])

    def piece(self, text: str) -> int:
        return merge_count([self.symbols[b] for b in text.encode()], self.ranks)

    def counts(self, texts: list[str]) -> list[int]:
        whole, extra = [], []
        for i, text in enumerate(texts):
            between = self.special.split(text) if self.special else [text]
            whole += [(i, part) for part in between]
            extra.append(len(between) - 1)
        found = self.memo.counts([part for _, part in whole]).tolist()
        for (i, _), n in zip(whole, found):
            extra[i] += n
        return extra


_COUNTERS: dict[int, TokenCounter] = {}


def _counter(config: str) -> TokenCounter:
    """One counter per worker process and file."""
    key = hash(config)
    if key not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[key] = TokenCounter(config)
    return _COUNTERS[key]


def count_tokens(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens) per row. The file is read on the driver and sent with the tasks (bounded)."""
    with open(tokenizer_file, encoding="utf-8") as f:
        config = f.read()

    def count(batches):
        counter = _counter(config)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("n_bytes"), pa.array(counter.counts(texts), pa.int64())],
                names=["id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return (docs.select(F.col(id_col).cast("long").alias("id"), F.octet_length(text).cast("long").alias("n_bytes"),
                        text.alias("text"))
            .mapInArrow(count, "id long, n_bytes long, n_tokens long"))
