"""SentencePiece models on the tokenizers library.

The model file is a protobuf message; its pieces, scores, kinds and the trainer's and normaliser's
settings are read with a few lines of wire-format code. They are rebuilt as a normaliser (character
map, space handling, space mark), a model (unigram with the scores, or BPE with the merges the
scores imply) and a decoder (space mark, byte pieces). No piece of such a model reaches over the
start of a run of spaces, so texts are cut there and each distinct piece is encoded once, by the
library's multithreaded batch call; a model with other pieces is encoded text by text.

Null text is empty and has no ids; an empty table gives an empty result.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kgspark.llm.pieces import PieceMemo, metaspace_starts, parts

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)
UNIGRAM, BPE = 1, 2


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def message(data: bytes) -> dict[int, list]:
    """Fields of a protobuf message by number: integers, raw bytes or fixed-width bytes."""
    fields, at = {}, 0
    while at < len(data):
        key, at = _varint(data, at)
        number, kind = key >> 3, key & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            size, at = (8, at) if kind == 1 else (4, at) if kind == 5 else _varint(data, at)
            value, at = data[at:at + size], at + size
        fields.setdefault(number, []).append(value)
    return fields


class Model:
    """What a model file says: pieces as (text, score, kind) and the settings used here."""

    def __init__(self, data: bytes):
        top = message(data)
        self.pieces = []
        for raw in top.get(1, []):
            f = message(raw)
            score = struct.unpack("<f", f[2][0])[0] if 2 in f else 0.0
            self.pieces.append((f.get(1, [b""])[0].decode(), score, f.get(3, [NORMAL])[0]))
        trainer, normal = message(top.get(2, [b""])[0]), message(top.get(3, [b""])[0])
        self.kind = trainer.get(3, [UNIGRAM])[0]
        self.byte_fallback = bool(trainer.get(35, [0])[0])
        self.suffix = bool(trainer.get(24, [0])[0])
        self.charsmap = normal.get(2, [b""])[0]
        self.dummy_prefix = bool(normal.get(3, [1])[0])
        self.squeeze = bool(normal.get(4, [1])[0])
        self.escape = bool(normal.get(5, [1])[0])
        if self.kind not in (UNIGRAM, BPE) or self.suffix or not self.escape or any(k == USER for _, _, k in self.pieces):
            raise ValueError("only unigram and BPE models with a leading space mark and no user pieces are read")
        self.unknown = next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)
        # a piece with the mark after another sign would reach over a cut
        self.cuts = not any(a != MARK and b == MARK for text, _, _ in self.pieces for a, b in zip(text, text[1:]))


def merges_of(pieces: list[tuple[str, float, int]]) -> list[tuple[str, str]]:
    """Every way to build a normal piece from two others, better scores first."""
    ids = {text: i for i, (text, _, kind) in enumerate(pieces) if kind == NORMAL}
    found = []
    for text, i in ids.items():
        for cut in range(1, len(text)):
            left, right = ids.get(text[:cut]), ids.get(text[cut:])
            if left is not None and right is not None:
                found.append((-pieces[i][1], i, left, right))
    return [(pieces[left][0], pieces[right][0]) for _, _, left, right in sorted(found)]


def build_tokenizer(model: Model):
    """The model on the tokenizers library, for text as it is (spaces not yet marked)."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers

    if model.kind == UNIGRAM:
        backend = models.Unigram([(t, s) for t, s, _ in model.pieces], model.unknown, model.byte_fallback)
    else:
        backend = models.BPE({t: i for i, (t, _, _) in enumerate(model.pieces)}, merges_of(model.pieces),
                             unk_token=model.pieces[model.unknown][0], fuse_unk=True, byte_fallback=model.byte_fallback)
    tokenizer = Tokenizer(backend)
    tokenizer.normalizer = normalizers.Replace(" ", MARK)
    start = [decoders.Strip(content=" ", left=1, right=0)] if model.dummy_prefix else []
    tokenizer.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *start])
    whole = []
    if model.charsmap:
        whole.append(normalizers.Precompiled(model.charsmap))
    if model.squeeze:
        whole += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Replace(Regex("^ +| +$"), "")]
    return tokenizer, normalizers.Sequence(whole) if whole else None


class SentencePieceCodec:
    """Encodes and decodes texts; ``parity`` compares with the original library piece by piece."""

    def __init__(self, data: bytes, check: bool = False, by_piece: bool = True):
        self.model, self.by_piece = Model(data), by_piece
        self.tokenizer, self.normalizer = build_tokenizer(self.model)
        self.memo = PieceMemo(self._encode, metaspace_starts)
        self.original, self.differing = None, 0
        if check:
            import sentencepiece
            self.original = sentencepiece.SentencePieceProcessor(model_proto=data)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        if self.original and self.by_piece:  # the original adds the first space itself
            known = self.original.encode([t[1:] for t in texts] if self.model.dummy_prefix else texts, num_threads=1)
            self.differing += sum(a != b for a, b, t in zip(found, known, texts) if len(t) > 1 and t[0] in (" ", MARK))
        return found

    def normalize(self, text: str) -> str:
        text = self.normalizer.normalize_str(text) if self.normalizer else text
        return " " + text if self.model.dummy_prefix and text else text

    def shown(self, text: str) -> str:
        """What encoding and decoding makes of a text: normalised, with space marks shown as spaces."""
        return (self.normalizer.normalize_str(text) if self.normalizer else text).replace(MARK, " ")

    def as_original(self, texts: list[str], rows: list[np.ndarray], whole: int = 1 << 20) -> list[bool]:
        """Whether the original library gives each raw text the ids in ``rows``. It gets texts over ``whole``
        characters in parts, cut before single spaces, each of which it starts with a space mark of its own."""
        out = []
        for text, row in zip(texts, rows):
            if len(text) <= whole:
                out.append(self.original.encode(text) == row.tolist())
                continue
            at, same = 0, True
            for k, part in enumerate(part for held in parts([text], max(whole, 1)) for _, part in held):
                ids = self.original.encode(part[1:] if k and self.model.dummy_prefix else part)
                same = same and row[at:at + len(ids)].tolist() == ids
                at += len(ids)
            out.append(same and at == len(row))
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, ids of each text)."""
        texts = [self.normalize(t) for t in texts]
        if self.model.cuts:
            return self.memo.ids(texts)
        found = self._encode(texts)
        return np.array([i for one in found for i in one], np.uint32), np.array([len(one) for one in found])

    def decode(self, rows: list[list[int]]) -> list[str]:
        """Texts of lists of ids, as the original library gives them; unknown ids become \" \\u2047 \"."""
        return self.tokenizer.decode_batch(rows, skip_special_tokens=False)


_CODECS: dict[int, SentencePieceCodec] = {}


def codec(data: bytes, check: bool = False, by_piece: bool = True) -> SentencePieceCodec:
    """One codec per worker process and file."""
    key = hash((data, check, by_piece))
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = SentencePieceCodec(data, check, by_piece)
    return _CODECS[key]


def _model_bytes(model_file: str) -> bytes:
    with open(model_file, "rb") as f:
        return f.read()


def encode(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text",
           check: bool = False) -> DataFrame:
    """(id, ids array<int>, differing): ``differing`` counts new pieces unlike the original library's,
    at the batch that met them; it is 0 everywhere when both agree, and when ``check`` is off."""
    data = _model_bytes(model_file)

    def run(batches):
        coder = codec(data, check)
        for batch in batches:
            before = coder.differing
            flat, sizes = coder.encode(batch.column("text").to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()),
                                             pa.array(flat.astype(np.int32)))
            wrong = pa.array(np.full(batch.num_rows, coder.differing - before), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id"), lists, wrong], names=["id", "ids", "differing"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return (docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"))
            .mapInArrow(run, "id long, ids array<int>, differing long"))


def decode(encoded: DataFrame, model_file: str) -> DataFrame:
    """(id, text) of rows (id, ids)."""
    data = _model_bytes(model_file)

    def run(batches):
        coder = codec(data)
        for batch in batches:
            texts = coder.decode([ids or [] for ids in batch.column("ids").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string())], names=["id", "text"])

    return encoded.select("id", "ids").mapInArrow(run, "id long, text string")


def ids_crc32(ids: np.ndarray) -> int:
    """CRC-32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, "<u4"))
