"""Token ids as Arrow stream files of equal-length sequences.

Documents are dealt to parts by ranges of their id and sorted within each part, so that the parts in
order hold the corpus in ascending id order. A part is an Arrow IPC file whose record batches have
two fixed-size-list columns: ``ids`` (uint16 for vocabularies that fit, else uint32) and ``mask`` (one bit each, false on the padding of a
part's last sequence). Sequence i of a batch lies at i * length of the values buffer, so a memory
map gives it without a copy. The end id may also occur inside a text; a second file per part holds
each document's id, start within the part and length.

A task writes under a name of its own; the manifest, itself a written table, names the files of the
tasks that succeeded, so that a repeated or lost task leaves nothing behind that is read.

Null text is empty: such a document holds the end id alone. Null ids come first. Rows that repeat an
id follow each other by a hash of the text, so that many of them spread over parts. An empty table gives no parts and no rows.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, Window, functions as F
from pyspark import TaskContext

from kgspark.llm.common import shuffle_width, text_slices
from kgspark.llm.pieces import PieceMemo, byte_level_starts
from kgspark.session import checkpoint_dir, cut_lineage

SEQUENCE = 2048  # ids in a sequence
BATCH = 64  # sequences in a record batch
SLICE = 4 << 20  # bytes of text encoded at once


class LibraryEncoder:
    """Ids of the tokenizers library, each distinct piece encoded once."""

    def __init__(self, config: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_str(config)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.memo = PieceMemo(self._encode_pieces, byte_level_starts)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_pieces(self, pieces: list[str], together: int = 256) -> list[list[int]]:
        """Ids of pieces. Letters keep their cuts when joined by line ends, and so do letters after a space
        when just joined: the library gets many per call and tells by word numbers which ids are whose."""
        found: list = [None] * len(pieces)
        spaced = [i for i, p in enumerate(pieces) if p[0] == " " and p[1:].isalpha()]
        bare = [i for i, p in enumerate(pieces) if p.isalpha()]
        for members, joiner, step in ((spaced, "", 1), (bare, "\n", 2)):
            groups = [members[i:i + together] for i in range(0, len(members), together)]
            joined = [joiner.join([pieces[i] for i in group]) for group in groups]
            for group, e in zip(groups, self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)):
                ids, of = e.ids, np.array(e.word_ids)
                numbers = np.arange(len(group)) * step
                if of[-1] == numbers[-1]:
                    starts = np.searchsorted(of, numbers).tolist()
                    ends = np.searchsorted(of, numbers, side="right").tolist()
                    for i, start, end in zip(group, starts, ends):
                        found[i] = ids[start:end]
        rest = [i for i, ids in enumerate(found) if ids is None]
        for i, ids in zip(rest, self._encode([pieces[i] for i in rest])):
            found[i] = ids
        return found

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids in a row, ids of each text); texts with special strings go to the library whole."""
        odd = {i for i, t in enumerate(texts) if any(s in t for s in self.special)}
        flat, sizes = self.memo.ids([t for i, t in enumerate(texts) if i not in odd] if odd else texts)
        if not odd:
            return flat, sizes
        ends = np.cumsum(sizes)
        plain = iter(np.split(flat, ends[:-1]) if len(sizes) else [])
        marked = dict(zip(sorted(odd), self._encode([texts[i] for i in sorted(odd)])))
        rows = [np.array(marked[i], np.uint32) if i in marked else next(plain) for i in range(len(texts))]
        return np.concatenate(rows), np.array([len(r) for r in rows])


_ENCODERS: dict[int, LibraryEncoder] = {}


def library_encoder(config: str) -> LibraryEncoder:
    """One encoder per worker process and file."""
    key = hash(config)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = LibraryEncoder(config)
    return _ENCODERS[key]


def file_schema(length: int, kind) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.from_numpy_dtype(kind), length)), ("mask", pa.list_(pa.bool_(), length))])


DOCS_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


class SequenceWriter:
    """Cuts a run of ids into sequences and writes them batch by batch."""

    def __init__(self, sink, length: int, vocabulary: int):
        self.length, self.held, self.size, self.total = length, [], 0, 0
        self.kind = np.uint16 if vocabulary <= 1 << 16 else np.uint32
        self.schema = file_schema(length, self.kind)
        self.file = pa.ipc.new_file(sink, self.schema)

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids.astype(self.kind))
        self.size += len(ids)
        self.total += len(ids)
        if self.size >= self.length * BATCH:
            run = np.concatenate(self.held)
            whole = len(run) // (self.length * BATCH) * self.length * BATCH
            for at in range(0, whole, self.length * BATCH):
                self._batch(run[at:at + self.length * BATCH], np.ones(self.length * BATCH, bool))
            self.held, self.size = [run[whole:]], len(run) - whole

    def _batch(self, ids: np.ndarray, mask: np.ndarray) -> None:
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(v), self.length) for v in (ids, mask)]
        self.file.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))

    def close(self) -> None:
        if self.size:
            run = np.concatenate(self.held)
            pad = -len(run) % self.length
            self._batch(np.concatenate((run, np.zeros(pad, self.kind))), np.arange(len(run) + pad) < len(run))
        self.file.close()


def _open(uri: str):
    """(file system, path) of a file:, hdfs: or object store address, or of a plain path."""
    return pafs.FileSystem.from_uri(uri if ":/" in uri else f"file://{uri}")


def write_token_files(docs: DataFrame, tokenizer_file: str, end_id: int, folder: str | None = None,
                      id_col: str = "doc_id", text_col: str = "text", length: int = SEQUENCE,
                      encoder: Callable = library_encoder) -> DataFrame:
    """Write the files; returns the manifest (part, tokens_file, docs_file, n_docs, n_tokens, start)."""
    spark = docs.sparkSession
    folder = folder or f"{checkpoint_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    with open(tokenizer_file, encoding="utf-8") as f:
        config = f.read()

    def write(batches):
        batches = (b for b in batches if b.num_rows)
        batch = next(batches, None)
        if batch is None:
            return
        coder = encoder(config)
        part = TaskContext.get().partitionId()
        fs, root = _open(folder)
        fs.create_dir(root, recursive=True)
        stem = f"part-{part:06d}-{uuid.uuid4().hex}"
        with fs.open_output_stream(f"{root}/{stem}.tokens.arrow") as sink, \
                fs.open_output_stream(f"{root}/{stem}.docs.arrow") as index_sink:
            sequences, n_docs = SequenceWriter(sink, length, max(coder.tokenizer.get_vocab_size(), end_id + 1)), 0
            index = pa.ipc.new_file(index_sink, DOCS_SCHEMA)
            while batch is not None:
                for first, part_texts in text_slices(batch.column("text"), SLICE):
                    flat, sizes = coder.ids([t.decode() for t in part_texts])
                    flat = np.insert(flat, np.cumsum(sizes), np.uint32(end_id))  # the end id after each document
                    sizes = sizes + 1
                    index.write_batch(pa.RecordBatch.from_arrays(
                        [batch.column("id").slice(first, len(sizes)), pa.array(sequences.total + np.cumsum(sizes) - sizes),
                         pa.array(sizes)], schema=DOCS_SCHEMA))
                    sequences.add(flat)
                n_docs += batch.num_rows
                batch = next(batches, None)
            sequences.close()
            index.close()
        yield pa.RecordBatch.from_pydict({
            "part": [part], "tokens_file": [f"{folder}/{stem}.tokens.arrow"],
            "docs_file": [f"{folder}/{stem}.docs.arrow"], "n_docs": [n_docs], "n_tokens": [sequences.total]})

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = (docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"))
            .repartitionByRange(shuffle_width(spark), F.col("id").asc_nulls_first(), F.xxhash64("text"))
            .sortWithinPartitions(F.col("id").asc_nulls_first(), F.xxhash64("text"), "text"))
    manifest = cut_lineage(rows.mapInArrow(
        write, "part long, tokens_file string, docs_file string, n_docs long, n_tokens long"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per part
    return manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long"))


def _source(uri: str):
    """A local file as a memory map, another as a seekable input."""
    fs, path = _open(uri)
    return pa.memory_map(path) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(path)


class TokenFile:
    """Random access to one part's sequences, masks and ids."""

    def __init__(self, uri: str):
        self.reader = pa.ipc.open_file(_source(uri))
        self.length = self.reader.schema.field("ids").type.list_size

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, mask) of sequence i; the ids are a view of the file, the mask's bits are unpacked."""
        batch, row = self.reader.get_batch(i // BATCH), i % BATCH
        ids, mask = (batch.column(k).values.slice((batch.column(k).offset + row) * self.length, self.length) for k in (0, 1))
        return ids.to_numpy(), mask.to_numpy(zero_copy_only=False)

    def runs(self, start: int, n: int):
        """Views that hold ids start to start + n, batch by batch."""
        per = self.length * BATCH
        while n:
            values = self.reader.get_batch(start // per).column(0).values
            view = values.slice(start % per, min(n, per - start % per)).to_numpy()
            yield view
            start, n = start + len(view), n - len(view)


def _digest(batches):
    for batch in batches:
        for tokens_file, docs_file, base in zip(*(batch.column(c).to_pylist() for c in ("tokens_file", "docs_file", "start"))):
            tokens, index = TokenFile(tokens_file), pa.ipc.open_file(_source(docs_file))
            for k in range(index.num_record_batches):
                docs = index.get_batch(k)
                starts, sizes = docs.column("start").to_numpy(), docs.column("n_tokens").to_numpy()
                sums = []
                for start, n in zip(starts.tolist(), sizes.tolist()):
                    crc = 0
                    for view in tokens.runs(start, n):
                        crc = zlib.crc32(view.astype("<u4", copy=False), crc)
                    sums.append(crc)
                yield pa.RecordBatch.from_arrays(
                    [docs.column("doc_id"), pa.array(starts + base), docs.column("n_tokens"), pa.array(sums, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_documents(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files; one part per task."""
    parts = manifest.select("part", "tokens_file", "docs_file", "start")
    return (parts.repartition(shuffle_width(manifest.sparkSession), "part")
            .mapInArrow(_digest, "doc_id long, start long, n_tokens long, ids_crc32 long"))
