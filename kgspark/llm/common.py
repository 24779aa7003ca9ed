"""Small helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from kgspark.session import cut_lineage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes that end a word of the regular expression [^\x20\x09-\x0D]+
BLANKS = bytes([0x20, *range(0x09, 0x0E)])


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case; every other character stays."""
    return F.translate(text, UPPER, LOWER)


def remaining(docs: DataFrame, me: Column, marks: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``marks`` (of, once) leaves, as they are; ``me`` is a row's name.

    Rows whose name is marked go, unless ``once`` holds: then one of them stays, the least by its columns
    in order. Tasks send one row per such name, so that no task holds all copies.
    """
    if marks.where("once").isEmpty():
        return docs.join(marks.select(F.col("of").alias("__dropped")).hint("merge"), me == F.col("__dropped"), "left_anti")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), me.alias("me"))
    kept = cut_lineage(rows.join(marks.hint("merge"), F.col("me") == F.col("of"), "left")
                       .where("once IS NULL OR once").select("row", "me", "once"))
    least = F.min("row")
    if any("map<" in kind for _, kind in docs.dtypes):  # maps have no order of their own
        least = F.min_by("row", F.struct(*[F.to_json(F.struct(f"row.`{c}`")) if "map<" in kind else F.col(f"row.`{c}`")
                                           for c, kind in docs.dtypes]))
    one = kept.where("once").groupBy("me").agg(least.alias("row"))
    return (kept.where("once IS NULL").select("row").unionByName(one.select("row"))
            .select([F.col(f"row.`{c}`").alias(c) for c in docs.columns]))


def shuffle_width(spark: SparkSession) -> int:
    """The cluster's own number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_slices(texts: pa.Array, limit: int = 4 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, UTF-8 texts) of at most ``limit`` bytes together, or of one longer text; null is empty.
    Only the slice at hand is held as Python values."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    first, held = 0, 0
    for i, size in enumerate([*sizes, limit + 1]):  # the last stands for the end
        if i > first and held + size > limit:
            yield first, [value or b"" for value in texts.slice(first, i - first).cast(pa.binary()).to_pylist()]
            first, held = i, 0
        held += size


def mix64(h: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values, so that sums and orders of them behave as random."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2^64
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of the base, and of its inverse, modulo 2^64."""
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(max(n, 1 << 10), base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS[0], _POWERS[1]


SHORT = 64  # symbols of a run up to which a polynomial modulo 2^64 tells runs apart; from 1024 on it need not


def run_hashes(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One 64-bit hash per run symbols[start:end]: of short runs a polynomial in the base, from running sums;
    of longer ones a hash of their bytes."""
    out = _short_hashes(symbols, starts, ends)
    for i in np.flatnonzero(ends - starts > SHORT).tolist():
        out[i] = xxhash.xxh3_64_intdigest(symbols[starts[i]:ends[i]].tobytes())
    return out


def _short_hashes(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    if not len(starts):
        return np.empty(0, np.uint64)
    n = len(symbols)
    up, down = _powers(n)
    terms = symbols.astype(np.uint64)
    terms += np.uint64(1)
    terms *= up[:n]
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(terms, out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


class Words:
    """Words of a slice of texts: the row and hash of each, in reading order."""

    def __init__(self, rows: list[bytes], separators: np.ndarray, piece: int = 1 << 20):
        """``separators``: 256 booleans; a word is a maximal run of other bytes."""
        joiner = bytes([int(np.flatnonzero(separators)[0])])
        data = np.frombuffer(joiner.join(rows) + joiner, np.uint8)
        bounds = np.cumsum([len(r) + 1 for r in rows])
        starts, hashes = [], []
        lo = 0
        while lo < len(data):
            hi = min(lo + piece, len(data))
            while not separators[data[hi - 1]]:  # a piece ends with a separator, as the data do
                more = np.flatnonzero(separators[data[hi:hi + piece]])
                hi = hi + int(more[0]) + 1 if len(more) else min(hi + piece, len(data))
            part = data[lo:hi]
            edge = np.diff(np.concatenate(([0], (~separators[part]).view(np.int8), [0])))
            begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            hashes.append(run_hashes(part, begin, end))
            starts.append(begin + lo)
            lo = hi
        self.hash = np.concatenate(hashes)
        self.count = np.diff(np.searchsorted(np.concatenate(starts), bounds), prepend=0)
        self.row = np.repeat(np.arange(len(rows)), self.count)
        self.first = np.cumsum(self.count) - self.count

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first word, hash) of every run of k words within one row."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        total = np.zeros(n, np.uint64)
        for j in range(k):
            total += self.hash[j:n + j] * _powers(k + 1)[0][j + 1]
        index = np.flatnonzero(self.row[:n] == self.row[k - 1:n + k - 1])
        return index, mix64(total[index])


def separator_table(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table
