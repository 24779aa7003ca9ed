"""Exact dedup by composable polynomial fingerprints, confirmed by comparing texts chunk by chunk.

A text (A-Z lower-cased, null as empty) is cut into byte chunks. A chunk's fingerprint is its
polynomial in a fixed base modulo two primes; fingerprints of neighbouring chunks combine as
H(a + b) = H(a) * base^len(b) + H(b), so a term shifted by the bytes that follow can be computed
anywhere and only needs to be summed. Chunks of long texts are dealt out to all tasks; a text of
one chunk is hashed where it is read.

Rows whose fingerprint and length agree are compared with the row of the largest id among them,
chunk by chunk in a salted join, so that no task holds a group. Rows that differ (a collision)
form new groups and are compared again until none is left.

Null text is empty; a null id sorts below all others; rows that repeat id and text share every
decision and stay or go together, unless one row per document is asked for; an id repeated with
different texts is several documents. An empty table gives an empty result. Other columns are not
touched.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from kgspark.llm.common import LOWER, UPPER, ascii_lower, remaining
from kgspark.session import cut_lineage

PRIMES = (2147483647, 2147483629)
BASES = (1103515245, 1597334677)
CHUNK = 16384  # bytes; dot products of this length stay exact in double precision
_FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())
_TABLES: list[np.ndarray] = []


def _weights() -> np.ndarray:
    """Two rows of base powers, highest first, so that the last n entries fit a chunk of n bytes."""
    if not _TABLES:
        rows = []
        for base, prime in zip(BASES, PRIMES):
            powers = [1]
            for _ in range(CHUNK - 1):
                powers.append(powers[-1] * base % prime)
            rows.append(powers[::-1])
        _TABLES.append(np.array(rows, np.float64))
    return _TABLES[0]


def chunk_fingerprint(chunk: bytes) -> tuple[int, int]:
    """Polynomial fingerprints of at most CHUNK bytes; byte values count from 1."""
    if not chunk:
        return 0, 0
    terms = _weights()[:, CHUNK - len(chunk):] @ (np.frombuffer(chunk, np.uint8) + 1.0)
    return int(terms[0]) % PRIMES[0], int(terms[1]) % PRIMES[1]


def shifted(fingerprint: tuple[int, int], after: int) -> tuple[int, int]:
    """The term that a chunk adds to its text when ``after`` bytes follow it."""
    return tuple(h * pow(b, after, p) % p for h, b, p in zip(fingerprint, BASES, PRIMES))


def _hash_chunks(batches):
    for batch in batches:
        first, second = [], []
        for data, after in zip(batch.column("chunk").to_pylist(), batch.column("after").to_pylist()):
            a, b = shifted(chunk_fingerprint(data.translate(_FOLD)), after)
            first.append(a)
            second.append(b)
        keep = [batch.column(c) for c in ("row", "me", "n_bytes")]
        yield pa.RecordBatch.from_arrays([*keep, pa.array(first, pa.int64()), pa.array(second, pa.int64())],
                                         names=["row", "me", "n_bytes", "h1", "h2"])


_HASHED = "row long, me struct<key: long, sha: string>, n_bytes int, h1 long, h2 long"


def _chunks(data: Column) -> Column:
    """Array of (number, after, chunk) of a binary column; ``after`` counts the bytes that follow."""
    n = F.octet_length(data)
    starts = F.sequence(F.lit(0), F.greatest(F.ceil(n / CHUNK).cast("int") - 1, F.lit(0)))
    return F.transform(starts, lambda i: F.struct(
        i.alias("number"), F.greatest(n - (i + 1) * CHUNK, F.lit(0)).cast("long").alias("after"),
        F.substring(data, i * CHUNK + 1, F.lit(CHUNK)).alias("chunk")))


def identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(me, text): me is the id with the normalised text's SHA-256, text the normalised text."""
    text = ascii_lower(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    return (docs.select(F.col(id_col).cast("long").alias("key"), text.alias("text"))
            .select(F.struct("key", F.sha2("text", 256).alias("sha")).alias("me"), "text"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(me, n_bytes, h1, h2), one row per row of ``docs``."""
    rows = (identified(docs, id_col, text_col)
            .select(F.lit(0).cast("long").alias("row"), "me", F.octet_length("text").alias("n_bytes"),
                    F.encode("text", "UTF-8").alias("data")))
    short = (rows.where(F.col("n_bytes") <= CHUNK)
             .select("row", "me", "n_bytes", F.col("data").alias("chunk"), F.lit(0).cast("long").alias("after"))
             .mapInArrow(_hash_chunks, _HASHED).select("me", "n_bytes", "h1", "h2"))
    # the row number keeps the chunks of repeated rows apart
    long = (rows.where(F.col("n_bytes") > CHUNK).withColumn("row", F.monotonically_increasing_id())
            .select("row", "me", "n_bytes", F.explode(_chunks(F.col("data"))).alias("c"))
            .select("row", "me", "n_bytes", "c.chunk", "c.after")
            .repartition("row", "after").mapInArrow(_hash_chunks, _HASHED)
            .groupBy("row", "me", "n_bytes")
            .agg((F.sum("h1") % PRIMES[0]).alias("h1"), (F.sum("h2") % PRIMES[1]).alias("h2")).drop("row"))
    return short.unionByName(long)


def _differing(docs: DataFrame, members: DataFrame, id_col: str, text_col: str, per_salt: int) -> DataFrame:
    """Those of ``members`` (me, keep, size) whose text differs from that of their ``keep`` row."""
    salts = F.ceil(F.col("size") / per_salt).cast("int")
    texts = identified(docs, id_col, text_col).select("me", F.encode("text", "UTF-8").alias("data"))
    held = (members.join(texts, "me")
            .select("me", "keep", "size", F.explode(_chunks(F.col("data"))).alias("c"))
            .select("me", "keep", "size", "c.number", "c.chunk"))
    model = (held.where("me = keep").dropDuplicates(["keep", "number"])
             .select("keep", "number", F.col("chunk").alias("model"),
                     F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt")))
    others = held.where("me <> keep").withColumn("salt", F.pmod(F.xxhash64("me"), salts).cast("int"))
    return (others.join(model, ["keep", "number", "salt"], "left")
            .where("model IS NULL OR chunk <> model").select("me").distinct())


def exact_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  per_salt: int = 64, prints: DataFrame | None = None) -> DataFrame:
    """(me, keep, size), one row per document: the kept row of its class and the class size.

    ``prints`` replaces the fingerprints (me, n_bytes, h1, h2), as tests of collisions do.
    """
    prints = cut_lineage(prints if prints is not None else fingerprints(docs, id_col, text_col))
    label = ["n_bytes", "h1", "h2"]
    best = [F.max("me").alias("keep"), F.count("*").alias("size")]
    groups = cut_lineage(prints.groupBy(*label).agg(*best).where("size > 1"))
    open_rows = cut_lineage(prints.join(groups, label).select("me", "keep", "size", *label))
    settled = []
    while not open_rows.isEmpty():
        members = open_rows.select("me", "keep", "size").distinct()
        other = cut_lineage(_differing(docs, members, id_col, text_col, per_salt))
        if other.isEmpty():  # as always but for collisions: sizes stand as counted
            settled.append(members)
            break
        same = open_rows.join(other, "me", "left_anti").select("me", "keep")
        sizes = cut_lineage(same.groupBy("keep").agg(F.count("*").alias("size")))
        settled.append(same.distinct().join(sizes, "keep").select("me", "keep", "size"))
        rest = open_rows.join(other, "me", "left_semi").select("me", *label)
        regrouped = cut_lineage(rest.groupBy(*label).agg(*best))
        open_rows = cut_lineage(rest.join(regrouped, label).select("me", "keep", "size", *label))
    if not settled:
        return prints.select("me", F.col("me").alias("keep"), F.lit(1).cast("long").alias("size"))
    known = cut_lineage(reduce(DataFrame.unionByName, settled))
    return (prints.select("me").join(known, "me", "left")
            .select("me", F.coalesce("keep", "me").alias("keep"), F.coalesce("size", F.lit(1).cast("long")).alias("size")))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", one_row: bool = False) -> DataFrame:
    """The rows of ``docs`` that stay: of equal texts the one with the largest id, all columns as they are.

    Rows that share the largest id, or have none, all stay; with ``one_row`` the least of them by its columns.
    """
    marks = exact_classes(docs, id_col, text_col).where("size > 1").groupBy("me", "keep").agg(F.count("*").alias("times"))
    once = F.col("me") == F.col("keep")
    marks = cut_lineage(marks.where(~once | (F.col("times") > 1) if one_row else ~once)
                        .select(F.col("me").alias("of"), once.alias("once")))
    text = ascii_lower(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    me = F.struct(F.col(id_col).cast("long").alias("key"), F.sha2(text, 256).alias("sha"))
    return remaining(docs, me, marks)  # alike at every size
