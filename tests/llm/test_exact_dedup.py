"""Exact dedup: fingerprints compose, collisions are told apart, awkward rows have defined results."""

import hashlib
import random
from collections import defaultdict

from pyspark.sql import functions as F

from kgspark.llm import exact_dedup as ed

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    """{(id, text digest): (largest id, rows)} of (id, text)."""
    groups = defaultdict(list)
    for key, text in rows:
        groups[(text or "").translate(FOLD)].append(key)
    out = []
    for key, text in rows:
        norm = (text or "").translate(FOLD)
        ids = groups[norm]
        best = max(ids, key=lambda k: (k is not None, k))
        out.append((key, best, len(ids), hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    return sorted(((r.me.key, r.keep.key, r["size"], r.me.sha) for r in df.collect()), key=repr)


def test_fingerprints_compose():
    rng = random.Random(1)
    data = rng.randbytes(3 * ed.CHUNK + 17)
    parts = [data[i:i + ed.CHUNK] for i in range(0, len(data), ed.CHUNK)]
    total = [0, 0]
    for i, part in enumerate(parts):
        for k, v in enumerate(ed.shifted(ed.chunk_fingerprint(part), sum(map(len, parts[i + 1:])))):
            total[k] = (total[k] + v) % ed.PRIMES[k]
    for k in range(2):
        value = 0
        for byte in data:
            value = (value * ed.BASES[k] + byte + 1) % ed.PRIMES[k]
        assert value == total[k]


def test_awkward_rows(spark):
    long = "Zeile ä\n" * 6000
    rows = [(1, "Hello"), (2, "hELLO"), (3, None), (4, ""), (5, "ÄB"), (6, "äb"), (7, long), (8, long.upper().replace("Ä", "ä")),
            (9, long + "x"), (10, "Äb"), (11, "hello "), (None, "hello"), (12, "twice"), (12, "twice"), (13, "one"), (13, "two"),
            (14, "two")] + [(100 + i, "copy") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("me", F.lit(1)).withColumn("size", F.lit("x"))
    assert found(ed.exact_classes(df, per_salt=16)) == brute(rows)
    kept = ed.exact_dedup(df)
    assert kept.columns == df.columns
    assert sorted(map(repr, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(
        repr(row) for row, (_, best, _, _) in zip(rows, [next(b for b in brute(rows) if b[0] == k and b[3] == hashlib.sha256(
            (t or "").translate(FOLD).encode()).hexdigest()) for k, t in rows]) if row[0] == best)


def test_collisions(spark):
    rows = [(1, "aa"), (2, "bb"), (3, "AA"), (4, "cc"), (5, "bb"), (6, "aa")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    same = ed.fingerprints(df).withColumn("h1", F.lit(0).cast("long")).withColumn("h2", F.lit(0).cast("long"))
    assert found(ed.exact_classes(df, prints=same)) == brute(rows)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert ed.exact_classes(df).count() == 0 and ed.exact_dedup(df).count() == 0


def test_one_row_of_copies_that_share_id_and_text(spark):
    rows = ([(12, "twice", "b"), (12, "twice", "a"), (12, "Twice", "a"), (3, "TWICE", "c"), (13, "one", "a"), (13, "two", "a")]
            + [(None, "none", "z")] * 300 + [(None, "other", None), (None, "other", "y"), (7, None, "a"), (7, "", "a")])
    df = spark.createDataFrame(rows, "doc_id long, text string, me string")
    want = [(12, "Twice", "a"), (13, "one", "a"), (13, "two", "a"), (None, "none", "z"), (None, "other", None), (7, None, "a")]
    kept = ed.exact_dedup(df, one_row=True)
    assert kept.columns == df.columns and sorted(map(repr, map(tuple, kept.collect()))) == sorted(map(repr, want))
    mapped = ed.exact_dedup(df.withColumn("bag", F.create_map(F.lit("k"), F.col("text"))), one_row=True)
    assert mapped.count() == len(want)
    assert ed.exact_dedup(df.limit(0), one_row=True).count() == 0
