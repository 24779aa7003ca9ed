"""Jaccard join against all pairs on small data, with large groups of near copies and chains."""

import random
import re

import duckdb
import numpy as np

from check_queries import compare
from kgspark.llm import jaccard_join as jj
from kgspark.llm.q08_jaccard_join import SQL, op8_jaccard_join

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    if not words:
        return set()
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)}


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders = {}
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    shared = {}
    for members in holders.values():
        for k, i in enumerate(members):
            for j in members[k + 1:]:
                shared[i, j] = shared.get((i, j), 0) + 1
    for (i, j), both in shared.items():
        if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
            parent[root(i)] = root(j)
    lowest = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            lowest[root(i)] = min(key, lowest.get(root(i), key))
    return sorted(repr((key, len(sets[i]), lowest.get(root(i)))) for i, (key, _) in enumerate(rows))


def found(df):
    return sorted(repr((r.id, r.n, r.comp_id)) for r in jj.jaccard_groups(df)[0].collect())


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "w%d" % rng.randrange(400)
    rows, key = [], 0
    passage = [word() for _ in range(30)]
    for _ in range(25):
        base = [word() for _ in range(rng.randrange(8, 120))]
        if rng.random() < 0.5:
            base[3:3] = passage
        for _ in range(rng.choice([1, 1, 2, 3, 12])):  # near copies around the limit, and chains of them
            copy = list(base)
            for _ in range(rng.randrange(0, 1 + len(copy) // 18)):
                copy[rng.randrange(len(copy))] = word()
            rows.append((key, " ".join(copy)))
            key += 1
            if rng.random() < 0.3:
                base = copy
    return rows


def test_all_pairs(spark):
    rows = corpus(2)
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_part_of_another(spark):
    """A text that is three quarters of another, whose own words come first in any order of rarity."""
    rng = random.Random(9)
    rows = []
    for k in range(12):
        words = ["c%d_%d" % (k, rng.randrange(10**6)) for _ in range(60 + 7 * k)]
        extra = ["e%d_%d" % (k, rng.randrange(10**6)) for _ in range(len(words) // 3 - rng.randrange(3))]
        rows += [(3 * k, " ".join(words)), (3 * k + 1, " ".join(words + extra)), (3 * k + 2, " ".join(extra + words))]
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_no_hub_rounds(spark, monkeypatch):
    """The exact step alone gives the same groups, and so do orders that know no heavy shingle."""
    rows = corpus(3)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(jj, "HUB_ROUNDS", 0)
    monkeypatch.setattr(jj._Join, "order", lambda self, s: (np.empty(0, np.uint64), np.empty(0, np.int64)))
    assert found(df) == brute(rows)


def test_awkward_rows(spark, awkward):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    assert found(awkward) == brute(rows)
    assert found(awkward.limit(0)) == []


def test_lists_over_batches():
    """Lists that go on from batch to batch lose no member and repeat none."""
    import pyarrow as pa
    for seed in range(6):
        rng = random.Random(seed)
        rows = sorted({(rng.randrange(30), rng.randrange(6)) for _ in range(70)})
        rows = sorted(rows + rows[::7])
        table = pa.table({"token": [t for t, _ in rows], "v": [v for _, v in rows], "np": [10 * v for _, v in rows], "last": [0] * len(rows)})
        lists = {}
        for t, v in set(rows):
            lists.setdefault(t, []).append(v)
        want = sorted((t, v, 10 * v, 0) for t, m in lists.items() if len(m) > 1 for v in m)
        for size in (1, 2, 3, 50):
            batches = table.to_batches(max_chunksize=size)
            assert sorted(r for b in jj._shared_lists(batches) for r in zip(*(c.to_pylist() for c in b.columns))) == want


def test_heavy_summary():
    rng = np.random.default_rng(1)
    stream = np.concatenate((rng.integers(0, 1000, 5000), np.full(900, 7))).astype(np.uint64)
    keys, counts = np.empty(0, np.uint64), np.empty(0, np.int64)
    for part in np.array_split(stream, 10):
        keys, counts = jj.heavy_merge(part, keys, counts, 50)
        assert len(keys) <= 50
    true = (stream == 7).sum()
    assert 7 in keys and true - len(stream) / 50 <= counts[keys == 7][0] <= true


def test_op8(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    df = op8_jaccard_join(spark, sf)
    got = [tuple(r) for r in df.collect()]
    assert sorted(map(repr, got)) == brute(rows)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    cur = con.execute(SQL)
    assert compare(df.columns, got, [c[0] for c in cur.description], cur.fetchall()) is None


def test_one_of_each_group_stays(spark, awkward):
    rows = corpus(5) + [(None, "x y z"), (9000, "x y z"), (9001, None), (9002, ""), (9003, "p q"), (9005, "r s"), (9004, "r s")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'m' AS comp", "1 AS print")
    kept = jj.keep_one_per_group(df)
    assert kept.columns == df.columns
    named = [eval(line) for line in brute(rows)]  # noqa: S307 - our own repr of tuples
    want = {}
    for (key, n, comp) in named:
        if n:
            want[comp] = min(want.get(comp, (key is None, key or 0)), (key is None, key or 0))
    got = kept.collect()
    assert len([r for r in got if r.text]) == len(want)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got if r.text) == sorted(want.values())
    assert len([r for r in got if not r.text]) == 2
    assert jj.keep_one_per_group(awkward.limit(0)).count() == 0


def test_one_row_of_copies_that_share_id_and_text(spark):
    rows = ([(1, "p q r", "b"), (1, "p q r", "a"), (2, "p q r", "a"), (3, "s t", "a"), (4, " ", "b"), (4, " ", "a"), (5, "", "a")]
            + [(None, "u v", "z")] * 300)
    df = spark.createDataFrame(rows, "doc_id long, text string, me string")
    want = [(1, "p q r", "a"), (3, "s t", "a"), (4, " ", "a"), (5, "", "a"), (None, "u v", "z")]
    assert sorted(map(repr, map(tuple, jj.keep_one_per_group(df).collect()))) == sorted(map(repr, want))


def test_lists_of_any_length_go_to_their_hub_first(spark, monkeypatch):
    """With every list counted as long and no hub rounds, all links still come out."""
    monkeypatch.setattr(jj, "LONG", 1)
    monkeypatch.setattr(jj, "HUB_ROUNDS", 0)
    rows = corpus(5)
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)
