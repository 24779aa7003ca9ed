"""Top-k search against all products: trees keep their invariants, ties, repeats and awkward rows."""

import math
import random

import duckdb
import numpy as np
from pyspark.sql import functions as F

from check_queries import compare
from kgspark.llm import topk_search as ts
from kgspark.llm.q10_topk_search import SQL, op10_topk_search


def brute(rows, k=5, every=50):
    """Every row but the query's own is a candidate, also one that shares its id."""
    known = [(key, [math.floor(256 * v) for v in x]) for key, x in rows
             if key is not None and x is not None and all(v is not None and math.isfinite(v) for v in x)]
    out = []
    for at, (q, x) in enumerate(known):
        if q % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(x, y)), i) for j, (i, y) in enumerate(known) if j != at)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    return sorted(out)


def found(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("x", F.lit(1)).withColumn("id", F.lit("c"))
    return sorted(map(tuple, ts.top_k(df, F.col("id") % 50 == 0, **options).collect()))


def test_tree():
    rng = np.random.default_rng(2)
    points = np.concatenate((rng.integers(-50, 50, (400, 5)), np.zeros((100, 5), np.int64)))
    tree = ts.CoverTree(np.arange(500), points, leaf=8)
    assert sorted(tree.order.tolist()) == list(range(500))

    def members(n):
        lo, hi = tree.children[n]
        return tree.order[slice(*tree.spans[n])] if hi == lo else np.concatenate([members(c) for c in range(lo, hi)])

    for n, (lo, hi) in enumerate(tree.children):
        away = np.linalg.norm(points[members(n)] - tree.center[n], axis=1)
        assert away.max() <= tree.radius[n] + 1e-9
        centers = tree.center[lo:hi]
        assert (tree.radius[lo:hi] <= tree.radius[n] / 2 + 1e-9).all()
        for i in range(len(centers)):
            for j in range(i):
                assert np.linalg.norm(centers[i] - centers[j]) > tree.radius[n] / 2


def test_dual_search():
    rng = np.random.default_rng(3)
    base = rng.integers(-200, 200, (30, 6))
    points = base[rng.integers(0, 30, 900)] + rng.integers(-9, 9, (900, 6))
    ids = rng.permutation(900)
    search = ts.Search(ts.CoverTree(ids[:300], points[:300], leaf=8), 5, np.full(300, -np.inf))
    for part in np.array_split(np.arange(900), 4):
        search.meet(ts.CoverTree(ids[part], points[part], leaf=8))
    want = []
    for q in range(300):
        scores = sorted((-int(points[q] @ points[j]), int(ids[j])) for j in range(900) if j != q)[:5]
        want += [(int(ids[q]), i, i, -s) for s, i in scores]
    assert sorted(search.rows()) == sorted(want)


def test_chunks_and_ties(spark, monkeypatch):
    monkeypatch.setattr(ts, "CHUNK", 40)
    monkeypatch.setattr(ts, "QUERY_CHUNK", 3)
    monkeypatch.setattr(ts, "PIVOTS", 5)
    rng = random.Random(5)
    rows = [(i, [rng.choice([-1.0, -0.5, 0.25, 1.0]) for _ in range(3)]) for i in range(500)] + [
        (1000 + i, [0.3, -0.2, 0.9]) for i in range(200)]
    rng.shuffle(rows)
    assert found(spark, rows) == brute(rows)


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (50, [0.5]), (1, None), (100, [nan, 1.0]), (2, [inf, 0.0]), (3, [None, 1.0]), (None, [1.0, 1.0]),
            (4, []), (5, [1e6, -1e6]), (150, [1e6, 1.0]), (6, [0.1, 0.2]), (6, [0.1, 0.2]), (7, [-3.0, 2.0]), (7, [3.0, 2.0])]
    assert found(spark, rows) == brute(rows)
    assert found(spark, rows[:1]) == [] and found(spark, []) == []
    rows = [(1, [1.0, 0.0]), (1, [5.0, 0.0]), (50, [1.0, 1.0]), (50, [1.0, 1.0]), (50, [2.0, 0.0])]
    assert found(spark, rows) == brute(rows) and found(spark, rows[:3]) == [(50, 1, 1, 327680), (50, 2, 1, 65536)]


def test_op10_matches_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    df, cur = op10_topk_search(spark, sf), con.execute(SQL)
    assert compare(df.columns, [tuple(r) for r in df.collect()], [c[0] for c in cur.description], cur.fetchall()) is None
