"""Mixing: targets by repeated resharing, copies near the targets, SQL on the whole table."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

from check_queries import compare
from kgspark.llm.mixing import mix, source_targets, with_copies
from kgspark.llm.q02_mixing import SQL, op2_mixing


def reshared(sizes, most=3.0):
    """Targets by sharing the excess again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    stopped, total = set(), sum(sizes.values())
    while True:
        rest = total - sum(most * sizes[s] for s in stopped)
        open_weight = sum(weight[s] for s in order if s not in stopped)
        share = {s: most * sizes[s] if s in stopped else rest * weight[s] / open_weight for s in order}
        above = {s for s in order if s not in stopped and share[s] > most * sizes[s]}
        if not above:
            return share
        stopped |= above


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 900, "c": 5, None: 1, "d": 300}, {"a": 5}, {"a": 0, "b": 7}, {"a": 0},
                                   {"é": 1, "z": 1, "A": 500, None: 40}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, size long")
    found = {r.source: r.target for r in source_targets(df).collect()}
    assert found == pytest.approx(reshared(sizes))


def test_awkward_rows(spark, awkward):
    rows = with_copies(awkward).collect()
    assert len(rows) == awkward.count()
    for r in rows:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r.row.text or "")) and 0 <= r.copies <= 3
    mixed = mix(awkward)
    assert mixed.columns == awkward.columns and mixed.count() == sum(r.copies for r in rows)
    assert mix(awkward.limit(0)).count() == 0 and with_copies(awkward.limit(0)).count() == 0


def test_near_targets(spark):
    df = spark.range(20000).selectExpr("id AS doc_id", "repeat('w ', 1 + id % 9) AS text",
                                       "if(id % 3 = 0, 'hot', concat('s', id % 7)) AS source")
    per = with_copies(df).groupBy("row.source").agg(
        F.sum(F.col("size") * F.col("copies")).alias("taken"), F.max("target").alias("target")).collect()
    assert all(abs(r.taken - r.target) < 0.06 * r.target for r in per)


def test_op2_matches_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    df, cur = op2_mixing(spark, sf), con.execute(SQL)
    assert compare(df.columns, [tuple(r) for r in df.collect()], [c[0] for c in cur.description], cur.fetchall()) is None
