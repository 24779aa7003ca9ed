"""Rows dealt by their count: the same answers, and no step of a history left to a fixed number of tasks."""

import datetime as dt
import random
import re

import pytest

from pyspark.sql import functions as F

from kgspark.operators import inference as inf, moves
from kgspark.operators.semantic import SemanticModel
from kgspark.plans import binding as b, load_queries, metadata as md
from kgspark.session import cut_lineage
from kgspark.sources.tables import Tables

SCHEMA = "part_key bigint, supp_key bigint, start_date date, end_date date"
MANY = 20_000_000  # 41 tasks, and 81 for twice as many


def tenures(spark):
    rng = random.Random(5)
    day = lambda n: dt.date(2000, 1, 1) + dt.timedelta(n)
    rows = []
    for part in range(12):
        for supp in rng.sample(range(6), rng.randint(1, 6)):
            start = rng.randint(0, 30)
            rows.append((part, supp, day(start), None if rng.random() < 0.3 else day(start + rng.randint(0, 9))))
    return spark.createDataFrame([*rows, (None, 3, day(4), day(5)), (7, 9, None, None)], SCHEMA)


@pytest.fixture
def folder(spark, tmp_path):
    """Small tables of our own; joins are planned as for tables too large to broadcast."""
    rng = random.Random(9)
    day = lambda n: dt.datetime(1999, 1, 1) + dt.timedelta(n)
    frames = {
        "region": ([(0, "R0"), (1, "R1")], "r_regionkey bigint, r_name string"),
        "nation": ([(n, f"N{n}", n % 2) for n in range(3)], "n_nationkey bigint, n_name string, n_regionkey bigint"),
        "supplier": ([(s, f"S{s}", s % 3, 1.0) for s in range(8)], "s_suppkey bigint, s_name string, s_nationkey bigint, s_acctbal double"),
        "customer": ([(c, f"C{c}", c % 3, "A", 1.0) for c in range(6)],
                     "c_custkey bigint, c_name string, c_nationkey bigint, c_mktsegment string, c_acctbal double"),
        "part": ([(p, f"P{p}", f"B{p % 2}", "T", 1, 2.0) for p in range(10)],
                 "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"),
        "orders": ([(o, rng.randrange(6), day(rng.randrange(900)), "1-URGENT", "F", 5.0) for o in range(60)],
                   "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp, o_orderpriority string, o_orderstatus string, o_totalprice double"),
        "lineitem": ([(rng.randrange(60), rng.randrange(10), rng.randrange(8), i, 3.0, 10.25, day(rng.randrange(1100)), rng.choice("RAN"))
                      for i in range(240)],
                     "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, "
                     "l_shipdate timestamp, l_returnflag string"),
    }
    for name, (rows, schema) in frames.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield str(tmp_path)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def undealt(t, name, *keys):
    """Exchanges of the query's plan by one of the keys that take the fixed number of shuffle partitions."""
    t.counts["lineitem"] = MANY
    plan = load_queries()[name].build(t)._jdf.queryExecution().executedPlan().toString()
    found = re.findall(r"Exchange hashpartitioning\((.*?), (\d+)\), (\w+)", plan)
    assert any(int(n) > 40 for _, n, _ in found)
    return [(by, n) for by, n, _ in found if int(n) < 41 and any(k in by for k in keys)]


def same(one, two):
    key = lambda r: [(v is not None, str(v)) for v in r]
    return sorted(map(tuple, one.collect()), key=key) == sorted(map(tuple, two.collect()), key=key)


def test_successors_dealt(spark):
    df = tenures(spark)
    assert same(moves.successors(df, "supp_key", "part_key", MANY), moves.successors(df, "supp_key", "part_key"))


def test_moves_dealt(spark):
    df = tenures(spark)
    assert same(moves.consecutive_moves(df, ["part_key"], "supp_key", MANY), moves.consecutive_moves(df, ["part_key"], "supp_key"))


def test_distinct_counts_apart(spark):
    """Values shared between groups, nulls, groups of nulls only; with and without dimensions and the row count."""
    rows = [("a", 1, "x", 5), ("a", 1, "y", 5), ("b", 1, None, 2), ("b", None, "x", 1), ("c", None, None, 4), (None, 2, "x", 3)]
    fact = spark.createDataFrame(rows, "kind string, number int, name string, amount bigint")

    def answer(known, dims):
        m = SemanticModel(tables={"fact": fact}, rows=known)
        m.add_metric("total", "fact", F.sum("amount"))
        m.add_distinct("numbers", "fact", "number")
        m.add_distinct("names", "fact", "name")
        out = m.query(["numbers", "total", "names"], dims)
        return out.columns, sorted(map(tuple, out.collect()), key=str)

    want = sorted([("a", 1, 10, 2), ("b", 1, 3, 1), ("c", 0, 4, 0), (None, 1, 3, 1)], key=str)
    for known in ({}, {"fact": MANY}):
        assert answer(known, ["fact.kind"]) == (["kind", "numbers", "total", "names"], want)
        assert answer(known, []) == (["numbers", "total", "names"], [(2, 20, 2)])


@pytest.mark.parametrize("name, keys", [
    ("party_moves", ["party_key"]), ("most_traveled", ["l_orderkey", "cust_key", "l_partkey"]),
    ("tenure_stability", ["party_key", "order_key", "cust_key", "l_partkey"]),
    ("semantic_metrics_concrete", ["order_key", "order_count", "part_count", "l_partkey"])])
def test_named_queries_are_dealt_by_rows(spark, folder, name, keys):
    assert undealt(Tables(spark, folder), name, *keys) == []


def test_customer_succession_is_dealt_by_rows(spark, folder):
    assert undealt(Tables(spark, folder), "customer_succession", "key", "day", "date") == []


def test_updated_inference_with_and_without_rows(spark):
    """Rows of rules that are not transitive pass the update by, whatever sources the change is near."""
    schema = "src_id string, dst_id string, edge_type string, weight double, effective_start date, effective_end date"
    edge = lambda a, b, kind: (a, b, kind, 1.0, None, None)
    edges = spark.createDataFrame([edge("P1", "S1", "SUPPLIED_BY"), edge("P1", "S1", "SUPPLIED_BY"), edge("P2", "S1", "SUPPLIED_BY"),
                                   edge("C1", "S1", "BUYS_FROM"), edge("S1", "N1", "WITHIN"), edge("C1", "N1", "WITHIN"),
                                   edge("N1", "R1", "WITHIN"), edge("P1", "O1", "IN_ORDER"), edge("S1", "O1", "LEAD_SUPPLIER")], schema)
    added = spark.createDataFrame([edge("R1", "W", "WITHIN"), edge("S1", "N2", "WITHIN")], schema)
    removed = spark.createDataFrame([edge("P2", "S1", "SUPPLIED_BY"), edge("P1", "S1", "SUPPLIED_BY")], schema)
    read = inf.relations_read(md.RULES, md.RELATION_MAP)
    assert read == {"SUPPLIED_BY", "BUYS_FROM", "WITHIN"}
    state = inf.supported(edges, md.RULES, md.RELATION_MAP)
    after = inf.update_supported(state, edges, added, removed, md.RULES, md.RELATION_MAP)
    kept = edges.where(F.col("edge_type").isin(*read))
    dealt_state = inf.supported(kept, md.RULES, md.RELATION_MAP, rows=MANY)
    assert same(state, dealt_state)
    assert same(after, inf.update_supported(dealt_state, kept, added, removed, md.RULES, md.RELATION_MAP, rows=MANY))
    now = edges.exceptAll(removed).unionByName(added)
    assert same(after, inf.supported(now, md.RULES, md.RELATION_MAP))


def test_edges_meet_their_orders_in_place(spark, folder):
    """What is grouped per order is dealt by order once: neither it nor the orders are moved again to find the date."""
    t = Tables(spark, folder)
    t.counts["lineitem"] = MANY
    plan = b.kg_edges(t)._jdf.queryExecution().executedPlan().toString()
    lines = re.findall(r"Exchange hashpartitioning\((.*?), (\d+)\), (\w+)", plan)
    by_order = [(by, n, why) for by, n, why in lines if "order_key" in by or "orderkey" in by]
    assert by_order and all(why == "REPARTITION_BY_NUM" and int(n) > 40 for _, n, why in by_order)
    assert not any("supp" in by or "part" in by for by, _, _ in by_order)


def test_written_steps_leave_no_shuffles(spark, tmp_path):
    """A step's shuffle files go once its table stands, and the setting is as before."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    tracker = spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    held = lambda: tracker.shuffleStatuses().size()
    count = held()
    df = spark.range(1000).repartition(5, "id").groupBy((F.col("id") % 7).alias("g")).count()
    assert cut_lineage(df).count() == 7 and spark.conf.get(key) == before
    spark.range(10).count()
    assert cut_lineage(df.where("g > 3")).collect() and held() <= count + 2  # the counts and the read have their own
