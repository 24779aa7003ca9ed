"""Ingest, typed views, sinks and interval helpers."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F, types as T

from kgspark.functions import intervals
from kgspark.functions.props import bounded_list, build_props, prop, props_text, round_ratio
from kgspark.operators import views
from kgspark.plans import binding
from kgspark.sources import sinks
from kgspark.sources.ingest import (LinkSource, ObjectSource, edges_from_props, ingest_links,
                                    ingest_objects, tag_by_role)
from kgspark.sources.tables import read_json_records

D = dt.date
PEOPLE = T.StructType([T.StructField(n, t) for n, t in (
    ("ID", T.LongType()), ("NAME", T.StringType()), ("ROLE", T.StringType()), ("SLOT", T.StringType()),
    ("SINCE", T.StringType()))])


def write_people(tmp_path):
    rows = [{"ID": 1, "NAME": "A", "ROLE": "Worker", "SLOT": "left", "SINCE": "2001-02-03"},
            {"ID": 1, "NAME": "B", "ROLE": "boss", "SLOT": None, "SINCE": "soon"}]
    (tmp_path / "array.json").write_text(json.dumps(rows, indent=1))
    (tmp_path / "lines.json").write_text("\n".join(json.dumps(r) for r in rows))
    return rows


def test_json_arrays_and_lines_agree(spark, tmp_path):
    write_people(tmp_path)
    a = read_json_records(spark, str(tmp_path / "array.json"), PEOPLE, array_file=True)
    b = read_json_records(spark, str(tmp_path / "lines.json"), PEOPLE)
    assert sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)
    assert a.count() == 2


def test_role_decides_type_and_shape(spark, tmp_path):
    write_people(tmp_path)
    people = read_json_records(spark, str(tmp_path / "array.json"), PEOPLE, array_file=True)
    nodes = tag_by_role(people, F.col("ROLE"), {"WORKER": {"slot": F.col("SLOT")}, "BOSS": {"level": F.lit("top")}},
                        F.col("ID"), F.col("NAME"), F.try_to_timestamp("SINCE"))
    got = {r.node_id: (r.node_type, r.slot, r.level, r.ts_ingested) for r in nodes.select(
        "node_id", "node_type", prop("slot", "string").alias("slot"), prop("level", "string").alias("level"),
        "ts_ingested").collect()}
    assert got == {"WORKER:1": ("WORKER", "left", None, dt.datetime(2001, 2, 3)),
                   "BOSS:1": ("BOSS", None, "top", None)}  # a bad date is NULL, the job goes on


def test_mapped_objects_and_links(spark):
    rows = spark.createDataFrame([(1, "x", 5, "2000-01-01"), (2, "y", None, "junk")],
                                 "k bigint, n string, v int, d string")
    nodes = ingest_objects({"src": rows}, [
        ObjectSource("THING", "src", "k", "n", {"v": "v"}),
        ObjectSource("BIG", "src", "k", "n", where="v > 3")])
    assert sorted(r.node_id for r in nodes.collect()) == ["BIG:1", "THING:1", "THING:2"]
    typed = {r.node_id: r.v for r in views.entity_view(nodes, "THING", {"v": "int"}).collect()}
    assert typed == {"THING:1": 5, "THING:2": None}
    link = LinkSource("LINK", "src", "THING", "k", "BIG", "v", start="try_to_date(d)", where="v is not null")
    edges = ingest_links({"src": rows}, [link])
    assert [(r.src_id, r.dst_id, r.weight, r.effective_start, r.effective_end) for r in edges.collect()] == [
        ("THING:1", "BIG:5", 1.0, D(2000, 1, 1), None)]
    again = ingest_links({"src": rows}, [link])
    assert edges.first().edge_id == again.first().edge_id


def test_null_keys_are_left_out(spark):
    df = spark.createDataFrame([(1, None)], "a int, b int")
    row = df.select(F.to_json(build_props(a=F.col("a"), b=F.col("b"))).alias("v"),
                    props_text(a=F.col("a"), b=F.col("b")).alias("t")).first()
    assert row.v == '{"a":1}' and row.t == '{"a":1}'


def test_edges_from_props(spark):
    nodes = spark.createDataFrame([("ORDER:1", "ORDER", '{"d":"2000-01-01","x":4}'), ("ORDER:2", "ORDER", "{}")],
                                  "node_id string, node_type string, j string").select(
        "node_id", "node_type", F.parse_json("j").alias("props"))
    got = edges_from_props(nodes, "ORDER", {"LEAD": ("x", "L_"), "TAIL": ("y", "T_")}, "d", "SUPPLIER").collect()
    assert [(r.edge_id, r.src_id, r.edge_type, r.effective_start) for r in got] == [
        ("L_ORDER:1", "SUPPLIER:4", "LEAD", D(2000, 1, 1))]


def test_active_is_monotone_and_keeps_future_starts(spark):
    df = spark.createDataFrame([(1, D(2000, 1, 1), None), (2, D(2000, 1, 1), D(2000, 5, 1)), (3, D(2030, 1, 1), None)],
                               "i int, start_date date, end_date date")
    kept = [{r.i for r in df.where(intervals.active_as_of(day)).collect()}
            for day in (D(2000, 5, 1), D(2000, 5, 2), D(2040, 1, 1))]
    assert kept == [{1, 2, 3}, {1, 3}, {1, 3}]
    started = df.where(intervals.active_as_of(D(2001, 1, 1), require_started=True))
    assert [r.i for r in started.collect()] == [1]


def test_overlap_and_age(spark):
    df = spark.createDataFrame([(D(2000, 1, 1), None, D(2000, 2, 1), None),
                                (D(2000, 1, 1), D(2000, 3, 1), D(2000, 2, 1), None)],
                               "s1 date, e1 date, s2 date, e2 date")
    got = df.select(intervals.overlap_start(F.col("s1"), F.col("s2")).alias("s"),
                    intervals.overlap_end(F.col("e1"), F.col("e2")).alias("e"),
                    intervals.whole_years(F.col("s1"), D(2002, 12, 31)).alias("y")).collect()
    assert [(r.s, r.e, r.y) for r in got] == [(D(2000, 2, 1), None, 2), (D(2000, 2, 1), D(2000, 3, 1), 2)]


def test_small_aggregates(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "v string")
    assert df.agg(bounded_list("v").alias("l")).first().l == "a, b"
    assert df.where("v = 'z'").agg(bounded_list("v").alias("l")).first().l is None
    ratio = spark.createDataFrame([(1, 3), (1, 8), (201, 200)], "n bigint, d bigint").select(
        round_ratio(F.col("n"), F.col("d")).alias("r"))
    assert [r.r for r in ratio.collect()] == [0.33, 0.13, 1.01]


def test_refresh_replaces_one_rule(spark, tmp_path):
    path = str(tmp_path / "inferred")
    rows = spark.createDataFrame([("r1", "a"), ("r1", "b"), ("r2", "c")], "rule_id string, src_id string")
    sinks.write_inferred(rows, path)
    sinks.refresh_rule(rows, path, "r1")
    sinks.refresh_rule(rows, path, "r1")
    assert sorted(r.src_id for r in sinks.read_table(spark, path).collect()) == ["a", "b", "c"]
    sinks.refresh_rule(rows.where("rule_id = 'none'"), path, "r1")  # nothing inferred any more
    assert sorted(r.src_id for r in sinks.read_table(spark, path).collect()) == ["c"]
    violations = spark.createDataFrame([("c1", "x"), ("c2", "y")], "check_name string, src_id string")
    vpath = str(tmp_path / "violations")
    for _ in range(2):
        sinks.write_violations(violations, vpath, "run1", "c1")
    assert sinks.read_table(spark, vpath).count() == 1


def test_typed_tables_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, "x")], "k bigint, n string")
    nodes = ingest_objects({"s": rows}, [ObjectSource("A", "s", "k", "n", {"n": "n"}), ObjectSource("B", "s", "k", "n")])
    path = str(tmp_path / "nodes")
    sinks.write_nodes(nodes, path)
    sinks.write_nodes(nodes.where("node_type = 'A'"), path)  # replaces type A only
    back = sinks.read_table(spark, path)
    assert sorted(r.node_id for r in back.select("node_id").collect()) == ["A:1", "B:1"]
    assert back.where("node_type = 'A'").select(prop("n", "string").alias("n")).first().n == "x"


def test_publishing_replaces_one_part(spark, tmp_path):
    folder, schema = str(tmp_path / "inferred"), "rule_id string, src_id string"
    rows = spark.createDataFrame([("r1", "a"), ("r1", "b"), ("r2", "c")], schema)

    def now():
        return sorted(r.src_id for r in sinks.published(spark, folder, schema).collect())

    assert now() == []
    for _ in range(2):  # two runs into one folder give one set of rows
        for rule in ("r1", "r2"):
            sinks.publish(rows.where(F.col("rule_id") == rule), folder, rule)
        assert now() == ["a", "b", "c"]
    # a run that fails half way leaves the old rows readable
    broken = rows.where("rule_id = 'r1'").withColumn("src_id", F.expr("if(src_id = 'b', raise_error('lost'), src_id)"))
    with pytest.raises(Exception, match="lost"):
        sinks.publish(broken, folder, "r1")
    assert now() == ["a", "b", "c"]
    sinks.publish(rows.where("rule_id = 'none'"), folder, "r1")  # nothing inferred any more
    assert now() == ["c"] and sinks.manifest(spark, folder).where("part = 'r1'").count() == 3


def test_arrays_read_in_parts(spark, tmp_path):
    """Arrays cut at every brace and at block borders, with nested objects, braces and escaped quotes in strings."""
    from kgspark.sources import json_arrays
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("s", T.StringType()),
                           T.StructField("n", T.StructType([T.StructField("x", T.LongType())])), T.StructField("l", T.ArrayType(T.LongType()))])
    texts = ["plain", "} {", 'quote " } and \\', "é語 }}", "", "{\"k\": 1}", "],["]
    rows = [{"k": i, "s": texts[i % len(texts)], "n": {"x": i * 2}, "l": [i, i + 1]} for i in range(700)]
    folder = tmp_path / "arrays"
    folder.mkdir()
    (folder / "a.json").write_text(json.dumps(rows[:400], indent=1, ensure_ascii=False))
    (folder / "b.json").write_text(json.dumps(rows[400:], separators=(",", ":")))
    (folder / "c.json").write_text("[]\n")
    (folder / "d.json").write_text("")
    (folder / "e.json").write_text('[{"k": 1000, "s": "last"}, {"k": "no number", "s": "x"}, {"k": null, "s": "y"}, {"k" 3}, {"k": 4, "s": "cut')
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        records = json_arrays.array_records(spark, str(folder))
        loaded, rejected = json_arrays.load_records(records, schema, ("k",))
        got = {r.k: r.asDict(True) for r in loaded.collect()}
        bad = sorted((r.reason, r.record) for r in rejected.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got.pop(1000)["s"] == "last" and [got[i] for i in range(700)] == rows and len(got) == 700
    assert [b[0] for b in bad] == ["MALFORMED", "MALFORMED", "MALFORMED", "MISSING k"] and bad[-1][1] == '{"k": null, "s": "y"}'


def test_lead_and_tail_edges_share_their_shuffle(spark):
    lines = spark.createDataFrame([(1, 7, 3), (1, 8, 9), (2, 7, 4), (3, None, 5)], "order_key bigint, supp_key bigint, cents bigint")
    sides = lines.groupBy("order_key").agg(F.min_by(F.struct("supp_key", "cents"), "cents").alias("x"),
                                           F.max_by(F.struct("supp_key", "cents"), "cents").alias("y")).select(
        "order_key", F.lit(dt.date(2000, 1, 1)).alias("order_date"), F.col("x.supp_key").alias("lead_key"), F.col("x.cents").alias("lead_cents"),
        F.col("y.supp_key").alias("tail_key"), F.col("y.cents").alias("tail_cents"))
    specs = [s for s in binding.LINK_SOURCES if s.source == "order_sides"]
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # its plans show reuse only after a run
    try:
        edges = ingest_links({"order_sides": binding.sides_in_rows(sides)}, specs)
        plan = edges._jdf.queryExecution().executedPlan().toString()
        found = {(r.edge_type, r.src_id, r.dst_id, r.value) for r in edges.select(
            "edge_type", "src_id", "dst_id", prop("value", "double").alias("value")).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert plan.count("ReusedExchange") == 1
    want = {("LEAD_SUPPLIER", 7, 1, 0.03), ("TAIL_SUPPLIER", 8, 1, 0.09), ("LEAD_SUPPLIER", 7, 2, 0.04), ("TAIL_SUPPLIER", 7, 2, 0.04)}
    assert {x for x in found if x[2] != "ORDER:3"} == {(k, f"SUPPLIER:{s}", f"ORDER:{o}", v) for k, s, o, v in want}
    assert {x[0] for x in found if x[2] == "ORDER:3"} == {"LEAD_SUPPLIER", "TAIL_SUPPLIER"}
