"""Closure, inference, checks and abstract views on a small awkward graph."""

import datetime as dt

import pytest

from kgspark.operators import ontology as ont, quality as q
from kgspark.operators.closure import closure, reflexive_closure
from kgspark.operators.inference import (Rule, infer_all, infer_inverse, infer_property_chain, infer_transitive,
                                         ordered_rules, run_inference, summarise)
from kgspark.plans import metadata as md

D = dt.date
EDGE_SCHEMA = ("edge_type string, src_id string, dst_id string, weight double, "
               "effective_start date, effective_end date")
EDGES = [
    ("SUPPLIED_BY", "PART:1", "SUPPLIER:1", 1.0, D(2000, 1, 1), None),
    ("SUPPLIED_BY", "PART:1", "SUPPLIER:2", 1.0, D(2000, 1, 1), D(2000, 6, 1)),
    ("SUPPLIED_BY", "PART:2", "SUPPLIER:1", 2.0, D(2030, 1, 1), None),        # starts later
    ("SUPPLIED_BY", "PART:2", "SUPPLIER:9", 1.0, D(2000, 1, 1), None),        # no such supplier
    ("BUYS_FROM", "CUSTOMER:1", "SUPPLIER:1", 1.0, D(2000, 1, 1), D(2001, 1, 1)),
    ("IN_ORDER", "PART:8", "ORDER:1", 1.0, D(2000, 1, 1), D(2000, 1, 1)),     # no such part
    ("LEAD_SUPPLIER", "SUPPLIER:1", "ORDER:1", 1.0, None, None),
    ("LEAD_SUPPLIER", "SUPPLIER:2", "ORDER:1", 1.0, None, None),              # a second lead
    ("WITHIN", "SUPPLIER:1", "NATION:1", 1.0, None, None),
    ("WITHIN", "NATION:1", "REGION:1", 1.0, None, None),
    ("WITHIN", "REGION:1", "REGION:1", 1.0, None, None),                      # a self-loop
    ("WITHIN", "PART:1", "SUPPLIER:1", 1.0, None, None),                      # out of range
]
NODES = ["PART:1", "PART:2", "CUSTOMER:1", "SUPPLIER:1", "SUPPLIER:2", "ORDER:1", "NATION:1", "REGION:1"]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, EDGE_SCHEMA)


@pytest.fixture(scope="module")
def nodes(spark):
    return spark.createDataFrame([(n, n.split(":")[0]) for n in NODES], "node_id string, node_type string")


def frame(spark, pairs):
    return spark.createDataFrame(pairs, "src_id string, dst_id string")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_closure_with_cycle_and_bound(spark):
    ring = [("a", "b"), ("b", "c"), ("c", "d"), ("d", "a"), ("a", "a"), ("d", "e")]
    got = {(r.src_id, r.dst_id): r.depth for r in closure(frame(spark, ring)).collect()}
    steps = {"a": 0, "b": 1, "c": 2, "d": 3}
    want = {(x, y): (steps[y] - steps[x]) % 4 for x in steps for y in steps if x != y}
    want |= {(x, "e"): (3 - steps[x]) % 4 + 1 for x in steps}
    assert got == want
    chain = [(str(i), str(i + 1)) for i in range(7)]
    bounded = closure(frame(spark, chain), max_depth=5)
    assert {r.depth for r in bounded.collect()} == {1, 2, 3, 4, 5}
    own = spark.createDataFrame([("a",)], "id string")
    assert ("a", "a", 0) in rows(reflexive_closure(frame(spark, ring), own))


def test_closure_of_closure_adds_nothing(spark):
    first = closure(frame(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")])).select("src_id", "dst_id")
    assert rows(closure(first).select("src_id", "dst_id")) == rows(first)


def test_inverse_is_rule_scoped_and_undone_by_itself(edges):
    rule = Rule("R1", "INVERSE", "SUPPLIES", inverse_of="SUPPLIED_BY")
    once = infer_inverse(edges, rule)
    assert once.count() == 4 and {r.rel_name for r in once.collect()} == {"SUPPLIES"}
    back = infer_inverse(once.withColumnRenamed("rel_name", "edge_type"),
                         Rule("R2", "INVERSE", "SUPPLIED_BY", inverse_of="SUPPLIES"))
    cols = ["src_id", "dst_id", "weight", "effective_start", "effective_end"]
    assert rows(back.select(cols)) == rows(edges.where("edge_type = 'SUPPLIED_BY'").select(cols))
    abstract = infer_inverse(edges, Rule("R3", "INVERSE", "engages", inverse_of="engaged_with"), md.RELATION_MAP)
    assert abstract.count() == 5


def test_transitive_weights_and_no_explicit_pairs(edges):
    got = {(r.src_id, r.dst_id): r.weight for r in infer_transitive(
        edges, Rule("R", "TRANSITIVE", "WITHIN")).collect()}
    assert got == {("SUPPLIER:1", "REGION:1"): 0.5, ("PART:1", "NATION:1"): 0.5,
                   ("PART:1", "REGION:1"): pytest.approx(1 / 3)}


def test_chain_intersects_validity(spark):
    e = spark.createDataFrame([
        ("r1", "a", "m", 1.0, D(2000, 1, 1), D(2000, 6, 1)), ("r2", "m", "z", 1.0, D(2000, 3, 1), None),
        ("r1", "b", "n", 1.0, D(2000, 1, 1), D(2000, 2, 1)), ("r2", "n", "z", 1.0, D(2000, 3, 1), None),
        ("r1", "c", "m", 1.0, None, None)], EDGE_SCHEMA)
    got = infer_property_chain(e, Rule("R", "PROPERTY_CHAIN", "t", "r1", "r2"))
    assert rows(got.select("src_id", "dst_id", "effective_start", "effective_end")) == sorted([
        ("a", "z", D(2000, 3, 1), D(2000, 6, 1)), ("c", "z", D(2000, 3, 1), None)], key=repr)


def test_run_goes_on_after_a_bad_rule(edges):
    rules = [Rule("R_BAD", "UNKNOWN", "x"), Rule("R_OFF", "INVERSE", "x", inverse_of="WITHIN", is_enabled=False),
             Rule("R_TRA", "TRANSITIVE", "WITHIN"), Rule("R_INV", "INVERSE", "SUPPLIES", inverse_of="SUPPLIED_BY")]
    assert [r.rule_id for r in ordered_rules(rules)] == ["R_INV", "R_TRA", "R_BAD"]
    saved = []
    status = {r.rule_id: (r.status.split(": unknown")[0], r.inferred) for r in run_inference(
        edges, rules, save=lambda df, rule: saved.append((rule.rule_id, df.collect())[0])).collect()}
    assert status == {"R_INV": ("OK", 4), "R_TRA": ("OK", 3), "R_BAD": ("ERROR: ValueError", 0)}
    assert saved == ["R_INV", "R_TRA"]


def test_summary(edges):
    inferred = infer_inverse(edges, Rule("R", "INVERSE", "SUPPLIES", inverse_of="SUPPLIED_BY"))
    r = summarise(inferred).first()
    assert (r.inferred_count, r.unique_sources, r.unique_targets) == (4, 3, 2)


def test_cardinality(edges):
    got = q.check_cardinality(edges, "SUPPLIED_BY", "C", D(2001, 1, 1)).collect()
    assert [(r.src_id, r.details) for r in got] == [("PART:2", "Multiple edges from same source: 2 edges")]
    both = q.check_cardinality_all(edges, md.RELATIONS, "C", D(2001, 1, 1)).collect()
    assert sorted((r.rel_or_class, r.src_id or "", r.dst_id or "") for r in both) == [
        ("LEAD_SUPPLIER", "", "ORDER:1"), ("SUPPLIED_BY", "PART:2", "")]


@pytest.mark.parametrize("splits", [1, 4])
def test_referential_one_row_per_edge(spark, edges, nodes, splits):
    extra = spark.createDataFrame([EDGES[3]] * 3, EDGE_SCHEMA)
    got = q.check_referential(edges.unionByName(extra), nodes, "R", splits=splits).collect()
    assert sorted((r.rel_or_class, r.src_id or "", r.dst_id or "", r.details) for r in got) == [
        ("IN_ORDER", "PART:8", "", "Source node not found")] + [
        ("SUPPLIED_BY", "", "SUPPLIER:9", "Destination node not found")] * 4


def catalog(spark):
    tree = spark.createDataFrame([(c.class_name, c.parent_class_name, c.node_type) for c in md.CLASSES],
                                 "class_name string, parent_class_name string, node_type string")
    relations = spark.createDataFrame([(r.rel_name, r.domain_class, r.range_class) for r in md.RELATIONS],
                                      "rel_name string, domain_class string, range_class string")
    return tree.where("node_type IS NOT NULL").select("node_type", "class_name"), relations, q.class_intervals(tree)


def test_domain_range(spark, edges, nodes):
    bad = q.check_domain_range(edges, nodes, *catalog(spark), "D").collect()
    assert [(r.src_id, r.dst_id) for r in bad] == [("PART:1", "SUPPLIER:1")]
    profile = q.domain_range_profile(edges, nodes, *catalog(spark)).where("NOT conforms AND src_class IS NOT NULL AND dst_class IS NOT NULL")
    assert {(r.src_class, r.dst_class) for r in profile.collect()} == {("Part", "Supplier")}
    # ids say nothing: a node called PART:77 that is an order, and one of a type without a class
    more = nodes.select("node_id", "node_type").unionByName(spark.createDataFrame(
        [("PART:77", "ORDER"), ("PART:78", "GHOST")], "node_id string, node_type string"))
    planted = edges.unionByName(spark.createDataFrame(
        [("SUPPLIED_BY", k, "SUPPLIER:1", 1.0, D(2000, 1, 1), None) for k in ("PART:77", "PART:78")],
        "edge_type string, src_id string, dst_id string, weight double, effective_start date, effective_end date").select(edges.columns))
    found = q.check_domain_range(planted, more, *catalog(spark), "D").collect()
    assert sorted(r.src_id for r in found) == ["PART:1", "PART:77", "PART:78"] and {r.check_name for r in found} == {"D"}


def test_class_intervals(spark):
    import random
    rng = random.Random(2)
    parent = {f"c{i}": (f"c{rng.randrange(i)}" if i and rng.random() < 0.95 else None) for i in range(40)}
    tree = spark.createDataFrame(list(parent.items()), "class_name string, parent_class_name string")
    label = {r.class_name: (r.low, r.high) for r in q.class_intervals(tree).collect()}

    def above(c):
        return {c} | (above(parent[c]) if parent[c] else set())

    for a in parent:
        for c in parent:
            assert (label[a][0] <= label[c][0] <= label[a][1]) == (a in above(c))
    with pytest.raises(ValueError):
        q.class_intervals(spark.createDataFrame([("a", "b"), ("b", "a"), ("r", None)], "class_name string, parent_class_name string"))


def test_ids_carried_twice(spark, nodes):
    twice = nodes.unionByName(nodes.limit(1))
    assert q.unique_id_violations(twice, "U").count() == 1 and q.unique_id_violations(nodes, "U").count() == 0


def test_required_props(spark):
    from pyspark.sql import functions as F
    raw = spark.createDataFrame([
        ("ORDER:1", "ORDER", '{"order_date":"2000-01-01","lead_supplier":1,"tail_supplier":2}'),
        ("ORDER:2", "ORDER", '{"order_date":"not a date","lead_supplier":1,"tail_supplier":2}'),
        ("ORDER:3", "ORDER", None), ("NATION:1", "NATION", "{}")], "node_id string, node_type string, j string")
    nodes = raw.select("node_id", "node_type", F.parse_json("j").alias("props"))
    got = sorted((r.src_id, r.details) for r in q.check_required_props(nodes, md.PROPERTIES, "P").collect())
    assert got == [("NATION:1", "Missing required property region"),
                   ("ORDER:2", "Wrong type of property order_date"),
                   ("ORDER:3", "Missing required property lead_supplier"),
                   ("ORDER:3", "Missing required property order_date"),
                   ("ORDER:3", "Missing required property tail_supplier")]


def test_ids_and_summary(spark, edges, nodes):
    assert q.check_unique_ids(nodes).count() == 0
    assert [r.id for r in q.check_unique_ids(nodes, typed=False).orderBy("id").collect()] == ["1", "2"]
    found = q.check_cardinality_all(edges, md.RELATIONS, "C", D(2001, 1, 1))
    texts = {r.rel_or_class: r.violation_types for r in q.violation_summary(found).collect()}
    assert texts["SUPPLIED_BY"] == "Multiple edges from same source: n edges"


def test_abstract_views(spark, edges, nodes):
    views = ont.generate_class_views(nodes, md.CLASSES, prefix="t_")
    assert {k: v.count() for k, v in views.items()} == {"Thing": 8, "Party": 3, "Org": 2, "Occasion": 1, "Place": 2}
    assert spark.sql("SELECT DISTINCT subtype FROM t_party ORDER BY 1").collect()[0][0] == "Customer"
    resolved = ont.resolved_relations(edges, md.CLASSES)
    relations = ont.generate_relation_views(resolved, md.RELATION_MAP, prefix="t_")
    assert {k: v.count() for k, v in relations.items()} == {
        "engaged_with": 5, "participates_in": 1, "affiliated_with": 2}
    assert ont.descendants(md.CLASSES, "Thing")["Part"] == 2
    named = ont.interface_view(nodes, md.CLASSES, ("Party", "Org"), {})
    assert named.count() == 5


def test_inference_kept_up_to_date(spark):
    """Any change gives what a full run on the changed edges gives, over several changes in a row."""
    import random
    from kgspark.operators.inference import supported, update_supported
    rng = random.Random(12)
    rules = [Rule("I", "INVERSE", "INV", inverse_of="A"), Rule("T", "TRANSITIVE", "W"), Rule("C", "PROPERTY_CHAIN", "CH", "A", "W"),
             Rule("X", "INVERSE", "any", inverse_of="some")]
    abstract = {"some": ["A", "B"]}
    schema = "edge_type string, src_id string, dst_id string, weight double, effective_start date, effective_end date"

    def some(n):
        return [(rng.choice("AAWWWB"), f"N:{rng.randrange(9)}", f"N:{rng.randrange(9)}", 1.0, rng.choice([None, D(2000, 1, 1)]),
                 rng.choice([None, None, D(2001, 1, 1)])) for _ in range(n)]

    def rows(df):
        return sorted(map(repr, df.collect()))

    held = some(30)
    held += held[:4]  # an edge given twice has two supports
    state = supported(spark.createDataFrame(held, schema), rules, abstract)
    for added, gone in ((some(6), 8), ([], 10)):
        removed = rng.sample(held, gone)
        after = list(held)
        for e in removed:
            after.remove(e)
        after += added
        state = update_supported(state, spark.createDataFrame(held, schema), spark.createDataFrame(added, schema),
                                 spark.createDataFrame(removed, schema), rules, abstract)
        assert rows(state) == rows(supported(spark.createDataFrame(after, schema), rules, abstract))
        held = after
    full = infer_all(spark.createDataFrame(held, schema), rules, abstract)
    assert rows(state.drop("support")) == rows(full.distinct().select(state.drop("support").columns))


def test_checks_share_counted_ends(spark, edges, nodes):
    """With ends counted once, the checks find the same; an end of many edges is one row of the join with the nodes."""
    day = D(2001, 1, 1)
    many = edges.unionByName(spark.createDataFrame([EDGES[3]] * 1000, EDGE_SCHEMA))
    ends = q.counted_ends(many, day)
    assert ends.count() == ends.select("edge_type", "side", "id").distinct().count()
    assert ends.where("edge_type = 'SUPPLIED_BY' AND id = 'SUPPLIER:9'").first().n == 1001
    key = lambda df: sorted(tuple(str(v) for v in r) for r in df.collect())
    for alone, shared in [
            (q.check_cardinality_all(many, md.RELATIONS, "C", day), q.check_cardinality_all(many, md.RELATIONS, "C", day, ends)),
            (q.check_referential(many, nodes, "R"), q.check_referential(many, nodes, "R", splits=7, ends=ends)),
            (q.check_domain_range(many, nodes, *catalog(spark), "D"), q.check_domain_range(many, nodes, *catalog(spark), "D", ends))]:
        assert key(alone) == key(shared)
    assert q.check_referential(many, nodes, "R", ends=ends).where("dst_id = 'SUPPLIER:9'").count() == 1001
