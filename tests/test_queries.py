"""Registered queries: the contract, and a sample against SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from check_queries import TABLES, compare
from kgspark.plans import concrete, networks, ontology
from kgspark.plans.ontology import abstract_model, concrete_model, governance_model
from kgspark.sources.tables import Tables

FOLDER = "/root/testdata/sf0.001"
SAMPLE = ["current_assortment", "supplier_performance", "customer_succession", "moves_between_nations",
          "co_supplied_overlap", "party_moves", "supplier_diversity", "rel_resolved", "infer_transitive",
          "check_referential", "semantic_metrics_concrete", "relation_catalog", "role_access_matrix",
          "network_by_year", "shortest_path", "centrality_betweenness", "centrality_eigenvector", "community_invariants",
          "moves_between_suppliers", "rel_resolved_props"]

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


@pytest.fixture(scope="module")
def tables(spark):
    return Tables(spark, FOLDER)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for table in TABLES:
        c.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return c


def test_contract(spark):
    registered, checks = entry_module.queries(), entry_module.oracle_sql()
    assert set(checks) <= set(registered)
    # the corpus queries state their own checks in tests/llm
    corpus = {n for n in registered if n == "pipeline" or n.startswith("op")}
    assert set(registered) - set(checks) - corpus == {"community_louvain", "community_sizes"}
    assert entry_module.entry(spark).limit(1).count() == 1


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_sql(spark, con, name):
    df = entry_module.queries()[name](spark, FOLDER)
    cur = con.execute(entry_module.oracle_sql()[name])
    assert compare(df.columns, [tuple(r) for r in df.collect()],
                   [c[0] for c in cur.description], cur.fetchall()) is None


def test_named_entity_forms(tables):
    """One entity's rows are the matching rows of the whole result."""
    one = concrete.assortment(tables, "Supplier#000000001").collect()
    every = [r for r in concrete.assortment(tables).collect() if r.supplier_name == "Supplier#000000001"]
    assert sorted(map(repr, one)) == sorted(map(repr, every)) and one
    path = {r.move_rank: r.path for r in concrete.move_path(tables, 1).collect()}
    steps = {r.move_rank: r.step for r in concrete.move_chain(tables).where("part_id = 'PART:1'").collect()}
    assert path[1] == steps[1] and all(path[k].endswith(steps[k].split(" → ")[-1]) for k in steps)
    mates = concrete.co_supplied_parts(tables, 1)
    assert mates.where("part_id = 'PART:1'").count() == 0 and mates.count() > 0
    assert concrete.head_to_head(tables, "Supplier#000000002", "Supplier#000000001").count() == \
        concrete.head_to_head(tables).where("supplier_a = 'Supplier#000000001' "
                                            "AND supplier_b = 'Supplier#000000002'").count()
    assert networks.moves_for_part(tables, part=1).count() == len(steps)


def test_unknown_graph_type(tables):
    with pytest.raises(ValueError):
        networks.load_graph(tables, "planets")


def test_network_paths(tables):
    rows = networks.supplier_network_paths(tables, 1).collect()
    assert rows and all(r.path.startswith("SUPPLIER:1 → (PART:") and r.path.endswith(r.supplier_id) for r in rows)


def test_semantic_models(tables):
    model = governance_model(tables)
    assert model.filtered("abstract_classes").count() == 5
    assert model.filtered("concrete_classes").count() == 6
    assert model.filtered("enabled_rules").count() == 5
    assert model.filtered("read_permissions").count() + model.filtered("write_permissions").count() \
        + model.filtered("admin_permissions").count() <= len(ontology.md.PERMISSIONS)
    for name in ("active_only", "trade_ontology", "required_properties", "enabled_actions"):
        assert model.filtered(name).count() > 0
    by_class = model.query(["instance_count"], ["class.class_name"])
    assert {r.class_name: r.instance_count for r in by_class.collect()}["Part"] == 200
    concrete_m = concrete_model(tables)
    assert all(concrete_m.duplicate_keys(name).count() == 0 for name in ("part", "supplier", "order", "supplied_by"))
    for bad in (lambda: concrete_m.query(["nothing"]), lambda: concrete_m.query(["total_value"], [], ["nothing"]),
                lambda: concrete_m.query(["total_value"], ["order.priority"])):
        with pytest.raises(ValueError):
            bad()
    assert len(concrete_m.joins) == 10 and len(concrete_m.filters) + len(abstract_model(tables).filters) \
        + len(model.filters) == 23
    assert len(concrete_m.metrics) == 9 and len(abstract_model(tables).metrics) == 5
