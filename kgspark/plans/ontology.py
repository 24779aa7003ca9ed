"""Ontology, inference, data quality and semantic-layer queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from kgspark.functions.ids import typed_id
from kgspark.functions.intervals import whole_years
from kgspark.functions.props import prop
from kgspark.operators import inference as inf, ontology as ont, quality as q, views
from kgspark.operators.closure import reflexive_closure
from kgspark.operators.semantic import Join, SemanticModel
from kgspark.plans import binding as b, metadata as md
from kgspark.plans.checks import AS_OF, active, sql
from kgspark.plans.registry import query
from kgspark.session import checkpoint_dir, cut_lineage
from kgspark.sources import sinks
from kgspark.sources.tables import Tables

CLASS_SQL = ("CASE split_part({c}, ':', 1) WHEN 'PART' THEN 'Part' WHEN 'CUSTOMER' THEN 'Customer' "
             "WHEN 'SUPPLIER' THEN 'Supplier' WHEN 'ORDER' THEN 'Order' WHEN 'NATION' THEN 'Nation' "
             "WHEN 'REGION' THEN 'Region' END")
SRC_CLASS, DST_CLASS = CLASS_SQL.format(c="src_id"), CLASS_SQL.format(c="dst_id")


def rule(rule_id: str) -> inf.Rule:
    return next(r for r in md.RULES if r.rule_id == rule_id)


# --- classes and abstract views ------------------------------------------------------------

def _members_sql(types: str) -> str:
    return sql(f"""SELECT node_id AS id, {CLASS_SQL.format(c='node_id')} AS subtype,
        'v_' || LOWER(node_type) AS src_view FROM node_keys WHERE node_type IN ({types})""", "node_keys")


@query("abstract_party", _members_sql("'PART', 'CUSTOMER'"))
def abstract_party(t: Tables) -> DataFrame:
    return ont.abstract_class_view(b.node_keys(t), md.CLASSES, "Party")


@query("abstract_org", _members_sql("'SUPPLIER'"))
def abstract_org(t: Tables) -> DataFrame:
    return ont.abstract_class_view(b.node_keys(t), md.CLASSES, "Org")


@query("abstract_occasion", _members_sql("'ORDER'"))
def abstract_occasion(t: Tables) -> DataFrame:
    return ont.abstract_class_view(b.node_keys(t), md.CLASSES, "Occasion")


@query("generated_thing_view", _members_sql("'PART','CUSTOMER','SUPPLIER','ORDER','NATION','REGION'"))
def generated_thing_view(t: Tables) -> DataFrame:
    """The root class's view from the metadata-driven generator; each entity once."""
    return ont.generate_class_views(b.node_keys(t), md.CLASSES)["Thing"]


@query("party_subtype_counts", """SELECT 'Part' AS subtype, COUNT(*) AS members FROM part
    UNION ALL SELECT 'Customer', COUNT(*) FROM customer""")
def party_subtype_counts(t: Tables) -> DataFrame:
    return abstract_party(t).groupBy("subtype").agg(F.count("*").alias("members"))


INVERSE_ROWS_SQL = f"""
    SELECT 'SUPPLIES' AS rel_name, dst_id AS src_id, src_id AS dst_id, 'INVERSE' AS inference_kind,
           'INV_SUPPLIES' AS rule_id, CAST(1.0 AS DOUBLE) AS weight, effective_start, effective_end
    FROM edges WHERE edge_type = 'SUPPLIED_BY'
    UNION ALL
    SELECT 'SELLS_TO', dst_id, src_id, 'INVERSE', 'INV_SELLS_TO', 1.0, effective_start, effective_end
    FROM edges WHERE edge_type = 'BUYS_FROM'"""


def _abstract_sql(rels: str) -> str:
    return sql(f"""SELECT edge_type AS via_rel, src_id AS subject_id, {SRC_CLASS} AS subject_class,
        dst_id AS object_id, {DST_CLASS} AS object_class, effective_start, effective_end
        FROM edges WHERE edge_type IN ({rels})""", "edges")


def abstract_relation(t: Tables, name: str) -> DataFrame:
    return ont.abstract_relation_view(ont.resolved_relations(b.kg_edges(t), md.CLASSES), md.RELATION_MAP[name])


@query("engaged_with", _abstract_sql("'SUPPLIED_BY', 'BUYS_FROM'"))
def engaged_with(t: Tables) -> DataFrame:
    return abstract_relation(t, "engaged_with")


@query("participates_in", _abstract_sql("'IN_ORDER'"))
def participates_in(t: Tables) -> DataFrame:
    return abstract_relation(t, "participates_in")


@query("affiliated_with", _abstract_sql("'LEAD_SUPPLIER', 'TAIL_SUPPLIER'"))
def affiliated_with(t: Tables) -> DataFrame:
    return abstract_relation(t, "affiliated_with")


@query("generated_engaged_with", sql(f"""SELECT edge_type AS via_rel, src_id AS subject_id,
    {SRC_CLASS} AS subject_class, dst_id AS object_id, {DST_CLASS} AS object_class, effective_start,
    effective_end, 'v_' || LOWER(edge_type) AS src_view
    FROM edges WHERE edge_type IN ('SUPPLIED_BY', 'BUYS_FROM')""", "edges"))
def generated_engaged_with(t: Tables) -> DataFrame:
    resolved = ont.resolved_relations(b.kg_edges(t), md.CLASSES)
    return ont.generate_relation_views(resolved, md.RELATION_MAP)["engaged_with"]


def _pairs_sql() -> str:
    """Every class with its descendants, walked down in SQL from the parent list alone."""
    rows = ", ".join(f"('{c.class_name}', {repr(c.parent_class_name) if c.parent_class_name else 'NULL'})"
                     for c in md.CLASSES)
    return f"""WITH RECURSIVE parents(child, parent) AS (VALUES {rows}),
        down(ancestor_class, descendant_class, depth) AS (
            SELECT child, child, 0 FROM parents
            UNION ALL SELECT d.ancestor_class, p.child, d.depth + 1 FROM down d JOIN parents p ON p.parent = d.descendant_class)
        SELECT * FROM down"""


@query("class_closure", sql(f"""
    SELECT ancestor_class, descendant_class, depth, COUNT(node_id) AS members
    FROM pairs LEFT JOIN (SELECT node_id, {CLASS_SQL.format(c='node_id')} AS c FROM node_keys) n
      ON n.c = descendant_class GROUP BY ALL""", "node_keys", extra={"pairs": _pairs_sql()}))
def class_closure(t: Tables) -> DataFrame:
    """Reflexive class closure with the number of live members of each descendant class."""
    members = (b.node_keys(t).groupBy("node_type").agg(F.count("*").alias("members"))
               .withColumn("descendant_class", ont.class_of_type(md.CLASSES, F.col("node_type"))))
    pairs = ont.class_pairs(t.spark, md.CLASSES)
    return pairs.join(members, "descendant_class", "left").select(
        "ancestor_class", "descendant_class", "depth",
        F.coalesce("members", F.lit(0).cast("bigint")).alias("members"))


def within_edges(t: Tables) -> DataFrame:
    return b.kg_edges(t).where("edge_type = 'WITHIN'")


@query("place_closure", sql("""
    SELECT node_id AS ancestor, node_id AS descendant, 0 AS depth FROM node_keys
    WHERE node_type IN ('CUSTOMER', 'SUPPLIER', 'NATION', 'REGION')
    UNION ALL SELECT dst_id, src_id, 1 FROM edges WHERE edge_type = 'WITHIN'
    UNION ALL SELECT y.dst_id, x.src_id, 2 FROM edges x JOIN edges y ON y.src_id = x.dst_id
    WHERE x.edge_type = 'WITHIN' AND y.edge_type = 'WITHIN'""", "node_keys", "edges"))
def place_closure(t: Tables) -> DataFrame:
    nodes = b.node_keys(t).where(F.col("node_type").isin("CUSTOMER", "SUPPLIER", "NATION", "REGION"))
    reach = reflexive_closure(within_edges(t), nodes.select(F.col("node_id").alias("id")), max_depth=10)
    return reach.select(F.col("dst_id").alias("ancestor"), F.col("src_id").alias("descendant"), "depth")


@query("interface_named", """
    SELECT 'PART:' || p_partkey AS id, 'Part' AS class_name, p_name AS name FROM part
    UNION ALL SELECT 'CUSTOMER:' || c_custkey, 'Customer', c_name FROM customer
    UNION ALL SELECT 'SUPPLIER:' || s_suppkey, 'Supplier', s_name FROM supplier
    UNION ALL SELECT 'ORDER:' || o_orderkey, 'Order', 'Order ' || o_orderkey FROM orders""")
def interface_named(t: Tables) -> DataFrame:
    return ont.interface_view(b.kg_nodes(t), md.CLASSES, md.INTERFACE_IMPL["Named"], {"name": F.col("name")})


def derived_values(t: Tables) -> DataFrame:
    """(class, prop, value) of every declared derived property on every node of its class."""
    frames = []
    for c in md.CLASSES:
        derived = [d for d in md.DERIVED if d.class_name == c.class_name]
        if derived:
            typed = views.declared_view(b.kg_nodes(t), c.node_type,
                                        [p for p in md.PROPERTIES if p.class_name == c.class_name])
            full = views.with_derived(typed, derived)
            frames.append(full.select("node_id", F.explode(F.array(*[
                F.struct(F.lit(c.class_name).alias("object_type"), F.lit(d.prop_name).alias("prop_name"),
                         F.col(d.prop_name).cast("string").alias("value"), F.lit(d.sql_expr).alias("sql_expr"))
                for d in derived])).alias("d")).select("node_id", "d.*"))
    return ont.union_all(frames)


def _preview(expr: str) -> str:
    return expr[:97] + "..." if len(expr) > 100 else expr


DERIVED_SQL = " UNION ALL ".join(
    f"""SELECT '{c}' AS object_type, '{p}' AS prop_name, '{_preview(e).replace("'", "''")}' AS definition_preview,
        CAST({x} AS VARCHAR) AS value FROM {tab}""" for (c, p, e), (x, tab) in zip(
        [(d.class_name, d.prop_name, d.sql_expr) for d in md.DERIVED],
        [("YEAR(o_orderdate)", "orders"), ("o_orderpriority IN ('1-URGENT', '2-HIGH')", "orders"),
         ("CASE WHEN p_size < 17 THEN 'small' WHEN p_size < 34 THEN 'medium' ELSE 'large' END", "part"),
         ("CAST(split_part(p_brand, '#', 2) AS INT)", "part")]))


@query("derived_properties", f"""
    SELECT object_type, prop_name, definition_preview, COUNT(*) AS nodes, COUNT(value) AS filled,
           MIN(value) AS min_value, MAX(value) AS max_value
    FROM ({DERIVED_SQL}) GROUP BY object_type, prop_name, definition_preview""")
def derived_properties(t: Tables) -> DataFrame:
    text = F.col("sql_expr")
    preview = F.when(F.length(text) > 100, F.concat(F.substring(text, 1, 97), F.lit("..."))).otherwise(text)
    return derived_values(t).groupBy("object_type", "prop_name", preview.alias("definition_preview")).agg(
        F.count("*").alias("nodes"), F.count("value").alias("filled"), F.min("value").alias("min_value"),
        F.max("value").alias("max_value"))


@query("tenure_age_years", sql(f"""
    SELECT 'PART:' || part_key AS part_id, 'SUPPLIER:' || supp_key AS supplier_id, start_date,
           CAST(DATESUB('year', start_date, {AS_OF}) AS INT) AS age_years
    FROM supplied_by WHERE start_date <= {AS_OF}""", "supplied_by"))
def tenure_age_years(t: Tables) -> DataFrame:
    return b.supplied_by(t).where(F.col("start_date") <= F.lit(b.AS_OF)).select(
        typed_id("PART", "part_key").alias("part_id"), typed_id("SUPPLIER", "supp_key").alias("supplier_id"),
        "start_date", whole_years(F.col("start_date"), b.AS_OF).alias("age_years"))


# --- inference -----------------------------------------------------------------------------

@query("infer_inverse", sql(INVERSE_ROWS_SQL, "edges"))
def infer_inverse(t: Tables) -> DataFrame:
    return inf.infer_all(b.kg_edges(t), [rule("INV_SUPPLIES"), rule("INV_SELLS_TO")])


ABSTRACT_INVERSE_SQL = """
    SELECT 'engages' AS rel_name, dst_id AS src_id, src_id AS dst_id, 'INVERSE' AS inference_kind,
           'INV_ENGAGES' AS rule_id, CAST(1.0 AS DOUBLE) AS weight, effective_start, effective_end
    FROM edges WHERE edge_type IN ('SUPPLIED_BY', 'BUYS_FROM')"""


@query("infer_inverse_abstract", sql(ABSTRACT_INVERSE_SQL, "edges"))
def infer_inverse_abstract(t: Tables) -> DataFrame:
    return inf.infer_inverse(b.kg_edges(t), rule("INV_ENGAGES"), md.RELATION_MAP)


TRANSITIVE_SQL = """
    SELECT 'WITHIN' AS rel_name, x.src_id, y.dst_id, 'TRANSITIVE' AS inference_kind,
           'TRA_WITHIN' AS rule_id, CAST(0.5 AS DOUBLE) AS weight,
           CAST(NULL AS DATE) AS effective_start, CAST(NULL AS DATE) AS effective_end
    FROM edges x JOIN edges y ON y.src_id = x.dst_id
    WHERE x.edge_type = 'WITHIN' AND y.edge_type = 'WITHIN'"""


@query("infer_transitive", sql(TRANSITIVE_SQL, "edges"))
def infer_transitive(t: Tables) -> DataFrame:
    return inf.infer_transitive(b.kg_edges(t), rule("TRA_WITHIN"))


CHAIN_SQL = """
    SELECT DISTINCT 'OFFERED_IN' AS rel_name, x.src_id, y.dst_id, 'PROPERTY_CHAIN' AS inference_kind,
           'CHAIN_OFFERED_IN' AS rule_id, CAST(1.0 AS DOUBLE) AS weight, x.effective_start, x.effective_end
    FROM edges x JOIN edges y ON y.src_id = x.dst_id
    WHERE x.edge_type = 'SUPPLIED_BY' AND y.edge_type = 'WITHIN'"""


@query("infer_property_chain", sql(CHAIN_SQL, "edges"))
def infer_property_chain(t: Tables) -> DataFrame:
    return inf.infer_property_chain(b.kg_edges(t), rule("CHAIN_OFFERED_IN"))


ALL_INFERRED_SQL = f"""({INVERSE_ROWS_SQL}) UNION ALL ({ABSTRACT_INVERSE_SQL})
    UNION ALL ({TRANSITIVE_SQL}) UNION ALL ({CHAIN_SQL})"""


@query("rel_resolved", sql(f"""
    SELECT edge_type AS rel_name, src_id, {SRC_CLASS} AS src_class, dst_id, {DST_CLASS} AS dst_class,
           effective_start, effective_end, CAST(1.0 AS DOUBLE) AS weight, 'EXPLICIT' AS source FROM edges
    UNION ALL
    SELECT rel_name, src_id, {SRC_CLASS}, dst_id, {DST_CLASS}, effective_start, effective_end, weight,
           inference_kind FROM i""", "edges", extra={"i": ALL_INFERRED_SQL}))
def rel_resolved(t: Tables) -> DataFrame:
    """Explicit edges and the edges of every enabled rule in one schema."""
    edges = b.written_edges(t)
    inferred = inf.infer_all(edges, md.RULES, md.RELATION_MAP)
    return ont.with_inferred(ont.resolved_relations(edges, md.CLASSES), inferred, md.CLASSES)


@query("run_inference", sql("""
    SELECT rule_id, inference_kind AS rule_kind, rel_name AS target_rel, 'OK' AS status,
           COUNT(*) AS inferred FROM i GROUP BY rule_id, inference_kind, rel_name""", "edges",
                            extra={"i": ALL_INFERRED_SQL}))
def run_inference(t: Tables, folder: str | None = None) -> DataFrame:
    """Edges are written once, then each rule's edges are published to the inferred table, whose earlier rows of the
    rule they replace, and counted as they are written."""
    edges = b.written_edges(t)
    folder = folder or f"{checkpoint_dir(t.spark).rstrip('/')}/kgspark-inferred"
    return inf.run_inference(edges, md.RULES, md.RELATION_MAP, lambda rows, rule: sinks.publish(rows, folder, rule.rule_id))


@query("inferred_summary", sql("""
    SELECT rule_id, rel_name, inference_kind,
           CASE rule_id WHEN 'INV_SUPPLIES' THEN 'Supplier to part' WHEN 'INV_SELLS_TO' THEN 'Supplier to customer'
                WHEN 'INV_ENGAGES' THEN 'Inverse of an abstract relation'
                WHEN 'TRA_WITHIN' THEN 'Places within places'
                ELSE 'Part is offered where its supplier is' END AS rule_description,
           COUNT(*) AS inferred_count, COUNT(DISTINCT src_id) AS unique_sources,
           COUNT(DISTINCT dst_id) AS unique_targets
    FROM i GROUP BY rule_id, rel_name, inference_kind""", "edges", extra={"i": ALL_INFERRED_SQL}))
def inferred_summary(t: Tables) -> DataFrame:
    """Live counts per enabled rule, with the rule catalog's description."""
    described = t.spark.createDataFrame([(r.rule_id, r.description) for r in md.RULES],
                                        "rule_id string, rule_description string")
    inferred = inf.infer_all(b.written_edges(t), md.RULES, md.RELATION_MAP)
    return inf.summarise(inferred).join(described, "rule_id", "left")


CHANGED_SQL = """SELECT edge_type, src_id, dst_id, CAST(1 AS DOUBLE) AS weight, effective_start, effective_end FROM edges
    WHERE NOT (edge_type = 'SUPPLIED_BY' AND effective_end IS NOT NULL)
    UNION ALL SELECT 'WITHIN', 'REGION:' || r_regionkey, 'WORLD:0', CAST(1 AS DOUBLE), CAST(NULL AS DATE), CAST(NULL AS DATE) FROM region"""


@query("inference_updated", sql(f"""
    SELECT rule_id, rel_name, src_id, dst_id, weight, effective_start, effective_end, COUNT(*) AS support FROM (
        SELECT 'SUPPLIES' AS rel_name, dst_id AS src_id, src_id AS dst_id, 'INV_SUPPLIES' AS rule_id, weight, effective_start, effective_end
            FROM now WHERE edge_type = 'SUPPLIED_BY'
        UNION ALL SELECT 'SELLS_TO', dst_id, src_id, 'INV_SELLS_TO', weight, effective_start, effective_end FROM now WHERE edge_type = 'BUYS_FROM'
        UNION ALL SELECT 'engages', dst_id, src_id, 'INV_ENGAGES', weight, effective_start, effective_end
            FROM now WHERE edge_type IN ('SUPPLIED_BY', 'BUYS_FROM')
        UNION ALL SELECT 'OFFERED_IN', x.src_id, y.dst_id, 'CHAIN_OFFERED_IN', x.weight * y.weight, x.effective_start, x.effective_end
            FROM now x JOIN now y ON y.src_id = x.dst_id WHERE x.edge_type = 'SUPPLIED_BY' AND y.edge_type = 'WITHIN'
        UNION ALL SELECT 'WITHIN', src_id, dst_id, 'TRA_WITHIN', 1.0 / MIN(depth), NULL, NULL FROM far WHERE depth > 1 GROUP BY src_id, dst_id)
    GROUP BY rule_id, rel_name, src_id, dst_id, weight, effective_start, effective_end""", "edges", extra={
        "now": CHANGED_SQL,
        "w2": """SELECT x.src_id, y.dst_id FROM now x JOIN now y ON y.src_id = x.dst_id WHERE x.edge_type = 'WITHIN' AND y.edge_type = 'WITHIN'""",
        "w3": "SELECT x.src_id, y.dst_id FROM w2 x JOIN now y ON y.src_id = x.dst_id WHERE y.edge_type = 'WITHIN'",
        "w4": "SELECT x.src_id, y.dst_id FROM w3 x JOIN now y ON y.src_id = x.dst_id WHERE y.edge_type = 'WITHIN'",
        "far": "SELECT *, 2 AS depth FROM w2 UNION ALL SELECT *, 3 FROM w3 UNION ALL SELECT *, 4 FROM w4"}))
def inference_updated(t: Tables) -> DataFrame:
    """Inferred edges after ended tenures went and a place around all regions came, worked out from the changes."""
    edges = b.written_edges(t, inf.relations_read(md.RULES, md.RELATION_MAP))
    rows = 3 * edges.count()  # each engagement is inverted twice, and most are followed to a place
    removed = edges.where("edge_type = 'SUPPLIED_BY' AND effective_end IS NOT NULL")
    none = F.lit(None).cast("date")
    added = t.region.select(
        typed_id("REGION", "r_regionkey").alias("src_id"), F.lit("WORLD:0").alias("dst_id"), F.lit("WITHIN").alias("edge_type"),
        F.lit(1.0).alias("weight"), none.alias("effective_start"), none.alias("effective_end"))
    before = cut_lineage(inf.supported(edges, md.RULES, md.RELATION_MAP, rows=rows))
    after = inf.update_supported(before, edges, added, removed, md.RULES, md.RELATION_MAP, rows=2 * rows)
    return after.select("rule_id", "rel_name", "src_id", "dst_id", "weight", "effective_start", "effective_end", "support")


# --- data quality ----------------------------------------------------------------------------

ACTIVE_EDGES = f"(effective_end IS NULL OR effective_end >= {AS_OF})"
CARDINALITY_SQL = f"""
    SELECT 'CARDINALITY' AS check_name, 'RELATION' AS scope, edge_type AS rel_or_class, src_id,
           CAST(NULL AS VARCHAR) AS dst_id,
           'Multiple edges from same source: ' || COUNT(*) || ' edges' AS details
    FROM edges WHERE {ACTIVE_EDGES} AND edge_type IN ('SUPPLIED_BY', 'BUYS_FROM', 'WITHIN')
    GROUP BY edge_type, src_id HAVING COUNT(*) > 1
    UNION ALL
    SELECT 'CARDINALITY', 'RELATION', edge_type, NULL, dst_id,
           'Multiple edges to same destination: ' || COUNT(*) || ' edges'
    FROM edges WHERE {ACTIVE_EDGES} AND edge_type IN ('LEAD_SUPPLIER', 'TAIL_SUPPLIER')
    GROUP BY edge_type, dst_id HAVING COUNT(*) > 1"""


@query("check_cardinality", sql(f"""
    SELECT 'CARD_SUPPLIED_BY' AS check_name, 'RELATION' AS scope, 'SUPPLIED_BY' AS rel_or_class, src_id,
           CAST(NULL AS VARCHAR) AS dst_id,
           'Multiple edges from same source: ' || COUNT(*) || ' edges' AS details
    FROM edges WHERE {ACTIVE_EDGES} AND edge_type = 'SUPPLIED_BY' GROUP BY src_id HAVING COUNT(*) > 1""", "edges"))
def check_cardinality(t: Tables) -> DataFrame:
    return q.check_cardinality(b.kg_edges(t), "SUPPLIED_BY", "CARD_SUPPLIED_BY", b.AS_OF)


@query("check_cardinality_all", sql(CARDINALITY_SQL, "edges"))
def check_cardinality_all(t: Tables) -> DataFrame:
    return q.check_cardinality_all(b.kg_edges(t), md.RELATIONS, "CARDINALITY", b.AS_OF)


REFERENTIAL_SQL = f"""
    SELECT 'REFERENTIAL' AS check_name, 'RELATION' AS scope, edge_type AS rel_or_class,
           CAST(NULL AS VARCHAR) AS src_id, dst_id, 'Destination node not found' AS details
    FROM edges JOIN order_dim ON dst_id = 'ORDER:' || order_key WHERE order_date > {AS_OF}"""


def nodes_known(t: Tables) -> DataFrame:
    """Ids of the node table as it stood on the reference date; later orders are not in it yet."""
    placed = t.orders.where(F.col("o_orderdate").cast("date") <= F.lit(b.AS_OF)).select(
        typed_id("ORDER", "o_orderkey").alias("node_id"))
    return b.node_keys(t).where("node_type <> 'ORDER'").select("node_id").unionByName(placed)


@query("check_referential", sql(REFERENTIAL_SQL, "edges", "order_dim"))
def check_referential(t: Tables) -> DataFrame:
    """All edges against the nodes known on the reference date."""
    return q.check_referential(b.kg_edges(t), nodes_known(t), "REFERENTIAL")


def class_catalog_frames(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(types and classes, relations with domain and range, class intervals) from the catalog."""
    tree = t.spark.createDataFrame([(c.class_name, c.parent_class_name, c.node_type) for c in md.CLASSES],
                                   "class_name string, parent_class_name string, node_type string")
    relations = t.spark.createDataFrame([(r.rel_name, r.domain_class, r.range_class) for r in md.RELATIONS],
                                        "rel_name string, domain_class string, range_class string")
    return tree.where("node_type IS NOT NULL").select("node_type", "class_name"), relations, q.class_intervals(tree)


TYPE_CASES = " ".join(f"WHEN '{c.node_type}' THEN '{c.class_name}'" for c in md.CLASSES if c.node_type)


def _below_sql() -> str:
    """(rel_name, src_class, dst_class): what each relation's domain and range allow, from the parent list."""
    classes = ", ".join(f"('{c.class_name}', {repr(c.parent_class_name) if c.parent_class_name else 'NULL'})" for c in md.CLASSES)
    relations = ", ".join(f"('{r.rel_name}', '{r.domain_class}', '{r.range_class}')" for r in md.RELATIONS)
    return f"""tree(c, p) AS (VALUES {classes}), declared(rel_name, domain_class, range_class) AS (VALUES {relations}),
        below(anc, c) AS (SELECT c, c FROM tree UNION SELECT below.anc, tree.c FROM below JOIN tree ON tree.p = below.c),
        allowed AS (SELECT rel_name, s.c AS src_class, d.c AS dst_class FROM declared
                    JOIN below s ON s.anc = domain_class JOIN below d ON d.anc = range_class)"""


@query("check_domain_range", sql("", "edges", "node_keys").replace("WITH", "WITH RECURSIVE", 1) + f""", {_below_sql()},
    typed AS (SELECT edge_type, CASE s.node_type {TYPE_CASES} END AS src_class, CASE d.node_type {TYPE_CASES} END AS dst_class
              FROM edges LEFT JOIN node_keys s ON s.node_id = src_id LEFT JOIN node_keys d ON d.node_id = dst_id)
    SELECT edge_type, typed.src_class, typed.dst_class, COUNT(*) AS edges, BOOL_OR(a.rel_name IS NOT NULL) AS conforms
    FROM typed LEFT JOIN allowed a ON a.rel_name = edge_type AND a.src_class = typed.src_class AND a.dst_class = typed.dst_class
    GROUP BY edge_type, typed.src_class, typed.dst_class""")
def check_domain_range(t: Tables) -> DataFrame:
    """Every edge's end nodes are looked up for their class; nothing is read off an id."""
    return q.domain_range_profile(b.kg_edges(t), b.node_keys(t), *class_catalog_frames(t))


REQUIRED_SQL = """
    SELECT 'REQUIRED' AS check_name, 'CLASS' AS scope, 'ORDER' AS rel_or_class,
           'ORDER:' || o_orderkey AS src_id, CAST(NULL AS VARCHAR) AS dst_id,
           'Missing required property ' || p AS details
    FROM orders, (VALUES ('lead_supplier'), ('tail_supplier')) v(p)
    WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)"""


@query("check_required_props", REQUIRED_SQL)
def check_required_props(t: Tables) -> DataFrame:
    return q.check_required_props(b.kg_nodes(t), md.PROPERTIES, "REQUIRED")


@query("check_unique_ids", sql("""
    SELECT split_part(node_id, ':', 2) AS id, COUNT(*) AS nodes,
           STRING_AGG(DISTINCT node_type, ', ' ORDER BY node_type) AS node_types
    FROM node_keys GROUP BY 1 HAVING COUNT(*) > 1""", "node_keys"))
def check_unique_ids(t: Tables) -> DataFrame:
    """Bare keys shared by several nodes: why ids carry their type."""
    return q.check_unique_ids(b.node_keys(t), typed=False)


VIOLATIONS_SQL = f"({CARDINALITY_SQL}) UNION ALL ({REFERENTIAL_SQL}) UNION ALL ({REQUIRED_SQL})"


def violations(t: Tables) -> DataFrame:
    """All five checks over edges that are derived and written once, and so are their counted ends."""
    edges, keys = b.written_edges(t), b.node_keys(t)
    ends = cut_lineage(q.counted_ends(edges, b.AS_OF))
    return ont.union_all([
        q.check_cardinality_all(edges, md.RELATIONS, "CARDINALITY", b.AS_OF, ends),
        q.check_referential(edges, nodes_known(t), "REFERENTIAL", ends=ends),
        q.check_domain_range(edges, keys, *class_catalog_frames(t), "DOMAIN_RANGE", ends), check_required_props(t),
        q.unique_id_violations(keys, "UNIQUE_ID")])


@query("violations_saved", sql("SELECT check_name, COUNT(*) AS violations FROM v GROUP BY check_name", "edges", "order_dim",
                               extra={"v": VIOLATIONS_SQL}))
def violations_saved(t: Tables, folder: str | None = None) -> DataFrame:
    """The violations of every check, published as one part of the violation log each and counted from the log."""
    folder = folder or f"{checkpoint_dir(t.spark).rstrip('/')}/kgspark-violations"
    rows = cut_lineage(violations(t))
    for check in ("CARDINALITY", "REFERENTIAL", "DOMAIN_RANGE", "REQUIRED", "UNIQUE_ID"):
        sinks.publish(rows.where(F.col("check_name") == check), folder, check)
    return sinks.published(t.spark, folder, rows.schema).groupBy("check_name").agg(F.count("*").alias("violations"))


@query("violation_summary", sql("""
    SELECT check_name, scope, rel_or_class, COUNT(*) AS violation_count,
           STRING_AGG(DISTINCT regexp_replace(details, '[0-9]+', 'n', 'g'), '; '
                      ORDER BY regexp_replace(details, '[0-9]+', 'n', 'g')) AS violation_types
    FROM v GROUP BY check_name, scope, rel_or_class""", "edges", "order_dim", extra={"v": VIOLATIONS_SQL}))
def violation_summary(t: Tables) -> DataFrame:
    return q.violation_summary(violations(t))


@query("violation_details", sql(f"""
    SELECT check_name, scope, rel_or_class, src_id, dst_id, details, {AS_OF} AS observed_at FROM v
    ORDER BY check_name, rel_or_class, src_id NULLS LAST, dst_id NULLS LAST, details LIMIT 20""",
                                "edges", "order_dim", extra={"v": VIOLATIONS_SQL}))
def violation_details(t: Tables, n: int = 20) -> DataFrame:
    """The newest violations; ties are settled by the violation itself."""
    return violations(t).withColumn("observed_at", F.lit(b.AS_OF)).orderBy(
        F.desc("observed_at"), "check_name", "rel_or_class", F.asc_nulls_last("src_id"),
        F.asc_nulls_last("dst_id"), "details").limit(n)


# --- semantic layer ----------------------------------------------------------------------------

def concrete_model(t: Tables) -> SemanticModel:
    """Facts and dimensions of the concrete graph with their joins, metrics and filters."""
    m = SemanticModel(
        tables={"supplied_by": b.supplied_by(t), "buys_from": b.buys_from(t), "in_order": b.in_order(t),
                "sides": b.order_sides(t), "part": b.part_dim(t), "supplier": b.supplier_dim(t),
                "customer": b.customer_dim(t), "order": b.order_dim(t),
                "lead": b.supplier_dim(t), "tail": b.supplier_dim(t)},
        keys={"part": ["part_key"], "supplier": ["supp_key"], "customer": ["cust_key"],
              "order": ["order_key"], "supplied_by": ["part_key", "supp_key"],
              "buys_from": ["cust_key", "supp_key"], "in_order": ["part_key", "order_key"],
              "sides": ["order_key"]},
        rows={"in_order": t.rows("lineitem")},
        joins=[Join("tenure_part", "supplied_by", "part", "part_key", "part_key"),
               Join("tenure_supplier", "supplied_by", "supplier", "supp_key", "supp_key"),
               Join("line_part", "in_order", "part", "part_key", "part_key"),
               Join("line_order", "in_order", "order", "order_key", "order_key"),
               Join("buyer_customer", "buys_from", "customer", "cust_key", "cust_key"),
               Join("buyer_supplier", "buys_from", "supplier", "supp_key", "supp_key"),
               Join("side_order", "sides", "order", "order_key", "order_key"),
               Join("lead_supplier", "sides", "lead", "lead_key", "supp_key"),
               Join("tail_supplier", "sides", "tail", "tail_key", "supp_key"),
               Join("order_customer", "order", "customer", "cust_key", "cust_key")])
    total = b.money(F.sum("cents"))
    m.add_metric("total_returned", "in_order", F.sum("returned"))
    m.add_metric("total_accepted", "in_order", F.sum("accepted"))
    m.add_metric("avg_quantity", "in_order", F.sum("quantity").cast("double") / F.count("quantity"))
    m.add_distinct("part_count", "in_order", "part_key")
    m.add_distinct("order_count", "in_order", "order_key")
    m.add_metric("total_value", "supplied_by", total)
    m.add_metric("avg_value", "supplied_by", total / F.count("cents"))
    m.add_metric("total_not_returned", "in_order", F.sum("not_returned"))
    m.add_metric("total_lines", "supplied_by", F.sum("lines"))
    m.add_filter("active_tenures", "supplied_by", F.col("end_date").isNull() | (F.col("end_date") >= F.lit(b.AS_OF)))
    m.add_filter("nation_3_suppliers", "supplier", F.col("nation") == "NATION_3")
    m.add_filter("nation_8_suppliers", "supplier", F.col("nation") == "NATION_8")
    m.add_filter("urgent_orders", "order", F.col("priority") == "1-URGENT")
    m.add_filter("returned_parts", "in_order", F.col("returned") > 0)
    m.add_filter("current_year_orders", "order", F.year("order_date") == b.AS_OF.year)
    return m


def abstract_model(t: Tables) -> SemanticModel:
    """Abstract classes and relations; every relation's subject and object join to their class."""
    resolved = ont.resolved_relations(b.kg_edges(t), md.CLASSES)
    keys = b.node_keys(t)
    view = lambda name: ont.abstract_relation_view(resolved, md.RELATION_MAP[name])
    m = SemanticModel(
        tables={"thing": ont.abstract_class_view(keys, md.CLASSES, "Thing"),
                "party": ont.abstract_class_view(keys, md.CLASSES, "Party"),
                "org": ont.abstract_class_view(keys, md.CLASSES, "Org"),
                "occasion": ont.abstract_class_view(keys, md.CLASSES, "Occasion"),
                "engaged_with": view("engaged_with"), "participates_in": view("participates_in"),
                "affiliated_with": view("affiliated_with")},
        keys={k: ["id"] for k in ("thing", "party", "org", "occasion")},
        joins=[Join("engaged_party", "engaged_with", "party", "subject_id", "id"),
               Join("engaged_org", "engaged_with", "org", "object_id", "id"),
               Join("participant_party", "participates_in", "party", "subject_id", "id"),
               Join("participant_occasion", "participates_in", "occasion", "object_id", "id"),
               Join("affiliated_org", "affiliated_with", "org", "subject_id", "id"),
               Join("affiliated_occasion", "affiliated_with", "occasion", "object_id", "id")])
    is_active = F.col("effective_end").isNull() | (F.col("effective_end") >= F.lit(b.AS_OF))
    days = F.datediff(F.coalesce("effective_end", F.lit(b.AS_OF)), F.col("effective_start"))
    m.add_metric("entity_count", "thing", F.count_distinct("id"))
    m.add_metric("party_count", "engaged_with", F.count_distinct("subject_id"))
    m.add_metric("relationship_count", "engaged_with", F.count("*"))
    m.add_metric("active_relationship_count", "engaged_with", F.count_if(is_active))
    m.add_metric("avg_relationship_days", "engaged_with", F.sum(days).cast("double") / F.count(days))
    for name, subtype in (("parts_only", "Part"), ("customers_only", "Customer"),
                          ("suppliers_only", "Supplier"), ("orders_only", "Order")):
        m.add_filter(name, "thing", F.col("subtype") == subtype)
    m.add_filter("active_relationships", "engaged_with", is_active)
    m.add_filter("supplied_by_relationships", "engaged_with", F.col("via_rel") == "SUPPLIED_BY")
    m.add_filter("buys_from_relationships", "engaged_with", F.col("via_rel") == "BUYS_FROM")
    return m


def governance_model(t: Tables) -> SemanticModel:
    """Catalogs of the ontology; the live tables are the node, edge and violation frames."""
    frame = lambda rows, schema: t.spark.createDataFrame([tuple(r) for r in rows], schema)
    classes = frame(md.CLASSES, "class_name string, parent_class_name string, is_abstract boolean, "
                                "node_type string, description string, status string")
    relations = frame(md.RELATIONS, "rel_name string, domain_class string, range_class string, "
                                    "cardinality string, is_hierarchical boolean, is_abstract boolean, "
                                    "inverse_rel_name string, description string, status string")
    properties = frame(md.PROPERTIES, "class_name string, node_type string, prop_name string, "
                                      "data_type string, is_required boolean, is_indexed boolean")
    rules = t.spark.createDataFrame([(r.rule_id, r.rule_kind, r.target_rel, r.is_enabled) for r in md.RULES],
                                    "rule_id string, rule_kind string, target_rel string, is_enabled boolean")
    permissions = frame(md.PERMISSIONS, "role string, subject_kind string, subject_name string, privilege string")
    actions = frame(md.ACTIONS, "action_id string, action_name string, target_class string, is_enabled boolean")
    functions = frame(md.FUNCTION_BINDINGS, "function_name string, version string, bound_kind string, bound_name string")
    m = SemanticModel(
        tables={"class": classes.withColumn("ontology", F.lit(md.ONTOLOGY)), "relation": relations,
                "property": properties, "rule": rules, "permission": permissions, "action": actions,
                "function": functions, "violation": violations(t), "live_node": b.node_keys(t).withColumn(
                "class_name", ont.class_of_type(md.CLASSES, F.col("node_type"))),
                "live_edge": b.written_edges(t).select("edge_type")},
        keys={"class": ["class_name"], "relation": ["rel_name"], "rule": ["rule_id"]},
        joins=[Join("class_parent", "property", "class", "class_name", "class_name"),
               Join("node_class", "live_node", "class", "class_name", "class_name"),
               Join("edge_relation", "live_edge", "relation", "edge_type", "rel_name"),
               Join("relation_domain", "relation", "class", "domain_class", "class_name"),
               Join("rule_relation", "rule", "relation", "target_rel", "rel_name"),
               Join("action_class", "action", "class", "target_class", "class_name"),
               Join("violation_relation", "violation", "relation", "rel_or_class", "rel_name")])
    m.add_metric("class_count", "class", F.count_distinct("class_name"))
    m.add_metric("property_count", "property", F.count_distinct("prop_name"))
    m.add_metric("relation_count", "live_edge", F.count_distinct("edge_type"))
    m.add_metric("active_rules_count", "rule", F.count_if("is_enabled"))
    m.add_metric("violation_count", "violation", F.count("*"))
    m.add_metric("permission_count", "permission", F.count_distinct(F.concat("subject_name", "role", "privilege")))
    m.add_metric("action_count", "action", F.count_distinct("action_id"))
    m.add_metric("function_count", "function", F.count_distinct("function_name"))
    m.add_metric("instance_count", "live_node", F.count("*"))
    m.add_filter("active_only", "class", F.col("status") == "ACTIVE")
    m.add_filter("enabled_rules", "rule", F.col("is_enabled"))
    m.add_filter("trade_ontology", "class", F.col("ontology") == md.ONTOLOGY)
    m.add_filter("abstract_classes", "class", F.col("is_abstract"))
    m.add_filter("concrete_classes", "class", ~F.col("is_abstract"))
    m.add_filter("required_properties", "property", F.col("is_required"))
    for name, privilege in (("admin_permissions", "ADMIN"), ("read_permissions", "READ"),
                            ("write_permissions", "WRITE")):
        m.add_filter(name, "permission", F.col("privilege") == privilege)
    m.add_filter("enabled_actions", "action", F.col("is_enabled"))
    return m


CONCRETE_METRICS = ["total_returned", "total_accepted", "avg_quantity", "part_count", "order_count",
                    "total_value", "avg_value", "total_not_returned", "total_lines"]


@query("semantic_metrics_concrete", sql("""
    SELECT brand, q.* EXCLUDE (brand), total_value, avg_value, total_lines FROM (
      SELECT brand, CAST(SUM(returned) AS BIGINT) AS total_returned,
             CAST(SUM(accepted) AS BIGINT) AS total_accepted,
             CAST(SUM(quantity) AS DOUBLE) / COUNT(quantity) AS avg_quantity,
             COUNT(DISTINCT i.part_key) AS part_count, COUNT(DISTINCT order_key) AS order_count,
             CAST(SUM(not_returned) AS BIGINT) AS total_not_returned
      FROM in_order i JOIN part_dim p ON p.part_key = i.part_key GROUP BY brand) q
    FULL JOIN (SELECT brand, CAST(SUM(value) AS DOUBLE) AS total_value,
             CAST(SUM(value) AS DOUBLE) / COUNT(value) AS avg_value, CAST(SUM(lines) AS BIGINT) AS total_lines
      FROM supplied_by e JOIN part_dim p ON p.part_key = e.part_key GROUP BY brand) r USING (brand)""",
                                        "in_order", "part_dim", "supplied_by"))
def semantic_metrics_concrete(t: Tables) -> DataFrame:
    """All concrete metrics by brand: two facts aggregated apart, joined on the dimension."""
    return concrete_model(t).query(CONCRETE_METRICS, ["part.brand"])


@query("semantic_metrics_abstract", sql(f"""
    SELECT (SELECT COUNT(*) FROM node_keys) AS entity_count, COUNT(DISTINCT src_id) AS party_count,
           COUNT(*) AS relationship_count, COUNT(*) FILTER ({ACTIVE_EDGES}) AS active_relationship_count,
           CAST(SUM(DATEDIFF('day', effective_start, COALESCE(effective_end, {AS_OF}))) AS DOUBLE) / COUNT(*)
             AS avg_relationship_days
    FROM edges WHERE edge_type IN ('SUPPLIED_BY', 'BUYS_FROM')""", "node_keys", "edges"))
def semantic_metrics_abstract(t: Tables) -> DataFrame:
    return abstract_model(t).query(["entity_count", "party_count", "relationship_count",
                                    "active_relationship_count", "avg_relationship_days"])


@query("semantic_metrics_governance", sql(f"""
    SELECT CAST({len(md.CLASSES)} AS BIGINT) AS class_count,
           CAST({len({p.prop_name for p in md.PROPERTIES})} AS BIGINT) AS property_count,
           (SELECT COUNT(DISTINCT edge_type) FROM edges) AS relation_count,
           CAST({sum(r.is_enabled for r in md.RULES)} AS BIGINT) AS active_rules_count,
           (SELECT COUNT(*) FROM v) AS violation_count,
           CAST({len(set(md.PERMISSIONS))} AS BIGINT) AS permission_count,
           CAST({len(md.ACTIONS)} AS BIGINT) AS action_count,
           CAST({len({f[0] for f in md.FUNCTION_BINDINGS})} AS BIGINT) AS function_count,
           (SELECT COUNT(*) FROM node_keys) AS instance_count""", "edges", "order_dim", "node_keys",
                                          extra={"v": VIOLATIONS_SQL}))
def semantic_metrics_governance(t: Tables) -> DataFrame:
    return governance_model(t).query([
        "class_count", "property_count", "relation_count", "active_rules_count", "violation_count",
        "permission_count", "action_count", "function_count", "instance_count"])


def _filter_counts(model: SemanticModel, names: list[str]) -> DataFrame:
    """Rows kept by each filter; the filters of one table share a single pass over it."""
    frames = []
    for table in dict.fromkeys(model.filters[n].table for n in names):
        own = [model.filters[n] for n in names if model.filters[n].table == table]
        counted = model.tables[table].agg(F.count("*").alias("_all"), *[
            F.count_if(f.expr).alias(f.name) for f in own])
        frames.append(counted.select(F.explode(F.array(*[
            F.struct(F.lit(f.name).alias("filter_name"), F.lit(table).alias("logical_table"),
                     F.col("_all").alias("rows_in"), F.col(f.name).alias("rows_kept"))
            for f in own])).alias("r")).select("r.*"))
    return ont.union_all(frames)


@query("semantic_filter_demo", sql(f"""
    SELECT 'active_tenures' AS filter_name, 'supplied_by' AS logical_table, COUNT(*) AS rows_in,
           COUNT(*) FILTER ({active()}) AS rows_kept FROM supplied_by
    UNION ALL SELECT 'nation_3_suppliers', 'supplier', COUNT(*), COUNT(*) FILTER (nation = 'NATION_3') FROM supplier_dim
    UNION ALL SELECT 'nation_8_suppliers', 'supplier', COUNT(*), COUNT(*) FILTER (nation = 'NATION_8') FROM supplier_dim
    UNION ALL SELECT 'urgent_orders', 'order', COUNT(*), COUNT(*) FILTER (priority = '1-URGENT') FROM order_dim
    UNION ALL SELECT 'returned_parts', 'in_order', COUNT(*), COUNT(*) FILTER (returned > 0) FROM in_order
    UNION ALL SELECT 'current_year_orders', 'order', COUNT(*), COUNT(*) FILTER (YEAR(order_date) = 2001) FROM order_dim
    UNION ALL SELECT 'parts_only', 'thing', COUNT(*), COUNT(*) FILTER (node_type = 'PART') FROM node_keys
    UNION ALL SELECT 'customers_only', 'thing', COUNT(*), COUNT(*) FILTER (node_type = 'CUSTOMER') FROM node_keys
    UNION ALL SELECT 'suppliers_only', 'thing', COUNT(*), COUNT(*) FILTER (node_type = 'SUPPLIER') FROM node_keys
    UNION ALL SELECT 'orders_only', 'thing', COUNT(*), COUNT(*) FILTER (node_type = 'ORDER') FROM node_keys
    UNION ALL SELECT 'active_relationships', 'engaged_with', COUNT(*), COUNT(*) FILTER ({active()}) FROM engaged
    UNION ALL SELECT 'supplied_by_relationships', 'engaged_with', COUNT(*), COUNT(*) FILTER (via_rel = 'SUPPLIED_BY') FROM engaged
    UNION ALL SELECT 'buys_from_relationships', 'engaged_with', COUNT(*), COUNT(*) FILTER (via_rel = 'BUYS_FROM') FROM engaged""",
                                   "supplied_by", "supplier_dim", "order_dim", "in_order", "node_keys", "engaged"))
def semantic_filter_demo(t: Tables) -> DataFrame:
    concrete, abstract = concrete_model(t), abstract_model(t)
    return _filter_counts(concrete, list(concrete.filters)).unionByName(
        _filter_counts(abstract, list(abstract.filters)))


@query("semantic_filter_governance", sql(f"""
    SELECT 'active_only' AS filter_name, 'class' AS logical_table, COUNT(*) AS rows_in, COUNT(*) FILTER (status = 'ACTIVE') AS rows_kept FROM class
    UNION ALL SELECT 'trade_ontology', 'class', COUNT(*), COUNT(*) FILTER (ontology = '{md.ONTOLOGY}') FROM class
    UNION ALL SELECT 'abstract_classes', 'class', COUNT(*), COUNT(*) FILTER (is_abstract) FROM class
    UNION ALL SELECT 'concrete_classes', 'class', COUNT(*), COUNT(*) FILTER (NOT is_abstract) FROM class
    UNION ALL SELECT 'enabled_rules', 'rule', COUNT(*), COUNT(*) FILTER (is_enabled) FROM rule
    UNION ALL SELECT 'required_properties', 'property', COUNT(*), COUNT(*) FILTER (is_required) FROM property
    UNION ALL SELECT 'admin_permissions', 'permission', COUNT(*), COUNT(*) FILTER (privilege = 'ADMIN') FROM permission
    UNION ALL SELECT 'read_permissions', 'permission', COUNT(*), COUNT(*) FILTER (privilege = 'READ') FROM permission
    UNION ALL SELECT 'write_permissions', 'permission', COUNT(*), COUNT(*) FILTER (privilege = 'WRITE') FROM permission
    UNION ALL SELECT 'enabled_actions', 'action', COUNT(*), COUNT(*) FILTER (is_enabled) FROM action
    UNION ALL SELECT 'violated_relations', 'relation', COUNT(DISTINCT rel_name), COUNT(DISTINCT v.rel_or_class) FROM relation
        LEFT JOIN v ON v.rel_or_class = rel_name""", "edges", "order_dim", extra={
    "v": VIOLATIONS_SQL,
    "class": "SELECT * FROM (VALUES " + ", ".join(f"('{c.class_name}', {c.is_abstract}, '{c.status}', '{md.ONTOLOGY}')" for c in md.CLASSES)
             + ") c(class_name, is_abstract, status, ontology)",
    "rule": "SELECT * FROM (VALUES " + ", ".join(f"('{r.rule_id}', {r.is_enabled})" for r in md.RULES) + ") r(rule_id, is_enabled)",
    "relation": "SELECT * FROM (VALUES " + ", ".join(f"('{r.rel_name}')" for r in md.RELATIONS) + ") r(rel_name)",
    "property": "SELECT * FROM (VALUES " + ", ".join(f"('{p.prop_name}', {p.is_required})" for p in md.PROPERTIES) + ") p(prop_name, is_required)",
    "permission": "SELECT * FROM (VALUES " + ", ".join(f"('{p[0]}', '{p[3]}')" for p in md.PERMISSIONS) + ") p(role, privilege)",
    "action": "SELECT * FROM (VALUES " + ", ".join(f"('{a[0]}', {a[3]})" for a in md.ACTIONS) + ") a(action_id, is_enabled)"}))
def semantic_filter_governance(t: Tables) -> DataFrame:
    """The ten governance filters over their catalogs, and the relations with violations in the live graph."""
    model = governance_model(t)
    hit = model.query(["violation_count"], ["relation.rel_name"]).where("rel_name IS NOT NULL")
    seen = model.tables["relation"].agg(F.count("*").alias("rows_in")).join(hit.agg(F.count("*").alias("rows_kept")), how="cross")
    return _filter_counts(model, list(model.filters)).unionByName(seen.select(
        F.lit("violated_relations").alias("filter_name"), F.lit("relation").alias("logical_table"), "rows_in", "rows_kept"))


@query("semantic_join_abstract", sql("""
    SELECT role AS subtype, COUNT(DISTINCT party_key) AS party_count, COUNT(*) AS relationship_count
    FROM engaged GROUP BY role""", "engaged"))
def semantic_join_abstract(t: Tables) -> DataFrame:
    """Two metrics of the engaged relation by the subtype of its party, over the declared join."""
    return abstract_model(t).query(["party_count", "relationship_count"], ["party.subtype"])


@query("semantic_join_demo", sql(f"""
    SELECT nation, CAST(SUM(value) AS DOUBLE) AS total_value, CAST(SUM(lines) AS BIGINT) AS total_lines
    FROM supplied_by e JOIN supplier_dim s ON s.supp_key = e.supp_key WHERE {active()} GROUP BY nation""",
                                 "supplied_by", "supplier_dim"))
def semantic_join_demo(t: Tables) -> DataFrame:
    return concrete_model(t).query(["total_value", "total_lines"], ["supplier.nation"], ["active_tenures"])
