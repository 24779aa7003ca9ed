"""The ontology of the bound domain: classes, relations, properties, rules, catalogs."""

from __future__ import annotations

from typing import NamedTuple

from kgspark.operators.inference import Rule

ONTOLOGY = "TRADE_V1"
VERSION = "1.0"


class OntClass(NamedTuple):
    class_name: str
    parent_class_name: str | None
    is_abstract: bool
    node_type: str | None
    description: str
    status: str = "ACTIVE"


class OntRelation(NamedTuple):
    rel_name: str
    domain_class: str
    range_class: str
    cardinality: str
    is_hierarchical: bool
    is_abstract: bool
    inverse_rel_name: str
    description: str
    status: str = "ACTIVE"


class OntProperty(NamedTuple):
    class_name: str
    node_type: str
    prop_name: str
    data_type: str
    is_required: bool
    is_indexed: bool


class Derived(NamedTuple):
    class_name: str
    node_type: str
    prop_name: str
    sql_expr: str


class Action(NamedTuple):
    action_id: str
    action_name: str
    target_class: str
    is_enabled: bool


class ActionParam(NamedTuple):
    action_id: str
    param_name: str
    param_type: str
    is_required: bool


class Permission(NamedTuple):
    role: str
    subject_kind: str
    subject_name: str
    privilege: str


CLASSES = [
    OntClass("Thing", None, True, None, "Everything in the graph"),
    OntClass("Party", "Thing", True, None, "Parts and customers engaged with a supplier"),
    OntClass("Org", "Thing", True, None, "Organisations"),
    OntClass("Occasion", "Thing", True, None, "Dated happenings"),
    OntClass("Place", "Thing", True, None, "Geography"),
    OntClass("Part", "Party", False, "PART", "A part that is supplied"),
    OntClass("Customer", "Party", False, "CUSTOMER", "A buying customer"),
    OntClass("Supplier", "Org", False, "SUPPLIER", "A supplier"),
    OntClass("Order", "Occasion", False, "ORDER", "A placed order"),
    OntClass("Nation", "Place", False, "NATION", "A nation"),
    OntClass("Region", "Place", False, "REGION", "A region"),
]

RELATIONS = [
    OntRelation("engaged_with", "Party", "Org", "N:1", False, True, "engages", "Party works with an organisation"),
    OntRelation("participates_in", "Party", "Occasion", "N:N", False, True, "has_participant", "Party takes part in an occasion"),
    OntRelation("affiliated_with", "Org", "Occasion", "N:N", False, True, "involves", "Organisation is tied to an occasion"),
    OntRelation("SUPPLIED_BY", "Part", "Supplier", "N:1", False, False, "SUPPLIES", "Part is delivered by a supplier"),
    OntRelation("BUYS_FROM", "Customer", "Supplier", "N:1", False, False, "SELLS_TO", "Customer buys from a supplier"),
    OntRelation("IN_ORDER", "Part", "Order", "N:N", False, False, "CONTAINS", "Part is on an order"),
    OntRelation("LEAD_SUPPLIER", "Supplier", "Order", "1:N", False, False, "LED_BY", "Supplier of an order's first line"),
    OntRelation("TAIL_SUPPLIER", "Supplier", "Order", "1:N", False, False, "CLOSED_BY", "Supplier of an order's last line"),
    OntRelation("WITHIN", "Thing", "Place", "N:1", True, False, "HOLDS", "Lies within a place"),
]

# abstract relation -> concrete relations
RELATION_MAP = {
    "engaged_with": ("SUPPLIED_BY", "BUYS_FROM"),
    "participates_in": ("IN_ORDER",),
    "affiliated_with": ("LEAD_SUPPLIER", "TAIL_SUPPLIER"),
}

PROPERTIES = [
    OntProperty("Part", "PART", "type", "string", True, True),
    OntProperty("Part", "PART", "brand", "string", True, True),
    OntProperty("Part", "PART", "size", "int", False, False),
    OntProperty("Part", "PART", "retail_price", "double", False, False),
    OntProperty("Customer", "CUSTOMER", "nation", "string", True, True),
    OntProperty("Customer", "CUSTOMER", "segment", "string", False, True),
    OntProperty("Customer", "CUSTOMER", "balance", "double", False, False),
    OntProperty("Supplier", "SUPPLIER", "nation", "string", True, True),
    OntProperty("Supplier", "SUPPLIER", "region", "string", False, True),
    OntProperty("Supplier", "SUPPLIER", "balance", "double", False, False),
    OntProperty("Order", "ORDER", "order_date", "date", True, True),
    OntProperty("Order", "ORDER", "priority", "string", False, True),
    OntProperty("Order", "ORDER", "status", "string", False, False),
    OntProperty("Order", "ORDER", "lead_supplier", "bigint", True, False),
    OntProperty("Order", "ORDER", "tail_supplier", "bigint", True, False),
    OntProperty("Nation", "NATION", "region", "string", True, True),
]

DERIVED = [
    Derived("Order", "ORDER", "order_year", "year(order_date)"),
    Derived("Order", "ORDER", "is_urgent", "priority in ('1-URGENT', '2-HIGH')"),
    Derived("Part", "PART", "size_band", "case when size < 17 then 'small' when size < 34 then 'medium' "
                                         "else 'large' end"),
    Derived("Part", "PART", "brand_no", "cast(substring_index(brand, '#', -1) as int)"),
]

INTERFACES = {"Named": "Things with a display name", "Temporal": "Things with a date",
              "Locatable": "Things with a place"}
INTERFACE_IMPL = {"Named": ("Party", "Org", "Occasion"), "Temporal": ("Order",),
                  "Locatable": ("Customer", "Org")}

RULES = [
    Rule("INV_SUPPLIES", "INVERSE", "SUPPLIES", inverse_of="SUPPLIED_BY", description="Supplier to part"),
    Rule("INV_SELLS_TO", "INVERSE", "SELLS_TO", inverse_of="BUYS_FROM", description="Supplier to customer"),
    Rule("INV_ENGAGES", "INVERSE", "engages", inverse_of="engaged_with", description="Inverse of an abstract relation"),
    Rule("TRA_WITHIN", "TRANSITIVE", "WITHIN", description="Places within places"),
    Rule("CHAIN_OFFERED_IN", "PROPERTY_CHAIN", "OFFERED_IN", source_rel_1="SUPPLIED_BY", source_rel_2="WITHIN",
         description="Part is offered where its supplier is"),
    Rule("INV_CONTAINS", "INVERSE", "CONTAINS", inverse_of="IN_ORDER", is_enabled=False, description="Order to part"),
]

ACTIONS = [
    Action("ACT_MOVE", "Move Part", "Part", True),
    Action("ACT_ENGAGE", "Engage Customer", "Customer", True),
    Action("ACT_RECORD", "Record Order", "Order", True),
]
ACTION_PARAMS = [
    ActionParam("ACT_MOVE", "part_id", "STRING", True),
    ActionParam("ACT_MOVE", "from_supplier_id", "STRING", True),
    ActionParam("ACT_MOVE", "to_supplier_id", "STRING", True),
    ActionParam("ACT_MOVE", "value", "NUMBER", False),
    ActionParam("ACT_ENGAGE", "customer_id", "STRING", True),
    ActionParam("ACT_ENGAGE", "supplier_id", "STRING", True),
    ActionParam("ACT_ENGAGE", "value", "NUMBER", False),
]

# (function, version, kind of element it is bound to, element)
FUNCTION_BINDINGS = [
    ("tenure_age", "1.0", "LINK_TYPE", "SUPPLIED_BY"),
    ("shortest_path", "1.0", "LINK_TYPE", "IN_ORDER"),
    ("centrality", "1.0", "OBJECT_TYPE", "Supplier"),
    ("centrality", "1.0", "OBJECT_TYPE", "Part"),
    ("communities", "1.0", "OBJECT_TYPE", "Supplier"),
]

ROLES = {"viewer": "Reads parts, suppliers and orders", "analyst": "Reads everything, runs functions",
         "editor": "Reads and writes", "admin": "Full access"}

PERMISSIONS = (
    [Permission("viewer", "OBJECT_TYPE", c, "READ") for c in ("Part", "Supplier", "Order")]
    + [Permission("viewer", "LINK_TYPE", "SUPPLIED_BY", "READ")]
    + [Permission("analyst", "OBJECT_TYPE", c, "READ") for c in ("Part", "Customer", "Supplier", "Order")]
    + [Permission("analyst", "LINK_TYPE", r, "READ") for r in ("SUPPLIED_BY", "BUYS_FROM", "IN_ORDER")]
    + [Permission("analyst", "ACTION_TYPE", a, "EXECUTE") for a in ("shortest_path", "centrality")]
    + [Permission("editor", "OBJECT_TYPE", c, p) for c in ("Part", "Customer", "Supplier", "Order")
       for p in ("READ", "WRITE")]
    + [Permission("editor", "ACTION_TYPE", a.action_id, "EXECUTE") for a in ACTIONS]
    + [Permission("admin", "OBJECT_TYPE", c.class_name, "ADMIN") for c in CLASSES if not c.is_abstract]
    + [Permission("admin", "LINK_TYPE", r.rel_name, "ADMIN") for r in RELATIONS if not r.is_abstract]
)
READS = ("READ", "WRITE", "ADMIN")  # privileges that let a role see rows

# columns shown for each class
DISPLAY_COLS = {"PART": ("name", "type", "brand"), "CUSTOMER": ("name", "nation", "segment"),
                "SUPPLIER": ("name", "region", "nation"), "ORDER": ("name", "order_date", "priority")}


def grants(role: str, kind: str) -> list[str]:
    """Names of the elements of one kind a role may read; role names match in any case."""
    return sorted({p.subject_name for p in PERMISSIONS if p.role.lower() == role.lower()
                   and p.subject_kind == kind and p.privilege in READS})


def concrete_types() -> dict[str, str]:
    return {c.class_name: c.node_type for c in CLASSES if not c.is_abstract}
