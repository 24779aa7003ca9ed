"""Questions on the abstract model: parties, organisations and occasions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from kgspark.functions.ids import typed_id
from kgspark.functions.intervals import active_as_of, in_year, tenure_days
from kgspark.functions.props import bounded_list
from kgspark.operators import moves, ontology
from kgspark.operators.inference import infer_inverse
from kgspark.plans import binding as b, metadata as md
from kgspark.plans.checks import AS_OF, active, sql
from kgspark.plans.concrete import CONSECUTIVE_SQL, named_sides, order_id, part_id
from kgspark.plans.registry import query
from kgspark.session import dealt
from kgspark.sources.tables import Tables

HOME_ORIGINS = ("Brand#3", "NATION_3")
HOME_NATION = "NATION_3"
LONG_DAYS_SQL = f"DATEDIFF('day', start_date, COALESCE(end_date, {AS_OF}))"
# average days / 365 rounded half up to one digit, in whole numbers
YEARS_SQL = ("CAST(FLOOR((CAST({s} AS DECIMAL(38,0)) * 20 + {n} * 365) / (CAST({n} AS DECIMAL(38,0)) * 730)) "
             "AS DOUBLE) / 10")


def current(t: Tables) -> DataFrame:
    return b.party_engagements(t).where(active_as_of(b.AS_OF))


def days_so_far():
    return tenure_days(F.col("start_date"), F.col("end_date"), b.AS_OF).cast("bigint")


@query("party_personnel", sql(f"""
    SELECT DISTINCT party_id, role, party_name, supplier_name, start_date, end_date
    FROM pe WHERE {active()}""", "pe"))
def party_personnel(t: Tables, supplier_name: str | None = None) -> DataFrame:
    rows = current(t)
    if supplier_name is not None:
        rows = rows.where(F.col("supplier_name") == supplier_name)
    return rows.select(b.party_id().alias("party_id"), "role", "party_name", "supplier_name",
                       "start_date", "end_date")  # one engagement per party and supplier: distinct


@query("workforce_by_class", sql(f"""
    SELECT nation, role, COUNT(DISTINCT party_id) AS party_count FROM pe WHERE {active()}
    GROUP BY nation, role""", "pe"))
def workforce_by_class(t: Tables) -> DataFrame:
    places = b.supplier_dim(t).select("supp_key", "nation")
    return (b.engaged_with(t).where(active_as_of(b.AS_OF)).select("role", "party_key", "supp_key")
            .join(places, "supp_key").groupBy("nation", "role")
            .agg(F.count_distinct("party_key").alias("party_count")))


@query("origin_in_nation", sql(f"""
    SELECT DISTINCT role, party_id, party_name, origin, supplier_name, nation FROM pe
    WHERE origin IN ('Brand#3', 'NATION_3') AND nation = 'NATION_3' AND {active()}""", "pe"))
def origin_in_nation(t: Tables, origins=HOME_ORIGINS, nation: str = HOME_NATION) -> DataFrame:
    return current(t).where(F.col("origin").isin(*origins) & (F.col("nation") == nation)).select(
        "role", b.party_id().alias("party_id"), "party_name", "origin", "supplier_name",
        "nation")


@query("parties_named_like", sql(f"""
    SELECT DISTINCT role, party_id, party_name, supplier_name, nation FROM pe
    WHERE party_name LIKE '%1%' AND nation LIKE 'NATION_1%' AND {active()}""", "pe"))
def parties_named_like(t: Tables, name: str = "%1%", nation: str = "NATION_1%") -> DataFrame:
    """Parties whose name is like one pattern, engaged in nations whose name is like another."""
    return current(t).where(F.col("party_name").like(name) & F.col("nation").like(nation)).select(
        "role", b.party_id().alias("party_id"), "party_name", "supplier_name", "nation").distinct()


@query("engaged_abroad", sql(f"""
    SELECT DISTINCT role, party_id, party_name, home_region, supplier_name, region AS working_region,
           nation, via_rel FROM pe WHERE home_region <> region AND {active()}""", "pe"))
def engaged_abroad(t: Tables) -> DataFrame:
    """Parties engaged outside their home region; parts have no home and drop out."""
    return current(t).where(F.col("home_region") != F.col("region")).select(
        "role", b.party_id().alias("party_id"), "party_name", "home_region", "supplier_name",
        F.col("region").alias("working_region"), "nation", "via_rel")


@query("matchup_participants", sql("""
    SELECT 'Part' AS participant_type, 'IN_ORDER' AS via_rel, 'PART:' || p.part_key AS participant_id,
           part_name AS participant_name, 'ORDER:' || m.order_key AS order_id, order_date
    FROM matchups m JOIN in_order i ON i.order_key = m.order_key
    JOIN part_dim p ON p.part_key = i.part_key JOIN order_dim o ON o.order_key = m.order_key
    UNION ALL
    SELECT 'Supplier', x.via_rel, 'SUPPLIER:' || x.k, supplier_name, 'ORDER:' || x.order_key, order_date
    FROM (SELECT 'LEAD_SUPPLIER' AS via_rel, lead_key AS k, order_key FROM matchups
          UNION ALL SELECT 'TAIL_SUPPLIER', tail_key, order_key FROM matchups) x
    JOIN supplier_dim s ON s.supp_key = x.k JOIN order_dim o ON o.order_key = x.order_key""",
                                   "matchups", "in_order", "part_dim", "order_dim", "supplier_dim"))
def matchup_participants(t: Tables) -> DataFrame:
    dated = b.order_dim(t).select("order_key", "order_date")
    met = b.matchups(t).join(dated, "order_key")
    parts = (b.in_order(t).select("part_key", "order_key").join(met.select("order_key", "order_date"), "order_key")
             .join(b.part_dim(t), "part_key").select(
        F.lit("Part").alias("participant_type"), F.lit("IN_ORDER").alias("via_rel"),
        part_id().alias("participant_id"), F.col("part_name").alias("participant_name"),
        order_id().alias("order_id"), "order_date"))
    sides = met.select("order_key", "order_date", F.explode(F.array(
        F.struct(F.lit("LEAD_SUPPLIER").alias("via_rel"), F.col("lead_key").alias("supp_key")),
        F.struct(F.lit("TAIL_SUPPLIER").alias("via_rel"), F.col("tail_key").alias("supp_key")))).alias("s"))
    suppliers = sides.select("order_key", "order_date", "s.*").join(b.supplier_dim(t), "supp_key").select(
        F.lit("Supplier").alias("participant_type"), "via_rel",
        typed_id("SUPPLIER", "supp_key").alias("participant_id"),
        F.col("supplier_name").alias("participant_name"), order_id().alias("order_id"), "order_date")
    return parts.unionByName(suppliers)


@query("tenure_history", sql(f"""
    SELECT role, party_id, party_name, origin, supplier_name, region, nation, start_date, end_date,
           {LONG_DAYS_SQL} AS days FROM pe""", "pe"))
def tenure_history(t: Tables, origin: str | None = None) -> DataFrame:
    rows = b.party_engagements(t)
    if origin is not None:
        rows = rows.where(F.col("origin") == origin)
    return rows.select("role", b.party_id().alias("party_id"), "party_name", "origin", "supplier_name",
                       "region", "nation", "start_date", "end_date", days_so_far().alias("days"))


@query("party_moves", sql("""
    SELECT r.role, UPPER(r.role) || ':' || r.party_key AS party_id, a.supplier_name AS previous_supplier,
           a.nation AS previous_nation, prev_end AS left_date, c.supplier_name AS new_supplier,
           c.nation AS new_nation, start_date AS joined_date
    FROM ranked r JOIN supplier_dim a ON a.supp_key = prev_member
    JOIN supplier_dim c ON c.supp_key = r.supp_key
    WHERE prev_end < start_date AND a.nation <> c.nation""", "engaged", "supplier_dim", extra={
        "ranked": CONSECUTIVE_SQL.format(src="engaged", e="role, party_key", m="supp_key")}))
def party_moves(t: Tables, from_nation: str | None = None, to_nation: str | None = None) -> DataFrame:
    """Consecutive moves across nations for both kinds of party."""
    tenures = b.engaged_with(t).select("role", "party_key", "supp_key", "start_date", "end_date")
    steps = moves.consecutive_moves(tenures, ["role", "party_key"], "supp_key", 2 * t.rows("lineitem"))
    dim = b.supplier_dim(t)
    old = dim.select(F.col("supp_key").alias("from_member"), F.col("supplier_name").alias("previous_supplier"),
                     F.col("nation").alias("previous_nation"))
    new = dim.select(F.col("supp_key").alias("to_member"), F.col("supplier_name").alias("new_supplier"),
                     F.col("nation").alias("new_nation"))
    rows = steps.join(old, "from_member").join(new, "to_member").where("previous_nation <> new_nation")
    if from_nation is not None:
        rows = rows.where(F.col("previous_nation") == from_nation)
    if to_nation is not None:
        rows = rows.where(F.col("new_nation") == to_nation)
    return rows.select("role", b.party_id().alias("party_id"), "previous_supplier", "previous_nation",
                       "left_date", "new_supplier", "new_nation", "joined_date")


@query("most_traveled", sql("""
    SELECT role, party_id, party_name, origin, COUNT(DISTINCT supp_key) AS total_suppliers,
           COUNT(DISTINCT region) AS regions, COUNT(DISTINCT nation) AS nations,
           STRING_AGG(DISTINCT nation, ', ' ORDER BY nation) AS nation_history
    FROM pe GROUP BY role, party_id, party_name, origin HAVING COUNT(DISTINCT supp_key) >= 3""", "pe"))
def most_traveled(t: Tables, at_least: int = 3) -> DataFrame:
    """One engagement per party and supplier, so rows are suppliers; nations and regions are
    small fixed sets. Names are joined after the counting."""
    places = b.supplier_dim(t).select("supp_key", "nation", "region")
    placed = b.engaged_with(t).select("role", "party_key", "supp_key").join(places, "supp_key")
    counted = (dealt(placed, 2 * t.rows("lineitem"), "role", "party_key").groupBy("role", "party_key").agg(
        F.count("*").alias("total_suppliers"), F.size(F.collect_set("region")).cast("bigint").alias("regions"),
        F.size(F.collect_set("nation")).cast("bigint").alias("nations"),
        bounded_list("nation").alias("nation_history")).where(F.col("total_suppliers") >= at_least))
    return counted.join(b.party_dim(t), ["role", "party_key"]).select(
        "role", b.party_id().alias("party_id"), "party_name", "origin", "total_suppliers", "regions",
        "nations", "nation_history")


@query("participants_by_priority", sql("""
    SELECT participant_type, via_rel, UPPER(participant_type) || ':' || k AS participant_id, priority,
           COUNT(DISTINCT x.order_key) AS orders_involved
    FROM x JOIN order_dim o ON o.order_key = x.order_key WHERE YEAR(order_date) = 1998
    GROUP BY participant_type, via_rel, k, priority""", "in_order", "lead_tail", "order_dim", extra={
        "x": """SELECT 'Part' AS participant_type, 'IN_ORDER' AS via_rel, part_key AS k, order_key FROM in_order
                UNION ALL SELECT 'Supplier', 'LEAD_SUPPLIER', lead_key, order_key FROM lead_tail
                UNION ALL SELECT 'Supplier', 'TAIL_SUPPLIER', tail_key, order_key FROM lead_tail"""}))
def participants_by_priority(t: Tables, year: int = 1998) -> DataFrame:
    placed = b.order_dim(t).where(in_year("o_orderdate", year)).select("order_key", "priority")
    sides = b.order_sides(t).select("order_key", F.explode(F.array(
        F.struct(F.lit("LEAD_SUPPLIER").alias("via_rel"), F.col("lead_key").alias("k")),
        F.struct(F.lit("TAIL_SUPPLIER").alias("via_rel"), F.col("tail_key").alias("k")))).alias("s"))
    everyone = b.in_order(t).select(
        F.lit("Part").alias("participant_type"), F.lit("IN_ORDER").alias("via_rel"),
        F.col("part_key").alias("k"), "order_key").unionByName(
        sides.select(F.lit("Supplier").alias("participant_type"), "s.via_rel", "s.k", "order_key"))
    return (everyone.join(placed, "order_key").groupBy("participant_type", "via_rel", "k", "priority")
            .agg(F.count("*").alias("orders_involved"))  # a participant is once on an order per relation
            .select("participant_type", "via_rel",
                    F.concat(F.upper("participant_type"), F.lit(":"), F.col("k").cast("string")).alias("participant_id"),
                    "priority", "orders_involved"))


@query("tenure_stability", sql(f"""
    SELECT nation, role, COUNT(*) AS total_tenures, COUNT(DISTINCT party_id) AS unique_parties,
           CAST(SUM({LONG_DAYS_SQL}) AS DOUBLE) / COUNT(*) AS avg_days,
           {YEARS_SQL.format(s=f"SUM({LONG_DAYS_SQL})", n="COUNT(*)")} AS avg_years,
           MIN(start_date) AS earliest_start, MAX(COALESCE(end_date, {AS_OF})) AS latest_end
    FROM pe WHERE start_date IS NOT NULL GROUP BY nation, role""", "pe"))
def tenure_stability(t: Tables) -> DataFrame:
    """Party counts are taken after combining per party, which also carries the sums."""
    places = b.supplier_dim(t).select("supp_key", "nation")
    placed = b.engaged_with(t).where(F.col("start_date").isNotNull()).join(places, "supp_key")
    keys = ["nation", "role", "party_key"]
    per_party = dealt(placed, 2 * t.rows("lineitem"), *keys).groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum(days_so_far()).alias("d"), F.min("start_date").alias("s"),
        F.max(F.coalesce("end_date", F.lit(b.AS_OF))).alias("e"))
    total = per_party.groupBy("nation", "role").agg(
        F.sum("n").alias("total_tenures"), F.count("*").alias("unique_parties"), F.sum("d").alias("d"),
        F.min("s").alias("earliest_start"), F.max("e").alias("latest_end"))
    n, d = F.col("total_tenures"), F.col("d")
    years = F.floor((d.cast("decimal(30,0)") * 20 + n * 365) / (n.cast("decimal(20,0)") * 730))
    return total.select("nation", "role", "total_tenures", "unique_parties",
                        (d.cast("double") / n).alias("avg_days"),
                        (years.cast("double") / 10).alias("avg_years"), "earliest_start", "latest_end")


def _by_origin(t: Tables) -> DataFrame:
    """Active engagements with origin and place; names are not carried."""
    parties = b.party_dim(t).select("role", "party_key", "origin")
    places = b.supplier_dim(t).select("supp_key", "nation", "region")
    return (b.engaged_with(t).where(active_as_of(b.AS_OF)).join(parties, ["role", "party_key"])
            .join(places, "supp_key"))


@query("origin_distribution", sql(f"""
    SELECT origin, role, COUNT(DISTINCT party_id) AS party_count, COUNT(DISTINCT supp_key) AS suppliers,
           COUNT(DISTINCT region) AS regions, STRING_AGG(DISTINCT nation, ', ' ORDER BY nation) AS nations
    FROM pe WHERE {active()} GROUP BY origin, role""", "pe"))
def origin_distribution(t: Tables) -> DataFrame:
    return _by_origin(t).groupBy("origin", "role").agg(
        F.count_distinct("party_key").alias("party_count"), F.count_distinct("supp_key").alias("suppliers"),
        F.size(F.collect_set("region")).cast("bigint").alias("regions"),
        bounded_list("nation").alias("nations"))


@query("origin_comparison", sql(f"""
    SELECT origin, role, COUNT(DISTINCT party_id) AS party_count,
           COUNT(DISTINCT supp_key) AS suppliers_served,
           CAST(SUM({LONG_DAYS_SQL}) AS DOUBLE) / COUNT(*) AS avg_days,
           COUNT(DISTINCT nation) AS nations, STRING_AGG(DISTINCT region, ', ' ORDER BY region) AS regions
    FROM pe WHERE {active()} GROUP BY origin, role HAVING COUNT(DISTINCT party_id) >= 2""", "pe"))
def origin_comparison(t: Tables, at_least: int = 2) -> DataFrame:
    return _by_origin(t).groupBy("origin", "role").agg(
        F.count_distinct("party_key").alias("party_count"),
        F.count_distinct("supp_key").alias("suppliers_served"),
        (F.sum(days_so_far()).cast("double") / F.count("*")).alias("avg_days"),
        F.size(F.collect_set("nation")).cast("bigint").alias("nations"),
        bounded_list("region").alias("regions")).where(F.col("party_count") >= at_least)


def _inverse_rows(t: Tables, rule_id: str) -> DataFrame:
    """Resolved relations plus one rule's inferred edges; the filter on rel_name prunes the rest."""
    rule = next(r for r in md.RULES if r.rule_id == rule_id)
    edges = b.kg_edges(t)
    inferred = infer_inverse(edges, rule, md.RELATION_MAP)
    return (ontology.with_inferred(ontology.resolved_relations(edges, md.CLASSES), inferred, md.CLASSES)
            .where(F.col("rel_name") == rule.target_rel)
            .where(active_as_of(b.AS_OF, end="effective_end")))


@query("assortment_via_inverse", sql(f"""
    SELECT 'SUPPLIER:' || e.supp_key AS supplier_id, 'PART:' || p.part_key AS part_id, part_name,
           part_type, brand, start_date AS contract_start, end_date AS contract_end,
           'INVERSE' AS relationship_source
    FROM supplied_by e JOIN part_dim p ON p.part_key = e.part_key WHERE {active()}""",
                                     "supplied_by", "part_dim"))
def assortment_via_inverse(t: Tables) -> DataFrame:
    parts = b.part_dim(t).withColumn("part_id", part_id())
    rows = _inverse_rows(t, "INV_SUPPLIES")
    return rows.join(parts, rows.dst_id == parts.part_id).select(
        F.col("src_id").alias("supplier_id"), "part_id", "part_name", "part_type", "brand",
        F.col("effective_start").alias("contract_start"), F.col("effective_end").alias("contract_end"),
        F.col("source").alias("relationship_source"))


@query("customers_via_inverse", sql(f"""
    SELECT 'SUPPLIER:' || e.supp_key AS supplier_id, 'CUSTOMER:' || c.cust_key AS customer_id,
           customer_name, origin, segment, start_date AS contract_start, end_date AS contract_end,
           'INVERSE' AS relationship_source
    FROM buys_from e JOIN customer_dim c ON c.cust_key = e.cust_key WHERE {active()}""",
                                    "buys_from", "customer_dim"))
def customers_via_inverse(t: Tables) -> DataFrame:
    customers = b.customer_dim(t).withColumn("customer_id", typed_id("CUSTOMER", "cust_key"))
    rows = _inverse_rows(t, "INV_SELLS_TO")
    return rows.join(customers, rows.dst_id == customers.customer_id).select(
        F.col("src_id").alias("supplier_id"), "customer_id", "customer_name", "origin", "segment",
        F.col("effective_start").alias("contract_start"), F.col("effective_end").alias("contract_end"),
        F.col("source").alias("relationship_source"))


@query("part_order_stats", sql("""
    SELECT 'PART:' || i.part_key AS part_id, 'ORDER:' || o.order_key AS order_id, order_date, priority,
           quantity, returned, accepted, not_returned
    FROM in_order i JOIN order_dim o ON o.order_key = i.order_key""", "in_order", "order_dim"))
def part_order_stats(t: Tables, part: int | None = None) -> DataFrame:
    rows = b.in_order(t)
    if part is not None:
        rows = rows.where(F.col("part_key") == part)
    return rows.join(b.order_dim(t).select("order_key", "order_date", "priority"), "order_key").select(
        part_id().alias("part_id"), order_id().alias("order_id"), "order_date", "priority", "quantity",
        "returned", "accepted", "not_returned")


@query("supplier_diversity", sql(f"""
    SELECT supplier_name, region, nation, COUNT(DISTINCT party_id) AS total_parties,
           COUNT(DISTINCT origin) AS unique_origins,
           COUNT(DISTINCT CASE WHEN role = 'Part' THEN party_id END) AS part_count,
           COUNT(DISTINCT CASE WHEN role = 'Customer' THEN party_id END) AS customer_count,
           STRING_AGG(DISTINCT origin, ', ' ORDER BY origin) AS all_origins
    FROM pe WHERE {active()} GROUP BY supplier_name, region, nation""", "pe"))
def supplier_diversity(t: Tables) -> DataFrame:
    """Origins (brands, nations) are small fixed sets; one row per party and supplier makes
    the distinct counts plain counts."""
    parties = b.party_dim(t).select("role", "party_key", "origin")
    counted = (b.engaged_with(t).where(active_as_of(b.AS_OF)).join(parties, ["role", "party_key"])
               .groupBy("supp_key").agg(
        F.count("*").alias("total_parties"), F.size(F.collect_set("origin")).cast("bigint").alias("unique_origins"),
        F.count_if(F.col("role") == "Part").alias("part_count"),
        F.count_if(F.col("role") == "Customer").alias("customer_count"),
        bounded_list("origin").alias("all_origins")))
    return counted.join(b.supplier_dim(t), "supp_key").select(
        "supplier_name", "region", "nation", "total_parties", "unique_origins", "part_count",
        "customer_count", "all_origins")
