"""Registry, bindings, routing and metadata queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import catalog, outcomes
from tidemark.plans import config, routing
from tidemark.sizing import broadcast_if_small
from workload import feeds
from workload.feeds import table
from workload.registry import query


def documents_registry(spark, sf):
    """Documents as schema revisions: a name is a source and language, a date a length."""
    return table(spark, sf, "documents").selectExpr(
        "doc_id AS id", "'D' || doc_id AS schema_id", "source || '/' || lang AS record_name",
        "n_chars AS date_created")


@query("latest_per_name", """
SELECT doc_id AS id, 'D' || doc_id AS schema_id, source || '/' || lang AS record_name,
  n_chars AS date_created FROM documents
QUALIFY row_number() OVER (PARTITION BY source || '/' || lang ORDER BY n_chars DESC, doc_id DESC) = 1
""")
def latest_per_name(spark, sf):
    return config.latest_revisions(documents_registry(spark, sf))


@query("registry_scan", "SELECT page_id AS id, url AS schema_id, length(html) AS date_created FROM pages")
def registry_scan(spark, sf):
    pages = table(spark, sf, "pages").selectExpr(
        "page_id AS id", "url AS schema_id", "CAST(length(html) AS bigint) AS date_created")
    return config.registry_by_age(pages)


@query("registry_lookup", f"""WITH {feeds.REGISTRY_SQL}, {feeds.EVENTS_BY_SCHEMA_SQL}
SELECT record_name, count(*) AS events FROM feed JOIN registry USING (schema_id) GROUP BY 1""")
def registry_lookup(spark, sf):
    known = feeds.registry(spark, sf).select("schema_id", "record_name")
    # Counts per id first: the join then has one row per id on both sides.
    counts = feeds.events_by_schema(spark, sf).groupBy("schema_id").agg(F.count("*").alias("n"))
    return counts.join(known, "schema_id").groupBy("record_name").agg(F.sum("n").alias("events"))


@query("registry_get_or_insert", f"""WITH {feeds.REGISTRY_SQL}, {feeds.EVENTS_BY_SCHEMA_SQL}
SELECT schema_id, record_name FROM registry
UNION ALL SELECT DISTINCT schema_id, 'new' FROM feed
WHERE schema_id NOT IN (SELECT schema_id FROM registry)""")
def registry_get_or_insert(spark, sf):
    seen = feeds.events_by_schema(spark, sf).select("schema_id", F.lit("new").alias("record_name"))
    known = feeds.registry(spark, sf).select("schema_id", "record_name")
    return config.register(known, seen).select("schema_id", "record_name")


@query("relink", f"""WITH {feeds.REGISTRY_SQL}, {feeds.BINDINGS_SQL}, {feeds.EVENTS_BY_SCHEMA_SQL},
named AS (
  SELECT record_name, r.id, max(position) AS seen_at FROM feed f JOIN registry r USING (schema_id)
  GROUP BY 1, 2),
newest AS (
  SELECT record_name, id FROM named
  QUALIFY row_number() OVER (PARTITION BY record_name ORDER BY seen_at DESC, id DESC) = 1)
SELECT b.id, coalesce(n.id, b.avro_schema_id) AS avro_schema_id
FROM bindings b LEFT JOIN newest n ON b.entity_name = n.record_name""")
def relink(spark, sf):
    registry = feeds.registry(spark, sf)
    events = feeds.events_by_schema(spark, sf)
    order = F.struct("position", F.substr("schema_id", F.lit(2)).cast("bigint"))
    return config.relink(feeds.bindings(spark, sf), registry, events, order).select(
        "id", "avro_schema_id")


@query("bindings_scan", f"""WITH {feeds.REGISTRY_SQL}, {feeds.BINDINGS_SQL}
SELECT b.id, entity_name, schema_id, record_name FROM bindings b
LEFT JOIN registry r ON b.avro_schema_id = r.id""")
def bindings_scan(spark, sf):
    bound = config.bound_revisions(feeds.bindings(spark, sf), feeds.registry(spark, sf))
    return bound.select("id", "entity_name", "schema_id", "record_name").orderBy("entity_name")


@query("field_map", f"""WITH {feeds.MAPPINGS_SQL},
one AS (SELECT binding_id, source_field, arg_max(target_column, id) AS t FROM mappings GROUP BY 1, 2)
SELECT binding_id, string_agg(source_field || '=' || t, ',' ORDER BY source_field) AS fields
FROM one GROUP BY 1""")
def field_map(spark, sf):
    maps = config.field_maps(feeds.mappings(spark, sf))
    pairs = F.transform(F.map_entries("fields"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return maps.select("binding_id", F.array_join(pairs, ",").alias("fields"))


@query("mapping_summary", f"""WITH {feeds.MAPPINGS_SQL}
SELECT binding_id, max(target_column) FILTER (WHERE source_field = 'MappedSFKey') AS key_column,
  count(*) FILTER (WHERE source_field <> 'MappedSFKey') AS field_mappings
FROM mappings GROUP BY 1""")
def mapping_summary(spark, sf):
    return config.mapping_summary(feeds.mappings(spark, sf))


@query("primary_row", """
SELECT s_suppkey AS id, s_name AS full_name FROM supplier WHERE s_nationkey = 3
ORDER BY s_suppkey LIMIT 1""")
def primary_row(spark, sf):
    rows = table(spark, sf, "supplier").selectExpr(
        "s_suppkey AS id", "s_name AS full_name", "s_nationkey = 3 AS is_primary")
    return config.primary_channel(rows).select("id", "full_name")


@query("state_backfill", f"""WITH {feeds.BINDINGS_SQL}
SELECT id, CASE WHEN state <> 'Incomplete' THEN state WHEN target_table = '' THEN 'Incomplete'
    ELSE 'Active' END AS state FROM bindings""")
def state_backfill(spark, sf):
    state = config.backfilled_state(F.col("state"), F.col("target_table"))
    return feeds.bindings(spark, sf).select("id", state.alias("state"))


def plan_of(spark, sf):
    return config.subscription_plan(
        feeds.bindings(spark, sf), feeds.registry(spark, sf), feeds.channels(spark, sf),
        feeds.members(spark, sf))


@query("plan", f"WITH {feeds.PLAN_SQL} SELECT id, entity_name, schema_id FROM plan")
def plan(spark, sf):
    return plan_of(spark, sf).select("id", "entity_name", "schema_id")


ROUTED_SQL = f"""WITH {feeds.PLAN_SQL}, {feeds.EVENTS_BY_SCHEMA_SQL},
routed AS (
  SELECT f.*, coalesce(p.id, CASE WHEN b.state = 'Active' THEN b.id END) AS binding_id,
    CASE WHEN p.id IS NOT NULL THEN 'direct' WHEN r.schema_id IS NULL THEN 'no schema'
      WHEN b.id IS NULL THEN 'no binding' WHEN b.state <> 'Active' THEN 'inactive'
      ELSE 'by name' END AS route
  FROM feed f LEFT JOIN registry r USING (schema_id) LEFT JOIN plan p USING (schema_id)
    LEFT JOIN bindings b ON r.record_name = b.entity_name)"""


def routed(spark, sf):
    return routing.route(feeds.events_by_schema(spark, sf), plan_of(spark, sf),
                         feeds.registry(spark, sf), feeds.bindings(spark, sf))


@query("route", f"""{ROUTED_SQL}
SELECT binding_id, route, count(*) AS events FROM routed GROUP BY 1, 2""")
def route(spark, sf):
    return outcomes.outcome_counts(routed(spark, sf), ["binding_id", "route"])


@query("route_fallback", f"""{ROUTED_SQL}
SELECT schema_id, binding_id, count(*) AS events FROM routed WHERE route = 'by name' GROUP BY 1, 2""")
def route_fallback(spark, sf):
    rows = routed(spark, sf).filter("route = 'by name'")
    return outcomes.outcome_counts(rows, ["schema_id", "binding_id"])


@query("drop_inactive", f"""{ROUTED_SQL}
SELECT position, schema_id, linenumber, flag FROM routed WHERE binding_id IS NULL""")
def drop_inactive(spark, sf):
    return routed(spark, sf).filter("binding_id IS NULL").select(
        "position", "schema_id", "linenumber", "flag")


@query("current_revisions", f"""WITH {feeds.REGISTRY_SQL}
SELECT record_name AS entity_name, arg_max(schema_id, (date_created, id)) AS schema_id
FROM registry GROUP BY 1""")
def current_revisions(spark, sf):
    known = feeds.registry(spark, sf).withColumnRenamed("record_name", "entity_name")
    return routing.current_revisions(known, F.struct("date_created", "id"))


KIND_OF = """CASE linenumber WHEN 1 THEN 'CREATE' WHEN 2 THEN 'UPDATE' WHEN 3 THEN 'DELETE'
    WHEN 4 THEN 'UNDELETE' WHEN 5 THEN 'GAP_UPDATE' WHEN 6 THEN 'SNAPSHOT' END"""


@query("dispatch", f"""{ROUTED_SQL},
judged AS (
  SELECT {KIND_OF} AS kind,
    soft_delete_enabled AND trim(coalesce(soft_delete_column, '')) <> '' AS soft
  FROM routed r JOIN bindings b ON r.binding_id = b.id)
SELECT CASE kind WHEN 'CREATE' THEN 'insert' WHEN 'UPDATE' THEN 'update'
    WHEN 'DELETE' THEN CASE WHEN soft THEN 'mark' ELSE 'delete' END
    WHEN 'UNDELETE' THEN CASE WHEN soft THEN 'restore' END END AS effect,
  CASE WHEN kind IS NULL THEN 'bad header' WHEN kind LIKE 'GAP%' THEN 'unsupported type'
    WHEN kind = 'SNAPSHOT' THEN 'unknown type'
    WHEN kind = 'UNDELETE' AND NOT soft THEN 'undelete skipped' END AS outcome,
  count(*) AS events
FROM judged GROUP BY 1, 2""")
def dispatch(spark, sf):
    soft = routing.marks_deleted(F.col("soft_delete_enabled"), F.col("soft_delete_column"))
    known = feeds.bindings(spark, sf).select(F.col("id").alias("binding_id"), soft.alias("soft"))
    judged = routed(spark, sf).join(broadcast_if_small(known), "binding_id").withColumn("kind", F.expr(KIND_OF))
    kind = F.col("kind")
    return outcomes.outcome_counts(
        judged.select(routing.effective_kind(kind, F.col("soft")).alias("effect"),
                      routing.kind_outcome(kind, F.col("soft")).alias("outcome")),
        ["effect", "outcome"])


@query("latest_position", f"""WITH {feeds.EVENTS_BY_SCHEMA_SQL}
SELECT schema_id, max(position) AS latest_position FROM feed GROUP BY 1""")
def latest_position(spark, sf):
    return outcomes.latest_position(feeds.events_by_schema(spark, sf), F.col("position"), ["schema_id"])


@query("entity_filter", """
SELECT value, CASE WHEN trim(label) = '' THEN value ELSE label END AS label FROM (
  SELECT CASE WHEN p_size < 4 THEN p_size || p_type WHEN p_size < 6 THEN ' '
      ELSE p_type || p_partkey || CASE WHEN p_size % 2 = 0 THEN 'ChangeEvent' ELSE '__e' END END
      AS value, CASE WHEN p_size > 30 THEN ' ' ELSE p_name END AS label, p_size <> 40 AS active
  FROM part) WHERE active AND value LIKE '%ChangeEvent' AND NOT regexp_matches(value, '^[0-9]')""")
def entity_filter(spark, sf):
    rows = table(spark, sf, "part").selectExpr(
        """CASE WHEN p_size < 4 THEN p_size || p_type WHEN p_size < 6 THEN ' '
           ELSE p_type || p_partkey || CASE WHEN p_size % 2 = 0 THEN 'ChangeEvent' ELSE '__e' END
           END AS value""",
        "CASE WHEN p_size > 30 THEN ' ' ELSE p_name END AS label", "p_size <> 40 AS active")
    return config.selectable_entities(rows, "data")


@query("counts", "SELECT count(*) AS n, count(*) FILTER (WHERE p_size > 25) AS large FROM part")
def counts(spark, sf):
    return table(spark, sf, "part").agg(
        F.count("*").alias("n"), F.count_if(F.col("p_size") > 25).alias("large"))


# Constraints: one per part, its columns from the line items that name it.


def metadata(spark, sf):
    constraints = table(spark, sf, "part").selectExpr(
        "'app' AS constraint_schema", "'k' || p_partkey AS constraint_name",
        """CASE WHEN p_size % 3 = 0 THEN 'FOREIGN KEY' WHEN p_size % 3 = 1 THEN 'PRIMARY KEY'
           ELSE 'UNIQUE' END AS constraint_type""", "p_brand AS table_name")
    key_columns = table(spark, sf, "lineitem").selectExpr(
        "'app' AS constraint_schema", "'k' || l_partkey AS constraint_name",
        "'c' || l_linenumber AS column_name", "l_linenumber AS ordinal").distinct()
    referenced = table(spark, sf, "part").filter("p_size % 3 = 0").selectExpr(
        "'app' AS constraint_schema", "'k' || p_partkey AS constraint_name",
        "p_type AS table_name", "'r' || p_size AS column_name", "1 AS ordinal")
    return constraints, key_columns, referenced


METADATA_SQL = """tc AS (
  SELECT 'app' AS s, 'k' || p_partkey AS n, CASE WHEN p_size % 3 = 0 THEN 'FOREIGN KEY'
    WHEN p_size % 3 = 1 THEN 'PRIMARY KEY' ELSE 'UNIQUE' END AS constraint_type,
    p_brand AS table_name FROM part),
kcu AS (SELECT DISTINCT 'app' AS s, 'k' || l_partkey AS n, 'c' || l_linenumber AS column_name,
    l_linenumber AS ordinal FROM lineitem),
ccu AS (SELECT 'app' AS s, 'k' || p_partkey AS n, p_type AS table_name, 'r' || p_size AS column_name
    FROM part WHERE p_size % 3 = 0)"""


@query("key_list", f"""WITH {METADATA_SQL}
SELECT tc.n AS constraint_name, tc.constraint_type, tc.table_name,
  string_agg(kcu.column_name, ', ' ORDER BY ordinal) AS column_list,
  ccu.table_name AS referenced_table, ccu.column_name AS referenced_column
FROM tc LEFT JOIN kcu ON tc.n = kcu.n AND tc.s = kcu.s LEFT JOIN ccu ON tc.n = ccu.n AND tc.s = ccu.s
GROUP BY ALL""")
def key_list(spark, sf):
    return catalog.constraint_list(*metadata(spark, sf)).drop("constraint_schema").orderBy(
        "constraint_type", "constraint_name")


@query("fk_list", f"""WITH {METADATA_SQL}
SELECT tc.n AS constraint_name, string_agg(kcu.column_name, ', ' ORDER BY ordinal) AS column_list,
  ccu.table_name AS referenced_table, any_value(ccu.column_name) AS referenced_column_list
FROM tc JOIN kcu ON tc.n = kcu.n JOIN ccu ON tc.n = ccu.n
WHERE tc.constraint_type = 'FOREIGN KEY' GROUP BY tc.n, ccu.table_name""")
def fk_list(spark, sf):
    return catalog.foreign_keys(*metadata(spark, sf)).select(
        "constraint_name", "column_list", "referenced_table", "referenced_column_list")


@query("column_constraints", f"""WITH {METADATA_SQL}
SELECT tc.n AS constraint_name, tc.constraint_type, kcu.column_name,
  ccu.table_name AS referenced_table, ccu.column_name AS referenced_column
FROM tc JOIN kcu ON tc.n = kcu.n LEFT JOIN ccu ON tc.n = ccu.n""")
def column_constraints(spark, sf):
    return catalog.column_constraints(*metadata(spark, sf)).select(
        "constraint_name", "constraint_type", "column_name", "referenced_table", "referenced_column")


def offered_columns(spark, sf):
    return table(spark, sf, "part").selectExpr(
        "p_partkey div 20 AS binding_id", "p_partkey AS position",
        "'FIELD-' || p_partkey % 11 || CASE WHEN p_size > 25 THEN '__c' ELSE '' END AS column_name")


@query("name_match", f"""WITH {feeds.FIELDS_SQL}, {feeds.MAPPINGS_SQL},
offered AS (
  SELECT p_partkey // 20 AS binding_id, 'field' || p_partkey % 11 AS name,
    arg_min('FIELD-' || p_partkey % 11 || CASE WHEN p_size > 25 THEN '__c' ELSE '' END, p_partkey)
      AS column_name FROM part GROUP BY 1, 2),
mapped AS (
  SELECT binding_id, lower(source_field) AS f, min(target_column) AS c FROM mappings GROUP BY 1, 2),
taken AS (SELECT DISTINCT binding_id, 'FIELD-' || substr(target_column, 5) AS c FROM mappings)
SELECT f.binding_id, f.field, m.c AS mapped_column,
  CASE WHEN m.c IS NULL AND t.c IS NULL THEN o.column_name END AS suggested_column
FROM fields f LEFT JOIN mapped m ON f.binding_id = m.binding_id AND lower(f.field) = m.f
LEFT JOIN offered o ON f.binding_id = o.binding_id AND replace(lower(f.field), '_', '') = o.name
LEFT JOIN taken t ON t.binding_id = o.binding_id AND t.c = o.column_name""")
def name_match(spark, sf):
    mappings = feeds.mappings(spark, sf)
    renamed = F.concat(F.lit("FIELD-"), F.substr("target_column", F.lit(5)))
    also_taken = mappings.select("binding_id", F.lit("MappedSFKey").alias("source_field"),
                                 renamed.alias("target_column"))
    both = mappings.select("binding_id", "source_field", "target_column").unionByName(also_taken)
    return catalog.suggested_columns(
        feeds.fields(spark, sf), offered_columns(spark, sf),
        both.filter("source_field <> 'MappedSFKey' OR target_column LIKE 'FIELD%'"))


@query("table_bound", f"""WITH {feeds.BINDINGS_SQL}
SELECT 'SALES.t' || p_partkey AS full_name, entity_name AS bound_entity FROM part
LEFT JOIN bindings ON lower(target_table) = 'sales.t' || p_partkey""")
def table_bound(spark, sf):
    tables = table(spark, sf, "part").selectExpr("'SALES.t' || p_partkey AS full_name")
    return catalog.bound_tables(tables, feeds.bindings(spark, sf))


@query("column_mapped", f"""WITH {feeds.COLUMNS_SQL}, {feeds.MAPPINGS_SQL},
first AS (SELECT binding_id, lower(target_column) AS c, arg_min(source_field, id) AS mapped_field
  FROM mappings GROUP BY 1, 2)
SELECT c.binding_id, c.column_name, mapped_field FROM columns_in c
LEFT JOIN first f ON c.binding_id = f.binding_id AND lower(c.column_name) = f.c""")
def column_mapped(spark, sf):
    return catalog.mapped_columns(feeds.columns(spark, sf), feeds.mappings(spark, sf)).select(
        "binding_id", "column_name", "mapped_field")


# Bindings that were switched and sent elsewhere over time: up to four versions each.
VERSIONS = """CASE v WHEN 0 THEN DATE '1992-06-01' WHEN 1 THEN DATE '1994-01-01' WHEN 2 THEN DATE '1996-07-15'
    ELSE DATE '1998-01-01' END"""


@query("bindings_as_of", f"""
WITH versions AS (
  SELECT s_suppkey AS binding_id, {VERSIONS} AS since, CASE WHEN (s_nationkey + v) % 3 = 0 THEN 'Inactive' ELSE 'Active' END AS state,
    'sales.T' || s_suppkey || '_' || v AS target_table
  FROM supplier, (SELECT unnest([0, 1, 2, 3]) AS v) WHERE s_suppkey % 4 >= v)
SELECT l_suppkey AS binding_id, state, target_table, count(*) AS events
FROM lineitem ASOF LEFT JOIN versions ON l_suppkey = binding_id AND l_shipdate >= since GROUP BY ALL""")
def bindings_as_of(spark, sf):
    versions = table(spark, sf, "supplier").selectExpr("*", "explode(array(0, 1, 2, 3)) AS v").filter(
        "s_suppkey % 4 >= v").selectExpr(
        "s_suppkey AS binding_id", f"{VERSIONS} AS since",
        "CASE WHEN (s_nationkey + v) % 3 = 0 THEN 'Inactive' ELSE 'Active' END AS state",
        "'sales.T' || s_suppkey || '_' || v AS target_table")
    events = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("binding_id"), "l_shipdate")
    return config.as_of(events, versions, ["binding_id"], "since", F.col("l_shipdate")).groupBy(
        "binding_id", "state", "target_table").agg(F.count("*").alias("events"))
