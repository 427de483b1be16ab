"""Change feeds and configuration tables derived from the test tables.

Each comes twice: as a DataFrame, and as SQL text to put in a WITH clause.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.fold import FoldSpec


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# A user's life: signup creates, click and view update, error deletes, purchase restores.

USER_SPEC = FoldSpec(key=("user_id",), columns=("value", "props"), order=("ts", "event_id"))
USER_SOFT = FoldSpec(key=("user_id",), columns=("value", "props"), order=("ts", "event_id"),
                     flag="is_deleted")

USER_KIND = """CASE event_type WHEN 'signup' THEN 'CREATE' WHEN 'click' THEN 'UPDATE'
    WHEN 'view' THEN 'UPDATE' WHEN 'error' THEN 'DELETE' WHEN 'purchase' THEN 'UNDELETE' END"""


def user_changes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").selectExpr(
        "user_id", "ts", "event_id", f"{USER_KIND} AS change_type",
        "CASE WHEN event_type = 'click' AND value < 5 THEN NULL ELSE value END AS value", "props",
        "event_type IN ('signup', 'click') AS value__set",
        "event_type IN ('signup', 'view') AS props__set",
    )


USER_CHANGES_SQL = f"""changes AS (
  SELECT user_id AS k, row_number() OVER (ORDER BY ts, event_id) AS ord, {USER_KIND} AS kind,
    CASE WHEN event_type = 'click' AND value < 5 THEN NULL ELSE value END AS value, props,
    event_type IN ('signup', 'click') AS value_set, event_type IN ('signup', 'view') AS props_set
  FROM events)"""


# An order is created by its row and changed by its line items; returned items delete it.

ORDER_SPEC = FoldSpec(
    key=("orderkey",),
    columns=("price", "priority", "quantity", "status"),
    order=("phase", "shipdate", "linenumber", "partkey", "suppkey"),
)
ORDER_SOFT = FoldSpec(key=ORDER_SPEC.key, columns=ORDER_SPEC.columns, order=ORDER_SPEC.order,
                      flag="is_deleted")


def order_changes(spark: SparkSession, sf: str) -> DataFrame:
    created = table(spark, sf, "orders").selectExpr(
        "o_orderkey AS orderkey", "0 AS phase", "o_orderdate AS shipdate", "0 AS linenumber",
        "0L AS partkey", "0L AS suppkey", "'CREATE' AS change_type",
        "o_totalprice AS price", "o_orderpriority AS priority",
        "CAST(NULL AS double) AS quantity", "o_orderstatus AS status",
        "true AS price__set", "true AS priority__set", "false AS quantity__set",
        "true AS status__set",
    )
    changed = table(spark, sf, "lineitem").selectExpr(
        "l_orderkey AS orderkey", "1 AS phase", "l_shipdate AS shipdate",
        "l_linenumber AS linenumber", "l_partkey AS partkey", "l_suppkey AS suppkey",
        "CASE WHEN l_returnflag = 'R' THEN 'DELETE' ELSE 'UPDATE' END AS change_type",
        "l_extendedprice AS price", "CAST(NULL AS string) AS priority",
        "l_quantity AS quantity", "l_linestatus AS status",
        "l_discount > 0.05 AS price__set", "false AS priority__set", "true AS quantity__set",
        "l_linenumber > 3 AS status__set",
    )
    return created.unionByName(changed)


ORDER_CHANGES_SQL = """raw AS (
  SELECT o_orderkey AS k, 0 AS phase, o_orderdate AS shipdate, 0 AS linenumber, 0 AS partkey,
    0 AS suppkey, 'CREATE' AS kind, o_totalprice AS price, o_orderpriority AS priority,
    CAST(NULL AS DOUBLE) AS quantity, o_orderstatus AS status, true AS price_set,
    true AS priority_set, false AS quantity_set, true AS status_set
  FROM orders
  UNION ALL
  SELECT l_orderkey, 1, l_shipdate, l_linenumber, l_partkey, l_suppkey,
    CASE WHEN l_returnflag = 'R' THEN 'DELETE' ELSE 'UPDATE' END, l_extendedprice, NULL,
    l_quantity, l_linestatus, l_discount > 0.05, false, true, l_linenumber > 3
  FROM lineitem),
changes AS (
  SELECT *, row_number() OVER (
    PARTITION BY k ORDER BY phase, shipdate, linenumber, partkey, suppkey) AS ord FROM raw)"""


def fold_sql(
    changes: str, key: str, columns: list[str], soft: bool = False, state: str | None = None
) -> str:
    """The fold by life segments over windows: another way to the same rows.

    ``state`` is SQL giving ``k``, the columns and ``old_flag``; its rows count
    as created before everything else.
    """
    wide = ", ".join(f"{c}, {c}_set" for c in columns)
    source = f"SELECT k, ord, kind, NULL AS old_flag, {wide} FROM changes"
    if state:
        given = ", ".join(f"{c}, true" for c in columns)
        source += f" UNION ALL SELECT k, -1, 'CREATE', old_flag, {given} FROM ({state})"
    life = "0" if soft else "sum(CASE WHEN kind = 'DELETE' THEN 1 ELSE 0 END) OVER by_time"
    values = ", ".join(
        f"arg_max_null({c}, ord) FILTER (WHERE {c}_set AND (kind = 'UPDATE' OR ord = born)) AS {c}"
        for c in columns
    )
    flag = (""", coalesce(arg_max(kind = 'DELETE', ord) FILTER (WHERE kind IN ('DELETE', 'UNDELETE')),
        bool_or(old_flag)) AS is_deleted""" if soft else "")
    return f"""WITH {changes},
rows_in AS ({source}),
lives AS (SELECT *, {life} AS life FROM rows_in WINDOW by_time AS (PARTITION BY k ORDER BY ord)),
newest AS (SELECT *, max(life) OVER (PARTITION BY k) AS last_life FROM lives),
born AS (
  SELECT *, min(CASE WHEN kind = 'CREATE' THEN ord END) OVER (PARTITION BY k) AS born
  FROM newest WHERE life = last_life)
SELECT k AS {key}, {values}{flag} FROM born WHERE ord >= born GROUP BY k"""


# Configuration in the shape of the test tables: one binding per supplier, twenty
# schema revisions, fields, columns and mappings for each, all from its parts.

def registry(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").selectExpr(
        "p_partkey AS id", "'S' || p_partkey AS schema_id",
        "'E' || (p_partkey div 20) || 'ChangeEvent' AS record_name",
        "p_name AS schema_json", "p_size AS date_created",
    )


REGISTRY_SQL = """registry AS (
  SELECT p_partkey AS id, 'S' || p_partkey AS schema_id,
    'E' || (p_partkey // 20) || 'ChangeEvent' AS record_name, p_name AS schema_json,
    p_size AS date_created FROM part)"""

BINDING_STATE = """CASE WHEN s_nationkey % 5 = 0 THEN 'Inactive'
    WHEN s_nationkey % 5 = 1 THEN 'Incomplete' ELSE 'Active' END"""


def bindings(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").selectExpr(
        "s_suppkey AS id", "CASE WHEN s_nationkey <> 7 THEN s_suppkey * 20 + 3 END AS avro_schema_id",
        "'E' || s_suppkey || 'ChangeEvent' AS entity_name",
        "CASE WHEN s_nationkey = 9 THEN '' ELSE 'sales.T' || s_suppkey END AS target_table",
        f"{BINDING_STATE} AS state", "s_acctbal > 5000 AS soft_delete_enabled",
        """CASE WHEN s_nationkey < 5 THEN NULL WHEN s_nationkey < 8 THEN ' '
           WHEN s_nationkey < 12 THEN 'Col_99' ELSE 'Col_' || s_nationkey % 20
           END AS soft_delete_column""",
    )


BINDINGS_SQL = f"""bindings AS (
  SELECT s_suppkey AS id,
    CASE WHEN s_nationkey <> 7 THEN s_suppkey * 20 + 3 END AS avro_schema_id,
    'E' || s_suppkey || 'ChangeEvent' AS entity_name,
    CASE WHEN s_nationkey = 9 THEN '' ELSE 'sales.T' || s_suppkey END AS target_table,
    {BINDING_STATE} AS state, s_acctbal > 5000 AS soft_delete_enabled,
    CASE WHEN s_nationkey < 5 THEN NULL WHEN s_nationkey < 8 THEN ' '
      WHEN s_nationkey < 12 THEN 'Col_99' ELSE 'Col_' || s_nationkey % 20
      END AS soft_delete_column FROM supplier)"""


def channels(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "region").selectExpr(
        "r_regionkey AS id", "r_name || '__chn' AS full_name", "r_regionkey = 2 AS is_primary"
    )


def members(spark: SparkSession, sf: str) -> DataFrame:
    nation = table(spark, sf, "nation")
    return table(spark, sf, "supplier").join(nation, F.expr("s_nationkey = n_nationkey")).selectExpr(
        "s_suppkey AS id", "n_regionkey AS channel_id",
        "upper('E' || s_suppkey || 'ChangeEvent') AS selected_entity",
    )


PLAN_SQL = f"""{REGISTRY_SQL}, {BINDINGS_SQL},
channels AS (SELECT r_regionkey AS id, r_regionkey = 2 AS is_primary FROM region),
members AS (
  SELECT n_regionkey AS channel_id, upper('E' || s_suppkey || 'ChangeEvent') AS selected_entity
  FROM supplier JOIN nation ON s_nationkey = n_nationkey),
plan AS (
  SELECT b.id, b.entity_name, r.schema_id FROM bindings b JOIN registry r ON b.avro_schema_id = r.id
  WHERE b.state = 'Active' AND lower(b.entity_name) IN (
    SELECT lower(m.selected_entity) FROM members m JOIN channels c ON m.channel_id = c.id
    WHERE c.is_primary))"""


def events_by_schema(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as events: each names a schema id, some of them unknown."""
    return table(spark, sf, "lineitem").selectExpr(
        "CASE WHEN l_tax = 0.08 THEN 'X' || l_partkey ELSE 'S' || l_partkey END AS schema_id",
        "l_orderkey AS position", "l_returnflag AS flag", "l_linestatus AS status",
        "l_linenumber AS linenumber",
    )


EVENTS_BY_SCHEMA_SQL = """feed AS (
  SELECT CASE WHEN l_tax = 0.08 THEN 'X' || l_partkey ELSE 'S' || l_partkey END AS schema_id,
    l_orderkey AS position, l_returnflag AS flag, l_linestatus AS status,
    l_linenumber AS linenumber FROM lineitem)"""


def mappings(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").selectExpr(
        "p_partkey AS id", "p_partkey div 20 AS binding_id",
        """CASE WHEN p_partkey % 20 = 0 AND p_size > 5 THEN 'MappedSFKey'
           ELSE 'field_' || (p_partkey + p_size) % 24 END AS source_field""",
        "'COL_' || (p_partkey * 7 + p_size div 10) % 23 AS target_column",
    )


MAPPINGS_SQL = """mappings AS (
  SELECT p_partkey AS id, p_partkey // 20 AS binding_id,
    CASE WHEN p_partkey % 20 = 0 AND p_size > 5 THEN 'MappedSFKey'
      ELSE 'field_' || (p_partkey + p_size) % 24 END AS source_field,
    'COL_' || (p_partkey * 7 + p_size // 10) % 23 AS target_column FROM part)"""

FIELD_TYPE = """CASE p_partkey % 20 WHEN 0 THEN 'Text' WHEN 1 THEN 'DateTime' WHEN 2 THEN 'DateOnly'
    WHEN 3 THEN 'TimeOnly' WHEN 4 THEN 'Integer' WHEN 5 THEN 'Currency' WHEN 6 THEN 'Percent'
    WHEN 7 THEN 'Double' WHEN 8 THEN 'Boolean' WHEN 9 THEN 'Address' WHEN 10 THEN 'Email'
    WHEN 11 THEN 'Phone' WHEN 12 THEN 'EntityId' WHEN 13 THEN 'MultiEnum' WHEN 14 THEN 'Unknown'
    WHEN 15 THEN 'StringPlusClob' WHEN 16 THEN 'PersonName' WHEN 17 THEN 'Url'
    WHEN 18 THEN 'StaticEnum' ELSE 'Location' END"""


def fields(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").selectExpr(
        "p_partkey div 20 AS binding_id", "'Field_' || p_partkey % 20 AS field",
        f"{FIELD_TYPE} AS field_type",
    )


FIELDS_SQL = f"""fields AS (
  SELECT p_partkey // 20 AS binding_id, 'Field_' || p_partkey % 20 AS field,
    {FIELD_TYPE} AS field_type FROM part)"""

DATA_TYPE = """CASE p_size % 10 WHEN 0 THEN 'varchar(40)' WHEN 1 THEN 'text' WHEN 2 THEN 'BIGINT'
    WHEN 3 THEN 'numeric' WHEN 4 THEN 'boolean' WHEN 5 THEN 'date'
    WHEN 6 THEN 'timestamp without time zone' WHEN 7 THEN 'time' WHEN 8 THEN 'Character Varying'
    ELSE 'jsonb' END"""
MAX_LENGTH = "CASE p_size % 10 WHEN 0 THEN 40 WHEN 8 THEN p_size ELSE NULL END"
DEFAULT_VALUE = "CASE WHEN p_type = 'PROMO' THEN 'x' END"


def columns(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").filter("p_partkey div 20 <> 4").selectExpr(
        "p_partkey div 20 AS binding_id", "'Col_' || p_partkey % 20 AS column_name",
        "p_partkey AS position", f"{DATA_TYPE} AS data_type", f"{MAX_LENGTH} AS max_length",
        "p_size % 3 = 0 AS is_unique", "p_size % 4 > 0 AS nullable",
        f"{DEFAULT_VALUE} AS default_value",
    )


COLUMNS_SQL = f"""columns_in AS (
  SELECT p_partkey // 20 AS binding_id, 'Col_' || p_partkey % 20 AS column_name,
    p_partkey AS position, {DATA_TYPE} AS data_type, {MAX_LENGTH} AS max_length,
    p_size % 3 = 0 AS is_unique, p_size % 4 > 0 AS nullable, {DEFAULT_VALUE} AS default_value
  FROM part WHERE p_partkey // 20 <> 4)"""

FAMILY_SQL = """CASE lower(data_type) WHEN 'varchar(40)' THEN 'Text' WHEN 'text' THEN 'Text'
    WHEN 'character varying' THEN 'Text' WHEN 'bigint' THEN 'Integer' WHEN 'numeric' THEN 'Decimal'
    WHEN 'boolean' THEN 'Boolean' WHEN 'date' THEN 'Date'
    WHEN 'timestamp without time zone' THEN 'Timestamp' WHEN 'time' THEN 'Time'
    ELSE 'Unknown' END"""
