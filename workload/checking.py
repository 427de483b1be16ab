"""Mapping checks on declared types and on the data."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import fixed
from tidemark.functions.names import column_family
from tidemark.operators import quality as q
from workload import feeds
from workload.feeds import table
from workload.registry import query

CLASS_SQL = """CASE WHEN field_type IN ('DateTime', 'DateOnly', 'TimeOnly') THEN 'temporal'
    WHEN field_type IN ('Integer', 'Double', 'Currency', 'Percent') THEN 'numeric'
    WHEN field_type = 'Boolean' THEN 'boolean'
    WHEN field_type IN ('Address', 'Location', 'PersonName') THEN 'compound'
    WHEN field_type = 'Unknown' THEN 'unknown' ELSE 'textual' END"""

LONGEST_SQL = """CASE field_type WHEN 'Text' THEN 255 WHEN 'Email' THEN 80 WHEN 'Url' THEN 255
    WHEN 'Phone' THEN 40 WHEN 'EntityId' THEN 18 WHEN 'StaticEnum' THEN 255 WHEN 'MultiEnum' THEN 4099
    WHEN 'StringPlusClob' THEN 131072 END"""


def fit_sql(sqlite: bool = False) -> str:
    """Level of ``field_type`` in ``family``, written out rule by rule."""
    number = "WHEN class = 'temporal' AND family = 'Integer' THEN 'Warning'" if sqlite else ""
    return f"""CASE WHEN class = 'compound' THEN 'Error' WHEN class = 'unknown' THEN 'Warning'
  WHEN family = 'Unknown' THEN 'Warning' {number}
  WHEN class = 'temporal' THEN CASE
    WHEN family = 'Text' THEN 'Compatible'
    WHEN field_type = 'DateTime' AND family = 'Timestamp' THEN 'Compatible'
    WHEN field_type = 'DateTime' AND family = 'Date' THEN 'Warning'
    WHEN field_type = 'DateOnly' AND family IN ('Date', 'Timestamp') THEN 'Compatible'
    WHEN field_type = 'TimeOnly' AND family = 'Time' THEN 'Compatible' ELSE 'Error' END
  WHEN class = 'numeric' THEN CASE WHEN family = 'Decimal' THEN 'Compatible'
    WHEN family = 'Integer' AND field_type = 'Integer' THEN 'Compatible'
    WHEN family IN ('Integer', 'Text') THEN 'Warning' ELSE 'Error' END
  WHEN class = 'boolean' THEN CASE WHEN family = 'Boolean' THEN 'Compatible'
    WHEN family IN ('Integer', 'Text') THEN 'Warning' ELSE 'Error' END
  WHEN family <> 'Text' THEN 'Error' WHEN max_length < longest THEN 'Warning'
  ELSE 'Compatible' END"""


# Every line item as a mapping of its part's type to its supplier line's column.


def declared(spark, sf):
    types = table(spark, sf, "part").selectExpr("p_partkey", f"{feeds.FIELD_TYPE} AS field_type")
    shapes = table(spark, sf, "part").selectExpr(
        "p_partkey AS l_partkey", "p_size", f"{feeds.DATA_TYPE} AS data_type",
        f"{feeds.MAX_LENGTH} AS max_length")
    lines = table(spark, sf, "lineitem").selectExpr("l_partkey", "l_suppkey * 7 AS p_partkey")
    return lines.join(shapes, "l_partkey").join(types, "p_partkey")


DECLARED_SQL = f"""declared AS (
  SELECT l_partkey, l_suppkey * 7 AS p_partkey FROM lineitem),
shaped AS (
  SELECT d.*, t.field_type, s.data_type, s.max_length FROM declared d
  JOIN (SELECT p_partkey, {feeds.FIELD_TYPE} AS field_type FROM part) t ON d.p_partkey = t.p_partkey
  JOIN (SELECT p_partkey, {feeds.DATA_TYPE} AS data_type, {feeds.MAX_LENGTH} AS max_length FROM part) s
    ON d.l_partkey = s.p_partkey),
classed AS (SELECT *, {CLASS_SQL} AS class, {feeds.FAMILY_SQL} AS family, {LONGEST_SQL} AS longest
  FROM shaped)"""


def fit_counts(spark, sf, dialect):
    # The verdict depends on declared types alone: count first, judge the few combinations.
    combinations = declared(spark, sf).groupBy("field_type", "data_type", "max_length").agg(
        F.count("*").alias("n"))
    verdict = q.fit(F.col("field_type"), column_family(F.col("data_type")), F.col("max_length"), dialect)
    judged = combinations.withColumn("level", verdict["level"])
    return judged.groupBy("field_type", "data_type", "level").agg(F.sum("n").alias("n"))


@query("fit_matrix", f"""WITH {DECLARED_SQL}
SELECT field_type, data_type, {fit_sql()} AS level, count(*) AS n FROM classed GROUP BY 1, 2, 3""")
def fit_matrix(spark, sf):
    return fit_counts(spark, sf, "postgres")


@query("fit_matrix_sqlite", f"""WITH {DECLARED_SQL}
SELECT field_type, data_type, {fit_sql(True)} AS level, count(*) AS n FROM classed GROUP BY 1, 2, 3""")
def fit_matrix_sqlite(spark, sf):
    return fit_counts(spark, sf, "sqlite")


KEY_SQL = """CASE WHEN family <> 'Text' THEN 'Error' WHEN max_length < 18 THEN 'Error'
    WHEN NOT is_unique THEN 'Warning' ELSE 'Compatible' END"""
FLAG_SQL = "CASE family WHEN 'Boolean' THEN 'Compatible' WHEN 'Integer' THEN 'Warning' ELSE 'Error' END"


@query("key_rules", f"""WITH {feeds.COLUMNS_SQL}
SELECT binding_id, column_name, {KEY_SQL} AS key_level, {FLAG_SQL} AS flag_level
FROM (SELECT *, {feeds.FAMILY_SQL} AS family FROM columns_in)""")
def key_rules(spark, sf):
    family = column_family(F.col("data_type"))
    return feeds.columns(spark, sf).select(
        "binding_id", "column_name",
        q.key_fit(family, F.col("max_length"), F.col("is_unique"))["level"].alias("key_level"),
        q.flag_fit(family)["level"].alias("flag_level"))


@query("truncation", """
SELECT count(*) FILTER (WHERE length(text) > 1000) AS text_over, max(length(text)) AS text_max,
  count(*) FILTER (WHERE length(source) > 5) AS source_over, max(length(source)) AS source_max
FROM documents""")
def truncation(spark, sf):
    return q.text_overflow(table(spark, sf, "documents"), {"text": 1000, "source": 5})


@query("fraction_loss", """
SELECT count(*) FILTER (WHERE value <> floor(value)) AS value_fraction,
  count(*) FILTER (WHERE ts <> date_trunc('day', ts)) AS ts_time FROM events""")
def fraction_loss(spark, sf):
    return q.precision_loss(table(spark, sf, "events"), ["value"], ["ts"])


@query("null_required", """
SELECT count(*) FILTER (WHERE l_tax = 0) AS tax_missing, CAST(0 AS BIGINT) AS price_missing FROM lineitem""")
def null_required(spark, sf):
    rows = table(spark, sf, "lineitem").selectExpr(
        "nullif(l_tax, 0) AS tax", "l_extendedprice AS price")
    return q.missing_required(rows, ["tax", "price"])


@query("duplicate_keys", """
SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""")
def duplicate_keys(spark, sf):
    return q.duplicate_keys(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("fk_integrity", """
SELECT l_partkey, count(*) AS n FROM lineitem
WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_type <> 'PROMO') GROUP BY 1""")
def fk_integrity(spark, sf):
    parents = table(spark, sf, "part").filter("p_type <> 'PROMO'")
    return q.missing_parents(table(spark, sf, "lineitem"), parents, "l_partkey", "p_partkey")


MAPPING_SQL = f"""{feeds.MAPPINGS_SQL}, {feeds.FIELDS_SQL}, {feeds.COLUMNS_SQL},
keys AS (SELECT binding_id, max(target_column) AS key_column FROM mappings
  WHERE source_field = 'MappedSFKey' GROUP BY 1)"""


@query("mapping_set_check", f"""WITH {MAPPING_SQL},
m AS (SELECT * FROM mappings WHERE source_field <> 'MappedSFKey')
SELECT binding_id, source_field, target_column, 'unknown field' AS problem FROM m
WHERE (binding_id, lower(source_field)) NOT IN (SELECT (binding_id, lower(field)) FROM fields)
UNION ALL
SELECT binding_id, source_field, target_column, 'unknown column' FROM m
WHERE (binding_id, lower(target_column)) NOT IN (SELECT (binding_id, lower(column_name)) FROM columns_in)
UNION ALL
SELECT binding_id, source_field, target_column, 'holds the record id' FROM m
WHERE (binding_id, target_column) IN (SELECT (binding_id, key_column) FROM keys)
UNION ALL
SELECT binding_id, NULL, min(target_column), 'column mapped twice' FROM m
GROUP BY binding_id, lower(target_column) HAVING count(*) > 1""")
def mapping_set_check(spark, sf):
    mappings = feeds.mappings(spark, sf)
    is_key = F.col("source_field") == fixed.KEY_MAPPING_FIELD
    keys = mappings.filter(is_key).groupBy("binding_id").agg(F.max("target_column").alias("key_column"))
    return q.mapping_set_problems(mappings.filter(~is_key), feeds.fields(spark, sf),
                                  feeds.columns(spark, sf), keys)


CHECKED_SQL = f"""{MAPPING_SQL},
joined AS (
  SELECT m.binding_id, m.source_field, m.target_column, c.data_type, c.max_length, c.is_unique,
    f.field_type, {feeds.FAMILY_SQL} AS family
  FROM mappings m
  LEFT JOIN columns_in c ON m.binding_id = c.binding_id AND lower(m.target_column) = lower(c.column_name)
  LEFT JOIN fields f ON m.binding_id = f.binding_id AND lower(m.source_field) = lower(f.field)),
typed AS (SELECT *, {CLASS_SQL} AS class, {LONGEST_SQL} AS longest FROM joined),
verdicts AS (
  SELECT binding_id, source_field, target_column, CASE WHEN data_type IS NULL THEN 'Blocker'
    WHEN source_field = 'MappedSFKey' THEN {KEY_SQL}
    WHEN field_type IS NULL THEN 'Blocker' ELSE {fit_sql()} END AS level FROM typed)"""


@query("mapping_check", f"WITH {CHECKED_SQL} SELECT * FROM verdicts")
def mapping_check(spark, sf):
    return q.check_mappings(feeds.mappings(spark, sf), feeds.fields(spark, sf),
                            feeds.columns(spark, sf)).drop("reason")


def described(spark, sf):
    return feeds.bindings(spark, sf).selectExpr(
        "id AS binding_id", "CASE WHEN avro_schema_id IS NULL THEN NULL ELSE entity_name END AS schema_id",
        "soft_delete_enabled", "soft_delete_column", "state")


UNWRITTEN_SQL = f"""{feeds.BINDINGS_SQL},
unwritten AS (
  SELECT c.binding_id, c.column_name FROM columns_in c
  WHERE NOT nullable AND default_value IS NULL
    AND NOT EXISTS (SELECT 1 FROM mappings m WHERE m.binding_id = c.binding_id
      AND lower(m.target_column) = lower(c.column_name))
    AND NOT EXISTS (SELECT 1 FROM bindings b WHERE b.id = c.binding_id
      AND lower(b.soft_delete_column) = lower(c.column_name)))"""


@query("not_null_unwritten", f"WITH {MAPPING_SQL}, {UNWRITTEN_SQL} SELECT * FROM unwritten")
def not_null_unwritten(spark, sf):
    return q.unwritten_required(feeds.columns(spark, sf), feeds.mappings(spark, sf),
                                described(spark, sf))


REPORT_SQL = f"""WITH {CHECKED_SQL}, {UNWRITTEN_SQL},
ready AS (SELECT * FROM bindings WHERE avro_schema_id IS NOT NULL
  AND id IN (SELECT binding_id FROM columns_in)),
flagged AS (
  SELECT r.id, r.soft_delete_column AS c, k.data_type, {feeds.FAMILY_SQL} AS family FROM ready r
  LEFT JOIN columns_in k ON k.binding_id = r.id AND lower(k.column_name) = lower(r.soft_delete_column)
  WHERE r.soft_delete_enabled),
items AS (
  SELECT id AS binding_id, '' AS item, 'Blocker' AS level, 'no target table' AS reason FROM bindings
  WHERE id NOT IN (SELECT binding_id FROM columns_in)
  UNION ALL
  SELECT id, '', 'Blocker', 'no schema' FROM bindings
  WHERE avro_schema_id IS NULL AND id IN (SELECT binding_id FROM columns_in)
  UNION ALL
  SELECT id, '', 'Blocker', 'no key mapping' FROM ready WHERE id NOT IN (
    SELECT binding_id FROM mappings WHERE source_field = 'MappedSFKey')
  UNION ALL
  SELECT id, '', 'Blocker', 'no field mapping' FROM ready WHERE id NOT IN (
    SELECT binding_id FROM mappings WHERE source_field <> 'MappedSFKey')
  UNION ALL
  SELECT binding_id, target_column, level, 'verdict' FROM verdicts
  WHERE binding_id IN (SELECT id FROM ready)
  UNION ALL
  SELECT binding_id, column_name, 'Warning', 'required but unwritten' FROM unwritten
  WHERE binding_id IN (SELECT id FROM ready)
  UNION ALL
  SELECT id, coalesce(c, ''), CASE WHEN trim(coalesce(c, '')) = '' OR data_type IS NULL THEN 'Blocker'
    ELSE {FLAG_SQL} END, 'flag' FROM flagged)"""


def items_of(spark, sf):
    return q.validation_items(described(spark, sf), feeds.mappings(spark, sf),
                              feeds.fields(spark, sf), feeds.columns(spark, sf))


@query("validation_items", f"{REPORT_SQL} SELECT binding_id, item, level FROM items")
def validation_items(spark, sf):
    return items_of(spark, sf).drop("reason")


@query("validation_report", f"""{REPORT_SQL}
SELECT b.id AS binding_id, CASE WHEN avro_schema_id IS NOT NULL THEN entity_name END AS schema_id,
  count(*) FILTER (WHERE level = 'Blocker') AS blockers, count(*) FILTER (WHERE level = 'Error') AS errors,
  count(*) FILTER (WHERE level = 'Warning') AS warnings,
  count(*) FILTER (WHERE level = 'Compatible') AS compatible,
  count(*) FILTER (WHERE level IN ('Blocker', 'Error')) = 0 AS can_activate
FROM bindings b LEFT JOIN items i ON i.binding_id = b.id GROUP BY 1, 2""")
def validation_report(spark, sf):
    return q.validation_report(described(spark, sf), items_of(spark, sf))


@query("state_after_edit", f"""{REPORT_SQL}
SELECT b.id AS binding_id, CASE WHEN any_value(state) = 'Active'
    AND count(*) FILTER (WHERE level IN ('Blocker', 'Error')) > 0 THEN 'Inactive'
    ELSE any_value(state) END AS state
FROM bindings b LEFT JOIN items i ON i.binding_id = b.id GROUP BY 1""")
def state_after_edit(spark, sf):
    rows = described(spark, sf)
    report = q.validation_report(rows, items_of(spark, sf)).select("binding_id", "can_activate")
    after = q.state_after_edit(F.col("state"), F.col("can_activate"))
    return rows.join(report, "binding_id").select("binding_id", after.alias("state"))


@query("destination_unique", """
SELECT lower(p_name || p_size) AS name, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1""")
def destination_unique(spark, sf):
    rows = table(spark, sf, "part").selectExpr("upper(p_name || p_size) AS name")
    return q.shared_destinations(rows, "name")


@query("distinct_sets", f"""WITH {feeds.MAPPINGS_SQL}
SELECT DISTINCT binding_id, lower(target_column) AS written FROM mappings""")
def distinct_sets(spark, sf):
    return feeds.mappings(spark, sf).select(
        "binding_id", F.lower("target_column").alias("written")).distinct()
