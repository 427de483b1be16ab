"""Bitmaps, names, types, value conversion."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import bitmap, convert, docs, names
from workload.feeds import table
from workload.registry import query

MIX = "(event_id * 2654435761) % 4294967296"
BITS = "array_to_string([i FOR i IN range(0, {n}) IF (bits >> i) & 1 = 1], ',')"


def hex_entries(spark, sf):
    return table(spark, sf, "events").selectExpr(
        "event_id", f"lpad(hex({MIX}), 8, '0') AS digits", f"{MIX} AS bits"
    )


@query("bitmap_top", f"""
SELECT event_id, {BITS.format(n=40)} AS positions FROM (SELECT event_id, {MIX} AS bits FROM events)
""")
def bitmap_top(spark, sf):
    entry = F.concat(F.lit("0x"), F.col("digits"))
    return hex_entries(spark, sf).select(
        "event_id", F.array_join(bitmap.positions(entry), ",").alias("positions"))


# 72 bits: the upper byte is the user, so no 64-bit number can stand for the bitmap.
@query("bitmap_wide", """
SELECT event_id, list_sum([i FOR i IN range(0, 32) IF (lo >> i) & 1 = 1])::BIGINT AS low_sum,
  list_sum([i + 64 FOR i IN range(0, 8) IF (hi >> i) & 1 = 1])::BIGINT AS high_sum
FROM (SELECT event_id, (event_id * 2654435761) % 4294967296 AS lo, user_id % 255 + 1 AS hi
      FROM events)""")
def bitmap_wide(spark, sf):
    rows = table(spark, sf, "events").select("event_id", F.concat(
        F.lit("0x"), F.lpad(F.hex(F.col("user_id") % 255 + 1), 2, "0"), F.lit("00000000"),
        F.lpad(F.hex(F.expr(MIX)), 8, "0")).alias("entry"))
    rows = rows.withColumn("found", bitmap.positions(F.col("entry")))

    def total(keep):
        kept = F.filter("found", keep)
        add = F.aggregate(kept, F.lit(0).cast("bigint"), lambda a, b: a + b)
        return F.when(F.size(kept) > 0, add)

    return rows.select("event_id", total(lambda i: i < 64).alias("low_sum"),
                       total(lambda i: i >= 64).alias("high_sum"))


@query("bitmap_nested", f"""
SELECT event_id, CAST(event_id % 9 + 1 AS INTEGER) AS parent, {BITS.format(n=16)} AS positions
FROM (SELECT event_id, (event_id * 40503) % 65536 AS bits FROM events)""")
def bitmap_nested(spark, sf):
    rows = table(spark, sf, "events").select("event_id", F.concat(
        (F.col("event_id") % 9 + 1).cast("string"), F.lit("-0x"),
        F.lpad(F.hex((F.col("event_id") * 40503) % 65536), 4, "0")).alias("entry"))
    return rows.select("event_id", bitmap.nested_parent(F.col("entry")).alias("parent"),
                       F.array_join(bitmap.positions(F.col("entry")), ",").alias("positions"))


@query("bitmap_malformed", f"""
SELECT event_id, CASE WHEN event_id % 4 = 3 THEN {BITS.format(n=40)} ELSE '' END AS positions,
  event_id % 4 = 2 AS broken
FROM (SELECT event_id, {MIX} AS bits FROM events)""")
def bitmap_malformed(spark, sf):
    digits = F.col("digits")
    odd = F.concat(F.lit("0x1"), digits)
    letters = F.concat(F.lit("0xz"), F.substr(digits, F.lit(2)))
    no_number = F.concat(F.lit("a-0xz"), digits)
    fine = F.concat(F.lit("0X0x"), F.lower(digits))
    kind = F.col("event_id") % 4
    entry = F.when(kind == 0, odd).when(kind == 1, letters).when(kind == 2, no_number).otherwise(fine)
    return hex_entries(spark, sf).select(
        "event_id", F.array_join(bitmap.positions(entry), ",").alias("positions"),
        bitmap.is_broken_entry(entry).alias("broken"))


@query("bitmap_fields", """
SELECT event_id, (bits >> 3) & 1 = 1 AS third, (bits >> 31) & 1 = 1 AS top,
  event_id % 5 = 2 AND (user_id >> 4) & 1 = 1 AS nested, false AS beyond
FROM (SELECT event_id, user_id, (event_id * 2654435761) % 4294967296 AS bits FROM events)""")
def bitmap_fields(spark, sf):
    top = F.concat(F.lit("0x"), F.lpad(F.hex(F.expr(MIX)), 8, "0"))
    nested = F.concat((F.col("event_id") % 5).cast("string"), F.lit("-0x"),
                      F.lpad(F.hex(F.col("user_id")), 6, "0"))
    entries = bitmap.parsed_entries(F.array(top, nested, F.lit("")))
    rows = table(spark, sf, "events").select("event_id", entries.alias("e"))

    def has(parent, position):
        return bitmap.field_changed(F.col("e"), F.lit(parent), F.lit(position))

    return rows.select("event_id", has(-1, 3).alias("third"), has(-1, 31).alias("top"),
                       has(2, 4).alias("nested"), has(-1, 90).alias("beyond"))


DOC = """CASE p_size % 8 WHEN 0 THEN 'Data:DateTime:' || p_partkey WHEN 1 THEN 'ForeignKey:EntityId'
    WHEN 2 THEN 'Data:Switchable_PersonName' WHEN 3 THEN NULL WHEN 4 THEN '  '
    WHEN 5 THEN 'Data:' || p_type || ':00N' WHEN 6 THEN 'mULTIeNUM' ELSE p_brand || ': Currency : ' END"""


@query("doc_parse", f"""
SELECT p_partkey,
  CASE p_size % 8 WHEN 0 THEN 'Data' WHEN 1 THEN 'ForeignKey' WHEN 2 THEN 'Data' WHEN 5 THEN 'Data'
    WHEN 7 THEN p_brand ELSE '' END AS role,
  CASE p_size % 8 WHEN 0 THEN 'DateTime' WHEN 1 THEN 'EntityId' WHEN 2 THEN 'Switchable_PersonName'
    WHEN 5 THEN p_type WHEN 6 THEN 'mULTIeNUM' WHEN 7 THEN 'Currency' ELSE '' END AS raw_type,
  CASE p_size % 8 WHEN 0 THEN 'DateTime' WHEN 1 THEN 'EntityId' WHEN 2 THEN 'PersonName'
    WHEN 6 THEN 'MultiEnum' WHEN 7 THEN 'Currency' ELSE 'Unknown' END AS field_type,
  CASE p_size % 8 WHEN 0 THEN CAST(p_partkey AS VARCHAR) WHEN 5 THEN '00N' END AS field_id
FROM part""")
def doc_parse(spark, sf):
    rows = table(spark, sf, "part").selectExpr("p_partkey", f"{DOC} AS doc")
    return rows.select("p_partkey", docs.parse_doc(F.col("doc")).alias("d")).select("p_partkey", "d.*")


@query("type_class", """
SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 'temporal' WHEN 1 THEN 'textual' WHEN 2 THEN 'compound'
    WHEN 3 THEN 'unknown' WHEN 4 THEN 'numeric' ELSE 'boolean' END AS class,
  CASE p_size % 6 WHEN 0 THEN 'DateOnly' WHEN 1 THEN 'Phone' WHEN 2 THEN 'Text' WHEN 3 THEN 'Unknown'
    WHEN 4 THEN 'Percent' ELSE 'Boolean' END AS scalar_type,
  CASE p_size % 6 WHEN 0 THEN 'DateOnly' WHEN 1 THEN 'Phone' WHEN 2 THEN 'Address' WHEN 3 THEN 'Text'
    WHEN 4 THEN 'Percent' ELSE 'Boolean' END AS child_type
FROM part""")
def type_class(spark, sf):
    doc = """CASE p_size % 6 WHEN 0 THEN 'D:DateOnly' WHEN 1 THEN 'D:Phone' WHEN 2 THEN 'D:Address'
        WHEN 3 THEN 'D:' || p_type WHEN 4 THEN 'D:Percent' ELSE 'D:Boolean' END"""
    rows = table(spark, sf, "part").selectExpr("p_partkey", f"{doc} AS doc")
    wire = F.lit("string")
    return rows.select(
        "p_partkey", docs.type_class(docs.parse_doc(F.col("doc"))["field_type"]).alias("class"),
        docs.scalar_type(F.col("doc"), wire).alias("scalar_type"),
        docs.child_type(F.col("doc"), wire).alias("child_type"))


@query("name_norm", """
SELECT c_custkey, lower(regexp_replace(c_name || c_mktsegment, '[^A-Za-z0-9]', '', 'g')) AS name
FROM customer""")
def name_norm(spark, sf):
    name = F.concat("c_name", F.lit("_-."), "c_mktsegment", F.lit("__C"))
    return table(spark, sf, "customer").select("c_custkey", names.normalised_name(name).alias("name"))


@query("name_flatten", "SELECT p_partkey, p_brand || p_type AS name FROM part")
def name_flatten(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey", names.flattened_name(F.col("p_brand"), F.col("p_type")).alias("name"))


@query("split_name", """
SELECT s_suppkey,
  CASE WHEN s_nationkey < 8 THEN 'public' WHEN s_nationkey < 16 THEN 'db.own' ELSE 'own' END
    AS schema_name,
  CASE WHEN s_nationkey < 4 THEN '.' || s_name ELSE s_name END AS table_name,
  CASE WHEN s_nationkey < 12 THEN 'public.' || s_name
    WHEN s_nationkey < 20 THEN 'own.' || s_name END AS full_name
FROM supplier""")
def split_name(spark, sf):
    given = F.expr("""CASE WHEN s_nationkey < 4 THEN '.' || s_name WHEN s_nationkey < 8 THEN s_name
        WHEN s_nationkey < 16 THEN 'db.own.' || s_name ELSE 'own.' || s_name END""")
    owner = F.expr("CASE WHEN s_nationkey < 6 THEN NULL WHEN s_nationkey < 12 THEN ' ' ELSE ' own' END")
    name = F.expr("CASE WHEN s_nationkey < 20 THEN s_name || ' ' ELSE '  ' END")
    return table(spark, sf, "supplier").select(
        "s_suppkey", names.split_table_name(given).alias("n"),
        names.full_table_name(owner, name).alias("full_name"),
    ).select("s_suppkey", "n.*", "full_name")


@query("enum_norm", """
SELECT c_custkey, CASE c_nationkey % 4 WHEN 0 THEN 'data' WHEN 1 THEN 'event' END AS channel_type,
  CASE c_nationkey % 4 WHEN 0 THEN 'data' WHEN 2 THEN 'custom' END AS event_type,
  c_nationkey % 4 <> 1 AS event_type_valid
FROM customer""")
def enum_norm(spark, sf):
    text = F.expr("""CASE c_nationkey % 4 WHEN 0 THEN ' Data' WHEN 1 THEN 'EVENT ' WHEN 2 THEN 'Custom'
        ELSE '  ' END""")
    return table(spark, sf, "customer").select(
        "c_custkey", names.channel_type(text).alias("channel_type"),
        names.event_type(text).alias("e"),
    ).select("c_custkey", "channel_type", F.col("e.value").alias("event_type"),
             F.col("e.valid").alias("event_type_valid"))


@query("name_rules", """
SELECT p_partkey, p_size % 5 IN (0, 4) AS channel_ok,
  CASE p_size % 5 WHEN 3 THEN NULL
    ELSE regexp_replace(name || '_' || p_type || '__e', '_+', '_', 'g') END AS member_name,
  p_size % 2 = 0 AS change_entity, (p_size % 2 = 0) = (p_size % 3 = 0) AS fits_channel
FROM (SELECT *, CASE p_size % 5 WHEN 0 THEN replace(p_name, ' ', '_') || '__chn'
    WHEN 1 THEN '9' || p_type || '__chn' WHEN 2 THEN p_type || '__x__chn'
    WHEN 3 THEN '' ELSE p_type || '__chn' END AS name FROM part)""")
def name_rules(spark, sf):
    name = """CASE p_size % 5 WHEN 0 THEN replace(p_name, ' ', '_') || '__chn'
        WHEN 1 THEN '9' || p_type || '__chn' WHEN 2 THEN p_type || '__x__chn'
        WHEN 3 THEN '' ELSE p_type || '__chn' END"""
    rows = table(spark, sf, "part").selectExpr(
        "p_partkey", f"{name} AS name", "p_type || '__e' AS entity",
        "CASE WHEN p_size % 2 = 0 THEN p_type || 'ChangeEvent' ELSE p_type END AS listed",
        "CASE WHEN p_size % 3 = 0 THEN 'DATA' ELSE 'event' END AS kind")
    listed = F.col("listed")
    return rows.select(
        "p_partkey", names.is_channel_name(F.col("name")).alias("channel_ok"),
        names.member_name(F.col("name"), F.col("entity")).alias("member_name"),
        names.is_change_entity(listed).alias("change_entity"),
        names.entity_fits_channel(listed, F.col("kind")).alias("fits_channel"))


@query("channel_full_name", """
SELECT s_suppkey, CASE WHEN s_nationkey < 12 THEN '' ELSE 'ns__' END || s_name || '__chn' AS full_name
FROM supplier""")
def channel_full_name(spark, sf):
    prefix = F.expr("CASE WHEN s_nationkey < 12 THEN ' ' ELSE 'ns' END")
    return table(spark, sf, "supplier").select(
        "s_suppkey", names.channel_name(F.col("s_name"), prefix).alias("full_name"))


@query("id_domain", """
SELECT c_custkey, length(c_name) = 18 AND c_custkey % 3 > 0 AS by_name FROM customer""")
def id_domain(spark, sf):
    text = F.when(F.col("c_custkey") % 3 > 0, F.translate("c_name", "#", "x")).otherwise(F.col("c_name"))
    return table(spark, sf, "customer").select("c_custkey", names.is_record_id(text).alias("by_name"))


@query("type_family", """
SELECT p_partkey, CASE p_size % 7 WHEN 0 THEN 'Text' WHEN 1 THEN 'Decimal' WHEN 2 THEN 'Timestamp'
    WHEN 3 THEN 'Integer' WHEN 4 THEN 'Unknown' WHEN 5 THEN 'Time' ELSE 'Unknown' END AS family,
  CASE p_size % 7 WHEN 0 THEN 'Text' WHEN 1 THEN 'Decimal' WHEN 2 THEN 'Timestamp'
    WHEN 3 THEN 'Integer' WHEN 4 THEN 'Boolean' WHEN 5 THEN 'Time' ELSE 'Unknown' END AS family_mssql
FROM part""")
def type_family(spark, sf):
    declared = F.expr("""CASE p_size % 7 WHEN 0 THEN ' VarChar (' || p_size || ')'
        WHEN 1 THEN 'double precision' WHEN 2 THEN 'TIMESTAMPTZ' WHEN 3 THEN 'int4' WHEN 4 THEN 'bit'
        WHEN 5 THEN 'time with time zone' ELSE p_type END""")
    return table(spark, sf, "part").select(
        "p_partkey", names.column_family(declared).alias("family"),
        names.column_family(declared, "sqlserver").alias("family_mssql"))


@query("convert_temporal", """
SELECT event_id, date_trunc('milliseconds', ts) AS stamp, CAST(ts AS DATE) AS day,
  strftime(ts, '%H:%M:%S.%g') AS clock, CAST(NULL AS TIMESTAMP) AS too_late
FROM events""")
def convert_temporal(spark, sf):
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return table(spark, sf, "events").select("event_id", ms.alias("ms")).select(
        "event_id",
        convert.epoch_timestamp(F.col("ms")).cast("timestamp_ntz").alias("stamp"),
        convert.epoch_date(F.col("ms")).alias("day"),
        convert.day_time(F.col("ms") % 86400000).alias("clock"),
        convert.epoch_timestamp(F.col("ms") * 1000).cast("timestamp_ntz").alias("too_late"))


@query("convert_interval", """
SELECT event_id, CAST(extract('hour' FROM ts) * 3600 + extract('minute' FROM ts) * 60
    + extract('second' FROM ts) AS BIGINT) AS seconds
FROM events""")
def convert_interval(spark, sf):
    ms = F.unix_millis(F.col("ts").cast("timestamp")) % 86400000
    span = convert.day_time_interval(ms)
    seconds = F.extract(F.lit("HOUR"), span) * 3600 + F.extract(F.lit("MINUTE"), span) * 60
    return table(spark, sf, "events").select(
        "event_id", (seconds + F.floor(F.extract(F.lit("SECOND"), span))).cast("bigint").alias("seconds"))


@query("convert_scalar", """
SELECT c_custkey, CAST(c_custkey AS INTEGER) AS as_int, c_acctbal AS as_double,
  c_acctbal > 0 AS as_boolean, c_name || '''s' AS as_text, CAST(c_custkey AS VARCHAR) AS int_text,
  CASE WHEN c_nationkey > 9 THEN CAST(c_nationkey AS BIGINT) END AS text_int
FROM customer""")
def convert_scalar(spark, sf):
    mixed = F.when(F.col("c_nationkey") > 9, F.col("c_nationkey").cast("string")).otherwise(
        F.col("c_name"))
    return table(spark, sf, "customer").select(
        "c_custkey",
        convert.convert(F.col("c_custkey"), "Unknown", "int").alias("as_int"),
        convert.convert(F.col("c_acctbal"), "Currency", "double", "Decimal").alias("as_double"),
        convert.convert(F.col("c_acctbal") > 0, "Boolean", "boolean").alias("as_boolean"),
        convert.convert(F.concat("c_name", F.lit("'s")), "Text", "string", "Text").alias("as_text"),
        convert.convert(F.col("c_custkey"), "Integer", "long", "Text").alias("int_text"),
        convert.convert(mixed, "Text", "string", "Integer").alias("text_int"))


@query("value_fit", """
WITH v AS (
  SELECT c_custkey, CASE c_nationkey % 4 WHEN 0 THEN CAST(c_custkey * 1000000 AS VARCHAR) WHEN 1 THEN c_name
      WHEN 2 THEN '999999999999999999' END AS moment, c_acctbal, CAST(CAST(c_acctbal AS VARCHAR) AS DECIMAL(18, 2)) AS exact,
    CASE WHEN c_nationkey % 3 = 0 THEN c_name ELSE CAST(c_nationkey AS VARCHAR) END AS code FROM customer)
SELECT c_custkey, CASE WHEN moment NOT LIKE 'C%' AND moment NOT LIKE '99999%' THEN epoch_ms(CAST(moment AS BIGINT)) END AS stamp,
  CASE WHEN moment LIKE 'C%' THEN 'no time' WHEN moment LIKE '99999%' THEN 'out of range' END AS stamp_problem,
  CASE WHEN abs(exact) < 999.95 THEN CAST(CAST(exact AS DECIMAL(4, 1)) AS VARCHAR) END AS amount,
  CASE WHEN abs(exact) >= 999.95 THEN 'out of range' WHEN exact <> CAST(exact AS DECIMAL(18, 1)) THEN 'digits lost' END
    AS amount_problem,
  TRY_CAST(code AS BIGINT) AS code, CASE WHEN TRY_CAST(code AS BIGINT) IS NULL THEN 'no number' END AS code_problem
FROM v""")
def value_fit(spark, sf):
    """Types that do not agree: times carried as text, amounts with too many digits, codes."""
    rows = table(spark, sf, "customer").selectExpr(
        "c_custkey", """CASE c_nationkey % 4 WHEN 0 THEN CAST(c_custkey * 1000000 AS string) WHEN 1 THEN c_name
            WHEN 2 THEN '999999999999999999' END AS moment""", "c_acctbal",
        "CASE WHEN c_nationkey % 3 = 0 THEN c_name ELSE CAST(c_nationkey AS string) END AS code")
    moment, amount, code = F.col("moment"), F.col("c_acctbal"), F.col("code")
    kinds = {"stamp": (moment, "DateTime", "string"), "amount": (amount, "Currency", "double", "Decimal(4,1)"),
             "code": (code, "Text", "string", "Integer")}
    made = {n: convert.convert(*k) for n, k in kinds.items()}
    return rows.select(
        "c_custkey", made["stamp"].cast("timestamp_ntz").alias("stamp"), made["amount"].cast("string").alias("amount"),
        made["code"].alias("code"), *[convert.problem(*k).alias(f"{n}_problem") for n, k in kinds.items()])


@query("replay_id", "SELECT event_id, event_id * 4294967311 - 77 AS replay_id FROM events")
def replay_id(spark, sf):
    number = F.col("event_id") * 4294967311 - 77
    encoded = F.unhex(F.concat(F.lpad(F.hex(number), 16, "0"), F.lit("0000")))
    return table(spark, sf, "events").select(
        "event_id", convert.replay_position(encoded).alias("replay_id"))


@query("json_array", """
SELECT c_custkey, c_name || '|' || c_mktsegment AS names,
  '["' || c_name || '"]' AS encoded, CAST(NULL AS VARCHAR) AS empty
FROM customer""")
def json_array(spark, sf):
    text = F.to_json(F.array(F.col("c_name"), F.lit("  "), F.concat("c_mktsegment", F.lit(" "))))
    return table(spark, sf, "customer").select(
        "c_custkey", F.array_join(names.json_names(text), "|").alias("names"),
        names.json_encode_names(F.array(F.lit(""), F.col("c_name"))).alias("encoded"),
        names.json_encode_names(F.array(F.lit(" "), F.lit(None))).alias("empty"))


@query("fallback_chain", """
SELECT c_custkey, CASE WHEN c_acctbal > 5000 THEN c_name WHEN c_acctbal > 0 THEN c_mktsegment
    ELSE 'none' END AS label FROM customer""")
def fallback_chain(spark, sf):
    first = F.when(F.col("c_acctbal") > 5000, F.col("c_name"))
    second = F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment"))
    return table(spark, sf, "customer").select(
        "c_custkey", F.coalesce(first, second, F.lit("none")).alias("label"))
