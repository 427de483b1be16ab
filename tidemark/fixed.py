"""Values that feeds and configuration tables already contain.

They are data agreed with the systems that write those feeds and tables, so they
are stated once, as they are spelled there.
"""

# Semantic field types, in the order of the type documentation.
TEXT_TYPES = [
    "Text",
    "StringPlusClob",
    "Email",
    "Url",
    "Phone",
    "EntityId",
    "ExternalId",
    "DynamicEnum",
    "StaticEnum",
    "MultiEnum",
]
BOOLEAN_TYPES = ["Boolean"]
NUMERIC_TYPES = ["Integer", "Double", "Currency", "Percent"]
TEMPORAL_TYPES = ["DateTime", "DateOnly", "TimeOnly"]
COMPOUND_TYPES = ["Address", "Location", "PersonName", "ComplexValueType"]
UNKNOWN_TYPE = "Unknown"

# Longest text each type can carry.
STANDARD_MAX_LENGTHS = {
    "Text": 255,
    "Email": 80,
    "Url": 255,
    "Phone": 40,
    "EntityId": 18,
    "ExternalId": 255,
    "DynamicEnum": 255,
    "StaticEnum": 255,
    "MultiEnum": 4099,
    "StringPlusClob": 131072,
}

# Target type names by column family.
FAMILY_TYPE_NAMES = {
    "Text": [
        "character varying", "varchar", "character", "char", "text", "nvarchar", "nchar",
        "ntext", "longtext", "mediumtext", "tinytext", "citext", "clob",
    ],
    "Integer": [
        "integer", "int", "int4", "int8", "int2", "bigint", "smallint", "mediumint",
        "tinyint", "serial", "bigserial",
    ],
    "Decimal": [
        "numeric", "decimal", "double precision", "double", "real", "float", "money",
        "smallmoney", "float8", "float4",
    ],
    "Boolean": ["boolean", "bool"],
    "Date": ["date"],
    "Time": ["time", "time without time zone", "time with time zone", "timetz"],
    "Timestamp": [
        "timestamp", "timestamp without time zone", "timestamp with time zone", "timestamptz",
        "datetime", "datetime2", "smalldatetime", "datetimeoffset",
    ],
}

# Change types of the event header.
APPLIED_KINDS = ["CREATE", "UPDATE", "DELETE", "UNDELETE"]
GAP_KINDS = ["GAP_CREATE", "GAP_UPDATE", "GAP_DELETE", "GAP_UNDELETE", "GAP_OVERFLOW"]

# Names used by feeds and configuration tables.
HEADER_FIELD = "ChangeEventHeader"
KEY_MAPPING_FIELD = "MappedSFKey"
SWITCHABLE_PREFIX = "Switchable_"
CHANGE_ENTITY_SUFFIX = "ChangeEvent"
CHANNEL_SUFFIX = "__chn"
CHANNEL_TYPES = ["data", "event"]
EVENT_TYPES = ["custom", "data", "monitoring"]
DEFAULT_SCHEMA = "public"
RECORD_ID_LENGTH = 18
KEY_COLUMN_SUGGESTION = "sf_id"
BINDING_STATES = ["Incomplete", "Active", "Inactive"]
EPOCH_MS_RANGE = (-62135596800000, 253402300799999)
DAY_MS = 86400000
