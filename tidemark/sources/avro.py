"""Schema registry rows and Avro-framed messages."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.names import column_safe, strip_topic_suffix
from tidemark.functions.scalar import col_of
from tidemark.operators.governance import is_pii_word
from tidemark.operators.shaping import latest_per_key
from tidemark.session import shuffle_parts

# Avro primitive to table type.
PRIMITIVES = {
    "string": "string", "int": "int", "long": "bigint", "float": "float", "double": "double",
    "boolean": "boolean", "bytes": "binary", "enum": "string", "fixed": "binary",
}
LOGICAL = {
    "timestamp-millis": "timestamp", "timestamp-micros": "timestamp", "date": "date", "decimal": "decimal(38,18)",
}

# Messages start with a zero byte and a 4-byte big-endian schema id.
FRAME_BYTES = 5


def frame(schema_id, payload) -> Column:
    head = F.concat(F.lit("00"), F.lpad(F.hex(col_of(schema_id).cast("long")), 8, "0"))
    return F.concat(F.unhex(head), col_of(payload).cast("binary"))


def frame_ok(value) -> Column:
    v = col_of(value)
    return F.coalesce((F.length(v) >= FRAME_BYTES) & (F.hex(F.substring(v, 1, 1)) == "00"), F.lit(False))


def schema_id(value) -> Column:
    return F.conv(F.hex(F.substring(col_of(value), 2, 4)), 16, 10).cast("long")


def payload(value) -> Column:
    return F.substring(col_of(value), FRAME_BYTES + 1, 2**31 - 1)


def split_frames(df: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """(framed messages with schema_id and payload, dead letters)."""
    good = df.where(frame_ok(value)).withColumns({"schema_id": schema_id(value), "payload": payload(value)})
    return good.drop(value), df.where(~frame_ok(value))


def avro_fields(df: DataFrame, text: str) -> DataFrame:
    """Adds ``namespace`` and ``fields`` (name, type text); a broken text gives none."""
    shape = "struct<namespace:string, fields:array<struct<name:string, type:string>>>"
    parsed = F.from_json(F.col(text), shape)
    none = F.array().cast("array<struct<name:string, type:string>>")
    return df.withColumn("_s", parsed).withColumns(
        {"namespace": F.coalesce(F.col("_s.namespace"), F.lit("")), "fields": F.coalesce(F.col("_s.fields"), none)}
    ).drop("_s")


def branch_text(type_text) -> Column:
    """The first non-null branch of a union text, or the text itself."""
    t = col_of(type_text)
    inner = F.when(t.startswith("{"), F.get_json_object(t, "$.type"))
    union = F.when(t.startswith("["), t).when(inner.startswith("["), inner)
    branches = F.filter(F.from_json(union, "array<string>"), lambda b: b != "null")
    return F.coalesce(F.get(branches, F.lit(0)), t)


def is_nullable(type_text) -> Column:
    t = col_of(type_text)
    inner = F.when(t.startswith("{"), F.get_json_object(t, "$.type"))
    union = F.when(t.startswith("["), t).when(inner.startswith("["), inner)
    return F.coalesce(F.array_contains(F.from_json(union, "array<string>"), "null"), F.lit(False))


def table_type(type_text) -> Column:
    """Table type of an Avro type text: logical types and primitives by name, else
    the kind of nested value."""
    b = branch_text(type_text)
    named = F.when(b.startswith("{"), F.get_json_object(b, "$.type")).otherwise(b)
    logical = F.when(b.startswith("{"), F.get_json_object(b, "$.logicalType"))
    ladder = F.when(named == "record", "struct").when(named == "array", "array").when(named == "map", "map").otherwise("string")
    for avro, kind in PRIMITIVES.items():
        ladder = F.when(named == avro, kind).otherwise(ladder)
    for name, kind in LOGICAL.items():
        ladder = F.when(logical == name, kind).otherwise(ladder)
    return ladder


def avro_type_map(df: DataFrame, text: str) -> DataFrame:
    """One row per schema field: source name, type, safe column, table type, nullable, personal data."""
    return (
        avro_fields(df, text)
        .withColumn("f", F.explode("fields"))
        .select(
            *df.columns,
            F.col("f.name").alias("source_field"), F.col("f.type").alias("source_type"),
            column_safe("f.name").alias("column_name"), table_type("f.type").alias("table_type"),
            is_nullable("f.type").alias("nullable"), is_pii_word("f.name").alias("pii_risk"),
        )
    )


def spark_type(avro) -> tuple[T.DataType, bool]:
    """(Spark type, nullable) of a parsed Avro type, nested types included."""
    if isinstance(avro, list):
        inner, _ = spark_type(next((b for b in avro if b != "null"), "string"))
        return inner, "null" in avro
    if isinstance(avro, str):
        return T.DataType.fromDDL(PRIMITIVES.get(avro, "string")), False
    kind = avro.get("type")
    if isinstance(kind, (list, dict)):
        return spark_type(kind)
    if avro.get("logicalType") == "decimal":
        return T.DecimalType(avro.get("precision", 38), avro.get("scale", 0)), False
    if avro.get("logicalType") in LOGICAL:
        return T.DataType.fromDDL(LOGICAL[avro["logicalType"]]), False
    if kind == "record":
        return spark_schema(avro), False
    if kind == "array":
        item, null = spark_type(avro["items"])
        return T.ArrayType(item, null), False
    if kind == "map":
        item, null = spark_type(avro["values"])
        return T.MapType(T.StringType(), item, null), False
    return spark_type(kind)


def spark_schema(schema) -> T.StructType:
    """StructType of an Avro record schema (text or parsed)."""
    record = json.loads(schema) if isinstance(schema, str) else schema
    out = T.StructType()
    for f in record.get("fields", []):
        kind, null = spark_type(f["type"])
        out.add(f["name"], kind, null)
    return out


def avro_schema(schema: T.StructType, name: str = "row") -> dict:
    """Avro record schema of a Spark schema; nullable fields become unions with null."""
    back = {"bigint": "long", "int": "int", "float": "float", "double": "double", "boolean": "boolean", "binary": "bytes"}

    def one(t: T.DataType):
        if isinstance(t, T.StructType):
            return avro_schema(t, name + "_n")
        if isinstance(t, T.ArrayType):
            return {"type": "array", "items": one(t.elementType)}
        if isinstance(t, T.MapType):
            return {"type": "map", "values": one(t.valueType)}
        if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
            return {"type": "long", "logicalType": "timestamp-millis"}
        if isinstance(t, T.DateType):
            return {"type": "int", "logicalType": "date"}
        if isinstance(t, T.DecimalType):
            return {"type": "bytes", "logicalType": "decimal", "precision": t.precision, "scale": t.scale}
        return back.get(t.simpleString(), "string")

    fields = [{"name": f.name, "type": ["null", one(f.dataType)] if f.nullable else one(f.dataType)} for f in schema]
    return {"type": "record", "name": name, "fields": fields}


def nest_registry(flat: DataFrame) -> DataFrame:
    """Registry rows in the nested listing shape: versions 1..n below one branch."""
    version = F.transform(
        F.sequence(F.lit(1), F.col("version")),
        lambda v: F.struct(v.cast("int").alias("version"), F.col("schema_text").alias("schemaText")),
    )
    return flat.select(
        F.struct(F.col("subject").alias("name"), F.col("schema_group").alias("schemaGroup")).alias("schemaMetadata"),
        F.array(F.struct(version.alias("schemaVersionInfos"))).alias("schemaBranches"),
    )


def registry_latest(raw: DataFrame) -> DataFrame:
    """Nested listing -> one row per schema with its highest version, and its topic.

    Keys and values of a topic are schemas of their own; a schema without versions stays, with version 0.
    """
    versions = (
        raw.where(F.col("schemaMetadata.name") != "")
        .select("schemaMetadata", F.explode_outer("schemaBranches").alias("b"))
        .select("schemaMetadata", F.explode_outer("b.schemaVersionInfos").alias("v"))
        .select(
            F.col("schemaMetadata.name").alias("name"),
            F.coalesce("schemaMetadata.schemaGroup", F.lit("Kafka")).alias("schema_group"),
            F.coalesce("v.version", F.lit(0)).alias("version"),
            F.col("v.schemaText").alias("schema_text"),
        )
    )
    latest = latest_per_key(versions, ["name", "schema_group"], ["version", "schema_text"], parts=shuffle_parts(raw.sparkSession))
    return latest.withColumn("topic", strip_topic_suffix("name"))


def registry_stats(registry: DataFrame, as_of_ms: int, ttl_ms: int) -> DataFrame:
    """Count and last update per group; stale when older than the time to live."""
    return registry.groupBy("schema_group").agg(
        F.count(F.lit(1)).alias("n_schemas"),
        F.max("updated_ms").alias("last_indexed_ms"),
        F.coalesce(F.lit(as_of_ms) - F.max("updated_ms") > ttl_ms, F.lit(True)).alias("is_stale"),
    )


def json_schema(messages: DataFrame, body: str) -> DataFrame:
    """Keys of JSON messages with the types seen, keys starting with '_' left out."""
    kinds = {"BIGINT": "int", "STRING": "str", "BOOLEAN": "bool", "VOID": "NoneType", "DOUBLE": "float", "FLOAT": "float"}
    spark = messages.sparkSession
    rows = spark.sql(
        "SELECT e.key AS name, schema_of_variant(e.value) AS t FROM {m} m, "
        "LATERAL variant_explode(try_parse_json(m." + body + ")) e",
        m=messages,
    )
    t = F.col("t")
    named = F.when(t.startswith("DECIMAL"), "float").when(t.startswith("ARRAY"), "list").when(t.startswith("OBJECT"), "dict")
    for variant, kind in kinds.items():
        named = F.when(t == variant, kind).otherwise(named)
    return (
        rows.where(~F.col("name").startswith("_"))
        .select("name", F.coalesce(named, F.lower(t)).alias("kind"))
        .groupBy("name")
        .agg(F.array_sort(F.collect_set("kind")).alias("types"))
    )
