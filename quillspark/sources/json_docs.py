"""Documents from JSON: plain ones, ones with dynamic fields, and change requests in envelopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import DYNAMIC, Schema

KINDS = ("INDEX", "DELETE", "UPDATE", "REPLACE", "DELETE_INDEX", "SWAP_INDEX")
CONTROLS = "_type", "_tokenize", "_omitnorms", "_snippet", "_docvalues", "_multi", "_omitfreqs"


def dynamic_map(raw: Column) -> Column:
    """``_dynamic``, an array of objects with one own key each, as a map name -> text.

    Keys that begin with ``_`` are controls. An object with two own keys is an error.
    """
    items = F.from_json(F.get_json_object(raw, "$._dynamic"), T.ArrayType(T.MapType(T.StringType(), T.StringType())))
    own = F.transform(items, lambda m: F.map_filter(m, lambda k, _: ~F.startswith(k, F.lit("_"))))
    checked = F.transform(
        own, lambda m: F.when(F.size(m) > 1, F.raise_error(F.lit("a dynamic field has two names")).cast("map<string,string>")).otherwise(m)
    )
    pairs = F.flatten(F.transform(checked, lambda m: F.map_entries(m)))
    last = F.aggregate(
        pairs, F.expr("map_from_arrays(cast(array() as array<string>), cast(array() as array<string>))"),
        lambda a, kv: F.map_concat(F.map_filter(a, lambda k, _: k != kv["key"]), F.map_from_arrays(F.array(kv["key"]), F.array(kv["value"]))),
    )
    none = F.expr("map_from_arrays(cast(array() as array<string>), cast(array() as array<string>))")
    # most documents have no such field; a backslash may stand for a sign of its name
    return F.when(F.contains(raw, F.lit("_dynamic")) | F.contains(raw, F.lit("\\")), F.coalesce(last, none)).otherwise(none)


def parse_documents(raw: DataFrame, schema: Schema, column: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """JSON text -> the schema's columns, after those of ``keep``. Empty strings become null; a document without an id is an error."""
    texts = T.StructType([T.StructField(f.name, T.ArrayType(T.StringType()) if f.multi else T.StringType()) for f in schema.fields if f.name != schema.id] + [T.StructField(schema.id, T.StringType())])
    doc = raw.select(F.from_json(column, texts).alias("d"), F.col(column).alias("__raw"), *keep)
    key = F.col(f"d.`{schema.id}`")
    out = [F.when(key.isNull(), F.raise_error(F.lit("a document has no id")).cast("string")).otherwise(key).alias(schema.id)]
    for f in schema.fields:
        if f.name != schema.id:
            c = F.col(f"d.`{f.name}`")
            out.append((c if f.multi else F.nullif(c, F.lit(""))).cast(f.spark_type).alias(f.name))
    return doc.select(*keep, *out, dynamic_map(F.col("__raw")).alias(DYNAMIC))


def parse_requests(raw: DataFrame, column: str = "value") -> DataFrame:
    """(kind, content, id, route, index): an envelope, or a bare document, which is an INDEX request."""
    kind = F.upper(F.get_json_object(column, "$.type"))
    content = F.get_json_object(column, "$.content")
    known = F.when(kind.isNull(), "INDEX").when(kind.isin(*KINDS), kind).otherwise(
        F.raise_error(F.concat(F.lit("unknown request type "), kind)).cast("string")
    )
    body = F.when(kind.isNull(), F.col(column)).otherwise(content)
    return raw.select(
        *[c for c in raw.columns if c != column], known.alias("kind"), body.alias("content"),
        F.coalesce(F.get_json_object(column, "$.id"), F.get_json_object(body, "$.id")).alias("id"),
        F.from_json(F.get_json_object(column, "$.route"), "array<int>").alias("route"), F.get_json_object(column, "$.index").alias("index"),
    )


def read_json_lines(spark: SparkSession, path: str, schema: Schema, stream: bool = False) -> DataFrame:
    reader = spark.readStream if stream else spark.read
    return parse_documents(reader.text(path), schema)


def read_kafka(spark: SparkSession, servers: str, topic: str, schema: Schema, **options: str) -> DataFrame:
    """A stream of JSON documents; needs Spark's Kafka connector on the class path."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).options(**options).load()
    return parse_documents(raw.select(F.col("value").cast("string").alias("value")), schema)


GATEWAYS: dict = {"file": read_json_lines, "kafka": read_kafka}


def register_gateway(name: str, read) -> None:
    """A custom source: ``read(spark, **settings)`` gives documents as a (streaming) DataFrame."""
    GATEWAYS[name] = read
