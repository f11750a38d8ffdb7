"""An inverted table: written once, searched by reading the words asked for."""

from __future__ import annotations

from zlib import crc32

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.analyzers import analyzer
from ..schema import Schema

BUCKETS = 64
#: A word's postings are dealt to so many tasks when they are written, so a very common one doesn't fall to one.
SALTS = 8


def field_norm(n: Column) -> Column:
    """One over the root of a field's length, with a mantissa of two bits."""
    length = F.greatest(n, F.lit(1)).cast("double")
    power = F.pow(F.lit(2.0), F.floor(-F.log2(length) / 2))
    return power * (1 + F.floor((1 / F.sqrt(length) / power - 1) * 4 + 1e-9) / 4)


def write_postings(rows: DataFrame, schema: Schema, path: str, buckets: int = BUCKETS) -> None:
    """``postings`` (bucket, field, token, id, tf, n), ``terms`` (bucket, field, token, df) and ``docs`` under ``path``.

    Buckets are folders, so a search lists and reads those of its words only; files are sorted by
    token, so within them the statistics of their row groups leave most unread. Rows with a null id,
    and fields without words, have no postings.
    """
    spark, key = rows.sparkSession, F.col(schema.id).cast("string")
    each = []
    for f in schema.fields:
        if f.tokenized:
            # a length beside explode() would be worked out again, the text cut into words anew, for each word
            cut = rows.where(key.isNotNull()).select(key.alias("id"), analyzer(f.analyzer).kept(f.column).alias("toks"))
            long = cut.select(F.lit(f.name).alias("field"), "id", F.size("toks").alias("n"), "toks")
            each.append(long.select("field", "id", "n", F.explode("toks").alias("token")))
    if not each:
        raise ValueError("no field is tokenized")
    said = each[0]
    for one in each[1:]:
        said = said.unionByName(one)
    bucket = F.pmod(F.crc32(F.concat("field", F.lit("\u0000"), "token").cast("binary")), F.lit(buckets)).cast("int")
    counted = said.groupBy("field", "token", "id", "n").agg(F.count("*").alias("tf")).withColumn("bucket", bucket)
    dealt = counted.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS))).repartition("bucket", "salt").sortWithinPartitions("bucket", "field", "token").drop("salt")
    dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    terms = spark.read.parquet(f"{path}/postings").groupBy("bucket", "field", "token").agg(F.count("*").alias("df"))
    terms.repartition("bucket").sortWithinPartitions("field", "token").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/terms")
    rows.select(F.count("*").alias("docs"), F.lit(buckets).alias("buckets")).write.mode("overwrite").parquet(f"{path}/docs")


def _of(table: DataFrame, field: str, words: list[str], buckets: int) -> DataFrame:
    wanted = sorted({crc32(f"{field}\0{w}".encode()) % buckets for w in words})
    return table.where(F.col("bucket").isin(wanted) & (F.col("field") == field) & F.col("token").isin(words))


def search_postings(spark: SparkSession, path: str, field: str, text: str, schema: Schema) -> DataFrame:
    """(id, score) of the rows that hold any of the words, scored by tf and idf; no table but the postings is read."""
    words = list(dict.fromkeys(analyzer(schema.resolve(field).analyzer).query(text)))
    docs, buckets = spark.read.parquet(f"{path}/docs").first()
    if not words:
        return spark.createDataFrame([], "id string, score double")
    df = {r["token"]: r["df"] for r in _of(spark.read.parquet(f"{path}/terms"), field, words, buckets).collect()}  # a row for each word asked for
    idf = {w: 1 + F.log(F.lit(float(docs) / (df.get(w, 0) + 1))) for w in words}
    norm = 1 / F.sqrt(sum((i * i for i in idf.values()), F.lit(0.0)))
    weight = F.element_at(F.create_map(*(x for w, i in idf.items() for x in (F.lit(w), i * i))), F.col("token"))
    found = _of(spark.read.parquet(f"{path}/postings"), field, words, buckets)
    return found.groupBy("id").agg(F.sum(F.sqrt("tf") * weight * field_norm(F.col("n")) * norm).alias("score"))
