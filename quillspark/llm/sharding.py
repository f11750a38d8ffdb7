"""Sharding by proportional stratified interleaving.

Rows of each source are ranked in a seeded shuffle; ``(2 rank + 1) / (2 rows)`` places every source
evenly over 0..1; sorting by that fraction interleaves the sources in proportion, and equal cuts of
the sorted order give shards whose mixture is the whole table's. No source, however large, is ranked
in one task: the shuffle key is cut into cells of bounded size and cells are ranked apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import documents, stratum, whole_rows

SEED = "interleave-1"
SHARDS = 16
#: A cell of a source and a bucket of the order hold about so many rows; both are small rows.
CELL_ROWS = 500_000
#: At least so many cells and buckets, so that small tables spread over the cluster too.
LEAST_CELLS = 512


def shard_rows(
    rows: DataFrame, source: str = "source", key: str = "doc_id", ties: tuple[str, ...] = (),
    shards: int = SHARDS, seed: str = SEED,
) -> DataFrame:
    """``rows`` with shard (0..shards-1, row counts at most one apart) and slot (0.. in each shard).

    Pass narrow rows and join wide columns later by key. A null source is a source of its own. Rows
    that tie in key are ordered by ``ties``; rows equal in all of those are interchangeable. Empty
    tables give empty results. Clashing columns named shard or slot are replaced.
    """
    tie = [F.col(c).alias(f"t{i}") for i, c in enumerate(ties)]
    base = rows.select(whole_rows(rows, "shard", "slot"), stratum(source).alias("s"), F.col(key).alias("key"), *tie)
    sizes = base.groupBy("s").agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    cells = max(LEAST_CELLS, -(-total // CELL_ROWS))
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("key").cast("string"), F.lit("-"))))
    cell = F.expr(f"(cast(conv(substring(h, 1, 10), 16, 10) as bigint) * {cells}) div {1 << 40}")

    # where each cell of a source starts, from counts that are combined before the shuffle
    marked = base.withColumn("h", digest).withColumn("c", cell)
    starts = (
        marked.groupBy("s", "c").agg(F.count("*").alias("k"))
        .withColumn("before", F.sum("k").over(Window.partitionBy("s").orderBy("c")) - F.col("k"))
        .join(sizes, "s").select("s", "c", "before", "n")
    )
    order = ["h", "key", *(f"t{i}" for i in range(len(ties)))]
    ranked = marked.withColumn(
        "r", F.row_number().over(Window.partitionBy("s", "c").orderBy(*order)) - 1
    ).join(starts, ["s", "c"]).withColumn("r", F.col("r") + F.col("before"))

    # how many rows stand before each bucket of the interleaved order follows from the sizes alone;
    # sources of one size count together, so very many small sources are few rows here
    bucket = F.expr(f"((2 * r + 1) * {cells}) div (2 * n)")
    first = (
        sizes.groupBy("n").agg(F.count("*").alias("m")).select("n", "m", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("b"))
        .groupBy(F.col("b").cast("bigint").alias("b"))
        .agg(F.sum(F.expr(f"m * if(b = 0, 0, ((2 * n * b - 1) div {cells} + 1) div 2)")).alias("first"))
    )
    place = F.row_number().over(Window.partitionBy("b").orderBy("f", "s", "r")) - 1
    placed = (
        ranked.withColumns({"b": bucket, "f": (2 * F.col("r") + 1) / (2 * F.col("n"))})
        .withColumn("g", place).join(first, "b").withColumn("g", F.col("g") + F.col("first"))
        .withColumn("shard", F.expr(f"cast((g * {shards}) div {max(total, 1)} as int)"))
    )
    return placed.select("row.*", "shard", F.expr(f"g - (shard * {total}L + {shards - 1}) div {shards}").alias("slot"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards whose row counts are at most one apart. A null source is a source of its own, a null text has size 1, ties in doc_id go by the text; an empty table gives an empty result."""
    narrow = documents(spark, sf_dir).select(
        "doc_id", "source",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("bigint").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
    )
    return shard_rows(narrow, ties=("text_crc32", "size")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


OP3_SQL = """
WITH RECURSIVE steps(b, c, k) AS (
  SELECT range, range, 0 FROM range(256)
  UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8),
crc AS (SELECT list(c ORDER BY b) AS t FROM steps WHERE k = 8),
bytes AS (
  SELECT doc_id, coalesce(source, '') AS s, source IS NULL AS gone, coalesce(octet_length(encode(text)), 0) + 1 AS size,
         list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT) AS l
  FROM documents),
marked AS (
  SELECT doc_id, s, gone, size,
         xor(list_reduce(list_prepend(4294967295::BIGINT, l), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) AS text_crc32
  FROM bytes, crc),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY gone, s ORDER BY md5('interleave-1:' || coalesce(doc_id::VARCHAR, '-')), doc_id, text_crc32, size) - 1 AS r,
         count(*) OVER (PARTITION BY gone, s) AS n
  FROM marked),
placed AS (
  SELECT *, row_number() OVER (ORDER BY (2 * r + 1)::DOUBLE / (2 * n)::DOUBLE, NOT gone, s, r) - 1 AS g, count(*) OVER () AS total FROM ranked),
cut AS (SELECT *, g * 16 // total AS shard FROM placed)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'rows' AS law, shard::INTEGER AS shard,
       (g - (shard * total + 15) // 16)::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM cut
"""
