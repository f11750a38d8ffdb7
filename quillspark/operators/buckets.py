"""Range buckets: one pass, one row, unpivoted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.nodes import Bucket, Range
from ..schema import Field
from .match import between


def bucket_counts(rows: DataFrame, field: Field, buckets: tuple[Bucket, ...]) -> DataFrame:
    """(field, bucket_ord, label, value): buckets may overlap and stay in the order given."""
    if not buckets:
        return rows.sparkSession.createDataFrame([], "field string, bucket_ord int, label string, value bigint")
    inside = [between(field.column, Range(field, b.low, b.high, b.with_low, b.with_high)) for b in buckets]
    counts = rows.agg(*(F.count(F.when(c, 1)).alias(f"b{i}") for i, c in enumerate(inside)))
    table = F.array(*(
        F.struct(F.lit(i).alias("bucket_ord"), F.lit(b.label).alias("label"), F.col(f"b{i}").alias("value"))
        for i, b in enumerate(buckets)
    ))
    return counts.select(F.inline(table)).select(F.lit(field.name).alias("field"), "bucket_ord", "label", "value")
