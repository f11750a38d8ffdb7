"""Hierarchical facets: counts of the children of a path, drill-down predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.nodes import Facet
from ..schema import Field


def paths(f: Field) -> Column:
    """A field's paths, each an array of its parts."""
    values = f.column if f.multi else F.when(f.column.isNotNull(), F.array(f.column))
    parts = F.transform(values, lambda v: F.filter(F.split(v, "/"), lambda p: p != ""))
    return F.coalesce(parts, F.expr("cast(array() as array<array<string>>)"))


def under(f: Field, path: tuple[str, ...]) -> Column:
    """The field has a value under the path; without a path, any value."""
    if not path:
        return (F.size(f.column) > 0) if f.multi else f.column.isNotNull()
    text = "/".join(path)
    test = lambda c: (c == text) | c.startswith(text + "/")
    return F.exists(f.column, test) if f.multi else test(f.column)


def drill_predicates(drills: tuple[tuple[Field, tuple[str, ...]], ...]) -> dict[str, Column]:
    """One predicate a dimension: several paths of the same one are alternatives."""
    out: dict[str, Column] = {}
    for f, path in drills:
        p = under(f, path)
        out[f.name] = out[f.name] | p if f.name in out else p
    return out


def facet_counts(rows: DataFrame, facet: Facet) -> DataFrame:
    """(dim, path, value, child_count, label, label_value, rank), best labels first.

    A row counts once for each different child. The value is the sum of all labels' counts, of a field
    with several values that of the labels returned. Labels are counted with a partial aggregate; only the
    top ones are sorted. A leaf or a path that isn't there gives one row of value and child count 0 without a
    label.
    """
    depth = len(facet.path)
    prefix = F.array(*map(F.lit, facet.path)) if depth else None
    own = paths(facet.field)
    if depth:
        own = F.filter(own, lambda p: F.slice(p, 1, depth) == prefix)
    children = F.array_distinct(F.transform(F.filter(own, lambda p: F.size(p) > depth), lambda p: F.get(p, F.lit(depth))))
    counts = rows.select(F.explode(children).alias("label")).groupBy("label").agg(F.count("*").alias("label_value"))
    dim = F.lit(facet.field.name)
    whole = counts.agg(F.coalesce(F.sum("label_value"), F.lit(0)).cast("bigint").alias("value"), F.count("*").alias("child_count")).withColumn("dim", dim)
    best = counts.orderBy(F.desc("label_value"), "label").limit(facet.top)
    if facet.field.multi:
        whole = whole.drop("value").crossJoin(best.agg(F.coalesce(F.sum("label_value"), F.lit(0)).cast("bigint").alias("value")))  # one row each
    numbered = best.withColumn("dim", dim).withColumn("rank", F.row_number().over(Window.partitionBy("dim").orderBy(F.desc("label_value"), "label")))
    return whole.join(numbered, "dim", "left").select(
        "dim", F.lit("/".join(facet.path)).alias("path"), "value", "child_count", "label", "label_value", F.col("rank").cast("bigint").alias("rank")
    )
