"""Change logs applied to tables: upsert, replace, partial update, delete, whole request logs.

Latest wins by ``seq``. A batch is reduced to one row an id by a partial aggregate before it meets
the table, so an id that changes a million times costs its aggregate, not a sort in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def latest(changes: DataFrame, key: str, seq: str) -> DataFrame:
    """The last change of each id; rows of equal seq are ordered by a hash of their other columns."""
    rest = [c for c in changes.columns if c != key]
    order = F.struct(F.col(seq), F.xxhash64(F.to_json(F.struct(*rest))))
    return changes.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("c")).select(key, "c.*").select(*changes.columns)


def upsert(table: DataFrame, changes: DataFrame, key: str, seq: str) -> DataFrame:
    """INDEX and REPLACE: an id's last row takes the place of what the table had."""
    last = latest(changes, key, seq)
    return table.join(last.select(key), key, "left_anti").unionByName(last.drop(seq), allowMissingColumns=True)


def delete_ids(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return table.join(ids.select(key).distinct(), key, "left_anti")


def update(table: DataFrame, changes: DataFrame, key: str, seq: str) -> tuple[DataFrame, DataFrame]:
    """Partial update: (table with each change's non-null columns over the old ones, ids that weren't there).

    Of several changes of an id, each column takes its last non-null value.
    """
    columns = [c for c in changes.columns if c not in (key, seq)]
    merged = changes.groupBy(key).agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col(seq))).alias(f"__{c}") for c in columns))
    new = table.join(merged, key, "left").select(
        *(F.coalesce(f"__{c}", c).alias(c) if c in columns else F.col(c) for c in table.columns)
    )
    return new, merged.select(key).join(table.select(key), key, "left_anti")


def apply_changes(table: DataFrame, changes: DataFrame, key: str, seq: str = "seq", kind: str = "kind") -> DataFrame:
    """A log of INDEX, REPLACE and DELETE rows: what the last change of each id leaves."""
    last = latest(changes, key, seq)
    kept = last.where(F.col(kind).isin("INDEX", "REPLACE")).drop(seq, kind)
    return table.join(last.select(key), key, "left_anti").unionByName(kept, allowMissingColumns=True)


def _overlaid(new: Column, old: Column, kind: T.DataType) -> Column:
    """A column of a partial update over the old one; of maps, the new entries join the old."""
    if not isinstance(kind, T.MapType):
        return F.coalesce(new, old)
    return F.when(new.isNull(), old).when(old.isNull(), new).otherwise(
        F.map_concat(F.map_filter(old, lambda k, _: ~F.array_contains(F.map_keys(new), k)), new)
    )


def resolve_requests(table: DataFrame, log: DataFrame, key: str, seq: str = "seq", kind: str = "kind", gone: str = "__gone") -> tuple[DataFrame, DataFrame]:
    """A log of INDEX, REPLACE, UPDATE and DELETE rows -> (what it makes of its ids, updates that failed).

    The first result has the table's columns and ``gone``: a row for each id that the log puts, updates
    or deletes. An id's updates after its last other change are laid over what that put, or over the
    table's row; of several updates a column takes the last value that isn't null, of a map the last
    one that isn't empty. The second result, (key, seq), names the last update of each id that neither
    is in the table nor was put. Null keys are left out.
    """
    columns = [f for f in table.schema.fields if f.name != key]
    log = log.where(F.col(key).isNotNull())
    last = latest(log.where(F.col(kind) != "UPDATE"), key, seq)
    last = last.select(key, F.col(seq).alias("__base"), F.col(kind).alias("__kind"), *(F.col(f"`{f.name}`").alias(f"__put_{f.name}") for f in columns))
    said = {f.name: F.when(F.size(F.col(f"`{f.name}`")) > 0, F.col(f"`{f.name}`")) if isinstance(f.dataType, T.MapType) else F.col(f"`{f.name}`") for f in columns}
    later = log.where(F.col(kind) == "UPDATE").join(last.select(key, "__base"), key, "left").where(F.col("__base").isNull() | (F.col(seq) > F.col("__base")))
    merged = later.groupBy(key).agg(F.max(seq).alias("__updated"), *(F.max_by(c, F.when(c.isNotNull(), F.col(seq))).alias(f"__new_{n}") for n, c in said.items()))
    old = table.select(key, F.lit(True).alias("__there"), *(F.col(f"`{f.name}`").alias(f"__old_{f.name}") for f in columns))
    rows = last.join(merged, key, "full_outer").join(old, key, "left")
    known = F.coalesce(F.col("__kind").isin("INDEX", "REPLACE"), F.col("__there"), F.lit(False))
    put = F.col("__kind").isNotNull()
    out = [_overlaid(F.col(f"`__new_{f.name}`"), F.when(put, F.col(f"`__put_{f.name}`")).otherwise(F.col(f"`__old_{f.name}`")), f.dataType).alias(f.name) for f in columns]
    done = rows.where(put | known).select(key, *out, (~known).alias(gone)).select(*table.columns, gone)
    return done, rows.where(~known & F.col("__updated").isNotNull()).select(key, F.col("__updated").alias(seq))
