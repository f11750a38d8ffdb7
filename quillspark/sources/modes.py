"""How a collection is laid out: one table, many by time, size or name, or a pointer that is swapped."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TIME = {"HOUR": "yyyy-MM-dd-HH", "DAY": "yyyy-MM-dd", "MONTH": "yyyy-MM", "YEAR": "yyyy"}


def time_index(ts: Column, unit: str) -> Column:
    """The name of the table that a row of this time goes to."""
    return F.date_format(ts, TIME[unit.upper()])


def size_index(ordinal: Column, limit: int) -> Column:
    """The table's number where every table takes ``limit`` rows in order of arrival."""
    return F.floor(ordinal / limit).cast("string")


@dataclass
class MultiTable:
    """Tables by index name; ``max_live`` retires the oldest names when more come."""

    key: str
    tables: dict[str, DataFrame] = field(default_factory=dict)
    max_live: int = 0

    def add(self, rows: DataFrame, index: str = "index") -> list[str]:
        """Rows go to the tables their index column names; an id that is there already is replaced."""
        names = sorted(r[0] for r in rows.select(index).distinct().collect())  # names of tables, not rows
        for n in names:
            own = rows.where(F.col(index) == n).drop(index)
            old = self.tables.get(n)
            self.tables[n] = own if old is None else old.join(own.select(self.key), self.key, "left_anti").unionByName(own)
        while self.max_live and len(self.tables) > self.max_live:
            del self.tables[min(self.tables)]
        return names

    def delete_index(self, name: str) -> bool:
        return self.tables.pop(name, None) is not None

    def update(self, *_: object) -> None:
        raise NotImplementedError("partial updates aren't supported over many tables")


@dataclass
class HotSwap:
    """Tables built aside as ``next_..`` and swapped in; up to three wait and three old ones stay."""

    name: str
    live: DataFrame | None = None
    waiting: dict[str, DataFrame] = field(default_factory=dict)
    expired: list[DataFrame] = field(default_factory=list)

    def index(self, name: str, rows: DataFrame) -> None:
        if name == self.name:
            self.live = rows if self.live is None else self.live.unionByName(rows)
        elif re.fullmatch(r"next_.+", name):
            old = self.waiting.get(name)
            self.waiting[name] = rows if old is None else old.unionByName(rows)
            while len(self.waiting) > 3:
                del self.waiting[min(self.waiting)]
        else:
            raise ValueError(f"no index {name}: only {self.name} and next_.. take rows")

    def swap(self, name: str) -> bool:
        if name not in self.waiting:
            return False
        if self.live is not None:
            self.expired = [self.live, *self.expired][:3]
        self.live = self.waiting.pop(name)
        return True


def batch_build(rows: DataFrame, path: str, key: str, shards: int) -> None:
    """The bulk build: rows dealt by the hash of their id and written a folder a shard."""
    from ..engine import shard_of

    rows.withColumn("shard", shard_of(F.col(key), shards)).repartition(shards, "shard").write.partitionBy("shard").mode("overwrite").parquet(path)


def compact(rows: DataFrame, path: str, files: int) -> None:
    """MERGE_INDEX: the table rewritten as a few files."""
    rows.repartition(files).write.mode("overwrite").parquet(path)
