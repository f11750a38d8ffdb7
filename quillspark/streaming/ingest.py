"""Change streams into versioned tables with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..schema import Schema
from ..sources.changes import latest, resolve_requests
from ..sources.json_docs import parse_documents, parse_requests


GONE = "__gone"


class Folders:
    """Numbered folders of a path, in whatever store Spark reads it from."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return root.getFileSystem(self.spark._jsc.hadoopConfiguration()), root

    def numbers(self, prefix: str) -> list[int]:
        """Of the folders ``prefix=n`` that were written to the end."""
        fs, root = self._fs()
        if not fs.exists(root):
            return []
        named = [s.getPath() for s in fs.listStatus(root) if s.getPath().getName().startswith(f"{prefix}=")]
        return sorted(int(p.getName().split("=")[1]) for p in named if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def remove(self, name: str) -> None:
        fs, _ = self._fs()
        fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}"), True)


def _none(spark: SparkSession, struct: T.StructType) -> DataFrame:
    """No rows, in a plan that starts no Python worker for them."""
    return spark.range(0).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in struct.fields))


class StreamTable:
    """A table that a stream keeps up to date: a base and, beside it, what each batch has changed.

    A batch writes the rows of its own ids (a mark stands for a deleted one), so its cost follows the
    batch, not the table. After ``compact`` batches what they changed is merged into the next base;
    the base before it stays for readers that have begun, older folders go. A batch that runs again
    after a failure starts from the same state and writes the same.
    """

    def __init__(self, spark: SparkSession, path: str, schema: Schema, compact: int = 16):
        self.spark, self.path, self.schema, self.compact, self.folders = spark, path.rstrip("/"), schema, compact, Folders(spark, path)

    def _state(self, before: int | None) -> tuple[int | None, list[int]]:
        bases, changes = ([n for n in self.folders.numbers(p) if before is None or n < before] for p in ("base", "change"))
        base = bases[-1] if bases else None
        return base, [n for n in changes if base is None or n > base]

    def read(self, before: int | None = None) -> DataFrame:
        struct = self.schema.struct()
        base, changes = self._state(before)
        rows = _none(self.spark, struct) if base is None else self.spark.read.schema(struct).parquet(f"{self.path}/base={base}")
        if not changes:
            return rows
        marked = T.StructType([*struct.fields, T.StructField(GONE, T.BooleanType())])
        each = [self.spark.read.schema(marked).parquet(f"{self.path}/change={n}").withColumn("__batch", F.lit(n)) for n in changes]
        key = self.schema.id
        last = latest(reduce(DataFrame.union, each), key, "__batch").drop("__batch")
        return rows.join(last.select(key), key, "left_anti").unionByName(last.where(~F.col(GONE)).drop(GONE))

    def apply(self, batch: DataFrame, number: int) -> None:
        """One batch of requests (value: JSON text, seq): the order within an id is that of seq.

        Updates of ids that aren't there are written to ``failed``. Requests about whole tables are
        an error here: they belong to StreamTables.
        """
        requests = parse_requests(batch).select("seq", "kind", "content", "id").persist(StorageLevel.DISK_ONLY)
        try:
            # in one job of all tasks; first() looks into one task, then a few more, and so on
            whole = requests.where(F.col("kind").isin("DELETE_INDEX", "SWAP_INDEX")).agg(F.min("kind")).first()[0]
            if whole is not None:
                raise ValueError(f"a single table takes no {whole}")
            self.apply_requests(requests, number)
        finally:
            requests.unpersist()

    def apply_requests(self, requests: DataFrame, number: int) -> None:
        put = requests.where(F.col("kind").isin("INDEX", "REPLACE", "UPDATE"))
        parsed = parse_documents(put.select("seq", "kind", F.col("content").alias("value")), self.schema, keep=("seq", "kind"))
        gone = requests.where("kind = 'DELETE'").select("seq", "kind", F.col("id").alias(self.schema.id))
        # both results read the log twice: its JSON is read and parsed once
        log = parsed.unionByName(gone, allowMissingColumns=True).persist(StorageLevel.DISK_ONLY)
        try:
            done, failed = resolve_requests(self.read(number), log, self.schema.id, gone=GONE)
            failed.write.mode("overwrite").parquet(f"{self.path}/failed={number}")
            done.write.mode("overwrite").parquet(f"{self.path}/change={number}")
        finally:
            log.unpersist()
        base, changes = self._state(number + 1)
        if len(changes) >= self.compact:
            self.read(number + 1).write.mode("overwrite").parquet(f"{self.path}/base={number}")
            for prefix, kept in (("base", base or -1), ("change", base or -1), ("failed", base or -1)):
                for n in self.folders.numbers(prefix):
                    if n < kept:
                        self.folders.remove(f"{prefix}={n}")

    def failed(self) -> DataFrame:
        """(id, seq) of updates of ids that weren't there, of the batches that are still kept."""
        struct = T.StructType([T.StructField(self.schema.id, T.StringType()), T.StructField("seq", T.LongType())])
        each = [self.spark.read.parquet(f"{self.path}/failed={n}").select(self.schema.id, F.col("seq").cast("long")) for n in self.folders.numbers("failed")]
        return reduce(DataFrame.union, each, self.spark.createDataFrame([], struct))

    def start(self, stream: DataFrame, checkpoint: str, once: bool = True, seconds: int = 60) -> StreamingQuery:
        """``once``: all that is there, then stop; else a batch every ``seconds``."""
        return _started(stream, self.apply, checkpoint, once, seconds)


class StreamTables:
    """Tables by index name that one stream keeps up to date, with DELETE_INDEX and SWAP_INDEX.

    A request goes to the table its ``index`` names, without one to the live table. SWAP_INDEX puts
    the named table, built aside, in the live one's place. Requests of a batch take effect in order
    of seq. Which folder serves which name is a small table of its own, written last, so a batch that
    runs again starts from the same state.
    """

    def __init__(self, spark: SparkSession, path: str, schema: Schema, live: str = "live"):
        self.spark, self.path, self.schema, self.live, self.folders = spark, path.rstrip("/"), schema, live, Folders(spark, path)

    def names(self, before: int | None = None) -> dict[str, str]:
        done = [n for n in self.folders.numbers("names") if before is None or n < before]
        if not done:
            return {}
        return {r["name"]: r["folder"] for r in self.spark.read.parquet(f"{self.path}/names={done[-1]}").collect()}  # a row for each table

    def read(self, name: str | None = None) -> DataFrame:
        folder = self.names().get(name or self.live)
        if folder is None:
            if name not in (None, self.live):
                raise ValueError(f"no index {name}")
            return self.spark.createDataFrame([], self.schema.struct())
        return StreamTable(self.spark, f"{self.path}/{folder}", self.schema).read()

    def apply(self, batch: DataFrame, number: int) -> None:
        requests = parse_requests(batch).withColumn("index", F.coalesce("index", F.lit(self.live)))
        whole = F.col("kind").isin("DELETE_INDEX", "SWAP_INDEX")
        commands = requests.where(whole).select("seq", "kind", "index").orderBy("seq").collect()  # requests about tables, not documents
        names, after = self.names(number), None
        for k, command in enumerate([*commands, None]):
            own = requests.where(~whole)
            own = own if after is None else own.where(F.col("seq") > after)
            own = own if command is None else own.where(F.col("seq") < command["seq"])
            for name in [r[0] for r in own.select("index").distinct().collect()]:  # names of tables
                folder = names.setdefault(name, f"table-{number}-{k}-{name}")
                StreamTable(self.spark, f"{self.path}/{folder}", self.schema).apply_requests(own.where(F.col("index") == name), number * 1_000_000 + k)
            if command is not None:
                after = command["seq"]
                if command["kind"] == "DELETE_INDEX":
                    names.pop(command["index"], None)
                elif command["index"] in names:
                    names[self.live] = names.pop(command["index"])
        table = self.spark.createDataFrame(sorted(names.items()), "name string, folder string")
        table.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/names={number}")

    def start(self, stream: DataFrame, checkpoint: str, once: bool = True, seconds: int = 60) -> StreamingQuery:
        return _started(stream, self.apply, checkpoint, once, seconds)


def _started(stream: DataFrame, use: Callable[[DataFrame, int], None], checkpoint: str, once: bool, seconds: int) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(use).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{seconds} seconds")).start()


def windowed_counts(events: DataFrame, ts: str, late: str, width: str, *keys: str) -> DataFrame:
    """Counts by tumbling window over a stream, with a watermark for late rows."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), *keys).count()


def each_batch(stream: DataFrame, use: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return stream.writeStream.foreachBatch(use).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
