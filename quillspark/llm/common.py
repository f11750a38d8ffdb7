"""Helpers that the training-data operators share: lineage cuts, connected groups, shipped modules."""

from __future__ import annotations

import gc
import sys
import tempfile
from collections.abc import Callable, Iterator
from contextlib import suppress

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def ship(name: str) -> None:
    """Send a module's functions to the executors by value, so only the driver needs the package."""
    cloudpickle.register_pickle_by_value(sys.modules[name])


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is missing (local tests) a temporary one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()


#: Rows of an Arrow batch: texts can be long, and a task holds batches on both sides.
BATCH_ROWS = 1000


def bound_batches(spark: SparkSession) -> None:
    """Let the session send Python at most ``BATCH_ROWS`` rows at a time; a smaller setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from there."""
    shared_folder(df.sparkSession)
    bound_batches(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete what earlier rounds shuffled: it waits for the driver's collector."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Rows of a narrow table that may be broadcast, once it is written and counted.
SMALL_ROWS = 500_000


def small(df: DataFrame) -> DataFrame:
    """``df``, a cut with a few longs a row, to be broadcast in a join if its count allows it; else the join shuffles."""
    return F.broadcast(df) if df.count() <= SMALL_ROWS else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def whole_rows(df: DataFrame, *replaced: str) -> Column:
    """All columns of ``df`` but those that an operator replaces, as one column: no name can clash."""
    gone = {c.lower() for c in replaced}
    return F.struct(*(F.col(f"`{c}`") for c in df.columns if c.lower() not in gone)).alias("row")


def stratum(column: str) -> Column:
    """A column as a never-null text key; null stays apart from every value, the empty one too."""
    return F.when(F.col(column).isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), F.col(column).cast("string")))


#: Edges that one task contracts at once (16 bytes each).
CHUNK_EDGES = 2_000_000


def contracted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids on the edges (a, b), sorted, and the smallest id that each reaches."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(ids))
    while True:
        lower, least = root.copy(), np.minimum(root[x], root[y])
        np.minimum.at(lower, root[x], least)
        np.minimum.at(lower, root[y], least)
        while (lower[lower] != lower).any():
            lower = lower[lower]
        if (lower == root).all():
            return ids, ids[root]
        root = lower


def _contract(edges: DataFrame, chunk: int) -> DataFrame:
    """(a, b) edges -> fewer that connect the same: those of each task, ``chunk`` at a time, as (id, smallest id)."""

    def contract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
        held: list[pd.DataFrame] = []

        def forest() -> tuple[np.ndarray, np.ndarray]:
            ids, root = contracted(np.concatenate([a, *(p["a"] for p in held)]), np.concatenate([b, *(p["b"] for p in held)]))
            return ids[ids != root], root[ids != root]

        for p in batches:
            held.append(p)
            if sum(map(len, held)) > chunk // 4:
                a, b = forest()
                held = []
                if len(a) > chunk:
                    yield pd.DataFrame({"a": a, "b": b})
                    a, b = a[:0], b[:0]
        a, b = forest()
        yield pd.DataFrame({"a": a, "b": b})

    return edges.mapInPandas(contract, "a bigint, b bigint")


def connected_groups(edges: DataFrame, chunk: int = CHUNK_EDGES) -> DataFrame:
    """``edges(a, b)`` of longs -> ``(id, root)``: the smallest id reachable, for every id on an edge.

    First every task contracts its own edges to a spanning forest. If what is left fits one chunk, a
    single task ends the work. More edges go on in rounds of large-star and small-star steps: minima
    are combined before the shuffle and joined back, so a hub with very many neighbours is a skewed
    join that adaptive execution splits, never one group in one task. The rounds end when one leaves
    the edges as they were.
    """
    star = cut(_contract(edges.select("a", "b").where("a <> b"), chunk))
    if star.count() <= chunk:
        star = cut(_contract(star.repartition(1), chunk))
    else:
        star = _star_rounds(star)
    return star.select(F.col("a").alias("id"), F.col("b").alias("root")).union(star.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())


def _star_rounds(edges: DataFrame) -> DataFrame:
    star = cut(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).distinct())
    before = None
    while True:
        state = star.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == before:
            return star.select(F.col("u").alias("a"), F.col("v").alias("b"))
        before = state
        both = star.union(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        star = cut(small.union(least.select("u", F.col("m").alias("v"))).distinct())
        release(star.sparkSession)


#: Columns (numbers as arrays, others as lists), places of some rows in them, of others, and a matrix of
#: which pairs of those to compare -> the pairs of ids that link.
Compare = Callable[[dict, np.ndarray, np.ndarray, np.ndarray], list[tuple[int, int]]]
#: Members of a bucket that are compared with one another in one task, and as many that ask them.
BLOCK_MEMBERS = 1024


def link_buckets(
    buckets: DataFrame, verify: Callable[[DataFrame, DataFrame], DataFrame], compare: Compare,
    said: Callable[[DataFrame], DataFrame], rounds: int = 3, block: int = BLOCK_MEMBERS,
) -> DataFrame:
    """Verified links among members of the same buckets, enough of them to connect all that link.

    ``buckets(b, id)``: pairs of longs. ``said``: ids(id) -> ``(id, ...)``, what it takes to compare
    them. ``verify`` takes pairs ``(a, b)`` with a < b and that table, and returns the pairs that
    link; so does ``compare`` in a task.

    In each round a bucket's leader - the member that meets the most others over all buckets, so the
    likely original of its copies - is compared with the members that aren't connected to it yet, in
    one row each. In the first round a member meets only the foremost of its buckets' leaders, which
    connects most copies. What is still apart after the rounds is compared block by block: of each
    bucket, the members outside its largest group ask all members, ``block`` of either in a task; a
    pair is compared in the first bucket that both have, and only links leave the task. So no list of a bucket's pairs is made, and no pair of a bucket
    stays untried unless its two are connected already.
    """
    spark = buckets.sparkSession
    least = cut(buckets.groupBy("b").agg(F.count("*").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi").select("b", "n"))
    release(spark)
    shared = cut(buckets.join(least, "b").select("b", "id", "n"))
    release(spark)
    items = cut(said(shared.select("id").distinct()))
    degree = shared.groupBy("id").agg(F.sum("n").alias("degree"))
    left = cut(shared.join(degree, "id").select("b", "id", "degree", F.col("id").alias("root")))
    release(spark)
    links = spark.createDataFrame([], "a bigint, b bigint")
    pair = F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b")
    for k in range(rounds):
        if left.isEmpty():
            return links
        lead = F.max(F.struct("degree", (-F.col("id")).alias("id"), "root")).alias("top")
        met = cut(left.join(left.groupBy("b").agg(lead), "b").select("b", "id", "degree", "root", (-F.col("top.id")).alias("leader"), F.col("top.degree").alias("rank"), F.col("top.root").alias("top_root")))
        new = met.where("root <> top_root")
        if k:
            new = new.select(*pair).distinct()
        else:
            best = F.max_by("leader", F.struct("rank", -F.col("leader"))).alias("leader")
            new = new.groupBy("id").agg(best).select(*pair)
        links = links.union(cut(verify(new, items)))
        # a leader that has met all its bucket stays only as long as others there may meet its group
        group = connected_groups(links).select("id", F.col("root").alias("g"))
        rooted = met.join(group, "id", "left").select(
            "b", "id", F.when((F.col("id") == F.col("leader")) & F.lit(0 < k < rounds - 1), F.lit(0)).otherwise(F.col("degree")).alias("degree"), F.coalesce("g", "id").alias("root")
        )
        open_ = rooted.groupBy("b").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("b")
        left = cut(rooted.join(open_, "b"))
        release(spark)
    return links if left.isEmpty() else links.union(cut(_linked_in_blocks(left, items, compare, block)))


def met_before(ends: np.ndarray, bands: np.ndarray, asks: np.ndarray, asked: np.ndarray, bucket: int) -> np.ndarray:
    """asks x asked: whether the two rows share a bucket below ``bucket``; row k has ``bands[ends[k] : ends[k + 1]]``."""
    rows = np.union1d(asks, asked)
    n = (ends[rows + 1] - ends[rows]).astype(np.int64)
    own = bands[np.repeat(ends[rows] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
    row, own = np.repeat(np.arange(len(rows)), n)[own < bucket], own[own < bucket]
    found, at, count = np.unique(own, return_inverse=True, return_counts=True)
    shared = count > 1  # by two rows
    has = np.zeros((len(rows), int(shared.sum())), np.float32)
    has[row[shared[at]], (np.cumsum(shared) - 1)[at[shared[at]]]] = 1
    return has[np.searchsorted(rows, asks)] @ has[np.searchsorted(rows, asked)].T > 0


def _linked_in_blocks(left: DataFrame, items: DataFrame, compare: Compare, block: int) -> DataFrame:
    """Links between members of different roots in the buckets ``left(b, id, root)``."""
    roots = left.groupBy("b", "root").agg(F.count("*").alias("k"))
    sizes = roots.groupBy("b").agg(F.sum("k").alias("n"), F.max(F.struct("k", "root")).alias("top")).select(
        "b", F.col("top.root").alias("main"), F.ceil(F.col("n") / block).alias("blocks"), F.ceil((F.col("n") - F.col("top.k")) / block).alias("parts")
    )
    own = left.groupBy("id").agg(F.sort_array(F.collect_set("b")).alias("own"))  # the bands of one member
    each = left.join(sizes, "b").join(items.join(own, "id"), "id")
    each = each.withColumn("asking", F.col("root") != F.col("main")).drop("main", "degree")
    deal = F.pmod(F.xxhash64("id", F.lit(23)), F.col("blocks")), F.pmod(F.xxhash64("id", F.lit(29)), F.col("parts"))
    # a member's own block in all parts and, if it asks, its own part in all blocks
    places = F.array_union(
        F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.struct(deal[0].alias("block"), p.cast("bigint").alias("part"))),
        F.when(F.col("asking"), F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(k.cast("bigint").alias("block"), deal[1].alias("part")))).otherwise(F.expr("cast(array() as array<struct<block:bigint,part:bigint>>)")),
    )
    placed = each.withColumns({"own_block": deal[0], "own_part": deal[1]}).withColumn("place", F.explode(places)).select("*", "place.*").drop("place", "blocks", "parts")

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            keys = [table.column(c).to_numpy() for c in ("b", "block", "part")]
            ends = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
            whole = int(ends[-1]) if len(ends) else 0
            held = table.slice(whole)  # its group may go on in the next batch
            if whole:
                yield linked(table.slice(0, whole), [0, *ends.tolist()])
        if held is not None and held.num_rows:
            yield linked(held, [0, held.num_rows])

    def linked(table: pa.Table, bounds: list[int]) -> pa.RecordBatch:
        table, seen = table.combine_chunks(), set()
        b, block, part, asking, own_block, own_part, root = (table.column(c).to_numpy() for c in ("b", "block", "part", "asking", "own_block", "own_part", "root"))
        own = table.column("own").chunk(0)
        ends, bands = own.offsets.to_numpy(), own.values.to_numpy()
        table = table.drop_columns(["own"])
        for start, end in zip(bounds, bounds[1:]):
            asks = start + np.flatnonzero(asking[start:end] & (own_part[start:end] == part[start]))
            asked = start + np.flatnonzero(own_block[start:end] == block[start])
            may = root[asks][:, None] != root[asked]
            if may.any():
                may &= ~met_before(ends, bands, asks, asked, b[start])
            if may.any():
                asks, asked, may = asks[may.any(1)], asked[may.any(0)], may[np.ix_(may.any(1), may.any(0))]
                rows = np.union1d(asks, asked)  # only their texts become Python objects
                some = table.take(pa.array(rows)).combine_chunks()
                columns = {c: x.to_numpy() if pa.types.is_integer(x.type) or pa.types.is_floating(x.type) else x.to_pylist() for c, x in zip(some.column_names, some.columns)}
                seen.update((min(x), max(x)) for x in compare(columns, np.searchsorted(rows, asks), np.searchsorted(rows, asked), may))
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in seen], pa.int64()) for k in range(2)], names=["a", "b"])

    dealt = placed.repartition("b", "block", "part").sortWithinPartitions("b", "block", "part")
    return dealt.mapInArrow(found, "a bigint, b bigint").distinct()


def slices(texts: pa.Array, rows: int = 256) -> Iterator[list]:
    """An Arrow array's values as Python objects, some rows at a time: a worker never holds a batch twice."""
    for start in range(0, len(texts), rows):
        yield texts.slice(start, rows).to_pylist()


def worker_cache(owner: str) -> dict:
    """A dict that outlives tasks in the Python worker (shipped modules are rebuilt for every task).

    Only the operator that ran last has one: what another left there is dropped and its memory given
    back, so a worker that serves one stage after another never holds the tables of two. Operators
    that keep nothing call this too.
    """
    import ctypes
    import types

    held = sys.modules.setdefault("_worker_cache_of_shipped_code", types.ModuleType("cache")).__dict__
    if held.get("owner") != owner:
        held["cache"] = {}
        held["owner"] = owner
        gc.collect()
        pa.default_memory_pool().release_unused()
        with suppress(OSError, AttributeError):  # where the C library has it
            ctypes.CDLL(None).malloc_trim(0)
    return held["cache"]


ship(__name__)
