"""Best-fit packing by the linear grouping scheme.

A piece's length is at most the sequence length, so all that packing decides on is a histogram of a
few thousand numbers, whatever the corpus. On that histogram, large lengths are cut into groups of
equal cardinality and rounded up to their group's largest; a configuration programme over those few
sizes (columns by knapsack, then rounded down) says how many sequences hold which sizes; actual
lengths take the places, and all that is left is best-fitted, longest first. The plan assigns
intervals of ranks within a length to intervals of sequences; pieces find theirs by rank.
"""

from __future__ import annotations

import sys
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, documents, ship, slices, whole_rows, worker_cache

CAPACITY = 2048
VOCABULARY = "byte_bpe_50k.tiktoken"  # the ids of byte_bpe_50k.json
#: That vocabulary's one special token; its id follows the last rank.
SPECIAL = "<|endoftext|>"
#: (largest share of the capacity that counts as small, groups); the best plan is taken.
SCHEMES = ((1 / 8, 24), (1 / 4, 40), (1 / 2, 24))
#: A cell of pieces of one length that is ranked in one task holds about so many.
CELL_ROWS = 500_000
#: More plan rows than this are joined by shuffle instead of broadcast (some 40 bytes each).
BROADCAST_PLAN = 200_000


# --- tokens ---------------------------------------------------------------------------------


def _encoder(path: str | None):
    """A function from a text to its ids as little-endian unsigned 32-bit bytes, without the end id.

    Ids are those of the tokenizers library for the same vocabulary, whose rank file is read by
    tiktoken: the string of the special token in a text is that token, what stands around it is
    encoded apart. The vocabulary's split pattern looks ahead only for runs of white space; texts
    without such runs, nearly all, are split alike by the pattern without it, in far less time.
    """
    cache = worker_cache("packing")
    if (key := ("encoder", path)) in cache:
        return cache[key]
    import base64
    import re
    from array import array

    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path(VOCABULARY), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    ahead = r"\s+(?!\S)|"
    whole, plain = (
        tiktoken.Encoding("ranks", pat_str=p, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for p in (public_tokenizers.PATTERN, public_tokenizers.PATTERN.replace(ahead, ""))
    )
    run, special = re.compile(r"\s\s"), len(ranks)
    code = next(c for c in "IL" if array(c).itemsize == 4)

    def encode(text: str) -> bytes:
        ids: list[int] = []
        for k, part in enumerate(text.split(SPECIAL)):
            if k:
                ids.append(special)
            ids += (whole if run.search(part) else plain)(part)
        made = array(code, ids)
        if sys.byteorder == "big":
            made.byteswap()
        return made.tobytes()

    cache[key] = encode
    return encode


def token_pieces(
    docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = 0,
    tokenizer_path: str | None = None, with_ids: bool = False,
) -> DataFrame:
    """(key, piece, start, length, ids_crc32[, ids]): a row for each piece of at most ``capacity`` ids.

    A text's ids and then ``end_id``; null counts as empty, so every row has a piece. Longer ones are
    cut into full pieces, the first one holding the rest. ``ids``: the bytes that the CRC covers.
    Repeated rows and null keys have pieces of their own; an empty table has none.
    """

    @F.arrow_udf("n bigint, crcs array<bigint>, ids array<binary>")
    def encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        from zlib import crc32

        import xxhash

        encode, end = _encoder(tokenizer_path), int(end_id).to_bytes(4, "little")
        for texts in batches:
            made: dict[bytes, tuple] = {}  # equal texts of a batch are encoded once
            out = []
            for t in (t or "" for some in slices(texts) for t in some):
                name = xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass"))
                if name not in made:
                    ids = encode(t) + end
                    n = len(ids) // 4
                    first = (n - 1) % capacity + 1
                    cuts = [0, *range(first, n + 1, capacity)]
                    pieces = [ids[4 * a : 4 * b] for a, b in zip(cuts, cuts[1:])]
                    made[name] = n, [crc32(p) for p in pieces], pieces if with_ids else None
                out.append(made[name])
            n, crcs, ids = zip(*out) if out else ((), (), ())
            columns = [pa.array(n, pa.int64()), pa.array(crcs, pa.list_(pa.int64())), pa.array(ids, pa.list_(pa.binary()))]
            yield pa.StructArray.from_arrays(columns, names=["n", "crcs", "ids"])

    first = F.expr(f"(_e.n - 1) % {capacity} + 1")
    rows = docs.select(F.col(key).alias("_k"), encoded(F.col(text)).alias("_e")).select(
        "_k", "_e", F.posexplode("_e.crcs").alias("piece", "ids_crc32")
    )
    return rows.select(
        F.col("_k").alias(key), "piece",
        F.when(F.col("piece") == 0, 0).otherwise(first + (F.col("piece") - 1) * capacity).cast("bigint").alias("start"),
        F.when(F.col("piece") == 0, first).otherwise(capacity).cast("bigint").alias("length"),
        "ids_crc32", *([F.get("_e.ids", F.col("piece")).alias("ids")] if with_ids else []),
    )


# --- the plan, on a histogram ---------------------------------------------------------------


def _configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[np.ndarray, int]]:
    """Patterns over ``sizes`` and how often each is used: the fractional optimum rounded down."""
    k = len(sizes)
    patterns = np.diag([capacity // s for s in sizes]).astype(float)
    need, s = np.array(demand, float), np.array(sizes)
    basis = patterns.copy()
    for _ in range(10 * k):
        y = np.linalg.solve(basis.T, np.ones(k))
        # the most valuable pattern that fits: a knapsack over capacities, copy by copy
        best, steps = np.zeros(capacity + 1), []
        for g in np.flatnonzero(y > 1e-12):
            for _ in range(capacity // sizes[g]):
                better = best.copy()
                np.maximum(best[s[g] :], best[: -s[g]] + y[g], out=better[s[g] :])
                steps.append((g, best))
                best = better
        if best[capacity] <= 1 + 1e-9:
            break
        new, c, value = np.zeros(k), capacity, best
        for g, under in reversed(steps):
            if value[c] > under[c]:
                new[g] += 1
                c -= s[g]
            value = under
        x, step = np.linalg.solve(basis, need), np.linalg.solve(basis, new)
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        if not np.isfinite(ratio).any():
            break
        basis[:, int(ratio.argmin())] = new
    x = np.linalg.solve(basis, need)
    return [(basis[:, j].astype(int), int(x[j] + 1e-9)) for j in range(k) if x[j] >= 1]


class _Sequences:
    """Runs of sequences that are filled alike: (first, count) by what they have left."""

    def __init__(self, capacity: int):
        self.capacity, self.open, self.left, self.made = capacity, {}, [], 0
        self.plan: list[tuple[int, int, int, int, int]] = []  # length, rank from, to, first sequence, offset

    def new(self, count: int) -> tuple[int, int]:
        self.made += count
        return self.made - count, count

    def add(self, left: int, run: tuple[int, int]) -> None:
        if left and run[1]:
            if left not in self.open:
                self.open[left] = []
                insort(self.left, left)
            self.open[left].append(run)

    def place(self, length: int, rank: int, first: int, count: int, left: int) -> None:
        self.plan.append((length, rank, rank + count, first, self.capacity - left))

    def best_fit(self, length: int, rank: int, count: int) -> None:
        while count:
            i = bisect_left(self.left, length)
            if i == len(self.left):
                left, run = self.capacity, self.new(-(-count // (self.capacity // length)))
            else:
                left = self.left[i]
                run = self.open[left].pop()
                if not self.open[left]:
                    del self.open[left], self.left[i]
            n = min(count, run[1])
            self.place(length, rank, run[0], n, left)
            self.add(left - length, (run[0], n))
            self.add(left, (run[0] + n, run[1] - n))
            rank, count = rank + n, count - n


def _packed(histogram: dict[int, int], capacity: int, small: float, groups: int) -> _Sequences:
    out = _Sequences(capacity)
    if n := histogram.get(capacity, 0):
        out.place(capacity, 0, out.new(n)[0], n, capacity)
    rest = {l: n for l, n in histogram.items() if l < capacity}
    large = sorted((l for l in rest if l > small * capacity), reverse=True)
    taken = dict.fromkeys(rest, 0)
    if large:
        # groups of equal cardinality, each rounded up to its largest length
        share = -(-sum(rest[l] for l in large) // groups)
        sizes: list[int] = []
        members: list[list[list[int]]] = []  # of a group: [length, how many], longest first
        room = 0
        for l in large:
            n = rest[l]
            while n:
                if not room:
                    if sizes and sizes[-1] == l:
                        room = n
                    else:
                        sizes.append(l)
                        members.append([])
                        room = share
                m = min(n, room)
                members[-1].append([l, m])
                n, room = n - m, room - m
        demand = [sum(n for _, n in m) for m in members]
        for pattern, times in _configurations(sizes, demand, capacity):
            runs = [(*out.new(times), capacity)]
            for g in np.repeat(np.arange(len(sizes)), pattern):
                filled = []
                for first, count, left in runs:
                    while count and members[g]:
                        l, n = members[g][0]
                        m = min(n, count)
                        out.place(l, taken[l], first, m, left)
                        taken[l] += m
                        filled.append((first, m, left - l))
                        first, count = first + m, count - m
                        members[g][0][1] -= m
                        if not members[g][0][1]:
                            members[g].pop(0)
                    if count:
                        filled.append((first, count, left))
                runs = filled
            for first, count, left in runs:
                out.add(left, (first, count))
    for l in sorted(rest, reverse=True):
        out.best_fit(l, taken[l], rest[l] - taken[l])
    return out


def plan_packing(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[int, list[tuple[int, int, int, int, int]]]:
    """(sequences, [(length, rank from, rank to, first sequence, offset)]) for counts by length."""
    schemes = [_packed(histogram, capacity, *scheme) for scheme in SCHEMES]
    best = min(schemes, key=lambda p: p.made)
    return best.made, best.plan


# --- pieces to sequences --------------------------------------------------------------------


def pack(pieces: DataFrame, length: str = "length", keys: tuple[str, ...] = ("doc_id", "piece"), capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with sequence_id (0..) and offset, gapless from 0 in every sequence.

    Lengths must be 1..capacity. Only counts by length come to the driver. Repeated rows are packed
    each; an empty table gives an empty result. ``pieces`` is read twice: pass a table or a cut.
    """
    spark = pieces.sparkSession
    own = [F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]
    base = pieces.select(whole_rows(pieces, "sequence_id", "offset"), F.col(length).cast("bigint").alias("l"), *own)
    histogram = {r[0]: r[1] for r in base.groupBy("l").count().collect()}  # at most ``capacity`` rows
    total = sum(histogram.values())
    sequences, plan = plan_packing(histogram, capacity)
    by_length: dict[int, list] = {l: [] for l in histogram}
    for l, a, b, first, offset in plan:
        by_length[l].append((a, b, first, offset))
    table = spark.createDataFrame(
        [(l, sorted(rows)) for l, rows in by_length.items()],
        "l bigint, plan array<struct<a:bigint,b:bigint,first:bigint,offset:bigint>>",
    )
    names = [f"k{i}" for i in range(len(keys))]
    cells = max(64, -(-total // CELL_ROWS))
    marked = base.withColumn("c", F.expr(f"pmod(xxhash64({', '.join(names)}), {cells})"))
    starts = marked.groupBy("l", "c").agg(F.count("*").alias("n")).withColumn(
        "before", F.sum("n").over(Window.partitionBy("l").orderBy("c")) - F.col("n")
    ).drop("n")
    rank = F.row_number().over(Window.partitionBy("l", "c").orderBy(*names)) - 1
    ranked = marked.withColumn("r", rank).join(starts, ["l", "c"]).withColumn("r", F.col("r") + F.col("before"))
    small = F.broadcast(table) if len(plan) <= BROADCAST_PLAN else table
    found = ranked.join(small, "l").withColumn(
        "p", F.expr("element_at(filter(plan, p -> p.a <= r and r < p.b), 1)")
    )
    return found.select("row.*", F.expr("p.first + r - p.a").alias("sequence_id"), F.col("p.offset").alias("offset"))


def pack_documents(docs: DataFrame, **options) -> DataFrame:
    """All of ``docs`` cut into pieces and packed: key, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(cut(token_pieces(docs, **options)))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces, packed. A null text counts as empty and is its end id alone; repeated rows and null ids are packed each; an empty table gives an empty result."""
    return pack_documents(documents(spark, sf_dir))


ship(__name__)
