"""Embedding near-duplicates on a Robust-pruned flat graph.

Vectors go to their nearest clusters, several each, so that shards overlap. Every shard builds a
Robust-pruned graph over its members, whose candidate neighbours come from the leaves of a few
random projection trees; the adjacency lists of a vector's shards are united. Each vector then
searches its shards' members over the united lists: greedily from medoids to its neighbourhood, then
onwards as long as neighbours stay in range. Only similarities along visited edges are computed, in
double precision, and those in range are the verified links. A link counts in the first shard that
both vectors share, so no list of pairs is made. Recall is audited against brute force, and shards
overlap more if it falls short; if it still does, all blocks are compared.

Shards keep their size as the table grows: beyond ``CLUSTERS`` shards, clusters are divided by the
residuals to their centres, and again, with codebooks of ``RESIDUALS`` entries each.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_groups, cut, ship

COSINE = 0.95
#: Vectors that cluster centres are fitted on, at most about so many, chosen by a hash of the id.
SAMPLE_ROWS = 20_000
#: Vectors whose links are compared with brute force over all rows: so many of all, and of those with links.
AUDIT_ROWS = 200
TARGET_RECALL = 0.98
OVERLAPS = (3, 6, 12)
#: Members of a shard on average, and at most in a block; larger shards are searched by pairs of blocks.
SHARD_ROWS, BLOCK_ROWS = 1000, 1500
#: Centres are broadcast: at most so many and the codebooks of residuals, however large the table.
CLUSTERS, RESIDUALS = 2048, 64
#: Projection trees, members of a leaf at most, candidates that are pruned, neighbours, entry points.
TREES, LEAF, POOL, DEGREE, ALPHA, SLACK, ENTRIES = 4, 32, 48, 24, 1.2, 0.08, 48
LOG = logging.getLogger(__name__)


def unit(vectors: list) -> np.ndarray:
    """Rows of length 1 in double precision; the largest component is divided out first."""
    x = np.stack([np.asarray(v, np.float64) for v in vectors])
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def usable(v: Column) -> Column:
    """Not null, not zero, and every component a finite number."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & fine & F.exists(v, lambda x: x != 0)


def cluster_centres(x: np.ndarray, clusters: int, rounds: int = 4) -> np.ndarray:
    """Spherical k-means from evenly spaced rows."""
    centres = x[np.linspace(0, len(x) - 1, min(clusters, len(x))).astype(int)].copy()
    for _ in range(rounds):
        own = np.concatenate([(x[i : i + 4096] @ centres.T).argmax(1) for i in range(0, len(x), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        size = np.linalg.norm(sums, axis=1)
        centres[size > 0] = sums[size > 0] / size[size > 0, None]
    return centres


# --- one shard ------------------------------------------------------------------------------


def dots(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The similarities of rows ``a`` and ``b``, pair by pair."""
    out = np.empty(a.shape)
    flat, a, b = out.reshape(-1), np.ascontiguousarray(a).reshape(-1), np.ascontiguousarray(b).reshape(-1)
    for i in range(0, len(a), 20_000):
        flat[i : i + 20_000] = np.einsum("ij,ij->i", x[a[i : i + 20_000]], x[b[i : i + 20_000]])
    return out


def leaf_mates(x: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """members x LEAF others (-1: none) of the leaf of a random projection tree that each falls into, and their similarities."""
    n, rng = len(x), np.random.default_rng(seed)
    leaves = 1 << max(0, int(np.ceil(np.log2(max(n, 1) / LEAF))))
    node, parts = np.zeros(n, np.int64), 1
    while parts < leaves:  # halves of equal size, by a direction of each node's own
        side = np.einsum("ij,ij->i", x, rng.normal(size=(parts, x.shape[1]))[node])
        order = np.lexsort((side, node))
        count = np.bincount(node, minlength=parts)
        place = np.arange(n) - np.repeat(np.cumsum(count) - count, count)
        node[order] = 2 * node[order] + (place >= -(-count[node[order]] // 2))
        parts *= 2
    order = np.argsort(node, kind="stable")
    count = np.bincount(node, minlength=parts)
    mates = np.full((parts, LEAF), -1)
    slot = np.empty(n, np.int64)
    slot[order] = np.arange(n) - np.repeat(np.cumsum(count) - count, count)
    mates[node, slot] = np.arange(n)
    own = x[mates]  # gathered once, leaf by leaf
    return mates[node], (own @ own.transpose(0, 2, 1))[node, slot]


def robust_prune(x: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA, seed: int = 0) -> np.ndarray:
    """members x degree neighbours (-1: none): of the candidates - mates in the trees' leaves and some
    random members - the nearest that isn't ``alpha`` times nearer to a neighbour already chosen, again and again."""
    n = len(x)
    out = np.full((n, degree), -1)
    if n < 2:
        return out
    rows = np.arange(n)
    some = np.random.default_rng(seed).integers(0, n, (n, LEAF // 4))
    found = [leaf_mates(x, seed * TREES + k) for k in range(TREES)] + [(some, dots(x, np.broadcast_to(rows[:, None], some.shape), some))]
    cand, sims = (np.concatenate(c, 1) for c in zip(*found))
    order = np.argsort(cand, 1)
    cand, sims = np.take_along_axis(cand, order, 1), np.take_along_axis(sims, order, 1)
    alive = (cand >= 0) & (cand != rows[:, None])
    alive[:, 1:] &= cand[:, 1:] != cand[:, :-1]
    dist = np.where(alive, 2 - 2 * sims, np.inf)
    pool = np.argpartition(dist, min(POOL, dist.shape[1]) - 1, axis=1)[:, :POOL]
    cand, dist, alive = (np.take_along_axis(c, pool, 1) for c in (cand, dist, alive))
    for k in range(degree):
        best = np.where(alive, dist, np.inf).argmin(1)
        some = np.flatnonzero(alive[rows, best])
        if not len(some):
            break
        star = cand[some, best[some]]
        out[some, k] = star
        # what is left of each member's candidates, against the neighbour chosen last
        at, which = np.nonzero(alive[some])
        near = 2 - 2 * dots(x, star[at], cand[some[at], which])
        gone = (alpha**2 * near <= dist[some[at], which]) | (cand[some[at], which] == star[at])
        alive[some[at[gone]], which[gone]] = False
    return out


def range_search(x: np.ndarray, adjacency: np.ndarray, limit: float, slack: float = SLACK, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(a, b), both ways: members within ``limit`` of each other that are found over the graph.

    Members that tie, equal ones too, are found like others; one member alone has no links.
    """
    n = len(x)
    rows = np.arange(n)
    seen = rows * n + rows
    # medoids: the most central member and spread ones; each starts from its two nearest
    entry = np.unique(np.append(np.random.default_rng(seed).integers(0, n, ENTRIES), (x @ x.sum(0)).argmax()))
    near = x @ x[entry].T
    top = np.argsort(-near, axis=1)[:, :2]
    found_q, found_x = [rows], [rows]
    for column in top.T:
        here, sim, going = entry[column], near[rows, column], rows
        while len(going):
            nbr = adjacency[here[going]]
            s = np.full(nbr.shape, -np.inf)
            there = nbr >= 0
            s[there] = dots(x, np.broadcast_to(going[:, None], nbr.shape)[there], nbr[there])
            best = s.argmax(1)
            pick = s[np.arange(len(going)), best]
            better = (pick > sim[going]) & (nbr[np.arange(len(going)), best] != going)
            going, nxt, pick = going[better], nbr[better, best[better]], pick[better]
            here[going], sim[going] = nxt, pick
        found_q.append(rows)
        found_x.append(here)
    new = np.setdiff1d(np.concatenate(found_q) * n + np.concatenate(found_x), np.zeros(0, np.int64))
    seen, links = np.union1d(seen, new), []
    while len(new):
        q, y = new // n, new % n
        parts = []
        for i in range(0, len(q), 50_000):
            nbr = adjacency[y[i : i + 50_000]]
            code = np.broadcast_to(q[i : i + 50_000, None] * n, nbr.shape)[nbr >= 0] + nbr[nbr >= 0]
            parts.append(np.unique(code))
        fresh = np.setdiff1d(np.unique(np.concatenate(parts)), seen, assume_unique=True)
        seen = np.union1d(seen, fresh)
        sim = dots(x, fresh // n, fresh % n)
        links.append(fresh[sim >= limit])
        new = fresh[sim >= limit - slack]
    start = np.setdiff1d(np.concatenate(found_q[1:]) * n + np.concatenate(found_x[1:]), rows * n + rows)
    links.append(start[dots(x, start // n, start % n) >= limit])
    code = np.concatenate(links)
    code = np.unique(np.concatenate([code, code % n * n + code // n]))
    return code // n, code % n


def all_in_range(x: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """The same by comparing all members."""
    a, b = np.nonzero(x @ x.T >= limit - 1e-12)
    a, b = a[a != b], b[a != b]
    keep = dots(x, a, b) >= limit
    return a[keep], b[keep]


def _united(lists: list, ids: np.ndarray) -> np.ndarray:
    """Adjacency over positions from lists of ids; neighbours elsewhere are left out; both ways."""
    order = np.argsort(ids)
    src = np.repeat(np.arange(len(lists)), [len(v) for v in lists])
    dst = np.concatenate([np.zeros(0, np.int64), *map(np.asarray, lists)]).astype(np.int64)
    at = order[np.minimum(np.searchsorted(ids, dst, sorter=order), len(ids) - 1)]
    here = ids[at] == dst
    src, at = src[here], at[here]
    both = np.unique(np.concatenate([src * len(ids) + at, at * len(ids) + src]))
    src, at = both // len(ids), both % len(ids)
    count = np.bincount(src, minlength=len(ids))
    out = np.full((len(ids), max(int(count.max(initial=0)), 1)), -1)
    out[src, np.arange(len(src)) - np.repeat(np.cumsum(count) - count, count)] = at
    return out


# --- the corpus -----------------------------------------------------------------------------


def fit_levels(x: np.ndarray, wanted: int) -> list[np.ndarray]:
    """Cluster centres, then codebooks of residuals until they tell ``wanted`` shards apart."""
    levels = [cluster_centres(x, min(wanted, CLUSTERS))]
    told, rest = len(levels[0]), x
    while told < wanted and len(x) > 1:
        c = levels[-1]
        own = np.concatenate([_distances(rest[i : i + 4096], c).argmin(1) for i in range(0, len(rest), 4096)])
        rest = rest - c[own]
        levels.append(_codebook(rest, min(RESIDUALS, -(-wanted // told))))
        if len(levels[-1]) < 2:
            break
        told *= len(levels[-1])
    return levels


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (c**2).sum(1) - 2 * x @ c.T


def _codebook(x: np.ndarray, size: int, rounds: int = 4) -> np.ndarray:
    """k-means from evenly spaced rows."""
    c = x[np.linspace(0, len(x) - 1, min(size, len(x))).astype(int)].copy()
    for _ in range(rounds):
        own = np.concatenate([_distances(x[i : i + 4096], c).argmin(1) for i in range(0, len(x), 4096)])
        sums, n = np.zeros_like(c), np.bincount(own, minlength=len(c))
        np.add.at(sums, own, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def shards_of(x: np.ndarray, levels: list[np.ndarray], overlap: int) -> np.ndarray:
    """rows x shards: the ``overlap`` nearest clusters, in each the two nearest residuals, and so on."""
    rows = np.repeat(np.arange(len(x)), min(overlap, len(levels[0])))
    near = np.argsort(_distances(x, levels[0]), axis=1, kind="stable")[:, : min(overlap, len(levels[0]))].reshape(-1)
    shard, rest = near.astype(np.int64), x[rows] - levels[0][near]
    for c in levels[1:]:
        k = min(2, len(c))
        near = np.argsort(_distances(rest, c), axis=1, kind="stable")[:, :k].reshape(-1)
        rest, shard = np.repeat(rest, k, 0) - c[near], np.repeat(shard, k) * len(c) + near
    return shard.reshape(len(x), -1)


def _shards(classes: DataFrame, levels: dict[int, list[np.ndarray]], overlap: int) -> DataFrame:
    """(dim, shard, block, blocks, id, n, v, homes): a row for each of a vector's shards."""

    def homes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for dim, rows in b.groupby(b["v"].map(len)):
                own = levels.get(dim)
                shards = np.zeros((len(rows), 1), int) if own is None else shards_of(unit(rows["v"].tolist()), own, overlap)
                out.append(rows.assign(homes=list(np.sort(shards, 1))))
            if out:
                yield pd.concat(out)

    assigned = cut(classes.mapInPandas(homes, "id bigint, n bigint, v array<double>, homes array<bigint>"))
    each = assigned.select(F.size("v").alias("dim"), F.explode("homes").alias("shard"), "id", "n", "v", "homes")
    sizes = each.groupBy("dim", "shard").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))
    return each.join(sizes, ["dim", "shard"]).withColumn("block", F.expr("cast(pmod(xxhash64(id), blocks) as int)"))


def _paired(members: DataFrame) -> DataFrame:
    """Each member once for every pair of blocks of its shard that its own is one of."""
    return members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns(
        {"lo": F.least("block", "other"), "hi": F.greatest("block", "other")}
    )


def _build(members: DataFrame) -> DataFrame:
    """(id, nbrs): the adjacency lists of all shards' graphs, united."""

    def build(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("id", kind="stable")
        ids = p["id"].to_numpy()
        nbr = robust_prune(unit(p["v"].tolist()), seed=int(key[1]) % 1_000_003)
        return pd.DataFrame({"id": ids, "nbrs": [ids[r[r >= 0]] for r in nbr]})

    lists = _paired(members).groupBy("dim", "shard", "lo", "hi").applyInPandas(build, "id bigint, nbrs array<bigint>")
    # at most DEGREE neighbours from each of a vector's few shards and their blocks
    return lists.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("nbrs"))).alias("nbrs"))


def _search(members: DataFrame, graph: DataFrame | None, limit: float) -> DataFrame:
    """(id, n_links, root): for every vector and shard, the links that count there; without a graph, of all."""
    compared = graph is None

    def search(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("id", kind="stable")
        ids, n, block = p["id"].to_numpy(), p["n"].to_numpy(), p["block"].to_numpy()
        x = unit(p["v"].tolist())
        if compared:
            a, b = all_in_range(x, limit)
        else:
            a, b = range_search(x, _united(p["nbrs"].tolist(), ids), limit, seed=int(key[1]) % 1_000_003)
        if key[2] != key[3]:
            apart = block[a] != block[b]
            a, b = a[apart], b[apart]
        # count a link only in the first shard that both have
        homes = p["homes"].tolist()
        if len(a):
            wide = max(map(len, homes))
            h = np.full((len(ids), wide), -1)
            for i, v in enumerate(homes):
                h[i, : len(v)] = v
            first = np.full(len(a), np.iinfo(np.int64).max)
            for k in range(wide):
                hk = h[a, k]
                shared = (h[b] == hk[:, None]).any(1) & (hk >= 0)
                first = np.where(shared, np.minimum(first, hk), first)
            mine = first == key[1]
            a, b = a[mine], b[mine]
        count = np.bincount(a, n[b], len(ids)).astype(np.int64)
        root = np.arange(len(ids))
        while True:
            lower = root.copy()
            np.minimum.at(lower, a, root[b])
            lower = lower[lower]
            if (lower == root).all():
                break
            root = lower
        return pd.DataFrame({"id": ids, "n_links": count, "root": ids[root]})

    known = members if graph is None else members.join(graph, "id")
    return _paired(known).groupBy("dim", "shard", "lo", "hi").applyInPandas(search, "id bigint, n_links bigint, root bigint")


def _audit(classes: DataFrame, counts: DataFrame, limit: float) -> float | None:
    """The share of the links of some vectors, found by brute force over all rows, that are counted.

    Some of all vectors and some of those with counted links are audited. None: they have no link.
    """
    known = classes.join(counts, "id", "left").select("id", "v", "n", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    order = F.xxhash64(F.lit(5), "id"), F.col("id")
    rows = pd.concat([known.orderBy(*order).limit(AUDIT_ROWS).toPandas(), known.where("n_links > 0").orderBy(*order).limit(AUDIT_ROWS).toPandas()]).drop_duplicates("id")
    if rows.empty:
        return None
    by_dim = {d: (r["id"].to_numpy(), unit(r["v"].tolist())) for d, r in rows.groupby(rows["v"].map(len))}

    def brute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, int] = {}
        for b in batches:
            for dim, some in b.groupby(b["v"].map(len)):
                if dim in by_dim:
                    ids, q = by_dim[dim]
                    near = (unit(some["v"].tolist()) @ q.T >= limit) & (some["id"].to_numpy()[:, None] != ids)
                    for i, c in zip(ids, some["n"].to_numpy() @ near, strict=True):
                        total[int(i)] = total.get(int(i), 0) + int(c)
        if total:
            yield pd.DataFrame({"id": list(total), "n": list(total.values())}, dtype="int64")

    true = classes.mapInPandas(brute, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("true")).toPandas()
    both = rows.merge(true, "left", "id").fillna({"true": 0})
    whole = both["true"].sum()
    return float(both[["n_links", "true"]].min(axis=1).sum() / whole) if whole else None


def near_vectors(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", limit: float = COSINE, overlaps: tuple[int, ...] = OVERLAPS) -> DataFrame:
    """(key, n_links, component_id, audit_recall) for each row of ``vectors``.

    Equal vectors are one class with a count, so a great many copies cost no more than one. Vectors
    that are null, zero or hold null or non-finite components, and vectors with a null id, link with
    nothing; vectors of different dimensions don't link. An id that repeats with the same vector is
    one vector; with different ones, each of its rows has the links of its own vector. Empty tables
    give empty results. ``audit_recall`` is null where no audited vector has a link, and 1 where all
    were compared because the audits fell short of ``TARGET_RECALL``.
    """
    base = vectors.select(F.col(key).cast("bigint").alias("id"), F.col(embedding).cast("array<double>").alias("v"))
    good = base.where(F.col("id").isNotNull() & usable(F.col("v")))
    classes = cut(good.groupBy("v").agg(F.min("id").alias("id"), F.count_distinct("id").alias("n")).select("id", "n", "v"))
    total = classes.count()
    # ids that name several vectors: a number of its own for each class keeps them apart
    classes = cut(classes.withColumns({"own": F.col("id"), "id": F.xxhash64("v")}))
    share = F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(1_000_000_007)) / 1_000_000_007.0
    sample = classes.where(share < SAMPLE_ROWS / max(total, 1)).orderBy("id").select("v").toPandas()["v"]
    recall: float | None = 1.0 if total < 2 else None
    narrow = classes.select("id", "n", "v")
    counts = classes.select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("root"))
    for overlap in overlaps if total > 1 else ():
        wanted = max(1, total * overlap // SHARD_ROWS)
        levels = {d: fit_levels(unit(v.tolist()), wanted) for d, v in sample.groupby(sample.map(len))}
        members = cut(_shards(narrow, levels, overlap))
        counts = cut(_search(members, cut(_build(members)), limit))
        found = counts.groupBy("id").agg(F.sum("n_links").alias("n_links"))
        recall = _audit(narrow, found, limit)
        LOG.info("embedding near-duplicates: overlap %s, audited recall %s", overlap, recall)
        if recall is None or recall >= TARGET_RECALL:
            break
    else:
        if total > 1:
            LOG.warning("embedding near-duplicates: audited recall %s is too low, all blocks are compared", recall)
            counts, recall = cut(_search(_shards(narrow, {}, 1), None, limit)), 1.0
    edges = counts.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b"))
    linked = counts.groupBy("id").agg(F.sum("n_links").alias("links"))
    named = (
        classes.join(linked, "id").join(connected_groups(edges), "id", "left")
        .select(F.col("v").alias("_v"), (F.col("links") + F.col("n") - 1).alias("n_links"), F.coalesce("root", "id").alias("group"), "own")
    )
    # classes are known by hashes; a component's name is its smallest vector id
    names = named.groupBy("group").agg(F.min("own").alias("component_id"))
    named = named.join(names, "group").select("_v", "n_links", "component_id")
    return base.join(named, (F.col("v") == F.col("_v")) & F.col("id").isNotNull() & usable(F.col("v")), "left").select(
        F.col("id").alias(key), F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"), F.lit(recall).cast("double").alias("audit_recall"),
    )


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each vector with its links and its component. Unusable vectors (null, zero, null or non-finite components) and null ids link with nothing; equal vectors link; an empty table gives an empty result."""
    found = near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    return found.select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"), "audit_recall")


ship(__name__)
