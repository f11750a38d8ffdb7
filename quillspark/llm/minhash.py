"""Near-duplicate documents by BagMinHash.

A document is the multiset of its five-word shingles. Every shingle carries Poisson processes over
its discretised weight - one for each of the weight intervals [0,1), [1,2), [2,4), [4,8), ... - and
every point of a process has a time, a register and a weight coordinate, all hashed from the shingle.
A document keeps the earliest time in each register among the points under its shingles' weights, so
two documents agree in a register with the probability of their weighted Jaccard similarity. Only
processes that may still beat the slowest register are followed. Signatures are banded; documents
that share a band are verified by their exact multiset overlap.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Compare, connected_groups, cut, documents, link_buckets, ship, slices, whole_rows, worker_cache

WORDS = 5
SIMILARITY = 0.8
#: Bands of registers: at a similarity of 0.8, 3 pairs in 100,000 share no band.
BANDS, ROWS = 26, 5
#: Shingles whose signatures are computed at once; bounds a worker's memory. A longer text goes alone.
CHUNK = 200_000
KEPT_WORDS = 100_000
#: Letters of texts that are compared at once, times of shingles in a product of matrices, and pairs counted one by one.
LETTERS, FEATURES, PAIRS = 4_000_000, 4096, 1 << 20
#: A shingle is counted by products of matrices if one in so many of the pairs has it.
DENSE = 64
WORD = re.compile(r"\w+")
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _mix(z: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """64-bit hashes of all runs of ``words`` words (letters and digits, any case); a shorter text is
    one run, a text without words has none."""
    import xxhash

    kept = worker_cache("words").setdefault("hashes", {})
    said = WORD.findall((text or "").lower())
    if not said:
        return np.zeros(0, np.uint64)
    try:
        h = np.fromiter(map(kept.__getitem__, said), np.uint64, len(said))
    except KeyError:
        if len(kept) > KEPT_WORDS:
            kept.clear()
        for w in said:
            if w not in kept:
                kept[w] = xxhash.xxh64_intdigest(w)
        h = np.fromiter(map(kept.__getitem__, said), np.uint64, len(said))
    n = max(len(h) - words + 1, 1)
    out = np.full(n, len(h) if len(h) < words else words, np.uint64)
    for k in range(min(words, len(h))):
        out = _mix(out * GOLDEN + h[k : k + n])
    return out


def signatures(doc: np.ndarray, key: np.ndarray, weight: np.ndarray, docs: int, registers: int) -> np.ndarray:
    """docs x registers earliest times, for (document, shingle, weight) entries; inf without any."""
    doc, key, low, length, weight = _intervals(doc, key, weight)
    sig = np.full(docs * registers, np.inf)
    last = np.full(docs, np.inf)
    time, k = np.zeros(len(doc)), 0
    while len(doc):
        k += 1
        z = _mix(key + np.uint64(k * int(GOLDEN) & 0xFFFFFFFFFFFFFFFF))
        time = time - np.log(((z >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / length
        alive = time < last[doc]
        if not alive.all():
            doc, key, low, length, weight, time, z = (a[alive] for a in (doc, key, low, length, weight, time, z))
            if not len(doc):
                break
        z = _mix(z ^ GOLDEN)
        register = ((z >> np.uint64(32)) * np.uint64(registers) >> np.uint64(32)).astype(np.int64)
        at = low + length * ((z & np.uint64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32)
        under = at < weight
        np.minimum.at(sig, (doc * registers + register)[under], time[under])
        if k < 8 or k % 8 == 0:
            some = np.unique(doc)
            last[some] = sig.reshape(docs, registers)[some].max(1)
    return sig.reshape(docs, registers)


def _intervals(doc: np.ndarray, key: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, ...]:
    """An entry for each weight interval [0,1), [1,2), [2,4), ... that begins under the weight."""
    out = [(doc, key, np.zeros(len(doc)), np.ones(len(doc)), weight)]
    low = 1
    while (over := weight > low).any():
        doc, key, weight = doc[over], key[over], weight[over]
        out.append((doc, _mix(key ^ np.uint64(low)), np.full(len(doc), float(low)), np.full(len(doc), float(low)), weight))
        low *= 2
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _bags(texts: list, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle, count), sorted, of texts numbered from 0."""
    found = [shingles(t, words) for t in texts]
    doc = np.repeat(np.arange(len(found)), [len(f) for f in found])
    key = np.concatenate([np.zeros(0, np.uint64), *found])
    order = np.lexsort((key, doc))
    doc, key = doc[order], key[order]
    first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])])) if len(doc) else np.zeros(0, np.int64)
    return doc[first], key[first], np.diff(np.append(first, len(doc)))


def _chunks(texts: list) -> Iterator[tuple[int, int]]:
    start, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t or "") // 5
        if i > start and size + n > CHUNK:
            yield start, i
            start, size = i, 0
        size += n
    if texts:
        yield start, len(texts)


def digest_texts(words: int = WORDS, bands: int = BANDS, rows: int = ROWS):
    """An Arrow UDF: text -> (bag: two longs that name the multiset, bands: a long for each band);
    null for texts without words."""

    def digests(texts: list) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for a, b in _chunks(texts):
            doc, key, count = _bags(texts[a:b], words)
            sig = signatures(doc, key, count.astype(np.float64), b - a, bands * rows)
            bits = sig.view(np.uint64).reshape(b - a, bands, rows)
            code = np.broadcast_to(np.arange(bands, dtype=np.uint64), (b - a, bands)).copy()
            for k in range(rows):
                code = _mix(code * GOLDEN + bits[:, :, k])
            both = _mix(key * GOLDEN + count.astype(np.uint64))
            names = np.zeros((2, b - a), np.uint64)
            np.add.at(names[0], doc, both)
            np.add.at(names[1], doc, _mix(both ^ GOLDEN))
            yield names.T, code, np.bincount(doc, minlength=b - a) > 0

    def lists(rows_: np.ndarray, there: np.ndarray) -> pa.Array:
        flat = rows_[there].astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(there * rows_.shape[1])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.reshape(-1)), mask=pa.array(~there))

    @F.arrow_udf("bag array<bigint>, bands array<bigint>")
    def digest(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import xxhash

        for batch in batches:
            # equal texts of a batch are digested once
            number: dict[bytes, int] = {}
            each, made = [], [(np.zeros((0, 2), np.uint64), np.zeros((0, bands), np.uint64), np.zeros(0, bool))]
            for some in slices(batch, 512):
                new = []
                for t in (t or "" for t in some):
                    name = xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass"))
                    if name not in number:
                        number[name] = len(number)
                        new.append(t)
                    each.append(number[name])
                made += digests(new)
            names, code, there = (np.concatenate(c)[each] if each else np.concatenate(c) for c in zip(*made))
            yield pa.StructArray.from_arrays([lists(names, there), lists(code, there)], names=["bag", "bands"])

    return digest


def overlap(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two bags (distinct hashes, counts)."""
    _, i, j = np.intersect1d(one[0], two[0], assume_unique=True, return_indices=True)
    shared = int(np.minimum(one[1][i], two[1][j]).sum())
    whole = int(one[1].sum() + two[1].sum()) - shared
    return shared / whole if whole else 0.0


def verified(pairs: DataFrame, texts: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """Those of ``pairs(a, b)`` whose texts in ``texts(id, text)`` overlap enough."""

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bags: dict[int, tuple] = {}

        def bag(i: int, t: str) -> tuple:
            key = i, hash(t)
            if key not in bags:
                if len(bags) > 500:
                    bags.clear()
                bags[key] = np.unique(shingles(t, words), return_counts=True)
            return bags[key]

        for p in batches:
            keep = [overlap(bag(a, x), bag(b, y)) >= similarity for a, b, x, y in zip(p["a"], p["b"], p["x"], p["y"], strict=True)]
            yield p.loc[np.array(keep, bool), ["a", "b"]]

    both = (
        pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("y")), "b")
        .join(texts.select(F.col("id").alias("a"), F.col("text").alias("x")), "a")
        .select("a", "b", "x", "y")
    )
    return both.mapInPandas(check, "a bigint, b bigint").distinct()


def shared_counts(rows: int, doc: np.ndarray, key: np.ndarray, count: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """one x two: how many shingles two texts share, each as often as both have it; bags as ``_bags`` returns them.

    Each time a text has a shingle is a feature. Those that many have are counted by a product of
    matrices, the others pair by pair.
    """
    left, right = (np.zeros(rows, bool) for _ in "ab")
    left[one], right[two] = True, True
    # the k-th time of a shingle has the number (shingle, k); one that a single text has is shared by none
    order = np.argsort(key, kind="stable")
    doc, key, count = doc[order], key[order], count[order]
    again = np.concatenate([[False], key[1:] == key[:-1]]) if len(key) else np.zeros(0, bool)
    kept = again | np.concatenate([again[1:], [False]]) if len(key) else again
    doc, count, again = doc[kept], count[kept], again[kept]
    name = np.cumsum(~again)
    doc, name = np.repeat(doc, count), np.repeat(name, count)
    time = np.arange(len(name)) - np.repeat(np.cumsum(count) - count, count)
    order = np.lexsort((time, name))
    doc, name, time = doc[order], name[order], time[order]
    feature = np.cumsum(np.concatenate([[0], (name[1:] != name[:-1]) | (time[1:] != time[:-1])])) if len(name) else name
    features = int(feature[-1]) + 1 if len(feature) else 0
    at = [np.full(rows, -1), np.full(rows, -1)]
    at[0][one], at[1][two] = np.arange(len(one)), np.arange(len(two))
    sides = [(at[0][doc[left[doc]]], feature[left[doc]]), (at[1][doc[right[doc]]], feature[right[doc]])]
    n = [np.bincount(f, minlength=features) for _, f in sides]
    pairs = n[0] * n[1]
    out = np.zeros((len(one), len(two)))
    dense = np.flatnonzero(pairs * DENSE > out.size)
    for k in range(0, len(dense), FEATURES):
        place = np.full(features, -1)
        some = dense[k : k + FEATURES]
        place[some] = np.arange(len(some))
        held = []
        for (row, f), height in zip(sides, out.shape):
            has, own = np.zeros((height, len(some)), np.float32), place[f]
            has[row[own >= 0], own[own >= 0]] = 1
            held.append(has)
        out += held[0] @ held[1].T
    first = [np.cumsum(c) - c for c in n]
    rest = np.flatnonzero((pairs > 0) & (pairs * DENSE <= out.size))
    part = np.cumsum(pairs[rest]) // PAIRS
    for some in np.split(rest, np.flatnonzero(part[1:] != part[:-1]) + 1) if len(rest) else ():
        f = np.repeat(some, pairs[some])
        k = np.arange(len(f)) - np.repeat(np.cumsum(pairs[some]) - pairs[some], pairs[some])
        i, j = sides[0][0][first[0][f] + k // n[1][f]], sides[1][0][first[1][f] + k % n[1][f]]
        out += np.bincount(i * out.shape[1] + j, minlength=out.size).reshape(out.shape)
    return out


def comparing(words: int = WORDS, similarity: float = SIMILARITY) -> Compare:
    """Of tables (id, root, text), the pairs asked for that overlap enough; of an asking text and those of one root the first."""

    def compare(columns: dict, asks: np.ndarray, asked: np.ndarray, may: np.ndarray) -> list[tuple[int, int]]:
        rows = np.union1d(asks, asked)
        texts = [columns["text"][k] or "" for k in rows.tolist()]
        if sum(map(len, texts)) > LETTERS and may.size > 1:  # in halves
            k, along = max(may.shape) // 2, int(may.shape[1] >= may.shape[0])
            halves = [(asks, asked[h], may[:, h]) if along else (asks[h], asked, may[h]) for h in (slice(None, k), slice(k, None))]
            return [x for half in halves if half[2].any() for x in compare(columns, *half)]
        doc, key, count = _bags(texts, words)
        one, two = np.searchsorted(rows, asks), np.searchsorted(rows, asked)
        size = np.bincount(doc, count, len(rows))
        low, high = np.minimum(size[one][:, None], size[two]), np.maximum(size[one][:, None], size[two])
        may = may & (low >= similarity * high)
        if not may.any():
            return []
        shared = shared_counts(len(rows), doc, key, count, one, two)
        near = may & (shared > 0) & (shared >= similarity * (size[one][:, None] + size[two] - shared))
        i, j = np.nonzero(near)
        # what has one root is connected, so an asking text's first link to it will do
        _, root = np.unique(columns["root"][asked], return_inverse=True)
        _, first = np.unique(i * len(asked) + root[j], return_index=True)
        return list(zip(columns["id"][asks[i[first]]].tolist(), columns["id"][asked[j[first]]].tolist()))

    return compare


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(key, component_id, n_copies) for each row: ``component_id`` is the smallest id of the rows
    linked to it through similarities of ``similarity`` or more; ``n_copies`` counts the rows whose
    bag is the same, itself included.

    Equal bags are one class and are compared once. Texts without words, null ones included, link
    with nothing; nor do rows with a null id, whose ``component_id`` is null. Rows that share an id
    count as one document. Empty tables give empty results.
    """
    base = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    made = cut(base.select("id", digest_texts(words)(F.col("text")).alias("d")).select("id", "d.bag", "d.bands"))
    named = made.where("id is not null and bag is not null")
    classes = cut(
        named.groupBy("bag").agg(F.min(F.struct("id", "bands")).alias("m"), F.count("*").alias("n_copies"))
        .select("bag", F.col("m.id").alias("rep"), F.col("m.bands").alias("bands"), "n_copies")
    )
    buckets = classes.select(F.explode("bands").alias("b"), F.col("rep").alias("id")).distinct()
    links = link_buckets(buckets, lambda pairs, texts: verified(pairs, texts, words, similarity), comparing(words, similarity), lambda ids: base.join(ids, "id", "left_semi"))
    # an id in two classes (repeated with another text) ties them
    ties = named.join(classes.select("bag", "rep"), "bag").where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b")).distinct()
    shared = ties.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").select("a")
    own = ties.join(classes.select(F.col("rep").alias("a")).distinct().union(shared).distinct(), "a", "left_semi")
    roots = connected_groups(links.union(own)).select(F.col("id").alias("rep"), "root")
    named_class = classes.join(roots, "rep", "left").select("bag", "n_copies", F.coalesce("root", "rep").alias("component_id"))
    return made.join(named_class, "bag", "left").select(
        F.col("id").alias(key), F.coalesce("component_id", "id").alias("component_id"), F.coalesce("n_copies", F.lit(1).cast("bigint")).alias("n_copies")
    )


def keep_one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` without near duplicates: of each group the rows with the smallest id, once per text.

    Rows with a null id are kept.
    """
    groups = near_duplicates(docs, key, text, **options)
    kept = groups.where(F.col(key) == F.col("component_id")).groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n"))
    held = docs.select(whole_rows(docs), F.col(key).alias("key"), F.col(text).alias("text")).join(kept, "key")
    once = held.where("n = 1")
    again = held.where("n > 1").dropDuplicates(["key", "text"])
    return once.union(again).select("row.*").union(docs.where(F.col(key).isNull()))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's group and whether it is kept. Texts without words, null ones included, and null ids link with nothing; rows that share an id are one document; an empty table gives an empty result."""
    groups = near_duplicates(documents(spark, sf_dir))
    return groups.withColumn("kept", F.col("doc_id") == F.col("component_id"))


ship(__name__)
