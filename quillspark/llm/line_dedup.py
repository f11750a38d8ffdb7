"""Fuzzy line deduplication.

Lines are normalised and given SimHashes by block: a line's words fall into ``PARTS`` parts by their
hash, and each part is a block with a SimHash of its own. By the pigeonhole principle a respelt,
added or lost word, which falls into two parts at most, leaves the other blocks as they were, so two
lines that differ in a few words agree on some blocks whichever words differ. Long lines meet in a
join on single blocks, short ones on pairs of coarser blocks. Lines that meet and whose SimHashes
over all words differ in at most ``DISTANCE`` bits are verified by edit similarity. Of each connected
group, its first occurrence stays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_groups, contracted, cut, documents, link_buckets, release, ship, small, whole_rows, worker_cache

SIMILARITY = 0.9
#: Bits in which SimHashes over all words may differ; lines that are 0.9 alike hardly ever differ in more.
DISTANCE = 24
#: Parts of a long line's words; a short line has half as many and meets on pairs of them.
PARTS = 8
#: Lines of so many words at least meet on single blocks, and up to so many on pairs; between them both.
LONG, SHORT = 26, 38
#: Words and letters that blocks need to be met on: fewer tell nothing ("of the").
LONG_WORDS, LONG_LETTERS, SHORT_WORDS, SHORT_LETTERS = 3, 15, 2, 8
#: In lines of up to so many words, blocks of so many letters will do.
TINY, TINY_LETTERS = 9, 4
#: The numbers of lines to remove are broadcast to the texts up to this size, else joined by shuffle.
BROADCAST_BYTES = 16 << 20
#: Edits whose bits of a column fit one number, bytes of tables and pairs at a time in comparing many.
BAND, TABLE_BYTES, PAIRS = 62, 16 << 20, 1 << 13
#: Fewer pairs are compared one by one.
FEW = 24
#: A block's lines are compared with a common one first if there are so many pairs a line.
PIVOT_PAIRS = 50
#: Pairs of a block that are compared at first, the nearest of each asking line before its further ones; then four times as many.
STEP = 1 << 10
#: Bytes of lines that are hashed at once.
CHUNK = 1 << 19

GOLDEN = np.uint64(0x9E3779B97F4A7C15)
BASE = np.uint64(0xD6E8FEB86659FD93)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
BYTE_VALUES = np.random.default_rng(11).integers(1, 1 << 63, 256, np.uint64)
#: A byte's bits as the lowest bits of eight 8-bit counters.
LANES = (np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.uint64) << (np.arange(8, dtype=np.uint64) * np.uint64(8))).sum(1, dtype=np.uint64)
#: Bytes of words: digits, small letters and whatever isn't ASCII; digits count as 0.
WORDS = np.array([48 <= b < 58 or 97 <= b < 123 or b >= 128 for b in range(256)])
NORMAL = np.array([48 if 48 <= b < 58 else b for b in range(256)], np.uint8)


def _mix(z: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


POWERS: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """The first n powers; those up to a chunk's bytes are kept."""
    kept = POWERS.get(int(base))
    if kept is None or len(kept) < n:
        kept = np.full(max(n, CHUNK + 1), base, np.uint64)
        kept[:1] = 1
        kept = np.multiply.accumulate(kept)
        if len(kept) <= CHUNK + 1:
            POWERS[int(base)] = kept
    return kept[:n]


class _Lines:
    """The words of an array of lines: small letters, digits as 0, no spacing or punctuation.

    Punctuation is what ASCII has and, of the rest, the Latin-1 signs, U+2000 to U+207F (dashes,
    quotation marks, spaces) and U+3000 to U+303F.
    """

    def __init__(self, lines: pa.Array):
        low = pc.utf8_lower(lines)
        ends = np.frombuffer(low.buffers()[1], np.int64)[low.offset : low.offset + len(low) + 1]
        text = np.frombuffer(low.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
        self.bounds = ends - ends[0]
        word = WORDS[text]
        if (text >= 0xC2).any():
            at = np.flatnonzero((text == 0xC2) | (text == 0xE2) | (text == 0xE3))
            after = text[np.minimum(at + 1, len(text) - 1)]
            two = at[(text[at] == 0xC2) & (after < 0xC0)]
            three = at[((text[at] == 0xE2) & ((after == 0x80) | (after == 0x81))) | ((text[at] == 0xE3) & (after == 0x80))]
            for k, which in ((0, two), (1, two), (0, three), (1, three), (2, three)):
                word[np.minimum(which + k, len(text) - 1)] = False
        self.text, self.word = NORMAL[text], word
        edge = np.zeros(len(text) + 1, bool)
        edge[self.bounds] = True
        apart = np.concatenate([[False], word, [False]])
        self.starts = np.flatnonzero(word & (~apart[:-2] | edge[:-1]))
        self.ends = np.flatnonzero(word & (~apart[2:] | edge[1:])) + 1
        self.first = np.searchsorted(self.starts, self.bounds[:-1])
        self.counts = np.searchsorted(self.starts, self.bounds[1:]) - self.first

    def strings(self) -> list[str]:
        """The words of each line, one space between them."""
        inner = np.ones(len(self.starts), bool)
        inner[self.first[self.counts > 0]] = False
        before = self.starts[inner] - 1
        text, keep = self.text.copy(), self.word.copy()
        text[before], keep[before] = 32, True
        ends = np.concatenate([[0], np.cumsum(keep)])[self.bounds]
        out = text[keep].tobytes()
        return [out[a:b].decode("utf-8", "replace") for a, b in zip(ends, ends[1:])]

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of every word."""
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE_VALUES[self.text] * _powers(BASE, len(self.text)), dtype=np.uint64)])
        raw = (sums[self.ends] - sums[self.starts]) * _powers(INVERSE, len(self.text) + 1)[self.starts]
        return _mix(raw + (self.ends - self.starts).astype(np.uint64) * GOLDEN)


def line_hashes(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each line's sequence of ``counts`` hashed ``words``."""
    out, ends = [], np.cumsum(counts)
    rise, fall = _powers(BASE, len(words)), _powers(INVERSE, len(words) + 1)
    for salt in (np.uint64(1), np.uint64(2)):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(words ^ salt) * rise, dtype=np.uint64)])
        whole = (sums[ends] - sums[ends - counts]) * fall[ends - counts]
        out.append(_mix(whole + counts.astype(np.uint64) * GOLDEN + salt))
    return out[0], out[1]


def bit_counts(words: np.ndarray, line: np.ndarray, lines: int) -> np.ndarray:
    """lines x 64: how many of a line's hashed words have each bit; ``line`` is sorted."""
    out = np.zeros((lines, 64), np.uint32)
    if not len(words):
        return out
    n = np.bincount(line, minlength=lines)
    some = np.flatnonzero(n)
    n = n[some]
    # eight-bit counters side by side in a long: summed over 255 words at most, then widened
    runs = -(-n // 255)
    first = np.cumsum(runs) - runs
    at = np.repeat(np.cumsum(n) - n, runs) + 255 * (np.arange(runs.sum()) - np.repeat(first, runs))
    octets = words.astype("<u8").view(np.uint8).reshape(-1, 8)
    for k in range(8):
        sums = np.add.reduceat(LANES[octets[:, k]], at).astype("<u8").view(np.uint8).reshape(-1, 8)
        out[some, 8 * k : 8 * k + 8] = sums if len(sums) == len(some) else np.add.reduceat(sums, first, axis=0, dtype=np.uint32)
    return out


def _majority(ones: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.packbits(2 * ones > n[..., None], axis=-1, bitorder="little").view("<u8")[..., 0]


def blocks(words: np.ndarray, letters: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(SimHash over all words, lines x keys, lines x keys: whether a line has that key).

    A word that a line repeats counts once, else "the" alone would be the majority of its block.
    """
    lines = len(counts)
    # sorted by line, then hash: 16, 44 and 4 bits
    each = np.repeat(np.arange(lines, dtype=np.uint64), counts) << np.uint64(48) | words >> np.uint64(20) << np.uint64(4)
    each = np.sort(each | np.minimum(letters, 15).astype(np.uint64))
    each = each[np.concatenate([[True], each[1:] != each[:-1]])] if len(each) else each
    line, letters = (each >> np.uint64(48)).astype(np.int64), (each & np.uint64(15)).astype(np.int64)
    words = _mix(each >> np.uint64(4) & np.uint64((1 << 44) - 1))
    part = (words >> np.uint64(61)).astype(np.uint8)
    bits = _mix(words ^ GOLDEN)
    ones, n, size = np.zeros((PARTS, lines, 64), np.uint32), np.zeros((PARTS, lines), np.int64), np.zeros((PARTS, lines))
    for p in range(PARTS):
        own = np.flatnonzero(part == p)
        ones[p] = bit_counts(bits[own], line[own], lines)
        n[p], size[p] = np.bincount(line[own], minlength=lines), np.bincount(line[own], letters[own], lines)
    half, whole = PARTS // 2, n.sum(0)
    coarse = ones[:half] + ones[half:]
    coarse_n, coarse_size = n[:half] + n[half:], size[:half] + size[half:]
    keys, has = [], []
    salts = _mix(np.arange(1, 65, dtype=np.uint64))
    sims = _majority(coarse, coarse_n)
    for i, j in combinations(range(half), 2):
        keys.append(_mix(_mix(sims[i] + salts[len(keys)]) ^ sims[j]))
        said, size_ = coarse_n[i] + coarse_n[j], coarse_size[i] + coarse_size[j]
        enough = np.where(whole <= TINY, size_ >= TINY_LETTERS, (size_ >= SHORT_LETTERS) & (said >= SHORT_WORDS))
        has.append((whole <= SHORT) & enough)
    sims = _majority(ones, n)
    for p in range(PARTS):
        keys.append(_mix(sims[p] + salts[len(keys)]))
        has.append((whole >= LONG) & (n[p] >= LONG_WORDS) & (size[p] >= LONG_LETTERS))
    return _majority(coarse.sum(0, dtype=np.uint32), whole), np.stack(keys, 1), np.stack(has, 1)


def _slices(lines: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of lines of ``CHUNK`` bytes or so; a longer line goes alone."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(lines), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < len(lines):
        b = min(max(a + 1, int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + CHUNK, side="right"))), a + (1 << 16))
        yield a, b
        a = b


def digest_lines(lines: pa.Array) -> Iterator[tuple[int, _Lines, np.ndarray]]:
    """(number of the first line, the lines, their words' hashes), chunk by chunk."""
    worker_cache("lines")
    lines = lines.cast(pa.large_string())
    for a, b in _slices(lines):
        some = _Lines(lines.slice(a, b - a))
        yield a, some, some.hashes()


def line_digests(each: DataFrame, words: int) -> DataFrame:
    """``each(id, no, line)`` -> (id, no, h, g: two hashes of its normal words, s: their SimHash, keys: to meet on); lines of under ``words`` words are left out."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, some, hashes in digest_lines(batch.column("line")):
                h, g = line_hashes(hashes, some.counts)
                s, keys, has = blocks(hashes, some.ends - some.starts, some.counts)
                keep = some.counts >= max(words, 1)
                has = has[keep]
                offsets = np.concatenate([[0], np.cumsum(has.sum(1))]).astype(np.int32)
                own, mask = batch.slice(a, len(some.counts)), pa.array(keep)
                yield pa.RecordBatch.from_arrays(
                    [own.column("id").filter(mask), own.column("no").filter(mask), *(pa.array(x[keep].astype(np.int64)) for x in (h, g, s)),
                     pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[keep][has].astype(np.int64)))],
                    names=["id", "no", "h", "g", "s", "keys"],
                )

    return each.mapInArrow(digests, "id bigint, no int, h bigint, g bigint, s bigint, keys array<bigint>")


def _shared(a: str, b: str, most: int, part: Callable[[str, int, int], str]) -> int:
    """How many first (or last, as ``part`` counts them) signs of the two are equal, by halving."""
    low, high = 0, most
    while low < high:
        middle = (low + high + 1) // 2
        if part(a, low, middle) == part(b, low, middle):
            low = middle
        else:
            high = middle - 1
    return low


def edit_distance(a: str, b: str, most: int | None = None) -> int:
    """Levenshtein's distance, a column of the table as the bits of two whole numbers (Myers).

    If it is over ``most``, some number over ``most`` will do.
    """
    start = _shared(a, b, min(len(a), len(b)), lambda x, i, j: x[i:j])
    end = _shared(a, b, min(len(a), len(b)) - start, lambda x, i, j: x[len(x) - j : len(x) - i])
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    if not a or not b:
        return len(a) + len(b)
    most = len(a) + len(b) if most is None else most
    where: dict[str, int] = {}
    for k, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << k
    full, top, distance = (1 << len(a)) - 1, 1 << (len(a) - 1), len(a)
    plus, minus, rest = full, 0, len(b)
    for c in b:
        same = where.get(c, 0)
        down = same | minus
        across = (((same & plus) + plus) ^ plus) | same
        more, less = minus | (~(across | plus) & full), plus & across
        rest -= 1
        if more & top:
            distance += 1
        elif less & top:
            distance -= 1
        if distance - rest > most:  # it falls by one a sign at most
            return distance - rest
        more, less = (more << 1 | 1) & full, less << 1 & full
        plus, minus = (less | ~(down | more)) & full, more & down
    return distance


def within(a: str, b: str, most: int) -> bool:
    """Whether the edit distance is ``most`` at most."""
    if abs(len(a) - len(b)) > most:
        return False
    x, y = a.split(), b.split()
    if len(x) == len(y):  # word for word, which bounds the distance from above
        bound = 0
        for u, v in zip(x, y):
            if u != v:
                bound += edit_distance(u, v)
                if bound > most:
                    break
        else:
            return True
    return edit_distance(a, b, most) <= most


def all_within(texts: list[str], a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Whether the edit distances of the pairs ``texts[a]``, ``texts[b]`` are ``most`` at most, many pairs at a time.

    A path of k edits leaves the diagonal by few signs, so 64 bits hold what of a column it may
    pass (Hyyrö 2003); longer distances are worked out by ``within``.
    """
    out = np.zeros(len(a), bool)
    size = np.array([len(t) for t in texts], np.int64)
    a, b = (np.where(size[a] >= size[b], x, y) for x, y in ((a, b), (b, a)))
    long = np.flatnonzero((most > BAND) | (len(a) < FEW))
    out[long] = [within(texts[i], texts[j], k) for i, j, k in zip(a[long].tolist(), b[long].tolist(), most[long].tolist())]
    left = np.flatnonzero((most <= BAND) & (len(a) >= FEW) & (np.abs(size[a] - size[b]) <= most))
    out[left[size[b[left]] == 0]] = True
    left = left[size[b[left]] > 0]
    if not len(left):
        return out
    # the texts that take part, their signs as numbers, a row for each
    used, at = np.unique(np.concatenate([a[left], b[left]]), return_inverse=True)
    n = size[used]
    signs, code = np.unique(np.frombuffer("".join(texts[k] for k in used.tolist()).encode("utf-32-le", "surrogatepass"), "<u4"), return_inverse=True)
    begin = np.cumsum(n) - n
    words = (int(n.max()) + BAND) // 64 + 3
    order = np.lexsort((n[at[: len(left)]], at[: len(left)]))
    a, b, left = at[: len(left)][order], at[len(left) :][order], left[order]
    # texts of about the same number of bits of tables and pairs at a time
    number = np.cumsum(np.concatenate([[0], a[1:] != a[:-1]]))
    part = number // max(TABLE_BYTES // (8 * len(signs) * words), 1)
    for some in np.split(np.arange(len(a)), np.flatnonzero(part[1:] != part[:-1]) + 1):
        mine, row = np.unique(a[some], return_inverse=True)
        table = np.zeros((len(mine), len(signs), words), np.uint64)
        place = np.arange(n[mine].sum()) - np.repeat(np.cumsum(n[mine]) - n[mine], n[mine])
        own = code[np.repeat(begin[mine], n[mine]) + place]
        np.bitwise_or.at(table, (np.repeat(np.arange(len(mine)), n[mine]), own, (place >> 6) + 1), np.uint64(1) << (place & 63).astype(np.uint64))
        by_end = np.argsort(n[b[some]], kind="stable")
        for k in range(0, len(some), PAIRS):
            few = by_end[k : k + PAIRS]
            pair = some[few]
            out[left[pair]] = _banded(table.reshape(-1), row[few] * (len(signs) * words), words, code, begin[b[pair]], n[a[pair]], n[b[pair]], most[left[pair]])
    return out


def _banded(table: np.ndarray, base: np.ndarray, words: int, code: np.ndarray, begin: np.ndarray, n1: np.ndarray, n2: np.ndarray, most: np.ndarray) -> np.ndarray:
    """The bits of a column from ``below`` signs under the diagonal upwards, in the highest bit first."""
    one, high = np.uint64(1), np.uint64(63)
    out, who = np.zeros(len(base), bool), np.arange(len(base))
    below = (most + n1 - n2) // 2
    turn, end = n1 - below, n2  # the lowest bit goes along the diagonal, from ``turn`` on along the last row
    plus = ~np.uint64(0) << (63 - below).astype(np.uint64)
    minus, distance = np.zeros(len(base), np.uint64), below.copy()
    least, first = most + end - turn, int(turn.min())
    for i in range(int(n2.max())):
        bit = below + (i + 1)
        where = base + code[begin + i] * words + (bit >> 6)
        off = (bit & 63).astype(np.uint64)
        same = table[where] >> off | table[where + 1] << one << (high - off)
        zero = (((same & plus) + plus) ^ plus) | same | minus
        more, less = minus | ~(zero | plus), zero & plus
        if i < first:
            distance += (~zero >> high).astype(np.int64)
        else:
            row = np.clip(62 - (i - turn), 0, 63).astype(np.uint64)
            along = (more >> row & one).astype(np.int64) - (less >> row & one).astype(np.int64)
            distance += np.where(i < turn, (~zero >> high).astype(np.int64), along)
        zero >>= one
        plus, minus = less | ~(zero | more), zero & more
        last = end == i + 1
        if i % 16 == 15 or last.any():
            out[who[last]] = distance[last] <= most[last]
            stay = ~last & (distance <= least)
            if not stay.any():
                return out
            if not stay.all():
                who, base, begin, below, turn, end, most, least, plus, minus, distance = (x[stay] for x in (who, base, begin, below, turn, end, most, least, plus, minus, distance))
    return out


def may_be_within(one: list[str], two: list[str], sims: np.ndarray, near: np.ndarray, similarity: float) -> np.ndarray:
    """ones x twos: False where the edit distance is over its bound for certain.

    Edit distance obeys the triangle inequality, so by their distances from a common text two texts
    are at least the difference apart. It pays where pairs outnumber texts; the common text is the
    one of ``two`` whose SimHash is nearest to their majority.
    """
    longer = np.maximum(np.array([len(t) for t in one])[:, None], [len(t) for t in two])
    most = np.floor((1 - similarity) * longer + 1e-9).astype(np.int64)
    if near.sum() <= 2 * sum(near.shape):
        return np.ones(near.shape, bool)
    bits = np.unpackbits(np.ascontiguousarray(sims).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1)
    middle = np.packbits(2 * bits.sum(0) > len(bits)).view("<u8")[0]
    pivot = two[int(np.bitwise_count(sims ^ middle).argmin())]
    far = [np.array([edit_distance(t, pivot) for t in texts]) for texts in (one, two)]
    return np.abs(far[0][:, None] - far[1]) <= most


def most_edits(one: int, two: int, similarity: float) -> int:
    return int((1 - similarity) * max(one, two) + 1e-9)


def repeated_lines(docs: DataFrame, key: str, text: str, words: int, distance: int, similarity: float) -> DataFrame:
    """(id, no) of every line but the first occurrence of its group."""
    spark = docs.sparkSession
    base = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text"))
    # a row for each line, so a worker's batches are as small as its lines, however long the texts
    lines = cut(line_digests(base.select("id", F.posexplode(F.split("text", "\n", -1)).alias("no", "line")), words))
    met = lines.select(F.explode("keys").alias("b"), F.col("h").alias("id"))
    # hardly any key is shared by different lines: a first pass names those, combined per task
    shared_keys = cut(met.groupBy("b").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi").select("b"))
    release(spark)
    buckets = cut(met.join(small(shared_keys), "b").select("b", "id").distinct())

    def said(shared: DataFrame) -> DataFrame:
        """(id, s, t) of the lines that share a key: their normal words, read once more from their documents."""
        wanted = lines.join(small(cut(shared)).withColumnRenamed("id", "h"), "h", "left_semi")
        wanted = wanted.groupBy("h").agg(F.min(F.struct("id", "no")).alias("first"), F.first("s").alias("s")).select("first.*", "h", "s")
        per_doc = wanted.groupBy("id").agg(F.collect_list(F.struct("no", "h", "s")).alias("of"))  # of one document's lines
        parts = F.transform(F.array(F.split("text", "\n", -1)), lambda p: F.transform("of", lambda w: F.struct(w["h"].alias("h"), w["s"].alias("s"), F.get(p, w["no"]).alias("line"))))
        each = base.join(small(cut(per_doc)), "id").select(F.inline(parts[0])).where("line is not null")

        def normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a, some, hashes in digest_lines(batch.column("line")):
                    own = batch.slice(a, len(some.counts))
                    # rows that share an id may have other lines there
                    right = own.column("h").to_numpy() == line_hashes(hashes, some.counts)[0].astype(np.int64)
                    made = pa.RecordBatch.from_arrays([own.column("h"), own.column("s"), pa.array(some.strings(), pa.string())], names=["id", "s", "t"])
                    yield made.filter(pa.array(right))

        return each.mapInArrow(normal, "id bigint, s bigint, t string").dropDuplicates(["id"])

    def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
        one, two = (texts.select(F.col("id").alias(k), F.col("s").alias(f"s{k}")) for k in "ab")
        near = pairs.join(one, "a").join(two, "b").where(F.bit_count(F.col("sa").bitwiseXOR(F.col("sb"))) <= distance).select("a", "b")
        both = near.join(texts.select(F.col("id").alias("a"), F.col("t").alias("x")), "a").join(texts.select(F.col("id").alias("b"), F.col("t").alias("y")), "b")

        def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts, n = batch.column("x").to_pylist() + batch.column("y").to_pylist(), batch.num_rows
                most = [most_edits(len(x), len(y), similarity) for x, y in zip(texts, texts[n:])]
                keep = all_within(texts, np.arange(n), np.arange(n, 2 * n), np.array(most, np.int64))
                yield batch.select(["a", "b"]).filter(pa.array(keep))

        return both.select("a", "b", "x", "y").mapInArrow(alike, "a bigint, b bigint")

    def compare(columns: dict, asks: np.ndarray, asked: np.ndarray, may: np.ndarray) -> list[tuple[int, int]]:
        sims, t = columns["s"].view(np.uint64), columns["t"]
        apart = np.bitwise_count(sims[asks][:, None] ^ sims[asked])
        size = np.array([len(x) for x in t], np.int64)
        high = np.maximum(size[asks][:, None], size[asked])
        most = ((1 - similarity) * high + 1e-9).astype(np.int64)
        near = may & (apart <= distance) & (np.abs(size[asks][:, None] - size[asked]) <= most)
        if near.sum() > PIVOT_PAIRS * sum(near.shape):
            near &= may_be_within([t[k] for k in asks.tolist()], [t[k] for k in asked.tolist()], sims[asked], near, similarity)
        i, j = np.nonzero(near)
        order = np.lexsort((apart[i, j], i))
        i, j = i[order], j[order]
        rest = np.argsort(np.arange(len(i)) - np.searchsorted(i, i), kind="stable")
        found, group, step = [], columns["root"].copy(), STEP
        while True:
            # links already found may have connected the two
            rest = rest[group[asks[i[rest]]] != group[asked[j[rest]]]]
            if not len(rest):
                return found
            some, rest, step = rest[:step], rest[step:], 4 * step
            a, b = asks[i[some]], asked[j[some]]
            link = all_within(t, a, b, most[i[some], j[some]])
            a, b = a[link], b[link]
            if not len(a):
                continue
            between = np.sort(np.stack([group[a], group[b]], 1), axis=1)
            _, once = np.unique(between, axis=0, return_index=True)
            found += zip(columns["id"][a[once]].tolist(), columns["id"][b[once]].tolist())
            names, least = contracted(between[:, 0], between[:, 1])
            at = np.minimum(np.searchsorted(names, group), len(names) - 1)
            group = np.where(names[at] == group, least[at], group)

    roots = connected_groups(link_buckets(buckets, verify, compare, said, rounds=2)).withColumnRenamed("id", "h")
    # equal lines have both hashes in common, linked ones their root
    named = lines.select("id", "no", "h", "g").join(small(cut(roots)), "h", "left").select(
        "id", "no", F.coalesce("root", "h").alias("root"), F.when(F.col("root").isNull(), F.col("g")).otherwise(F.lit(0)).alias("g")
    )
    groups = cut(named.groupBy("root", "g").agg(F.min("id").alias("keep_id"), F.count("*").alias("n")).where("n > 1").select("root", "g", "keep_id"))
    repeated = cut(named.join(small(groups), ["root", "g"]))
    first = repeated.where("id = keep_id").groupBy("root", "g").agg(F.min("no").alias("keep_no"))
    return repeated.join(small(cut(first)), ["root", "g"]).where("id <> keep_id OR no <> keep_no").select("id", "no")


def dedup_lines(
    docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 1, distance: int = DISTANCE, similarity: float = SIMILARITY,
) -> DataFrame:
    """``docs`` with text cut to the lines that stay, and removed_lines (sorted numbers from 0).

    The first occurrence of a group is the one with the smallest (id, line number). Lines with the
    same normal words are one group, however short; lines of under ``words`` words stay, as do those
    without any. Rows that share an id count as one document and lose the same lines; rows with a
    null id or text stay as they are. Empty tables give empty results. A clashing column
    removed_lines is replaced.
    """
    repeated = repeated_lines(docs, key, text, words, distance, similarity)
    gone = cut(repeated.groupBy("id").agg(F.sort_array(F.collect_set("no")).alias("gone")))  # of one document
    release(docs.sparkSession)
    rows = docs.select(whole_rows(docs, "removed_lines"), F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"))
    count, numbers = gone.agg(F.count("*"), F.sum(F.size("gone"))).first()
    few = F.broadcast(gone) if 32 * count + 4 * (numbers or 0) <= BROADCAST_BYTES else gone
    joined = rows.join(few, F.col("key") == F.col("id"), "left")
    stays = F.filter(
        F.transform(F.split("text", "\n", -1), lambda x, i: F.when(~F.array_contains("gone", i), x)), lambda x: x.isNotNull()
    )
    left = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(stays, "\n"))
    kept = [left.alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns if c.lower() != "removed_lines"]
    return joined.select(*kept, F.coalesce("gone", F.expr("cast(array() as array<int>)")).alias("removed_lines"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text without repeated lines. Null and empty texts and null ids stay as they are; rows that share an id lose the same lines; an empty table gives an empty result."""
    docs = documents(spark, sf_dir).select("doc_id", "text", F.size(F.split("text", "\n", -1)).alias("n_lines"))
    return dedup_lines(docs).select("doc_id", "n_lines", F.size("removed_lines").alias("n_removed"), "removed_lines", "text")


ship(__name__)
