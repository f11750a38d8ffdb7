"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

A lexicon of words and word beginnings is learned from labelled texts by how much oftener they
stand in toxic ones. A text's features are rates of lexicon words, their nearness to the second
person, capitals, punctuation and obfuscated spellings. The trees are fitted on the driver on the
features (a few dozen numbers) of a bounded sample of labelled rows; scoring covers every whole text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, documents, ship, slices, worker_cache

#: Labelled rows that a model is fitted on, at most about so many, chosen by a hash of the id.
SAMPLE_ROWS = 20_000
#: Lexicon entries, the most telling ones first.
LEXICON_ENTRIES = 4_000
#: Likelihood-ratio statistic that an entry needs (25: chance of about 1 in 2 million by accident).
LEXICON_G2 = 25.0
THRESHOLD = 0.3
PREFIXES = (4, 5, 6)
#: Words that a worker keeps numbers of, and entries that a task counts before it hands them on.
KEPT_WORDS, HELD_ENTRIES = 200_000, 100_000
#: Folds of calibration; a row's features come from the lexicon of the other folds.
FOLDS = 4
YOU = frozenset(
    "you your yours yourself u ur thou tu te toi ton ta tes vous votre vos du dich dir dein deine deiner ihr euch euer "
    "usted ustedes tú ti tus su sus vosotros vosotras".split()
)
PLAIN = str.maketrans("013457@$!|", "oieastasil")
EDGES = re.compile(r"^\W+|\W+$")
HIDDEN = re.compile(r"[^\W\d_][*@$%#!|&+0-9]+[^\W\d_]")
FEATURES = (
    "words", "hits", "hits_strong", "weight", "mean_hit", "distinct", "near_you", "you", "capitals", "shouted",
    "exclaims", "asks", "marks", "hidden", "hidden_hits", "word_length", "hit_count",
)
WORD_COLUMNS = 13


# --- words ----------------------------------------------------------------------------------


def _variants(word: str) -> list[str]:
    """What a word is looked up under: itself and its beginnings (marked by a trailing '~')."""
    return [word, *(word[:n] + "~" for n in PREFIXES if len(word) > n)]


def _core(word: str) -> str:
    return EDGES.sub("", word.lower())


class _Words:
    """Rows of numbers for words, kept per worker up to a bound."""

    def __init__(self, lexicon: dict[str, float], most: int = KEPT_WORDS):
        self.lexicon, self.most = lexicon, most
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.rows: list[tuple] = []
        self.table = np.zeros((0, WORD_COLUMNS), np.float32)

    def row(self, w: str) -> tuple:
        core = _core(w)
        weight = max((self.lexicon.get(v, 0.0) for v in _variants(core)), default=0.0)
        hidden = bool(HIDDEN.search(w))
        hidden_weight = 0.0
        if hidden:
            plain = _core(core.translate(PLAIN))
            hidden_weight = max((self.lexicon.get(v, 0.0) for v in _variants(plain)), default=0.0)
            weight = max(weight, hidden_weight)
        letters = sum(map(str.isalpha, w))
        upper = sum(map(str.isupper, w))
        return (
            1, weight > 0, weight > 3, weight, core in YOU, letters, upper, letters > 2 and upper == letters,
            w.count("!"), w.count("?"), len(w) - letters, hidden, hidden_weight > 0,
        )

    def numbers(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        at = self.at
        if new := [w for w in dict.fromkeys(words) if w not in at]:
            if len(at) + len(new) > self.most:
                self.clear()
                at, new = self.at, list(dict.fromkeys(words))
            for w in new:
                at[w] = len(at)
            made = np.array([self.row(w) for w in new], np.float32)
            end = len(at)
            if end > len(self.table):
                grown = np.zeros((max(end, 2 * len(self.table), 4096), WORD_COLUMNS), np.float32)
                grown[: end - len(new)] = self.table[: end - len(new)]
                self.table = grown
            self.table[end - len(new) : end] = made
        where = np.fromiter(map(at.__getitem__, words), np.int64, len(words))
        return self.table[where], where


def _text_features(text: str | None, words: _Words) -> list[float]:
    said = (text or "").split()
    if not said:
        return [0.0] * len(FEATURES)
    t, where = words.numbers(said)
    total = t.sum(0, dtype=np.float64)
    n, letters = total[0], max(total[5], 1.0)
    hits, you = np.flatnonzero(t[:, 1]), np.flatnonzero(t[:, 4])
    near = 0.0
    if len(hits) and len(you):
        i = np.searchsorted(you, hits)
        gap = np.minimum(np.abs(hits - you[np.minimum(i, len(you) - 1)]), np.abs(hits - you[np.maximum(i - 1, 0)]))
        near = float((1 / (1 + gap)).mean())
    return [
        float(np.log1p(n)), total[1] / n, total[2] / n, total[3] / n, total[3] / max(total[1], 1.0),
        float(np.log1p(len(np.unique(where[hits])))), near, total[4] / n, total[6] / letters, total[7] / n,
        total[8] / n, total[9] / n, total[10] / (letters + total[10]), total[11] / n, total[12] / n, letters / n,
        float(np.log1p(total[1])),
    ]


# --- lexicon --------------------------------------------------------------------------------


def learn_lexicon(labelled: DataFrame, text: str = "text", label: str = "label") -> dict[str, float]:
    """Words and beginnings with their log odds, from ``labelled``: at most ``LEXICON_ENTRIES``."""
    return learn_lexicons(labelled.select(text, label, F.lit(0).alias("fold")), text, label, "fold", 0)[0]


def learn_lexicons(labelled: DataFrame, text: str, label: str, fold: str, folds: int) -> list[dict[str, float]]:
    """The lexicon of all of ``labelled``, then for each fold (0..) the one of the rows outside it.

    A text counts an entry once; a null text has none. Counts are combined per task, then by entry;
    a task without rows gives none. A lexicon is empty where one of the classes is missing.
    """
    parts = max(folds, 1)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("toxic words")
        found: dict[str, list[int]] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(found.values(), pa.list_(pa.int32()))], names=["entry", "n"])

        for batch in batches:
            for texts, places in zip(slices(batch.column("t")), slices(batch.column("at")), strict=True):
                for t, at in zip(texts, places, strict=True):
                    for v in {v for w in set((t or "").split()) if (k := _core(w)) for v in _variants(k)}:
                        if v not in found:
                            found[v] = [0] * (2 * parts)
                        found[v][at] += 1
                    if len(found) > HELD_ENTRIES:
                        yield out()
                        found.clear()
        if found:
            yield out()

    # of a fold k, clean rows are counted at 2k and toxic ones at 2k + 1
    at = (2 * F.col(fold) + F.col(label)).cast("int")
    rows = labelled.select(F.col(text).alias("t"), at.alias("at"))
    size = {r["at"]: r["count"] for r in rows.groupBy("at").count().collect()}  # two rows a fold
    counts = cut(
        rows.mapInArrow(counted, "entry string, n array<int>")
        .groupBy("entry").agg(F.array(*(F.sum(F.col("n")[k]) for k in range(2 * parts))).alias("n"))
    )

    def best(without: int | None) -> dict[str, float]:
        own = [k for k in range(parts) if k != without]
        clean, toxic = (float(sum(size.get(2 * k + y, 0) for k in own)) for y in (0, 1))
        if not toxic or not clean:
            return {}
        rate = toxic / (toxic + clean)
        b, a = (sum((F.col("n")[2 * k + y] for k in own), F.lit(0)) for y in (0, 1))
        named = counts.select("entry", a.alias("a"), b.alias("b")).where("a >= 3")
        a, b, both = F.col("a"), F.col("b"), F.col("a") + F.col("b")
        g2 = 2 * (a * F.log(a / (both * rate)) + F.when(b > 0, b * F.log(b / (both * (1 - rate)))).otherwise(0.0))
        odds = F.log((a + 0.5) / (toxic + 1)) - F.log((b + 0.5) / (clean + 1))
        top = (
            named.withColumns({"g2": g2, "odds": odds}).where((F.col("g2") > LEXICON_G2) & (F.col("odds") > 1.5))
            .orderBy(F.desc("g2"), "entry").limit(LEXICON_ENTRIES)
        )
        return {r["entry"]: float(r["odds"]) for r in top.collect()}

    return [best(None), *(best(k) for k in range(folds))]


# --- trees ----------------------------------------------------------------------------------


@dataclass
class Trees:
    """Depth-limited regression trees on binned features; a tree's nodes lie level by level."""

    base: float
    features: np.ndarray  # trees x inner nodes
    cuts: np.ndarray
    leaves: np.ndarray  # trees x 2 ** depth

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        depth = int(np.log2(self.leaves.shape[1])) if self.leaves.size else 0
        for f, c, leaf in zip(self.features, self.cuts, self.leaves, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, f[node]] > c[node])
            out += leaf[node - (2**depth - 1)]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 48, l2: float = 1.0) -> Trees:
    """Newton boosting of the logistic loss on quantile bins. Rows that tie in a feature stay together; a
    constant feature is never split; without rows of both classes the trees say the mean."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    code = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
    p0 = min(max(y.mean(), 1e-3), 1 - 1e-3)
    base = float(np.log(p0 / (1 - p0)))
    raw, out = np.full(len(y), base), ([], [], [])
    inner = 2**depth - 1
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, p * (1 - p)
        node, f, c = np.zeros(len(y), np.int64), np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            own = node - first
            best = np.full(width, 1e-9)
            for j, e in enumerate(edges):
                k = len(e) + 1
                key = own * k + code[:, j]
                gs = np.bincount(key, g, width * k).reshape(width, k).cumsum(1)
                hs = np.bincount(key, h, width * k).reshape(width, k).cumsum(1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + l2) + (gt - gs) ** 2 / (ht - hs + l2) - gt**2 / (ht + l2)
                gain = np.where((hs < 0.5) | (ht - hs < 0.5), 0, gain)[:, :-1]
                if not gain.shape[1]:
                    continue
                at = gain.argmax(1)
                for i in np.flatnonzero(gain[np.arange(width), at] > best):
                    best[i], f[first + i], c[first + i] = gain[i, at[i]], j, e[at[i]]
            node = 2 * node + 1 + (x[np.arange(len(x)), f[node]] > c[node])
        own = node - inner
        gs, hs = np.bincount(own, g, inner + 1), np.bincount(own, h, inner + 1)
        leaf = rate * gs / (hs + l2)
        raw += leaf[own]
        for o, v in zip(out, (f, c, leaf), strict=True):
            o.append(v)
    return Trees(base, *map(np.array, out))


def fit_isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots (raw score, probability) to interpolate between."""
    order = np.argsort(raw, kind="stable")
    blocks: list[list[float]] = []  # mean, weight, lowest, highest
    for r, v in zip(raw[order], y[order], strict=True):
        blocks.append([float(v), 1.0, r, r])
        while len(blocks) > 1 and (blocks[-2][0] >= blocks[-1][0] or blocks[-2][3] == blocks[-1][2]):
            m, w, _, high = blocks.pop()
            b = blocks[-1]
            b[0], b[1], b[3] = (b[0] * b[1] + m * w) / (b[1] + w), b[1] + w, high
    knots = [(x, m) for m, _, low, high in blocks for x in dict.fromkeys((low, high))]
    return np.array([k[0] for k in knots]), np.array([k[1] for k in knots])


# --- model ----------------------------------------------------------------------------------


@dataclass
class ToxicityModel:
    lexicon: dict[str, float]
    trees: Trees | None
    knots: tuple[np.ndarray, np.ndarray]
    prior: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probabilities, strictly rising in the trees' score but for rounding."""
        if self.trees is None:
            return np.full(len(x), self.prior)
        raw = self.trees.raw(x)
        return np.clip(0.98 * np.interp(raw, *self.knots) + 0.02 / (1 + np.exp(-raw)), 0, 1)


def _features(lexicons: list[dict[str, float]]):
    """(text, fold) -> features by the fold's lexicon."""

    @F.arrow_udf("array<double>")
    def features(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        worker_cache("toxic features")
        words = [_Words(lexicon, KEPT_WORDS // len(lexicons)) for lexicon in lexicons]
        for texts, folds in batches:
            found = [_text_features(t, words[k]) for some, which in zip(slices(texts), slices(folds), strict=True) for t, k in zip(some, which, strict=True)]
            yield pa.array(found, pa.list_(pa.float64()))

    return features


def _words(lexicon: dict[str, float]) -> _Words:
    cache = worker_cache("toxicity")
    key = hash(frozenset(lexicon.items()))
    if cache.get("of") != key:
        cache.update(of=key, words=_Words(lexicon))
    return cache["words"]


def fit_toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = SAMPLE_ROWS) -> ToxicityModel:
    """Fit on the rows of ``labels`` (at most about ``rows``, chosen by a hash of the key).

    Null keys and labels are left out; a key with several labels counts as its largest. Without
    texts of both classes the model gives the labels' mean (0 without any) as every score. Null and
    empty texts have features of 0; repeated rows of a labelled key count each.
    """
    named = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key).agg(F.max(label).cast("int").alias("label"))
    size = named.count()
    share = F.pmod(F.xxhash64(F.lit(17), F.col(key)), F.lit(1_000_000_007)) / 1_000_000_007.0
    chosen = named if size <= rows else named.where(share < rows / size)
    # at most ``rows`` ids, so the texts are found without moving the others
    texts = cut(docs.select(key, text).join(F.broadcast(chosen), key).select(F.xxhash64(key).alias("h"), text, "label"))
    texts = texts.withColumn("fold", F.pmod("h", F.lit(FOLDS)).cast("int"))
    lexicon, *others = learn_lexicons(texts, text, "label", "fold", FOLDS)
    found = texts.select("h", "label", "fold", _features(others)(F.col(text), F.col("fold")).alias("x")).toPandas().sort_values(["h"], kind="stable")
    y = found["label"].to_numpy(float)
    prior = float(y.mean()) if len(y) else 0.0
    if len(y) < 10 or y.min() == y.max():
        return ToxicityModel(lexicon, None, (np.zeros(1), np.zeros(1)), prior)
    # no row's features know its label, and calibration is by scores of rows that the trees of that fold haven't seen
    x, fold, held = np.stack(found["x"].to_numpy()), found["fold"].to_numpy(), np.zeros(len(y))
    for k in range(FOLDS):
        own = fold == k
        if own.any() and not own.all():
            held[own] = fit_trees(x[~own], y[~own]).raw(x[own])
    return ToxicityModel(lexicon, fit_trees(x, y), fit_isotonic(held, y), prior)


def score_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text", score: str = "score") -> DataFrame:
    """``docs`` with the model's score of every whole text (0 to 1); null counts as empty."""

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words = _words(model.lexicon)
        for texts in batches:
            found = [np.zeros(0)]
            for some in slices(texts):
                x = np.array([_text_features(t, words) for t in some]).reshape(len(some), len(FEATURES))
                found.append(model.scores(x))
            yield pa.array(np.concatenate(found))

    return docs.withColumn(score, scored(F.col(text)))


def training_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels that may be learned from: crc32(doc_id as text) mod 4 is not 2."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score. Null and empty texts are scored by features of 0; repeated rows get equal scores; a null id isn't held out (null); an empty table gives an empty result."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = fit_toxicity(docs, training_labels(spark, sf_dir))
    return score_toxicity(docs, model).select(
        "doc_id", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


ship(__name__)
