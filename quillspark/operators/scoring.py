"""Nodes to score columns: TF-IDF with coordination, boosts and query normalisation, or BM25.

Only statistics of the query's own terms are collected: one row. They enter the plan as literals.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.analyzers import analyzer
from ..plans import nodes as N
from ..schema import Field, Schema
from .match import between, phrase_count, predicate, tokens


@dataclass
class Statistics:
    """Documents, document frequencies by (field, token), mean lengths by field."""

    docs: int = 0
    df: dict[tuple[str, str], int] = field(default_factory=dict)
    length: dict[str, float] = field(default_factory=dict)


@dataclass(frozen=True)
class Similarity:
    """``kind``: tfidf or bm25. ``dictionary``: token -> idf, unknown tokens have the largest of them;
    ``norm_floor`` then lifts norms to floor + (1 - floor) * norm."""

    kind: str = "tfidf"
    dictionary: dict[str, float] | None = None
    norm_floor: float = 0.0
    k1: float = 1.2
    b: float = 0.75

    def idf(self, s: Statistics, name: str, token: str) -> float:
        if self.dictionary is not None:
            return self.dictionary.get(token, max(self.dictionary.values(), default=1.0))
        df = s.df.get((name, token), 0)
        if self.kind == "bm25":
            return math.log(1 + (s.docs - df + 0.5) / (df + 0.5))
        return 1 + math.log(s.docs / (df + 1)) if s.docs else 0.0


def query_terms(node: N.Node | None) -> list[tuple[Field, str]]:
    out: dict[tuple[str, str], tuple[Field, str]] = {}

    def walk(n) -> None:
        if isinstance(n, N.Term):
            out[n.field.name, n.token] = n.field, n.token
        elif isinstance(n, N.Phrase):
            for _, t in n.terms:
                out[n.field.name, t] = n.field, t
        elif isinstance(n, N.Bool):
            for c in (*n.must, *n.should):
                walk(c)
        elif isinstance(n, N.Filtered):
            walk(n.query)
        elif isinstance(n, N.DisMax):
            for c in n.parts:
                walk(c)
        elif isinstance(n, N.Flexible):
            from .flexible import query_tokens

            for f in {f.name: f for f in (*(f for f, _ in n.fields), *n.global_fields)}.values():
                for t, _ in query_tokens(n):
                    out[f.name, t] = f, t

    if node is not None:
        walk(node)
    return list(out.values())


def collect_statistics(df: DataFrame, node: N.Node | None, similarity: Similarity) -> Statistics:
    """One pass, one row: partial counts are combined before the shuffle."""
    terms = query_terms(node)
    if not terms:
        return Statistics()
    fields = {f.name: f for f, _ in terms}
    counts = [F.count("*").alias("n")]
    counts += [
        F.sum(F.array_contains(tokens(f), F.lit(t)).cast("bigint")).alias(f"t{i}") if f.tokenized or f.multi
        else F.sum((f.column == F.lit(t)).cast("bigint")).alias(f"t{i}")
        for i, (f, t) in enumerate(terms)
    ]
    if similarity.kind == "bm25":
        counts += [F.avg(F.when(field_length(f) > 0, field_length(f))).alias(f"l{i}") for i, f in enumerate(fields.values())]
    row = df.agg(*counts).first()
    return Statistics(
        row["n"], {(f.name, t): row[f"t{i}"] or 0 for i, (f, t) in enumerate(terms)},
        {name: row[f"l{i}"] or 0.0 for i, name in enumerate(fields)} if similarity.kind == "bm25" else {},
    )


def field_length(f: Field) -> Column:
    own = tokens(f)
    if f.tokenized and (stop := analyzer(f.analyzer).stopwords):
        own = F.filter(own, lambda t: ~t.isin(*stop))
    return F.size(own)


def norm(f: Field, similarity: Similarity) -> Column:
    """1 / sqrt(length) as it comes out of one byte: a power of two and two bits of fraction."""
    if f.omit_norms:
        return F.lit(1.0)
    n = F.greatest(field_length(f), F.lit(1)).cast("double")
    p = F.pow(F.lit(2.0), F.floor(-F.log2(n) / 2))
    out = p * (1 + F.floor((1 / F.sqrt(n) / p - 1) * 4 + 1e-9) / 4)
    return F.lit(similarity.norm_floor) + (1 - similarity.norm_floor) * out if similarity.norm_floor else out


def term_frequency(f: Field, token: str) -> Column:
    if f.omit_freqs:
        return F.lit(1.0)
    if f.tokenized or f.multi:
        return F.size(F.filter(tokens(f), lambda t: t == F.lit(token))).cast("double")
    return F.lit(1.0)


@dataclass
class Scorer:
    stats: Statistics
    similarity: Similarity = field(default_factory=Similarity)
    schema: Schema | None = None

    def weight(self, n: N.Node) -> float:
        """The node's share of the sum of squares that queries are normalised by."""
        if isinstance(n, N.Term):
            return (self.similarity.idf(self.stats, n.field.name, n.token) * n.boost) ** 2
        if isinstance(n, N.Phrase):
            return (self._phrase_idf(n) * n.boost) ** 2
        if isinstance(n, N.Bool):
            return n.boost**2 * sum(map(self.weight, (*n.must, *n.should)))
        if isinstance(n, N.DisMax):
            parts = [self.weight(p) for p in n.parts]
            return n.boost**2 * ((sum(parts) - max(parts)) * n.tie**2 + max(parts))
        if isinstance(n, N.Filtered):
            return n.boost**2 * self.weight(n.query)
        if isinstance(n, N.Flexible):
            from .flexible import flexible_weight

            return flexible_weight(n, self)
        return n.boost**2

    def _phrase_idf(self, n: N.Phrase) -> float:
        return sum(self.similarity.idf(self.stats, n.field.name, t) for _, t in n.terms)

    def norm_of(self, n: N.Node) -> float:
        if self.similarity.kind == "bm25":
            return 1.0
        total = self.weight(n)
        return 1 / math.sqrt(total) if total > 0 and math.isfinite(total) else 1.0

    def score(self, n: N.Node) -> Column:
        """The score of a row that the node matches."""
        return self.part(n, 1.0, self.norm_of(n))[0]

    def explained(self, n: N.Node) -> Column:
        """The score's make-up as JSON."""
        return self.part(n, 1.0, self.norm_of(n))[1]

    def part(self, n: N.Node, top: float, qn: float) -> tuple[Column, Column]:
        by = n.boost * top
        if isinstance(n, (N.Term, N.Phrase)):
            phrase = isinstance(n, N.Phrase)
            freq = phrase_count(n) if phrase else term_frequency(n.field, n.token)
            idf = self._phrase_idf(n) if phrase else self.similarity.idf(self.stats, n.field.name, n.token)
            name = f"{n.field.name}:" + (" ".join(t for _, t in n.terms) if phrase else n.token)
            if self.similarity.kind == "bm25":
                s = self.similarity
                mean = self.stats.length.get(n.field.name) or 1.0
                long = F.lit(1.0) if n.field.omit_norms else (1 - s.b) + s.b * field_length(n.field) / mean
                value = F.lit(idf * by * (s.k1 + 1)) * freq / (freq + s.k1 * long)
            else:
                value = F.sqrt(freq) * F.lit(idf * idf * by * qn) * norm(n.field, self.similarity)
            return value, _explain(value, f"weight({name})", _explain(freq, "frequency"), _explain(F.lit(idf), "idf"))
        if isinstance(n, N.Bool):
            return self._boolean(n, by, qn)
        if isinstance(n, N.DisMax):
            parts = []
            for p in n.parts:
                value, told = self.part(p, by, qn)
                hit = F.coalesce(predicate(p), F.lit(False))
                parts.append((F.when(hit, value).otherwise(0.0), F.when(hit, told)))
            total = sum((v for v, _ in parts[1:]), parts[0][0])
            best = F.greatest(*(v for v, _ in parts)) if len(parts) > 1 else parts[0][0]
            value = best + n.tie * (total - best)
            return value, _explain(value, f"max plus {n.tie} times others", *(t for _, t in parts))
        if isinstance(n, N.Filtered):
            return self.part(n.query, by, qn)
        if isinstance(n, N.Flexible):
            from .flexible import flexible_score

            return flexible_score(n, self, by, qn)
        value = F.lit(by * qn)
        return value, _explain(value, f"constant({type(n).__name__.lower()})")

    def _boolean(self, n: N.Bool, by: float, qn: float) -> tuple[Column, Column]:
        parts = []
        for c in n.must:
            value, told = self.part(c, by, qn)
            parts.append((F.lit(True), value, told))
        for c in n.should:
            value, told = self.part(c, by, qn)
            parts.append((F.coalesce(predicate(c), F.lit(False)), value, told))
        if not parts:
            return F.lit(by * qn), _explain(F.lit(by * qn), "constant")
        values = [v if i < len(n.must) else F.when(hit, v).otherwise(0.0) for i, (hit, v, _) in enumerate(parts)]
        total = sum(values[1:], values[0])
        told = [t if i < len(n.must) else F.when(hit, t) for i, (hit, _, t) in enumerate(parts)]
        if n.disable_coord or self.similarity.kind == "bm25" or len(parts) == 1:
            return total, _explain(total, "sum of", *told)
        matched = sum((h.cast("int") for h, _, _ in parts[1:]), parts[0][0].cast("int"))
        value = total * (matched / F.lit(float(len(parts))))
        return value, _explain(value, f"sum times matched of {len(parts)}", *told)


def _explain(value: Column, text: str, *details: Column) -> Column:
    words = F.to_json(F.struct(F.lit(text).alias("t")))
    inner = F.concat_ws(",", *details) if details else F.lit("")
    return F.concat(
        F.lit('{"value":'), value.cast("double").cast("string"), F.lit(',"description":'), F.substring(words, 6, 1 << 30).substr(F.lit(1), F.length(words) - 6),
        F.lit(',"details":['), inner, F.lit("]}"),
    )


__all__ = ["Scorer", "Similarity", "Statistics", "between", "collect_statistics", "norm", "query_terms"]
