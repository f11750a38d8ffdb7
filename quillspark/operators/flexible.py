"""Flexible queries: a matrix of query tokens by fields, scored by a model over its cells."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.analyzers import analyzer
from ..plans import nodes as N
from .match import positions, tokens
from .scoring import norm, term_frequency


def query_tokens(n: N.Flexible) -> list[tuple[str, float]]:
    """Weighted tokens: ``a^3 b``; text that isn't only weighted words is analysed plainly."""
    cut = analyzer(next((f.analyzer for f, _ in n.fields if f.tokenized), "standard"))
    words = n.text.split()
    if any(re.search(r'[()\[\]{}"~:/*?!+&|]', w) for w in words):
        return [(t, 1.0) for t in cut.query(n.text)]
    out = []
    for w in words:
        text, _, boost = w.partition("^")
        try:
            weight = float(boost) if boost else 1.0
        except ValueError:
            return [(t, 1.0) for t in cut.query(n.text)]
        out += [(t, weight) for t in cut.query(text)]
    return out


def _matched(f, token: str) -> Column:
    if f.tokenized or f.multi:
        return F.coalesce(F.array_contains(tokens(f), F.lit(token)), F.lit(False))
    return F.coalesce(f.column == F.lit(token), F.lit(False))


def flexible_predicate(n: N.Flexible) -> Column:
    words = query_tokens(n)
    if not words or not n.fields:
        return F.lit(False)
    each = []
    for t, _ in words:
        hit = _matched(n.fields[0][0], t)
        for f, _ in n.fields[1:]:
            hit = hit | _matched(f, t)
        each.append(hit)
    least = len(words) if n.full_match else max(1, math.ceil(n.match_ratio * len(words) - 1e-9)) if n.match_ratio > 0 else 1
    if least <= 1:
        out = each[0]
        for e in each[1:]:
            out = out | e
        return out
    return sum((e.cast("int") for e in each[1:]), each[0].cast("int")) >= least


def _idf(n: N.Flexible, scorer, f, token: str) -> float:
    if n.global_idf:
        over = n.global_fields or tuple(f for f, _ in n.fields)
        df = max(scorer.stats.df.get((g.name, token), 0) for g in over)
        return 1 + math.log(scorer.stats.docs / (df + 1)) if scorer.stats.docs else 0.0
    return scorer.similarity.idf(scorer.stats, f.name, token)


def flexible_weight(n: N.Flexible, scorer) -> float:
    words = query_tokens(n)
    return n.boost**2 * sum((_idf(n, scorer, f, t) * w) ** 2 for f, _ in n.fields for t, w in words)


class Matrix:
    """What model code sees: fields i, tokens j."""

    def __init__(self, n: N.Flexible, scorer, by: float, qn: float):
        self.n, self.words, self.by, self.qn, self.scorer = n, query_tokens(n), by, qn, scorer

    def field(self, i: int):
        return self.n.fields[i][0]

    def matched(self, i: int, j: int) -> Column:
        return _matched(self.field(i), self.words[j][0])

    def raw(self, i: int, j: int) -> Column:
        f, (t, w) = self.field(i), self.words[j]
        idf = _idf(self.n, self.scorer, f, t)
        value = F.sqrt(term_frequency(f, t)) * F.lit(idf * idf * w * self.by * self.qn) * norm(f, self.scorer.similarity)
        return F.when(self.matched(i, j), value).otherwise(0.0)

    def frequency(self, i: int, j: int) -> Column:
        return F.when(self.matched(i, j), term_frequency(self.field(i), self.words[j][0])).otherwise(0.0).cast("int")

    def positions(self, i: int, j: int) -> Column:
        """Positions, stopwords' places included."""
        f = self.field(i)
        if f.tokenized:
            return positions(f, self.words[j][0])
        return F.when(self.matched(i, j), F.array(F.lit(0))).otherwise(F.expr("cast(array() as array<int>)"))


def flexible_score(n: N.Flexible, scorer, by: float, qn: float) -> tuple[Column, Column]:
    from .scoremodel import run_model
    from .scoring import _explain

    value, told = run_model(n.model, scorer.schema, Matrix(n, scorer, by, qn), None, None)
    return value, told if told is not None else _explain(value, f"model {n.model.name}")
