"""Nodes to predicate columns.

Leaves are bare comparisons, so scans can use them; ``coalesce`` is put on only where a node is
negated, because there a missing value must count as "doesn't match".
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.analyzers import analyzer
from ..functions.geo import distance_km, within_box
from ..plans import nodes as N
from ..schema import Field



def token_column(f: Field) -> str:
    """The derived column that holds a field's tokens, stopwords kept: their places are positions."""
    return f"__tokens_{f.name}"


def token_fields(node: N.Node | None) -> dict[str, Field]:
    """The tokenized fields that a node looks into."""
    out: dict[str, Field] = {}

    def walk(n) -> None:
        if isinstance(n, (N.Term, N.Phrase, N.Pattern, N.Fuzzy, N.Range)) and n.field.tokenized:
            out[n.field.name] = n.field
        elif isinstance(n, N.Bool):
            for c in (*n.must, *n.should, *n.must_not):
                walk(c)
        elif isinstance(n, N.Filtered):
            walk(n.query)
            walk(n.filter)
        elif isinstance(n, N.DisMax):
            for c in n.parts:
                walk(c)
        elif isinstance(n, N.Flexible):
            for f, _ in (*n.fields, *((g, 1.0) for g in n.global_fields)):
                if f.tokenized:
                    out[f.name] = f

    if node is not None:
        walk(node)
    return out


def tokens(f: Field) -> Column:
    """A field's searchable tokens: analysed ones, or its values as they are."""
    if f.tokenized:
        return F.col(f"`{token_column(f)}`")
    one = f.column
    return one if f.multi else F.when(one.isNotNull(), F.array(one)).otherwise(F.expr("cast(array() as array<string>)"))


def with_tokens(df, fields: dict[str, Field]):
    """``df`` with the token columns that it doesn't have already (an index table has them)."""
    missing = {token_column(f): analyzer(f.analyzer).all_tokens(f.column) for f in fields.values() if token_column(f) not in df.columns}
    return df.withColumns(missing) if missing else df


def _any(f: Field, test) -> Column:
    """``test`` on the field's value, on some value, or on some token."""
    if f.tokenized:
        stop = analyzer(f.analyzer).stopwords
        own = tokens(f)
        return F.exists(own, lambda t: test(t) & ~t.isin(*stop)) if stop else F.exists(own, test)
    return F.exists(f.column, test) if f.multi else test(f.column)


def between(c: Column, n: N.Range) -> Column:
    out = None
    for bound, closed, closed_op, open_op in ((n.low, n.with_low, "ge", "gt"), (n.high, n.with_high, "le", "lt")):
        if bound is not None:
            value = F.lit(bound)
            part = {"ge": c >= value, "gt": c > value, "le": c <= value, "lt": c < value}[closed_op if closed else open_op]
            out = part if out is None else out & part
    return c.isNotNull() if out is None else out


def once(c: Column, body) -> Column:
    """``body`` of a value worked out once. A column that lambdas name may be put into them as its own
    expression, and a text cut into words again for each element; a lambda's variable is not."""
    return F.get(F.transform(F.array(c), body), F.lit(0))


def _places(own: Column, token: str) -> Column:
    return F.filter(F.transform(own, lambda t, i: F.when(t == token, i)), lambda i: i.isNotNull())


def positions(f: Field, token: str) -> Column:
    return _places(tokens(f), token)


#: Up to this slop a token is looked for at the places around its own, beyond it among all its places.
NEAR = 16


def phrase_count(n: N.Phrase) -> Column:
    """How often the phrase stands there; with slop, each first token's best match weighs 1 / (distance + 1)."""
    return once(tokens(n.field), lambda own: _phrase_count(n, own))


def _phrase_count(n: N.Phrase, own: Column) -> Column:
    first, rest = _places(own, n.terms[0][1]), n.terms[1:]

    def stands(token: str, at: Column) -> Column:
        return F.coalesce(F.get(own, at.cast("int")) == token, F.lit(False))

    if not n.slop:
        return F.size(F.filter(first, lambda i: _fold([stands(t, i + p) for p, t in rest] or [F.lit(True)], lambda a, b: a & b))).cast("double")

    def weighed(off) -> Column:
        """``off``: how far every other token is from its place in the phrase, for a first token's place; it adds up."""
        def weight(i):
            total = _fold(off(i), lambda a, b: a + b)
            return F.when(total <= n.slop, 1.0 / (total + 1.0)).otherwise(0.0)

        return F.aggregate(F.transform(first, weight), F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))

    if n.slop <= NEAR:
        steps = F.array(*(F.lit(d) for d in range(n.slop + 1)))
        return weighed(lambda i: [F.array_min(F.filter(steps, _beside(stands, t, i + p))) for p, t in rest])
    return once(F.array(*(_places(own, t) for _, t in rest)), lambda at: weighed(lambda i: [F.array_min(F.transform(at[k], _off(i, p))) for k, (p, _) in enumerate(rest)]))


def _beside(stands, token: str, at: Column):
    return lambda d: stands(token, at - d) | stands(token, at + d)


def _off(i: Column, p: int):
    return lambda j: F.abs(j - i - p)


def predicate(n: N.Node) -> Column:
    if isinstance(n, (N.MatchAll, N.MatchNone)):
        return F.lit(isinstance(n, N.MatchAll))
    if isinstance(n, N.Term):
        if not n.field.searchable:
            return F.lit(False)
        if n.field.tokenized and n.token in analyzer(n.field.analyzer).stopwords:
            return F.lit(False)
        if n.field.tokenized or n.field.multi:
            return F.array_contains(tokens(n.field), F.lit(n.token))
        return n.field.column == F.lit(n.token)
    if isinstance(n, N.Range):
        if not n.field.searchable:
            return F.lit(False)
        if n.low is not None and n.low == n.high and n.with_low and n.with_high and not (n.field.tokenized or n.field.multi):
            return n.field.column == F.lit(n.low)
        return _any(n.field, lambda c: between(c, n))
    if isinstance(n, N.Pattern):
        return _any(n.field, lambda c: c.rlike(f"\\A(?:{n.regex})\\z")) if n.field.searchable else F.lit(False)
    if isinstance(n, N.Fuzzy):
        return _any(n.field, lambda c: F.levenshtein(c, F.lit(n.token)) <= n.edits)
    if isinstance(n, N.Phrase):
        return phrase_count(n) > 0
    if isinstance(n, N.Exists):
        if not n.field.searchable:
            return F.lit(False)
        return (F.size(n.field.column) > 0) if n.field.multi else n.field.column.isNotNull()
    if isinstance(n, N.Distance):
        lon, lat = F.col("longitude"), F.col("latitude")
        return within_box(n.lon, n.lat, n.km, lon, lat) & (distance_km(n.lon, n.lat, lon, lat) <= n.km)
    if isinstance(n, N.Filtered):
        return predicate(n.query) & predicate(n.filter)
    if isinstance(n, N.DisMax):
        return _fold([predicate(p) for p in n.parts], lambda a, b: a | b)
    if isinstance(n, N.Flexible):
        from .flexible import flexible_predicate

        return flexible_predicate(n)
    if isinstance(n, N.Bool):
        return _boolean(n)
    raise TypeError(type(n))


def _fold(columns: list[Column], join) -> Column:
    out = columns[0]
    for c in columns[1:]:
        out = join(out, c)
    return out


def _boolean(n: N.Bool) -> Column:
    """In a filter some optional clause must hold if there are any; in a query only if none is required.

    Exclusions alone: a filter matches all the rest, a query nothing.
    """
    parts = [predicate(c) for c in n.must]
    if n.should and not (n.scored and n.must):
        parts.append(_fold([predicate(c) for c in n.should], lambda a, b: a | b))
    if n.scored and not n.must and not n.should:
        return F.lit(False)
    parts += [~F.coalesce(predicate(c), F.lit(False)) for c in n.must_not]
    return _fold(parts, lambda a, b: a & b) if parts else F.lit(True)
