"""Statements to requests: names are resolved, literals typed, and what hangs on an open placeholder is dropped."""

from __future__ import annotations

from typing import Any

from ..schema import NUMERIC, Field, Schema
from .lexer import Sign, StatementError, signs_of
from .nodes import (
    Bool, Bucket, Delete, DisMax, Distance, Exists, Facet, Filtered, Flexible, MatchAll, Node, Pattern, Range, Route,
    ScoreModel, Search, Sort, Term,
)
from .querystring import QueryStringError, parse_query_string, wildcard
from .values import TypeMismatch, typed

HOLE = object()
CLAUSES = (
    "ORDER LIMIT GROUP BROWSE AGGREGATE DRILL EXPLAIN SOURCE SNIPPET ROUTE USING BOOST IN WHERE BY QUERY".split()
)
PARAM_TYPES = {"int": int, "integer": int, "long": int, "float": float, "double": float, "string": str}


def _boosted(node: Node | None, by: float) -> Node | None:
    return node if node is None or by == 1.0 else node.__class__(**{**node.__dict__, "boost": node.boost * by})


class Parser:
    def __init__(self, text: str, schema: Schema, params: dict[str, Any] | None = None, strict: bool = False):
        self.signs, self.i, self.schema, self.params, self.strict = signs_of(text), 0, schema, params or {}, strict
        self.scored = False
        self.place: tuple[float, float] | None = None

    # signs

    @property
    def now(self) -> Sign:
        return self.signs[self.i]

    def fail(self, message: str, at: Sign | None = None) -> StatementError:
        at = at or self.now
        return StatementError(at.line, at.col, message)

    def at(self, *words: str) -> bool:
        return all(self.i + k < len(self.signs) and (self.signs[self.i + k].key == w or (self.signs[self.i + k].kind == "op" and self.signs[self.i + k].text == w)) for k, w in enumerate(words))

    def accept(self, *words: str) -> bool:
        if self.at(*words):
            self.i += len(words)
            return True
        return False

    def expect(self, *words: str) -> None:
        for w in words:
            if not self.accept(w):
                raise self.fail(f"expected {w}, found {self.now.text!r}")

    def take(self, *kinds: str) -> Sign:
        if self.now.kind not in kinds:
            raise self.fail(f"expected {' or '.join(kinds)}, found {self.now.text!r}")
        self.i += 1
        return self.signs[self.i - 1]

    def list_of(self, one) -> list:
        out = [one()]
        while self.accept(","):
            out.append(one())
        return out

    def hole(self, sign: Sign) -> Any:
        return self.params.get(sign.text[1:], HOLE)

    def number(self) -> Any:
        s = self.take("integer", "real", "hole")
        if s.kind == "hole":
            return self.hole(s)
        return int(s.text.rstrip("lL")) if s.kind == "integer" else float(s.text.rstrip("fFdD"))

    def value(self) -> Any:
        s = self.now
        if s.key in ("TRUE", "FALSE"):
            self.i += 1
            return s.key == "TRUE"
        if s.kind == "string":
            self.i += 1
            return s.text
        return self.number()

    def name(self) -> str:
        return self.take("word", "quoted").text

    def field(self) -> Field:
        return self.schema.resolve(self.name())

    def fit(self, field: Field, value: Any, at: Sign) -> Any:
        try:
            return typed(field, value)
        except TypeMismatch as e:
            raise self.fail(str(e), at) from None

    # statements

    def statement(self) -> Search | Delete:
        if self.at("DELETE"):
            out: Search | Delete = self.delete()
            self.accept(";")
        else:
            parts = [self.select()]
            self.accept(";")
            while self.accept("|"):
                parts.append(self.select())
                self.accept(";")
            out = parts[0]
            if len(parts) > 1:
                nodes = tuple(_boosted(Filtered(p.query, p.filter) if p.filter is not None else p.query, p.boost) for p in parts)
                out.query, out.filter, out.boost = DisMax(nodes), None, 1.0
        if self.now.kind != "end":
            raise self.fail(f"unexpected {self.now.text!r}")
        return out

    def tables(self) -> tuple[str, ...]:
        names = self.list_of(self.name)
        return tuple(names)

    def delete(self) -> Delete:
        self.expect("DELETE", "FROM")
        tables = self.tables()
        where = self.condition(False) if self.accept("WHERE") else None
        route = None
        while self.accept("ROUTE", "BY"):
            route = self.route()
        return Delete(tables, where, route)

    def select(self) -> Search:
        self.place = None
        out = Search()
        self.expect("SELECT")
        if not self.accept("*"):
            out.columns = tuple(self.list_of(self.name))
        if self.accept("FROM"):
            out.indexes = self.tables()
        if self.at("BY") or (self.at("QUERY") and not self.at("QUERY", "IS")):
            self.i += 1
            out.query = self.condition(True) or MatchAll()
        if self.accept("WHERE"):
            out.filter = self.condition(False)
        seen: set[str] = set()

        def once(clause: str) -> None:
            if clause in seen:
                raise self.fail(f"{clause} stands more than once")
            seen.add(clause)

        while self.now.key in CLAUSES:
            if self.at("ORDER"):
                once("ORDER BY")
                self.expect("ORDER", "BY")
                out.sorts = tuple(self.list_of(self.sort))
            elif self.at("LIMIT"):
                once("LIMIT")
                self.i += 1
                n = self.number()
                m = self.number() if self.accept(",") else None
                offset, limit = (n, m) if m is not None else (0, n)
                if limit is not HOLE:
                    out.limit, out.offset = int(limit), 0 if offset is HOLE else int(offset)
            elif self.at("GROUP"):
                once("GROUP BY")
                self.expect("GROUP", "BY")
                out.group = self.field()
                if self.accept("TOP") and (n := self.number()) is not HOLE:
                    out.group_top = int(n)
            elif self.at("BROWSE"):
                once("BROWSE BY")
                self.expect("BROWSE", "BY")
                out.facets = tuple(self.list_of(self.facet))
            elif self.at("AGGREGATE"):
                self.expect("AGGREGATE", "BY")
                out.aggregations = tuple(self.list_of(self.aggregation))
            elif self.at("DRILL"):
                once("DRILL")
                self.i += 1
                if not (self.at("DOWN") or self.at("SIDEWAYS")):
                    raise self.fail("expected DOWN or SIDEWAYS")
                out.sideways = self.take("word").text.upper() == "SIDEWAYS"
                out.drills = tuple(self.list_of(self.drill))
            elif self.accept("EXPLAIN"):
                out.explain = self.flag()
            elif self.at("SOURCE"):
                once("SOURCE")
                self.i += 1
                out.source = self.flag()
            elif self.accept("SNIPPET"):
                fields = self.list_of(self.field)
                if bad := next((f for f in fields if f.type != "string"), None):
                    raise self.fail(f"SNIPPET needs string fields, {bad.name} is {bad.type}")
                out.snippets = tuple(fields)
            elif self.at("ROUTE"):
                once("ROUTE BY")
                self.expect("ROUTE", "BY")
                out.route = self.route()
            elif self.at("USING"):
                once("SCORE MODEL")
                self.expect("USING", "SCORE", "MODEL")
                out.model = self.model()
            elif self.accept("BOOST", "BY"):
                n = self.number()
                out.boost = 1.0 if n is HOLE else float(n)
            elif self.at("IN", "TOP"):
                out.in_top = self.in_top()
            else:
                break
        out.distance = self.place
        return out

    def flag(self) -> bool:
        if self.accept("TRUE"):
            return True
        if self.accept("FALSE"):
            return False
        if self.now.kind == "hole":
            return self.hole(self.take("hole")) is True
        return True

    # conditions

    def condition(self, scored: bool) -> Node | None:
        before, self.scored = self.scored, scored
        try:
            return self.any_of()
        finally:
            self.scored = before

    def modifiers(self, kind: str) -> tuple[bool, float]:
        disable, boost = False, 1.0
        if self.accept(f"{kind}DISABLECOORD"):
            disable = self.flag() if self.now.key in ("TRUE", "FALSE") else True
        if self.accept(f"{kind}BOOST"):
            self.expect("BY")
            n = self.number()
            boost = 1.0 if n is HOLE else float(n)
        return disable, boost

    def any_of(self) -> Node | None:
        required = self.accept("MUST")
        parts = [self.all_of()]
        while self.accept("OR"):
            parts.append(self.all_of())
        if len(parts) == 1:
            return parts[0]
        disable, boost = self.modifiers("OR")
        must = tuple(p for p in parts[:1] if p is not None) if required else ()
        should = tuple(p for p in (parts[1:] if required else parts) if p is not None)
        if len(must) + len(should) <= 1:
            return _boosted(next(iter((*must, *should)), None), boost)
        return Bool(must, should, (), self.scored, disable, boost)

    def all_of(self) -> Node | None:
        parts = [self.factor()]
        while self.accept("AND"):
            parts.append(self.factor())
        if len(parts) == 1:
            return parts[0]
        disable, boost = self.modifiers("AND")
        must = tuple(p for p in parts if p is not None)
        if len(must) <= 1:
            return _boosted(next(iter(must), None), boost)
        return Bool(must, (), (), self.scored, disable, boost)

    def factor(self) -> Node | None:
        if self.accept("("):
            node = self.any_of()
            self.expect(")")
            return node
        node = self.predicate()
        if self.accept("SUBBOOST"):
            self.expect("BY")
            n = self.number()
            node = _boosted(node, 1.0 if n is HOLE else float(n))
        return node

    def values(self) -> tuple[list[tuple[Any, Sign]], bool]:
        self.expect("(")
        out: list[tuple[Any, Sign]] = []
        if not self.accept(")"):
            while True:
                at = self.now
                v = self.value()
                if v is not HOLE:
                    out += [(x, at) for x in v] if isinstance(v, (list, tuple)) else [(v, at)]
                if not self.accept(","):
                    break
            self.expect(")")
            return out, True
        return out, False

    def equal(self, f: Field, value: Any, at: Sign) -> Node:
        v = self.fit(f, value, at)
        return Range(f, v, v) if f.type in NUMERIC else Term(f, v)

    def but(self, *nots: Node) -> Node:
        return Bool((MatchAll(),) if self.scored else (), (), nots, self.scored)

    def predicate(self) -> Node | None:
        if self.at("QUERY", "IS"):
            return self.query_string()
        if self.at("FLEXIBLE_QUERY"):
            return self.flexible()
        if self.at("DISTANCE", "("):
            self.i += 2
            lon = self.number()
            self.expect(",")
            lat = self.number()
            self.expect(")", "IN")
            km = self.number()
            if HOLE in (lon, lat, km):
                return None
            self.place = float(lon), float(lat)
            return Distance(float(lon), float(lat), float(km))
        at = self.now
        f = self.field()
        negated = self.accept("NOT")
        if self.accept("IN"):
            return self.in_list(f, negated)
        if self.accept("BETWEEN"):
            low_at, low = self.now, self.value()
            self.expect("AND")
            high_at, high = self.now, self.value()
            if low is HOLE or high is HOLE:
                return None
            low, high = self.fit(f, low, low_at), self.fit(f, high, high_at)
            if not negated:
                return Range(f, low, high)
            return Bool((), (Range(f, None, low, True, False), Range(f, high, None, False, True)), (), self.scored)
        if self.accept("LIKE"):
            s = self.take("string", "hole")
            text = self.hole(s) if s.kind == "hole" else s.text
            if f.type not in ("string", "facet"):
                raise self.fail(f"LIKE needs a string field, {f.name} is {f.type}", at)
            if text is HOLE:
                return None
            node = Pattern(f, wildcard(text), text)
            return self.but(node) if negated else node
        if negated:
            raise self.fail("expected IN, BETWEEN or LIKE after NOT")
        if self.accept("IS"):
            there = self.accept("NOT")
            self.expect("NULL")
            return Exists(f) if there else self.but(Exists(f))
        op = self.take("op").text
        value_at, v = self.now, self.value()
        if v is HOLE:
            return None
        if op == "=":
            return self.equal(f, v, value_at)
        if op in ("<>", "!="):
            return self.but(self.equal(f, v, value_at))
        v = self.fit(f, v, value_at)
        ranges = {">": (v, None, False, True), ">=": (v, None, True, True), "<": (None, v, True, False), "<=": (None, v, True, True)}
        if op not in ranges:
            raise self.fail(f"unexpected {op!r}", value_at)
        return Range(f, *ranges[op])

    def in_list(self, f: Field, negated: bool) -> Node | None:
        inside, given = self.values()
        outside, excepted = self.values() if self.accept("EXCEPT") else ([], False)
        yes, no = [self.equal(f, v, at) for v, at in inside], [self.equal(f, v, at) for v, at in outside]
        if negated:
            yes, no = no, yes
        if not yes and not no:
            return None  # every value hangs on an open placeholder, or there is none
        if yes:
            return Bool((), tuple(yes), tuple(no), self.scored)
        return Bool((), (), tuple(no), True) if self.scored and self.strict else self.but(*no)

    def query_string(self) -> Node | None:
        self.expect("QUERY", "IS")
        at = self.take("string", "hole")
        text = self.hole(at) if at.kind == "hole" else at.text
        disable, default_and = True, False
        if self.accept("DISABLECOORD"):
            disable = self.flag() if self.now.key in ("TRUE", "FALSE") else True
        if self.accept("OP"):
            self.expect("(")
            default_and = self.at("AND")
            if not (self.accept("AND") or self.accept("OR")):
                raise self.fail("expected AND or OR")
            self.expect(")")
        if text is HOLE:
            return None
        try:
            return parse_query_string(text, self.schema, default_and, disable)
        except (QueryStringError, TypeMismatch) as e:
            raise self.fail(str(e), at) from None

    def flexible(self) -> Node:
        self.expect("FLEXIBLE_QUERY", "IS")
        text = self.take("string").text
        full = self.accept("FULL_MATCH")
        ratio = 0.0
        if not full and self.accept("MATCH"):
            n = self.number()
            ratio = 0.0 if n is HOLE else float(n)
        spread, over = False, ()
        if self.accept("GLOBAL_IDF"):
            spread = True
            if self.accept("OF"):
                self.expect("(")
                over = tuple(f for f, _ in self.list_of(self.weighted))
                self.expect(")")
        self.expect("IN", "(")
        fields = tuple(self.list_of(self.weighted))
        self.expect(")", "USING", "MODEL")
        return Flexible(text, fields, self.model(), full, ratio, spread, over)

    def weighted(self) -> tuple[Field, float]:
        f = self.field()
        n = self.number() if self.accept("^") else 1.0
        return f, 1.0 if n is HOLE else float(n)

    # clauses

    def sort(self) -> Sort:
        at = self.now
        name = self.name()
        kind = name.lower() if at.kind == "word" and name.lower() in ("score", "distance") else "field"
        descending = not self.accept("ASC")
        if descending:
            self.accept("DESC")
        f = None
        if kind == "field":
            f = self.schema.resolve(name)
            if f.multi:
                raise self.fail(f"can't order by {name}: it has many values", at)
        return Sort(kind, f, descending)

    def facet(self) -> Facet:
        at = self.now
        f = self.field()
        if f.type != "facet":
            raise self.fail(f"BROWSE BY needs a facet field, {f.name} is {f.type}", at)
        top, path = 10, ()
        if self.accept("("):
            top = int(self.take("integer").text)
            if self.accept(","):
                path = self.path()
            self.expect(")")
        return Facet(f, top, path)

    def path(self) -> tuple[str, ...]:
        return tuple(p for p in self.take("string").text.split("/") if p)

    def drill(self) -> tuple[Field, tuple[str, ...]]:
        f, path = self.field(), ()
        if self.accept("("):
            path = self.path()
            self.expect(")")
        return f, path

    def aggregation(self) -> tuple[Field, tuple[Bucket, ...]]:
        at = self.now
        f = self.field()
        if f.type not in ("integer", "long", "double"):
            raise self.fail(f"AGGREGATE BY needs an integer, long or double field, {f.name} is {f.type}", at)
        buckets: list[Bucket] = []
        if self.accept("("):
            buckets = self.list_of(lambda: self.bucket(f))
            self.expect(")")
        return f, tuple(buckets)

    def bucket(self, f: Field) -> Bucket:
        first = self.take("op")
        if first.text not in "[{":
            raise self.fail("expected [ or {", first)

        def end() -> tuple[float | None, str]:
            at = self.now
            if self.accept("*"):
                return None, "*"
            n = self.number()
            return (None, "*") if n is HOLE else (self.fit(f, n, at), at.text if at.kind != "hole" else str(n))

        low, low_text = end()
        self.expect(",")
        high, high_text = end()
        last = self.take("op")
        if last.text not in "]}":
            raise self.fail("expected ] or }", last)
        return Bucket(low, high, first.text == "[", last.text == "]", f"{first.text}{low_text},{high_text}{last.text}")

    def in_top(self) -> int | None:
        self.expect("IN", "TOP")
        n = self.number()
        return None if n is HOLE else int(n)

    def route(self) -> Route:
        shards: list[tuple[int, int | None]] = []
        replica = None
        while True:
            if self.accept("REPLICA_KEY"):
                replica = self.take("string").text
            elif self.accept("("):
                many = self.list_of(self.number)
                self.expect(")")
                top = self.in_top()
                shards += [(int(n), top) for n in many if n is not HOLE]
            else:
                n = self.number()
                top = self.in_top() if self.at("IN", "TOP") else None
                if n is not HOLE:
                    shards.append((int(n), top))
            if not self.accept(","):
                return Route(tuple(shards), replica)

    def model(self) -> ScoreModel:
        plugin, override = self.accept("PLUGIN"), self.accept("OVERRIDE")
        name = self.name()
        params: list[tuple[str, str, Any]] = []
        if self.accept("("):
            if not self.accept(")"):
                params = [p for p in self.list_of(self.parameter) if p is not None]
                self.expect(")")
        code = None
        if self.accept("BEGIN"):
            code = self.take("code").text
        return ScoreModel(name, code, tuple(params), plugin, override)

    def parameter(self) -> tuple[str, str, Any] | None:
        at = self.take("word")
        kind = at.text.lower()
        if kind == "map":
            self.expect("<")
            key = self.take("word").text.lower()
            self.expect(",")
            kind = f"map<{key},{self.take('word').text.lower()}>"
            self.expect(">")
        elif kind not in PARAM_TYPES:
            raise self.fail(f"parameters can't be of type {at.text}", at)
        name = self.name()
        if not self.accept("="):
            return kind, name, None
        value = self.literal()
        return None if value is HOLE else (kind, name, value)

    def literal(self) -> Any:
        if self.accept("["):
            out: list = []
            while not self.accept("]"):
                if not self.accept(","):
                    if self.at("["):
                        raise self.fail("lists within lists aren't supported")
                    out.append(self.literal())
            return [v for v in out if v is not HOLE]
        if self.accept("{"):
            found: dict = {}
            while not self.accept("}"):
                if not self.accept(","):
                    key = self.take("string").text
                    self.expect(":")
                    if (v := self.literal()) is not HOLE:
                        found[key] = v
            return found
        return self.value()


def parse(text: str, schema: Schema, params: dict[str, Any] | None = None, strict: bool = False) -> Search | Delete:
    """``params`` fill placeholders; ``strict`` keeps BY ... NOT IN matching nothing, as a query of exclusions alone."""
    return Parser(text, schema, params, strict).statement()
