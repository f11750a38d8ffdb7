"""Score code: a subset of Java, compiled to columns when the query is planned.

Nothing is evaluated as code of the host. Values are constants or columns with a kind; counted loops
with constant bounds are unrolled, loops over a field's values become ``aggregate``, branches on
columns become ``when``. What lies outside the subset is a compile error that names it.
"""

from __future__ import annotations

import importlib
import math
import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.nodes import ScoreModel
from ..schema import Schema
from .match import once

UNROLL = 2000
SIGNS = re.compile(
    r"""(?P<blank>\s+|//[^\n]*|/\*.*?\*/)|(?P<real>\d+\.\d*(?:[eE][+-]?\d+)?[fFdD]?|\.\d+[fFdD]?|\d+[eE][+-]?\d+[fFdD]?|\d+[fFdD])
      |(?P<int>\d+[lL]?)|(?P<str>"(?:\\.|[^"\\])*")|(?P<chr>'(?:\\.|[^'\\])')|(?P<id>[A-Za-z_$][\w$]*)
      |(?P<op>>>>|<<|>>|\+\+|--|&&|\|\||[=!<>+\-*/%&|^]=|[-+*/%=<>!?:;,.(){}\[\]&|^~])""",
    re.X | re.S,
)
TYPES = {"int": "int", "Integer": "int", "short": "int", "byte": "int", "long": "long", "Long": "long", "float": "double",
         "Float": "double", "double": "double", "Double": "double", "boolean": "bool", "Boolean": "bool", "String": "string"}
SQL = {"int": "int", "long": "bigint", "double": "double", "bool": "boolean", "string": "string"}
LEVELS = [["||"], ["&&"], ["|"], ["^"], ["&"], ["==", "!="], ["<", ">", "<=", ">=", "instanceof"], ["<<", ">>", ">>>"], ["+", "-"], ["*", "/", "%"]]

MODELS: dict[str, Callable] = {}


def register_score_model(name: str, make: Callable[[Any], Column]) -> None:
    """A model by name for USING ... PLUGIN: ``make(context)`` gives the score column."""
    MODELS[name] = make


def plugin(name: str, reload: bool) -> Callable[[Any], Column]:
    """The model registered under a name, else the one that ``module.function`` names.

    A module is imported once; OVERRIDE imports it anew.
    """
    module, dot, function = name.rpartition(".")
    if name in MODELS and not (reload and name in _LOADED):
        return MODELS[name]
    if not dot:
        raise ScoreCodeError(f"no score model is registered as {name!r}")
    try:
        found = importlib.import_module(module)
        if reload:
            found = importlib.reload(found)
        MODELS[name] = getattr(found, function)
    except (ImportError, AttributeError) as e:
        raise ScoreCodeError(f"no score model is registered as {name!r}") from e
    _LOADED.add(name)
    return MODELS[name]


_LOADED: set[str] = set()


class ScoreCodeError(ValueError):
    pass


@dataclass
class V:
    """kind: int, long, double, bool, string, list:<kind>, map:<kind>; value: a constant or a column."""

    kind: str
    value: Any

    @property
    def fixed(self) -> bool:
        return not isinstance(self.value, Column)

    def col(self) -> Column:
        if not self.fixed:
            return self.value
        if self.kind.startswith("list:"):
            one = SQL[self.kind[5:]]
            return F.array(*(F.lit(x).cast(one) for x in self.value)) if self.value else F.expr(f"cast(array() as array<{one}>)")
        if self.kind.startswith("map:"):
            return F.create_map(*(F.lit(x) for kv in self.value.items() for x in kv))
        return F.lit(self.value).cast(SQL[self.kind])


def _cast(v: V, kind: str) -> V:
    if v.kind == kind or kind not in SQL:
        return v
    if v.fixed:
        if kind in ("int", "long"):
            return V(kind, math.trunc(v.value))
        return V(kind, float(v.value) if kind == "double" else v.value)
    if kind in ("int", "long") and v.kind == "double":
        return V(kind, F.when(v.value < 0, F.ceil(v.value)).otherwise(F.floor(v.value)).cast(SQL[kind]))
    return V(kind, v.value.cast(SQL[kind]))


# --- reading --------------------------------------------------------------------------------


class _Reader:
    def __init__(self, code: str):
        self.s, at = [], 0
        while at < len(code):
            m = SIGNS.match(code, at)
            if not m:
                raise ScoreCodeError(f"score code: unexpected sign {code[at]!r}")
            if m.lastgroup != "blank":
                self.s.append((m.lastgroup, m.group()))
            at = m.end()
        self.s.append(("end", ""))
        self.i = 0

    def at(self, *texts: str) -> bool:
        return self.s[self.i][0] in ("op", "id") and self.s[self.i][1] in texts

    def accept(self, text: str) -> bool:
        if self.at(text):
            self.i += 1
            return True
        return False

    def expect(self, text: str) -> None:
        if not self.accept(text):
            raise ScoreCodeError(f"score code: expected {text!r}, found {self.s[self.i][1]!r}")

    def name(self) -> str:
        if self.s[self.i][0] != "id":
            raise ScoreCodeError(f"score code: expected a name, found {self.s[self.i][1]!r}")
        self.i += 1
        return self.s[self.i - 1][1]

    def block(self) -> list:
        if self.accept("{"):
            out = []
            while not self.accept("}"):
                out.append(self.statement())
            return out
        return [self.statement()]

    def type(self) -> str | None:
        """A type before a name, if one stands here."""
        start = self.i
        self.accept("final")
        if self.s[self.i][0] == "id":
            name = self.name()
            if self.accept("<"):
                depth = 1
                while depth and self.s[self.i][0] != "end":
                    depth += {"<": 1, ">": -1, ">>": -2}.get(self.s[self.i][1], 0)
                    self.i += 1
            while self.at("[") and self.s[self.i + 1][1] == "]":
                self.i += 2
                name += "[]"
            if self.s[self.i][0] == "id" and name not in ("return", "else", "new", "instanceof"):
                return name
        self.i = start
        return None

    def statement(self):
        if self.at("{"):
            return ("block", self.block())
        if self.accept(";"):
            return ("block", [])
        if self.accept("if"):
            self.expect("(")
            cond = self.expr()
            self.expect(")")
            yes = self.block()
            return ("if", cond, yes, self.block() if self.accept("else") else [])
        if self.accept("for"):
            self.expect("(")
            start = self.i
            kind = self.type()
            if kind:
                name = self.name()
                if self.accept(":"):
                    over = self.expr()
                    self.expect(")")
                    return ("each", kind, name, over, self.block())
                self.i = start
            init = [] if self.at(";") else [self.simple()]
            self.expect(";")
            cond = ("lit", V("bool", True)) if self.at(";") else self.expr()
            self.expect(";")
            step = [] if self.at(")") else [self.simple()]
            self.expect(")")
            return ("for", init, cond, step, self.block())
        if self.accept("while"):
            self.expect("(")
            cond = self.expr()
            self.expect(")")
            return ("for", [], cond, [], self.block())
        if self.accept("do"):
            body = self.block()
            self.expect("while")
            self.expect("(")
            cond = self.expr()
            self.expect(")")
            self.expect(";")
            return ("block", [("once", body), ("for", [], cond, [], body)])
        if self.accept("switch"):
            return self.switch()
        if self.accept("return"):
            e = self.expr()
            self.expect(";")
            return ("return", e)
        for word in ("break", "continue"):
            if self.accept(word):
                self.expect(";")
                return (word,)
        out = self.simple()
        self.expect(";")
        return out

    def switch(self):
        self.expect("(")
        on = self.expr()
        self.expect(")")
        self.expect("{")
        cases: list = []
        while not self.accept("}"):
            labels: list = []
            while self.at("case", "default"):
                labels.append(None if self.accept("default") else (self.expect("case"), self.expr())[1])
                self.expect(":")
            body = []
            while not self.at("case", "default", "}"):
                body.append(self.statement())
            if body and body[-1][0] not in ("break", "return") and not self.at("}"):
                raise ScoreCodeError("score code: a case that falls through isn't supported")
            cases.append((labels, body[:-1] if body and body[-1][0] == "break" else body))
        out: list = next((b for ls, b in cases if None in ls), [])
        for labels, body in reversed(cases):
            if None not in labels:
                cond = None
                for e in labels:
                    one = ("call", on, "equals", [e]) if e[0] == "lit" and e[1].kind == "string" else ("bin", "==", on, e)
                    cond = one if cond is None else ("bin", "||", cond, one)
                out = [("if", cond, body, out)]
        return ("block", out)

    def simple(self):
        kind = self.type()
        if kind:
            out = []
            while True:
                name = self.name()
                while self.accept("["):
                    self.expect("]")
                    kind += "[]"
                out.append(("declare", kind, name, self.expr() if self.accept("=") else None))
                if not self.accept(","):
                    return ("block*", out)
        e = self.expr()
        for op in ("=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^="):
            if self.accept(op):
                if e[0] != "name":
                    raise ScoreCodeError("score code: only variables can be assigned to")
                right = self.expr()
                return ("assign", e[1], right if op == "=" else ("bin", op[:-1], e, right))
        if e[0] == "step":
            return ("assign", e[2], ("bin", e[1], ("name", e[2]), ("lit", V("int", 1))))
        return ("do", e)

    def expr(self):
        cond = self.binary(0)
        if self.accept("?"):
            yes = self.expr()
            self.expect(":")
            return ("cond", cond, yes, self.expr())
        return cond

    def binary(self, level: int):
        if level == len(LEVELS):
            return self.unary()
        left = self.binary(level + 1)
        while self.at(*LEVELS[level]):
            op = self.s[self.i][1]
            self.i += 1
            if op == "instanceof":
                left = ("instanceof", left, self.name())
            else:
                left = ("bin", op, left, self.binary(level + 1))
        return left

    def unary(self):
        for op in ("++", "--"):
            if self.accept(op):
                return ("step", op[0], self.name())
        for op in ("-", "+", "!", "~"):
            if self.accept(op):
                return ("un", op, self.unary())
        if self.at("(") and self.s[self.i + 1][1] in TYPES and self.s[self.i + 2][1] == ")":
            kind = self.s[self.i + 1][1]
            self.i += 3
            return ("cast", kind, self.unary())
        return self.postfix()

    def postfix(self):
        kind, text = self.s[self.i]
        self.i += 1
        if kind == "real":
            e = ("lit", V("double", float(text.rstrip("fFdD"))))
        elif kind == "int":
            e = ("lit", V("long" if text[-1] in "lL" else "int", int(text.rstrip("lL"))))
        elif kind in ("str", "chr"):
            plain = re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), text[1:-1])
            e = ("lit", V("string", plain))
        elif kind == "id" and text in ("true", "false"):
            e = ("lit", V("bool", text == "true"))
        elif kind == "id" and text == "null":
            e = ("lit", V("string", None))
        elif kind == "id":
            e = ("invoke", text, self.args()) if self.at("(") else ("name", text)
        elif text == "(":
            e = self.expr()
            self.expect(")")
        else:
            raise ScoreCodeError(f"score code: unexpected {text or 'end'!r}")
        while True:
            if self.accept("."):
                name = self.name()
                e = ("call", e, name, self.args()) if self.at("(") else ("member", e, name)
            elif self.accept("["):
                e = ("index", e, self.expr())
                self.expect("]")
            elif self.at("++", "--") and e[0] == "name":
                e = ("step", self.s[self.i][1][0], e[1])
                self.i += 1
            else:
                return e

    def args(self) -> list:
        self.expect("(")
        out = []
        if not self.accept(")"):
            out.append(self.expr())
            while self.accept(","):
                out.append(self.expr())
            self.expect(")")
        return out


# --- compiling ------------------------------------------------------------------------------


def _and(a: V, b: V) -> V:
    if a.fixed:
        return b if a.value else a
    if b.fixed:
        return a if b.value else b
    return V("bool", a.value & b.value)


def _or(a: V, b: V) -> V:
    if a.fixed:
        return a if a.value else b
    if b.fixed:
        return b if b.value else a
    return V("bool", a.value | b.value)


def _not(a: V) -> V:
    return V("bool", (not a.value) if a.fixed else ~a.value)


def _choose(cond: V, yes: V, no: V) -> V:
    if cond.fixed:
        return yes if cond.value else no
    kind = _wider(yes.kind, no.kind) if yes.kind != no.kind else yes.kind
    return V(kind, F.when(cond.value, _cast(yes, kind).col()).otherwise(_cast(no, kind).col()))


def _wider(a: str, b: str) -> str:
    order = ["int", "long", "double"]
    if a in order and b in order:
        return order[max(order.index(a), order.index(b))]
    if "string" in (a, b):
        return "string"
    if a == b:
        return a
    raise ScoreCodeError(f"score code: {a} and {b} don't go together")


NO, YES = V("bool", False), V("bool", True)


class _Compiler:
    def __init__(self, schema: Schema, matrix, score: Column | None, distance: Column | None, params: dict[str, V]):
        self.schema, self.matrix, self.raw_score, self.raw_distance = schema, matrix, score, distance
        self.env, self.kinds = dict(params), {k: v.kind for k, v in params.items()}
        self.done, self.result, self.broken, self.skipped = NO, None, NO, NO
        self.steps, self.notes = 0, []
        self.held: dict[tuple, Column] | None = None  # in loops over values: what they ask of the row

    def cell(self, key: tuple, make: Callable[[], Column]) -> Column:
        """A value of the row, which a loop over values must not work out in each round."""
        if self.held is None:
            return make()
        if key not in self.held:
            self.held[key] = make()
        return self.held[key]

    # statements

    def active(self, guard: V) -> V:
        return _and(guard, _not(_or(self.done, _or(self.broken, self.skipped))))

    def run(self, body: list, guard: V) -> None:
        for s in body:
            self.steps += 1
            if self.steps > 50 * UNROLL:
                raise ScoreCodeError("score code: too many steps to unroll")
            now = self.active(guard)
            if now.fixed and not now.value:
                return
            getattr(self, "do_" + s[0].rstrip("*"))(s, guard)

    def do_block(self, s, guard) -> None:
        self.run(s[1], guard)

    def do_once(self, s, guard) -> None:
        broken, skipped = self.broken, self.skipped
        self.run(s[1], guard)
        self.broken, self.skipped = broken, skipped

    def do_declare(self, s, guard) -> None:
        _, kind, name, e = s
        own = "list:" + TYPES.get(kind[:-2], "double") if kind.endswith("[]") else TYPES.get(kind, "")
        self.kinds.pop(name, None)
        if e is None:
            value = V(own, {"string": None, "bool": False, "double": 0.0}.get(own, 0))
        else:
            value = self.value(e)
        self.env[name] = _cast(value, own) if own in SQL else value
        self.kinds[name] = own if own in SQL else value.kind

    def do_assign(self, s, guard) -> None:
        _, name, e = s
        if name not in self.env:
            raise ScoreCodeError(f"score code: no variable {name}")
        new = _cast(self.value(e), self.kinds[name])
        self.env[name] = _choose(self.active(guard), new, self.env[name])

    def do_do(self, s, guard) -> None:
        e = s[1]
        if e[0] == "step":
            self.do_assign(("assign", e[2], ("bin", e[1], ("name", e[2]), ("lit", V("int", 1)))), guard)
        elif e[0] == "invoke" and e[1] in ("writeExplanation", "setRootExpl", "addTermExpl", "addFieldExpl"):
            args = [self.value(a) for a in e[2]]
            text = next((i for i, a in enumerate(args) if a.kind == "string"), None)
            if text is not None:
                self.notes.append((self.active(guard), self.formatted(args[text:])))
        else:
            self.value(e)

    def do_if(self, s, guard) -> None:
        cond = self.value(s[1])
        if cond.kind != "bool":
            raise ScoreCodeError("score code: a condition must be boolean")
        self.run(s[2], _and(guard, cond))
        self.run(s[3], _and(guard, _not(cond)))

    def do_return(self, s, guard) -> None:
        value = _cast(self.value(s[1]), "double")
        now = self.active(guard)
        self.result = value if self.result is None else _choose(self.done, self.result, value)
        self.done = _or(self.done, now)

    def do_break(self, s, guard) -> None:
        self.broken = _or(self.broken, self.active(guard))

    def do_continue(self, s, guard) -> None:
        self.skipped = _or(self.skipped, self.active(guard))

    def do_for(self, s, guard) -> None:
        _, init, cond, step, body = s
        self.run(init, guard)
        outer, skipped = self.broken, self.skipped
        for k in range(UNROLL + 1):
            test = self.value(cond)
            if not test.fixed:
                if k == 0 and self.counted(s, guard):
                    break
                raise ScoreCodeError("score code: a loop must end at a constant, or count up to the size of a field's values")
            if not test.value:
                break
            if k == UNROLL:
                raise ScoreCodeError(f"score code: a loop of more than {UNROLL} rounds")
            self.skipped = skipped
            self.run(body, guard)
            self.skipped = skipped
            self.run_step(step)
            now = self.active(guard)
            if now.fixed and not now.value:
                break
        self.broken, self.skipped = outer, skipped

    def run_step(self, step: list) -> None:
        for st in step:
            self.env[st[1]] = _cast(self.value(st[2]), self.kinds[st[1]])

    def counted(self, s, guard) -> bool:
        """for (i = a; i < n; ++i) where n is a column."""
        _, init, cond, step, body = s
        if cond[0] != "bin" or cond[1] not in ("<", "<=") or cond[2][0] != "name" or len(step) != 1:
            return False
        name = cond[2][1]
        if step[0][:2] != ("assign", name) or step[0][2] != ("bin", "+", ("name", name), ("lit", V("int", 1))):
            return False
        last = self.value(cond[3]).col().cast("int") - (1 if cond[1] == "<" else 0)
        first = self.env[name].col().cast("int")
        over = F.when(last >= first, F.sequence(first, F.greatest(first, last))).otherwise(F.expr("cast(array() as array<int>)"))
        self.fold(V("list:int", over), "int", name, body, guard)
        return True

    def do_each(self, s, guard) -> None:
        _, kind, name, over, body = s
        items = self.value(over)
        if not items.kind.startswith("list:"):
            raise ScoreCodeError("score code: only lists can be walked over")
        own = items.kind[5:]
        if items.fixed:
            outer, skipped = self.broken, self.skipped
            for x in items.value:
                self.env[name], self.kinds[name], self.skipped = V(own, x), own, skipped
                self.run(body, guard)
            self.broken, self.skipped = outer, skipped
        else:
            self.fold(items, own, name, body, guard)

    def fold(self, items: V, kind: str, name: str, body: list, guard: V) -> None:
        """A loop over a column's values: the variables it assigns travel along in an aggregate."""
        names = sorted({n for n in _assigned(body) if n in self.env and n != name})
        start = F.struct(*(self.env[n].col().alias(n) for n in names), F.lit(False).alias("__broken"))
        kinds = [self.kinds[n] for n in names]
        if any(k not in SQL for k in kinds):
            raise ScoreCodeError("score code: a loop over values can only change numbers, strings and booleans")
        if _returns(body):
            raise ScoreCodeError("score code: return inside a loop over values isn't supported")

        def walked(env: dict[str, V], held: dict[tuple, Column]) -> Column:
            def step(acc: Column, x: Column) -> Column:
                inner = _Compiler(self.schema, self.matrix, self.raw_score, self.raw_distance, {})
                inner.env, inner.kinds, inner.held = dict(env), dict(self.kinds), held
                for n, k in zip(names, kinds, strict=True):
                    inner.env[n] = V(k, acc[n])
                inner.env[name], inner.kinds[name] = V(kind, x), kind
                inner.broken = V("bool", acc["__broken"])
                inner.run(body, YES)
                return F.struct(*(_cast(inner.env[n], k).col().alias(n) for n, k in zip(names, kinds, strict=True)), inner.broken.col().alias("__broken"))

            return F.aggregate(items.col(), start, step)

        # what the rounds read and don't change is worked out before them; the first walk finds what that is
        held = {} if self.held is None else self.held
        done = walked(self.env, held)
        kept = {n: v for n, v in self.env.items() if not v.fixed and n in _named(body) and n not in (*names, name)}
        cells = list(held.items()) if self.held is None else []
        if kept or cells:
            before = F.struct(*(v.col().alias(n) for n, v in kept.items()), *(c.alias(f"__cell{k}") for k, (_, c) in enumerate(cells)))
            done = once(before, lambda s: walked(
                self.env | {n: V(v.kind, s[n]) for n, v in kept.items()}, {key: s[f"__cell{k}"] for k, (key, _) in enumerate(cells)} if cells else held,
            ))
        for n, k in zip(names, kinds, strict=True):
            self.env[n] = _choose(self.active(guard), V(k, done[n]), self.env[n])

    # expressions

    def value(self, e) -> V:
        return getattr(self, "e_" + e[0])(*e[1:])

    def e_lit(self, v: V) -> V:
        return v

    def e_name(self, name: str) -> V:
        if name not in self.env:
            raise ScoreCodeError(f"score code: no variable {name}")
        return self.env[name]

    def e_step(self, op: str, name: str) -> V:
        raise ScoreCodeError("score code: ++ and -- stand alone or in a for clause only")

    def e_cond(self, c, yes, no) -> V:
        cond = self.value(c)
        if cond.fixed:
            return self.value(yes if cond.value else no)
        return _choose(cond, self.value(yes), self.value(no))

    def e_cast(self, kind: str, e) -> V:
        return _cast(self.value(e), TYPES[kind])

    def e_instanceof(self, e, kind: str) -> V:
        return V("bool", self.value(e).kind == TYPES.get(kind))

    def e_un(self, op: str, e) -> V:
        v = self.value(e)
        if op == "!":
            return _not(v)
        if op == "-":
            return V(v.kind, -v.value)
        if op == "~":
            return V(v.kind, ~v.value if v.fixed else F.bitwise_not(v.value))
        return v

    def e_bin(self, op: str, a, b) -> V:
        if op in ("&&", "||"):
            left = self.value(a)
            if left.fixed:
                return left if left.value == (op == "||") else self.value(b)
            return (_and if op == "&&" else _or)(left, self.value(b))
        x, y = self.value(a), self.value(b)
        if x.kind == y.kind == "bool" and op in ("&", "|"):
            return (_and if op == "&" else _or)(x, y)
        if op == "+" and "string" in (x.kind, y.kind):
            if x.fixed and y.fixed:
                return V("string", _java_text(x) + _java_text(y))
            return V("string", F.concat(_cast(x, "string").col(), _cast(y, "string").col()))
        if op in ("==", "!="):
            return self.same(x, y) if op == "==" else _not(self.same(x, y))
        kind = _wider(x.kind, y.kind)
        both = x.fixed and y.fixed
        p, q = (x.value, y.value) if both else (_cast(x, kind).col(), _cast(y, kind).col())
        if op in ("<", ">", "<=", ">="):
            return V("bool", {"<": lambda: p < q, ">": lambda: p > q, "<=": lambda: p <= q, ">=": lambda: p >= q}[op]())
        if op in ("<<", ">>", ">>>"):
            if not y.fixed:
                raise ScoreCodeError("score code: shifts need a constant distance")
            n = y.value & (63 if x.kind == "long" else 31)
            if x.fixed:
                return V(x.kind, x.value << n if op == "<<" else x.value >> n)
            return V(x.kind, {"<<": F.shiftleft, ">>": F.shiftright, ">>>": F.shiftrightunsigned}[op](x.value, n))
        if op in ("&", "|", "^"):
            if both:
                return V(kind, {"&": p & q, "|": p | q, "^": p ^ q}[op])
            return V(kind, {"&": p.bitwiseAND, "|": p.bitwiseOR, "^": p.bitwiseXOR}[op](q))
        if op in "+-*":
            return V(kind, {"+": lambda: p + q, "-": lambda: p - q, "*": lambda: p * q}[op]())
        if both:
            if not q:
                if kind != "double":
                    raise ScoreCodeError("score code: division by zero")
                return V(kind, math.nan if not p or op == "%" else math.copysign(math.inf, p))
            if op == "/":
                return V(kind, p / q if kind == "double" else math.trunc(p / q) if abs(p) < 2**52 else int(p // q))
            return V(kind, math.fmod(p, q) if kind == "double" else int(math.fmod(p, q)))
        if kind == "double":
            safe = F.when(q == 0, F.lit(float("nan"))).otherwise(F.try_divide(p, q)) if op == "/" else F.try_mod(p, q)
            if op == "/":
                safe = F.when((q == 0) & (p > 0), F.lit(float("inf"))).when((q == 0) & (p < 0), F.lit(float("-inf"))).otherwise(safe)
            return V(kind, safe)
        if op == "/":
            exact = F.try_divide(p, q)
            return V(kind, F.when(exact < 0, F.ceil(exact)).otherwise(F.floor(exact)).cast(SQL[kind]))
        return V(kind, F.try_mod(p, q))

    def same(self, x: V, y: V) -> V:
        if x.fixed and y.fixed:
            return V("bool", x.value == y.value)
        if (x.fixed and x.value is None) or (y.fixed and y.value is None):
            other = y if x.fixed and x.value is None else x
            return V("bool", other.col().isNull())
        kind = _wider(x.kind, y.kind)
        return V("bool", F.coalesce(_cast(x, kind).col() == _cast(y, kind).col(), F.lit(False)))

    def e_index(self, e, i) -> V:
        items, at = self.value(e), self.value(i)
        if items.fixed and at.fixed:
            return V(items.kind[5:], items.value[at.value])
        return V(items.kind[5:], F.get(items.col(), at.col()))

    def e_member(self, e, name: str) -> V:
        v = self.value(e)
        if name == "length" and v.kind.startswith("list:"):
            return V("int", len(v.value) if v.fixed else F.size(v.value))
        raise ScoreCodeError(f"score code: {name} isn't supported")

    def e_invoke(self, name: str, args: list) -> V:
        m = self.matrix
        if m is not None:
            at = lambda: tuple(self.index(a) for a in args)
            own = lambda what, i, j: self.cell((what, i, j), lambda: getattr(m, what)(i, j))
            if name in ("getFieldLength", "getTermLength"):
                return V("int", len(m.n.fields) if name == "getFieldLength" else len(m.words))
            if name == "getFieldBoost":
                return V("double", m.n.fields[at()[0]][1])
            if name == "getTermBoost":
                return V("double", m.words[at()[0]][1])
            if name == "isMatched":
                return V("bool", own("matched", *at()))
            if name == "getRawScore":
                return V("double", own("raw", *at()))
            if name == "getScore":
                i, j = at()
                return V("double", own("raw", i, j) * m.n.fields[i][1])
            if name in ("freq", "getFreq"):
                return V("int", own("frequency", *at()))
            if name in ("position", "getPosition"):
                return V("int", F.coalesce(F.get(own("positions", *at()), F.lit(0)), F.lit(-1)))
            if name in ("positions", "getPositions"):
                return V("list:int", own("positions", *at()))
            if name in ("text", "getText"):
                return V("string", m.words[at()[-1]][0])
            if name == "field" and len(args) == 1:
                return V("string", m.field(at()[0]).name)
            if name == "getTotalMatchedTerms":
                hits = []
                for j in range(len(m.words)):
                    hit = own("matched", 0, j)
                    for i in range(1, len(m.n.fields)):
                        hit = hit | own("matched", i, j)
                    hits.append(hit.cast("int"))
                return V("int", sum(hits[1:], hits[0]) if hits else 0)
            if name == "getMatchedField":
                hits = []
                for i in range(len(m.n.fields)):
                    hit = own("matched", i, 0)
                    for j in range(1, len(m.words)):
                        hit = hit | own("matched", i, j)
                    hits.append(hit.cast("int"))
                return V("int", sum(hits[1:], hits[0]))
            if name == "getExpl":
                return self.formatted([self.value(a) for a in args])
        if name == "score" and not args:
            return V("double", self.cell(("score",), lambda: self.raw_score) if self.raw_score is not None else F.lit(1.0))
        if name == "distance" and not args:
            return V("double", F.coalesce(self.raw_distance, F.lit(0.0)) if self.raw_distance is not None else 0.0)
        if name == "doc" and not args:
            return V("long", F.col("__seq"))
        if args:
            raise ScoreCodeError(f"score code: {name}(...) isn't supported")
        f = self.schema.static(name)
        if f is None:
            raise ScoreCodeError(f"score code: no field {name}")
        kind = {"integer": "int", "long": "long", "float": "double", "double": "double"}.get(f.type, "string")
        if f.multi:
            none = F.expr(f"cast(array() as array<{SQL[kind]}>)")
            return V("list:" + kind, self.cell((f.name,), lambda: F.coalesce(f.column.cast(f"array<{SQL[kind]}>"), none)))
        zero = {"string": "", "double": 0.0}.get(kind, 0)
        return V(kind, F.coalesce(f.column.cast(SQL[kind]), F.lit(zero).cast(SQL[kind])))

    def index(self, e) -> int:
        v = self.value(e)
        if not v.fixed:
            raise ScoreCodeError("score code: fields and terms are indexed by constants or loop counters")
        return int(v.value)

    def formatted(self, args: list[V]) -> V:
        if all(a.fixed for a in args):
            return V("string", re.sub(r"%(\.\d+)?f", r"%\1f", args[0].value) % tuple(a.value for a in args[1:]))
        kinds = re.findall(r"%[-+0-9.]*([a-z])", args[0].value)
        rest = [(_cast(a, "double") if k == "f" else a).col() for k, a in zip(kinds, args[1:])]
        return V("string", F.format_string(args[0].value, *rest))

    def e_call(self, target, name: str, args: list) -> V:
        if target[0] == "name" and target[1] in ("Math", "Integer", "Long", "Double", "Float", "String") and target[1] not in self.env:
            return self.static(target[1], name, [self.value(a) for a in args])
        v, rest = self.value(target), [self.value(a) for a in args]
        if v.kind.startswith("map:"):
            kind = v.kind[4:]
            if name == "get":
                if v.fixed and rest[0].fixed:
                    return V(kind, v.value.get(rest[0].value, 0 if kind != "string" else None))
                return V(kind, F.try_element_at(v.col(), rest[0].col()))
            if name == "containsKey":
                return V("bool", rest[0].value in v.value) if v.fixed and rest[0].fixed else V("bool", F.coalesce(F.map_contains_key(v.col(), rest[0].col()), F.lit(False)))
            if name == "keySet":
                return V("list:string", list(v.value) if v.fixed else F.map_keys(v.value))
            if name == "size":
                return V("int", len(v.value) if v.fixed else F.size(v.value))
        if v.kind.startswith("list:"):
            kind = v.kind[5:]
            if name in ("size", "length"):
                return V("int", len(v.value) if v.fixed else F.size(v.value))
            if name == "get":
                return V(kind, v.value[rest[0].value]) if v.fixed and rest[0].fixed else V(kind, F.get(v.col(), rest[0].col()))
            if name == "contains":
                return V("bool", F.coalesce(F.array_contains(v.col(), rest[0].col()), F.lit(False)))
            if name == "isEmpty":
                return V("bool", F.size(v.col()) == 0)
        if name == "equals":
            return self.same(v, rest[0])
        if v.kind == "string":
            c, a = v.col(), [r.col() for r in rest]
            made = {
                "equalsIgnoreCase": lambda: V("bool", F.coalesce(F.lower(c) == F.lower(a[0]), F.lit(False))),
                "length": lambda: V("int", F.length(c)), "isEmpty": lambda: V("bool", F.length(c) == 0),
                "contains": lambda: V("bool", F.contains(c, a[0])), "startsWith": lambda: V("bool", F.startswith(c, a[0])),
                "endsWith": lambda: V("bool", F.endswith(c, a[0])), "toLowerCase": lambda: V("string", F.lower(c)),
                "toUpperCase": lambda: V("string", F.upper(c)), "trim": lambda: V("string", F.trim(c)),
                "indexOf": lambda: V("int", F.position(a[0], c) - 1), "concat": lambda: V("string", F.concat(c, a[0])),
                "substring": lambda: V("string", F.substr(c, a[0] + 1, *([a[1] - a[0]] if len(a) > 1 else []))),
                "split": lambda: V("list:string", F.split(c, rest[0].value)), "toString": lambda: v,
                "replace": lambda: V("string", F.replace(c, a[0], a[1])), "hashCode": lambda: V("int", java_hash(c)),
                "compareTo": lambda: V("int", F.when(c < a[0], -1).when(c > a[0], 1).otherwise(0)),
            }
            if name in made:
                return made[name]()
        if name in ("intValue", "longValue", "doubleValue", "floatValue"):
            return _cast(v, {"intValue": "int", "longValue": "long"}.get(name, "double"))
        raise ScoreCodeError(f"score code: {v.kind}.{name}() isn't supported")

    def static(self, owner: str, name: str, args: list[V]) -> V:
        if owner == "Math":
            if name in ("max", "min") and len(args) == 2:
                kind = _wider(args[0].kind, args[1].kind)
                if all(a.fixed for a in args):
                    return V(kind, (max if name == "max" else min)(args[0].value, args[1].value))
                return V(kind, (F.greatest if name == "max" else F.least)(*(_cast(a, kind).col() for a in args)))
            if name == "abs":
                return V(args[0].kind, abs(args[0].value) if args[0].fixed else F.abs(args[0].value))
            one = {"sqrt": F.sqrt, "log": F.ln, "log10": F.log10, "exp": F.exp, "sin": F.sin, "cos": F.cos, "tan": F.tan,
                   "asin": F.asin, "acos": F.acos, "atan": F.atan, "cbrt": F.cbrt, "signum": F.signum,
                   "toRadians": F.radians, "toDegrees": F.degrees}
            if name in one:
                return V("double", one[name](_cast(args[0], "double").col()))
            if name == "pow":
                return V("double", F.pow(_cast(args[0], "double").col(), _cast(args[1], "double").col()))
            if name in ("floor", "ceil"):
                return V("double", (F.floor if name == "floor" else F.ceil)(_cast(args[0], "double").col()).cast("double"))
            if name == "round":
                return V("long", F.floor(_cast(args[0], "double").col() + 0.5).cast("bigint"))
        if name in ("valueOf", "parseInt", "parseLong", "parseDouble", "parseFloat", "toString", "format"):
            if owner == "String":
                return self.formatted(args) if name == "format" else _cast(args[0], "string")
            return _cast(args[0], TYPES[owner])
        raise ScoreCodeError(f"score code: {owner}.{name}() isn't supported")


def _java_text(v: V) -> str:
    return str(v.value).lower() if v.kind == "bool" else str(v.value)


def _assigned(body: list) -> set[str]:
    out: set[str] = set()
    for s in body:
        if s[0] == "assign":
            out.add(s[1])
        for part in s[1:]:
            if isinstance(part, list):
                out |= _assigned([p for p in part if isinstance(p, tuple)])
    return out


def _named(code) -> set[str]:
    """The variables that code speaks of."""
    if not isinstance(code, (list, tuple)):
        return set()
    return {code[1]} if len(code) == 2 and code[0] == "name" else set().union(*map(_named, code))


def _returns(body: list) -> bool:
    return any(s[0] == "return" or any(isinstance(p, list) and _returns([q for q in p if isinstance(q, tuple)]) for p in s[1:]) for s in body)


def java_hash(c: Column) -> Column:
    """String.hashCode of text in the basic plane, as a 32-bit number."""
    codes = F.transform(F.split(c, ""), lambda ch: F.ascii(ch).cast("bigint"))
    total = F.aggregate(F.filter(codes, lambda x: x > 0), F.lit(0).cast("bigint"), lambda h, x: F.pmod(h * 31 + x, F.lit(1 << 32)))
    return F.when(total >= 1 << 31, total - (1 << 32)).otherwise(total).cast("int")


def _parameters(model: ScoreModel) -> dict[str, V]:
    out: dict[str, V] = {}
    for kind, name, value in model.params:
        own = TYPES.get({"integer": "Integer", "string": "String"}.get(kind, kind), "")
        if kind.startswith("map<"):
            item = TYPES.get({"integer": "int", "string": "String"}.get(kind[4:-1].split(",")[1], kind[4:-1].split(",")[1]), "double")
            out[name] = V("map:" + item, {k: float(x) if item == "double" else x for k, x in (value or {}).items()})
        elif isinstance(value, list):
            out[name] = V("list:" + own, [float(x) if own == "double" else x for x in value])
        else:
            empty = {"string": "", "double": 0.0}.get(own, 0)
            out[name] = V(own, empty if value is None else float(value) if own == "double" else value)
    return out


@lru_cache(maxsize=512)
def statements(code: str) -> tuple:
    """Score code, read once: what it says depends on nothing but its text."""
    reader, body = _Reader(code), []
    while reader.s[reader.i][0] != "end":
        body.append(reader.statement())
    return tuple(body)


def run_model(model: ScoreModel, schema: Schema, matrix, score: Column | None, distance: Column | None) -> tuple[Column, Column | None]:
    """(score column, explanation column or None)."""
    if model.plugin or model.code is None:
        context = {"schema": schema, "matrix": matrix, "score": score, "distance": distance, "params": {n: v for _, n, v in model.params}}
        return plugin(model.name, model.override)(context).cast("double"), None
    body = statements(model.code)
    c = _Compiler(schema, matrix, score, distance, _parameters(model))
    c.run(list(body), YES)
    if c.result is None:
        raise ScoreCodeError("score code: nothing is returned")
    told = None
    if c.notes:
        notes = [F.when(g.col(), v.col()) for g, v in c.notes]
        text = F.to_json(F.struct(F.concat_ws("; ", *notes).alias("description"), c.result.col().alias("value")))
        told = text
    return c.result.col().cast("double"), told
