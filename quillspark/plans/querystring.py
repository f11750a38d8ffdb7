"""The query-string language: ``field:term``, phrases, groups, ranges, wildcards, boosts, + - AND OR NOT."""

from __future__ import annotations

import re

from ..functions.analyzers import analyzer
from ..schema import NUMERIC, Field, Schema
from .nodes import Bool, Fuzzy, MatchAll, MatchNone, Node, Pattern, Phrase, Range, Term
from .values import typed

SIGNS = re.compile(
    r"""(?P<blank>\s+)|(?P<all>\*:\*)|(?P<quoted>"(?:\\.|[^"\\])*")|(?P<op>&&|\|\||[()\[\]{}!+\-^~:])
      |(?P<regex>/(?:\\.|[^/\\])+/)|(?P<term>(?:\\.|[^\s()\[\]{}"^~:\\!+\-])(?:\\.|[^\s()\[\]{}"^~:\\])*)""",
    re.X | re.S,
)


class QueryStringError(ValueError):
    pass


def wildcard(text: str) -> str:
    """``*`` any string, ``?`` one sign, a backslash takes the next sign as it is."""
    out, i = [], 0
    while i < len(text):
        c = text[i]
        if c == "\\" and i + 1 < len(text):
            i += 1
            out.append(re.escape(text[i]))
        else:
            out.append({"*": ".*", "?": "."}.get(c) or re.escape(c))
        i += 1
    return "(?s)" + "".join(out)


def plain(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


class _Parser:
    def __init__(self, text: str, schema: Schema, default_and: bool, disable_coord: bool):
        self.schema, self.default_and, self.disable_coord = schema, default_and, disable_coord
        self.signs, at = [], 0
        while at < len(text):
            m = SIGNS.match(text, at)
            if not m:
                raise QueryStringError(f"unexpected sign {text[at]!r} at {at} in {text!r}")
            if m.lastgroup != "blank":
                self.signs.append((m.lastgroup, m.group(), m.end(), m.start()))
            at = m.end()
        self.i = 0

    def peek(self, k: int = 0) -> tuple[str, str]:
        return self.signs[self.i + k][:2] if self.i + k < len(self.signs) else ("end", "")

    def take(self, text: str | None = None) -> str:
        kind, own = self.peek()
        if kind == "end" or (text is not None and own != text):
            raise QueryStringError(f"expected {text or 'more'}, found {own or 'the end'}")
        self.i += 1
        return own

    def clauses(self, name: str, closing: str) -> Node:
        """Clauses up to ``closing``: AND makes both sides required, + and - mark one, the rest is optional."""
        rows: list[list] = []  # role, node
        joined = ""
        while self.peek()[1] != closing and self.peek()[0] != "end":
            kind, text = self.peek()
            if (kind == "term" and text in ("AND", "OR")) or text in ("&&", "||"):
                self.i += 1
                joined = "and" if text in ("AND", "&&") else "or"
                if joined == "and" and rows and rows[-1][0] == "should":
                    rows[-1][0] = "must"
                elif joined == "or" and self.default_and and rows and rows[-1][0] == "must" and not rows[-1][2]:
                    rows[-1][0] = "should"
                continue
            role, marked = "", False
            while True:
                kind, text = self.peek()
                if text in ("+", "-", "!") or (kind == "term" and text == "NOT"):
                    self.i += 1
                    role, marked = ("must" if text == "+" else "not"), True
                else:
                    break
            node = self.clause(name)
            if not role:
                role = "must" if joined == "and" or (self.default_and and joined != "or") else "should"
            if node is not None:
                rows.append([role, node, marked])
            joined = ""
        pick = lambda r: tuple(n for role, n, _ in rows if role == r)
        if len(rows) == 1 and rows[0][0] != "not":
            return rows[0][1]
        if not rows:
            return MatchNone()
        return Bool(pick("must"), pick("should"), pick("not"), scored=True, disable_coord=self.disable_coord)

    def boost(self, node: Node | None) -> Node | None:
        if self.peek()[1] == "^":
            self.i += 1
            value = float(self.take())
            if node is not None:
                node = node.__class__(**{**node.__dict__, "boost": node.boost * value})
        return node

    def clause(self, name: str) -> Node | None:
        kind, text = self.peek()
        if kind == "all":
            self.i += 1
            return self.boost(MatchAll())
        if kind == "term" and self.peek(1)[1] == ":":
            self.i += 2
            name, (kind, text) = plain(text), self.peek()
        if text == "(":
            self.i += 1
            node = self.clauses(name, ")")
            self.take(")")
            return self.boost(node)
        field = self.schema.resolve(name) if name else None
        if text in ("[", "{"):
            return self.boost(self.range(field, text == "["))
        self.i += 1
        if kind == "quoted":
            slop = 0
            if self.peek()[1] == "~":
                self.i += 1
                slop = int(float(self.take()))
            return self.boost(self.words(field, plain(text[1:-1]), slop))
        if kind == "regex":
            return self.boost(Pattern(field, "(?s)" + text[1:-1].replace("\\/", "/"), text) if field else MatchNone())
        if kind != "term":
            raise QueryStringError(f"unexpected {text or 'end'}")
        if self.peek()[1] == "~":
            self.i += 1
            edits = 2
            if self.peek()[0] == "term" and self.signs[self.i - 1][2] == self.signs[self.i][3] and re.fullmatch(r"\d+(\.\d+)?", self.peek()[1]):
                given = float(self.take())
                edits = int(given) if given >= 1 else min(2, int((1 - given) * len(text)))
            return self.boost(Fuzzy(field, plain(text).lower(), min(edits, 2)) if field else MatchNone())
        if re.search(r"(?<!\\)[*?]", text):
            if field is None:
                return MatchNone()
            low = text.lower() if field.tokenized else text
            return self.boost(Pattern(field, wildcard(low), text))
        return self.boost(self.words(field, plain(text), 0))

    def words(self, field: Field | None, text: str, slop: int) -> Node | None:
        if field is None:
            return MatchNone()
        if field.type in NUMERIC:
            value = typed(field, text)
            return Range(field, value, value)
        if not field.tokenized:
            return Term(field, text)
        found = analyzer(field.analyzer).query_positions(text)
        if not found:
            return None
        if len(found) == 1:
            return Term(field, found[0][1])
        return Phrase(field, tuple((p - found[0][0], t) for p, t in found), slop)

    def range(self, field: Field | None, with_low: bool) -> Node:
        self.i += 1
        ends = []
        for stop in ("TO", None):
            sign = ""
            if self.peek()[1] in ("-", "+"):
                sign = self.take()
            text = self.take()
            if text[:1] == '"':
                text = plain(text[1:-1])
            ends.append(None if text == "*" else sign.replace("+", "") + plain(text))
            if stop:
                self.take(stop)
        closing = self.take()
        if closing not in ("]", "}"):
            raise QueryStringError(f"expected ] or }}, found {closing}")
        if field is None or field.type == "facet":
            return MatchNone()
        low, high = (None if e is None else typed(field, e.lower() if field.tokenized else e) for e in ends)
        return Range(field, low, high, with_low, closing == "]")


def parse_query_string(text: str, schema: Schema, default_and: bool = False, disable_coord: bool = True) -> Node:
    """A scored node. Terms without a field match nothing: there is no default field."""
    p = _Parser(text, schema, default_and, disable_coord)
    node = p.clauses("", "")
    if p.peek()[0] != "end":
        raise QueryStringError(f"unexpected {p.peek()[1]!r}")
    return node
