"""Signs of a statement, each with its place."""

from __future__ import annotations

import re
from dataclasses import dataclass


class StatementError(ValueError):
    """A statement that can't be read; the message begins with ``[line:l, col:c]``."""

    def __init__(self, line: int, col: int, message: str):
        super().__init__(f"[line:{line}, col:{col}] {message}")
        self.line, self.col = line, col


@dataclass(frozen=True)
class Sign:
    kind: str  # word, quoted, string, integer, real, hole, op, code, end
    text: str
    line: int
    col: int

    @property
    def key(self) -> str:
        return self.text.upper() if self.kind == "word" else ""


SIGNS = re.compile(
    r"""(?P<blank>\s+|--[^\n]*|/\*.*?\*/)
      |(?P<real>-?\d+\.\d*(?:[eE][+-]?\d+)?[fFdD]?|-?\.\d+(?:[eE][+-]?\d+)?|-?\d+[eE][+-]?\d+)
      |(?P<integer>-?\d+[lL]?)(?![A-Za-z_])
      |(?P<string>'(?:[^']|'')*'|"(?:[^"]|"")*")
      |(?P<quoted>`[^`]+`)
      |(?P<hole>\$[A-Za-z0-9_]+)
      |(?P<word>[A-Za-z_][A-Za-z0-9_\-]*(?:\.[A-Za-z0-9_\-]+)*|\d+[A-Za-z_]\w*)
      |(?P<op><>|!=|<=|>=|[=<>(),*\[\]{}:|;^])""",
    re.X | re.S,
)


def signs_of(text: str) -> list[Sign]:
    """All signs. What stands between BEGIN and END is one sign of kind code: it has its own lexer."""
    out: list[Sign] = []
    at, line, start = 0, 1, 0
    while at < len(text):
        m = SIGNS.match(text, at)
        if not m:
            raise StatementError(line, at - start, f"unexpected sign {text[at]!r}")
        kind, piece = m.lastgroup, m.group()
        if kind == "string":
            q = piece[0]
            out.append(Sign(kind, piece[1:-1].replace(q + q, q), line, at - start))
        elif kind == "quoted":
            out.append(Sign("quoted", piece[1:-1], line, at - start))
        elif kind != "blank":
            out.append(Sign(kind, piece, line, at - start))
        at = m.end()
        if kind == "word" and piece.upper() == "BEGIN":
            end = re.compile(r"\bEND\b", re.I).search(text, at)
            if not end:
                raise StatementError(line, m.start() - start, "BEGIN without END")
            out.append(Sign("code", text[at : end.start()], line, at - start))
            piece, at = text[m.start() : end.end()], end.end()
        if n := piece.count("\n"):
            line, start = line + n, at - len(piece) + piece.rindex("\n") + 1
    out.append(Sign("end", "end of statement", line, at - start))
    return out
