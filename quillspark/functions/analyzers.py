"""Analyzers: a column of tokens for documents and the same tokens in Python for query text."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

STOPWORDS = tuple(
    "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this "
    "to was will with".split()
)
CJK = r"぀-ヿ㐀-䶿一-鿿豈-﫿"
WORD_JAVA = rf"[{CJK}]|[\p{{L}}\p{{N}}&&[^{CJK}]](?:['’._]?[\p{{L}}\p{{N}}&&[^{CJK}]])*"
WORD_PY = rf"[{CJK}]|(?:(?![{CJK}])[^\W_])(?:['’._]?(?:(?![{CJK}])[^\W_]))*"
CASE_CUT = r"(?<=\p{Ll})(?=\p{Lu})"
NUMBER_CUT = r"(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=\p{L})"


@dataclass(frozen=True)
class Analyzer:
    """``column`` gives the tokens of a text column, ``tokens`` those of a string; both must agree.

    ``gaps``: removed stopwords leave a hole in positions; ``positions`` then gives a column of
    positions that goes with the tokens.
    """

    column: Callable[[Column], Column]
    tokens: Callable[[str], list[str]]
    stopwords: tuple[str, ...] = ()

    def all_tokens(self, c: Column) -> Column:
        return F.coalesce(self.column(c), F.expr("cast(array() as array<string>)"))

    def kept(self, c: Column) -> Column:
        got = self.all_tokens(c)
        return F.filter(got, lambda t: ~t.isin(*self.stopwords)) if self.stopwords else got

    def query(self, text: str) -> list[str]:
        return [t for t in self.tokens(text) if t not in self.stopwords]

    def query_positions(self, text: str) -> list[tuple[int, str]]:
        return [(i, t) for i, t in enumerate(self.tokens(text)) if t not in self.stopwords]


def _words(java: str, py: str, stopwords: tuple[str, ...] = ()) -> Analyzer:
    found = re.compile(py)
    return Analyzer(
        lambda c: F.regexp_extract_all(F.lower(c), F.lit(java), F.lit(0)), lambda s: found.findall(s.lower()), stopwords
    )


def word_delimiter(
    lower_case: bool = True, set_stopwords: bool = True, split_on_case_change: bool = True, split_on_numerics: bool = True,
    generate_word_parts: bool = True, generate_number_parts: bool = True, catenate_words: bool = False, catenate_numbers: bool = False,
    catenate_all: bool = False, preserve_original: bool = False, stem_english_possessive: bool = True,
) -> Analyzer:
    """Words cut into parts at signs inside them and, unless told not to, where small letters meet capitals or letters digits.

    Signs without blanks are words of their own. Of each word come the original if it is asked for,
    its parts (those with a letter are words, others numbers), then runs of parts put together.
    """
    import regex

    cuts = "|".join([r"[^\p{L}\p{N}]+", *([CASE_CUT] if split_on_case_change else []), *([NUMBER_CUT] if split_on_numerics else [])])
    word = rf"[{CJK}]|[\p{{L}}\p{{N}}&&[^{CJK}]](?:['’._]?[\p{{L}}\p{{N}}&&[^{CJK}]])*"
    possessive, letter, mark = r"['’][sS]$", r"\p{L}", "\u0001"
    part = rf"[^{mark}]*\p{{L}}[^{mark}]*", r"\p{N}+"
    runs = [rf"{p}(?:{mark}{p})+" if kept else rf"{p}(?:{mark}{p})*" for p, kept in zip(part, (generate_word_parts, generate_number_parts))]
    wanted = [r for r, w in zip(runs, (catenate_words, catenate_numbers)) if w]

    def column(c: Column) -> Column:
        def of(w: Column) -> Column:
            own = F.regexp_replace(w, possessive, "") if stem_english_possessive else w
            parts = F.filter(F.split(own, cuts), lambda t: t != "")
            kept = F.filter(parts, lambda t: F.when(t.rlike(letter), F.lit(generate_word_parts)).otherwise(F.lit(generate_number_parts)))
            out = [F.array(w)] if preserve_original else []
            joined = F.array_join(parts, mark)
            out += [kept, *(F.transform(F.regexp_extract_all(joined, F.lit(r), F.lit(0)), lambda t: F.replace(t, F.lit(mark), F.lit(""))) for r in wanted)]
            if catenate_all:
                out.append(F.when(F.size(parts) > 1, F.array(F.array_join(parts, ""))).otherwise(F.expr("cast(array() as array<string>)")))
            return F.array_distinct(F.concat(*out)) if len(out) > 1 else out[0]

        got = F.flatten(F.transform(F.regexp_extract_all(c, F.lit(word), F.lit(0)), of))
        return F.transform(got, F.lower) if lower_case else got

    cut, each, run = regex.compile(cuts, regex.V1), regex.compile(WORD_PY), [regex.compile(r) for r in wanted]

    def tokens(s: str) -> list[str]:
        out: list[str] = []
        for w in each.findall(s):
            own = regex.sub(possessive, "", w) if stem_english_possessive else w
            parts = [t for t in cut.split(own) if t]
            got = [w] if preserve_original else []
            got += [t for t in parts if (generate_word_parts if regex.search(letter, t) else generate_number_parts)]
            got += [m.replace(mark, "") for r in run for m in r.findall(mark.join(parts))]
            got += ["".join(parts)] if catenate_all and len(parts) > 1 else []
            out += dict.fromkeys(got) if preserve_original or run or catenate_all else got
        return [t.lower() for t in out] if lower_case else out

    return Analyzer(column, tokens, STOPWORDS if set_stopwords else ())


_REGISTRY: dict[str, Analyzer] = {}


def register(name: str, analyzer: Analyzer) -> None:
    """Make an analyzer known under a name; dictionary analyzers for other languages plug in here."""
    _REGISTRY[name] = analyzer


def analyzer(name: str) -> Analyzer:
    if name not in _REGISTRY:
        raise KeyError(f"no analyzer is registered as {name!r}")
    return _REGISTRY[name]


def max_match(words: set[str], longest: bool = True) -> Analyzer:
    """Dictionary segmentation for text without blanks: the longest word first, else single signs.

    The column half is a pandas UDF: matching against a dictionary can't be expressed in SQL.
    """
    most = max(map(len, words), default=1)

    def tokens(s: str) -> list[str]:
        out, i, s = [], 0, s.lower()
        while i < len(s):
            if s[i].isspace():
                i += 1
                continue
            if s[i].isascii() and s[i].isalnum():
                j = i
                while j < len(s) and s[j].isascii() and s[j].isalnum():
                    j += 1
            else:
                sizes = range(min(most, len(s) - i), 0, -1) if longest else range(2, min(most, len(s) - i) + 1)
                j = i + next((n for n in sizes if s[i : i + n] in words), 1)
            if any(ch.isalnum() for ch in s[i:j]):
                out.append(s[i:j])
            i = j
        return out

    def column(c: Column) -> Column:
        @F.pandas_udf("array<string>")
        def cut(texts: pd.Series) -> pd.Series:
            return texts.map(lambda t: None if t is None else tokens(t))

        return cut(c)

    return Analyzer(column, tokens)


def best_path(frequency: dict[str, int], index: bool = False) -> Analyzer:
    """Dictionary segmentation by the most probable path: the words whose frequencies' product is largest.

    Signs that no word covers stand alone; letters and digits of one run stay together. ``index``
    puts the dictionary's words of two and three signs inside a longer word before it, as an index
    needs them; without it a text gives one path, as a query does. Both halves use the same code;
    the column half is a pandas UDF, for a path isn't a SQL expression.
    """
    import math

    total = math.log(max(sum(frequency.values()), 1))
    weight = {w.lower(): math.log(max(n, 1)) - total for w, n in frequency.items()}
    most = max(map(len, weight), default=1)

    def path(s: str) -> list[str]:
        best: list[tuple[float, int]] = [(0.0, 0)] * (len(s) + 1)
        for i in range(len(s) - 1, -1, -1):
            ends = [i + 1, *(j for j in range(i + 2, min(len(s), i + most) + 1) if s[i:j] in weight)]
            best[i] = max((weight.get(s[i:j], -total - 1) + best[j][0], j) for j in ends)
        out, i = [], 0
        while i < len(s):
            out.append(s[i : best[i][1]])
            i = best[i][1]
        return out

    runs = re.compile(rf"[{CJK}]+|(?:(?![{CJK}])[^\W_])+")

    def tokens(s: str) -> list[str]:
        out: list[str] = []
        for run in runs.findall(s.lower()):
            for w in path(run) if re.match(rf"[{CJK}]", run) else [run]:
                if index and re.match(rf"[{CJK}]", w):
                    out += [w[i : i + n] for n in (2, 3) if len(w) > n for i in range(len(w) - n + 1) if w[i : i + n] in weight]
                out.append(w)
        return out

    def column(c: Column) -> Column:
        @F.pandas_udf("array<string>")
        def cut(texts: pd.Series) -> pd.Series:
            return texts.map(lambda t: None if t is None else tokens(t))

        return cut(c)

    return Analyzer(column, tokens)


register("standard", _words(WORD_JAVA, WORD_PY, STOPWORDS))
register("standard_all", _words(WORD_JAVA, WORD_PY))
register("simple", _words("[a-z0-9]+", "[a-z0-9]+"))
register("whitespace", Analyzer(lambda c: F.filter(F.split(c, r"\s+"), lambda t: t != ""), str.split))
register("word_delimiter", word_delimiter())
register("word_delimiter_all", word_delimiter(set_stopwords=False))
