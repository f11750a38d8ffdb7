"""Highlighted passages."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import Field

PASSAGES = 10


def snippet(f: Field, words: list[str], passages: int = PASSAGES) -> Column:
    """Up to ten sentences that hold a searched word, in their order, with the words in <b>..</b>."""
    if not words:
        return F.lit("")
    apart = [w for w in words if not re.search(r"[぀-ヿ㐀-鿿]", w)]
    close = [w for w in words if w not in apart]
    parts = [rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join(map(re.escape, apart))})(?![\p{{L}}\p{{N}}])"] if apart else []
    parts += ["|".join(map(re.escape, close))] if close else []
    pattern = f"(?iu)({'|'.join(parts)})"
    sentences = F.regexp_extract_all(F.coalesce(f.column, F.lit("")), F.lit(r"[^.!?。！？]+[.!?。！？]*\s*"), F.lit(0))
    held = F.slice(F.filter(sentences, lambda s: s.rlike(pattern)), 1, passages)
    return F.rtrim(F.array_join(F.transform(held, lambda s: F.regexp_replace(s, pattern, "<b>$1</b>")), ""))
