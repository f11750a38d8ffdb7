"""The typed request that a statement becomes."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from ..schema import Field


@dataclass(frozen=True)
class Node:
    pass


@dataclass(frozen=True)
class MatchAll(Node):
    boost: float = 1.0


@dataclass(frozen=True)
class MatchNone(Node):
    boost: float = 1.0


@dataclass(frozen=True)
class Term(Node):
    """An exact token (or value) of a string field."""

    field: Field
    token: str
    boost: float = 1.0


@dataclass(frozen=True)
class Phrase(Node):
    """Tokens at given positions, moved by ``slop`` in total."""

    field: Field
    terms: tuple[tuple[int, str], ...]
    slop: int = 0
    boost: float = 1.0


@dataclass(frozen=True)
class Range(Node):
    field: Field
    low: Any = None
    high: Any = None
    with_low: bool = True
    with_high: bool = True
    boost: float = 1.0


@dataclass(frozen=True)
class Pattern(Node):
    """Tokens (or values) that a regular expression fits as a whole."""

    field: Field
    regex: str
    text: str
    boost: float = 1.0


@dataclass(frozen=True)
class Fuzzy(Node):
    field: Field
    token: str
    edits: int
    boost: float = 1.0


@dataclass(frozen=True)
class Exists(Node):
    """The field has a value; never true for fields that aren't searchable."""

    field: Field
    boost: float = 1.0


@dataclass(frozen=True)
class Distance(Node):
    lon: float
    lat: float
    km: float
    boost: float = 1.0


@dataclass(frozen=True)
class Bool(Node):
    must: tuple[Node, ...] = ()
    should: tuple[Node, ...] = ()
    must_not: tuple[Node, ...] = ()
    scored: bool = False
    disable_coord: bool = False
    boost: float = 1.0


@dataclass(frozen=True)
class Filtered(Node):
    query: Node
    filter: Node
    boost: float = 1.0


@dataclass(frozen=True)
class DisMax(Node):
    parts: tuple[Node, ...]
    tie: float = 0.1
    boost: float = 1.0


@dataclass(frozen=True)
class ScoreModel:
    name: str
    code: str | None
    params: tuple[tuple[str, str, Any], ...] = ()  # type, name, value
    plugin: bool = False
    override: bool = False


@dataclass(frozen=True)
class Flexible(Node):
    text: str
    fields: tuple[tuple[Field, float], ...]
    model: ScoreModel
    full_match: bool = False
    match_ratio: float = 0.0
    global_idf: bool = False
    global_fields: tuple[Field, ...] = ()
    boost: float = 1.0


@dataclass(frozen=True)
class Sort:
    kind: str  # field, score or distance
    field: Field | None = None
    descending: bool = True


@dataclass(frozen=True)
class Facet:
    field: Field
    top: int = 10
    path: tuple[str, ...] = ()


@dataclass(frozen=True)
class Bucket:
    low: float | None
    high: float | None
    with_low: bool
    with_high: bool
    label: str


@dataclass(frozen=True)
class Route:
    shards: tuple[tuple[int, int | None], ...] = ()
    replica_key: str | None = None


@dataclass
class Search:
    indexes: tuple[str, ...] = ()
    columns: tuple[str, ...] | None = None
    query: Node = field(default_factory=MatchAll)
    filter: Node | None = None
    boost: float = 1.0
    sorts: tuple[Sort, ...] = ()
    offset: int = 0
    limit: int = 10
    group: Field | None = None
    group_top: int = 1
    facets: tuple[Facet, ...] = ()
    drills: tuple[tuple[Field, tuple[str, ...]], ...] = ()
    sideways: bool = False
    aggregations: tuple[tuple[Field, tuple[Bucket, ...]], ...] = ()
    explain: bool = False
    source: bool = False
    snippets: tuple[Field, ...] = ()
    route: Route | None = None
    model: ScoreModel | None = None
    in_top: int | None = None
    distance: tuple[float, float] | None = None


@dataclass
class Delete:
    indexes: tuple[str, ...]
    filter: Node | None
    route: Route | None = None
