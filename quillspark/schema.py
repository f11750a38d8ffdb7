"""Collections' schemas: typed, flagged fields, static ones and dynamic ones by name suffix."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPARK_TYPES = {
    "string": T.StringType(), "facet": T.StringType(), "integer": T.IntegerType(), "long": T.LongType(),
    "double": T.DoubleType(), "float": T.FloatType(),
}
ALIASES = {"text": "string", "int": "integer"}
NUMERIC = ("integer", "long", "double", "float")
DYNAMIC = "_dyn"


class SchemaError(ValueError):
    pass


def type_name(name: str) -> str:
    low = ALIASES.get(name.lower(), name.lower())
    if low not in SPARK_TYPES:
        raise SchemaError(f"unknown field type {name!r}")
    return low


@dataclass(frozen=True)
class Field:
    name: str
    type: str = "string"
    indexed: bool = True
    stored: bool = True
    tokenized: bool = False
    doc_values: bool = False
    multi: bool = False
    omit_norms: bool = False
    omit_freqs: bool = False
    snippet: bool = False
    analyzer: str = "standard"
    dynamic: bool = False

    def __post_init__(self):
        if self.doc_values and self.multi:
            raise SchemaError(f"{self.name}: doc values and multiple values exclude each other")

    @property
    def searchable(self) -> bool:
        return self.indexed or self.doc_values

    @property
    def spark_type(self) -> T.DataType:
        one = SPARK_TYPES[self.type]
        return T.ArrayType(one) if self.multi else one

    @property
    def column(self) -> Column:
        if not self.dynamic:
            return F.col(f"`{self.name}`")
        raw = F.try_element_at(F.col(DYNAMIC), F.lit(self.name))
        return raw if self.type in ("string", "facet") else raw.try_cast(SPARK_TYPES[self.type])


@dataclass(frozen=True)
class Schema:
    id: str
    fields: tuple[Field, ...] = field(default_factory=tuple)

    def static(self, name: str) -> Field | None:
        if name == self.id:
            return next((f for f in self.fields if f.name == name), Field(name, omit_norms=True))
        return next((f for f in self.fields if f.name == name), None)

    def resolve(self, name: str) -> Field:
        """A static field, else a dynamic one whose type is the suffix after the last dot.

        A suffix on a static field's name means that field; no known suffix means a string.
        """
        if found := self.static(name):
            return found
        stem, dot, suffix = name.rpartition(".")
        if dot and ALIASES.get(suffix.lower(), suffix.lower()) in SPARK_TYPES:
            if found := self.static(stem):
                return found
            return Field(stem, type_name(suffix), dynamic=True)
        return Field(name, "string", dynamic=True)

    def struct(self) -> T.StructType:
        rows = [T.StructField(self.id, T.StringType(), False)]
        rows += [T.StructField(f.name, f.spark_type, True) for f in self.fields if f.name != self.id]
        return T.StructType([*rows, T.StructField(DYNAMIC, T.MapType(T.StringType(), T.StringType()), True)])

    def with_field(self, name: str, **flags) -> Schema:
        return replace(self, fields=tuple(replace(f, **flags) if f.name == name else f for f in self.fields))


def schema_of(df: DataFrame, id: str, tokenized: tuple[str, ...] = (), facets: tuple[str, ...] = (), analyzer: str = "simple") -> Schema:
    """A schema for a DataFrame's columns, all of them indexed and stored."""
    names = {T.IntegerType: "integer", T.ShortType: "integer", T.LongType: "long", T.DoubleType: "double", T.FloatType: "float"}
    out = []
    for c in df.schema.fields:
        multi = isinstance(c.dataType, T.ArrayType)
        one = c.dataType.elementType if multi else c.dataType
        if isinstance(one, (T.StructType, T.MapType, T.ArrayType)):
            continue
        kind = "facet" if c.name in facets else names.get(type(one), "string")
        out.append(Field(c.name, kind, tokenized=c.name in tokenized, multi=multi, analyzer=analyzer, omit_norms=kind == "facet" or c.name == id))
    return Schema(id, tuple(out))


def load_xml(text: str) -> Schema:
    """``<schema><table><id>..</id><column name= type= index= store= .../></table></schema>``; flags are yes or no."""
    root = ET.fromstring(text)
    table = root if root.tag == "table" else root.find(".//table")
    if table is None:
        raise SchemaError("no table element")
    key = table.find("id")
    name = (key.text or "").strip() if key is not None else ""
    if key is not None and not name:
        name = key.get("name", "")
    if not name:
        raise SchemaError("no id element")
    flags = {
        "index": "indexed", "store": "stored", "tokenize": "tokenized", "docvalues": "doc_values", "multi": "multi",
        "omitnorms": "omit_norms", "omitfreqs": "omit_freqs", "snippet": "snippet",
    }
    fields = []
    for c in table.iter("column"):
        own = {k.lower(): v for k, v in c.attrib.items()}
        chosen = {"indexed": False, "stored": False}
        for k, to in flags.items():
            if k in own:
                if own[k].lower() not in ("yes", "no"):
                    raise SchemaError(f"{own.get('name')}: {k} must be yes or no")
                chosen[to] = own[k].lower() == "yes"
        fields.append(Field(own["name"], type_name(own.get("type", "string")), **chosen))
    return Schema(name, tuple(fields))
