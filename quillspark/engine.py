"""Searching collections: statements in, DataFrames out."""

from __future__ import annotations

import threading
import time
import uuid
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import cached_property
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions.geo import distance_km
from .operators.buckets import bucket_counts
from .operators.facets import drill_predicates, facet_counts
from .operators.match import predicate, token_column, token_fields, with_tokens
from .operators.scoremodel import java_hash, run_model
from .operators.scoring import Scorer, Similarity, Statistics, collect_statistics, query_terms
from .operators.snippet import snippet
from .plans import nodes as N
from .plans.parser import parse
from .schema import SPARK_TYPES, Field, Schema, type_name
from .sources.changes import resolve_requests
from .sources.json_docs import parse_documents, parse_requests


class NoSuchIndex(ValueError):
    pass


def shard_of(key: Column, shards: int) -> Column:
    """abs(hash(id) % shards), with the 32-bit string hash of the id."""
    return F.abs(java_hash(key.cast("string")) % shards).cast("int")


def index_table(df: DataFrame, schema: Schema) -> DataFrame:
    """``df`` with a token column for every tokenized field: write it once, search it often."""
    return with_tokens(df, {f.name: f for f in schema.fields if f.tokenized})


@dataclass
class Engine:
    """A collection, or several by name, under one schema.

    ``presort``: columns (name, descending) that IN TOP takes rows by; without it rows go by id.
    ``statistics``: term statistics to score with instead of the collection's own (global ones, or
    ones that still count deleted rows). ``strict``: BY .. NOT IN (..) alone matches nothing.
    """

    schema: Schema
    tables: dict[str, DataFrame] | DataFrame
    similarity: Similarity = field(default_factory=Similarity)
    shards: int = 1
    presort: tuple[tuple[str, bool], ...] = ()
    statistics: Statistics | None = None
    strict: bool = False
    cache_size: int = 0
    cache_seconds: float = float("inf")
    _cache: OrderedDict = field(default_factory=OrderedDict)

    def rows(self, indexes: tuple[str, ...] = ()) -> DataFrame:
        if isinstance(self.tables, DataFrame):
            return self.tables
        names = list(self.tables) if not indexes or indexes[0].lower() == "default" else list(indexes)
        if missing := [n for n in names if n not in self.tables]:
            if len(indexes) == 1 and len(self.tables) == 1:
                names = list(self.tables)
            else:
                raise NoSuchIndex(f"no index {', '.join(missing)}")
        out = self.tables[names[0]]
        for n in names[1:]:
            out = out.unionByName(self.tables[n], allowMissingColumns=True)
        return out

    def request(self, statement: str, params: dict[str, Any] | None = None) -> N.Search | N.Delete:
        return parse(statement, self.schema, params, self.strict)

    def search(self, statement: str | N.Search, params: dict[str, Any] | None = None) -> Result:
        if isinstance(statement, N.Search):
            return Result(self, statement)
        key = (statement, repr(sorted((params or {}).items())))
        if self.cache_size and key in self._cache:
            made, result = self._cache[key]
            if time.monotonic() - made <= self.cache_seconds:
                self._cache.move_to_end(key)
                return result
        request = self.request(statement, params)
        if isinstance(request, N.Delete):
            raise ValueError("a DELETE statement goes to delete()")
        result = Result(self, request)
        if self.cache_size:
            self._cache[key] = time.monotonic(), result
            self._cache.move_to_end(key)
            while len(self._cache) > self.cache_size:
                self._cache.popitem(last=False)
        return result

    def index(self, content: str | list[str] | DataFrame) -> tuple[Engine, DataFrame]:
        """Requests pushed in: (the engine with what they make of its table, failed updates (id, seq)).

        ``content``: JSON text, several in order, or rows (value, seq). Of several tables, one is named.
        Columns that the schema doesn't know are null in new rows.
        """
        if not isinstance(self.tables, DataFrame):
            raise ValueError("requests go to a single table; several are kept by MultiTable or StreamTables")
        table, key = self.tables, self.schema.id
        if not isinstance(content, DataFrame):
            said = [content] if isinstance(content, str) else content
            content = table.sparkSession.createDataFrame([(t, i) for i, t in enumerate(said)], "value string, seq long")
        requests = parse_requests(content)
        put = requests.where(F.col("kind").isin("INDEX", "REPLACE", "UPDATE"))
        docs = parse_documents(put.select("seq", "kind", F.col("content").alias("value")), self.schema, keep=("seq", "kind"))
        gone = requests.where("kind = 'DELETE'").select("seq", "kind", F.col("id").alias(key))
        log = docs.unionByName(gone, allowMissingColumns=True)
        own = [(F.col(f"`{f.name}`") if f.name in log.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in table.schema]
        done, failed = resolve_requests(table, log.select("seq", "kind", *own), key, gone="__gone")
        rows = table.join(done.select(key), key, "left_anti").select(*table.columns).unionByName(done.where("NOT __gone").drop("__gone"))
        return replace(self, tables=rows, _cache=OrderedDict()), failed

    def with_value(self, name: str, make: Callable[[DataFrame], Column], kind: str = "double") -> Engine:
        """The engine with one more field, worked out once for each row and kept for score models to read.

        The column is persisted with its table, so many searches compute it once.
        """
        def own(rows: DataFrame) -> DataFrame:
            return rows.withColumn(name, make(rows).cast(SPARK_TYPES[type_name(kind)])).persist(StorageLevel.DISK_ONLY)

        tables = own(self.tables) if isinstance(self.tables, DataFrame) else {n: own(t) for n, t in self.tables.items()}
        schema = replace(self.schema, fields=(*self.schema.fields, Field(name, type_name(kind), stored=False)))
        return replace(self, schema=schema, tables=tables, _cache=OrderedDict())

    def delete(self, statement: str, params: dict[str, Any] | None = None) -> DataFrame:
        """The rows that stay. Without WHERE none do."""
        request = self.request(statement, params)
        if not isinstance(request, N.Delete):
            raise ValueError("not a DELETE statement")
        rows = self.rows(request.indexes)
        gone = predicate(request.filter) if request.filter is not None else F.lit(True)
        if request.route and request.route.shards:
            gone &= shard_of(F.col(self.schema.id), self.shards).isin([s for s, _ in request.route.shards])
        columns = rows.columns
        return with_tokens(rows, token_fields(request.filter)).where(~F.coalesce(gone, F.lit(False))).select(*columns)


@dataclass
class Result:
    engine: Engine
    request: N.Search

    @property
    def schema(self) -> Schema:
        return self.engine.schema

    @cached_property
    def routed(self) -> DataFrame:
        r, e = self.request, self.engine
        rows = e.rows(r.indexes)
        if r.route and r.route.shards:
            rows = rows.where(shard_of(F.col(self.schema.id), e.shards).isin([s for s, _ in r.route.shards]))
        fields = token_fields(r.query) | token_fields(r.filter)
        return with_tokens(rows, fields)

    @cached_property
    def base(self) -> DataFrame:
        """Rows that the query and the filter match, drills aside."""
        r = self.request
        rows = self.routed
        if r.filter is not None:
            rows = rows.where(predicate(r.filter))
        if not isinstance(r.query, N.MatchAll):
            rows = rows.where(predicate(r.query))
        return self._top(rows)

    def _top(self, rows: DataFrame) -> DataFrame:
        """IN TOP n: the first n rows of every shard; groups aren't cut."""
        r, e = self.request, self.engine
        by_shard = dict(r.route.shards) if r.route else {}
        if r.group is not None or (r.in_top is None and not any(n is not None for n in by_shard.values())):
            return rows
        shard = shard_of(F.col(self.schema.id), e.shards)
        order = [(F.desc_nulls_last if down else F.asc_nulls_first)(c) for c, down in e.presort]
        place = F.row_number().over(Window.partitionBy("__shard").orderBy(*order, F.col(self.schema.id)))
        limit = F.lit(r.in_top)
        for s, n in by_shard.items():
            if n is not None:
                limit = F.when(F.col("__shard") == s, F.lit(n)).otherwise(limit)
        ranked = rows.withColumn("__shard", shard).withColumn("__place", place)
        return ranked.where(limit.isNull() | (F.col("__place") <= limit)).drop("__shard", "__place")

    @cached_property
    def drills(self) -> dict[str, Column]:
        return drill_predicates(self.request.drills)

    def _drilled(self, without: str | None = None) -> DataFrame:
        rows = self.base
        for name, p in self.drills.items():
            if name != without:
                rows = rows.where(p)
        return rows

    @cached_property
    def matched(self) -> DataFrame:
        return self._drilled()

    @cached_property
    def scorer(self) -> Scorer:
        query = self.request.query
        stats = self.engine.statistics
        if stats is None and query_terms(query):
            stats = collect_statistics(self.routed, query, self.engine.similarity)
        return Scorer(stats or Statistics(), self.engine.similarity, self.schema)

    def distance(self) -> Column:
        if self.request.distance is None:
            return F.lit(None).cast("double")
        return distance_km(*self.request.distance, F.col("longitude"), F.col("latitude"))

    @cached_property
    def scored(self) -> DataFrame:
        """Matched rows with __score, __distance and, if asked for, __explanation."""
        r = self.request
        query = r.query if r.boost == 1.0 else replace(r.query, boost=r.query.boost * r.boost)
        plain = isinstance(query, N.MatchAll)
        score = F.lit(1.0) if plain else self.scorer.score(query)
        rows = self.matched.withColumn("__distance", self.distance())
        told = None
        if r.explain:
            told = F.lit('{"value":1.0,"description":"constant(matchall)","details":[]}') if plain else self.scorer.explained(query)
        if r.model is not None:
            value, notes = run_model(r.model, self.schema, None, score, F.col("__distance"))
            score = value
            told = notes if notes is not None else told
        rows = rows.withColumn("__score", score.cast("double"))
        return rows.withColumn("__explanation", told) if r.explain else rows

    def order(self) -> list[Column]:
        out: list[Column] = []
        for s in self.request.sorts:
            if s.kind == "distance":
                out.append(F.col("__distance").asc_nulls_last())
            elif s.kind == "score":
                out.append(F.col("__score").desc() if s.descending else F.col("__score").asc())
            else:
                c = s.field.column
                if s.field.type not in ("string", "facet"):
                    c = F.coalesce(c, F.lit(0).cast(c_type(s.field)))
                    out.append(c.desc() if s.descending else c.asc())
                else:
                    out.append(c.desc_nulls_last() if s.descending else c.asc_nulls_first())
        return [*(out or [F.col("__score").desc()]), F.col(self.schema.id).asc()]

    def shape(self, rows: DataFrame, *more: Column) -> DataFrame:
        r, key = self.request, self.schema.id
        columns = [F.col(key).cast("string").alias("id"), F.col("__score").alias("score")]
        if r.source:
            columns.append(self.source().alias("source"))
        if r.distance is not None:
            columns.append(F.col("__distance").alias("distance"))
        if r.explain:
            columns.append(F.col("__explanation").alias("explanation"))
        if r.sorts:
            pairs = []
            for s in r.sorts:
                name = s.field.name if s.kind == "field" else s.kind
                pairs += [F.lit(name), s.field.column.cast("string") if s.kind == "field" else F.col(f"__{s.kind}").cast("string")]
            columns.append(F.create_map(*pairs).alias("fields"))
        if r.snippets:
            words = self._words()
            columns.append(F.create_map(*(x for f in r.snippets for x in (F.lit(f.name), snippet(f, words.get(f.name, []))))).alias("snippets"))
        return rows.select(*columns, *more)

    def _words(self) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for f, t in query_terms(N.Bool((self.request.query, *([self.request.filter] if self.request.filter is not None else [])))):
            out.setdefault(f.name, []).append(t)
        return out

    def source(self) -> Column:
        """The stored fields asked for, as JSON without missing ones; the id is always there."""
        key = self.schema.id
        fields = [self.schema.resolve(c) for c in self.request.columns] if self.request.columns else [f for f in self.schema.fields if f.stored]
        rows = [F.col(key).cast("string").alias(key)]
        rows += [f.column.alias(f.name) for f in fields if f.name != key]
        return F.to_json(F.struct(*rows))

    @cached_property
    def hits(self) -> DataFrame:
        """The page asked for, in order."""
        if self.request.group is not None:
            return self.groups
        page = self.scored.orderBy(*self.order())
        page = page.offset(self.request.offset) if self.request.offset else page
        return self.shape(page.limit(self.request.limit))

    def within(self, seconds: float) -> list[Row]:
        """The page's rows, unless it takes longer: then the search is cancelled and TimeoutError raised.

        A search of many tasks has no part of its page before it ends, so nothing is returned in part.
        """
        context, tag, late = self.engine.rows(self.request.indexes).sparkSession.sparkContext, f"search-{uuid.uuid4().hex}", threading.Event()

        def cancel() -> None:
            late.set()
            context.cancelJobsWithTag(tag)

        timer = threading.Timer(seconds, cancel)
        context.addJobTag(tag)
        timer.start()
        try:
            rows = self.hits.collect()  # one page
        except Exception as e:
            if late.is_set():
                raise TimeoutError(f"no page within {seconds} s") from e
            raise
        finally:
            timer.cancel()
            context.removeJobTag(tag)
        return rows

    @cached_property
    def groups(self) -> DataFrame:
        """Rows of the page's groups: group_value, group_rank (1..), hit_rank (1..) and the hit.

        The rank filter stands right on the window, so Spark cuts every task's groups before the shuffle.
        """
        r = self.request
        g = r.group.column
        kept = self.scored.withColumn("__group", g)
        order = self.order()
        n = F.row_number().over(Window.partitionBy("__group").orderBy(*order))
        best = kept.withColumn("__hit", n).where(F.col("__hit") <= r.group_top)
        first = best.where("__hit = 1").orderBy(*order).limit(r.offset + r.limit)
        ranked = first.withColumn("__rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order)))
        ranked = ranked.where(F.col("__rank") > r.offset).select(F.col("__group").alias("__g"), "__rank")
        joined = best.join(F.broadcast(ranked), F.col("__group").eqNullSafe(F.col("__g")))
        return self.shape(
            joined, F.col("__group").cast("string").alias("group_value"), F.col("__rank").cast("bigint").alias("group_rank"), F.col("__hit").cast("bigint").alias("hit_rank")
        )

    @cached_property
    def totals(self) -> DataFrame:
        """One row: total_hits, total_groups, total_group_hits."""
        r = self.request
        if r.group is None:
            return self.matched.agg(F.count("*").alias("total_hits"))
        per = self.matched.groupBy(r.group.column.alias("g")).agg(F.count("*").alias("n"))
        return per.agg(
            F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("total_hits"), F.count("*").alias("total_groups"),
            F.coalesce(F.sum(F.least("n", F.lit(r.group_top))), F.lit(0)).cast("bigint").alias("total_group_hits"),
        )

    def total_hits(self) -> int:
        return self.totals.first()["total_hits"]

    @cached_property
    def facets(self) -> DataFrame | None:
        """A row for each label of each facet; groups suppress facets."""
        r = self.request
        out = None
        for f in r.facets if r.group is None else ():
            rows = self._drilled(f.field.name if r.sideways else None)
            one = facet_counts(rows, f)
            out = one if out is None else out.unionByName(one)
        return out

    @cached_property
    def aggregations(self) -> DataFrame | None:
        out = None
        for f, buckets in self.request.aggregations:
            one = bucket_counts(self.matched, f, buckets)
            out = one if out is None else out.unionByName(one)
        return out


def c_type(f) -> str:
    return {"integer": "int", "long": "bigint", "double": "double", "float": "float"}[f.type]


def batch_search(rows: DataFrame, schema: Schema, field_name: str, queries: DataFrame, top: int = 10) -> DataFrame:
    """Many word queries in one job: ``queries(qid, text)`` -> (qid, id, score, rank), best first.

    Postings are joined to the queries' tokens and contributions summed, so the cost follows the
    postings of the words asked for, not queries times documents. Queries are a stated set; they are
    broadcast only if adaptive execution finds them small.
    """
    from .functions.analyzers import analyzer

    f = schema.resolve(field_name)
    cut = analyzer(f.analyzer)
    words = queries.select("qid", F.explode(F.array_distinct(cut.kept(F.col("text")))).alias("token"))
    docs = rows.select(F.col(schema.id).cast("string").alias("id"), cut.kept(f.column).alias("toks"))
    total = rows.count()
    postings = docs.select("id", F.size("toks").alias("n"), "toks").select("id", "n", F.explode("toks").alias("token")).join(
        words.select("token").distinct(), "token", "left_semi"
    ).groupBy("token", "id").agg(F.count("*").alias("tf"), F.first("n").alias("n"))
    df = postings.groupBy("token").agg(F.count("*").alias("df"))
    p = F.pow(F.lit(2.0), F.floor(-F.log2(F.col("n").cast("double")) / 2))
    norm = p * (1 + F.floor((1 / F.sqrt(F.col("n").cast("double")) / p - 1) * 4 + 1e-9) / 4)
    idf = 1 + F.log(F.lit(float(total)) / (F.col("df") + 1))
    weighted = postings.join(df, "token").select("token", "id", (F.sqrt("tf") * idf * idf * norm).alias("w"), (idf * idf).alias("sq"))
    scores = words.join(weighted, "token").groupBy("qid", "id").agg(F.sum("w").alias("w"))
    # a word that no document holds counts in its query's norm, too
    known = words.join(df, "token", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    norms = known.groupBy("qid").agg((1 / F.sqrt(F.sum(idf * idf))).alias("qn"))
    scored = scores.join(norms, "qid").select("qid", "id", (F.col("w") * F.col("qn")).alias("score"))
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc(F.round("score", 9)), "id"))
    return scored.withColumn("rank", place.cast("bigint")).where(F.col("rank") <= top)


__all__ = ["Engine", "NoSuchIndex", "Result", "batch_search", "index_table", "shard_of", "token_column"]
