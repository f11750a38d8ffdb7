"""The registered queries of the search engine, and the SQL that says the same."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine, batch_search, shard_of
from .functions.analyzers import STOPWORDS, analyzer
from .operators.scoring import Similarity
from .schema import DYNAMIC, Field, Schema, schema_of
from .sources.changes import apply_changes, update, upsert
from .sources.json_docs import dynamic_map, parse_documents, parse_requests
from .sources.modes import HotSwap, MultiTable, size_index, time_index
from .sources.postings import search_postings, write_postings
from .streaming.ingest import StreamTable

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


# --- collections ----------------------------------------------------------------------------


def _part(spark: SparkSession, d: str) -> Engine:
    df = spark.read.parquet(f"{d}/part.parquet").withColumns({
        "kind": F.concat_ws("/", "p_type", "p_brand"), "p_maybe": F.nullif("p_type", F.lit("PROMO")),
        "p_words": F.split("p_name", " "), "p_sizes": F.array(F.col("p_size"), F.col("p_size") + 1, F.col("p_size") + 2),
        "p_number": F.when(F.col("p_size") > 10, F.col("p_size")),
    })
    return Engine(schema_of(df, "p_partkey", ("p_name",), ("kind",)), df)


PART = """(SELECT *, p_type || '/' || p_brand AS kind, nullif(p_type, 'PROMO') AS p_maybe, string_split(p_name, ' ') AS p_words,
           CASE WHEN p_size > 10 THEN p_size END AS p_number FROM part)"""


def _orders(spark: SparkSession, d: str) -> Engine:
    df = spark.read.parquet(f"{d}/orders.parquet").withColumns({
        "day": F.date_format("o_orderdate", "yyyy/MM/dd"), "o_orderdate": F.date_format("o_orderdate", "yyyy-MM-dd"),
    })
    return Engine(schema_of(df, "o_orderkey", (), ("day",)), df, shards=4)


ORDERS = "(SELECT * REPLACE (strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate), strftime(o_orderdate, '%Y/%m/%d') AS day FROM orders)"


def _lineitem(spark: SparkSession, d: str) -> Engine:
    df = spark.read.parquet(f"{d}/lineitem.parquet").withColumns({
        "id": F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"), "shipdate": F.date_format("l_shipdate", "yyyy/MM/dd"),
    }).drop("l_shipdate")
    return Engine(schema_of(df, "id", (), ("shipdate",)), df)


LINEITEM = "(SELECT *, concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS id, strftime(l_shipdate, '%Y/%m/%d') AS shipdate FROM lineitem)"


def _documents(spark: SparkSession, d: str, similarity: Similarity | None = None) -> Engine:
    df = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    return Engine(schema_of(df, "doc_id", ("text", "source"), ("lang",)), df, similarity or Similarity())


def _supplier(spark: SparkSession, d: str) -> Engine:
    df = spark.read.parquet(f"{d}/supplier.parquet").withColumns({
        "longitude": 116.0 + (F.col("s_suppkey") * 37 % 1000) / 1000.0, "latitude": 39.5 + (F.col("s_suppkey") * 91 % 1000) / 1000.0,
    })
    return Engine(schema_of(df, "s_suppkey"), df)


SUPPLIER = "(SELECT *, 116.0::DOUBLE + (s_suppkey * 37 % 1000) / 1000.0::DOUBLE AS longitude, 39.5::DOUBLE + (s_suppkey * 91 % 1000) / 1000.0::DOUBLE AS latitude FROM supplier)"


def _customer(spark: SparkSession, d: str) -> Engine:
    df = spark.read.parquet(f"{d}/customer.parquet")
    return Engine(schema_of(df, "c_custkey", (), ("c_mktsegment",)), df)


# --- predicates: all rows that match ---------------------------------------------------------


def _filter(name: str, engine: Callable, statement: str, table: str, key: str, where: str, params: dict | None = None) -> None:
    def query(spark: SparkSession, d: str) -> DataFrame:
        return engine(spark, d).search(statement, params).matched.select(F.col(key).cast("string").alias("id"))

    QUERIES[name] = query
    SQL[name] = f"SELECT {key}::VARCHAR AS id FROM {table} WHERE {where}"


def _part_filter(name: str, where: str, sql: str, params: dict | None = None) -> None:
    _filter(name, _part, f"SELECT * FROM part {where}", PART, "p_partkey", sql, params)


def _order_filter(name: str, where: str, sql: str, params: dict | None = None) -> None:
    _filter(name, _orders, f"SELECT * FROM orders {where}", ORDERS, "o_orderkey", sql, params)


_part_filter("eq_string", "WHERE p_brand = 'Brand#4'", "p_brand = 'Brand#4'")
_part_filter("eq_numeric", "WHERE p_size = 11", "p_size = 11")
_part_filter("eq_token", "WHERE p_name = 'bolt'", "list_contains(p_words, 'bolt')")
_part_filter("neq_null", "WHERE p_maybe <> 'LARGE'", "NOT coalesce(p_maybe = 'LARGE', false)")
_part_filter("in_list", "WHERE p_brand IN ('Brand#1', 'Brand#2', 'Brand#3')", "p_brand IN ('Brand#1', 'Brand#2', 'Brand#3')")
_part_filter("not_in_null", "WHERE p_maybe NOT IN ('LARGE', 'SMALL')", "NOT coalesce(p_maybe IN ('LARGE', 'SMALL'), false)")
_part_filter("in_except", "WHERE p_words IN ('red', 'blue') EXCEPT ('bolt')", "(list_contains(p_words, 'red') OR list_contains(p_words, 'blue')) AND NOT list_contains(p_words, 'bolt')")
_part_filter("not_in_except", "WHERE p_words NOT IN ('red', 'blue') EXCEPT ('bolt')", "list_contains(p_words, 'bolt') AND NOT (list_contains(p_words, 'red') OR list_contains(p_words, 'blue'))")
_part_filter("in_empty_except", "WHERE p_size > 40 AND p_size IN () EXCEPT (45)", "p_size > 40 AND p_size <> 45")
_part_filter("range_num", "WHERE p_retailprice >= 950.5 AND p_size < 20", "p_retailprice >= 950.5 AND p_size < 20")
_part_filter("range_str", "WHERE p_type > 'MEDIUM'", "p_type > 'MEDIUM'")
_part_filter("between", "WHERE p_size BETWEEN 10 AND 20", "p_size BETWEEN 10 AND 20")
_part_filter("not_between_null", "WHERE p_number NOT BETWEEN 20 AND 30", "coalesce(p_number < 20 OR p_number > 30, false)")
_part_filter("like_star", "WHERE p_name LIKE 'b*'", "list_has_any(p_words, list_filter(p_words, lambda w: starts_with(w, 'b')))")
_part_filter("like_qmark", "WHERE p_name LIKE 'b?lt'", "len(list_filter(p_words, lambda w: regexp_full_match(w, 'b.lt'))) > 0")
_part_filter("like_untokenized", "WHERE p_brand LIKE 'Brand#1?'", "regexp_full_match(p_brand, 'Brand#1.')")
_part_filter("not_like_null", "WHERE p_maybe NOT LIKE 'S*'", "NOT coalesce(starts_with(p_maybe, 'S'), false)")
_part_filter("is_null", "WHERE p_maybe IS NULL", "p_maybe IS NULL")
_part_filter("is_not_null", "WHERE p_maybe IS NOT NULL", "p_maybe IS NOT NULL")
_part_filter("multi_value_eq", "WHERE p_words = 'ring'", "list_contains(p_words, 'ring')")
_part_filter("multi_value_range", "WHERE p_sizes > 50", "p_size + 2 > 50")
_part_filter("by_not_in", "BY p_size NOT IN (1, 2, 3)", "p_size NOT IN (1, 2, 3)")
_part_filter("boolean_literal", "WHERE p_maybe = TRUE OR p_size = 3", "p_maybe = 'true' OR p_size = 3")
_part_filter("match_all", "", "true")
_order_filter("and_or_nested", "WHERE o_orderstatus = 'F' AND (o_orderpriority = '1-URGENT' OR o_totalprice > 400000) AND o_custkey <> 5", "o_orderstatus = 'F' AND (o_orderpriority = '1-URGENT' OR o_totalprice > 400000) AND o_custkey <> 5")
_order_filter("must_or_filter", "WHERE MUST o_orderstatus = 'F' OR o_orderpriority = '1-URGENT' OR o_totalprice > 450000", "o_orderstatus = 'F' AND (o_orderpriority = '1-URGENT' OR o_totalprice > 450000)")
_order_filter("must_or_query", "BY MUST o_orderstatus = 'F' OR o_orderpriority = '1-URGENT'", "o_orderstatus = 'F'")
_order_filter("placeholder_pruned", "WHERE o_orderstatus = $status AND o_custkey = $nobody AND o_totalprice > $least", "o_orderstatus = 'O' AND o_totalprice > 250000", {"status": "O", "least": 250000})
_order_filter("comments_and_quotes", "-- a comment\nWHERE `o_orderpriority` = \"1-URGENT\" /* more */ AND o_orderstatus = 'P';", "o_orderpriority = '1-URGENT' AND o_orderstatus = 'P'")
_order_filter("drill_down", "DRILL DOWN day('1998/03')", "starts_with(day, '1998/03/')")
_part_filter("drill_down_same_dim", "DRILL DOWN kind('PROMO'), kind('SMALL/Brand#7')", "p_type = 'PROMO' OR kind = 'SMALL/Brand#7'")
_filter("range_lineitem", _lineitem, "SELECT * WHERE l_quantity >= 24 AND l_discount < 0.05 AND l_returnflag = 'R'", LINEITEM, "id", "l_quantity >= 24 AND l_discount < 0.05 AND l_returnflag = 'R'")
_filter("geo_radius", _supplier, "SELECT * WHERE DISTANCE(116.4, 39.95) IN 25", SUPPLIER, "s_suppkey", "2 * 6371.0087714 * asin(sqrt(sin(radians(latitude - 39.95) / 2) ** 2 + cos(radians(latitude)) * cos(radians(39.95)) * sin(radians(longitude - 116.4) / 2) ** 2)) <= 25")

# --- the query-string language: all documents that match -------------------------------------

TOKENS = "(SELECT *, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM documents)"


def _qs(name: str, text: str, where: str, more: str = "") -> None:
    _filter(name, _documents, f"SELECT * FROM documents BY QUERY IS '{text}' {more}", TOKENS, "doc_id", where)


def _has(w: str) -> str:
    return f"list_contains(t, '{w}')"


_qs("qs_term", "text:Idiot", _has("idiot"))
_qs("qs_or", "text:(scum trash)", f"{_has('scum')} OR {_has('trash')}")
_qs("qs_and", "text:scum AND text:clown", f"{_has('scum')} AND {_has('clown')}")
_qs("qs_op_and", "text:(scum clown)", f"{_has('scum')} AND {_has('clown')}", "OP(AND)")
_qs("qs_must_not", "text:licensed -text:gnu", f"{_has('licensed')} AND NOT {_has('gnu')}")
_qs("qs_plus", "+text:licensed text:gnu", _has("licensed"))
_qs("qs_not", "text:this AND NOT text:that", f"{_has('this')} AND NOT {_has('that')}")
_qs("qs_phrase", 'text:"is licensed under"', "len(list_filter(range(1, len(t) - 1), lambda i: t[i] = 'is' AND t[i + 1] = 'licensed' AND t[i + 2] = 'under')) > 0")
_qs("qs_slop", 'text:"licensed the"~1', "len(list_filter(range(1, len(t) + 1), lambda i: t[i] = 'licensed' AND (t[i + 1] = 'the' OR t[i + 2] = 'the' OR t[i] = 'the'))) > 0")
_qs("qs_range", "n_chars:[1000 TO 2000}", "n_chars >= 1000 AND n_chars < 2000")
_qs("qs_open_range", "n_chars:[5000 TO *] AND lang:de", "n_chars >= 5000 AND lang = 'de'")
_qs("qs_wildcard", "text:licen*", "len(list_filter(t, lambda w: starts_with(w, 'licen'))) > 0")
_qs("qs_prefix_qmark", "text:idi?t", "len(list_filter(t, lambda w: regexp_full_match(w, 'idi.t'))) > 0")
_qs("qs_fuzzy", "text:stupit~1", "len(list_filter(t, lambda w: levenshtein(w, 'stupit') <= 1)) > 0")
_qs("qs_regex", "text:/mor[aeo]n/", "len(list_filter(t, lambda w: regexp_full_match(w, 'mor[aeo]n'))) > 0")
_qs("qs_boost", "text:scum^2 OR text:(moron loser)^0.5", f"{_has('scum')} OR {_has('moron')} OR {_has('loser')}")
_qs("qs_all", "*:*", "true")

# --- scores: all documents that match, with their score --------------------------------------

NORM = "pow(2.0, floor(-log2(n) / 2)) * (1 + floor((1 / sqrt(n) / pow(2.0, floor(-log2(n) / 2)) - 1) * 4 + 1e-9) / 4)"


def _score_sql(words: list[str], norm: str, score: str, where: str) -> str:
    """f<i>: frequency, i<i>: idf, c<i>: frequency part of word i; q: query norm, nm: field norm."""
    each = range(len(words))
    return f"""
WITH d AS (SELECT doc_id, lang, n_chars, source, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM documents),
m AS (SELECT doc_id, lang, n_chars, source, greatest(len(t), 1)::DOUBLE AS n, {', '.join(f"len(list_filter(t, lambda x: x = '{w}'))::DOUBLE AS f{i}" for i, w in enumerate(words))} FROM d),
s AS (SELECT count(*)::DOUBLE AS docs, avg(n) AS mean, {', '.join(f'(count(*) FILTER (f{i} > 0))::DOUBLE AS d{i}' for i in each)} FROM m),
i AS (SELECT docs, mean, {', '.join(f'd{i}, 1 + ln(docs / (d{i} + 1)) AS i{i}' for i in each)} FROM s),
w AS (SELECT m.*, i.*, {NORM} AS nm, {norm} AS q FROM m, i),
c AS (SELECT *, {', '.join(f'sqrt(f{i}) * i{i} * i{i} * nm * q AS c{i}' for i in each)} FROM w)
SELECT doc_id::VARCHAR AS id, round({score}, 6) AS score FROM c WHERE {where}"""


def _scored(name: str, statement: str, sql: str, similarity: Similarity | None = None) -> None:
    def query(spark: SparkSession, d: str) -> DataFrame:
        found = _documents(spark, d, similarity).search(statement)
        return found.scored.select(F.col("doc_id").cast("string").alias("id"), F.round("__score", 6).alias("score"))

    QUERIES[name] = query
    SQL[name] = sql


_any2 = "f0 > 0 OR f1 > 0"
_sq = lambda *b: "1 / sqrt(" + " + ".join(f"pow(i{i} * {x}, 2)" for i, x in enumerate(b)) + ")"
_scored("score_tfidf", "SELECT * BY QUERY IS 'text:(idiot this)'", _score_sql(["idiot", "this"], _sq(1, 1), "c0 + c1", _any2))
_scored("score_single", "SELECT * BY text = 'licensed'", _score_sql(["licensed"], "1 / i0", "c0", "f0 > 0"))
_scored("score_coord", "SELECT * BY text = 'scum' OR text = 'this' OR text = 'licensed'", _score_sql(["scum", "this", "licensed"], _sq(1, 1, 1), "(c0 + c1 + c2) * ((f0 > 0)::INT + (f1 > 0)::INT + (f2 > 0)::INT) / 3.0", "f0 > 0 OR f1 > 0 OR f2 > 0"))
_scored("score_disable_coord", "SELECT * BY text = 'scum' OR text = 'this' orDisableCoord TRUE", _score_sql(["scum", "this"], _sq(1, 1), "c0 + c1", _any2))
_scored("score_boosts", "SELECT * BY text = 'scum' subBoost BY 0.8 AND text = 'this' subBoost BY 2 andBoost BY 3", _score_sql(["scum", "this"], "1 / sqrt(9 * (pow(i0 * 0.8, 2) + pow(i1 * 2, 2)))", "3 * (0.8 * c0 + 2 * c1)", "f0 > 0 AND f1 > 0"))
_scored("score_dismax", "SELECT * BY QUERY IS 'text:scum' | SELECT * BY QUERY IS 'text:this' BOOST BY 2", _score_sql(["scum", "this"], "1 / sqrt((pow(i0, 2) + pow(2 * i1, 2) - greatest(pow(i0, 2), pow(2 * i1, 2))) * 0.01 + greatest(pow(i0, 2), pow(2 * i1, 2)))", "greatest(c0, 2 * c1) + 0.1 * (c0 + 2 * c1 - greatest(c0, 2 * c1))", _any2))
_scored("score_constant", "SELECT * BY QUERY IS 'text:scum' OR n_chars > 5000", _score_sql(["scum"], "1 / sqrt(i0 * i0 + 1)", "(CASE WHEN f0 > 0 THEN c0 ELSE 0 END + CASE WHEN n_chars > 5000 THEN q ELSE 0 END) * ((f0 > 0)::INT + (n_chars > 5000)::INT) / 2.0", "f0 > 0 OR n_chars > 5000"))
_scored("score_filter_only", "SELECT * WHERE text = 'scum'", _score_sql(["scum"], "1", "1.0", "f0 > 0"))
_scored("score_dict_idf", "SELECT * BY QUERY IS 'text:(idiot this)'", _score_sql(["idiot", "this"], "1 / sqrt(4.0 * 4.0 + 1.5 * 1.5)", "sqrt(f0) * 16.0 * (0.5 + 0.5 * nm) * q + sqrt(f1) * 2.25 * (0.5 + 0.5 * nm) * q", _any2), Similarity(dictionary={"this": 1.5, "that": 4.0}, norm_floor=0.5))
_scored("score_bm25", "SELECT * BY QUERY IS 'text:(idiot this)'", _score_sql(["idiot", "this"], "1", " + ".join(f"ln(1 + (docs - d{i} + 0.5) / (d{i} + 0.5)) * 2.2 * f{i} / (f{i} + 1.2 * (0.25 + 0.75 * n / mean))" for i in (0, 1)), _any2), Similarity("bm25"))
_scored("score_phrase", "SELECT * BY QUERY IS 'text:\"the of\"'", """
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM documents),
m AS (SELECT doc_id, greatest(len(t), 1)::DOUBLE AS n, list_contains(t, 'the') AS a, list_contains(t, 'of') AS b,
             len(list_filter(range(1, len(t)), lambda i: t[i] = 'the' AND t[i + 1] = 'of'))::DOUBLE AS f FROM d),
s AS (SELECT 2 + ln(count(*)::DOUBLE / ((count(*) FILTER (a)) + 1)) + ln(count(*)::DOUBLE / ((count(*) FILTER (b)) + 1)) AS idf FROM m)
SELECT doc_id::VARCHAR AS id, round(sqrt(f) * idf * (""" + NORM + """), 6) AS score FROM m, s WHERE f > 0""")  # fmt: skip

# --- flexible queries and score models -------------------------------------------------------

SUM_CELLS = """float sum = 0f;
for (int i = 0; i < getFieldLength(); ++i) { for (int j = 0; j < getTermLength(); ++j) { if (isMatched(i, j)) { sum += getScore(i, j); } } }
return sum;"""
_flex = lambda head, body=SUM_CELLS: f"SELECT * BY FLEXIBLE_QUERY IS {head} USING MODEL m BEGIN {body} END"
_cell = "1 / sqrt(i0 * i0 + i1 * i1)"
_scored("flex_sum", _flex("'idiot this' IN (text)"), _score_sql(["idiot", "this"], _cell, "c0 + c1", _any2))
_scored("flex_field_boost", _flex("'idiot^3 this' IN (text^2)"), _score_sql(["idiot", "this"], "1 / sqrt(9 * i0 * i0 + i1 * i1)", "2 * (3 * c0 + c1)", _any2))
_scored("flex_full_match", _flex("'idiot this' FULL_MATCH IN (text)"), _score_sql(["idiot", "this"], _cell, "c0 + c1", "f0 > 0 AND f1 > 0"))
_scored("flex_match_ratio", _flex("'idiot this that licensed' MATCH 0.5 IN (text)"), _score_sql(["idiot", "this", "that", "licensed"], _sq(1, 1, 1, 1), "c0 + c1 + c2 + c3", "(f0 > 0)::INT + (f1 > 0)::INT + (f2 > 0)::INT + (f3 > 0)::INT >= 2"))
_scored("flex_positions", _flex("'the of' IN (text)", """
float s = 0f; int n = 0;
for (int p : positions(0, 0)) { for (int o : positions(0, 1)) { if (o == p + 1) { n += 1; } } }
return n;"""), """
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM documents)
SELECT doc_id::VARCHAR AS id, len(list_filter(range(1, len(t)), lambda i: t[i] = 'the' AND t[i + 1] = 'of'))::DOUBLE AS score
FROM d WHERE list_contains(t, 'the') OR list_contains(t, 'of')""")
_scored("flex_global_idf", _flex("'src1 this' GLOBAL_IDF OF (text, source) IN (source)"), """
WITH d AS (SELECT doc_id, source, list_contains(regexp_extract_all(lower(text), '[a-z0-9]+'), 'src1') AS ta, list_contains(regexp_extract_all(lower(text), '[a-z0-9]+'), 'this') AS tb FROM documents),
s AS (SELECT 1 + ln(count(*)::DOUBLE / (greatest(count(*) FILTER (ta), count(*) FILTER (source = 'src1')) + 1)) AS a,
             1 + ln(count(*)::DOUBLE / (greatest(count(*) FILTER (tb), count(*) FILTER (source = 'this')) + 1)) AS b FROM d)
SELECT doc_id::VARCHAR AS id, round(a * a / sqrt(a * a + b * b), 6) AS score FROM d, s WHERE source = 'src1'""")


def _model(name: str, engine: Callable, statement: str, table: str, key: str, score: str, where: str = "true") -> None:
    def query(spark: SparkSession, d: str) -> DataFrame:
        found = engine(spark, d).search(statement)
        return found.scored.select(F.col(key).cast("string").alias("id"), F.round("__score", 6).alias("score"))

    QUERIES[name] = query
    SQL[name] = f"SELECT {key}::VARCHAR AS id, round(({score})::DOUBLE, 6) AS score FROM {table} WHERE {where}"


_model("model_field_expr", _part, "SELECT * USING SCORE MODEL m BEGIN return p_retailprice() / p_size() + Math.sqrt(p_size()) * score(); END", PART, "p_partkey", "p_retailprice / p_size + sqrt(p_size)")
_model("model_params_map", _part, "SELECT * USING SCORE MODEL m(Map<String, Double> w = {'SMALL': 1.5, 'LARGE': 2.5}, Double d = 0.25, Long extra = [1, 2, 3]) BEGIN double s = d; if (w.containsKey(p_type())) { s += w.get(p_type()); } for (long x : extra) { s += x; } return s; END", PART, "p_partkey", "0.25 + CASE p_type WHEN 'SMALL' THEN 1.5 WHEN 'LARGE' THEN 2.5 ELSE 0 END + 6")
_model("model_if_return", _part, """SELECT * USING SCORE MODEL m(String q = "red bolt") BEGIN
  if (p_name().equalsIgnoreCase(q)) { return 100; } else if (p_size() > 40) { return p_size() / 3; }
  int k = p_size() % 7; switch (k) { case 0: return 1.5; case 1: k = 9; break; default: k = k * 2; } return p_maybe().length() + k; END""", PART, "p_partkey", "CASE WHEN p_name = 'red bolt' THEN 100 WHEN p_size > 40 THEN p_size // 3 WHEN p_size % 7 = 0 THEN 1.5 ELSE length(coalesce(p_maybe, '')) + CASE WHEN p_size % 7 = 1 THEN 9 ELSE p_size % 7 * 2 END END")
_model("model_loop_multi", _part, "SELECT * USING SCORE MODEL m BEGIN int s = 0; for (int x : p_sizes()) { if (x % 2 == 0) continue; s += x; } for (int i = 0; i < p_words().length; i++) { s += p_words()[i].length(); } return s; END", PART, "p_partkey", "CASE WHEN p_size % 2 = 1 THEN 2 * p_size + 2 ELSE p_size + 1 END + length(replace(p_name, ' ', ''))")
_model("model_distance", _supplier, "SELECT * WHERE DISTANCE(116.5, 40.0) IN 60 USING SCORE MODEL m BEGIN return 1 / (1 + distance()); END", f"(SELECT *, 2 * 6371.0087714 * asin(sqrt(sin(radians(latitude - 40.0) / 2) ** 2 + cos(radians(latitude)) * cos(radians(40.0)) * sin(radians(longitude - 116.5) / 2) ** 2)) AS km FROM {SUPPLIER})", "s_suppkey", "1 / (1 + km)", "km <= 60")
_model("model_over_score", _documents, "SELECT * BY text = 'licensed' USING SCORE MODEL m BEGIN return score() * n_chars(); END", f"(SELECT doc_id, n_chars, s.score AS s FROM documents JOIN ({_score_sql(['licensed'], '1 / i0', 'c0', 'f0 > 0').replace('round(c0, 6)', 'c0')}) s ON s.id = doc_id::VARCHAR)", "doc_id", "s * n_chars")

# --- order, pages, groups --------------------------------------------------------------------


def _page(name: str, engine: Callable, statement: str, sql: str, *columns: str) -> None:
    """A page of hits; its limit is the feature. The place on the page comes along."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        hits = engine(spark, d).search(statement).hits
        return hits.select("id", *[F.expr(c) for c in columns])

    QUERIES[name] = query
    SQL[name] = sql


_page("order_desc_default", _orders, "SELECT * ORDER BY o_totalprice LIMIT 20", f"SELECT o_orderkey::VARCHAR AS id, o_totalprice::DOUBLE AS price FROM {ORDERS} ORDER BY o_totalprice DESC, o_orderkey LIMIT 20", "cast(fields['o_totalprice'] as double) AS price")
_page("order_multi", _orders, "SELECT * WHERE o_custkey < 300 ORDER BY o_orderpriority ASC, o_orderdate DESC LIMIT 25", f"SELECT o_orderkey::VARCHAR AS id FROM {ORDERS} WHERE o_custkey < 300 ORDER BY o_orderpriority, o_orderdate DESC, o_orderkey LIMIT 25")
_page("limit_offset", _orders, "SELECT * ORDER BY o_totalprice ASC LIMIT 30, 15", f"SELECT o_orderkey::VARCHAR AS id FROM {ORDERS} ORDER BY o_totalprice, o_orderkey LIMIT 15 OFFSET 30")
_page("order_missing_first", _part, "SELECT * ORDER BY p_maybe ASC, p_size DESC LIMIT 40", f"SELECT p_partkey::VARCHAR AS id FROM {PART} ORDER BY p_maybe NULLS FIRST, p_size DESC, p_partkey LIMIT 40")
_page("order_score_tiebreak", _documents, "SELECT * BY QUERY IS 'text:(idiot scum)' LIMIT 12", _score_sql(["idiot", "scum"], _sq(1, 1), "c0 + c1", _any2).replace("round(c0 + c1, 6) AS score", "round(c0 + c1, 6) AS score") + " ORDER BY c0 + c1 DESC, doc_id LIMIT 12", "round(score, 6) AS score")
_page("geo_sort", _supplier, "SELECT * WHERE DISTANCE(116.5, 40.0) IN 80 ORDER BY distance LIMIT 10", f"SELECT id, round(km, 6) AS km FROM (SELECT s_suppkey::VARCHAR AS id, s_suppkey, 2 * 6371.0087714 * asin(sqrt(sin(radians(latitude - 40.0) / 2) ** 2 + cos(radians(latitude)) * cos(radians(40.0)) * sin(radians(longitude - 116.5) / 2) ** 2)) AS km FROM {SUPPLIER}) WHERE km <= 80 ORDER BY km, s_suppkey LIMIT 10", "round(distance, 6) AS km")


def _groups(name: str, engine: Callable, statement: str, table: str, key: str, g: str, order: str, top: int, pages: int) -> None:
    def query(spark: SparkSession, d: str) -> DataFrame:
        return engine(spark, d).search(statement).groups.select("id", "group_value", "group_rank", "hit_rank")

    QUERIES[name] = query
    SQL[name] = f"""
WITH r AS (SELECT {key}::VARCHAR AS id, {g} AS g, row_number() OVER (PARTITION BY {g} ORDER BY {order}) AS hit_rank,
                  row_number() OVER (ORDER BY {order}) AS place FROM {table}),
b AS (SELECT g AS bg, row_number() OVER (ORDER BY min(place)) AS group_rank FROM r GROUP BY g)
SELECT id, g::VARCHAR AS group_value, group_rank, hit_rank FROM r JOIN b ON g IS NOT DISTINCT FROM bg WHERE hit_rank <= {top} AND group_rank <= {pages}"""


_groups("group_top1", _customer, "SELECT * ORDER BY c_acctbal GROUP BY c_mktsegment", "customer", "c_custkey", "c_mktsegment", "c_acctbal DESC, c_custkey", 1, 10)
_groups("group_topn", _orders, "SELECT * ORDER BY o_totalprice GROUP BY o_custkey TOP 3 LIMIT 8", ORDERS, "o_orderkey", "o_custkey", "o_totalprice DESC, o_orderkey", 3, 8)
QUERIES["group_totals"] = lambda spark, d: _orders(spark, d).search("SELECT * WHERE o_totalprice > 100000 GROUP BY o_custkey TOP 2").totals
SQL["group_totals"] = "SELECT sum(n)::BIGINT AS total_hits, count(*) AS total_groups, sum(least(n, 2))::BIGINT AS total_group_hits FROM (SELECT o_custkey, count(*) AS n FROM orders WHERE o_totalprice > 100000 GROUP BY 1)"
QUERIES["total_hits"] = lambda spark, d: _orders(spark, d).search("SELECT * WHERE o_orderstatus = 'F'").totals
SQL["total_hits"] = "SELECT count(*) AS total_hits FROM orders WHERE o_orderstatus = 'F'"

# --- facets and buckets ----------------------------------------------------------------------


def _facet(name: str, engine: Callable, statement: str, sql: list[tuple[str, str, str, int, str, int]]) -> None:
    def query(spark: SparkSession, d: str) -> DataFrame:
        return engine(spark, d).search(statement).facets

    QUERIES[name] = query
    parts = []
    for table, dim, path, depth, where, top in sql:
        parts.append(f"""
(WITH c AS (SELECT split_part({dim}, '/', {depth + 1}) AS label, count(*) AS label_value FROM {table} WHERE {where} AND {dim} IS NOT NULL GROUP BY 1 HAVING label <> '')
SELECT '{dim}' AS dim, '{path}' AS path, (SELECT sum(label_value) FROM c)::BIGINT AS value, (SELECT count(*) FROM c) AS child_count,
       label, label_value, row_number() OVER (ORDER BY label_value DESC, label) AS rank FROM c QUALIFY rank <= {top})""")
    SQL[name] = " UNION ALL ".join(parts)


_facet("facet_root", _part, "SELECT * BROWSE BY kind", [(PART, "kind", "", 0, "true", 10)])
_facet("facet_path", _lineitem, "SELECT * BROWSE BY shipdate(12, '1999')", [(LINEITEM, "shipdate", "1999", 1, "starts_with(shipdate, '1999/')", 12)])
_facet("facet_topn", _part, "SELECT * WHERE p_size > 10 BROWSE BY kind(5, 'PROMO')", [(PART, "kind", "PROMO", 1, "p_size > 10 AND starts_with(kind, 'PROMO/')", 5)])
_facet("facet_two_dims", _orders, "SELECT * WHERE o_totalprice > 200000 BROWSE BY day(10), day(31, '1998/02')", [(ORDERS, "day", "", 0, "o_totalprice > 200000", 10), (ORDERS, "day", "1998/02", 2, "o_totalprice > 200000 AND starts_with(day, '1998/02/')", 31)])
_facet("drill_down_facets", _part, "SELECT * BROWSE BY kind(10) DRILL DOWN kind('SMALL')", [(PART, "kind", "", 0, "p_type = 'SMALL'", 10)])
_facet("drill_sideways", _part, "SELECT * BROWSE BY kind(10) DRILL SIDEWAYS kind('SMALL')", [(PART, "kind", "", 0, "true", 10)])

QUERIES["facet_leaf"] = lambda spark, d: _part(spark, d).search("SELECT * BROWSE BY kind(5, 'PROMO/Brand#1'), kind(5, 'NOSUCH')").facets
SQL["facet_leaf"] = " UNION ALL ".join(
    f"SELECT 'kind' AS dim, '{path}' AS path, 0::BIGINT AS value, 0::BIGINT AS child_count, NULL::VARCHAR AS label, NULL::BIGINT AS label_value, NULL::BIGINT AS rank"
    for path in ("PROMO/Brand#1", "NOSUCH")
)
_facet("drill_down_multi", _part, "SELECT * BROWSE BY kind(10) DRILL DOWN kind('SMALL'), kind('PROMO/Brand#1')", [(PART, "kind", "", 0, "(p_type = 'SMALL' OR kind = 'PROMO/Brand#1')", 10)])


def _words(spark: SparkSession, d: str) -> DataFrame:
    """Labels of a field with several values a row: a row counts once for each different one."""
    df = _part(spark, d).tables.withColumn("words", F.col("p_words"))
    return Engine(schema_of(df, "p_partkey", ("p_name",), ("words",)), df).search("SELECT * WHERE p_size > 20 BROWSE BY words(8)").facets


QUERIES["facet_multi_value"] = _words
SQL["facet_multi_value"] = f"""WITH c AS (SELECT label, count(*) AS label_value FROM (SELECT DISTINCT p_partkey, unnest(p_words) AS label FROM {PART} WHERE p_size > 20) GROUP BY 1)
SELECT 'words' AS dim, '' AS path, (SELECT sum(label_value) FROM (SELECT label_value FROM c ORDER BY label_value DESC, label LIMIT 8))::BIGINT AS value, (SELECT count(*) FROM c) AS child_count, label, label_value,
       row_number() OVER (ORDER BY label_value DESC, label) AS rank FROM c QUALIFY rank <= 8"""


def _buckets(name: str, engine: Callable, statement: str, field: str, table: str, rows: list[tuple[str, str]]) -> None:
    QUERIES[name] = lambda spark, d: engine(spark, d).search(statement).aggregations
    SQL[name] = " UNION ALL ".join(f"SELECT '{field}' AS field, {i} AS bucket_ord, '{label}' AS label, count(*) FILTER ({where}) AS value FROM {table}" for i, (label, where) in enumerate(rows))


_buckets("bucket_long", _part, "SELECT * AGGREGATE BY p_size({*, 10}, [10, 20}, [20, *})", "p_size", PART, [("{*,10}", "p_size < 10"), ("[10,20}", "p_size >= 10 AND p_size < 20"), ("[20,*}", "p_size >= 20")])
_buckets("bucket_double_overlap", _orders, "SELECT * AGGREGATE BY o_totalprice([1000, 200000}, {150000.5, 300000], [0, 500000])", "o_totalprice", ORDERS, [("[1000,200000}", "o_totalprice >= 1000 AND o_totalprice < 200000"), ("{150000.5,300000]", "o_totalprice > 150000.5 AND o_totalprice <= 300000"), ("[0,500000]", "o_totalprice BETWEEN 0 AND 500000")])
_buckets("bucket_open_ended", _part, "SELECT * WHERE p_type = 'LARGE' AGGREGATE BY p_number({*, *}, {*, 25]), p_size([30, *])", "p_number", f"(SELECT * FROM {PART} WHERE p_type = 'LARGE')", [("{*,*}", "p_number IS NOT NULL"), ("{*,25]", "p_number <= 25")])
SQL["bucket_open_ended"] += f" UNION ALL SELECT 'p_size', 0, '[30,*]', count(*) FILTER (p_size >= 30) FROM {PART} WHERE p_type = 'LARGE'"

# --- shards, snippets, sources ---------------------------------------------------------------

JAVA_HASH = "list_reduce(list_prepend(0::BIGINT, list_transform(string_split_regex(o_orderkey::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (h * 31 + c) % 4294967296)"
SHARDED = f"(SELECT *, (abs((CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END) % 4))::INT AS shard FROM (SELECT *, {JAVA_HASH} AS h FROM {ORDERS}))"
_filter("route_shards", _orders, "SELECT * WHERE o_orderstatus = 'F' ROUTE BY 0, 2", SHARDED, "o_orderkey", "o_orderstatus = 'F' AND shard IN (0, 2)")
_filter("in_top_shard", _orders, "SELECT * WHERE o_orderstatus = 'F' IN TOP 50", f"(SELECT *, row_number() OVER (PARTITION BY shard ORDER BY o_orderkey) AS k FROM {SHARDED} WHERE o_orderstatus = 'F')", "o_orderkey", "k <= 50")
_filter("route_in_top", _orders, "SELECT * WHERE o_orderstatus = 'F' ROUTE BY 1 IN TOP 20, 3", f"(SELECT *, row_number() OVER (PARTITION BY shard ORDER BY o_orderkey) AS k FROM {SHARDED} WHERE o_orderstatus = 'F')", "o_orderkey", "(shard = 1 AND k <= 20) OR shard = 3")


def _shard_hash(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").cast("string").alias("id"), shard_of(F.col("o_orderkey"), 4).alias("shard"))


QUERIES["shard_hash"] = _shard_hash
SQL["shard_hash"] = f"SELECT o_orderkey::VARCHAR AS id, shard FROM {SHARDED}"


def _snippet(spark: SparkSession, d: str) -> DataFrame:
    found = _documents(spark, d).search("SELECT * BY QUERY IS 'text:(licensed idiot)' SNIPPET text")
    return found.shape(found.scored).select("id", F.col("snippets")["text"].alias("snippet"))


QUERIES["snippet"] = _snippet
_mark = r"(?i)\b(licensed|idiot)\b"
SQL["snippet"] = rf"""
SELECT doc_id::VARCHAR AS id, rtrim(array_to_string(list_transform(held, lambda s: regexp_replace(s, '{_mark}', '<b>\1</b>', 'g')), ''), ' ') AS snippet
FROM (SELECT doc_id, list_slice(list_filter(regexp_extract_all(text, '[^.!?。！？]+[.!?。！？]*\s*'), lambda s: regexp_matches(s, '{_mark}')), 1, 10) AS held FROM documents
      WHERE list_has_any(regexp_extract_all(lower(text), '[a-z0-9]+'), ['licensed', 'idiot']))"""


def _source(spark: SparkSession, d: str) -> DataFrame:
    found = _part(spark, d).search("SELECT p_name, p_maybe, p_words WHERE p_size > 30 SOURCE")
    return found.shape(found.scored).select("id", F.get_json_object("source", "$.p_name").alias("name"), F.get_json_object("source", "$.p_maybe").alias("maybe"), F.get_json_object("source", "$.p_words[0]").alias("word"))


QUERIES["source_json"] = _source
SQL["source_json"] = f"SELECT p_partkey::VARCHAR AS id, p_name AS name, p_maybe AS maybe, p_words[1] AS word FROM {PART} WHERE p_size > 30"


def _explain(spark: SparkSession, d: str) -> DataFrame:
    found = _documents(spark, d).search("SELECT * BY QUERY IS 'text:(idiot this)' EXPLAIN")
    rows = found.scored.select(F.col("doc_id").cast("string").alias("id"), F.get_json_object("__explanation", "$.value").cast("double").alias("v"))
    return rows.select("id", F.round("v", 6).alias("score"))


QUERIES["explain"] = _explain
SQL["explain"] = SQL["score_tfidf"]


def _batch(spark: SparkSession, d: str) -> DataFrame:
    queries = spark.createDataFrame([(1, "idiot this"), (2, "licensed gnu"), (3, "moron")], "qid int, text string")
    engine = _documents(spark, d)
    return batch_search(engine.tables, engine.schema, "text", queries, 10).select("qid", "id", F.round("score", 6).alias("score"))


QUERIES["batch_queries"] = _batch
SQL["batch_queries"] = " UNION ALL ".join(
    f"(SELECT {qid} AS qid, id, score FROM ({sql} ORDER BY round({score}, 9) DESC, doc_id::VARCHAR LIMIT 10))"
    for qid, score, sql in (
        (1, "c0 + c1", SQL["score_tfidf"]), (2, "c0 + c1", _score_sql(["licensed", "gnu"], _sq(1, 1), "c0 + c1", _any2)),
        (3, "c0", _score_sql(["moron"], "1 / i0", "c0", "f0 > 0")),
    )
)

# --- changes, modes, dynamic fields ----------------------------------------------------------


def _events(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet")


def _split(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A table of the first halves' last rows, and the second halves' as changes."""
    rows = _events(spark, d).select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), "event_type", "value")
    empty = rows.where("false").drop("seq")
    return upsert(empty, rows.where("seq % 2 = 0"), "id", "seq"), rows.where("seq % 2 = 1")


LAST = "SELECT user_id AS id, event_type, value FROM events WHERE {} QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1"


def _upsert(spark: SparkSession, d: str) -> DataFrame:
    table, changes = _split(spark, d)
    return upsert(table, changes, "id", "seq")


def _update(spark: SparkSession, d: str) -> DataFrame:
    table, changes = _split(spark, d)
    part = changes.where("event_type = 'error'").select("id", "seq", "value", F.lit(None).cast("string").alias("event_type"))
    return update(table, part, "id", "seq")[0]


def _log(spark: SparkSession, d: str) -> DataFrame:
    table, changes = _split(spark, d)
    kinds = changes.withColumn("kind", F.when(F.col("event_type") == "error", "DELETE").otherwise("REPLACE"))
    return apply_changes(table, kinds, "id")


QUERIES |= {"upsert_latest": _upsert, "partial_update": _update, "change_log": _log}
SQL["upsert_latest"] = f"""WITH o AS ({LAST.format('event_id % 2 = 0')}), n AS ({LAST.format('event_id % 2 = 1')})
SELECT * FROM n UNION ALL SELECT * FROM o WHERE id NOT IN (SELECT id FROM n)"""
SQL["partial_update"] = f"""WITH o AS ({LAST.format('event_id % 2 = 0')}), n AS ({LAST.format("event_id % 2 = 1 AND event_type = 'error'")})
SELECT o.id, o.event_type, coalesce(n.value, o.value) AS value FROM o LEFT JOIN n ON o.id = n.id"""
SQL["change_log"] = f"""WITH o AS ({LAST.format('event_id % 2 = 0')}), n AS ({LAST.format('event_id % 2 = 1')})
SELECT * FROM n WHERE event_type <> 'error' UNION ALL SELECT * FROM o WHERE id NOT IN (SELECT id FROM n)"""

QUERIES["delete_by_query"] = lambda spark, d: _part(spark, d).delete("DELETE FROM part WHERE p_type = 'PROMO' OR p_name = 'bolt'").select(F.col("p_partkey").cast("string").alias("id"))
SQL["delete_by_query"] = f"SELECT p_partkey::VARCHAR AS id FROM {PART} WHERE NOT (p_type = 'PROMO' OR list_contains(p_words, 'bolt'))"


def _union(spark: SparkSession, d: str) -> DataFrame:
    rows = _part(spark, d)
    tables = {t.lower(): rows.tables.where(F.col("p_type") == t) for t in ("SMALL", "LARGE", "PROMO")}
    return Engine(rows.schema, tables).search("SELECT * FROM small, promo WHERE p_size < 25").matched.select(F.col("p_partkey").cast("string").alias("id"))


QUERIES["multi_index_union"] = _union
SQL["multi_index_union"] = "SELECT p_partkey::VARCHAR AS id FROM part WHERE p_type IN ('SMALL', 'PROMO') AND p_size < 25"
QUERIES["time_partition"] = lambda spark, d: _events(spark, d).groupBy(time_index(F.col("ts"), "DAY").alias("index_name")).agg(F.count("*").alias("docs"))
SQL["time_partition"] = "SELECT strftime(ts, '%Y-%m-%d') AS index_name, count(*) AS docs FROM events GROUP BY 1"
QUERIES["doc_num_partition"] = lambda spark, d: _events(spark, d).groupBy(size_index(F.col("event_id"), 3000).alias("index_name")).agg(F.count("*").alias("docs"))
SQL["doc_num_partition"] = "SELECT (event_id // 3000)::VARCHAR AS index_name, count(*) AS docs FROM events GROUP BY 1"


def _dynamic(spark: SparkSession, d: str) -> DataFrame:
    rows = _events(spark, d).select(
        F.col("event_id").cast("string").alias("id"),
        dynamic_map(F.to_json(F.struct(F.array(F.struct(F.get_json_object("props", "$.k").alias("k"), F.lit("int").alias("_type"))).alias("_dynamic")))).alias(DYNAMIC),
    )
    return Engine(Schema("id"), rows).search("SELECT * WHERE k.int >= 50 AND k.int <> 60 ORDER BY k.int").matched.select("id")


QUERIES["dynamic_field"] = _dynamic
SQL["dynamic_field"] = "SELECT event_id::VARCHAR AS id FROM events WHERE (props ->> '$.k')::INT >= 50 AND (props ->> '$.k')::INT <> 60"


def _envelopes(spark: SparkSession, d: str) -> DataFrame:
    part = spark.read.parquet(f"{d}/part.parquet")
    schema = schema_of(part, "p_partkey")
    doc = F.to_json(F.struct(*(F.col(c).cast("string").alias(c) if c == "p_partkey" else F.col(c) for c in part.columns)))
    raw = part.select(F.when(F.col("p_size") % 2 == 0, doc).otherwise(F.to_json(F.struct(F.lit("replace").alias("type"), doc.alias("content")))).alias("value"))
    requests = parse_requests(raw)
    docs = parse_documents(requests.select("kind", F.col("content").alias("value")), schema, keep=("kind",))
    return docs.select("kind", F.col("p_partkey").alias("id"), "p_name", "p_size", "p_retailprice")


QUERIES["json_envelopes"] = _envelopes
SQL["json_envelopes"] = "SELECT CASE WHEN p_size % 2 = 0 THEN 'INDEX' ELSE 'REPLACE' END AS kind, p_partkey::VARCHAR AS id, p_name, p_size, p_retailprice FROM part"


# --- filtered and flexible queries as filters, facets of the first rows, analyzers, tables by name ---

_scored("score_filtered", "SELECT * BY QUERY IS 'text:(idiot this)' WHERE n_chars > 2000", _score_sql(["idiot", "this"], _sq(1, 1), "c0 + c1", f"({_any2}) AND n_chars > 2000"))
_scored("flex_as_filter", "SELECT * WHERE FLEXIBLE_QUERY IS 'idiot this' FULL_MATCH IN (text) USING MODEL m BEGIN return 7f; END", _score_sql(["idiot", "this"], "1", "1.0", "f0 > 0 AND f1 > 0"))
_facet("facet_in_top", _orders, "SELECT * WHERE o_orderstatus = 'F' BROWSE BY day(10) IN TOP 50", [(f"(SELECT *, row_number() OVER (PARTITION BY shard ORDER BY o_orderkey) AS k FROM {SHARDED} WHERE o_orderstatus = 'F')", "day", "", 0, "k <= 50", 10)])


#: Signs of text that one task counts the words of; what it holds for that follows its share, not the table.
TASK_SIGNS = 8 << 20


def _counted(rows: DataFrame, kind: str) -> DataFrame:
    """(id, token, n): the tokens of ``rows`` (id, text) counted. Rows go by id to as many tasks as their
    signs fill, and are cut there: an id's tokens are in one task, so they are counted in one step."""
    signs = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(max(least, signs // TASK_SIGNS + 1), "id")
    return dealt.select("id", F.explode(analyzer(kind).kept(F.col("text"))).alias("token")).groupBy("id", "token").agg(F.count("*").alias("n"))


def _analyzed(name: str, table: str, key: str, column: str, kind: str, sql: str) -> None:
    """All tokens of a column, counted by text and token."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        return _counted(spark.read.parquet(f"{d}/{table}.parquet").select(F.col(key).cast("string").alias("id"), F.col(column).alias("text")), kind)

    QUERIES[name] = query
    SQL[name] = f"SELECT id, token, count(*) AS n FROM (SELECT {key}::VARCHAR AS id, unnest({sql}) AS token FROM {table}) GROUP BY ALL"


_stop = "[" + ", ".join(f"'{w}'" for w in STOPWORDS) + "]"
_analyzed("analyze_standard", "documents", "doc_id", "text", "standard", rf"list_filter(regexp_extract_all(lower(text), '[\pL\pN]+([''’._][\pL\pN]+)*'), lambda t: NOT list_contains({_stop}, t))")
_analyzed("analyze_whitespace", "part", "p_partkey", "p_name", "whitespace", "string_split(p_name, ' ')")


def _delimited(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat("p_brand", F.lit("-the_wifi"), "p_size", F.lit("Of"), F.initcap("p_type"), F.lit("HTTPServer"))
    return _counted(spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").cast("string").alias("id"), text.alias("text")), "word_delimiter")


QUERIES["analyze_word_delimiter"] = _delimited
SQL["analyze_word_delimiter"] = """SELECT id, token, count(*) AS n FROM (
  SELECT p_partkey::VARCHAR AS id, unnest([lower(string_split(p_brand, '#')[1]), string_split(p_brand, '#')[2], 'wifi', p_size::VARCHAR, lower(p_type), 'httpserver']) AS token FROM part) GROUP BY ALL"""


def _by_day(spark: SparkSession, d: str) -> DataFrame:
    """Events in a table for each day, the last three days live, the newest of them deleted by name."""
    rows = _events(spark, d).select(F.col("event_id").cast("string").alias("id"), "event_type", time_index(F.col("ts"), "DAY").alias("index"))
    tables = MultiTable("id", max_live=3)
    names = tables.add(rows)
    tables.delete_index(names[-1])
    return Engine(Schema("id", (Field("event_type"),)), tables.tables).search("SELECT * WHERE event_type <> 'error'").matched.select("id", "event_type")


QUERIES["multi_table"] = _by_day
SQL["multi_table"] = """WITH days AS (SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS day FROM events ORDER BY day DESC LIMIT 3)
SELECT event_id::VARCHAR AS id, event_type FROM events
WHERE strftime(ts, '%Y-%m-%d') IN (SELECT day FROM days) AND strftime(ts, '%Y-%m-%d') <> (SELECT max(day) FROM days) AND event_type IS DISTINCT FROM 'error'"""


def _swapped(spark: SparkSession, d: str) -> DataFrame:
    rows = _events(spark, d).select(F.col("event_id").cast("string").alias("id"), "event_type")
    table = HotSwap("live", rows.where("event_type = 'click'"))
    for k in (1, 2):
        table.index(f"next_{k}", rows.where(F.col("id").cast("long") % 3 == k))
    table.swap("next_2")
    table.index("live", rows.where(F.col("id").cast("long") % 3 == 0))
    return Engine(Schema("id", (Field("event_type"),)), table.live).search("SELECT * WHERE event_type <> 'view'").matched.select("id", "event_type")


QUERIES["hot_swap"] = _swapped
SQL["hot_swap"] = "SELECT event_id::VARCHAR AS id, event_type FROM events WHERE event_id % 3 IN (0, 2) AND event_type IS DISTINCT FROM 'view'"

# --- streams -----------------------------------------------------------------------------------

EVENTS = Schema("id", (Field("event_type"), Field("value", "double")))


def _requests(events: DataFrame) -> DataFrame:
    """Events as requests about their users: of seven, one deletes, two update and four index."""
    doc = F.to_json(F.struct(F.col("user_id").cast("string").alias("id"), "event_type", "value"))
    part = F.to_json(F.struct(F.col("user_id").cast("string").alias("id"), "value"))
    k = F.col("event_id") % 7
    value = (
        F.when(k == 0, F.to_json(F.struct(F.lit("delete").alias("type"), F.col("user_id").cast("string").alias("id"))))
        .when(k < 3, F.to_json(F.struct(F.lit("update").alias("type"), part.alias("content")))).otherwise(doc)
    )
    return events.where("user_id IS NOT NULL").select(value.alias("value"), F.col("event_id").alias("seq"))


def _folder(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared one; without one (local tests) a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or tempfile.mkdtemp()
    return f"{shared}/{name}-{uuid.uuid4().hex}"


def _postings(spark: SparkSession, d: str) -> DataFrame:
    """A table's postings written once, then two searches of them."""
    engine, folder = _documents(spark, d), _folder(spark, "postings")
    write_postings(engine.tables, engine.schema, folder)
    found = [search_postings(spark, folder, "text", words, engine.schema).withColumn("qid", F.lit(k)) for k, words in ((1, "idiot this"), (2, "licensed gnu"))]
    return found[0].union(found[1]).select("qid", "id", F.round("score", 6).alias("score"))


QUERIES["postings_search"] = _postings
SQL["postings_search"] = f"""SELECT 1 AS qid, * FROM ({SQL["score_tfidf"]})
UNION ALL SELECT 2 AS qid, * FROM ({_score_sql(["licensed", "gnu"], _sq(1, 1), "c0 + c1", _any2)})"""


def _stream(spark: SparkSession, d: str) -> DataFrame:
    folder = _folder(spark, "stream")
    table = StreamTable(spark, f"{folder}/table", EVENTS, compact=2)
    requests = _requests(spark.read.parquet(f"{d}/events.parquet"))
    low, high = requests.agg(F.min("seq"), F.max("seq")).first()
    thirds = [low + (high + 1 - low) * k // 3 for k in range(4)] if low is not None else []
    for a, b in zip(thirds, thirds[1:]):  # requests come in three times
        requests.where((F.col("seq") >= a) & (F.col("seq") < b)).write.mode("append").json(f"{folder}/in")
        stream = spark.readStream.schema("value string, seq long").json(f"{folder}/in")
        table.start(stream, f"{folder}/progress").awaitTermination()
    return table.read().select("id", "event_type", "value")


QUERIES["index_stream"] = _stream
SQL["index_stream"] = """WITH log AS (SELECT user_id::VARCHAR AS id, event_id AS seq, event_id % 7 AS k, event_type, value FROM events WHERE user_id IS NOT NULL),
base AS (SELECT id, max(seq) AS seq FROM log WHERE k NOT IN (1, 2) GROUP BY id),
put AS (SELECT log.* FROM log JOIN base USING (id, seq) WHERE k > 2),
upd AS (SELECT l.id, arg_max(l.value, l.seq) AS value FROM log l JOIN base b ON l.id = b.id AND l.seq > b.seq WHERE k IN (1, 2) AND l.value IS NOT NULL GROUP BY l.id)
SELECT put.id, event_type, coalesce(upd.value, put.value) AS value FROM put LEFT JOIN upd ON put.id = upd.id"""


def _pushed(spark: SparkSession, d: str) -> DataFrame:
    """Parts with some requests pushed to them: one replaced, one updated, one deleted, one new."""
    requests = ["""{"type": "replace", "content": {"p_partkey": "1", "p_name": "steel bolt", "p_size": 5}}""", """{"type": "update", "content": {"p_partkey": "2", "p_size": 49}}""",
                """{"type": "delete", "id": "3"}""", """{"p_partkey": "999999", "p_name": "tin bolt", "p_size": 7}"""]  # fmt: skip
    part = spark.read.parquet(f"{d}/part.parquet")
    engine, failed = Engine(schema_of(part, "p_partkey", ("p_name",)), part).index(requests)
    return engine.search("SELECT * WHERE p_name = 'bolt'").matched.select(F.col("p_partkey").cast("string").alias("id"), "p_name", "p_size", "p_type")


QUERIES["push_ingest"] = _pushed
SQL["push_ingest"] = """SELECT p_partkey::VARCHAR AS id, p_name, p_size, p_type FROM (
  SELECT p_partkey, p_name, CASE WHEN p_partkey = 2 THEN 49 ELSE p_size END AS p_size, p_type FROM part WHERE p_partkey NOT IN (1, 3)
  UNION ALL SELECT 1, 'steel bolt', 5, NULL UNION ALL SELECT 999999, 'tin bolt', 7, NULL) WHERE list_contains(string_split(p_name, ' '), 'bolt')"""


def _cached_value(spark: SparkSession, d: str) -> DataFrame:
    """A score model that reads a value worked out once for each row."""
    engine = _part(spark, d).with_value("value_per_size", lambda rows: F.col("p_retailprice") / F.col("p_size"), "double")
    found = engine.search("SELECT * WHERE p_size > 30 USING SCORE MODEL m BEGIN return 2 * value_per_size(); END")
    return found.scored.select(F.col("p_partkey").cast("string").alias("id"), F.round("__score", 6).alias("score"))


QUERIES["model_cached_value"] = _cached_value
SQL["model_cached_value"] = "SELECT p_partkey::VARCHAR AS id, round(2 * p_retailprice / p_size, 6) AS score FROM part WHERE p_size > 30"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One statement with a filter, an order and a page."""
    return _part(spark, sf_dir).search("SELECT p_name FROM part WHERE p_retailprice < 1000 AND p_brand = 'Brand#4' ORDER BY p_retailprice ASC LIMIT 0, 10 SOURCE").hits


__all__ = ["QUERIES", "SQL", "flagship"]
