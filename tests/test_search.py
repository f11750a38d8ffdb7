"""Expected values of small collections: predicates, missing values, scores, facets, buckets, groups.

The rows, statements and expected counts and scores in the tables of this file are fixed values that
results must equal.
"""

import json
import time

import pytest
from pyspark.sql import functions as F

from quillspark.engine import Engine, NoSuchIndex, Result
from quillspark.operators.scoremodel import ScoreCodeError, register_score_model
from quillspark.operators.scoring import Statistics
from quillspark.schema import Field, Schema, SchemaError, load_xml

CORE = Schema("id", (
    Field("title", tokenized=True), Field("field1", stored=False), Field("field2", tokenized=True, omit_norms=True, omit_freqs=True),
    Field("rank", "float"), Field("cat1", "integer"), Field("cat2", "double"), Field("tagstr", multi=True),
    Field("hotwords", indexed=False), Field("tagnum", "integer"),
))
CORE_TYPES = "id string, title string, field1 string, field2 string, rank float, cat1 int, cat2 double, tagstr array<string>, hotwords string, tagnum int, _dyn map<string,string>"


@pytest.fixture(scope="module")
def core(spark):
    rows = [
        ("1", "lucene 1", "aaa", "aaa aaa", 1.2, 1, 1.5, None, "hello", None, {}),
        ("2", "lucene 2", "bbb", None, 4.5, 2, 2.5, None, None, 100, {}),
        ("3", "lucene 3", "ccc", None, 4.5, 3, 3.5, ["ok"], None, None, {}),
        ("4", "lucene 4", "ddd", None, 10.3, 4, 4.5, None, None, None, {}),
        ("6", None, None, None, None, None, None, ["MI4", "MI Note", "Note3"], None, None, {}),
        ("7", None, None, None, None, None, None, ["MI4C", "MI Note Pro"], None, None, {}),
    ]
    return Engine(CORE, spark.createDataFrame(rows, CORE_TYPES).cache())


@pytest.mark.parametrize(("where", "count"), [
    ("WHERE cat1 IS NULL", 2), ("WHERE title IS NOT NULL", 4), ("WHERE tagstr IS NULL", 3), ("WHERE hotwords IS NOT NULL", 0),
    ("WHERE unknown IS NULL", 6), ("WHERE cat1 IN (1, 3) EXCEPT (3)", 1), ("WHERE cat2 > 1.5 AND cat2 IN () EXCEPT (3.5)", 2),
    ("WHERE field1 <> 'aaa'", 5), ("BY field1 <> 'aaa'", 5), ("WHERE cat1 BETWEEN 1 AND 3", 3), ("BY field1 NOT LIKE 'aaa*'", 5),
    ("WHERE tagstr = 'MI Note'", 1), ("WHERE title = 'lucene'", 4), ("WHERE cat1 NOT BETWEEN 2 AND 3", 2),
    ("WHERE NOT_THERE = 'x'", 0), ("BY QUERY IS 'title:(lucene 2)' OP(AND)", 1), ("BY QUERY IS 'rank:[4.5 TO *]'", 3),
    ("BY QUERY IS '*:*'", 6), ("BY QUERY IS 'bare'", 0), ("WHERE rank > -1.5", 4), ("WHERE tagstr LIKE 'MI*'", 2),
    ("BY QUERY IS 'title:\"lucene 3\"'", 1), ("WHERE id NOT IN (1, 2)", 4), ("WHERE cat1 = $x", 6), ("WHERE cat1 = $x OR cat1 = 2", 1),
])
def test_counts(core, where, count):
    assert core.search(f"SELECT * FROM default {where}").total_hits() == count


def test_exclusions_alone_match_nothing_in_a_strict_query(core):
    strict = Engine(CORE, core.tables, strict=True)
    assert strict.search("SELECT * BY id NOT IN (1, 2)").total_hits() == 0
    assert strict.search("SELECT * WHERE id NOT IN (1, 2)").total_hits() == 4


def test_score_with_statistics_that_count_a_deleted_row(core):
    stats = Statistics(7, {("title", "lucene"): 5, ("title", "2"): 1})
    found = Engine(CORE, core.tables, statistics=stats).search(
        "SELECT * BY QUERY IS 'title:(lucene 2)' WHERE id = 2 USING SCORE MODEL m BEGIN return 100 * score(); END"
    )
    assert found.hits.first()["score"] == pytest.approx(158.20, abs=0.01)


def test_delete(core):
    assert core.delete("DELETE FROM default WHERE cat1 > 2").count() == 4
    assert core.delete("DELETE FROM default").count() == 0


def test_source_explain_snippet_and_sort_values(core):
    row = core.search("SELECT title, cat1 BY QUERY IS 'title:2' ORDER BY rank SOURCE EXPLAIN SNIPPET title").hits.first()
    assert json.loads(row["source"]) == {"id": "2", "title": "lucene 2", "cat1": 2}
    assert json.loads(row["explanation"])["value"] == pytest.approx(row["score"])
    assert row["snippets"] == {"title": "lucene <b>2</b>"} and row["fields"] == {"rank": "4.5"}


FLEX = [("0", "hello world", "hello lucene"), ("1", "hello lucene hello world", "hello world"), ("2", "world hello", "lucene"), ("3", "hello world lucene hello", "world")]


@pytest.fixture(scope="module")
def flex(spark):
    schema = Schema("id", (Field("text", tokenized=True), Field("title", tokenized=True)))
    return Engine(schema, spark.createDataFrame(FLEX, "id string, text string, title string").cache())


def scores(found: Result) -> dict:
    return {r["id"]: r["score"] for r in found.hits.collect()}


def test_golden_scores(flex):
    assert scores(flex.search("SELECT * BY QUERY IS 'text:(hello world)'")) == pytest.approx({"0": 0.68665057, "2": 0.68665057, "1": 0.66308844, "3": 0.66308844})
    assert scores(flex.search("SELECT * BY QUERY IS 'text:(hello world lucene)'")) == pytest.approx({"1": 0.92017776, "3": 0.92017776, "0": 0.44567561, "2": 0.44567561})


def test_flexible_query_bonus_for_neighbours(flex):
    code = """
      double sum = 0; int last = -2;
      for (int i = 0; i < getFieldLength(); ++i) {
        for (int j = 0; j < getTermLength(); ++j) {
          if (!isMatched(i, j)) continue;
          sum += getScore(i, j);
          if (j > 0 && isMatched(i, j - 1) && position(i, j) == position(i, j - 1) + 1) { sum += 0.5; }
        }
      }
      return sum;"""
    plain = scores(flex.search("SELECT * BY QUERY IS 'text:(hello world)'"))
    got = scores(flex.search(f"SELECT * BY FLEXIBLE_QUERY IS 'hello world' IN (text) USING MODEL m BEGIN {code} END"))
    assert got["0"] == pytest.approx(plain["0"] + 0.5) and got["2"] == pytest.approx(plain["2"])


def test_full_match_and_match_ratio(flex):
    head = "SELECT * BY FLEXIBLE_QUERY IS 'hello lucene' {} IN (title) USING MODEL m BEGIN return getTotalMatchedTerms(); END"
    assert scores(flex.search(head.format("FULL_MATCH"))) == {"0": 2.0}
    assert scores(flex.search(head.format("MATCH 0.5"))) == {"0": 2.0, "1": 1.0, "2": 1.0}


def test_global_idf(spark):
    rows = [(str(i), "lucene x", "lucene" if i < 2 else "y", "lucene" if i < 3 else "z") for i in range(5)]
    schema = Schema("id", tuple(Field(n, tokenized=True, omit_norms=True) for n in ("title", "field1", "field2")))
    e = Engine(schema, spark.createDataFrame(rows, "id string, title string, field1 string, field2 string"))
    one = "SELECT * BY FLEXIBLE_QUERY IS 'lucene' {} IN ({}) USING MODEL m BEGIN return getRawScore(0, 0); END"
    for more, field, raw in (("", "title", 0.82), ("", "field2", 1.22), ("", "field1", 1.51), ("GLOBAL_IDF OF (title, field1)", "field1", 0.82)):
        best = max(scores(e.search(one.format(more, field))).values())
        assert round(best, 2) == pytest.approx(raw, abs=0.011)


FACETS = [
    ("1", "cn", "Bob book 1", "Bob", "2010/10/15"), ("2", "cn", "Lisa book 1", "Lisa", "2010/10/20"), ("3", "en", "Lisa book 2", "Lisa", "2012/1/1"),
    ("4", "en", "Susan book 1", "Susan", "2012/1/7"), ("5", "en", "Frank book 1", "Frank", "1999/5/5"), ("6", "cn", "Bob book 2", "Bob", "2010/10/25"),
    ("7", "cn", "Lisa book 3", "Lisa", "2010/11/20"), ("8", "en", "Lisa book 4", "Lisa", "2012/2/1"), ("9", "en", "Susan book 2", "Susan", "2013/1/7"),
    ("10", "en", "Susan book 3", "Susan", "1999/5/15"), ("11", "en", "Anonymous book", None, "1999/2/1"), ("12", "en", "No PubDate book", "Susan", None),
    ("13", "cn", "Book without any info", None, None),
]


@pytest.fixture(scope="module")
def books(spark):
    schema = Schema("id", (Field("Language"), Field("Title", tokenized=True), Field("Author", "facet"), Field("PublishDate", "facet")))
    return Engine(schema, spark.createDataFrame(FACETS, "id string, Language string, Title string, Author string, PublishDate string").cache())


def labels(found: Result, dim: str) -> dict:
    return {r["label"]: r["label_value"] for r in found.facets.where(F.col("dim") == dim).orderBy("rank").collect()}


def test_facets(books):
    found = books.search("SELECT * BROWSE BY Author, PublishDate")
    assert list(labels(found, "Author").items()) == [("Lisa", 4), ("Susan", 4), ("Bob", 2), ("Frank", 1)]
    assert labels(found, "PublishDate") == {"2010": 4, "2012": 3, "1999": 3, "2013": 1}
    row = found.facets.where("dim = 'Author'").first()
    assert (row["value"], row["child_count"]) == (11, 4)
    assert labels(books.search("SELECT * BROWSE BY PublishDate(10, '2010')"), "PublishDate") == {"10": 3, "11": 1}
    leaf = books.search("SELECT * BROWSE BY PublishDate(10, '2010/10/15')").facets.collect()
    assert [(r["value"], r["child_count"], r["label"]) for r in leaf] == [(0, 0, None)]


def test_drill_down_and_sideways(books):
    down = books.search("SELECT * BROWSE BY Author, PublishDate DRILL DOWN PublishDate('2010')")
    assert down.total_hits() == 4 and labels(down, "Author") == {"Bob": 2, "Lisa": 2} and labels(down, "PublishDate") == {"2010": 4}
    side = books.search("SELECT * BROWSE BY Author, PublishDate DRILL SIDEWAYS PublishDate('2010')")
    assert side.total_hits() == 4 and labels(side, "PublishDate") == {"2010": 4, "2012": 3, "1999": 3, "2013": 1}
    assert labels(side, "Author") == {"Bob": 2, "Lisa": 2}
    assert books.search("SELECT * WHERE PublishDate.FACET NOT LIKE '2012*'").total_hits() == 10


def test_buckets_over_static_and_dynamic_fields(spark):
    values = [(1, 0, 1.0), (2, 1, 2.1), (3, -1, 3.4), (4, 11, 11.0), (5, -11, 21.01), (6, 4, 13.5), (7, 5, 23.0), (8, 6, 112.0), (9, 123, -1.0), (10, 456, -31.0), (11, -12, -21.8), (12, 342, -3.14), (13, 122, 5.12), (14, 1213, 9.2), (15, -133, 11.25)]
    rows = [(str(i), v, {"dValue": str(d)}) for i, v, d in values]
    e = Engine(Schema("id", (Field("intValue", "integer", doc_values=True),)), spark.createDataFrame(rows, "id string, intValue int, _dyn map<string,string>"))
    found = e.search("SELECT * AGGREGATE BY intValue({*,*}, {*,-200], {-200,0}, [0,10}), dValue.double({*,-5.0}, [-21.79,-0.9}, [-21.80,-0.9}, {1000,*], {0,11.0])")
    assert [r["value"] for r in found.aggregations.orderBy("field", "bucket_ord").collect()] == [2, 2, 3, 0, 6, 15, 0, 4, 5]


def test_groups(spark):
    rows = [("1", "lucene 1", "aaa", 1.2, "1"), ("2", "lucene 2", "bbb", 4.5, "2"), ("3", "lucene 3", "ccc", 4.0, "1"), ("4", "lucene 4", "ddd", 10.3, "2"), ("5", "lucene 5", "ddd", 10.0, "3")]
    schema = Schema("id", (Field("title", tokenized=True), Field("field1"), Field("rank", "double"), Field("cat1")))
    found = Engine(schema, spark.createDataFrame(rows, "id string, title string, field1 string, rank double, cat1 string")).search("SELECT * ORDER BY rank GROUP BY cat1 TOP 3")
    got = [(r["group_rank"], r["id"]) for r in found.groups.orderBy("group_rank", "hit_rank").collect()]
    assert got == [(1, "4"), (1, "2"), (2, "5"), (3, "3"), (3, "1")]
    assert found.totals.first().asDict() == {"total_hits": 5, "total_groups": 3, "total_group_hits": 5}


def test_multi_valued_accessors_and_unsupported_code(spark):
    rows = [(f"doc_{i}", [i, i + 1, i + 2], [str(i), str(i + 1), str(i + 2)]) for i in range(10)]
    schema = Schema("id", (Field("ids_int", "integer", multi=True), Field("ids_str", multi=True)))
    e = Engine(schema, spark.createDataFrame(rows, "id string, ids_int array<int>, ids_str array<string>"))
    both = "int s = 0; for (int x : ids_int()) { s += x; } for (String t : ids_str()) { s += Integer.valueOf(t); } return s;"
    got = scores(e.search(f"SELECT * USING SCORE MODEL m BEGIN {both} END LIMIT 10"))
    assert got == {f"doc_{i}": float(2 * (3 * i + 3)) for i in range(10)}
    for bad in ("return System.exit(1);", "while (true) { int x = 1; }", "return nothing();", "return 1 +;", "int x = 1;"):
        with pytest.raises(ScoreCodeError):
            e.search(f"SELECT * USING SCORE MODEL m BEGIN {bad} END").hits.collect()
    register_score_model("sizes", lambda c: F.size("ids_int") * F.lit(float(c["params"]["k"])))
    assert set(scores(e.search("SELECT * USING SCORE MODEL PLUGIN sizes(Double k = 2)")).values()) == {6.0}


def test_indexes_by_name(books):
    both = Engine(books.schema, {"a": books.tables.where("Language = 'cn'"), "b": books.tables.where("Language = 'en'")})
    assert both.search("SELECT * FROM a").total_hits() == 5
    assert both.search("SELECT * FROM a, b").total_hits() == 13
    with pytest.raises(NoSuchIndex):
        both.search("SELECT * FROM nowhere").total_hits()


def test_schema_rules():
    s = load_xml("<schema><table><id>aid</id><column name='t' type='Text' index='yes' store='yes' tokenize='yes' snippet='yes'/><column name='n' type='INT' index='yes'/><column name='f' type='facet' omitfreqs='yes'/></table></schema>")
    assert s.id == "aid" and s.resolve("t").tokenized and s.resolve("n").type == "integer" and not s.resolve("n").stored
    assert s.resolve("x.y.LONG").type == "long" and s.resolve("x.y.LONG").name == "x.y" and s.resolve("t.string") is s.static("t")
    with pytest.raises(SchemaError):
        Field("x", doc_values=True, multi=True)
    with pytest.raises(SchemaError):
        load_xml("<table><id>a</id><column name='x' index='maybe'/></table>")


def test_a_search_that_takes_too_long_is_cancelled(spark, core):
    e = Engine(CORE, core.tables)
    assert len(e.search("SELECT * WHERE cat1 > 1").within(60)) == 3
    slow = spark.range(1, 200_000_000, 1, 4).select(F.col("id").cast("string").alias("id"), F.sha2(F.sha2(F.col("id").cast("string"), 512), 512).alias("title"))
    with pytest.raises(TimeoutError):
        Engine(Schema("id", (Field("title"),)), slow).search("SELECT * WHERE title LIKE 'ffff*' ORDER BY title").within(1.5)
    assert len(e.search("SELECT * WHERE cat1 > 1").within(60)) == 3


def test_results_are_kept_for_a_while(core):
    e = Engine(CORE, core.tables, cache_size=2, cache_seconds=0.2)
    one = e.search("SELECT * WHERE cat1 = 1")
    assert e.search("SELECT * WHERE cat1 = 1") is one
    time.sleep(0.3)
    assert e.search("SELECT * WHERE cat1 = 1") is not one


def test_plugins_by_module_and_override(core, tmp_path, monkeypatch):
    monkeypatch.syspath_prepend(str(tmp_path))
    source = tmp_path / "own_models.py"
    source.write_text("from pyspark.sql import functions as F\ndef sized(context):\n    return F.lit(3.0)\n")
    e = Engine(CORE, core.tables)
    say = lambda how: {r["score"] for r in e.search(f"SELECT * USING SCORE MODEL {how} own_models.sized").hits.collect()}
    assert say("PLUGIN") == {3.0}
    source.write_text("from pyspark.sql import functions as F\ndef sized(context):\n    return F.lit(44.0)\n")
    assert say("PLUGIN") == {3.0} and say("PLUGIN OVERRIDE") == {44.0} == say("PLUGIN")
    with pytest.raises(ScoreCodeError):
        e.search("SELECT * USING SCORE MODEL PLUGIN OVERRIDE own_models.nothing").hits.collect()


def test_pushed_requests_and_values_worked_out_once(core):
    e, failed = Engine(CORE, core.tables).index(['{"id": "9", "title": "lucene 9", "cat1": 3}', '{"type": "update", "content": {"id": "1", "cat1": 8}}', '{"type": "delete", "id": "2"}', '{"type": "update", "content": {"id": "77", "cat1": 8}}'])
    assert {r["id"]: r["cat1"] for r in e.search("SELECT * WHERE cat1 > 2").matched.collect()} == {"1": 8, "3": 3, "4": 4, "9": 3}
    assert [r["id"] for r in failed.collect()] == ["77"]
    e = e.with_value("double_cat", lambda rows: rows["cat1"] * 2, "integer")
    got = e.search("SELECT * WHERE double_cat > 7 USING SCORE MODEL m BEGIN return double_cat() + 0.5; END").hits.collect()
    assert {r["id"]: r["score"] for r in got} == {"1": 16.5, "4": 8.5}


def test_postings_cut_a_text_once(spark, tmp_path):
    from quillspark.functions.analyzers import Analyzer, register
    from quillspark.sources.postings import search_postings, write_postings

    cuts = spark.sparkContext.accumulator(0)

    def cut(text):
        cuts.add(1)
        return text.split()

    register("counted", Analyzer(F.udf(cut, "array<string>"), str.split))
    schema = Schema("id", (Field("text", tokenized=True, analyzer="counted"),))
    rows = spark.createDataFrame([("1", "a b " * 200), ("2", "b c " * 300)], "id string, text string")
    write_postings(rows, schema, str(tmp_path / "p"), buckets=2)
    assert cuts.value <= 2 * 2  # of 1,000 words
    assert {r["id"] for r in search_postings(spark, str(tmp_path / "p"), "text", "a c", schema).collect()} == {"1", "2"}


TEXTS = Schema("id", (Field("text", tokenized=True, analyzer="simple"),))


def _long(spark, n):
    return Engine(TEXTS, spark.createDataFrame([("1", "the of " * n), ("2", "of the")], "id string, text string"))


def test_phrase_in_a_long_text(spark):
    _long(spark, 10).search("SELECT * BY QUERY IS 'text:\"the of\"'").scored.collect()
    began = time.monotonic()
    assert [r["id"] for r in _long(spark, 12_000).search("SELECT * BY QUERY IS 'text:\"the of\"'").scored.collect()] == ["1"]
    assert time.monotonic() - began < 15  # minutes, if the text is cut into words for each of its places


@pytest.mark.parametrize("slop", [0, 1, 2, 5, 16, 17, 40])
@pytest.mark.parametrize("phrase", ["a b", "a a", "b a c", "a x"])
def test_phrase_against_brute_force(spark, slop, phrase):
    import random

    from quillspark.operators.match import phrase_count, with_tokens
    from quillspark.plans import nodes as N

    draw = random.Random(7)
    texts = [" ".join(draw.choice("abcdefghi") for _ in range(draw.randrange(60))) for _ in range(40)]
    f, terms = TEXTS.fields[0], tuple(enumerate(phrase.split()))

    def want(t):
        total = 0.0
        for i in [i for i, w in enumerate(t) if w == terms[0][1]]:
            off = [min((abs(j - i - p) for j, w in enumerate(t) if w == token), default=10**6) for p, token in terms[1:]]
            total += 1.0 / (sum(off) + 1.0) if sum(off) <= slop else 0.0
        return total

    rows = with_tokens(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), {"text": f})
    got = {r["id"]: r["n"] for r in rows.select("id", phrase_count(N.Phrase(f, terms, slop)).alias("n")).collect()}
    assert got == pytest.approx({i: want(t.split()) for i, t in enumerate(texts)})


LOOPS = """SELECT * BY FLEXIBLE_QUERY IS 'the of' IN (text) USING MODEL m BEGIN
float s = 0f; int n = 0; int k = positions(0, 1)[0];
for (int p : positions(0, 0)) { for (int o : positions(0, 1)) { if (o == p + 1) { n += k; if (isMatched(0, 1)) { s += freq(0, 1); } } } }
return n + s; END"""


def test_loops_work_out_a_row_s_values_once(spark):
    """What the rounds of a loop read of the row, other than the loop's own variables, isn't in the lambda of a round."""
    _long(spark, 10).search(LOOPS).scored.collect()
    began = time.monotonic()
    rows = spark.createDataFrame([("1", "the of " + "x " * 30_000 + "the " * 1_000)], "id string, text string")
    assert [(r["id"], r["__score"]) for r in Engine(TEXTS, rows).search(LOOPS).scored.collect()] == [("1", 2.0)]
    assert {r["id"]: r["__score"] for r in _long(spark, 30).search(LOOPS).scored.collect()} == {"1": 30 * 1 + 30 * 30.0, "2": 0.0}
    assert time.monotonic() - began < 15
