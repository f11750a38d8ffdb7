"""Statements: what is read, what is dropped, what is refused."""

import pytest
from hypothesis import given
from hypothesis import strategies as st

from quillspark.functions.analyzers import analyzer, max_match
from quillspark.plans import nodes as N
from quillspark.plans.lexer import StatementError, signs_of
from quillspark.plans.parser import parse
from quillspark.plans.querystring import QueryStringError, parse_query_string
from quillspark.schema import Field, Schema

S = Schema("id", (Field("title", tokenized=True), Field("rank", "double"), Field("color", "facet"), Field("year", "integer")))


def test_clauses():
    r = parse("select title, rank from a, b by title = 'x' where rank > 1.5 order by rank asc, score limit 5, 20 browse by color(3, 'a/b') source explain false in top 9 route by 0 in top 5, (1, 2) in top 7, replica_key 'k';", S)
    assert r.indexes == ("a", "b") and r.columns == ("title", "rank") and (r.offset, r.limit) == (5, 20)
    assert r.sorts[0].descending is False and r.sorts[1].kind == "score" and r.source and not r.explain and r.in_top == 9
    assert r.route == N.Route(((0, 5), (1, 7), (2, 7)), "k") and r.facets[0].path == ("a", "b") and r.facets[0].top == 3


@pytest.mark.parametrize("text", [
    "select * limit 1 limit 2", "select * where", "select * where title >", "select * browse by title", "select * aggregate by title({1,2})",
    "select * where rank = 'abc'", "select * where year = 99999999999", "select * where rank like 'x'", "select * snippet rank",
    "select * where title = 'x' nonsense", "select * where distance(1) in 2", "select * using score model m(Boolean b = true) begin return 1; end",
    "select * where year not = 3", "update x", "select * where query is 'title:(a'", "select * where title ~ 'x'",
])
def test_refused_with_a_place(text):
    with pytest.raises(StatementError, match=r"^\[line:\d+, col:\d+\] "):
        parse(text, S)


def test_placeholders():
    assert parse("select * where title = $a and year = $b", S).filter is None
    assert parse("select * where title = $a and year = $b", S, {"b": 3}).filter == N.Range(S.static("year"), 3, 3)
    assert parse("select * limit $n", S).limit == 10 and parse("select * explain $e", S).explain is False


def test_boosts_and_coordination():
    q = parse("select * by title = 'a' subBoost by 2 or (title = 'b' and title = 'c' andDisableCoord andBoost by 3) orBoost by 5 boost by 7", S)
    assert q.boost == 7 and q.query.boost == 5 and q.query.should[0].boost == 2 and q.query.should[1].boost == 3 and q.query.should[1].disable_coord


def test_dis_max_takes_other_clauses_from_the_first():
    q = parse("select * by title = 'a' limit 3 | select * by title = 'b' where year = 1 boost by 2 limit 9", S)
    assert isinstance(q.query, N.DisMax) and q.limit == 3 and q.query.parts[1] == N.Filtered(N.Term(S.static("title"), "b"), N.Range(S.static("year"), 1, 1), 2.0)


def test_query_strings():
    f = S.static("title")
    assert parse_query_string("title:Hello", S) == N.Term(f, "hello")
    assert parse_query_string('title:"a hello world"~3', S) == N.Phrase(f, ((0, "hello"), (1, "world")), 3)
    assert parse_query_string("title:x^2.5", S).boost == 2.5 and isinstance(parse_query_string("title:ab~", S), N.Fuzzy)
    assert parse_query_string("+title:x -title:y title:z", S).must_not == (N.Term(f, "y"),)
    assert parse_query_string("color:[a TO b]", S) == N.MatchNone() and parse_query_string("nofield", S) == N.MatchNone()
    assert parse_query_string("rank:{1 TO 2]", S) == N.Range(S.static("rank"), 1.0, 2.0, False, True)
    with pytest.raises(QueryStringError):
        parse_query_string("title:(", S)


@given(st.text(max_size=30))
def test_quoted_text_survives(text):
    quoted = "'" + text.replace("'", "''") + "'"
    assert [s.text for s in signs_of(quoted)][0] == text


@given(st.text(max_size=60))
def test_any_text_is_read_or_refused(text):
    try:
        parse(text, S)
    except StatementError:
        pass


def test_analyzers_agree_with_their_columns(spark):
    from pyspark.sql import functions as F

    texts = ["The Quick-brown fox's 3.5 Wi-Fi PowerShot500", "中文 分词 test", "", "Étion ouè, a_b", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for name in ("standard", "standard_all", "simple", "whitespace", "word_delimiter", "word_delimiter_all"):
        a = analyzer(name)
        got = [r[0] for r in df.select(a.kept(F.col("t"))).collect()]
        assert got == [a.query(t) if t is not None else [] for t in texts], name
    assert analyzer("word_delimiter").query("PowerShot500 Wi-Fi the") == ["power", "shot", "500", "wi", "fi"]
    own = max_match({"中文", "分词"})
    assert own.query("中文分词ab 好") == ["中文", "分词", "ab", "好"]
    assert [r[0] for r in df.select(own.kept(F.col("t"))).collect()][1] == ["中文", "分词", "test"]
