"""Documents and changes: JSON, dynamic fields, upserts, partial updates, modes, streams."""

import json

import pytest
from pyspark.sql import functions as F

from quillspark.engine import Engine, shard_of
from quillspark.schema import Field, Schema
from quillspark.sources.changes import apply_changes, resolve_requests, update, upsert
from quillspark.sources.json_docs import parse_documents, parse_requests, read_json_lines
from quillspark.sources.modes import HotSwap, MultiTable, batch_build
from quillspark.streaming.ingest import StreamTable, StreamTables

S = Schema("id", (Field("title", tokenized=True), Field("rank", "double"), Field("tags", multi=True)))


def test_documents_with_dynamic_fields(spark):
    doc = {"id": "1", "title": "", "rank": 2, "tags": ["a", "b"], "_dynamic": [{"cost": 30, "_type": "long"}, {"num": 7.7, "_type": "float"}, {"text": "x y", "_tokenize": "yes"}]}
    raw = spark.createDataFrame([(json.dumps(doc),)], "value string")
    row = parse_documents(raw, S).first()
    assert row["title"] is None and row["rank"] == 2.0 and row["tags"] == ["a", "b"]
    assert row["_dyn"] == {"cost": "30", "num": "7.7", "text": "x y"}
    found = Engine(S, parse_documents(raw, S))
    assert found.search("SELECT * WHERE cost.long > 29 AND num.float < 8").total_hits() == 1
    for bad in ({"title": "no id"}, {"id": "1", "_dynamic": [{"a": 1, "b": 2}]}):
        with pytest.raises(Exception, match="no id|two names"):
            parse_documents(spark.createDataFrame([(json.dumps(bad),)], "value string"), S).collect()


def test_envelopes(spark):
    rows = ['{"id":"1","title":"a"}', '{"type":"Delete","id":"2"}', '{"type":"index","content":{"id":"3"},"route":[0,2],"index":"i"}']
    got = parse_requests(spark.createDataFrame([(r,) for r in rows], "value string")).collect()
    assert [(r["kind"], r["id"]) for r in got] == [("INDEX", "1"), ("DELETE", "2"), ("INDEX", "3")] and got[2]["route"] == [0, 2]
    with pytest.raises(Exception, match="unknown request type"):
        parse_requests(spark.createDataFrame([('{"type":"drop"}',)], "value string")).collect()


def test_latest_wins_and_partial_updates(spark):
    table = spark.createDataFrame([("1", "a", 1.0), ("2", "b", 2.0)], "id string, title string, rank double")
    new = spark.createDataFrame([("1", 5, "x", 9.0), ("1", 4, "y", 8.0), ("3", 1, "z", None)], "id string, seq int, title string, rank double")
    assert {tuple(r) for r in upsert(table, new, "id", "seq").collect()} == {("1", "x", 9.0), ("2", "b", 2.0), ("3", "z", None)}
    part = spark.createDataFrame([("1", 1, 7.5), ("9", 2, 1.0)], "id string, seq int, rank double")
    done, unknown = update(table, part, "id", "seq")
    assert {tuple(r) for r in done.collect()} == {("1", "a", 7.5), ("2", "b", 2.0)} and [r["id"] for r in unknown.collect()] == ["9"]
    log = spark.createDataFrame([("1", 1, "INDEX", "q", 0.0), ("1", 2, "DELETE", None, None), ("4", 3, "REPLACE", "w", 4.0)], "id string, seq int, kind string, title string, rank double")
    assert {tuple(r) for r in apply_changes(table, log, "id").collect()} == {("2", "b", 2.0), ("4", "w", 4.0)}


def test_modes(spark):
    rows = spark.createDataFrame([(str(i), f"2024-01-0{1 + i % 3}") for i in range(9)], "id string, index string")
    many = MultiTable("id", max_live=2)
    many.add(rows)
    assert sorted(many.tables) == ["2024-01-02", "2024-01-03"] and many.delete_index("2024-01-02") and not many.delete_index("x")
    with pytest.raises(NotImplementedError):
        many.update(rows)
    swap = HotSwap("live", rows)
    swap.index("next_1", rows.limit(2))
    assert not swap.swap("next_2") and swap.swap("next_1") and swap.live.count() == 2 and len(swap.expired) == 1
    with pytest.raises(ValueError):
        swap.index("other", rows)


def test_batch_build_and_shard_hash(spark, tmp_path):
    rows = spark.createDataFrame([("hello",), ("a",), ("b",)], "id string")
    assert [r[0] for r in rows.select(shard_of(F.col("id"), 7)).collect()] == [99162322 % 7, 97 % 7, 98 % 7]
    batch_build(rows, str(tmp_path / "t"), "id", 4)
    assert spark.read.parquet(str(tmp_path / "t")).where("shard = 2").count() == 2


def test_stream_table(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "table")
    source.mkdir()
    table = StreamTable(spark, target, S)

    def push(name: str, lines: list[dict]) -> None:
        (source / name).write_text("\n".join(json.dumps(x) for x in lines))
        stream = spark.readStream.schema("value string").text(str(source)).withColumn("seq", F.get_json_object("value", "$.seq").cast("long"))
        table.start(stream, str(tmp_path / "cp")).awaitTermination()

    assert table.read().count() == 0
    push("1.txt", [{"id": "1", "title": "a", "seq": 1}, {"id": "2", "title": "b", "seq": 2}, {"id": "1", "title": "c", "seq": 3}])
    assert {(r["id"], r["title"]) for r in table.read().collect()} == {("1", "c"), ("2", "b")}
    push("2.txt", [{"type": "delete", "id": "2", "seq": 4}, {"id": "3", "title": "d", "seq": 5}])
    assert {(r["id"], r["title"]) for r in table.read().collect()} == {("1", "c"), ("3", "d")}
    assert read_json_lines(spark, str(source / "1.txt"), S).count() == 3


def lines_of(spark, requests, start=1):
    return spark.createDataFrame([(json.dumps(r), start + i) for i, r in enumerate(requests)], "value string, seq long")


def test_updates_in_a_log(spark):
    table = spark.createDataFrame([("1", "a", 1.0, {"x": "1", "y": "2"}), ("2", "b", 2.0, None)], "id string, title string, rank double, d map<string,string>")
    log = spark.createDataFrame(
        [("1", 1, "UPDATE", None, 7.0, {"y": "9"}), ("1", 2, "UPDATE", "z", None, {}), ("2", 3, "UPDATE", "lost", None, None), ("2", 4, "INDEX", "n", None, None), ("2", 5, "UPDATE", None, 5.0, None),
         ("3", 6, "UPDATE", "q", None, None), ("1", 7, "UPDATE", None, 8.0, None), ("4", 8, "INDEX", "w", 1.0, None), ("4", 9, "DELETE", None, None, None), ("4", 10, "UPDATE", "v", None, None), (None, 11, "INDEX", "no", 0.0, None)],
        "id string, seq int, kind string, title string, rank double, d map<string,string>")
    done, failed = resolve_requests(table, log, "id")
    got = {r["id"]: (r["title"], r["rank"], r["d"], r["__gone"]) for r in done.collect()}
    assert got == {"1": ("z", 8.0, {"x": "1", "y": "9"}, False), "2": ("n", 5.0, None, False), "4": ("v", None, None, True)}
    assert {(r["id"], r["seq"]) for r in failed.collect()} == {("3", 6), ("4", 10)}


def test_stream_table_updates_and_compacts(spark, tmp_path):
    table = StreamTable(spark, str(tmp_path / "t"), S, compact=2)
    table.apply(lines_of(spark, [{"id": "1", "title": "a", "rank": 1}, {"id": "2", "title": "b"}]), 0)
    for _ in range(2):  # a batch that runs again
        table.apply(lines_of(spark, [{"type": "update", "content": {"id": "1", "rank": 5}}, {"type": "delete", "id": "2"}, {"type": "update", "content": {"id": "9", "rank": 5}}], 3), 1)
        assert [(r["id"], r["title"], r["rank"]) for r in table.read().collect()] == [("1", "a", 5.0)]
        assert [(r["id"], r["seq"]) for r in table.failed().collect()] == [("9", 5)]
    assert table.folders.numbers("base") == [1]
    for n in range(2, 6):
        table.apply(lines_of(spark, [{"id": str(n), "title": "c"}], 10 * n), n)
    assert {r["id"] for r in table.read().collect()} == {"1", "2", "3", "4", "5"} and table.folders.numbers("base") == [3, 5]
    with pytest.raises(ValueError, match="DELETE_INDEX"):
        table.apply(lines_of(spark, [{"type": "delete_index", "index": "x"}]), 9)


def test_stream_tables_delete_and_swap_indexes(spark, tmp_path):
    tables = StreamTables(spark, str(tmp_path / "t"), S)
    assert tables.read().count() == 0
    for _ in range(2):
        tables.apply(lines_of(spark, [
            {"type": "index", "content": {"id": "1", "title": "old"}}, {"type": "index", "content": {"id": "7", "title": "new"}, "index": "next_1"},
            {"type": "swap_index", "index": "next_1"}, {"type": "index", "content": {"id": "8", "title": "newer"}}, {"type": "index", "content": {"id": "9"}, "index": "side"},
        ]), 0)
        assert {r["id"] for r in tables.read().collect()} == {"7", "8"} and set(tables.names()) == {"live", "side"}
    tables.apply(lines_of(spark, [{"type": "delete_index", "index": "side"}, {"type": "swap_index", "index": "nothing"}, {"type": "update", "content": {"id": "7", "rank": 3}}], 20), 1)
    assert {(r["id"], r["rank"]) for r in tables.read().collect()} == {("7", 3.0), ("8", None)} and set(tables.names()) == {"live"}
    with pytest.raises(ValueError, match="no index side"):
        tables.read("side")


def test_a_stream_s_batch_is_read_once(spark, tmp_path):
    reads = spark.sparkContext.accumulator(0)

    def seen(text):
        reads.add(1)
        return text

    table = StreamTable(spark, str(tmp_path / "t"), S)
    batch = lines_of(spark, [{"id": str(k), "title": "a"} for k in range(50)] + [{"type": "update", "content": {"id": "1", "rank": 5}}])
    table.apply(batch.withColumn("value", F.udf(seen)("value")), 0)
    assert table.read().count() == 50 and reads.value == 51
