import datetime as dt
import json

import pytest
from rivulet import Stream, fields
from rivulet.app import Application, Histogram
from rivulet.sources import (
    CsvFormat, DelayedListSource, FileSink, FileSource, JsonFormat, ListSource, MemorySink, PartitionedSink, ServiceSink, ServiceSource,
    object_store_source, parse_instant, register_adapter,
)
from rivulet.sources.sinks import WRITERS


def test_csv_null_token_and_separator(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a|b\n3|N\nx|1\n4|2\n")
    fmt = CsvFormat(columns=("a", "b"), header=True, separator="|", null="N")
    s = FileSource(str(tmp_path / "a.csv"), "a int, b int", fmt).stream(spark)
    assert sorted(map(tuple, s.to_df().collect()), key=str) == [(3, None), (4, 2)]


def test_csv_output_subset(spark, tmp_path):
    s = Stream.of_list(spark, [(1, 2, 3)], "a int, b int, c int")
    FileSink(str(tmp_path / "out"), CsvFormat(columns=("b", "c"))).write(s)
    assert [p.read_text() for p in (tmp_path / "out").glob("part-*.csv")] == ["2,3\n"]


def test_json_unknown_fields(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"a": 1, "x": 2}\n{"a": 3}\n')
    loose = FileSource(str(tmp_path / "a.json"), "a int").stream(spark)
    assert sorted(r.a for r in loose.to_df().collect()) == [1, 3]
    strict = FileSource(str(tmp_path / "a.json"), "a int", JsonFormat(strict=True)).stream(spark)
    with pytest.raises(Exception, match="unknown fields: x"):
        strict.to_df().collect()


def test_instants(spark):
    given = ["2024-01-02T03:04:05Z", "2024-01-02T03:04:05.250Z", "2024-01-02T03:04:05", "2024-01-02 03:04:05", "2024-01-02", "no"]
    got = [r[0] for r in spark.createDataFrame([(g,) for g in given], "s string").select(parse_instant("s")).collect()]
    t = dt.datetime(2024, 1, 2, 3, 4, 5)
    assert got == [t, t.replace(microsecond=250000), t, t, dt.datetime(2024, 1, 2), None]


def test_delayed_list(spark):
    s = DelayedListSource([(0, (1,)), (1500, (2,))], "i int").stream(spark)
    assert [(r.i, r.arrival) for r in s.to_df().orderBy("i").collect()] == [(1, dt.datetime(1970, 1, 1)), (2, dt.datetime(1970, 1, 1, 0, 0, 1, 500000))]


def test_object_store_path():
    assert object_store_source("/bucket/", "/a/b/", "i int").path == "s3a://bucket/a/b"


def test_service_source_and_sink(spark):
    image = {"NewImage": {"n": {"N": "3"}, "s": {"S": "x"}, "l": {"L": [{"N": "1.5"}, {"BOOL": True}]}}}
    register_adapter("changes", lambda sp, o: sp.createDataFrame([(json.dumps(image),), (json.dumps({"OldImage": {}}),)], "value string"))
    s = ServiceSource("changes", "n bigint, s string", ("n",), image=True).stream(spark)
    assert [tuple(r) for r in s.to_df().collect()] == [(3, "x")]
    with pytest.raises(LookupError):
        ServiceSource("none", "n int", ("n",)).stream(spark)
    with pytest.raises(LookupError):
        ServiceSink("none").write(s)
    assert not WRITERS


def test_application_with_several_sinks(spark, tmp_path):
    app = Application("sums", lambda given: {"doubled": given["numbers"].map(lambda r: fields(i=r.i + r.i, j=r.i))})
    app.set_source("numbers", ListSource([(1,), (2,)], "i int"))
    memory = MemorySink("doubled")
    memory.clear()
    app.add_sink("doubled", memory).add_sink("doubled", PartitionedSink(str(tmp_path / "p"), ("i",)))
    app.metrics["doubled"] = [Histogram("i", (0.5,))]
    run = app.run(spark)
    assert [r["i"] for r in memory.wait_for(2)] == [2, 4]
    assert sorted(p.name for p in (tmp_path / "p").glob("i=*")) == ["i=2", "i=4"]
    assert run.metric("doubled")[0].first()["records"] == 2
    app.add_sink("absent", memory)
    with pytest.raises(LookupError):
        app.run(spark)


def doubled(given):
    return {"doubled": given["numbers"].map(lambda r: fields(i=r.i + r.i, j=r.i))}


def test_application_as_text(spark, tmp_path):
    app = Application("sums", doubled, "2")
    app.set_source("numbers", ListSource([(1,), (2,)], "i int"))
    app.set_source("files", FileSource("/nowhere", "t timestamp", CsvFormat(columns=("t",), times={"t": "yyyy"}), ("t",)))
    app.add_sink("doubled", MemorySink("told")).add_sink("doubled", FileSink(str(tmp_path / "f")))
    app.metrics["doubled"] = [Histogram("i", (0.5,))]
    again = Application.from_json(app.to_json())
    assert (again.sources, again.metrics, again.build, again.version) == (app.sources, app.metrics, doubled, "2")
    assert again.to_json() == app.to_json()
    again.sources.pop("files")
    memory = again.sinks["doubled"][0]
    memory.clear()
    again.run(spark)
    assert [r["i"] for r in memory.wait_for(2)] == [2, 4]
    with pytest.raises(ValueError, match="found again"):
        Application("x", lambda given: given).to_json()


def test_list_that_runs_forever(spark):
    s = ListSource([(1, "a"), (2, "b")], "i int, s string", run_forever=True).stream(spark)
    q = s.to_df().writeStream.format("memory").queryName("forever").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(map(tuple, spark.table("forever").collect())) == [(1, "a"), (2, "b")]


def test_select_all_names(spark):
    a = Stream.of_list(spark, [(1, 2)], "a int, right_a int")
    out = a.left_join(a).where(lambda x, y: x.a == y.a).select_all()
    assert out.columns == ["a", "right_a", "right_a1", "right_right_a"]


def test_lineage_walks(spark):
    from rivulet.operators import lineage as walk

    links = spark.createDataFrame(
        [("b", "b1", "a", "a1"), ("c", "c1", "b", "b1"), ("c", "c1", "z", "z9")], "stream string, subject string, from_stream string, source string"
    )
    assert walk.is_descended_from(links, ("c", "c1"), ("a", "a1"))
    assert not walk.is_descended_from(links, ("b", "b1"), ("z", "z9"))
    assert walk.first_upstream(links, ("c", "c1"), "a") == "a1"
    assert walk.immediate_descendants(links, "b", "b1").collect()[0]["subject"] == "c1"
    assert walk.has_lineage(spark.createDataFrame([("c1",), ("c2",)], "k string"), links, "k", "c").count() == 1
