"""The same pipeline bounded and streaming must agree."""

import pytest
from rivulet import Stream, agg, fields

DATA = [(i, i % 3, (i * 7) % 11, "abc"[i % 3]) for i in range(60)]
SCHEMA = "n bigint, key int, value int, kind string"


@pytest.fixture
def pair(spark, tmp_path):
    """The bounded stream, and a streaming one over three files."""
    df = spark.createDataFrame(DATA, SCHEMA)
    for i in range(3):
        df.where(f"n >= {i * 20} AND n < {i * 20 + 20}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    read = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in"))
    return Stream.from_df(df, "n"), Stream.from_df(read, "n")


def collect(spark, stream, tmp_path, mode="append"):
    df = stream.to_df(with_order=True)
    if not df.isStreaming:
        return sorted(map(repr, (tuple(r)[: len(stream.columns)] for r in df.collect())))
    q = df.writeStream.format("memory").queryName("out").outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return sorted(map(repr, (tuple(r)[: len(stream.columns)] for r in spark.table("out").collect())))


CASES = {
    "select": lambda s: s.group_by(lambda r: r.key).select(
        lambda k, r: fields(key=k, a=agg.sum_(r.value), b=agg.count(), c=agg.min_(r.value), d=agg.max_(r.value), e=agg.mean(r.value),
                            f=agg.any_(r.kind), g=agg.argmax(r.value, r.n), h=agg.argmin(r.value, r.n))
    ),
    "sum_by": lambda s: s.group_by(lambda r: r.key).flat_map(lambda k, x: x.sum_by(lambda r: r.value, lambda r, v: fields(n=r.n, v=v))),
    "max_by": lambda s: s.group_by(lambda r: r.key).flat_map(lambda k, x: x.max_by(lambda r: r.value)),
    "max_by_all": lambda s: s.group_by(lambda r: r.key).flat_map(lambda k, x: x.max_by(lambda r: r.value, emit="all")),
    "scan": lambda s: s.group_by(lambda r: r.key).flat_map(lambda k, x: x.scan(0, lambda t, r: (t + 1, {"n": r["n"], "t": t}), "n bigint, t bigint")),
    "window": lambda s: s.group_by(lambda r: r.kind).record_window(2).select(lambda r: fields(v=agg.sum_(r.value), m=agg.max_(r.value))),
}


@pytest.mark.parametrize("case", sorted(CASES))
def test_streaming_agrees(spark, pair, tmp_path, case):
    bounded, streaming = (CASES[case](s) for s in pair)
    assert collect(spark, bounded, tmp_path) == collect(spark, streaming, tmp_path)


@pytest.mark.parametrize("kind", ["left_join", "full_join", "left_inner_join"])
def test_streaming_joins(spark, pair, tmp_path, kind):
    out = []
    for s in pair:
        a, b = s.where(lambda r: r.kind == "a"), s.where(lambda r: r.kind != "a")
        joined = getattr(a, kind)(b).where(lambda x, y: x.value == y.value)
        out.append(collect(spark, joined.select(lambda x, y: fields(x=x.n, y=y.n)), tmp_path))
    if kind == "left_inner_join":
        assert out[0] == out[1]
    else:
        assert out[0] == out[1] and out[0]


def test_streaming_time_window(spark, tmp_path):
    import datetime as dt

    t = dt.datetime(2024, 1, 1)
    data = [(i, t + dt.timedelta(minutes=i), i) for i in range(50)]
    df = spark.createDataFrame(data, "n bigint, t timestamp, v int")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    final = {}
    for s in (Stream.from_df(df, "n"), Stream.from_df(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "n")):
        w = s.tumbling_window(lambda r: r.t, "10 minutes")
        if s.streaming:
            out = w.select(lambda k, r: fields(start=k, total=agg.sum_(r.v)))
            final[True] = collect(spark, out, tmp_path, mode="update")
        else:
            final[False] = collect(spark, w.select(lambda k, r: fields(start=k, total=agg.sum_(r.v)), emit="final"), tmp_path)
    assert final[True] == final[False] and len(final[True]) == 5
