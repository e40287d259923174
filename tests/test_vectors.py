"""Step vectors: what each pipeline emits as records arrive."""

import pytest
from rivulet import Stream, agg, fields, tuple_of


def rows(stream, *names):
    df = stream.df.orderBy(*stream.order)
    return [tuple(r) for r in df.select(*(names or stream.columns)).collect()]


def kv(spark, data):
    return Stream.of_list(spark, data, "key int, value int")


def test_filter(spark):
    s = Stream.of_list(spark, [(1,), (6,), (3,), (10,)], "i int")
    assert rows(s.where(lambda r: r.i > 5)) == [(6,), (10,)]


def test_scan(spark):
    s = Stream.of_list(spark, [(1,), (2,), (2,), (4,)], "i int")

    def step(state, r):
        return state + r["i"], {"s": state + r["i"]}

    assert rows(s.scan(0, step, "s int")) == [(1,), (3,), (5,), (9,)]


def test_scan_drops_where_none(spark):
    s = Stream.of_list(spark, [(1,), (2,), (3,), (4,)], "i int")
    out = s.scan(0, lambda n, r: (n + 1, {"i": r["i"]} if n % 2 else None), "i int")
    assert rows(out) == [(2,), (4,)]


def test_sum_by_per_key(spark):
    g = kv(spark, [(1, 1), (1, 2), (2, 3), (2, 5)]).group_by(lambda r: r.key)
    out = g.flat_map(lambda k, s: s.sum_by(lambda r: r.value, lambda r, v: fields(key=r.key, total=v)))
    assert rows(out) == [(1, 1), (1, 3), (2, 3), (2, 8)]


def test_max_by_changes_and_all(spark):
    g = kv(spark, [(1, 1), (1, 3), (1, 2), (2, 8), (2, 3)]).group_by(lambda r: r.key)
    assert rows(g.flat_map(lambda k, s: s.max_by(lambda r: r.value))) == [(1, 1), (1, 3), (2, 8)]
    assert rows(g.flat_map(lambda k, s: s.max_by(lambda r: r.value, emit="all"))) == [(1, 1), (1, 3), (1, 3), (2, 8), (2, 8)]


def test_ties_keep_the_first(spark):
    s = Stream.of_list(spark, [(1, 5, "a"), (1, 5, "b"), (1, 4, "c")], "key int, value int, name string")
    g = s.group_by(lambda r: r.key)
    assert rows(g.flat_map(lambda k, x: x.max_by(lambda r: r.value, emit="all")), "name") == [("a",), ("a",), ("a",)]
    out = g.select(lambda k, r: fields(hi=agg.argmax(r.value, r.name), lo=agg.argmin(r.value, r.name)))
    assert rows(out) == [("a", "a"), ("a", "a"), ("a", "c")]


def test_running_sum_and_count(spark):
    g = kv(spark, [(1, 1), (1, 2), (2, 3), (2, 5)]).group_by(lambda r: r.key)
    out = g.select(lambda k, r: fields(key=k, total=agg.sum_(r.value), n=agg.count()))
    assert rows(out) == [(1, 1, 1), (1, 3, 2), (2, 3, 1), (2, 8, 2)]


def test_record_window(spark):
    w = kv(spark, [(1, 1), (1, 2), (2, 3), (2, 4)]).group_by(lambda r: r.key).record_window(1)
    assert rows(w.select(lambda r: fields(total=agg.sum_(r.value)))) == [(1,), (2,), (5,), (6,)]


def test_top_record_then_window(spark):
    g = kv(spark, [(1, 1), (1, 3), (1, 2), (2, 1), (2, 5), (2, 4)]).group_by(lambda r: r.key)
    w = g.map(lambda k, s: s.max_by(lambda r: r.value, emit="all")).record_window(1)
    out = w.select(lambda r: fields(key=agg.any_(r.key), total=agg.sum_(r.value)))
    assert rows(out) == [(1, 1), (1, 3), (1, 3), (1, 4), (1, 8), (1, 8)]


def test_window_apply(spark):
    s = Stream.of_list(spark, [(1, 1, 1), (1, 2, 2), (2, 3, 1), (2, 1, 1)], "a int, b int, c int")
    w = s.group_by(lambda r: r.a).map(lambda k, x: x.max_by(lambda r: r.b, emit="all")).record_window(1)
    out = w.apply(lambda rs: {"v": ",".join(f"{r['a']}{r['b']}{r['c']}" for r in rs)}, "v string")
    assert rows(out) == [("111",), ("122",), ("122,231",), ("122,231",)]


def test_nested_groups(spark):
    data = [(1, 1, 1, 1), (1, 1, 2, 3), (1, 2, 1, 5), (1, 2, 2, 2), (2, 1, 1, 1), (2, 1, 2, 3)]
    s = Stream.of_list(spark, data, "a int, b int, c int, d int")

    def body(a, x):
        best = x.group_by(lambda r: r.b).map(lambda b, y: y.max_by(lambda r: r.c, emit="all"))
        return best.record_window(1).select(lambda r: fields(a=agg.any_(r.a), total=agg.sum_(r.d)))

    assert rows(s.group_by(lambda r: r.a).flat_map(body)) == [(1, 1), (1, 3), (1, 8), (1, 5), (2, 1), (2, 3)]


def sides(spark, steps):
    made = [[(i, *v) for i, (side, v) in enumerate(steps) if side == want] for want in "LR"]
    return [Stream.from_df(spark.createDataFrame(m, "n int, a int, b int"), "n") for m in made]


def test_left_join_inner_by_null_test(spark):
    l, r = sides(spark, [("L", (1, 1)), ("R", (1, 2)), ("L", (1, 3)), ("R", (2, 1)), ("R", (2, 2)), ("L", (2, 4))])  # noqa: E741
    j = l.left_join(r).where(lambda x, y: (x.a == y.a) & (y != None))  # noqa: E711
    assert rows(j.select(lambda x, y: fields(key=x.a, v=x.b + y.b))) == [(1, 5), (2, 6)]


def test_full_join(spark):
    from rivulet import if_else

    steps = [("L", (1, 1)), ("L", (1, 3)), ("R", (1, 2)), ("L", (1, 5)), ("R", (2, 1)), ("R", (2, 3)), ("L", (2, 2)), ("R", (2, 5))]
    l, r = sides(spark, steps)  # noqa: E741
    zero = lambda side: if_else(side.is_null(), 0, side.b)
    j = l.full_join(r).where(lambda x, y: x.a == y.a)
    out = j.select(lambda x, y: fields(a=if_else(x.is_null(), y.a, x.a), v=zero(x) + zero(y)))
    assert rows(out) == [(1, 1), (1, 3), (1, 5), (1, 7), (2, 1), (2, 3), (2, 5), (2, 7)]


def test_left_inner_join_waits(spark):
    l, r = sides(spark, [("L", (1, 10)), ("L", (2, 20)), ("R", (1, 1)), ("R", (2, 2)), ("R", (1, 3)), ("R", (2, 4))])  # noqa: E741
    out = l.left_inner_join(r).where(lambda x, y: x.a == y.a).select(lambda x, y: fields(a=x.a, b=y.b))
    assert rows(out) == [(1, 1), (2, 2)]


def test_missing_side_is_not_a_record_of_nulls(spark):
    l = Stream.from_df(spark.createDataFrame([(1, 1)], "n int, a int"), "n")  # noqa: E741
    r = Stream.from_df(spark.createDataFrame([(0, 1, None)], "n int, a int, x int"), "n")
    out = l.left_join(r).where(lambda p, q: p.a == q.a).select(lambda p, q: fields(gone=q.is_null(), x=q.x))
    assert rows(out) == [(False, None)]


def test_join_needs_an_equality(spark):
    a = kv(spark, [(1, 1)])
    with pytest.raises(ValueError, match="equality"):
        a.left_join(a).where(lambda x, y: x.key > y.key)


def test_null_keys_meet(spark):
    l = Stream.from_df(spark.createDataFrame([(1, None)], "n int, a int"), "n")  # noqa: E741
    r = Stream.from_df(spark.createDataFrame([(0, None)], "n int, a int"), "n")
    out = l.left_join(r).where(lambda p, q: p.a == q.a).select(lambda p, q: fields(n=q.n))
    # a key column is compared as a partition, where nulls are equal
    assert rows(out) == [(0,)]


def test_sliding_window_six(spark):
    import datetime as dt

    s = Stream.of_list(spark, [(dt.datetime(2024, 1, 1, 0, 55), 1)], "t timestamp, i int")
    w = s.sliding_window(lambda r: r.t, "1 hour", "10 minutes")
    out = w.select(lambda k, r: fields(start=k, v=agg.sum_(r.i)))
    got = rows(out)
    assert len({g[0] for g in got}) == 6 and {g[1] for g in got} == {1}


def test_window_top_record(spark):
    import datetime as dt

    t = dt.datetime(2024, 1, 1)
    data = [(t, 1, 1, i) for i in (1, 5, 3)] + [(t + dt.timedelta(seconds=6), 1, 1, i) for i in (12, 11, 10)]
    s = Stream.of_list(spark, data, "t timestamp, k1 int, k2 int, i int")
    w = s.group_by(lambda r: tuple_of(r.k1, r.k2)).tumbling_window(lambda r: r.t, "5 seconds")
    out = w.flat_map(lambda k, x: x.max_by(lambda r: tuple_of(r.t, r.i)).last())
    assert sorted(rows(out, "i")) == [(5,), (12,)]


def test_last(spark):
    g = kv(spark, [(1, 1), (1, 3), (1, 2)]).group_by(lambda r: r.key)
    assert rows(g.flat_map(lambda k, s: s.max_by(lambda r: r.value).last())) == [(1, 3)]


def test_last_of_nothing(spark):
    assert rows(kv(spark, [(1, 1)]).where(lambda r: r.key > 5).last()) == []


def test_cycle(spark):
    from rivulet.operators.cycle import cycle

    out = cycle(Stream.of_list(spark, [(1,)], "i int"), lambda s: s.map(lambda r: fields(i=r.i + 1)).where(lambda r: r.i <= 10))
    assert rows(out) == [(i,) for i in range(2, 11)]


def test_max_per_group_then_window_sum(spark):
    data = [(1, 1, 3), (1, 2, 1), (2, 1, 40), (2, 3, 20), (3, 1, 100), (3, 2, 200)]
    s = Stream.of_list(spark, data, "f0 int, f1 int, f2 int")
    w = s.group_by(lambda r: r.f0).map(lambda k, x: x.max_by(lambda r: r.f1)).record_window(1)
    assert rows(w.apply(lambda rs: {"v": sum(r["f2"] for r in rs)}, "v int").last()) == [(221,)]
    assert rows(w.select(lambda r: fields(v=agg.sum_(r.f2))).last()) == [(221,)]


def test_validation(spark):
    g = kv(spark, [(1, 1)]).group_by(lambda r: r.key)
    with pytest.raises(ValueError, match="inside an aggregate"):
        g.select(lambda k, r: fields(v=agg.sum_(agg.max_(r.value))))
    with pytest.raises(ValueError, match="group key"):
        g.select(lambda k, r: fields(v=agg.sum_(r.value + k)))
    with pytest.raises(TypeError):
        kv(spark, [(1, 1)]).where(lambda r: r.key == 1 and r.value == 1)


def test_comment_scenario(spark):
    """Votes replace each other by user; an older edit changes nothing, and every event emits."""
    events = [
        (1, "create", "u1", "text"), (2, "vote", "u2", "1"), (3, "vote", "u2", "-1"), (4, "vote", "u3", "1"), (6, "edit", "u1", "new text"), (5, "edit", "u1", "stale"),
    ]
    s = Stream.of_list(spark, events, "t int, kind string, username string, data string")
    votes = s.map(lambda r: fields(t=r.t, username=r.username, up=if_(r, "1"), down=if_(r, "-1"))).group_by(lambda r: r.username)
    latest = votes.map(lambda k, x: x.max_by(lambda r: r.t, emit="all")).record_window(1)
    got = rows(latest.select(lambda r: fields(up=agg.sum_(r.up), down=agg.sum_(r.down))))
    assert got[-1] == (1, 1) and len(got) == 6
    text = s.where(lambda r: r.kind != "vote").max_by(lambda r: r.t, emit="all")
    assert rows(text, "data")[-1] == ("new text",)


def if_(r, value):
    from rivulet import if_else

    return if_else((r.kind == "vote") & (r.data == value), 1, 0)
