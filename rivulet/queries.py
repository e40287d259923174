"""Registered queries of the stream operators, each with its SQL for DuckDB."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import Stream, agg, call, duration, fields, if_else, lit, map_option, none_of, record, tuple_of, unpack
from .functions.time import week_offset
from .operators.cycle import cycle
from .plans.work import shared_folder
from .sources import CsvFormat, DelayedListSource, FileSource, JsonFormat, PartitionedSink

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

_CENTS = "CAST(round(value * 100) AS BIGINT)"
_RUN = "PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING"


def query(sql: str | None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return add


def events(spark: SparkSession, sf_dir: str, *columns: str) -> Stream:
    """Events in order of event_id, with the value in whole cents."""
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    df = df.withColumn("cents", F.round(F.col("value") * 100).cast("bigint"))
    return Stream.of_fields(df, "event_id", *(columns or ("event_id", "ts", "user_id", "event_type", "cents")))


def orders(spark: SparkSession, sf_dir: str) -> Stream:
    df = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("cents", F.round(F.col("o_totalprice") * 100).cast("bigint"))
    return Stream.of_fields(df, ["o_orderdate", "o_orderkey"], "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "cents")


def _kind(s: Stream, kind: str) -> Stream:
    return s.where(lambda r: r.event_type == kind)


@query(f"""SELECT event_id, user_id, {_CENTS} + 1 AS plus_one, event_type || '!' AS label,
    CASE WHEN {_CENTS} > 5000 THEN 'high' ELSE 'low' END AS size, CAST(user_id AS VARCHAR) AS user_text
    FROM events WHERE {_CENTS} > 1000 AND NOT event_type = 'click'""")
def filter_map(spark, sf_dir):  # noqa: ANN001, ANN201
    s = events(spark, sf_dir).where(lambda r: (r.cents > 1000) & ~(r.event_type == "click"))
    return s.map(
        lambda r: fields(
            event_id=r.event_id, user_id=r.user_id, plus_one=r.cents + 1, label=r.event_type + "!",
            size=if_else(r.cents > 5000, "high", "low"), user_text=r.user_id.to_string(),
        )
    ).to_df()


@query("""SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, CAST(round(o_totalprice * 100) AS BIGINT) AS cents,
    CAST(round(o_totalprice * 100) AS BIGINT) - o_orderkey AS less, o_orderstatus = 'F' AS is_final FROM orders""")
def add_fields(spark, sf_dir):  # noqa: ANN001, ANN201
    return orders(spark, sf_dir).add_fields(lambda r: fields(less=r.cents - r.o_orderkey, is_final=r.o_orderstatus == "F")).to_df()


@query("SELECT o_orderkey AS k, o_orderpriority AS p FROM orders")
def to_field(spark, sf_dir):  # noqa: ANN001, ANN201
    s = orders(spark, sf_dir).to_field("rec")
    return s.map(lambda r: fields(k=r.rec.get("o_orderkey"), p=r.rec.get("o_orderpriority"))).to_df()


@query("SELECT event_id, event_type, len(json_keys(props)) AS n FROM events")
def apply_function(spark, sf_dir):  # noqa: ANN001, ANN201
    s = events(spark, sf_dir, "event_id", "event_type", "props")
    return s.map(lambda r: fields(event_id=r.event_id, event_type=r.event_type, n=call(lambda c: F.size(F.json_object_keys(c)).cast("bigint"), r.props))).to_df()


@query("SELECT event_id, unnest(string_split(event_type, 'c')) AS part FROM events")
def scalar_flat_map(spark, sf_dir):  # noqa: ANN001, ANN201
    s = events(spark, sf_dir, "event_id", "event_type").explode(lambda r: call(lambda c: F.split(c, "c"), r.event_type), "part")
    return s.map(lambda r: fields(event_id=r.event_id, part=r.part)).to_df()


@query("""SELECT event_id, event_type FROM events WHERE event_type = 'click'
    UNION ALL SELECT event_id, event_type FROM events WHERE user_id < 50""")
def union_streams(spark, sf_dir):  # noqa: ANN001, ANN201
    s = events(spark, sf_dir, "event_id", "event_type", "user_id")
    return _kind(s, "click").union(s.where(lambda r: r.user_id < 50)).map(lambda r: fields(event_id=r.event_id, event_type=r.event_type)).to_df()


def _running(name: str, sql: str, make) -> None:  # noqa: ANN001
    def run(spark, sf_dir):  # noqa: ANN001, ANN202
        return events(spark, sf_dir).group_by(lambda r: r.user_id).select(lambda k, r: fields(user_id=k, v=make(r))).to_df()

    run.__name__ = name
    query(f"SELECT user_id, {sql} AS v FROM events")(run)


_running("running_sum", f"CAST(sum({_CENTS}) OVER ({_RUN}) AS BIGINT)", lambda r: agg.sum_(r.cents))
_running("running_count", f"count(*) OVER ({_RUN})", lambda r: agg.count())
_running("running_min", f"min({_CENTS}) OVER ({_RUN})", lambda r: agg.min_(r.cents))
_running("running_max", f"max({_CENTS}) OVER ({_RUN})", lambda r: agg.max_(r.cents))
_running("running_any", f"first_value(event_type) OVER ({_RUN})", lambda r: agg.any_(r.event_type))
_running(
    "running_mean", f"CAST(floor(avg({_CENTS}) OVER ({_RUN}) * 100 + 0.5) AS BIGINT)", lambda r: call(lambda c: F.floor(c * 100 + 0.5).cast("bigint"), agg.mean(r.cents))
)

def _arg(name: str, f: str, make) -> None:  # noqa: ANN001
    def run(spark, sf_dir):  # noqa: ANN001, ANN202
        return events(spark, sf_dir).group_by(lambda r: r.user_id).select(lambda k, r: fields(user_id=k, v=make(r.cents, r.event_id))).to_df()

    run.__name__ = name
    query(f"""WITH e AS (SELECT user_id, event_id, {_CENTS} AS cents, {f}({_CENTS}) OVER ({_RUN}) AS m FROM events),
        firsts AS (SELECT user_id, cents, min(event_id) AS v FROM e GROUP BY ALL)
        SELECT e.user_id, firsts.v FROM e JOIN firsts ON e.user_id = firsts.user_id AND e.m = firsts.cents""")(run)


_arg("running_argmax", "max", agg.argmax)
_arg("running_argmin", "min", agg.argmin)


@query(f"""SELECT user_id, CAST(sum({_CENTS}) OVER ({_RUN}) AS BIGINT) - count(*) OVER ({_RUN}) + user_id AS v,
    max({_CENTS}) OVER ({_RUN}) - min({_CENTS}) OVER ({_RUN}) AS span, count(*) OVER ({_RUN}) AS n FROM events""")
def running_arithmetic(spark, sf_dir):  # noqa: ANN001, ANN201
    g = events(spark, sf_dir).group_by(lambda r: r.user_id)
    return g.select(
        lambda k, r: fields(user_id=k, v=agg.sum_(r.cents) - agg.count() + k, span=agg.max_(r.cents) - agg.min_(r.cents), n=agg.count())
    ).to_df()


@query("""SELECT l_returnflag AS flag, l_linestatus AS status, CAST(sum(CAST(round(l_quantity) AS BIGINT)) AS BIGINT) AS quantity,
    count(*) AS n, min(l_orderkey) AS first_order, max(l_orderkey) AS last_order FROM lineitem GROUP BY ALL""")
def final_agg_by_key(spark, sf_dir):  # noqa: ANN001, ANN201
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("q", F.round("l_quantity").cast("bigint"))
    s = Stream.of_fields(df, ["l_orderkey", "l_linenumber"], "l_returnflag", "l_linestatus", "q", "l_orderkey")
    g = s.group_by(lambda r: tuple_of(r.l_returnflag, r.l_linestatus))
    return g.select(
        lambda k, r: fields(
            flag=k.get("_1"), status=k.get("_2"), quantity=agg.sum_(r.q), n=agg.count(), first_order=agg.min_(r.l_orderkey), last_order=agg.max_(r.l_orderkey)
        ),
        emit="final",
    ).to_df()


@query(f"""WITH e AS (SELECT *, {_CENTS} AS cents FROM events)
    SELECT user_id, count(*) AS n, min_by(event_type, event_id) AS first_type,
    (SELECT min(x.event_id) FROM e x WHERE x.user_id = e.user_id AND x.cents = max(e.cents)) AS best,
    (SELECT min(x.event_id) FROM e x WHERE x.user_id = e.user_id AND x.cents = min(e.cents)) AS worst FROM e GROUP BY user_id HAVING count(*) > 10""")
def final_having(spark, sf_dir):  # noqa: ANN001, ANN201
    g = events(spark, sf_dir).group_by(lambda r: r.user_id)
    out = g.select(
        lambda k, r: fields(
            user_id=k, n=agg.count(), first_type=agg.any_(r.event_type), best=agg.argmax(r.cents, r.event_id), worst=agg.argmin(r.cents, r.event_id)
        ),
        emit="final",
    )
    return out.where(lambda r: r.n > 10).to_df()


@query(f"SELECT event_id, user_id, CAST(sum({_CENTS}) OVER ({_RUN}) AS BIGINT) AS total FROM events")
def sum_by(spark, sf_dir):  # noqa: ANN001, ANN201
    g = events(spark, sf_dir).group_by(lambda r: r.user_id)
    return g.flat_map(lambda k, s: s.sum_by(lambda r: r.cents, lambda r, v: fields(event_id=r.event_id, user_id=r.user_id, total=v))).to_df()


@query(f"SELECT event_id, CAST(sum({_CENTS}) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM events WHERE user_id < 20")
def sum_by_global(spark, sf_dir):  # noqa: ANN001, ANN201
    s = events(spark, sf_dir).where(lambda r: r.user_id < 20)
    return s.sum_by(lambda r: r.cents, lambda r, v: fields(event_id=r.event_id, total=v)).to_df()


@query(f"SELECT event_id, CAST(floor(avg({_CENTS}) OVER ({_RUN}) * 100 + 0.5) AS BIGINT) AS mean FROM events")
def mean_by(spark, sf_dir):  # noqa: ANN001, ANN201
    g = events(spark, sf_dir).group_by(lambda r: r.user_id)
    return g.flat_map(
        lambda k, s: s.mean_by(lambda r: r.cents, lambda r, v: fields(event_id=r.event_id, mean=call(lambda c: F.floor(c * 100 + 0.5).cast("bigint"), v)))
    ).to_df()


@query("""SELECT user_id, event_id, CAST(product(1 + user_id % 2) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS p
    FROM events WHERE event_id % 37 = 0""")
def product_by(spark, sf_dir):  # noqa: ANN001, ANN201
    g = events(spark, sf_dir).where(lambda r: r.event_id % 37 == 0).group_by(lambda r: r.user_id)
    return g.flat_map(lambda k, s: s.product_by(lambda r: r.user_id % 2 + 1, lambda r, v: fields(user_id=r.user_id, event_id=r.event_id, p=v))).to_df()


def _changes(name: str, f: str, op: str, largest: bool) -> None:
    def run(spark, sf_dir):  # noqa: ANN001, ANN202
        g = events(spark, sf_dir, "event_id", "user_id", "cents").group_by(lambda r: r.user_id)
        return g.flat_map(lambda k, s: s.max_by(lambda r: r.cents) if largest else s.min_by(lambda r: r.cents)).to_df()

    run.__name__ = name
    query(f"""SELECT event_id, user_id, cents FROM (SELECT event_id, user_id, {_CENTS} AS cents,
        {f}({_CENTS}) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM events)
        WHERE m IS NULL OR cents {op} m""")(run)


_changes("max_by_changes", "max", ">", True)
_changes("min_by_changes", "min", "<", False)


@query(f"""WITH e AS (SELECT user_id, event_id, {_CENTS} AS cents, max({_CENTS}) OVER ({_RUN}) AS m FROM events),
    firsts AS (SELECT user_id, cents, min(event_id) AS v FROM e GROUP BY ALL)
    SELECT firsts.v AS event_id, e.user_id, e.m AS cents FROM e JOIN firsts ON e.user_id = firsts.user_id AND e.m = firsts.cents""")
def max_by_all(spark, sf_dir):  # noqa: ANN001, ANN201
    g = events(spark, sf_dir, "event_id", "user_id", "cents").group_by(lambda r: r.user_id)
    return g.flat_map(lambda k, s: s.max_by(lambda r: r.cents, emit="all")).to_df()


@query("SELECT user_id, max(event_id) AS event_id, max_by(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def last_per_key(spark, sf_dir):  # noqa: ANN001, ANN201
    g = events(spark, sf_dir, "user_id", "event_id", "event_type").group_by(lambda r: r.user_id)
    return g.flat_map(lambda k, s: s.last()).to_df()


@query("SELECT user_id, event_id, event_type FROM events ORDER BY event_id DESC LIMIT 1")
def last_global(spark, sf_dir):  # noqa: ANN001, ANN201
    return events(spark, sf_dir, "user_id", "event_id", "event_type").last().to_df()


def _two(spark: SparkSession, sf_dir: str, a: str, b: str) -> tuple[Stream, Stream]:
    s = events(spark, sf_dir, "event_id", "user_id", "event_type", "cents")
    return _kind(s, a), _kind(s, b)


@query("""SELECT l.event_id AS left_id, r.event_id AS right_id FROM (SELECT * FROM events WHERE event_type = 'purchase') l
    ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') r ON l.user_id = r.user_id AND l.event_id >= r.event_id""")
def left_join_latest(spark, sf_dir):  # noqa: ANN001, ANN201
    a, b = _two(spark, sf_dir, "purchase", "click")
    return a.left_join(b).where(lambda l, r: l.user_id == r.user_id).select(lambda l, r: fields(left_id=l.event_id, right_id=r.event_id)).to_df()  # noqa: E741


@query(f"""WITH e AS (SELECT *, {_CENTS} AS cents FROM events)
    SELECT l.event_id AS left_id, r.event_id AS right_id, l.cents + r.cents AS total FROM (SELECT * FROM e WHERE event_type = 'purchase' AND cents > 2000) l
    ASOF JOIN (SELECT * FROM e WHERE event_type = 'click' AND cents < 6000) r ON l.user_id = r.user_id AND l.event_id >= r.event_id WHERE l.cents > r.cents""")
def left_join_filtered(spark, sf_dir):  # noqa: ANN001, ANN201
    a, b = _two(spark, sf_dir, "purchase", "click")
    j = a.left_join(b).where(
        lambda l, r: (l.user_id == r.user_id) & (l.cents > 2000) & (r.cents < 6000) & (r != None) & (l.cents > r.cents)  # noqa: E741, E711
    )
    return j.select(lambda l, r: fields(left_id=l.event_id, right_id=r.event_id, total=l.cents + r.cents)).to_df()  # noqa: E741


@query("""SELECT last_value(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS) OVER w AS left_id,
    last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER w AS right_id FROM events WHERE event_type IN ('view', 'click')
    WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)""")
def full_join_latest(spark, sf_dir):  # noqa: ANN001, ANN201
    a, b = _two(spark, sf_dir, "view", "click")
    return a.full_join(b).where(lambda l, r: l.user_id == r.user_id).select(lambda l, r: fields(left_id=l.event_id, right_id=r.event_id)).to_df()  # noqa: E741


@query("""WITH l AS (SELECT * FROM events WHERE event_type = 'purchase'), r AS (SELECT * FROM events WHERE event_type = 'click')
    SELECT l.event_id AS left_id, coalesce((SELECT max(event_id) FROM r WHERE r.user_id = l.user_id AND r.event_id <= l.event_id),
        (SELECT min(event_id) FROM r WHERE r.user_id = l.user_id AND r.event_id > l.event_id)) AS right_id FROM l
    WHERE EXISTS (SELECT 1 FROM r WHERE r.user_id = l.user_id)""")
def left_inner_wait(spark, sf_dir):  # noqa: ANN001, ANN201
    a, b = _two(spark, sf_dir, "purchase", "click")
    return a.left_inner_join(b).where(lambda l, r: l.user_id == r.user_id).select(lambda l, r: fields(left_id=l.event_id, right_id=r.event_id)).to_df()  # noqa: E741


@query(f"""WITH e AS (SELECT *, {_CENTS} AS cents FROM events), l AS (SELECT * FROM e WHERE event_type = 'purchase'), r AS (SELECT * FROM e WHERE event_type = 'click'),
    b AS (SELECT l.event_id, l.user_id, l.cents, (SELECT max(event_id) FROM r WHERE r.user_id = l.user_id AND r.event_id <= l.event_id) AS before FROM l),
    c AS (SELECT b.event_id AS left_id, CASE WHEN r.cents > b.cents THEN b.before ELSE
        (SELECT min(event_id) FROM r x WHERE x.user_id = b.user_id AND x.event_id > b.event_id AND x.cents > b.cents) END AS right_id FROM b LEFT JOIN r ON r.event_id = b.before)
    SELECT left_id, right_id FROM c WHERE right_id IS NOT NULL""")
def left_inner_wait_condition(spark, sf_dir):  # noqa: ANN001, ANN201
    a, b = _two(spark, sf_dir, "purchase", "click")
    j = a.left_inner_join(b).where(lambda l, r: (l.user_id == r.user_id) & (r.cents > l.cents))  # noqa: E741
    return j.select(lambda l, r: fields(left_id=l.event_id, right_id=r.event_id)).to_df()  # noqa: E741


@query("""SELECT l.event_id, l.user_id, l.event_type, r.event_id AS right_event_id, r.user_id AS right_user_id, r.event_type AS right_event_type
    FROM (SELECT * FROM events WHERE event_type = 'purchase') l
    ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') r ON l.user_id = r.user_id AND l.event_id >= r.event_id""")
def select_all_join(spark, sf_dir):  # noqa: ANN001, ANN201
    s = events(spark, sf_dir, "event_id", "user_id", "event_type")
    return _kind(s, "purchase").left_join(_kind(s, "view")).where(lambda l, r: l.user_id == r.user_id).select_all().to_df()  # noqa: E741


@query("""SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY 1""")
def tumbling_final(spark, sf_dir):  # noqa: ANN001, ANN201
    w = events(spark, sf_dir).tumbling_window(lambda r: r.ts, "1 day")
    return w.select(lambda k, r: fields(start=k, n=agg.count(), total=agg.sum_(r.cents)), emit="final").to_df()


@query(f"""SELECT event_type, time_bucket(INTERVAL 6 HOUR, ts) AS start, CAST(sum({_CENTS}) OVER (PARTITION BY event_type, time_bucket(INTERVAL 6 HOUR, ts)
    ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM events""")
def tumbling_running(spark, sf_dir):  # noqa: ANN001, ANN201
    w = events(spark, sf_dir).group_by(lambda r: r.event_type).tumbling_window(lambda r: r.ts, "6 hours")
    return w.select(lambda k, r: fields(event_type=agg.any_(r.event_type), start=k, total=agg.sum_(r.cents))).to_df()


@query("""SELECT time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-05') AS start, count(*) AS n FROM events GROUP BY 1""")
def tumbling_offset(spark, sf_dir):  # noqa: ANN001, ANN201
    from .functions.time import week_offset

    w = events(spark, sf_dir).tumbling_window(lambda r: r.ts, "7 days", week_offset("monday"))
    return w.select(lambda k, r: fields(start=k, n=agg.count()), emit="final").to_df()


@query("""SELECT start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 10 MINUTE, ts) - i * INTERVAL 10 MINUTE FOR i IN range(6)]) AS start FROM events) GROUP BY 1""")
def sliding_final(spark, sf_dir):  # noqa: ANN001, ANN201
    w = events(spark, sf_dir).sliding_window(lambda r: r.ts, "1 hour", "10 minutes")
    return w.select(lambda k, r: fields(start=k, n=agg.count()), emit="final").to_df()


@query(f"""SELECT event_type, start, max(cents) AS top FROM (SELECT event_type, {_CENTS} AS cents,
    unnest([time_bucket(INTERVAL 12 HOUR, ts) - i * INTERVAL 12 HOUR FOR i IN range(2)]) AS start FROM events) GROUP BY ALL""")
def sliding_grouped(spark, sf_dir):  # noqa: ANN001, ANN201
    w = events(spark, sf_dir).group_by(lambda r: r.event_type).sliding_window(lambda r: r.ts, "1 day", "12 hours")
    return w.select(lambda k, r: fields(event_type=agg.any_(r.event_type), start=k, top=agg.max_(r.cents)), emit="final").to_df()


@query(f"""WITH e AS (SELECT user_id, event_id, time_bucket(INTERVAL 1 DAY, ts) AS start, {_CENTS} AS cents FROM events),
    m AS (SELECT user_id, start, max(cents) AS cents FROM e GROUP BY ALL)
    SELECT m.user_id, m.start, m.cents, min(e.event_id) AS event_id FROM m JOIN e USING (user_id, start, cents) GROUP BY ALL""")
def window_flatmap_maxby_last(spark, sf_dir):  # noqa: ANN001, ANN201
    w = events(spark, sf_dir, "user_id", "event_id", "cents", "ts").group_by(lambda r: r.user_id).tumbling_window(lambda r: r.ts, "1 day")
    out = w.flat_map(lambda k, s: s.max_by(lambda r: r.cents).last().map(lambda r: fields(user_id=r.user_id, start=k, cents=r.cents, event_id=r.event_id)))
    return out.to_df()


@query(f"""WITH e AS (SELECT event_id, event_type, {_CENTS} AS cents FROM events)
    SELECT event_id, CAST({" + ".join(f"coalesce(last_value(CASE WHEN event_type = '{t}' THEN cents END IGNORE NULLS) OVER w, 0)" for t in ("click", "view", "purchase", "signup", "error"))} AS BIGINT) AS total
    FROM e WINDOW w AS (ORDER BY event_id ROWS UNBOUNDED PRECEDING)""")
def record_window_sum_1(spark, sf_dir):  # noqa: ANN001, ANN201
    w = events(spark, sf_dir).group_by(lambda r: r.event_type).record_window(1)
    return _with_id(w.select(lambda r: fields(total=agg.sum_(r.cents))))


def _with_id(s: Stream) -> DataFrame:
    return s.df.select(F.col("_o0").alias("event_id"), *s.columns)


@query(f"""WITH e AS (SELECT event_id, event_type, user_id, {_CENTS} AS cents,
        {_CENTS} - coalesce(lag({_CENTS}, 3) OVER (PARTITION BY user_id, event_type ORDER BY event_id), 0) AS d,
        CASE WHEN row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) <= 3 THEN 1 ELSE 0 END AS c FROM events)
    SELECT event_id, CAST(sum(d) OVER w AS BIGINT) AS total, CAST(sum(c) OVER w AS BIGINT) AS n FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)""")
def record_window_sum_3(spark, sf_dir):  # noqa: ANN001, ANN201
    s = events(spark, sf_dir).group_by(lambda r: r.user_id)
    out = s.flat_map(lambda k, u: u.group_by(lambda r: r.event_type).record_window(3).select(lambda r: fields(total=agg.sum_(r.cents), n=agg.count())))
    return _with_id(out)


@query(f"""WITH e AS (SELECT *, {_CENTS} AS cents FROM events WHERE user_id < 10)
    SELECT a.event_id, (SELECT max(l.cents) FROM (SELECT max_by(b.cents, b.event_id) AS cents FROM e b WHERE b.user_id = a.user_id AND b.event_id <= a.event_id GROUP BY b.event_type) l) AS top,
    (SELECT min(l.cents) FROM (SELECT max_by(b.cents, b.event_id) AS cents FROM e b WHERE b.user_id = a.user_id AND b.event_id <= a.event_id GROUP BY b.event_type) l) AS bottom FROM e a""")
def record_window_max(spark, sf_dir):  # noqa: ANN001, ANN201
    g = events(spark, sf_dir).where(lambda r: r.user_id < 10).group_by(lambda r: r.user_id)
    out = g.flat_map(lambda k, u: u.group_by(lambda r: r.event_type).record_window(1).select(lambda r: fields(top=agg.max_(r.cents), bottom=agg.min_(r.cents))))
    return _with_id(out)


@query("""WITH e AS (SELECT * FROM events WHERE user_id < 10)
    SELECT a.event_id, (SELECT string_agg(l.x, ',' ORDER BY l.x) FROM (SELECT CAST(max(b.event_id) AS VARCHAR) AS x FROM e b WHERE b.user_id = a.user_id AND b.event_id <= a.event_id GROUP BY b.event_type) l) AS ids FROM e a""")
def record_window_apply(spark, sf_dir):  # noqa: ANN001, ANN201
    g = events(spark, sf_dir, "event_id", "user_id", "event_type").where(lambda r: r.user_id < 10).group_by(lambda r: r.user_id)

    def ids(rows: list[dict]) -> dict:
        return {"ids": ",".join(sorted(str(r["event_id"]) for r in rows))}

    return _with_id(g.flat_map(lambda k, u: u.group_by(lambda r: r.event_type).record_window(1).apply(ids, "ids string")))


_LATEST = f"""WITH e AS (SELECT event_id, user_id, event_type, {_CENTS} AS cents FROM events),
    m AS (SELECT *, max(cents) OVER (PARTITION BY user_id, event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS best FROM e),
    d AS (SELECT *, best - coalesce(lag(best) OVER (PARTITION BY user_id, event_type ORDER BY event_id), 0) AS d FROM m)
    SELECT event_id, user_id, CAST(sum(d) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM d"""


@query(_LATEST)
def nested_latest_sum(spark, sf_dir):  # noqa: ANN001, ANN201
    """For each user, the best record of each event type so far, summed at every event."""
    g = events(spark, sf_dir).group_by(lambda r: r.user_id)

    def body(key, user):  # noqa: ANN001, ANN202
        best = user.group_by(lambda r: r.event_type).map(lambda t, s: s.max_by(lambda r: r.cents, emit="all"))
        return best.record_window(1).select(lambda r: fields(user_id=agg.any_(r.user_id), total=agg.sum_(r.cents)))

    return _with_id(g.flat_map(body))


@query("SELECT event_type, count(DISTINCT user_id) AS users, CAST(sum(c) AS BIGINT) AS total FROM (SELECT event_type, user_id, max_by(CAST(round(value * 100) AS BIGINT), event_id) AS c FROM events GROUP BY ALL) GROUP BY event_type")
def unique_latest(spark, sf_dir):  # noqa: ANN001, ANN201
    g = events(spark, sf_dir).group_by(lambda r: r.event_type).unique(lambda r: r.user_id)
    return g.select(lambda k, r: fields(event_type=k, users=agg.count(), total=agg.sum_(r.cents)), emit="final").to_df()


@query(f"""WITH e AS (SELECT event_id, user_id, {_CENTS} AS cents, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events WHERE user_id < 40)
    SELECT event_id, CAST(sum(CASE WHEN n % 2 = 1 THEN cents ELSE -cents END) OVER (PARTITION BY user_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS BIGINT) AS balance FROM e""")
def scan_fold(spark, sf_dir):  # noqa: ANN001, ANN201
    """An alternating sum, which needs its own state."""

    def step(state: tuple[int, int], r: dict) -> tuple[tuple[int, int], dict]:
        n, total = state
        total += r["cents"] if n % 2 == 0 else -r["cents"]
        return (n + 1, total), {"event_id": r["event_id"], "balance": total}

    g = events(spark, sf_dir).where(lambda r: r.user_id < 40).group_by(lambda r: r.user_id)
    return g.flat_map(lambda k, s: s.scan((0, 0), step, "event_id bigint, balance bigint")).to_df()


@query(f"SELECT event_id, {_CENTS} AS cents, user_id FROM events WHERE user_id < 20 AND {_CENTS} > 0")
def reduce_keep(spark, sf_dir):  # noqa: ANN001, ANN201
    """A reduce that keeps each record as it is."""
    g = events(spark, sf_dir, "event_id", "cents", "user_id").where(lambda r: (r.user_id < 20) & (r.cents > 0)).group_by(lambda r: r.user_id)
    return g.flat_map(lambda k, s: s.reduce(lambda a, b: b)).to_df()


@query("SELECT CAST(i AS INTEGER) AS i FROM range(2, 11) t(i)")
def cycle_increment(spark, sf_dir):  # noqa: ANN001, ANN201
    start = Stream.of_list(spark, [(1,)], "i int")
    return cycle(start, lambda s: s.map(lambda r: fields(i=r.i + 1)).where(lambda r: r.i <= 10)).to_df()


@query("""SELECT l.event_id AS left_id, r.event_id AS right_id FROM (SELECT * FROM events WHERE event_type = 'purchase') l
    ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') r ON l.user_id = r.user_id AND l.event_id >= r.event_id""")
def lineage_left_join(spark, sf_dir):  # noqa: ANN001, ANN201
    a, b = _two(spark, sf_dir, "purchase", "click")
    records = a.left_join(b).where(lambda l, r: l.user_id == r.user_id).lineage("event_id", "event_id")  # noqa: E741

    def one(name: str):  # noqa: ANN202
        found = F.filter("sources", lambda x: x["stream"] == name)
        return F.try_element_at(found, F.lit(1))["record"].cast("bigint").alias(f"{name}_id")

    return records.select(one("left"), one("right"))


@query("""WITH l AS (SELECT * FROM events WHERE event_type = 'purchase' AND user_id < 15), r AS (SELECT * FROM events WHERE event_type <> 'purchase' AND user_id < 5)
    SELECT l.event_id, (SELECT count(*) FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM r WHERE r.event_id <= l.event_id) x WHERE n <= 2) AS held FROM l""")
def join_window_apply(spark, sf_dir):  # noqa: ANN001, ANN201
    s = events(spark, sf_dir, "event_id", "user_id", "event_type")
    left = s.where(lambda r: (r.event_type == "purchase") & (r.user_id < 15))
    right = s.where(lambda r: (r.event_type != "purchase") & (r.user_id < 5)).group_by(lambda r: r.user_id).record_window(2)
    return left.left_join(right).apply(lambda l, rs: {"event_id": l["event_id"], "held": len(rs)}, "event_id bigint, held bigint").to_df()  # noqa: E741


@query("SELECT user_id, time_bucket(INTERVAL 1 DAY, min(ts)) AS day, string_agg(event_type, '>' ORDER BY event_id) AS path FROM events WHERE user_id < 10 GROUP BY user_id, time_bucket(INTERVAL 1 DAY, ts)")
def time_window_apply(spark, sf_dir):  # noqa: ANN001, ANN201
    w = events(spark, sf_dir).where(lambda r: r.user_id < 10).group_by(lambda r: r.user_id).tumbling_window(lambda r: r.ts, "1 day")

    def path(rows: list[dict]) -> dict:
        return {"user_id": rows[0]["user_id"], "day": rows[0]["ts"].normalize(), "path": ">".join(r["event_type"] for r in rows)}

    return w.apply(path, "user_id bigint, day timestamp_ntz, path string").to_df()


@query("SELECT event_id, user_id AS inner_user, event_type AS inner_type, user_id < 75 AS small FROM events")
def nested_record(spark, sf_dir):  # noqa: ANN001, ANN201
    s = events(spark, sf_dir).map(lambda r: fields(event_id=r.event_id, rec=record(user=r.user_id, kind=r.event_type), pair=tuple_of(r.user_id, lit(75))))
    return s.map(
        lambda r: fields(event_id=r.event_id, inner_user=r.rec.get("user"), inner_type=r.rec.get("kind"), small=r.pair.get("_1") < r.pair.get("_2"))
    ).to_df()


@query(f"""SELECT event_id, ts + INTERVAL 90 MINUTE AS later, CAST(user_id AS VARCHAR) || '/' || event_type AS label, user_id + 7 AS back,
    CAST({_CENTS} AS DOUBLE) AS as_double, user_id = 5 OR NOT event_type = 'click' AS either, user_id >= 10 AND user_id <= 20 AS both_ways,
    CASE WHEN user_id > 50 THEN user_id + 1 ELSE -1 END AS option, user_id + {_CENTS} AS unpacked, user_id <= 50 AS missing,
    user_id > 50 OR (user_id = 50 AND event_id > 500) AS after, CASE WHEN {_CENTS} < 100 THEN 'low' ELSE CASE WHEN {_CENTS} < 1000 THEN 'mid' ELSE 'high' END END AS size,
    user_id <> 3 AS other FROM events""")
def expressions(spark, sf_dir):  # noqa: ANN001, ANN201
    """Literals, durations, conversions, comparisons, options, tuples and nested choices."""
    some = lambda r: if_else(r.user_id > 50, r.user_id, none_of("bigint"))
    return events(spark, sf_dir).map(
        lambda r: fields(
            event_id=r.event_id, later=r.ts + duration(5_400_000), label=r.user_id.to_string() + "/" + r.event_type,
            back=r.user_id.to_string().to_long() + 7, as_double=r.cents.to_double(), either=(r.user_id == 5) | ~(r.event_type == "click"),
            both_ways=(r.user_id >= 10) & (r.user_id <= 20), option=map_option(some(r), lambda v: v + 1, -1),
            unpacked=unpack(tuple_of(r.user_id, r.cents), 2, lambda a, b: a + b), missing=some(r).is_null(),
            after=tuple_of(r.user_id, r.event_id) > tuple_of(lit(50), lit(500)), size=if_else(r.cents < 100, "low", if_else(r.cents < 1000, "mid", "high")),
            other=r.user_id != 3,
        )
    ).to_df()


@query("SELECT date_trunc('week', ts)::TIMESTAMP AS week, count(*) AS n FROM events GROUP BY 1")
def week_window(spark, sf_dir):  # noqa: ANN001, ANN201
    """Windows of seven days that begin on Mondays."""
    w = events(spark, sf_dir).tumbling_window(lambda r: r.ts, "7 days", week_offset("monday"))
    return w.select(lambda start, r: fields(week=start, n=agg.count()), emit="final").to_df()


@query("""WITH s AS (SELECT event_id, user_id FROM events WHERE user_id < 5)
    SELECT l.event_id, (SELECT count(*) FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM s r WHERE r.event_id <= l.event_id) x WHERE n <= 2) AS held,
      (SELECT CAST(sum(event_id) AS BIGINT) FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM s r WHERE r.event_id <= l.event_id) x WHERE n <= 2) AS ids
    FROM s l""")
def record_window_flat_map(spark, sf_dir):  # noqa: ANN001, ANN201
    """After each record one record for each that the window holds, counted again by the arrival."""
    s = events(spark, sf_dir, "event_id", "user_id").where(lambda r: r.user_id < 5)
    held = s.group_by(lambda r: r.user_id).record_window(2).flat_map(
        lambda rows: [{"arrival": max(x["event_id"] for x in rows), "one": x["event_id"]} for x in rows], "arrival bigint, one bigint"
    )
    return held.group_by(lambda r: r.arrival).select(lambda k, r: fields(event_id=k, held=agg.count(), ids=agg.sum_(r.one)), emit="final").to_df()


_FILED = "o_orderkey bigint, o_orderpriority string, cents bigint, o_orderstatus string"


def _through(spark: SparkSession, sf_dir: str, form: CsvFormat | JsonFormat) -> DataFrame:
    """Orders through files in folders by status, and back."""
    folder = f"{shared_folder(spark)}/filed-{uuid.uuid4().hex}"
    s = orders(spark, sf_dir).map(lambda r: fields(o_orderkey=r.o_orderkey, o_orderpriority=r.o_orderpriority, cents=r.cents, o_orderstatus=r.o_orderstatus))
    PartitionedSink(folder, ("o_orderstatus",), form).write(s)
    inner = ", ".join(_FILED.split(", ")[:3])
    back = [
        FileSource(f"{folder}/o_orderstatus={k}", inner, form).stream(spark).to_df().withColumn("o_orderstatus", F.lit(k)) for k in ("F", "O", "P")
    ]
    return back[0].unionByName(back[1]).unionByName(back[2])


_FILED_SQL = """SELECT o_orderkey, o_orderpriority, CAST(round(o_totalprice * 100) AS BIGINT) AS cents, o_orderstatus
    FROM orders WHERE o_orderstatus IN ('F', 'O', 'P')"""


@query(_FILED_SQL)
def json_files(spark, sf_dir):  # noqa: ANN001, ANN201
    return _through(spark, sf_dir, JsonFormat())


@query(_FILED_SQL)
def csv_files(spark, sf_dir):  # noqa: ANN001, ANN201
    return _through(spark, sf_dir, CsvFormat())


@query("""SELECT CAST(i AS INTEGER) AS i, label, epoch_ms(CAST(ms AS BIGINT)) AS arrival
    FROM (VALUES (1, 'a', 0), (2, 'b', 250), (3, 'c', 1250)) t(i, label, ms)""")
def delayed_list(spark, sf_dir):  # noqa: ANN001, ANN201
    """Given records with pauses between them, with the times at which they would arrive."""
    df = DelayedListSource([(0, (1, "a")), (250, (2, "b")), (1000, (3, "c"))], "i int, label string").stream(spark).to_df()
    return df.withColumn("arrival", F.col("arrival").cast("timestamp_ntz"))


def _streamed(spark: SparkSession, sf_dir: str) -> Stream:
    """The events as a stream of files."""
    path = f"{sf_dir}/events.parquet"
    kind = spark.read.parquet(path).schema
    df = spark.readStream.schema(kind).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    df = df.withColumn("cents", F.round(F.col("value") * 100).cast("bigint"))
    return Stream.of_fields(df, "event_id", "event_id", "user_id", "event_type", "cents")


def _ended(spark: SparkSession, stream: Stream) -> DataFrame:
    """Everything that a streaming query gives for the files that are there."""
    folder = f"{shared_folder(spark)}/streamed-{uuid.uuid4().hex}"
    df = stream.to_df()
    q = df.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{folder}/rows")


@query(f"""SELECT event_id, user_id, CAST(sum({_CENTS}) OVER w AS BIGINT) AS total, count(*) OVER w AS n FROM events WHERE user_id < 30
    WINDOW w AS ({_RUN})""")
def streaming_running(spark, sf_dir):  # noqa: ANN001, ANN201
    g = _streamed(spark, sf_dir).where(lambda r: r.user_id < 30).group_by(lambda r: r.user_id)
    return _ended(spark, g.flat_map(lambda k, s: s.scan((0, 0), _count_cents, "event_id bigint, user_id bigint, total bigint, n bigint")))


def _count_cents(state: tuple[int, int], r: dict) -> tuple[tuple[int, int], dict]:
    total, n = state[0] + r["cents"], state[1] + 1
    return (total, n), {"event_id": r["event_id"], "user_id": r["user_id"], "total": total, "n": n}


@query("""SELECT l.event_id, l.user_id, r.event_id AS click_id
    FROM (SELECT * FROM events WHERE event_type = 'purchase') l
    ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') r ON l.user_id = r.user_id AND l.event_id >= r.event_id""")
def streaming_left_join(spark, sf_dir):  # noqa: ANN001, ANN201
    s = _streamed(spark, sf_dir)
    joined = _kind(s, "purchase").left_join(_kind(s, "click")).where(lambda l, r: l.user_id == r.user_id)  # noqa: E741
    return _ended(spark, joined.select(lambda l, r: fields(event_id=l.event_id, user_id=l.user_id, click_id=r.event_id)))  # noqa: E741
