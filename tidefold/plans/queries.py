"""One query per operator over whole tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import semigroup as sg
from ..functions import time as tm
from ..operators.flow import Flow
from ..operators.service import AsOfService, DeltaService, EmptyService, StoreService, UniqueService, WindowService, loop_join
from ..operators.sink import BatchedSink
from ..operators.store import VersionedStore
from ..plans.job import Job
from ..plans.state import CheckpointState
from ..sources.files import Source, shared_path
from ..streaming import client
from ..streaming.stream import DeltaStore, start_sum

DAY = tm.days(1)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
#: 2024-01-16, the middle of the events: a batch edge.
MIDDLE = 19738 * tm.DAY

E_SQL = "WITH e AS (SELECT user_id AS key, epoch_us(ts) // 1000 AS ts_ms, event_id AS seq, event_type, CAST(round(value * 100) AS BIGINT) AS cents, epoch_us(ts) // 1000 // 86400000 AS day FROM events)"
BEFORE = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def cents():
    return F.round(F.col("value") * 100).cast("long")


def events(spark: SparkSession, d: str, value=None, kind: str | None = None) -> Flow:
    """Events keyed by user."""
    df = _table(spark, d, "events")
    if kind:
        df = df.where(F.col("event_type") == kind)
    return Flow.source(df, "ts", cents() if value is None else value, key="user_id", seq="event_id")


def log(flow: Flow) -> DataFrame:
    return flow.df.select("ts_ms", "seq", "key", "value")


SUMS = E_SQL + f""", d AS (SELECT key, day AS batch_id, max(ts_ms) AS ts_ms, count(*) AS delta FROM e GROUP BY key, day)
SELECT key, batch_id, ts_ms, CAST(sum(delta) OVER (PARTITION BY key ORDER BY batch_id {BEFORE}) AS BIGINT) AS prev, delta FROM d"""


@query(SUMS)
def sum_by_key(spark, d):
    return events(spark, d).sums(DAY, sg.count)


@query(
    E_SQL + f""" SELECT key, ts_ms, seq, CAST(sum(cents) OVER (PARTITION BY key ORDER BY ts_ms, seq {BEFORE}) AS BIGINT) AS prev, cents AS delta FROM e"""
)
def sum_by_key_record(spark, d):
    return events(spark, d).sums(DAY, sg.sum_, "record")


@query("""SELECT word AS key, count(*) AS total FROM (
  SELECT unnest(string_split_regex(regexp_replace(lower(text), '[^a-z0-9 \\t\\n\\x0B\\f\\r]', '', 'g'), '[ \\t\\n\\x0B\\f\\r]+')) AS word FROM documents WHERE text IS NOT NULL)
WHERE word <> '' GROUP BY word""")
def word_count(spark, d):
    docs = _table(spark, d, "documents").where("text is not null")
    flow = Flow.source(docs, F.lit(0), "text", ts_type="bigint")
    space = "[ \\t\\n\\x0B\\f\\r]"
    words = flow.flat_map(lambda t: F.split(F.regexp_replace(F.lower(t), f"[^a-z0-9{space[1:]}", ""), f"{space}+")).filter(lambda w: w != "")
    return words.key_by(lambda w: w).sums(tm.UnitBatcher(), sg.count).select("key", F.col("delta").alias("total"))


@query(E_SQL + " SELECT key, ts_ms, cents * 2 AS value FROM e WHERE cents % 3 = 0 AND key % 2 = 0")
def map_filter_collect(spark, d):
    flow = events(spark, d).map(lambda v: v * 2).filter(lambda v: v % 6 == 0).collect_keys(lambda k: k % 2 == 0, lambda k: k)
    return flow.df.select("key", "ts_ms", "value")


@query(E_SQL + " SELECT key, ts_ms, CAST(cents // 10 AS BIGINT) AS value FROM e WHERE event_type = 'purchase' AND cents // 10 > 100")
def option_map(spark, d):
    flow = events(spark, d, kind="purchase").option_map(lambda v: F.when(tm.floor_div(v, 10) > 100, tm.floor_div(v, 10)))
    return flow.df.select("key", "ts_ms", "value")


@query(E_SQL + " SELECT ts_ms, unnest([cents, -cents]) AS value FROM e")
def flat_map(spark, d):
    return events(spark, d).values().flat_map(lambda v: F.array(v, -v)).df.select("ts_ms", "value")


@query(E_SQL + " SELECT unnest([key, -1]) AS key, ts_ms, cents AS value FROM e")
def flat_map_keys(spark, d):
    return events(spark, d).flat_map_keys(lambda k: F.array(k, F.lit(-1).cast("long"))).df.select("key", "ts_ms", "value")


@query(E_SQL + " SELECT key, unnest([cents % 7, cents % 11]) AS value FROM e WHERE cents % 2 = 1")
def flat_map_values(spark, d):
    return events(spark, d).filter_values(lambda v: v % 2 == 1).flat_map_values(lambda v: F.array(v % 7, v % 11)).df.select("key", "value")


@query(E_SQL + " SELECT key + 1 AS key, cents - 1 AS value FROM e WHERE key > 3 AND cents > 500")
def map_and_filter_keys_values(spark, d):
    flow = events(spark, d).filter_keys(lambda k: k > 3).map_keys(lambda k: k + 1).collect_values(lambda v: v > 500, lambda v: v).map_values(lambda v: v - 1)
    return flow.df.select("key", "value")


@query("SELECT l_partkey AS key, l_orderkey AS value FROM lineitem")
def swap_keys_values(spark, d):
    flow = Flow.source(_table(spark, d, "lineitem"), "l_shipdate", "l_partkey", key="l_orderkey")
    return flow.swap().df.select("key", "value")


@query("SELECT l_orderkey AS value FROM lineitem UNION ALL SELECT l_partkey FROM lineitem")
def keys_and_values(spark, d):
    flow = Flow.source(_table(spark, d, "lineitem"), "l_shipdate", "l_partkey", key="l_orderkey")
    return flow.keys().merge(flow.values()).df.select("value")


@query(E_SQL + " SELECT key, CAST(sum(x) AS BIGINT) AS total FROM (SELECT key, cents AS x FROM e WHERE event_type = 'purchase' UNION ALL SELECT key, 1 FROM e WHERE event_type = 'view') GROUP BY key")
def merge_sum(spark, d):
    both = events(spark, d, kind="purchase") + events(spark, d, F.lit(1).cast("long"), kind="view")
    return both.sums(tm.UnitBatcher(), sg.sum_).select("key", F.col("delta").alias("total"))


@query(E_SQL + " SELECT 'left' AS tag, cents AS l, CAST(NULL AS VARCHAR) AS r FROM e WHERE event_type = 'purchase' UNION ALL SELECT 'right', NULL, event_type FROM e WHERE event_type <> 'purchase'")
def either_split(spark, d):
    other = Flow.source(_table(spark, d, "events").where("event_type <> 'purchase'"), "ts", "event_type")
    both = events(spark, d, kind="purchase").values().either(other)
    return both.df.select("value.tag", F.col("value.left").alias("l"), F.col("value.right").alias("r"))


@query(E_SQL + " SELECT 'user' AS store, CAST(key AS VARCHAR) AS key, CAST(sum(cents) AS BIGINT) AS total FROM e GROUP BY key UNION ALL SELECT 'type', event_type, count(*) FROM e GROUP BY event_type")
def also_two_stores(spark, d):
    """One job that sums one flow into two stores; the flow is read once."""
    unit = tm.UnitBatcher()
    stores = {"user": VersionedStore(spark, shared_path(spark, "user"), unit, sg.sum_), "type": VersionedStore(spark, shared_path(spark, "type"), unit, sg.count)}

    def program(frames):
        flow = Flow.source(frames["events"], "ts_ms", F.struct("user_id", "event_type", cents().alias("cents")), seq="seq", ts_type="bigint")
        by_user = flow.key_by(lambda v: v["user_id"], lambda v: v["cents"]).sum_by_key(stores["user"])
        return by_user.also(flow.key_by(lambda v: v["event_type"]).sum_by_key(stores["type"]))

    Job(program, {"events": Source(lambda s, _: _table(s, d, "events"), "ts", seq="event_id")}).run(spark, tm.Interval())
    each = [s.totals(0).select(F.lit(n).alias("store"), F.col("key").cast("string").alias("key"), F.col("value").alias("total")) for n, s in stores.items()]
    return each[0].unionByName(each[1])


@query("SELECT o_orderkey AS value, o_custkey AS key, c_name AS joined FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def left_join_unique(spark, d):
    orders = Flow.source(_table(spark, d, "orders"), "o_orderdate", "o_orderkey", key="o_custkey")
    service = UniqueService(_table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("value")))
    return orders.left_join(service).df.select("key", F.col("value.left").alias("value"), F.col("value.right").alias("joined"))


@query("SELECT l_suppkey AS key, s_name AS value FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey AND s_nationkey < 12")
def lookup(spark, d):
    flow = Flow.source(_table(spark, d, "lineitem"), "l_shipdate", "l_suppkey")
    service = UniqueService(_table(spark, d, "supplier").where("s_nationkey < 12").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("value")))
    return flow.lookup(service).df.select("key", "value")


@query("SELECT user_id AS key, CAST(NULL AS VARCHAR) AS joined FROM events")
def left_join_empty(spark, d):
    return events(spark, d).left_join(EmptyService()).df.select("key", F.col("value.right").alias("joined"))


ASOF = E_SQL + """, l AS (SELECT * FROM e WHERE event_type = 'purchase'), r AS (SELECT * FROM e WHERE event_type = 'view')"""


@query(ASOF + " SELECT l.key, l.seq, r.cents AS joined FROM l ASOF LEFT JOIN r ON l.key = r.key AND l.ts_ms > r.ts_ms")
def lookup_asof(spark, d):
    service = AsOfService(log(events(spark, d, kind="view")), DAY)
    return events(spark, d, kind="purchase").left_join(service).df.select("key", "seq", F.col("value.right").alias("joined"))


@query(ASOF + " SELECT l.key, l.seq, CASE WHEN l.ts_ms - r.ts_ms < 7200000 THEN r.cents END AS joined FROM l ASOF LEFT JOIN r ON l.key = r.key AND l.ts_ms > r.ts_ms")
def lookup_windowed(spark, d):
    service = WindowService(log(events(spark, d, kind="view")), DAY, 2 * tm.HOUR)
    return events(spark, d, kind="purchase").left_join(service).df.select("key", "seq", F.col("value.right").alias("joined"))


RUNNING = E_SQL + f""", u AS (SELECT *, sum(CASE WHEN event_type = 'view' THEN cents END) OVER (PARTITION BY key ORDER BY ts_ms, CASE WHEN event_type = 'view' THEN 1 ELSE 0 END, seq {BEFORE}) AS s FROM e)
SELECT key, seq, CAST(s AS BIGINT) AS joined FROM u WHERE event_type = 'purchase'"""


@query(RUNNING)
def lookup_delta_sum(spark, d):
    service = DeltaService(log(events(spark, d, kind="view")), DAY, sg.sum_)
    return events(spark, d, kind="purchase").left_join(service).df.select("key", "seq", F.col("value.right").alias("joined"))


@query(RUNNING.replace("WHERE event_type = 'purchase'", f"WHERE event_type = 'purchase' AND ts_ms >= {MIDDLE}"))
def left_join_store(spark, d):
    """The store's snapshot of the first half, and the deltas after it."""
    views, purchases = events(spark, d, kind="view"), events(spark, d, kind="purchase")
    store = VersionedStore(spark, shared_path(spark, "views"), DAY, sg.sum_, initial_batch=0)
    store.merge(log(views), tm.Interval(0, MIDDLE))
    late = Flow(purchases.df.where(F.col("ts_ms") >= MIDDLE))
    return late.left_join(StoreService(store, DAY.batch_of(MIDDLE), log(views))).df.select("key", "seq", F.col("value.right").alias("joined"))


@query(ASOF + " SELECT l.key, l.seq, r.cents AS joined FROM l ASOF LEFT JOIN r ON l.key = r.key AND l.ts_ms > r.ts_ms")
def left_join_flow(spark, d):
    """A flow joined with another as of each row, by the default batcher."""
    left, right = events(spark, d, kind="purchase"), events(spark, d, kind="view")
    return left.left_join(right).df.select("key", "seq", F.col("value.right").alias("joined"))


def _double_until(value, total):
    return [value] if total is None or total < 10**12 else []


def _plus(a, b):
    return a + b


@query(E_SQL + f""" SELECT key, seq, CAST(sum(cents) OVER (PARTITION BY key ORDER BY ts_ms, seq {BEFORE}) AS BIGINT) AS joined, cents AS delta FROM e""")
def loop_join_sum(spark, d):
    out = loop_join(events(spark, d).df, _double_until, _plus, "long")
    return out.select("key", "seq", F.col("right").alias("joined"), "delta")


@query(E_SQL + " SELECT key, min(cents) AS lo, max(cents) AS hi, count(*) AS n, CAST(sum(cents) AS BIGINT) AS total FROM e GROUP BY key")
def min_max_tuple(spark, d):
    value = F.struct(*(cents().alias(n) for n in ("lo", "hi", "n", "total")))
    out = events(spark, d, value).sums(tm.UnitBatcher(), sg.tuple_of(lo=sg.min_, hi=sg.max_, n=sg.count, total=sg.sum_))
    return out.select("key", "delta.*")


@query(E_SQL + " SELECT key, day AS batch_id, arg_min(event_type, (ts_ms, seq)) AS opened, arg_max(event_type, (ts_ms, seq)) AS closed FROM e GROUP BY key, day")
def first_last(spark, d):
    value = F.struct(F.col("event_type").alias("opened"), F.col("event_type").alias("closed"))
    return events(spark, d, value).sums(DAY, sg.tuple_of(opened=sg.first, closed=sg.last)).select("key", "batch_id", "delta.*")


@query(E_SQL + " SELECT key, day AS batch_id, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS kinds FROM e GROUP BY key, day")
def set_union(spark, d):
    return events(spark, d, F.array("event_type")).sums(DAY, sg.set_union).select("key", "batch_id", F.array_join("delta", ",").alias("kinds"))


@query(E_SQL + " SELECT key, day AS batch_id, array_to_string(list(event_type ORDER BY ts_ms, seq), ',') AS kinds FROM e GROUP BY key, day")
def list_concat(spark, d):
    return events(spark, d, F.col("event_type")).sums(DAY, sg.list_concat).select("key", "batch_id", F.array_join("delta", ",").alias("kinds"))


@query(E_SQL + """, m AS (SELECT key, day, event_type, sum(cents) AS s FROM e GROUP BY ALL)
SELECT key, day AS batch_id, string_agg(event_type || '=' || CAST(s AS BIGINT), ',' ORDER BY event_type) AS totals FROM m GROUP BY key, day""")
def map_sum(spark, d):
    out = events(spark, d, F.create_map("event_type", cents())).sums(DAY, sg.map_sum)
    pairs = F.transform(F.array_sort(F.map_entries("delta")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return out.select("key", "batch_id", F.array_join(pairs, ",").alias("totals"))


@query(E_SQL + " SELECT key, CAST(sum(cents) AS DOUBLE) / count(*) AS mean FROM e GROUP BY key")
def average(spark, d):
    return events(spark, d).sums(tm.UnitBatcher(), sg.average).select("key", F.col("delta").alias("mean"))


@query(E_SQL + " SELECT key, CAST(sum(cents) AS BIGINT) AS total_cents FROM e GROUP BY key")
def decimal_sum(spark, d):
    out = events(spark, d, cents() / 100.0).sums(tm.UnitBatcher(), sg.decimal_sum())
    return out.select("key", (F.col("delta") * 100).cast("long").alias("total_cents"))


@query(E_SQL + " SELECT key, day AS batch_id, string_agg(substr(event_type, 1, 1), '' ORDER BY ts_ms, seq) AS path FROM e GROUP BY key, day")
def ordered_fold(spark, d):
    """A non-commutative sum: strings joined in order of time."""
    out = events(spark, d, F.substring("event_type", 1, 1)).sums(DAY, sg.fold("join", lambda a, b: F.concat(a, b)))
    return out.select("key", "batch_id", F.col("delta").alias("path"))


@query(E_SQL + " SELECT key, day AS batch_id, CAST(bit_xor(cents) AS BIGINT) AS x FROM e GROUP BY key, day")
def python_semigroup(spark, d):
    return events(spark, d).sums(DAY, sg.custom("xor", _xor, "long", commutative=True)).select("key", "batch_id", F.col("delta").alias("x"))


def _xor(a, b):
    return int(a) ^ int(b)


@query(E_SQL + ", a AS (SELECT key, day, count(*) AS n FROM e GROUP BY key, day) SELECT n AS key, count(*) AS total FROM a GROUP BY n")
def chained_sum(spark, d):
    """How many (user, day) pairs had n events: a sum of a sum's deltas."""
    first = events(spark, d).sum_by_key(DAY, sg.count)
    return first.values().key_by(lambda v: v["delta"]).sums(tm.UnitBatcher(), sg.count).select("key", F.col("delta").alias("total"))


@query(E_SQL + " SELECT k AS key, day AS batch_id, max(ts_ms) AS ts_ms, CAST(sum(cents) AS BIGINT) AS delta FROM (SELECT unnest([key % 3, -1]) AS k, day, ts_ms, cents FROM e) GROUP BY k, day")
def pre_aggregated_key_expansion(spark, d):
    return events(spark, d).sums_of_expanded_keys(lambda k: F.array(k % 3, F.lit(-1).cast("long")), DAY, sg.sum_)


def _upper(spark, d) -> int:
    last = _table(spark, d, "events").agg(F.max(tm.to_ms("ts"))).first()[0] or 0
    return DAY.earliest(DAY.batch_of(last) + 1)


@query(E_SQL + " SELECT key, CAST(sum(cents) AS BIGINT) AS value FROM e GROUP BY key")
def store_roll_forward(spark, d):
    """Two runs; the second starts from the first one's snapshot."""
    flow, upper = log(events(spark, d)), _upper(spark, d)
    store = VersionedStore(spark, shared_path(spark, "store"), DAY, sg.sum_, initial_batch=0)
    store.merge(flow, tm.Interval(0, MIDDLE))
    wanted = tm.Interval(MIDDLE, upper)
    store.merge(flow.where(store.needed(wanted).condition()), wanted)
    return store.totals(DAY.batch_of(upper) - 1)


@query(E_SQL + " SELECT key, CAST(sum(cents) AS BIGINT) AS value FROM e GROUP BY key HAVING key % 5 <> 0")
def store_pruned(spark, d):
    flow, upper = log(events(spark, d)), _upper(spark, d)
    store = VersionedStore(spark, shared_path(spark, "pruned"), DAY, sg.sum_, initial_batch=0, prune=lambda k, v, t: k % 5 == 0)
    store.merge(flow, tm.Interval(0, upper))
    return store.totals(DAY.batch_of(upper) - 1)


@query(SUMS + f" QUALIFY batch_id >= {DAY.batch_of(MIDDLE)}")
def store_emits(spark, d):
    """What a store's second run gives: totals before each batch, the snapshot included."""
    flow, upper = log(events(spark, d)), _upper(spark, d)
    store = VersionedStore(spark, shared_path(spark, "emits"), DAY, sg.count, initial_batch=0)
    store.merge(flow, tm.Interval(0, MIDDLE))
    return store.merge(flow, tm.Interval(MIDDLE, upper))


@query(E_SQL + " SELECT key, seq, cents AS value FROM e")
def batched_sink(spark, d):
    """The first half is on disk already when the whole is asked for."""
    flow, upper = events(spark, d).df, _upper(spark, d)
    sink = BatchedSink(spark, shared_path(spark, "sink"), DAY)
    lower = 19723 * tm.DAY
    sink.write(flow, tm.Interval(lower, MIDDLE))
    return sink.write(flow, tm.Interval(lower, upper)).select("key", "seq", "value")


@query(E_SQL + f" SELECT key, CAST(sum(cents) AS BIGINT) AS value FROM e WHERE ts_ms < {19723 * tm.DAY + 3 * 5 * tm.DAY} GROUP BY key")
def checkpointed_job(spark, d):
    """Three runs of five days each, every one begun where the last token ends."""
    store = VersionedStore(spark, shared_path(spark, "job"), DAY, sg.sum_, initial_batch=0)
    job = Job(lambda f: Flow.source(f["events"], "ts_ms", cents(), key="user_id", seq="event_id", ts_type="bigint").sum_by_key(store), {"events": Source(lambda s, _: _table(s, d, "events"), "ts", seq="event_id")})
    path, start = shared_path(spark, "state"), 19723 * tm.DAY
    for k in range(3):
        done = job.run_next(spark, CheckpointState(spark, path, DAY, start if not k else None, 5))
    return store.totals(DAY.batch_of(done.upper) - 1)


@query(E_SQL + " SELECT key, CAST(sum(cents) AS BIGINT) AS value FROM e GROUP BY key")
def hybrid_read(spark, d):
    """Events split at a batch edge into an offline snapshot and online deltas."""
    flow, upper = events(spark, d), _upper(spark, d)
    store = VersionedStore(spark, shared_path(spark, "offline"), DAY, sg.sum_, initial_batch=0)
    store.merge(log(flow), tm.Interval(0, MIDDLE))
    online = DeltaStore(spark, shared_path(spark, "online"), DAY, sg.sum_)
    online.merge(log(flow), tm.Interval(MIDDLE - 2 * tm.DAY, upper))
    now = DAY.batch_of(upper) - 1
    return client.read(flow.df.select("key"), now, sg.sum_, store.for_client(now + 1), online.read(), keep=60).select("key", "value")


@query(
    E_SQL + f""", t AS (SELECT key, day AS batch_id, sum(cents) AS s FROM e GROUP BY key, day)
SELECT key, batch_id, CAST(p AS BIGINT) AS prev, CAST(s AS BIGINT) AS delta FROM (SELECT *, sum(s) OVER (PARTITION BY key ORDER BY batch_id {BEFORE}) AS p FROM t) WHERE batch_id >= {DAY.batch_of(MIDDLE)}"""
)
def client_merge(spark, d):
    flow = log(events(spark, d))
    store = VersionedStore(spark, shared_path(spark, "offline"), DAY, sg.sum_, initial_batch=0)
    edge = DAY.batch_of(MIDDLE)
    store.merge(flow, tm.Interval(0, MIDDLE))
    sums = Flow(flow.where(F.col("ts_ms") >= MIDDLE)).sums(DAY, sg.sum_).select("key", "batch_id", "delta")
    return client.merge(sums, sg.sum_, store.for_client(edge), None, keep=60)


@query(E_SQL + " SELECT key, day AS batch_id, max(ts_ms) AS ts_ms, CAST(sum(cents) AS BIGINT) AS delta FROM e GROUP BY key, day")
def streaming_sum(spark, d):
    """A file stream summed into a delta store, micro-batch by micro-batch."""
    source = _table(spark, d, "events")
    stream = spark.readStream.schema(source.schema).parquet(f"{d}/events.parquet*")
    flow = Flow.source(stream, "ts", cents(), key="user_id", seq="event_id")
    store = DeltaStore(spark, shared_path(spark, "deltas"), DAY, sg.sum_)
    start_sum(flow.df, store, shared_path(spark, "checkpoint"), available_now=True).awaitTermination()
    store.compact()
    return store.read()


@query(
    """SELECT event_id, epoch_us(ts) // 1000 // 1320000 AS fixed, epoch_us(ts) // 1000 // 86400000 // 7 AS weeks,
CASE WHEN epoch_us(ts) // 1000 < 1705363200000 THEN epoch_us(ts) // 1000 // 86400000 ELSE epoch_us(ts) // 1000 // 3600000 - 473712 + 19738 END AS combined,
CAST(date_diff('day', DATE '1970-01-01', CAST((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS DATE)) AS BIGINT) AS local_day FROM events"""
)
def batchers(spark, d):
    ts = tm.to_ms("ts")
    return _table(spark, d, "events").select(
        "event_id",
        tm.minutes(22).column(ts).alias("fixed"),
        tm.CalendarBatcher(7).column(ts).alias("weeks"),
        tm.CombinedBatcher(DAY, MIDDLE, tm.hours(1)).column(ts).alias("combined"),
        tm.CalendarBatcher(1, "America/New_York").column(ts).alias("local_day"),
    )
