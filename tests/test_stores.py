import pytest
from pyspark.sql import functions as F

from tidefold.functions import semigroup as sg
from tidefold.functions import time as tm
from tidefold.functions.time import Interval
from tidefold.operators.flow import Flow
from tidefold.operators.sink import BatchedSink, ConvertedSink, EpochSink, FunctionSink, NoSink
from tidefold.operators.store import NothingToDo, VersionedStore
from tidefold.plans.counters import Counters
from tidefold.plans.job import Job, dot, main
from tidefold.plans.state import CheckpointState, Refused
from tidefold.sources import files
from tidefold.streaming import client
from tidefold.streaming.stream import DeltaStore, presenting, start_sink, start_sum

B20 = tm.FixedBatcher(20)
SCHEMA = "ts_ms long, seq long, key long, value long"


def numbers(spark, n=100):
    return spark.createDataFrame([(t, t, t % 3, t) for t in range(n)], SCHEMA)


def totals(df):
    return {r["key"]: r["value"] for r in df.collect()}


def model(upto, n=100):
    out = {}
    for t in range(min(n, upto)):
        out[t % 3] = out.get(t % 3, 0) + t
    return out


def test_reruns_are_idempotent_and_catch_up(spark, tmp_path):
    a, b, c = (VersionedStore(spark, f"{tmp_path}/{x}", B20, sg.sum_, initial_batch=0) for x in "abc")
    df, all_ = numbers(spark), Interval(0, 100)
    for stores in ((a, b), (c, b), (c, b)):
        for s in stores:
            s.merge(df, all_).collect()
    assert a.versions() == b.versions() == c.versions() == [5]
    assert totals(a.totals(4)) == totals(b.totals(4)) == totals(c.totals(4)) == model(100)
    assert a.metadata(5)["end_ms"] == 100


def test_second_run_starts_at_the_snapshot(spark, tmp_path):
    s = VersionedStore(spark, f"{tmp_path}/s", B20, sg.sum_, initial_batch=0, keep=2)
    df = numbers(spark)
    first = s.merge(df, Interval(0, 45)).collect()  # the third batch is not whole
    assert s.versions() == [2] and {r["batch_id"] for r in first} == {0, 1}
    wanted = Interval(40, 100)
    assert s.needed(wanted) == Interval(40, 100)
    out = s.merge(df.where(s.needed(wanted).condition()), wanted, select=[2, 3]).collect()
    assert s.versions() == [2, 3, 4, 5]
    s.expire()
    assert s.versions() == [4, 5]
    for r in out:
        assert r["prev"] == model(20 * r["batch_id"])[r["key"]]
    assert totals(s.totals(3)) == model(80)
    assert s.read_last(5)[0] == 4 and s.read_last(4)[0] == 3


def test_every_snapshot_holds_all_keys_and_pruning_is_for_writing(spark, tmp_path):
    df = spark.createDataFrame([(1, 0, 7, 5), (25, 0, 8, 6), (45, 0, 7, 1)], SCHEMA)
    s = VersionedStore(spark, f"{tmp_path}/s", B20, sg.sum_, initial_batch=0, prune=lambda k, v, t: (k == 7) & (v == 5))
    s.merge(df, Interval(0, 60), select=[0, 1]).collect()
    assert [totals(s.totals(b)) for b in range(3)] == [{}, {8: 6}, {7: 6, 8: 6}]


def test_store_refusals(spark, tmp_path):
    s = VersionedStore(spark, f"{tmp_path}/s", B20, sg.sum_, initial_batch=3)
    with pytest.raises(NothingToDo):
        s.merge(numbers(spark), Interval(61, 79))
    with pytest.raises(ValueError):
        s.merge(numbers(spark), Interval(0, 80))
    with pytest.raises(ValueError):
        s.read_last(2)


def test_batched_sink_reuses_what_is_there(spark, tmp_path):
    sink, df = BatchedSink(spark, f"{tmp_path}/s", B20), numbers(spark)
    assert sink.write(df, Interval(0, 50)).count() == 40
    other = df.withColumn("value", F.lit(-1).cast("long"))
    got = sink.write(other, Interval(0, 100))
    assert got.where("value = -1").count() == 60 and got.count() == 100
    seen = []
    assert FunctionSink(lambda x: seen.append(x.count())).write(df, Interval()).count() == 100 and seen == [100]
    assert ConvertedSink(NoSink(), lambda x: x.where("key = 1")).write(df, Interval()) is df


def test_checkpoint_state(spark, tmp_path):
    path = f"{tmp_path}/state"
    with pytest.raises(Refused):
        CheckpointState(spark, path, B20).begin()
    with pytest.raises(Refused):
        CheckpointState(spark, path, B20, 7).begin()
    s = CheckpointState(spark, path, B20, 0, 2)
    p = s.begin()
    with pytest.raises(Refused):
        CheckpointState(spark, path, B20, 0, 2).begin()  # another process
    assert p.requested == Interval(0, 40)
    with pytest.raises(Refused):
        s.begin()
    with pytest.raises(Refused):
        p.will_accept(Interval(20, 40))
    with pytest.raises(Refused):
        s.begin().will_accept(Interval(0, 25))
    s.begin().will_accept(Interval(0, 20)).succeed()
    again = s.begin()
    assert again.requested == Interval(20, 60)
    again.fail()
    with pytest.raises(Refused):
        CheckpointState(spark, path, B20, 60).begin()
    files.Files(spark).write(f"{path}/_other.version")
    assert CheckpointState(spark, path, B20).tokens() == [20]
    assert s.begin().requested == Interval(20, 60)  # and dies
    with pytest.raises(Refused):
        CheckpointState(spark, path, B20).begin()
    assert CheckpointState(spark, path, B20, takeover=True).begin().requested == Interval(20, 40)


def test_job_command_line_and_failure(spark, tmp_path):
    store = VersionedStore(spark, f"{tmp_path}/s", B20, sg.sum_, initial_batch=0)
    source = files.rows(spark, [(t, t % 3, t) for t in range(100)], "ts_ms long, k long, v long")
    job = Job(lambda f: Flow.source(f["n"], "ts_ms", "v", "k", ts_type="bigint").name("numbers").sum_by_key(store), {"n": source})
    argv = ["--state", f"{tmp_path}/state", "--batches", "2"]
    assert main(job, B20, [*argv, "--start-time", "0"]).upper == 40
    assert main(job, B20, argv).upper == 80
    assert totals(store.totals(3)) == model(80)
    broken = Job(lambda f: 1 / 0, {"n": source})
    with pytest.raises(ZeroDivisionError):
        main(broken, B20, argv)
    assert CheckpointState(spark, f"{tmp_path}/state", B20).tokens() == [40, 80]
    text = dot(Flow(numbers(spark)).map(lambda v: v).merge(Flow(numbers(spark))))
    assert text.startswith("digraph") and "merge" in text


def test_sources_give_what_they_have(spark, tmp_path):
    s = files.Source(lambda sp, _: numbers(sp), "ts_ms", "bigint", available=Interval(0, 50))
    assert s.frame(spark, Interval(10, 80)).count() == 40
    assert s.satisfiable(Interval(60, 80)).empty
    exact = files.Source(lambda sp, _: numbers(sp), "ts_ms", "bigint", available=Interval(0, 50), exact=True)
    with pytest.raises(ValueError):
        exact.frame(spark, Interval(10, 80))
    assert s.mapped(lambda d: d.where("key = 1")).frame(spark).count() == 33
    for day in ("1970/01/01", "1970/01/02", "1970/01/04"):
        numbers(spark, 5).write.parquet(f"{tmp_path}/{day}")
    paths = files.TimePaths(spark, f"{tmp_path}/{{:%Y/%m/%d}}")
    assert paths.satisfiable(Interval(0, 5 * tm.DAY)) == Interval(0, 2 * tm.DAY)
    assert paths.source(Interval(0, 5 * tm.DAY), "ts_ms", ts_type="bigint").frame(spark).count() == 10
    with pytest.raises(ValueError):
        paths.source(Interval(0, 5 * tm.DAY), "ts_ms", exact=True)
    with pytest.raises(ValueError):
        paths.satisfiable(Interval(0, None))


def test_counters_of_a_run_and_of_micro_batches(spark, tmp_path):
    c = Counters("job", odd=lambda: F.col("value") % 2 == 1)
    c.watch(numbers(spark)).write.format("noop").mode("overwrite").save()
    assert c.values == {"rows": 100, "odd": 50}
    for k in range(3):
        numbers(spark, 10).write.parquet(f"{tmp_path}/in/p={k}")
    online, c = DeltaStore(spark, f"{tmp_path}/online", B20, sg.sum_), Counters("stream", odd=lambda: F.col("value") % 2 == 1)
    stream = files.stream(f"{tmp_path}/in/*", SCHEMA, "ts_ms", max_files=1, ts_type="bigint", seq="seq")
    job = Job(lambda f: Flow(f["n"].select("ts_ms", "seq", "key", "value")).transform(c.watch).sum_by_key(online), streams={"n": stream})
    for q in job.start(spark, f"{tmp_path}/check", available_now=True):
        q.awaitTermination()
    assert c.values == {"rows": 30, "odd": 15}


def test_hybrid_read_adds_the_two_layers(spark):
    """Batch 20 is now, and four are kept: m has an offline total in the midst of them, n one that is older, p one right
    before now; q is online only, r is in neither, s and t can't be looked up."""
    offline = spark.createDataFrame([("m", 18, 100), ("n", 15, 200), ("p", 20, 300)], "key string, batch_excl long, total long")
    online = spark.createDataFrame([(k, b, 1 << b - 15) for k in "mnpq" for b in range(15, 22)] + [("t", 19, 5)], "key string, batch_id long, delta long")
    keys = spark.createDataFrame([(k,) for k in "mnpqrst"], "key string")
    failed, lost = (spark.createDataFrame([(k,)], "key string") for k in "st")
    got = {r["key"]: (r["value"], r["error"]) for r in client.read(keys, 20, sg.sum_, offline, online, keep=4, offline_failed=failed, online_failed=lost).collect()}
    assert {k: v for k, (v, _) in got.items()} == {"m": 100 + 8 + 16 + 32, "n": 200 + 4 + 8 + 16 + 32, "p": 300 + 32, "q": 4 + 8 + 16 + 32, "r": None, "s": None, "t": None}
    assert [k for k in "mnpqrst" if got[k][1]] == ["s", "t"]
    ahead = client.read(keys, 18, sg.sum_, offline, online, keep=4).where("key = 'p'").first()
    assert ahead["error"] and ahead["value"] is None
    old = client.read(keys, 20, sg.sum_, offline, online, keep=4, strict=True).where("key = 'n'").first()
    assert "missing" in old["error"]
    denied = client.read(keys, 20, sg.sum_, offline, online, keep=4, online_keys=lambda k: k != "m")
    assert {r["key"]: r["value"] for r in denied.collect()}["m"] == 100
    only = client.read(keys, 20, sg.sum_, None, online, keep=2)
    assert {r["key"]: r["value"] for r in only.collect()} == {"m": 48, "n": 48, "p": 48, "q": 48, "r": None, "s": None, "t": 5}


def test_client_merge_takes_batches_in_order(spark):
    offline = spark.createDataFrame([("a", 3, 100)], "key string, batch_excl long, total long")
    online = spark.createDataFrame([("a", 2, 7), ("a", 3, 1), ("b", 3, 5)], "key string, batch_id long, delta long")
    new = spark.createDataFrame([("a", 4, 10), ("a", 3, 20), ("b", 5, 1), ("c", 5, 2)], "key string, batch_id long, delta long")
    got = {(r["key"], r["batch_id"]): r["prev"] for r in client.merge(new, sg.sum_, offline, online).collect()}
    assert got == {("a", 3): 101, ("a", 4): 121, ("b", 5): 5, ("c", 5): None}


@pytest.mark.parametrize("parts", [1, 4])
def test_stream_and_batch_agree_at_every_split(spark, tmp_path, parts):
    df = numbers(spark)
    for k in range(parts):
        df.where(F.col("seq") % parts == k).coalesce(1).write.parquet(f"{tmp_path}/in/p={k}")
    online = DeltaStore(spark, f"{tmp_path}/online", B20, sg.sum_)
    published = []
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    after = presenting(online, lambda t: published.append(totals(t)))
    start_sum(stream.select("ts_ms", "seq", "key", "value"), online, f"{tmp_path}/check", available_now=True, after=after).awaitTermination()
    assert published[-1] == model(100)
    want = {(r["key"], r["batch_id"]): r["delta"] for r in Flow(df).sums(B20, sg.sum_).collect()}
    assert {(r["key"], r["batch_id"]): r["delta"] for r in online.read().collect()} == want
    epochs = [e for _, e in online.epochs()]
    online.add(df.where(F.col("seq") % parts == parts - 1) if parts > 1 else df, epochs[-1])  # the last micro-batch again
    online.compact()
    assert {(r["key"], r["batch_id"]): r["delta"] for r in online.read().collect()} == want
    store = VersionedStore(spark, f"{tmp_path}/offline", B20, sg.sum_, initial_batch=0)
    store.merge(df, Interval(0, 60)).collect()
    got = client.read(df.select("key"), 4, sg.sum_, store.for_client(5), online.read(), keep=5)
    assert totals(got) == model(100)


def test_one_program_on_both_platforms(spark, tmp_path):
    numbers(spark).write.parquet(f"{tmp_path}/in")
    store = DeltaStore(spark, f"{tmp_path}/store", B20, sg.count)
    program = lambda f: Flow.source(f["n"], "ts_ms", "value", "key", "seq", ts_type="bigint").filter(lambda v: v % 2 == 0).sum_by_key(store)
    stream = files.stream(f"{tmp_path}/in", SCHEMA, "ts_ms", ts_type="bigint", seq="seq")
    batch = files.Source(lambda sp, _: sp.read.parquet(f"{tmp_path}/in"), "ts_ms", "bigint", "seq")
    job = Job(program, {"n": batch}, {"n": stream})
    for q in job.start(spark, f"{tmp_path}/check", available_now=True):
        q.awaitTermination()
    streamed = sorted(store.read().collect())
    store2 = DeltaStore(spark, f"{tmp_path}/store2", B20, sg.count)
    store = store2
    job.run(spark, Interval())
    assert sorted(store2.read().collect()) == streamed
    start_sink(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), EpochSink(f"{tmp_path}/sink"), f"{tmp_path}/check2", True).awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/sink").count() == 100
