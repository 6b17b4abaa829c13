"""Jobs: planning, catching up, options by name, buffers and loops; and the streams of the same programs."""

import pytest
from pyspark.sql import functions as F

from tidefold.functions import semigroup as sg
from tidefold.functions import time as tm
from tidefold.functions.time import Interval
from tidefold.operators.flow import Flow
from tidefold.operators.run import Pair
from tidefold.operators.service import AsOfService, ClampedService, UniqueService
from tidefold.operators.sink import BatchedSink, Buffer, EpochSink, FunctionSink, StoreSink
from tidefold.operators.store import Metrics, VersionedStore
from tidefold.plans.job import Behind, Job, dot, main
from tidefold.sources import files
from tidefold.streaming.stream import DeltaStore

B20 = tm.FixedBatcher(20)
SCHEMA = "ts_ms long, seq long, key long, value long"


def source(n=100, **options):
    return files.Source(lambda s, _: s.createDataFrame([(t, t, t % 3, t) for t in range(n)], SCHEMA), "ts_ms", "bigint", "seq", **options)


def flow(frame):
    return Flow(frame.select("ts_ms", "seq", "key", "value"))


def store(spark, path, semigroup=sg.sum_, **options):
    return VersionedStore(spark, str(path), B20, semigroup, **({"initial_batch": 0} | options))


def totals(df):
    return {r["key"]: r["value"] for r in df.collect()}


def model(upto, since=0):
    out = {}
    for t in range(since, upto):
        out[t % 3] = out.get(t % 3, 0) + t
    return out


def test_a_store_that_is_behind_catches_up_or_refuses(spark, tmp_path):
    a, b, c = (store(spark, tmp_path / x) for x in "abc")
    job = lambda *stores: Job(lambda f: [flow(f["n"]).sum_by_key(s) for s in stores][-1], {"n": source()})
    job(a, b).run(spark, Interval(0, 60))
    job(c, b).run(spark, Interval(60, 100))
    assert totals(c.totals(4)) == totals(b.totals(4)) == model(100)
    job(c, b).run(spark, Interval(60, 100))
    assert c.versions() == [5] and b.versions() == [3, 5]
    job(a).run(spark, Interval(80, 100))  # a hole of one batch between the snapshot and the run
    assert totals(a.totals(4)) == model(100)
    late = store(spark, tmp_path / "late")
    with pytest.raises(Behind):
        Job(lambda f: flow(f["n"]).sum_by_key(late), {"n": source(available=Interval(40, 100))}).run(spark, Interval(60, 100))
    assert late.versions() == []


def test_a_sum_hands_on_what_its_store_held(spark, tmp_path):
    first, second, seen = store(spark, tmp_path / "a"), store(spark, tmp_path / "b", sg.count), []
    program = lambda f: flow(f["n"]).sum_by_key(first).write(FunctionSink(lambda df: seen.extend(df.collect()))).key_by(lambda v: v["delta"] % 2).sum_by_key(second)
    job = Job(program, {"n": source()})
    for a, b in ((0, 40), (40, 100)):
        job.run(spark, Interval(a, b))
    assert len(seen) == 15
    for r in seen:
        batch = r["ts_ms"] // 20
        assert r["value"]["prev"] == model(20 * batch).get(r["key"]) and r["value"]["delta"] == model(20 * batch + 20, 20 * batch)[r["key"]]
    deltas = [model(20 * b + 20, 20 * b)[k] % 2 for b in range(5) for k in range(3)]
    assert totals(second.totals(4)) == {k: deltas.count(k) for k in (0, 1)}


def test_a_chained_store_that_is_behind_is_fed_from_the_first(spark, tmp_path):
    first, second = store(spark, tmp_path / "a"), store(spark, tmp_path / "b")
    chained = lambda f: flow(f["n"]).sum_by_key(first).map_values(lambda v: v["delta"]).sum_by_key(second)
    Job(lambda f: flow(f["n"]).sum_by_key(first), {"n": source()}).run(spark, Interval(0, 60))
    Job(chained, {"n": source()}).run(spark, Interval(60, 100))
    assert totals(second.totals(4)) == totals(first.totals(4)) == model(100)


def test_options_by_the_nearest_name(spark, tmp_path):
    s = store(spark, tmp_path / "s")
    program = lambda f: flow(f["n"]).flat_map_values(lambda v: F.array(v)).name("inner", reducers=2).map(lambda v: v).sum_by_key(s).name("outer", reducers=3, shards=4)
    job = Job(program, {"n": source()}, options={"DEFAULT": {"reducers": 9, "grouping": "grouped"}, "outer": {"reducers": 5}})
    run, plan, out = job.plan({"n": source().frame(spark)})
    kinds = [n.kind for n in run.nodes]
    assert kinds == ["flat_map_values", "name", "map", "sum_by_key", "name"]
    assert [plan.option(k, "reducers") for k in range(4)] == [2, 2, 5, 5]  # what the job says goes before the program's own
    assert plan.option(0, "shards") == 4 and plan.option(0, "grouping") == "grouped" and plan.option(0, "other") is None
    text = dot(out, plan)
    assert "reducers=5" in text and "shards=4" in text
    job.run(spark, Interval(0, 100))
    assert totals(s.totals(4)) == model(100)


def test_what_several_read_is_computed_once(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def opaque(df):
        def run(batches):
            for b in batches:
                calls.add(b.num_rows)
                yield b

        return df.mapInArrow(run, df.schema)

    a, b = store(spark, tmp_path / "a"), store(spark, tmp_path / "b", sg.count)

    def program(f):
        shared = flow(f["n"]).transform(opaque)
        return shared.sum_by_key(a).also((shared + shared.map_values(lambda v: -v)).sum_by_key(b))

    Job(program, {"n": source()}).run(spark, Interval(0, 100))
    assert calls.value == 100
    assert totals(a.totals(4)) == model(100) and totals(b.totals(4)) == {0: 68, 1: 66, 2: 66}
    assert not spark._jsc.getPersistentRDDs()


def test_what_cant_be_planned_is_refused(spark, tmp_path):
    s = store(spark, tmp_path / "s")
    twice = Job(lambda f: flow(f["n"]).sum_by_key(s).also(flow(f["n"]).sum_by_key(s)), {"n": source()})
    with pytest.raises(ValueError, match="once"):
        twice.run(spark, Interval(0, 100))
    early = Job(lambda f: flow(f["n"]).left_join(s), {"n": source()})
    with pytest.raises(ValueError, match="before it joins"):
        early.run(spark, Interval(0, 100))

    def looped(f):
        other = store(spark, tmp_path / "t")
        summed = flow(f["n"]).sum_by_key(s)
        joined = flow(f["n"]).left_join(s).map_keys(lambda k: k + 1).map_values(lambda v: v["left"])
        return summed.also(joined.sum_by_key(other)).also(joined.sum_by_key(s))

    with pytest.raises(ValueError, match="only loop_join"):
        Job(looped, {"n": source()}).run(spark, Interval(0, 100))
    with pytest.raises(ValueError, match="numbers"):
        Job(lambda f: flow(f["n"]).loop_join(store(spark, tmp_path / "u", sg.set_of), lambda v, t: [v], "long"), {"n": source()}).run(spark, Interval(0, 100))
    with pytest.raises(ValueError, match="Job"):
        flow(source().frame(spark)).left_join(flow(source().frame(spark)), Buffer(spark, f"{tmp_path}/b"))
    with pytest.raises(ValueError):
        Job(lambda f: flow(f["n"]), {"n": source(available=Interval(50, 60))}).run(spark, Interval(0, 100))
    assert s.versions() == []


def test_hooks_metrics_and_intermediate_sums(spark, tmp_path):
    ended, metrics = [], Metrics()
    s, sink = store(spark, tmp_path / "s", metrics=metrics), EpochSink(f"{tmp_path}/sums")
    job = Job(lambda f: flow(f["n"]).sum_by_key(s), {"n": source()}, options={"DEFAULT": {"intermediate": sink}}, after=lambda run, e: ended.append((run.mode, run.wanted, e)))
    job.run(spark, Interval(0, 100))
    assert [(m, w, e) for m, w, e in ended] == [("batch", Interval(0, 100), None)]
    assert metrics.counts[s.path, "merge"] == metrics.counts[s.path, "write"] == 1
    got = {(r["key"], r["ts_ms"] // 20): r["value"] for r in spark.read.parquet(*sink.folders(spark)).collect()}
    assert got == {(k, b): model(20 * b + 20, 20 * b)[k] for k in range(3) for b in range(5)}
    bad = Job(lambda f: flow(f["n"]).write(FunctionSink(lambda df: 1 // 0)), {"n": source()}, after=lambda run, e: ended.append(type(e)))
    with pytest.raises(ZeroDivisionError):
        bad.run(spark, Interval(0, 100))
    assert ended[-1] is ZeroDivisionError
    assert s.find(lambda m: m["end_ms"] < 100) is None and s.find(lambda m: m["end_ms"] == 100) == 5


def test_a_clamped_service_bounds_the_run(spark, tmp_path):
    log = source().frame(spark).select("ts_ms", "seq", "key", "value")
    service, sink = ClampedService(Interval(0, 60), lambda i: AsOfService(log.where(i.condition()), B20)), EpochSink(f"{tmp_path}/out")
    job = Job(lambda f: flow(f["n"]).left_join(service).write(sink), {"n": source()})
    assert job.run(spark, Interval(0, 100)) == Interval(0, 60)
    got = {r["ts_ms"]: r["value"]["right"] for r in spark.read.parquet(*sink.folders(spark)).collect()}
    assert got == {t: t - 3 if t > 2 else None for t in range(60)}
    with pytest.raises(ValueError):
        job.run(spark, Interval(60, 100))
    with pytest.raises(ValueError):
        UniqueService.of(source(available=Interval(0, 50)), spark, Interval(0, 100), required=True)


def test_stores_of_deltas_fold_themselves_and_keep_writers_apart(spark, tmp_path):
    s = DeltaStore(spark, f"{tmp_path}/s", B20, sg.sum_, compact_every=2)
    df = flow(source().frame(spark)).df
    part = lambda k: df.where(F.col("seq") % 5 == k)
    s.add(part(0), 0, "x")
    s.add(part(1), 0, "y")  # the same number, another writer
    s.merge(part(2), Interval(0, 100))
    s.merge(part(2), Interval(0, 100))  # again
    s.add(part(3), 1, "x")
    out = s.add(part(4), 1, "y").collect()
    again = s.add(part(4), 1, "y").collect()
    assert sorted(out) == sorted(again)
    want = {(k, b): v for b in range(5) for k, v in model(20 * b + 20, 20 * b).items()}
    assert {(r["key"], r["batch_id"]): r["delta"] for r in s.read().collect()} == want
    assert all(r["prev"] + r["delta"] == want[r["key"], r["batch_id"]] for r in out)
    s.compact()
    assert {(r["key"], r["batch_id"]): r["delta"] for r in s.read().collect()} == want
    assert {w for w, _ in s.epochs()} == {"x", "y"} and len(s._bases()) == 1
    s.compact(oldest_batch=2)
    assert DeltaStore(spark, f"{tmp_path}/empty", B20, sg.sum_).read() is None
    assert totals(s.present(df)).keys() == {0, 1, 2}


def test_one_program_batch_and_stream_with_pairs(spark, tmp_path):
    source().frame(spark).write.parquet(f"{tmp_path}/in")
    offline, online = store(spark, tmp_path / "off"), DeltaStore(spark, f"{tmp_path}/on", B20, sg.sum_)
    newest = DeltaStore(spark, f"{tmp_path}/newest", tm.UnitBatcher(), sg.last)
    batched, epochs = BatchedSink(spark, f"{tmp_path}/batched", B20), EpochSink(f"{tmp_path}/epochs")
    program = lambda f: flow(f["n"]).write(Pair(batched, epochs)).write(StoreSink(newest)).sum_by_key(Pair(offline, online))
    stream = files.stream(f"{tmp_path}/in", SCHEMA, "ts_ms", ts_type="bigint", seq="seq")
    job = Job(program, {"n": source()}, {"n": stream})
    job.run(spark, Interval(0, 100))
    main(job, B20, ["--stream", f"{tmp_path}/check", "--available-now", "--shards", "2"])
    assert totals(offline.totals(4)) == totals(online.present(source().frame(spark))) == model(100)
    assert spark.read.parquet(*epochs.folders(spark)).count() == 100
    assert totals(newest.present(source().frame(spark))) == {0: 99, 1: 97, 2: 98}
    with pytest.raises(SystemExit):
        main(job, B20, [])
    with pytest.raises(TypeError):
        batched.add(source().frame(spark), "n", 0)


def test_intervals_that_a_probe_bounds(spark):
    for end in range(0, 60, 7):
        assert files.longest_prefix(Interval(3, 50), lambda i, end=end: i.upper <= end) == (Interval(3, min(end, 50)) if end > 3 else Interval(0, 0))
    s = source(probe=lambda i: i.upper is not None and i.upper <= 41)
    assert s.satisfiable(Interval(10, 100)) == Interval(10, 41) and not s.covers(Interval(0, 60)) and s.covers(Interval(0, 41))
    assert source(margin=5).frame(spark, Interval(10, 20)).count() == 10


def test_folders_of_months_and_years(spark, tmp_path):
    for month in ("2020/11", "2020/12", "2021/01", "2021/03"):
        spark.createDataFrame([(0, month)], "n long, m string").write.parquet(f"{tmp_path}/{month}")
    at = lambda s: int(spark.sql(f"SELECT unix_millis(timestamp '{s}')").first()[0])
    months = files.TimePaths(spark, f"{tmp_path}/{{:%Y/%m}}", "month")
    assert months.satisfiable(Interval(at("2020-11-10"), at("2021-05-01"))) == Interval(at("2020-11-10"), at("2021-02-01"))
    assert months.whole(Interval(at("2020-11-10"), at("2020-12-02"))) == Interval(at("2020-11-01"), at("2021-01-01"))
    assert months.whole(Interval(5, 5)).empty
    years = files.TimePaths(spark, f"{tmp_path}/{{:%Y}}", "year")
    assert years.satisfiable(Interval(at("2020-06-01"), at("2023-01-01"))) == Interval(at("2020-06-01"), at("2022-01-01"))
    assert [p[-4:] for p in years.paths(Interval(at("2020-06-01"), at("2021-06-01")))] == ["2020", "2021"]
