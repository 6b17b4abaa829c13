"""Random programs: each is a graph of operators over rows (time, key, value), run as a batch job in one or two runs and as a stream, and
compared with plain Python that does the same to lists."""

import random

import pytest
from pyspark.sql import functions as F

from tidefold.functions import semigroup as sg
from tidefold.functions import time as tm
from tidefold.functions.time import Interval
from tidefold.operators.flow import Flow
from tidefold.operators.run import Pair
from tidefold.operators.store import VersionedStore
from tidefold.plans.job import Job
from tidefold.sources import files
from tidefold.streaming.stream import DeltaStore

B25 = tm.FixedBatcher(25)
SCHEMA = "ts_ms long, seq long, key long, value long"


def mod(x, n):
    return F.pmod(x, F.lit(n))  # as Python's


OPS = {
    "map_values": (lambda f, n: f.map_values(lambda v: v * 2 + n), lambda r, n: [(t, k, v * 2 + n) for t, k, v in r]),
    "filter": (lambda f, n: f.filter(lambda v: mod(v, n + 2) != 0), lambda r, n: [x for x in r if x[2] % (n + 2) != 0]),
    "filter_keys": (lambda f, n: f.filter_keys(lambda k: k != n), lambda r, n: [x for x in r if x[1] != n]),
    "flat_map_values": (lambda f, n: f.flat_map_values(lambda v: F.when(mod(v, 3) != 0, F.array(v, v + n))), lambda r, n: [(t, k, y) for t, k, v in r if v % 3 != 0 for y in (v, v + n)]),
    "flat_map_keys": (lambda f, n: f.flat_map_keys(lambda k: F.array(k, k + n + 1)), lambda r, n: [(t, y, v) for t, k, v in r for y in (k, k + n + 1)]),
    "map_keys": (lambda f, n: f.map_keys(lambda k: mod(k, n + 2)), lambda r, n: [(t, k % (n + 2), v) for t, k, v in r]),
    "swap": (lambda f, n: f.swap().map_keys(lambda k: mod(k, 4)), lambda r, n: [(t, v % 4, k) for t, k, v in r]),
    "option_map": (lambda f, n: f.option_map(lambda v: F.when(v > n, v - n)), lambda r, n: [(t, k, v - n) for t, k, v in r if v > n]),
    "collect_values": (lambda f, n: f.collect_values(lambda v: mod(v, 2) == n % 2, lambda v: -v), lambda r, n: [(t, k, -v) for t, k, v in r if v % 2 == n % 2]),
    "name": (lambda f, n: f.name(f"step {n}", reducers=n + 1), lambda r, n: r),
}


def make(seed):
    """(steps): each step is (operator, number, inputs) over the earlier steps; step 0 is the source."""
    r, steps = random.Random(seed), []
    for k in range(1, r.randint(4, 8)):
        steps.append(("merge", 0, (r.randrange(k), r.randrange(k))) if r.random() < 0.3 else (r.choice(sorted(OPS)), r.randint(0, 3), (k - 1 if r.random() < 0.6 else r.randrange(k),)))
    return steps


def evaluate(steps, start, apply, merge):
    out = [start]
    for name, n, inputs in steps:
        out.append(merge(out[inputs[0]], out[inputs[1]]) if name == "merge" else apply(name, out[inputs[0]], n))
    return out


def rows(n=120):
    r = random.Random(7)
    return [(r.randrange(100), s, r.randrange(5), r.randrange(-9, 30)) for s in range(n)]


def expected(result):
    out = {}
    for t, k, v in result:
        out[k, t // 25] = out.get((k, t // 25), 0) + v
    return out


@pytest.mark.parametrize("seed", range(4))
def test_random_programs_match_lists_on_both_platforms(spark, tmp_path, seed):
    steps, data = make(seed), rows()
    lists = evaluate(steps, [(t, k, v) for t, _, k, v in data], lambda name, x, n: OPS[name][1](x, n), lambda a, b: a + b)
    tails = sorted({len(steps), len(steps) - 1, len(steps) // 2})
    offline = {k: VersionedStore(spark, f"{tmp_path}/off{k}", B25, sg.sum_, initial_batch=0) for k in tails}
    online = {k: DeltaStore(spark, f"{tmp_path}/on{k}", B25, sg.sum_) for k in tails}

    def program(f):
        source = Flow(f["n"].select("ts_ms", "seq", "key", "value")).map_values(lambda v: v)
        flows, out = evaluate(steps, source, lambda name, x, n: OPS[name][0](x, n), lambda a, b: a + b), None
        for k in tails:
            summed = flows[k].sum_by_key(Pair(offline[k], online[k]))
            out = summed if out is None else out.also(summed)
        return out

    for part in range(2):
        spark.createDataFrame(data[part::2], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    batch = files.Source(lambda s, _: s.read.schema(SCHEMA).parquet(f"{tmp_path}/in"), "ts_ms", "bigint", "seq")
    stream = files.stream(f"{tmp_path}/in", SCHEMA, "ts_ms", max_files=1, ts_type="bigint", seq="seq")
    job = Job(program, {"n": batch}, {"n": stream})
    for a, b in [(0, 100)] if seed % 2 else [(0, 50), (50, 100)]:
        job.run(spark, Interval(a, b))
    for q in job.start(spark, f"{tmp_path}/check", available_now=True):
        q.awaitTermination()
    for k in tails:
        want, total = expected(lists[k]), {}
        for (key, _), v in want.items():
            total[key] = total.get(key, 0) + v
        assert {r["key"]: r["value"] for r in offline[k].totals(3).collect()} == total, steps
        held = online[k].read()
        assert {(r["key"], r["batch_id"]): r["delta"] for r in held.collect()} == want, steps
