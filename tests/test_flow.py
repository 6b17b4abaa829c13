"""Flows against plain Python models of the same job."""

from collections import defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidefold.functions import semigroup as sg
from tidefold.functions import time as tm
from tidefold.operators.flow import Flow
from tidefold.operators.service import AsOfService, DeltaService, UniqueService, WindowService, loop_join

TEN = tm.FixedBatcher(10)
FLOWS = 30


def flow(spark, rows, value="long"):
    return Flow(spark.createDataFrame(rows, f"ts_ms long, seq long, key long, value {value}"))


def rows_strategy(values):
    return st.lists(st.tuples(st.integers(-25, 40), st.integers(0, 3), values), max_size=25).map(lambda r: [(t, s, k, v) for s, (t, k, v) in enumerate(r)])


def model(rows, plus, lift=lambda v: v):
    """(key, batch): (newest time, previous total, delta), values added in order of time."""
    out, total = {}, {}
    for t, s, k, v in sorted(rows):
        b = t // 10
        if (k, b) not in out:
            out[k, b] = [t, total.get(k), None]
        x = lift(v)
        out[k, b][0] = t
        out[k, b][2] = x if out[k, b][2] is None else plus(out[k, b][2], x)
        total[k] = x if k not in total else plus(total[k], x)
    return {k: tuple(v) for k, v in out.items()}


CASES = {
    "sum": (sg.sum_, "long", st.integers(-9, 9), lambda a, b: a + b, lambda v: v),
    "count": (sg.count, "long", st.integers(-9, 9), lambda a, b: a + b, lambda v: 1),
    "min": (sg.min_, "long", st.integers(-9, 9), min, lambda v: v),
    "max": (sg.max_, "long", st.integers(-9, 9), max, lambda v: v),
    "first": (sg.first, "long", st.integers(-9, 9), lambda a, b: a, lambda v: v),
    "last": (sg.last, "long", st.integers(-9, 9), lambda a, b: b, lambda v: v),
    "list": (sg.list_concat, "long", st.integers(-9, 9), lambda a, b: a + b, lambda v: [v]),
    "set": (sg.set_union, "array<long>", st.lists(st.integers(0, 5), max_size=3), lambda a, b: sorted({*a, *b}), lambda v: sorted(set(v))),
    "map": (sg.map_sum, "map<string,long>", st.dictionaries(st.sampled_from("abc"), st.integers(0, 5)), lambda a, b: {k: a.get(k, 0) + b.get(k, 0) for k in {*a, *b}}, lambda v: v),
    "custom": (sg.custom("join", lambda a, b: a + b, "string"), "string", st.sampled_from("abc"), lambda a, b: a + b, lambda v: v),
    "tuple": (sg.tuple_of(a=sg.min_, b=sg.average), "struct<a:long,b:long>", st.tuples(st.integers(0, 5), st.integers(0, 5)), None, None),
    "fold": (sg.fold("join", lambda a, b: F.concat(a, b)), "string", st.sampled_from("abc"), lambda a, b: a + b, lambda v: v),
}


@pytest.mark.parametrize("name", CASES)
def test_sum_by_key_matches_the_model(spark, name):
    semigroup, kind, values, plus, lift = CASES[name]

    # FLOWS drawn flows go through one Spark job, each with keys of its own
    @given(flows=st.lists(rows_strategy(values), min_size=FLOWS, max_size=FLOWS))
    @settings(max_examples=2, deadline=None, suppress_health_check=list(HealthCheck))
    def law(flows):
        rows = [(t, s, 10 * n + k, v) for n, own in enumerate(flows) for t, s, k, v in own]
        got = {(r["key"], r["batch_id"]): (r["ts_ms"], r["prev"], r["delta"]) for r in flow(spark, rows, kind).sums(TEN, semigroup).collect()}
        if plus is not None:
            assert got == model(rows, plus, lift)
            return
        want = model(rows, lambda a, b: (min(a[0], b[0]), a[1] + b[1], a[2] + b[2]), lambda v: (*v, 1))
        shown = lambda x: None if x is None else (x[0], x[1] / x[2])
        assert {k: (t, p and tuple(p), tuple(d)) for k, (t, p, d) in got.items()} == {k: (t, shown(p), shown(d)) for k, (t, p, d) in want.items()}

    law()


def test_record_granularity_telescopes(spark):
    rows = [(t * 7 % 30, s, s % 2, s) for s, t in enumerate(range(20))]
    got = flow(spark, rows).sums(TEN, sg.sum_, "record").collect()
    total = defaultdict(int)
    for r in sorted(got, key=lambda r: (r["ts_ms"], r["seq"])):
        assert (r["prev"] or 0) == total[r["key"]]
        total[r["key"]] += r["delta"]
    assert len(got) == len(rows)


@pytest.mark.parametrize("commutative", [False, True])
def test_python_semigroup_with_null_values_and_keys(spark, commutative):
    rows = [(1, 0, 1, 6), (2, 1, 1, 3), (3, 2, 1, None), (11, 3, 1, 4), (1, 4, None, 9), (2, 5, None, 1), (1, 6, 2, None)]
    xor = sg.custom("xor", lambda a, b: a ^ b, "long", commutative)
    got = {(r["key"], r["batch_id"]): (r["prev"], r["delta"]) for r in flow(spark, rows).sums(TEN, xor).collect()}
    assert got == {(1, 0): (None, 5), (1, 1): (5, 4), (None, 0): (None, 8), (2, 0): (None, None)}


def test_sketches(spark):
    rows = [(t, t, t % 2, t % 7) for t in range(60)]
    got = {r["key"]: (r["d"], list(r["q"])) for r in flow(spark, rows).sums(tm.UnitBatcher(), sg.approx_distinct).select("key", F.col("delta").alias("d")).join(flow(spark, rows).sums(tm.UnitBatcher(), sg.quantiles).select("key", F.col("delta").alias("q")), "key").collect()}
    assert got == {0: (7, [1, 3, 5]), 1: (7, [1, 3, 5])} or all(v[0] == 7 and 2 <= v[1][1] <= 4 for v in got.values())
    counts = flow(spark, rows).sums(tm.UnitBatcher(), sg.frequencies()).where("key = 0")
    assert counts.select(sg.frequency_of(F.col("delta"), F.lit(0).cast("long"))).first()[0] == 5
    assert counts.select(sg.frequency_of(F.col("delta"), F.lit(99).cast("long"))).first()[0] == 0
    with pytest.raises(ValueError):
        flow(spark, rows).sums(TEN, sg.approx_distinct, "record")
    assert sg.option(sg.custom("xor", lambda a, b: a ^ b, "long")).python


def test_rows_of_equal_time_are_ordered_by_value_where_no_order_is_given(spark):
    df = spark.createDataFrame([(1, 7, "b", {"x": 1}), (1, 7, "a", {"y": 2}), (1, 7, "c", {})], "t long, k long, v string, m map<string,long>")
    for value in ("v", "m"):
        one, two = (Flow.source(d, "t", value, "k", ts_type="bigint").df.select("seq", F.col("value").cast("string")).collect() for d in (df, df.orderBy(F.desc("v"))))
        assert sorted(one) == sorted(two) and len({r["seq"] for r in one}) == 3


def test_expanded_keys_equal_the_plain_plan(spark):
    rows = [(s, s, s % 4, s) for s in range(30)]
    expand = lambda k: F.array(k % 2, F.lit(9).cast("long"))
    a = flow(spark, rows).sums_of_expanded_keys(expand, TEN, sg.sum_)
    b = flow(spark, rows).flat_map_keys(expand).sums(TEN, sg.sum_).select("key", "batch_id", "ts_ms", "delta")
    assert sorted(a.collect()) == sorted(b.collect())
    plan = b._jdf.queryExecution().optimizedPlan().toString()
    assert plan.rindex("Aggregate") > plan.index("Generate")  # sums stand below the expansion
    later = flow(spark, rows).flat_map_keys(expand).map_values(lambda v: v * 2).sums(TEN, sg.sum_).select("key", (F.col("delta") / 2).cast("long").alias("delta"))
    assert sorted(later.collect()) == sorted(a.select("key", "delta").collect())
    with pytest.raises(ValueError):
        flow(spark, rows).sums_of_expanded_keys(expand, TEN, sg.list_concat)


def test_lookup_comes_before_write_at_equal_time_and_deletes_count(spark):
    log = spark.createDataFrame([(5, 0, 1, 10), (15, 0, 1, None), (25, 0, 1, 30)], "ts_ms long, seq long, key long, value long")
    left = flow(spark, [(5, 0, 1, 0), (6, 1, 1, 0), (15, 2, 1, 0), (16, 3, 1, 0), (26, 4, 1, 0), (99, 5, 1, 0), (50, 6, 2, 0)])
    got = {r["seq"]: r["value"]["right"] for r in left.left_join(AsOfService(log, TEN)).df.collect()}
    assert got == {0: None, 1: 10, 2: 10, 3: None, 4: 30, 5: 30, 6: None}
    got = {r["seq"]: r["value"]["right"] for r in left.left_join(WindowService(log, TEN, 11)).df.collect()}
    assert got == {0: None, 1: 10, 2: 10, 3: None, 4: 30, 5: None, 6: None}
    got = {r["seq"]: r["value"]["right"] for r in left.left_join(DeltaService(log, TEN, sg.sum_)).df.collect()}
    assert got == {0: None, 1: 10, 2: 10, 3: 10, 4: 40, 5: 40, 6: None}
    start = spark.createDataFrame([(1, 100), (2, 7)], "key long, value long")
    got = {r["seq"]: r["value"]["right"] for r in left.left_join(AsOfService(log, TEN, start, 0)).df.collect()}
    assert got == {0: 100, 1: 10, 2: 10, 3: None, 4: 30, 5: 30, 6: 7}


def test_unique_join_keeps_every_left_row(spark):
    rows = [(10, 0, 4, 7), (20, 1, 5, 8), (20, 2, 4, 9), (30, 3, 6, 1)]
    right = spark.createDataFrame([(5, "five"), (4, "four"), (9, "nine")], "key long, value string")
    got = sorted((r["ts_ms"], r["key"], r["value"]["left"], r["value"]["right"]) for r in flow(spark, rows).left_join(UniqueService(right)).df.collect())
    assert got == [(10, 4, 7, "four"), (20, 4, 9, "four"), (20, 5, 8, "five"), (30, 6, 1, None)]


def test_loop_join_keeps_its_total(spark):
    rows = [(1, 0, 1, 5), (2, 0, 1, 0), (3, 0, 1, 2), (1, 0, 2, 1)]
    expand = lambda v, total: [v, v] if v else []
    got = sorted((r["key"], r["ts_ms"], r["right"], r["delta"]) for r in loop_join(flow(spark, rows).df, expand, lambda a, b: a + b, "long").collect() if r["delta"] is not None)
    assert got == [(1, 1, None, 5), (1, 1, None, 5), (1, 3, 10, 2), (1, 3, 10, 2), (2, 1, None, 1), (2, 1, None, 1)]
    assert loop_join(flow(spark, rows).df, expand, lambda a, b: a + b, "long").where("delta is null").first()["right"] == 10


def test_set_operations(spark):
    a = flow(spark, [(1, 0, 1, 1), (2, 0, 2, 2)])
    assert a.merge(a).df.count() == 4
    e = a.values().either(a.keys())
    assert sorted(r["value"] for r in e.lefts().df.collect()) == [1, 2]
    assert sorted(r["value"] for r in e.rights().df.collect()) == [1, 2]
    assert a.option_map(lambda v: F.when(v > 1, v)).df.count() == 1
    assert a.collect(lambda v: v < 2, lambda v: v * 5).df.first()["value"] == 5
    assert a.flat_map(lambda v: F.array().cast("array<long>")).df.count() == 0
    with pytest.raises(TypeError):
        a.values().map_keys(lambda k: k)
