from datetime import UTC, datetime
from zoneinfo import ZoneInfo

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidefold.functions import time as tm
from tidefold.functions.time import Batches, Interval

MS = st.integers(-(10**13), 10**13)
BATCHERS = [tm.FixedBatcher(1), tm.FixedBatcher(2), tm.minutes(22), tm.hours(1), tm.days(3), tm.CalendarBatcher(1), tm.CalendarBatcher(5, "America/New_York"), tm.CombinedBatcher(tm.days(1), 5 * tm.DAY, tm.hours(2)), tm.CombinedBatcher(tm.hours(2), 12345, tm.minutes(1))]


@pytest.mark.parametrize("b", BATCHERS)
@given(t=MS, u=MS)
@settings(max_examples=60, deadline=None)
def test_batcher_laws(b, t, u):
    k = b.batch_of(t)
    assert b.batch_of(b.earliest(k)) == k
    assert t in b.interval(k)
    assert b.earliest(k) <= t <= b.latest(k)
    if t <= u:
        assert k <= b.batch_of(u)
    assert b.is_lower_edge(b.earliest(k))


@pytest.mark.parametrize("b", BATCHERS)
@given(t=MS, n=st.integers(0, 10**10))
@settings(max_examples=60, deadline=None)
def test_intervals_and_batches(b, t, n):
    i = Interval(t, t + n)
    inside, around = b.covered_by(i), b.cover(i)
    if not inside.empty:
        s = b.span(inside)
        assert s.lower >= i.lower and s.upper <= i.upper
        assert b.earliest(inside.first - 1) < t and b.earliest(inside.last + 2) > t + n
    if n:
        s = b.span(around)
        assert s.lower <= i.lower and s.upper >= i.upper
    else:
        assert around.empty


@pytest.mark.parametrize("b", BATCHERS)
def test_column_and_python_forms_agree(spark, b):
    edges = [b.earliest(k) + e for k in (-1000, -3, -1, 0, 1, 2, 1000) for e in (-1, 0, 1)] + [5 * tm.DAY - 1, 5 * tm.DAY, 12344, 12345, -1, -2, 0, 1704067200123]
    df = spark.createDataFrame([(t,) for t in edges], "t long")
    for t, k in df.select("t", b.column(F.col("t"))).collect():
        assert k == b.batch_of(t), t


def test_literal_batches():
    one, two = tm.FixedBatcher(1), tm.FixedBatcher(2)
    assert [one.batch_of(-1), one.batch_of(-2)] == [-1, -2]
    assert [two.batch_of(t) for t in (-1, -2, -3)] == [-1, -1, -2]
    assert [two.earliest(-1), two.earliest(-2)] == [-2, -4]
    enclosed = [list(tm.minutes(22).enclosed_by(k, tm.hours(1))) for k in range(6)]
    assert enclosed == [[0], [0], [0, 1], [1], [1], [1, 2]]


def test_batches_and_texts():
    assert Batches.of([3, 1, 2]) == Batches(1, 3)
    assert Batches.of([1, 3]) is None
    assert Batches.of([]).empty
    assert list(Batches(2, 1)) == []
    assert tm.parse_batch(tm.batch_text(-7)) == -7
    assert (Interval(1, 5) & Interval(3, None)) == Interval(3, 5)
    assert (Interval(1, 3) & Interval(3, 9)).empty


def test_unit_batcher_needs_all_time():
    u = tm.UnitBatcher()
    assert u.covered_by(Interval(0, 10)).empty
    assert list(u.covered_by(Interval())) == [0]


def test_local_days_over_daylight_saving():
    b = tm.CalendarBatcher(1, "America/New_York")
    day = lambda *x: int(datetime(*x, tzinfo=ZoneInfo("America/New_York")).astimezone(UTC).timestamp() * 1000)
    k = b.batch_of(day(2024, 3, 10, 12))
    assert b.interval(k) == Interval(day(2024, 3, 10), day(2024, 3, 11))
    assert b.interval(k).upper - b.interval(k).lower == 23 * tm.HOUR
