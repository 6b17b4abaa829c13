"""Event time in milliseconds, half-open intervals of it, and batchers that deal it into numbered batches.

Each batcher has a Python form for planning and a Column form for data; the two agree everywhere.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND, MINUTE, HOUR, DAY = 1000, 60_000, 3_600_000, 86_400_000


def to_ms(col: Column | str, kind: str = "timestamp") -> Column:
    """Milliseconds of a timestamp column (with or without zone), rounded down; integers pass unchanged."""
    c = F.col(col) if isinstance(col, str) else col
    return c.cast("long") if kind in ("bigint", "int", "long") else F.unix_millis(c.cast("timestamp"))


def floor_div(a: Column, n: int) -> Column:
    """Whole-number division that rounds down; `div` rounds towards zero."""
    d = F.lit(n).cast("long")
    return ((a - F.pmod(a, d)) / d).cast("long")


@dataclass(frozen=True)
class Interval:
    """lower <= t < upper; None is unbounded. Interval(0, 0) and the like are empty."""

    lower: int | None = None
    upper: int | None = None

    @property
    def empty(self) -> bool:
        return self.lower is not None and self.upper is not None and self.lower >= self.upper

    def __contains__(self, t: int) -> bool:
        return (self.lower is None or t >= self.lower) and (self.upper is None or t < self.upper)

    def __and__(self, other: Interval) -> Interval:
        low = [x for x in (self.lower, other.lower) if x is not None]
        high = [x for x in (self.upper, other.upper) if x is not None]
        return Interval(max(low, default=None), min(high, default=None))

    def condition(self, ts: str = "ts_ms") -> Column:
        """The filter on a column; it reaches the scan when the column does."""
        out = F.lit(True)
        if self.lower is not None:
            out = F.col(ts) >= self.lower
        if self.upper is not None:
            out = (F.col(ts) < self.upper) if self.lower is None else out & (F.col(ts) < self.upper)
        return out


@dataclass(frozen=True)
class Batches:
    """Batch ids from first to last, both included; None is unbounded."""

    first: int | None = None
    last: int | None = None

    @property
    def empty(self) -> bool:
        return self.first is not None and self.last is not None and self.last < self.first

    def __contains__(self, b: int) -> bool:
        return (self.first is None or b >= self.first) and (self.last is None or b <= self.last)

    def __iter__(self):
        if self.first is None or self.last is None:
            raise ValueError("batches without a bound can't be listed")
        return iter(range(self.first, self.last + 1))

    def condition(self, col: str = "batch_id") -> Column:
        out = F.lit(True)
        if self.first is not None:
            out = F.col(col) >= self.first
        if self.last is not None:
            out = out & (F.col(col) <= self.last)
        return out

    @staticmethod
    def of(ids: Iterable[int]) -> Batches | None:
        """The run that the ids fill; None where ids are missing between them."""
        known = sorted(set(ids))
        if not known:
            return Batches(0, -1)
        return Batches(known[0], known[-1]) if known[-1] - known[0] + 1 == len(known) else None


def batch_text(b: int) -> str:
    return f"BatchID.{b}"


def parse_batch(s: str) -> int:
    return int(s.removeprefix("BatchID."))


class Batcher:
    """batch_of and earliest are increasing, and batch_of(earliest(b)) is b."""

    def batch_of(self, ms: int) -> int:
        raise NotImplementedError

    def earliest(self, b: int) -> int | None:
        """The first millisecond of a batch; None if it has none."""
        raise NotImplementedError

    def column(self, ts: Column) -> Column:
        raise NotImplementedError

    def latest(self, b: int) -> int | None:
        after = self.earliest(b + 1)
        return None if after is None else after - 1

    def interval(self, b: int) -> Interval:
        return Interval(self.earliest(b), self.earliest(b + 1))

    def span(self, batches: Batches) -> Interval:
        return Interval(None if batches.first is None else self.earliest(batches.first), None if batches.last is None else self.earliest(batches.last + 1))

    def is_lower_edge(self, ms: int) -> bool:
        return self.batch_of(ms - 1) != self.batch_of(ms)

    def covered_by(self, i: Interval) -> Batches:
        """Batches that lie in the interval whole."""
        if i.empty:
            return Batches(0, -1)
        first = None if i.lower is None else self.batch_of(i.lower) + (not self.is_lower_edge(i.lower))
        return Batches(first, None if i.upper is None else self.batch_of(i.upper) - 1)

    def cover(self, i: Interval) -> Batches:
        """Batches that the interval touches."""
        if i.empty:
            return Batches(0, -1)
        return Batches(None if i.lower is None else self.batch_of(i.lower), None if i.upper is None else self.batch_of(i.upper - 1))

    def enclosed_by(self, b: int, other: Batcher) -> Batches:
        """Batches of another batcher that are needed to hold batch b."""
        return other.cover(self.interval(b))


@dataclass(frozen=True)
class FixedBatcher(Batcher):
    width: int

    def batch_of(self, ms: int) -> int:
        return ms // self.width

    def earliest(self, b: int) -> int:
        return b * self.width

    def column(self, ts: Column) -> Column:
        return floor_div(ts, self.width)


def minutes(n: int) -> Batcher:
    return FixedBatcher(n * MINUTE)


def hours(n: int) -> Batcher:
    return FixedBatcher(n * HOUR)


def days(n: int) -> Batcher:
    return FixedBatcher(n * DAY)


@dataclass(frozen=True)
class UnitBatcher(Batcher):
    """All time is batch 0; only an unbounded interval covers it."""

    def batch_of(self, ms: int) -> int:
        return 0

    def earliest(self, b: int) -> int | None:
        return None

    def column(self, ts: Column) -> Column:
        return F.lit(0).cast("long")

    def covered_by(self, i: Interval) -> Batches:
        return Batches(0, 0) if i.lower is None and i.upper is None else Batches(0, -1)

    def cover(self, i: Interval) -> Batches:
        return Batches(0, -1) if i.empty else Batches(0, 0)


@dataclass(frozen=True)
class CalendarBatcher(Batcher):
    """Runs of `count` local calendar days, rounded down on both sides of the epoch; days that daylight saving
    makes shorter or longer are still one day."""

    count: int
    zone: str = "UTC"

    def _local_day(self, ms: int) -> int:
        t = datetime.fromtimestamp(0, UTC) + timedelta(milliseconds=ms)
        return t.astimezone(ZoneInfo(self.zone)).date().toordinal() - datetime(1970, 1, 1).toordinal()

    def batch_of(self, ms: int) -> int:
        return self._local_day(ms) // self.count

    def earliest(self, b: int) -> int:
        day = datetime(1970, 1, 1, tzinfo=ZoneInfo(self.zone)).replace(tzinfo=None) + timedelta(days=b * self.count)
        at = day.replace(tzinfo=ZoneInfo(self.zone)).astimezone(UTC)
        return (at - datetime(1970, 1, 1, tzinfo=UTC)) // timedelta(milliseconds=1)

    def column(self, ts: Column) -> Column:
        local = F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(self.zone), F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), ts / F.lit(1000.0))))
        day = F.datediff(local, F.lit("1970-01-01").cast("date")).cast("long")
        return floor_div(day, self.count)


@dataclass(frozen=True)
class CombinedBatcher(Batcher):
    """One batcher before a time, another from it on; ids go on without a hole."""

    before: Batcher
    at: int
    after: Batcher

    @property
    def _first(self) -> int:
        return self.before.batch_of(self.at - 1) + 1

    def batch_of(self, ms: int) -> int:
        return self.before.batch_of(ms) if ms < self.at else self.after.batch_of(ms) - self.after.batch_of(self.at) + self._first

    def earliest(self, b: int) -> int | None:
        if b < self._first:
            return self.before.earliest(b)
        return self.at if b == self._first else self.after.earliest(b - self._first + self.after.batch_of(self.at))

    def column(self, ts: Column) -> Column:
        shift = self._first - self.after.batch_of(self.at)
        return F.when(ts < self.at, self.before.column(ts)).otherwise(self.after.column(ts) + F.lit(shift).cast("long"))
