"""Services: what a flow of (ts_ms, key, value) can be left-joined with. Each gives `right`, null for none. A null key is a
key like any other: it finds what is stored under null."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.semigroup import Semigroup
from ..functions.time import Batcher, Interval
from ..functions.time import hours as _hours
from .summing import join_same


class Service:
    def join(self, left: DataFrame) -> DataFrame:
        """left with a column `right`; one row for each row of left."""
        raise NotImplementedError


class UniqueService(Service):
    """(key, value) with one value per key at most, without time. Catalyst picks the join; small sides are broadcast
    by their measured size."""

    def __init__(self, table: DataFrame):
        self.table = table

    @staticmethod
    def of(source, spark, wanted: Interval, required: bool = False, then: Callable[[DataFrame], DataFrame] = lambda df: df) -> UniqueService:
        """From a ranged source's rows, which `then` turns into (key, value). required: the whole interval must be there."""
        got = source.satisfiable(wanted)
        if required and got != wanted:
            raise ValueError(f"{wanted} is not available: the source has {got}")
        return UniqueService(then(source.frame(spark, got)))

    def join(self, left: DataFrame) -> DataFrame:
        return join_same(left, self.table.select("key", F.col("value").alias("right")), ["key"], "left")


class EmptyService(Service):
    def __init__(self, kind: str = "string"):
        self.kind = kind

    def join(self, left: DataFrame) -> DataFrame:
        return left.withColumn("right", F.lit(None).cast(self.kind))


class ClampedService(Service):
    """A service that knows its log for an interval only. A job that joins with it runs over what clamp() leaves of its own
    interval; left rows outside the service's interval are left out."""

    def __init__(self, available: Interval, serve: Callable[[Interval], Service]):
        self.available, self.serve = available, serve

    def clamp(self, wanted: Interval) -> Interval:
        """The part of an interval that can be served, from its beginning on."""
        got = wanted & self.available
        return got if not got.empty and got.lower == wanted.lower else Interval(0, 0)

    def join(self, left: DataFrame) -> DataFrame:
        inside = left.where(self.available.condition())
        return self.serve(self.available).join(inside)


def _timeline(left: DataFrame, log: DataFrame, batcher: Batcher) -> DataFrame:
    """Left rows and log rows of each key on one line of time; at equal time a lookup comes before a write."""
    names = left.columns
    seq = F.col("seq").cast("long") if "seq" in log.columns else F.lit(0).cast("long")
    mine = left.select(F.struct(*names).alias("l_"), "key", "ts_ms", F.lit(0).alias("side_"), F.lit(0).cast("long").alias("seq_"))
    theirs = log.select("key", "ts_ms", F.lit(1).alias("side_"), seq.alias("seq_"), F.struct("ts_ms", F.col("value").alias("v")).alias("r_"))
    both = mine.unionByName(theirs, allowMissingColumns=True)
    return both.withColumn("bucket_", batcher.column(F.col("ts_ms")))


def _upto_now(line: DataFrame, total: Callable[[Column], Column], running: Callable[[Column, object], Column], carry: Callable[[Column, Column], Column]) -> DataFrame:
    """Left rows with `found_`: the running total of r_ over all earlier rows of the key.

    Taken within each (key, bucket), and carried between buckets through one row per bucket, an aggregate that combines
    on the map side, so a hot key is dealt out by time. Buckets that only have lookups get their carry too."""
    inside = Window.partitionBy("key", "bucket_").orderBy("ts_ms", "side_", "seq_").rowsBetween(Window.unboundedPreceding, -1)
    marked = line.withColumn("inside_", running(F.col("r_"), inside)).where("side_ = 0")
    ends = line.groupBy("key", "bucket_").agg(total(F.col("r_")).alias("end_"))
    earlier = Window.partitionBy("key").orderBy("bucket_").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("key", "bucket_", running(F.col("end_"), earlier).alias("carried_"))
    out = join_same(marked, carried, ["key", "bucket_"], "inner")
    return out.withColumn("found_", carry(F.col("carried_"), F.col("inside_")))


class AsOfService(Service):
    """A log (ts_ms, key, value[, seq]): the value written last before each lookup; a null value deletes. Of writes at one
    time the one of the greatest seq is the last.

    snapshot (key, value) holds what was known up to snapshot_ms."""

    def __init__(self, log: DataFrame, batcher: Batcher | None = None, snapshot: DataFrame | None = None, snapshot_ms: int | None = None, window_ms: int | None = None):
        self.log, self.batcher, self.window_ms = log, batcher or _hours(24), window_ms
        if snapshot is not None:
            start = snapshot.select(F.lit(snapshot_ms).cast("long").alias("ts_ms"), "key", "value")
            self.log = log.unionByName(start, allowMissingColumns=True)

    def join(self, left: DataFrame) -> DataFrame:
        line = _timeline(left, self.log, self.batcher)
        # the struct is not null where a value was deleted, so an older value can't come back
        newest = lambda r: F.max_by(r, F.when(r.isNotNull(), F.struct("ts_ms", "seq_")))
        out = _upto_now(line, newest, lambda r, w: F.last(r, ignorenulls=True).over(w), lambda a, b: F.coalesce(b, a))
        right = F.col("found_")["v"]
        if self.window_ms is not None:
            age = F.col("ts_ms") - F.col("found_")["ts_ms"]
            right = F.when((age > 0) & (age < self.window_ms), right)
        return out.select("l_.*", right.alias("right"))

    @staticmethod
    def of_store_and_sink(store, sink, wanted: Interval, schema) -> AsOfService:
        """A store's last snapshot before an interval, and a sink's log of what was written in it: (ts_ms, seq, key, value)."""
        first = store.batcher.covered_by(wanted).first
        found = store.read_last(first)
        log = sink.read(wanted, schema)
        if found is None:
            return AsOfService(log, store.batcher)
        return AsOfService(log, store.batcher, found[1].select("key", "value"), store.batcher.latest(found[0]))


class WindowService(AsOfService):
    """As-of, but a value serves only lookups less than window_ms after it, and none at its own time."""

    def __init__(self, log: DataFrame, batcher: Batcher, window_ms: int):
        super().__init__(log, batcher, window_ms=window_ms)


class DeltaService(Service):
    """A log of deltas: the sum of a key's deltas before each lookup, on top of a snapshot: (key, value), which is lifted, or
    (key, total) as a store holds it."""

    def __init__(self, log: DataFrame, batcher: Batcher, semigroup: Semigroup, snapshot: DataFrame | None = None):
        if semigroup.sketch is not None:
            raise ValueError("a sketch has no totals by record")
        self.log, self.batcher, self.semigroup, self.snapshot = log, batcher, semigroup, snapshot

    def join(self, left: DataFrame) -> DataFrame:
        s = self.semigroup
        line = _timeline(left, self.log, self.batcher)
        line = line.withColumn("r_", F.when(F.col("side_") == 1, s.lift(F.col("r_")["v"], F.col("ts_ms"), F.col("seq_"))))
        out = _upto_now(line, s.total, s.running, s.add)
        if self.snapshot is not None:
            start = F.col("total") if "total" in self.snapshot.columns else s.lift(F.col("value"), F.lit(0).cast("long"), F.lit(0).cast("long"))
            out = join_same(out, self.snapshot.select("key", start.alias("start_")), ["key"], "left").withColumn("found_", s.add(F.col("start_"), F.col("found_")))
        return out.select("l_.*", s.present(F.col("found_")).alias("right"))


class StoreService(DeltaService):
    """A store that another flow sums into, as a service: its last snapshot and the deltas since, up to each lookup."""

    def __init__(self, store, before_batch: int | None, flow: DataFrame):
        found = None if before_batch is None else store.last_version(before_batch)
        log = flow if found is None else flow.where(F.col("ts_ms") > store.batcher.latest(found - 1))
        super().__init__(log, store.batcher, store.semigroup, None if found is None else store.read_raw(found))


class ReadableService(Service):
    """Anything that gives a (key, value) DataFrame when asked, such as a hybrid read; asked again for each join."""

    def __init__(self, factory: Callable[[DataFrame], DataFrame]):
        self.factory = factory

    def join(self, left: DataFrame) -> DataFrame:
        return UniqueService(self.factory(left.select("key").distinct())).join(left)


def loop_join(left: DataFrame, expand: Callable, plus: Callable, total_type: str, initial: DataFrame | None = None) -> DataFrame:
    """A join with the store that its own result is summed into: (key, ts_ms, seq, value, right, delta).

    Per key, in order of (ts_ms, seq): right is the total so far, expand(value, right) gives the deltas, and plus
    adds them to the total. Sequential per key by nature: one task handles a key. A value that expands to nothing
    keeps its row, with delta null, and the total stays.
    """
    kinds = dict(left.dtypes)
    rows = left.select("key", "ts_ms", "seq", "value")
    if initial is not None:
        rows = join_same(rows, initial.select("key", F.col("value").alias("initial")), ["key"], "left")
    else:
        rows = rows.withColumn("initial", F.lit(None).cast(total_type))

    def none(x):
        return None if x is None or x is pd.NA or (isinstance(x, float) and x != x) else x

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["ts_ms", "seq"])
        total, out = none(p["initial"].iloc[0]), []
        for key, ts, seq, value in zip(p["key"], p["ts_ms"], p["seq"], p["value"], strict=True):
            seen = total
            some = list(expand(value, seen))
            for d in some:
                out.append((key, ts, seq, value, seen, d))
                total = d if total is None else plus(total, d)
            if not some:
                out.append((key, ts, seq, value, seen, None))
        return pd.DataFrame(out, columns=["key", "ts_ms", "seq", "value", "right", "delta"], dtype=object)

    return rows.groupBy("key").applyInPandas(run, f"key {kinds['key']}, ts_ms long, seq long, value {kinds['value']}, right {total_type}, delta {total_type}")
