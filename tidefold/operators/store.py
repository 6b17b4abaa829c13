"""Versioned stores: immutable snapshots of totals per key, one per batch, and the walk that rolls them forward."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.semigroup import Semigroup
from ..functions.time import Batcher, Batches, Interval
from ..sources.files import Files
from .summing import deltas, with_previous


class Metrics:
    """How often stores were read, written and merged, by name; shared among stores on the driver."""

    def __init__(self) -> None:
        self.counts: Counter[tuple[str, str]] = Counter()

    def count(self, store: str, what: str) -> None:
        self.counts[store, what] += 1


class NothingToDo(ValueError):
    """No whole batch lies in the interval."""


class VersionedStore:
    """Snapshots under path/version=<n>, n being the first batch after the snapshot. A folder counts once Spark has
    committed it, and a version that exists is never written again, so reruns are idempotent.

    initial_batch: the store is empty before it. prune(key, total, latest_ms) drops rows from what is written only.
    keep: old versions beyond so many are deleted. metrics: counts what is done to the store.
    """

    def __init__(self, spark: SparkSession, path: str, batcher: Batcher, semigroup: Semigroup, initial_batch: int | None = None, keep: int | None = None, prune: Callable[[Column, Column, Column], Column] | None = None, metrics: Metrics | None = None):
        self.spark, self.path, self.batcher, self.semigroup = spark, path.rstrip("/"), batcher, semigroup
        self.initial_batch, self.keep, self.prune, self.files = initial_batch, keep, prune, Files(spark)
        self.metrics, self._held = metrics or Metrics(), []

    def versions(self) -> list[int]:
        names = [n for n in self.files.names(self.path) if n.startswith("version=")]
        return sorted(int(n[8:]) for n in names if self.files.exists(f"{self.path}/{n}/_SUCCESS"))

    def _folder(self, version: int) -> str:
        return f"{self.path}/version={version}"

    def read_raw(self, version: int) -> DataFrame:
        """(key, total) as the semigroup adds them."""
        self.metrics.count(self.path, "read")
        return self.spark.read.parquet(self._folder(version))

    def last_version(self, before: int) -> int | None:
        """The newest version of a batch under `before`."""
        known = [v for v in self.versions() if v - 1 < before]
        if known:
            return known[-1]
        if self.initial_batch is not None and before < self.initial_batch:
            raise ValueError(f"the store begins at batch {self.initial_batch}")
        return None

    def read_last(self, before: int) -> tuple[int, DataFrame] | None:
        """(batch, rows) of the newest snapshot of a batch under `before`; rows are (key, value)."""
        found = self.last_version(before)
        return None if found is None else (found - 1, self.totals(found - 1))

    def write_last(self, batch: int, totals: DataFrame) -> None:
        """Store (key, total) as the total up to and including a batch; skipped if it is there."""
        if batch + 1 in self.versions():
            return
        if self.prune is not None:
            at = self.batcher.latest(batch)
            totals = totals.where(~F.coalesce(self.prune(F.col("key"), self.semigroup.present(F.col("total")), F.lit(at)), F.lit(False)))
        totals.write.mode("overwrite").parquet(self._folder(batch + 1))
        self.metrics.count(self.path, "write")
        self.files.write(f"{self.path}/_meta/{batch + 1}.json", json.dumps({"version": batch + 1, "end_ms": self.batcher.earliest(batch + 1)}))

    def expire(self) -> None:
        """Delete all but the newest `keep` versions. merge() begins with it, as what it returns may read older ones."""
        for old in self.versions()[: -self.keep] if self.keep else []:
            self.files.delete(self._folder(old))

    def metadata(self, version: int) -> dict:
        return json.loads(self.files.read(f"{self.path}/_meta/{version}.json"))

    def find(self, accept: Callable[[dict], bool]) -> int | None:
        """The newest version whose metadata is accepted."""
        return next((v for v in reversed(self.versions()) if accept(self.metadata(v))), None)

    def annotate(self, version: int, **more) -> None:
        """Add to a version's metadata."""
        self.files.write(f"{self.path}/_meta/{version}.json", json.dumps(self.metadata(version) | more))

    def needed(self, wanted: Interval) -> Interval:
        """The interval of deltas that a merge up to wanted.upper must read: from the end of the last snapshot on."""
        batches = self._batches(wanted)
        start = self._start(batches)
        return Interval(None if start is None else self.batcher.earliest(start), wanted.upper)

    def _batches(self, wanted: Interval) -> Batches:
        batches = self.batcher.covered_by(wanted)
        if batches.empty:
            raise NothingToDo(f"no whole batch in {wanted}")
        if self.initial_batch is not None and batches.first is not None and batches.first < self.initial_batch:
            raise ValueError(f"the store begins at batch {self.initial_batch}")
        return batches

    def _start(self, batches: Batches) -> int | None:
        """The first batch that no snapshot before `batches` holds."""
        known = [] if batches.first is None else [v for v in self.versions() if v <= batches.first]
        return known[-1] if known else (self.initial_batch if self.initial_batch is not None else None)

    def merge(self, flow: DataFrame, wanted: Interval, select: Iterable[int] | None = None, reducers: int | None = None, expand: Callable[[Column], Column] | None = None) -> DataFrame:
        """Roll the store forward over the whole batches in `wanted` and return (key, batch_id, ts_ms, prev, delta) of
        those with data. flow (key, ts_ms, seq, value) must hold needed(wanted).

        select: batches to write besides the last. Every snapshot holds all keys, those without new data carried forward.
        expand: as deltas() takes it.
        """
        s, batches = self.semigroup, self._batches(wanted)
        self.metrics.count(self.path, "merge")
        self.release()
        self.expire()
        start = self._start(batches)
        known = None if start is None or start not in self.versions() else self.read_raw(start)
        span = self.batcher.span(Batches(start, batches.last))
        sums = deltas(flow.where(span.condition()), self.batcher, s, reducers, expand).persist()  # read once for each snapshot and once for the result
        self._held.append(sums)
        last = batches.last if batches.last is not None else 0
        for b in sorted({*(select or ()), last}):
            if b in batches and b + 1 not in self.versions():
                new = sums.where(F.col("batch_id") <= b).select("key", F.col("delta").alias("total"))
                both = new if known is None else known.unionByName(new)
                self.write_last(b, both.groupBy("key").agg(s.total(F.col("total")).alias("total")))
        out = with_previous(sums, s, known)
        out = out.where(batches.condition())
        return out.select("key", "batch_id", "ts_ms", s.present(F.col("prev")).alias("prev"), s.present(F.col("delta")).alias("delta"))

    def release(self) -> None:
        """Let go of the sums that the last merge keeps for its result; if that is still read, they are summed anew."""
        while self._held:
            self._held.pop().unpersist()

    def totals(self, batch: int) -> DataFrame:
        """(key, value) up to and including a batch."""
        return self.read_raw(batch + 1).select("key", self.semigroup.present(F.col("total")).alias("value"))

    def for_client(self, before: int) -> DataFrame:
        """(key, batch_excl, total) of the last snapshot, as the hybrid read takes it."""
        found = [v for v in self.versions() if v - 1 < before]
        return self.read_raw(found[-1]).select("key", F.lit(found[-1]).cast("long").alias("batch_excl"), "total")
