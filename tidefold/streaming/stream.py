"""The online side: streaming sums into a table of deltas by key and batch, sinks and joins per micro-batch."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.semigroup import Semigroup
from ..functions.time import Batcher, Interval
from ..operators.store import Metrics
from ..operators.summing import deltas, join_same
from ..sources.files import Files


class DeltaStore:
    """(key, batch_id, ts_ms, delta) under path/writer=<name>/epoch=<micro-batch>. A micro-batch that is run again replaces
    what it wrote, so nothing counts twice, and each writer has its own numbers. Late data goes to its own batch: there is
    no watermark to drop it.

    With a unit batcher everything is batch 0, which makes the store online only. keep: batches older than so many before
    the newest are left out when folders are folded together, which happens once there are `compact_every` of them.
    """

    def __init__(self, spark: SparkSession, path: str, batcher: Batcher, semigroup: Semigroup, keep: int | None = None, compact_every: int = 64, metrics: Metrics | None = None):
        self.spark, self.path, self.batcher, self.semigroup, self.files = spark, path.rstrip("/"), batcher, semigroup, Files(spark)
        self.keep, self.compact_every, self.metrics = keep, compact_every, metrics or Metrics()

    def add(self, df: DataFrame, epoch: int, writer: str = "stream", expand: Callable[[Column], Column] | None = None) -> DataFrame:
        """Store a micro-batch, and return (key, batch_id, ts_ms, prev, delta) of what it held: prev is what the store had for
        the key and batch without it. Folding comes first, as what is returned is read from the folders."""
        if len(self._live()) > self.compact_every:
            self.compact()
        self.metrics.count(self.path, "add")
        deltas(df, self.batcher, self.semigroup, expand=expand).write.mode("overwrite").parquet(f"{self.path}/writer={writer}/epoch={epoch}")
        new, s = self.written(writer, epoch), self.semigroup
        span = new.agg(F.min("batch_id"), F.max("batch_id")).first()
        old = self.read(without=(writer, epoch), span=tuple(span))
        if old is None:
            out = new.withColumn("prev", F.lit(None).cast(new.schema["delta"].dataType))
        else:
            # a join from the few rows of a micro-batch
            out = join_same(new, old.select("key", "batch_id", F.col("delta").alias("prev")), ["key", "batch_id"], "left")
        out = out.select("key", "batch_id", "ts_ms", s.present(F.col("prev")).alias("prev"), s.present(F.col("delta")).alias("delta"))
        return out

    def written(self, writer: str, epoch: int) -> DataFrame:
        """(key, batch_id, ts_ms, delta) of one micro-batch."""
        return self.spark.read.parquet(f"{self.path}/writer={writer}/epoch={epoch}")

    def merge(self, df: DataFrame, wanted: Interval, reducers: int | None = None, expand: Callable[[Column], Column] | None = None) -> DataFrame:
        """The batch form of add; a run over the same interval replaces it, or, once it is folded, changes nothing."""
        return self.add(df.where(wanted.condition()), 0, f"batch_{wanted.lower}_{wanted.upper}", expand)

    def epochs(self) -> list[tuple[str, int]]:
        """Complete (writer, epoch)."""
        writers = [w for w in self.files.names(self.path) if w.startswith("writer=")]
        found = [(w[7:], e) for w in writers for e in self.files.names(f"{self.path}/{w}") if e.startswith("epoch=")]
        return sorted((w, int(e[6:])) for w, e in found if self.files.exists(f"{self.path}/writer={w}/{e}/_SUCCESS"))

    def _bases(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self.files.names(f"{self.path}/_meta") if n.endswith(".json"))

    def _base(self) -> tuple[int | None, dict[str, int]]:
        """The newest fold, and up to which epoch it holds each writer."""
        known = self._bases()
        return (known[-1], json.loads(self.files.read(f"{self.path}/_meta/{known[-1]}.json"))) if known else (None, {})

    def _live(self) -> list[tuple[str, int]]:
        _, upto = self._base()
        return [(w, e) for w, e in self.epochs() if e > upto.get(w, -1)]

    def read(self, without: tuple[str, int] | None = None, span: tuple[int | None, int | None] | None = None) -> DataFrame | None:
        """(key, batch_id, ts_ms, delta) over all epochs, or all but one; None where nothing is stored. span: the first and
        the last batch to read, a filter that reaches the scan."""
        self.metrics.count(self.path, "read")
        base, upto = self._base()
        paths = [] if base is None else [f"{self.path}/base={base}"]
        paths += [f"{self.path}/writer={w}/epoch={e}" for w, e in self.epochs() if e > upto.get(w, -1) and (w, e) != without]
        if not paths:
            return None
        rows = self.spark.read.parquet(*paths)
        if span is not None:
            rows = rows.where(F.col("batch_id").between(*span))
        return rows.groupBy("key", "batch_id").agg(F.max("ts_ms").alias("ts_ms"), self.semigroup.total(F.col("delta")).alias("delta"))

    def present(self, keys: DataFrame) -> DataFrame:
        """(key, value): the totals of all batches, of some keys."""
        s, rows = self.semigroup, self.read()
        if rows is None:
            return keys.limit(0).withColumn("value", F.lit(None))
        totals = join_same(rows, keys.select("key").distinct(), ["key"], "left_semi").groupBy("key").agg(s.total(F.col("delta")).alias("x"))
        return totals.select("key", s.present(F.col("x")).alias("value"))

    def compact(self, oldest_batch: int | None = None) -> None:
        """Fold all epochs into one folder, leaving out batches before oldest_batch (or those that `keep` lets go), and then
        delete them. The newest epoch of each writer is not folded, as its micro-batch may be run again."""
        base, upto = self._base()
        for w, e in self.epochs():
            if e <= upto.get(w, -1):  # folded before, and written again since
                self.files.delete(f"{self.path}/writer={w}/epoch={e}")
        newest = dict(self.epochs())
        done = [(w, e) for w, e in self._live() if e < newest[w] or w.startswith("batch_")]
        if not done:
            return
        held = ([] if base is None else [f"{self.path}/base={base}"]) + [f"{self.path}/writer={w}/epoch={e}" for w, e in done]
        rows = self.spark.read.parquet(*held)
        if oldest_batch is None and self.keep is not None:
            last = rows.agg(F.max("batch_id")).first()[0]
            oldest_batch = None if last is None else last - self.keep + 1
        if oldest_batch is not None:
            rows = rows.where(F.col("batch_id") >= oldest_batch)
        rows = rows.groupBy("key", "batch_id").agg(F.max("ts_ms").alias("ts_ms"), self.semigroup.total(F.col("delta")).alias("delta"))
        new = 0 if base is None else base + 1
        rows.write.mode("overwrite").parquet(f"{self.path}/base={new}")
        self.files.write(f"{self.path}/_meta/{new}.json", json.dumps(upto | dict(done)))  # counts from here on
        for w, e in done:
            self.files.delete(f"{self.path}/writer={w}/epoch={e}")
        if base is not None:
            self.files.delete(f"{self.path}/base={base}")
            self.files.delete(f"{self.path}/_meta/{base}.json")


def start_query(df: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = False, interval: str = "1 second"):
    writer = df.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)).start()


def start_sum(df: DataFrame, store: DeltaStore, checkpoint: str, available_now: bool = False, interval: str = "1 second", after: Callable[[DataFrame, int], None] | None = None, writer: str = "stream"):
    """Sum a streaming flow of (ts_ms, seq, key, value) into a store. `after` is called with each micro-batch's rows
    once they are stored, to present totals elsewhere or for any other effect. Streams of one store differ in `writer`."""

    def each(rows: DataFrame, epoch: int) -> None:
        store.add(rows, epoch, writer)
        if after:
            after(rows, epoch)

    return start_query(df, each, checkpoint, available_now, interval)


def start_sink(df: DataFrame, sink, checkpoint: str, available_now: bool = False, interval: str = "1 second", writer: str = "stream"):
    return start_query(df, lambda rows, epoch: sink.add(rows, writer, epoch), checkpoint, available_now, interval)


def presenting(store: DeltaStore, publish: Callable[[DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """An `after` that publishes the new totals (key, value) of the keys that a micro-batch touched."""
    return lambda rows, epoch: publish(store.present(rows))
