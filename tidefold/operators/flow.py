"""Flow: the one program. A DataFrame of (ts_ms, seq, [key,] value) and the operators on it.

Operators take functions from Column to Column and keep event time. The same program runs over intervals of batch
sources and over micro-batches of streams. Sums into stores and writes take effect when a Job runs the program; without
a job they only say what they would give.
"""

from __future__ import annotations

import operator
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, MapType

from ..functions.semigroup import Semigroup
from ..functions.time import Batcher, to_ms
from .run import Node, current, pick
from .service import AsOfService, ClampedService, ReadableService, Service, StoreService, loop_join
from .sink import Buffer
from .store import VersionedStore
from .summing import sum_by_key, sum_by_key_record, sum_expanded_keys

Fn = Callable[[Column], Column]


def _has_map(kind: DataType) -> bool:
    return isinstance(kind, MapType) or any(_has_map(k) for k in [getattr(kind, "elementType", None), *(f.dataType for f in getattr(kind, "fields", []))] if k is not None)


def _own_seq(df: DataFrame, value: Column) -> Column:
    """An order among rows of equal time where none is given: by a hash of the value, so that only equal values tie."""
    kind = df.select(value.alias("v")).schema["v"].dataType
    return F.xxhash64(F.to_json(F.struct(value.alias("v"))) if _has_map(kind) else value)


@dataclass(frozen=True)
class Flow:
    df: DataFrame
    node: Node = Node("source")
    reads: frozenset = frozenset()  #: stores that this flow was joined with
    unexpanded: tuple[DataFrame, Fn] | None = field(default=None, compare=False)  #: what flat_map_keys just expanded, and how

    # sources

    @staticmethod
    def source(df: DataFrame, ts: str | Column, value: str | Column, key: str | Column | None = None, seq: str | Column | None = None, ts_type: str = "timestamp") -> Flow:
        """seq orders rows of equal time."""
        col = lambda c: F.col(c) if isinstance(c, str) else c
        cols = [to_ms(ts, ts_type).alias("ts_ms"), (_own_seq(df, col(value)) if seq is None else col(seq)).cast("long").alias("seq")]
        if key is not None:
            cols.append(col(key).alias("key"))
        run, node = current(), Node("source")
        out = _sharded(df.select(*cols, col(value).alias("value")), 1)
        return Flow(run.note(node, out) if run else out, node)

    def _next(self, df: DataFrame, kind: str, *others: Flow, label: str | None = None) -> Flow:
        run, node = current(), Node(kind, (self.node, *(o.node for o in others)), label)
        return Flow(run.note(node, df) if run else df, node, self.reads.union(*(o.reads for o in others)))

    @property
    def keyed(self) -> bool:
        return "key" in self.df.columns

    # any flow

    def map(self, f: Fn) -> Flow:
        return self._next(self.df.withColumn("value", f(F.col("value"))), "map")

    def filter(self, f: Fn) -> Flow:
        return self._next(self.df.where(f(F.col("value"))), "filter")

    def option_map(self, f: Fn) -> Flow:
        """Null results are dropped."""
        return self._next(self.df.withColumn("value", f(F.col("value"))).where("value is not null"), "option_map")

    def collect(self, defined: Fn, f: Fn) -> Flow:
        """f where it is defined; other values are dropped."""
        return self._next(self.df.where(defined(F.col("value"))).withColumn("value", f(F.col("value"))), "collect")

    def flat_map(self, f: Fn) -> Flow:
        """f gives an array; null and empty ones give nothing."""
        return self._next(_sharded(self.df).withColumn("value", F.explode(f(F.col("value")))), "flat_map")

    def transform(self, f: Callable[[DataFrame], DataFrame]) -> Flow:
        """Opaque code: mapInArrow, UDTFs and the like. The row shape must stay."""
        return self._next(f(self.df), "transform")

    def key_by(self, key: Fn, value: Fn = lambda v: v) -> Flow:
        return self._next(self.df.select("ts_ms", "seq", key(F.col("value")).alias("key"), value(F.col("value")).alias("value")), "key_by")

    def merge(self, other: Flow) -> Flow:
        """All rows of both, repeated ones too; merging a flow with itself doubles it."""
        return self._next(self.df.unionByName(other.df), "merge", other)

    __add__ = merge

    def either(self, other: Flow) -> Flow:
        """Rows of both, told apart: value is a struct (tag, left, right)."""
        kinds = [f.df.schema["value"].dataType for f in (self, other)]
        cols = lambda tag, left, right: ["ts_ms", "seq", F.struct(F.lit(tag).alias("tag"), left.cast(kinds[0]).alias("left"), right.cast(kinds[1]).alias("right")).alias("value")]
        return self._next(self.df.select(*cols("left", F.col("value"), F.lit(None))).unionByName(other.df.select(*cols("right", F.lit(None), F.col("value")))), "either", other)

    def lefts(self) -> Flow:
        return self.collect(lambda v: v["tag"] == "left", lambda v: v["left"])

    def rights(self) -> Flow:
        return self.collect(lambda v: v["tag"] == "right", lambda v: v["right"])

    def name(self, label: str, **options) -> Flow:
        """Labels the flow, and sets options for what stands above it, as far as no nearer name does: shards (deal rows out
        anew before a flat map), reducers (of sums), grouping ("grouped" or "shuffled", before joins), share (keep what
        several read), intermediate (a sink for the deltas of sums). A Job can set them by label too."""
        run = current()
        if run and options:
            run.options[label] = options | run.options.get(label, {})
        return replace(self._next(self.df, "name", label=label), unexpanded=self.unexpanded)

    def write(self, sink) -> Flow:
        """Rows pass on unchanged; the write happens when a Job runs. `sink` may be a Pair."""
        run, sink = current(), pick(sink)
        if run and run.mode == "batch":
            sink.write(self.df.where(run.wanted.condition()), run.wanted)
        elif run and run.mode == "stream":
            sink.add(self.df, run.writer, run.epoch)
        return self._next(self.df, "write")

    def also(self, other: Flow) -> Flow:
        """This flow's effects, and then the other flow."""
        node = Node("also", (self.node, other.node))
        run = current()
        return Flow(run.note(node, other.df) if run else other.df, node, other.reads)

    def lookup(self, service: Service) -> Flow:
        """Values are keys: key and what the service has for it, or null."""
        left = self.df.withColumn("key", F.col("value")).drop("value")
        return self._next(self._served(pick(service)).join(_grouped(left)).withColumnRenamed("right", "value"), "lookup")

    # keyed flows

    def _with(self, column: str, f: Fn, kind: str, where: Fn | None = None) -> Flow:
        if not self.keyed:
            raise TypeError(f"{kind} needs a keyed flow")
        df = self.df if where is None else self.df.where(where(F.col(column)))
        return self._next(df.withColumn(column, f(F.col(column))), kind)

    def map_keys(self, f: Fn) -> Flow:
        return self._with("key", f, "map_keys")

    def map_values(self, f: Fn) -> Flow:
        return self._with("value", f, "map_values")

    def flat_map_keys(self, f: Fn) -> Flow:
        """f gives an array of keys. A commutative sum that follows adds up by the old keys first, so that sums are
        expanded and not rows."""
        return replace(self._with("key", lambda k: F.explode(f(k)), "flat_map_keys"), unexpanded=(self.df, f))

    def flat_map_values(self, f: Fn) -> Flow:
        return self._with("value", lambda v: F.explode(f(v)), "flat_map_values")

    def filter_keys(self, f: Fn) -> Flow:
        return self._with("key", lambda k: k, "filter_keys", f)

    def filter_values(self, f: Fn) -> Flow:
        return self._with("value", lambda v: v, "filter_values", f)

    def collect_keys(self, defined: Fn, f: Fn) -> Flow:
        return self._with("key", f, "collect_keys", defined)

    def collect_values(self, defined: Fn, f: Fn) -> Flow:
        return self._with("value", f, "collect_values", defined)

    def keys(self) -> Flow:
        return self._next(self.df.select("ts_ms", "seq", F.col("key").alias("value")), "keys")

    def values(self) -> Flow:
        return self._next(self.df.select("ts_ms", "seq", "value"), "values")

    def swap(self) -> Flow:
        return self._next(self.df.select("ts_ms", "seq", F.col("value").alias("key"), F.col("key").alias("value")), "swap")

    def left_join(self, right: Service | Flow | VersionedStore, buffer: Buffer | None = None, batcher: Batcher | None = None) -> Flow:
        """value becomes a struct (left, right).

        A Flow on the right is joined as of each left row; with `buffer`, a Job first adds it to what the buffer holds from
        earlier runs, and joins with all of that. A store on the right is one that the program sums into before it joins:
        right is its total up to each left row; in a stream, what it holds at the moment. `batcher` deals a key's time
        out among tasks. `right` may be a Pair.
        """
        right, others, run = pick(right), (), current()
        reads = frozenset()
        if isinstance(right, Flow):
            others, log = (right,), right.df
            if buffer is not None:
                if run is None:
                    raise ValueError("a buffer is written when a Job runs")
                if run.mode == "batch":
                    buffer.write(log.where(run.wanted.condition()), run.wanted)
                elif run.mode == "stream":
                    buffer.add(log, run.writer, run.epoch)
                if run.mode != "plan":
                    log = buffer.log(log.schema)
            service: Service = AsOfService(log, batcher)
        elif isinstance(right, Service):
            service = self._served(right)
        else:
            service, reads = self._store_service(right), frozenset([id(right)])
        joined = service.join(_grouped(self.df)).withColumn("value", F.struct(F.col("value").alias("left"), F.col("right"))).drop("right")
        out = self._next(joined, "left_join", *others)
        return replace(out, reads=out.reads | reads)

    @staticmethod
    def _served(service: Service) -> Service:
        run = current()
        if run and run.mode == "plan" and isinstance(service, ClampedService):
            run.clamps.append(service)
        return service

    @staticmethod
    def _store_service(store) -> Service:
        run = current()
        if run is None or id(store) not in run.inputs:
            raise ValueError("a program sums into a store before it joins with it")
        if run.mode == "stream":
            return ReadableService(lambda keys: store.present(keys))
        first = store.batcher.covered_by(run.reach).first if run.mode == "batch" else None
        return StoreService(store, first, run.inputs[id(store)])

    def loop_join(self, store: VersionedStore, expand: Callable, kind: str, plus: Callable = operator.add) -> Flow:
        """A join with the very store that its result is summed into. Per key, in order of time: expand(value, total so far)
        gives deltas of the Spark type `kind`, plus (two Python values, as the store's semigroup adds them) takes them
        into the total. The value that results is a struct (left, right, delta), of deltas that there are; keys can't change."""
        run = current()
        if store.semigroup.python is None and store.semigroup.name != "sum":
            raise ValueError("a looped store sums numbers, or by a Python function")
        plus, before = store.semigroup.python or plus, None
        rows = self.df
        if run and run.mode == "batch":
            first = store.batcher.covered_by(run.reach).first
            found = None if first is None else store.read_last(first)
            if found is not None:
                before, rows = found[1], rows.where(F.col("ts_ms") > store.batcher.latest(found[0]))
        out = loop_join(rows, expand, plus, kind, before).where("delta is not null")
        if run and run.mode == "batch":  # the loop goes through Python: once
            out = out.persist()
            run.held.append(out)
        value = F.struct(F.col("value").alias("left"), F.col("right"), F.col("delta"))
        joined = self._next(out.select("ts_ms", "seq", "key", value.alias("value")), "loop_join")
        summed = joined.map_values(lambda v: v["delta"]).sum_by_key(store)
        return replace(summed.also(joined), reads=joined.reads)

    # sums

    def sum_by_key(self, store, semigroup: Semigroup | None = None) -> Flow:
        """Sum into a store: a Batcher alone keeps nothing; a VersionedStore, a DeltaStore or a Pair of them is written
        when a Job runs. The flow that results has one row per key and batch, its value a struct (prev, delta), prev
        being the store's total before the batch. Without a job, or with a Batcher, prev is the total of this flow's
        earlier batches; with a DeltaStore, what the store held for that key and batch."""
        store, run = pick(store), current()
        batcher = store if isinstance(store, Batcher) else store.batcher
        semigroup = semigroup or store.semigroup
        if id(store) in self.reads:
            raise ValueError("this flow was joined with the store it is summed into: only loop_join() can, where only the values change")
        reducers = run.option("reducers") if run else None
        df, expand = self.unexpanded if self.unexpanded and semigroup.commutative and semigroup.sketch is None else (self.df, None)
        if run and store is not batcher:
            run.inputs[id(store)] = self.df
            if run.mode == "plan":
                if any(s is store for s in run.stores):
                    raise ValueError("a store is summed into once: merge the flows first")
                run.stores.append(store)
            elif sink := run.option("intermediate"):
                sums = sum_by_key(self.df, batcher, semigroup).select("ts_ms", F.lit(0).cast("long").alias("seq"), "key", F.col("delta").alias("value"))
                sink.write(sums.where(run.wanted.condition()), run.wanted) if run.mode == "batch" else sink.add(sums, run.writer, run.epoch)
        if run and run.mode == "batch" and store is not batcher:
            out = store.merge(df, run.reach if isinstance(store, VersionedStore) else run.wanted, reducers=reducers, expand=expand)
        elif run and run.mode == "stream" and store is not batcher:
            out = store.add(df, run.epoch, run.writer, expand=expand)
        else:
            out = sum_by_key(df, batcher, semigroup, reducers=reducers, expand=expand)
        return self._next(out.select("ts_ms", F.lit(0).cast("long").alias("seq"), "key", F.struct("prev", "delta").alias("value")), "sum_by_key")

    def sums(self, batcher: Batcher, semigroup: Semigroup, granularity: str = "batch") -> DataFrame:
        """(key, batch_id, ts_ms, prev, delta), or one row per input with granularity "record"."""
        if granularity == "record":
            return sum_by_key_record(self.df, batcher, semigroup)
        df, expand = self.unexpanded if self.unexpanded and semigroup.commutative and semigroup.sketch is None else (self.df, None)
        return sum_by_key(df, batcher, semigroup, expand=expand)

    def sums_of_expanded_keys(self, expand: Fn, batcher: Batcher, semigroup: Semigroup) -> DataFrame:
        return sum_expanded_keys(self.df, expand, batcher, semigroup)


def _sharded(df: DataFrame, least: int = 0) -> DataFrame:
    """Rows dealt out anew where the option `shards` of the next operator asks for it."""
    run = current()
    shards = run.option("shards") if run else None
    return df.repartition(shards) if shards and shards > least else df


def _grouped(df: DataFrame) -> DataFrame:
    """Rows on their way to a join, by the option `grouping`."""
    run = current()
    grouping = run.option("grouping") if run else None
    if grouping == "shuffled":
        return df.repartition(df.sparkSession.sparkContext.defaultParallelism)
    return df.repartition("key") if grouping == "grouped" else df
