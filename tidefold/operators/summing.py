"""Sum by key: per key and batch the delta, and the total before it. A null key is a key like any other."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.semigroup import Semigroup
from ..functions.time import Batcher


def join_same(left: DataFrame, right: DataFrame, on: list[str], how: str) -> DataFrame:
    """An equi-join on columns of equal names, in which null equals null; the right's columns of these names go."""
    renamed = right.withColumnsRenamed({c: f"{c}_of_right_" for c in on})
    condition = F.lit(True)
    for c in on:
        condition = condition & F.col(c).eqNullSafe(F.col(f"{c}_of_right_"))
    out = left.join(renamed, condition, how)
    return out if how in ("left_semi", "left_anti") else out.drop(*(f"{c}_of_right_" for c in on))


def deltas(df: DataFrame, batcher: Batcher, semigroup: Semigroup, reducers: int | None = None, expand: Callable[[Column], Column] | None = None) -> DataFrame:
    """(key, batch_id, ts_ms, delta): one element per key and batch, ts_ms the newest of its values.

    One shuffle on (key, batch_id), after map-side combination; a hot key is dealt out by its batches. reducers: into so
    many partitions. expand: the keys become many, once their values are summed."""
    if expand is not None:
        return sum_expanded_keys(df, expand, batcher, semigroup, reducers)
    rows = df.select("key", batcher.column(F.col("ts_ms")).alias("batch_id"), "ts_ms", "seq", "value")
    lifted = rows.withColumn("x", semigroup.lift(F.col("value"), F.col("ts_ms"), F.col("seq")))
    total = semigroup.total(F.col("x"))
    if semigroup.by_entry:
        lifted = _sum_entries(lifted)
    elif semigroup.sketch is not None:
        lifted, total = rows, semigroup.sketch(F.col("value"))
    elif semigroup.python and semigroup.commutative:
        lifted = _combined(lifted.select("key", "batch_id", "ts_ms", "seq", "x"), semigroup.python)
    if reducers:
        lifted = lifted.repartition(reducers, "key", "batch_id")
    return lifted.groupBy("key", "batch_id").agg(F.max("ts_ms").alias("ts_ms"), total.alias("delta"))


def _sum_entries(rows: DataFrame) -> DataFrame:
    """Maps of numbers summed entry by entry, so that equal ones meet on the map side: one map per key and batch.
    Where all maps are empty or null an empty one, or null, stays."""
    each = rows.select("key", "batch_id", "ts_ms", F.col("x").isNotNull().alias("some"), F.explode_outer("x").alias("k", "n"))
    sums = each.groupBy("key", "batch_id", "k").agg(F.max("ts_ms").alias("ts_ms"), F.max("some").alias("some"), F.sum("n").alias("n"))
    whole = sums.groupBy("key", "batch_id").agg(F.max("ts_ms").alias("ts_ms"), F.max("some").alias("some"), F.array_sort(F.collect_list(F.when(F.col("k").isNotNull(), F.struct("k", "n")))).alias("e"))
    return whole.select("key", "batch_id", "ts_ms", F.when(F.col("some"), F.map_from_entries("e")).alias("x"))


def _combined(rows: DataFrame, plus) -> DataFrame:
    """Each task's elements added up by key and batch, a pandas batch at a time; for commutative Python functions."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            held: dict = {}
            for key, batch, ts, seq, x in zip(b["key"], b["batch_id"], b["ts_ms"], b["seq"], b["x"], strict=True):
                at, v = (_hashable(key), batch), x["v"]
                old = held.get(at)
                if old is not None:
                    v = old[4] if v is None else v if old[4] is None else plus(old[4], v)
                    ts, seq = max(old[2:4], (ts, seq))
                held[at] = (key, batch, ts, seq, v)
            if held:
                yield pd.DataFrame([(k, n, t, s, {"ts_ms": t, "seq": s, "v": v}) for k, n, t, s, v in held.values()], columns=["key", "batch_id", "ts_ms", "seq", "x"])

    return rows.mapInPandas(run, rows.schema)


def _hashable(key):
    if pd.api.types.is_scalar(key):
        return None if pd.isna(key) else key
    return repr(key)


def _before(semigroup: Semigroup, window, x: Column) -> Column:
    return semigroup.running(x, window.rowsBetween(Window.unboundedPreceding, -1))


def with_previous(sums: DataFrame, semigroup: Semigroup, initial: DataFrame | None = None) -> DataFrame:
    """Adds `prev`, the total of a key's earlier batches and of `initial` (key, total): null where there is none.

    The window holds one row per batch of a key, not its values."""
    out = sums.withColumn("prev", _before(semigroup, Window.partitionBy("key").orderBy("batch_id"), F.col("delta")))
    if initial is not None:
        out = join_same(out, initial.select("key", F.col("total").alias("total_")), ["key"], "left")
        out = out.withColumn("prev", semigroup.add(F.col("total_"), F.col("prev"))).drop("total_")
    return out.select("key", "batch_id", "ts_ms", "prev", "delta")


def sum_by_key(df: DataFrame, batcher: Batcher, semigroup: Semigroup, initial: DataFrame | None = None, reducers: int | None = None, expand: Callable[[Column], Column] | None = None) -> DataFrame:
    """(key, batch_id, ts_ms, prev, delta) with prev and delta presented."""
    out = with_previous(deltas(df, batcher, semigroup, reducers, expand), semigroup, initial)
    return out.select("key", "batch_id", "ts_ms", semigroup.present(F.col("prev")).alias("prev"), semigroup.present(F.col("delta")).alias("delta"))


def sum_by_key_record(df: DataFrame, batcher: Batcher, semigroup: Semigroup) -> DataFrame:
    """One row (key, ts_ms, seq, prev, delta) per input row, in order of (ts_ms, seq).

    Running totals are taken within a key's batch and added to the total before the batch, so no task needs all
    rows of a hot key: narrower batches deal it out further."""
    if semigroup.sketch is not None:
        raise ValueError("a sketch has no totals by record")
    ready = df.select("key", batcher.column(F.col("ts_ms")).alias("batch_id"), "ts_ms", "seq", semigroup.lift(F.col("value"), F.col("ts_ms"), F.col("seq")).alias("x"))
    per_batch = ready.groupBy("key", "batch_id").agg(semigroup.total(F.col("x")).alias("s"))
    carried = per_batch.select("key", "batch_id", _before(semigroup, Window.partitionBy("key").orderBy("batch_id"), F.col("s")).alias("carried"))
    inside = ready.withColumn("inside", _before(semigroup, Window.partitionBy("key", "batch_id").orderBy("ts_ms", "seq"), F.col("x")))
    out = join_same(inside, carried, ["key", "batch_id"], "inner")
    return out.select("key", "ts_ms", "seq", semigroup.present(semigroup.add(F.col("carried"), F.col("inside"))).alias("prev"), semigroup.present(F.col("x")).alias("delta"))


def sum_expanded_keys(df: DataFrame, expand: Callable[[Column], Column], batcher: Batcher, semigroup: Semigroup, reducers: int | None = None) -> DataFrame:
    """(key, batch_id, ts_ms, delta) after each key is expanded into many: values are summed by the old key first,
    so that the expansion multiplies sums, not rows. Only for commutative semigroups."""
    if not semigroup.commutative:
        raise ValueError("summing before key expansion needs a commutative semigroup")
    first = deltas(df, batcher, semigroup, reducers)
    many = first.select(F.explode(expand(F.col("key"))).alias("key"), "batch_id", "ts_ms", "delta")
    return many.groupBy("key", "batch_id").agg(F.max("ts_ms").alias("ts_ms"), semigroup.total(F.col("delta")).alias("delta"))
