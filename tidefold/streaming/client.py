"""The hybrid read: the last batch snapshot plus the online batches after it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.semigroup import Semigroup
from ..operators.summing import join_same


def read(
    keys: DataFrame,
    now: int,
    semigroup: Semigroup,
    offline: DataFrame | None = None,
    online: DataFrame | None = None,
    keep: int = 1,
    online_keys: Callable[[Column], Column] | None = None,
    strict: bool = False,
    offline_failed: DataFrame | None = None,
    online_failed: DataFrame | None = None,
) -> DataFrame:
    """(key, value, error) for each of `keys` (key) as of batch `now`.

    offline (key, batch_excl, total): totals of all batches before batch_excl. online (key, batch_id, delta): one
    row per key and batch. Online batches are taken from max(now - keep + 1, batch_excl) to now and added in order;
    missing ones count as nothing, and value is null where neither side has any. error tells of an offline total
    that already holds batch `now + 1`, of keys whose lookup failed (the *_failed tables), and, if strict, of a hole
    between the offline total and the first online batch that is kept. Keys that online_keys denies are read
    offline alone.
    """
    out = keys.select("key").distinct()
    none = F.lit(None)
    if offline is not None:
        out = join_same(out, offline.select("key", "batch_excl", "total"), ["key"], "left")
    else:
        kind = online.schema["delta"].dataType
        out = out.withColumn("batch_excl", none.cast("long")).withColumn("total", none.cast(kind))
    start = F.greatest(F.lit(now - keep + 1).cast("long"), F.col("batch_excl"))
    if online is not None:
        ready = online.where(F.col("batch_id") <= now).select("key", "batch_id", "delta")
        if offline is None or keep:
            wanted = out.select("key", start.alias("start_"))
            ready = join_same(ready.where(F.col("batch_id") >= now - keep + 1), wanted, ["key"], "inner").where(F.col("batch_id") >= F.coalesce("start_", F.lit(now - keep + 1)))
        if online_keys is not None:
            ready = ready.where(online_keys(F.col("key")))
        recent = ready.groupBy("key").agg(semigroup.total(F.col("delta")).alias("recent"))
        out = join_same(out, recent, ["key"], "left")
        total = semigroup.add(F.col("total"), F.col("recent"))
    else:
        total = F.col("total")
    error = F.when(F.col("batch_excl") > now + 1, F.concat(F.lit("the offline total is ahead: "), F.col("batch_excl").cast("string")))
    if strict:
        error = F.coalesce(error, F.when(F.col("batch_excl") < now - keep + 1, F.lit("batches between the offline total and the online ones are missing")))
    for side, failed in (("offline", offline_failed), ("online", online_failed)):
        if failed is not None:
            out = join_same(out, failed.select("key", F.lit(True).alias(f"{side}_failed")).distinct(), ["key"], "left")
            error = F.coalesce(error, F.when(F.col(f"{side}_failed"), F.lit(f"the {side} lookup failed")))
    return out.select("key", F.when(error.isNull(), semigroup.present(total)).alias("value"), error.alias("error"))


def merge(new: DataFrame, semigroup: Semigroup, offline: DataFrame | None, online: DataFrame | None, keep: int = 1) -> DataFrame:
    """(key, batch_id, prev, delta) of new deltas (key, batch_id, delta): prev is the whole total before each, offline
    and earlier online batches included; several batches of a key are taken in order."""
    lined = new.select("key", "batch_id", "delta", F.lit(1).alias("new_"))
    if online is not None:
        held = join_same(online, new.select("key").distinct(), ["key"], "left_semi").select("key", "batch_id", "delta", F.lit(0).alias("new_"))
        lined = lined.unionByName(held)
    if offline is not None:
        lined = join_same(lined, offline.select("key", "batch_excl", "total"), ["key"], "left").where("new_ = 1 or batch_excl is null or batch_id >= batch_excl")
    # rows of one key and batch: what is stored comes before what is new
    before = Window.partitionBy("key").orderBy("batch_id", "new_").rowsBetween(Window.unboundedPreceding, -1)
    prev = semigroup.running(F.col("delta"), before)
    out = lined.withColumn("prev", prev)
    if offline is not None:
        out = out.withColumn("prev", semigroup.add(F.col("total"), F.col("prev")))
    return out.where("new_ = 1").select("key", "batch_id", semigroup.present(F.col("prev")).alias("prev"), semigroup.present(F.col("delta")).alias("delta"))


def merge_into(store, df: DataFrame, epoch: int, writer: str = "client", offline: DataFrame | None = None) -> DataFrame:
    """Merge rows (ts_ms, seq, key, value) into an online store, and return (key, batch_id, prev, delta) with prev the whole
    total before each, offline and online. The same epoch again replaces what it wrote and returns the same."""
    store.add(df, epoch, writer)
    return merge(store.written(writer, epoch), store.semigroup, offline, store.read(without=(writer, epoch)))
