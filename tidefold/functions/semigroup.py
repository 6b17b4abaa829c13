"""Semigroups as Column expressions: how to lift a value, add many, add two, and present a total.

`agg` is an ordinary aggregate, so Spark combines on the map side; `plus` adds two elements, null standing for
none. Where order matters the element carries (ts_ms, seq), which makes the sum independent of arrival.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _same(x: Column) -> Column:
    return x


def _either(plus: Callable[[Column, Column], Column]) -> Callable[[Column, Column], Column]:
    return lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(plus(a, b))


@dataclass(frozen=True)
class Semigroup:
    name: str
    agg: Callable[[Column, Callable[[Column], Column]], Column]  #: of elements; every aggregate in it goes through the second argument
    plus: Callable[[Column, Column], Column]
    lift: Callable[[Column, Column, Column], Column] = lambda v, ts, seq: v  #: (value, ts_ms, seq) -> element
    present: Callable[[Column], Column] = _same
    commutative: bool = True
    python: Callable | None = None  #: of two Python values, for custom()
    sketch: Callable[[Column], Column] | None = None  #: an aggregate from values to an element, where no one value has its own
    by_entry: bool = False  #: elements are maps of numbers, whose entries can be summed each by itself

    def total(self, x: Column) -> Column:
        """The aggregate of a group's elements; null elements don't count."""
        return self.agg(x, _same)

    def running(self, x: Column, window) -> Column:
        """The aggregate over a window; null where it holds no element."""
        return F.when(F.count(x).over(window) > 0, self.agg(x, lambda a: a.over(window)))

    def add(self, a: Column, b: Column) -> Column:
        return _either(self.plus)(a, b)


def _sum(x, o):
    return o(F.sum(x))


def _min(x, o):
    return o(F.min(x))


def _max(x, o):
    return o(F.max(x))


count = Semigroup("count", _sum, lambda a, b: a + b, lift=lambda v, ts, seq: F.lit(1).cast("long"))
sum_ = Semigroup("sum", _sum, lambda a, b: a + b)
min_ = Semigroup("min", _min, F.least)
max_ = Semigroup("max", _max, F.greatest)


def decimal_sum(scale: int = 2) -> Semigroup:
    """Exact sums of doubles rounded to `scale` places: no order of addition changes them."""
    kind = f"decimal(38,{scale})"
    return Semigroup("decimal_sum", lambda x, o: o(F.sum(x)).cast(kind), lambda a, b: (a + b).cast(kind), lift=lambda v, ts, seq: F.round(v, scale).cast(f"decimal(28,{scale})").cast(kind))


def _stamped(v: Column, ts: Column, seq: Column) -> Column:
    return F.struct(ts.alias("ts_ms"), seq.alias("seq"), v.alias("v"))


first = Semigroup("first", _min, F.least, _stamped, lambda x: x["v"], commutative=False)
last = Semigroup("last", _max, F.greatest, _stamped, lambda x: x["v"], commutative=False)
#: Values are arrays; the union has no order of its own, so it is kept sorted. Equal arrays meet once on the map side.
set_union = Semigroup("set_union", lambda x, o: F.array_sort(F.array_distinct(F.flatten(o(F.collect_set(x))))), lambda a, b: F.array_sort(F.array_union(a, b)), lambda v, ts, seq: F.array_sort(F.array_distinct(v)))
set_of = Semigroup("set_of", lambda x, o: F.array_sort(F.array_distinct(F.flatten(o(F.collect_set(x))))), lambda a, b: F.array_sort(F.array_union(a, b)), lambda v, ts, seq: F.array(v))
#: Values of equal (ts_ms, seq) come in order of value.
list_concat = Semigroup(
    "list_concat",
    lambda x, o: F.array_sort(F.flatten(o(F.collect_list(x)))),
    lambda a, b: F.array_sort(F.concat(a, b)),
    lambda v, ts, seq: F.array(_stamped(v, ts, seq)),
    lambda x: F.transform(x, lambda e: e["v"]),
    commutative=False,
)
average = Semigroup(
    "average",
    lambda x, o: F.when(o(F.count(x)) > 0, F.struct(o(F.sum(x["s"])).alias("s"), o(F.sum(x["n"])).alias("n"))),
    lambda a, b: F.struct((a["s"] + b["s"]).alias("s"), (a["n"] + b["n"]).alias("n")),
    lambda v, ts, seq: F.struct(v.alias("s"), F.lit(1).cast("long").alias("n")),
    lambda x: x["s"] / x["n"],
)
#: Values are HyperLogLog sketches, presented as their estimate.
approx_distinct = Semigroup("approx_distinct", lambda x, o: o(F.hll_union_agg(x)), lambda a, b: F.hll_union(a, b), present=lambda x: F.hll_sketch_estimate(x), sketch=lambda v: F.hll_sketch_agg(v))
#: Values are whole numbers; a total is a KLL sketch, presented as (0.25, 0.5, 0.75)-quantiles, each within about 1.3 %.
quantiles = Semigroup(
    "quantiles",
    lambda x, o: o(F.kll_merge_agg_bigint(x)),
    lambda a, b: F.kll_sketch_merge_bigint(a, b),
    present=lambda x: F.kll_sketch_get_quantile_bigint(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))),
    sketch=lambda v: F.kll_sketch_agg_bigint(v),
)


def _merged_maps(x: Column, o: Callable) -> Column:
    """Maps of numbers, added by key, one after the other."""
    each = o(F.collect_list(x))
    return F.reduce(F.slice(each, 2, F.greatest(F.size(each) - 1, F.lit(0))), F.get(each, F.lit(0)), _add_maps)


def _add_maps(a: Column, b: Column) -> Column:
    zero = F.lit(0).cast("long")
    return F.map_zip_with(a, b, lambda k, x, y: F.coalesce(x, zero) + F.coalesce(y, zero))


#: Values are maps to long. An empty map is an element like any other, so its key survives. The sums of a batch's entries
#: are taken by (key, map key), on the map side first; a total lists few keys.
map_sum = Semigroup("map_sum", _merged_maps, _add_maps, lambda v, ts, seq: F.transform_values(v, lambda k, x: x.cast("long")), by_entry=True)


def frequencies(buckets: int = 1024, rows: int = 4) -> Semigroup:
    """Count-min: how often each value came, at most; a total is a map from row * buckets + bucket to a count. Ask it with
    frequency_of()."""

    def lift(v: Column, ts: Column, seq: Column) -> Column:
        cells = F.array(*(F.lit(r * buckets).cast("long") + F.pmod(F.xxhash64(v.cast("string"), F.lit(r)), F.lit(buckets)) for r in range(rows)))
        return F.map_from_arrays(cells, F.transform(cells, lambda _: F.lit(1).cast("long")))

    return Semigroup("frequencies", _merged_maps, _add_maps, lift, by_entry=True)


def frequency_of(total: Column, v: Column, buckets: int = 1024, rows: int = 4) -> Column:
    """What frequencies(buckets, rows) says of a value: never less than its count."""
    cells = [F.lit(r * buckets).cast("long") + F.pmod(F.xxhash64(v.cast("string"), F.lit(r)), F.lit(buckets)) for r in range(rows)]
    return F.least(*(F.coalesce(F.try_element_at(total, c), F.lit(0).cast("long")) for c in cells))


def option(s: Semigroup) -> Semigroup:
    """Values that may be missing: none + x is x. All aggregates ignore null already."""
    return Semigroup(f"option({s.name})", s.agg, s.add, s.lift, s.present, s.commutative, s.python, s.sketch, s.by_entry)


def tuple_of(**parts: Semigroup) -> Semigroup:
    """Values are structs with these fields, each added by its own semigroup; no sketches among them."""
    each = parts.items()
    return Semigroup(
        "tuple(" + ",".join(s.name for s in parts.values()) + ")",
        lambda x, o: F.when(o(F.count(x)) > 0, F.struct(*(s.agg(x[n], o).alias(n) for n, s in each))),
        lambda a, b: F.struct(*(s.add(a[n], b[n]).alias(n) for n, s in each)),
        lambda v, ts, seq: F.struct(*(s.lift(v[n], ts, seq).alias(n) for n, s in each)),
        lambda x: F.when(x.isNotNull(), F.struct(*(s.present(x[n]).alias(n) for n, s in each))),
        all(s.commutative for s in parts.values()),
    )


def fold(name: str, plus: Callable[[Column, Column], Column], commutative: bool = False) -> Semigroup:
    """Any associative Column function, applied in order of (ts_ms, seq). Elements of a key meet in one array, so
    keys must be of a size for that; semigroups above combine on the map side instead."""

    def agg(x: Column, o: Callable) -> Column:
        ordered = F.array_sort(o(F.collect_list(x)))
        rest = F.slice(ordered, 2, F.greatest(F.size(ordered) - 1, F.lit(0)))
        return F.reduce(rest, ordered[0], lambda a, e: F.struct(e["ts_ms"].alias("ts_ms"), e["seq"].alias("seq"), plus(a["v"], e["v"]).alias("v")))

    def two(a: Column, b: Column) -> Column:
        """In order of time, whichever comes first."""
        x, y = F.least(a, b), F.greatest(a, b)
        return F.struct(y["ts_ms"].alias("ts_ms"), y["seq"].alias("seq"), plus(x["v"], y["v"]).alias("v"))

    return Semigroup(name, agg, two, _stamped, lambda x: x["v"], commutative)


def custom(name: str, python: Callable, kind: str, commutative: bool = False) -> Semigroup:
    """An associative Python function of two values of the Spark type `kind`, applied in order of (ts_ms, seq); the slow
    path. The values of a key and batch meet in one array; if `commutative`, each task adds up its own first."""

    def folded(values):
        known = [v for v in values or () if v is not None]
        return reduce(python, known) if known else None

    made: list = []  # once there is a session to make it in

    def fold_all(values: Column) -> Column:
        if not made:
            made.append(F.udf(folded, kind))
        return made[0](values)

    def of(elements: Column) -> Column:
        ordered = F.array_sort(F.array_compact(elements))
        newest = F.element_at(ordered, F.lit(-1))
        whole = F.struct(newest["ts_ms"].alias("ts_ms"), newest["seq"].alias("seq"), fold_all(F.transform(ordered, lambda e: e["v"])).alias("v"))
        return F.when(F.size(ordered) > 0, whole)

    return Semigroup(name, lambda x, o: of(o(F.collect_list(x))), lambda a, b: of(F.array(a, b)), _stamped, lambda x: x["v"], commutative, python)
