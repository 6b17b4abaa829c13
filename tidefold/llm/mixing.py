"""Mixing sources to target weights by capped water-filling, on DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import cut

#: Hexadecimal digits of the order key that group documents for the first prefix sum.
PREFIX = 3
WORD = "[^\\x20\\x09-\\x0D]+"


def word_count(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, share: float, max_epochs: float) -> DataFrame:
    """sources (source, source_size, weight) with `target` in place of weight.

    The targets add up to share * all sizes, are in proportion to the weights, and stop at
    max_epochs * source_size; what a stopped source leaves goes to the others by weight. The level is found
    in closed form: with sources in order of cap / weight, it is the first at which the rest stay below it.
    Where even all caps hold less than the share, every target is its cap.
    """
    cap = F.lit(float(max_epochs)) * F.col("source_size")
    order = Window.orderBy("ratio", "source").rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.partitionBy()
    level = sources.select("source", "source_size", "weight", cap.alias("cap"), (cap / F.col("weight")).alias("ratio"))
    left = F.lit(float(share)) * F.sum("source_size").over(all_) - F.coalesce(F.sum("cap").over(order), F.lit(0.0))
    open_ = F.sum("weight").over(all_) - F.coalesce(F.sum("weight").over(order), F.lit(0))
    level = level.withColumn("level", left / open_)
    water = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(all_)["level"]
    return level.select("source", "source_size", F.coalesce(F.least("cap", F.col("weight") * water), "cap").alias("target"))


def mix_sources(
    docs: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.5,
    max_epochs: float = 2.0,
    seed: str = "mix",
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    carry: tuple[str, ...] = (),
    columns: tuple[str, ...] = ("id", "size", "source_size", "target", "taken", "times"),
) -> DataFrame:
    """(id, size, source_size, target, taken, times), or those of them in `columns`, for every row of docs; the docs
    columns named in `carry` come before them as carried_0, carried_1, ..., so that no name can clash.

    Sources in order of code points, null last, weigh `weights` in turn. A source with target t takes all its
    documents floor(t / size) times, and once more those that come first by md5(seed:id) until their words
    reach the rest, the last one if at least half of it fits. `times` is the repetitions, taken = times * size.

    Nothing depends on partitions or order of rows, so reruns agree. Only one row per source goes through one
    task. The prefix sums of a source are first of 16**PREFIX groups of keys, then within each group, so a hot
    source is dealt to as many tasks. Null text: size 0. Null source: a source of its own. A size of 0 takes 0
    words. Rows that repeat an id are dealt with one by one, in order of size. No rows: no rows.
    """
    source = F.col(source_col).cast("string")
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"))
    base = docs.select(
        *(F.col(c).alias(f"carried_{k}") for k, c in enumerate(carry)),
        F.col(id_col).alias("id"),
        word_count(F.col(text_col)).alias("size"),
        F.when(source.isNull(), "-").otherwise(F.concat(F.lit("+"), source)).alias("source"),  # "-" is after "+"
        key.alias("key"),
        F.substring(key, 1, PREFIX).alias("grp"),
    )
    rows = base if carry else cut(base, "sizes")
    groups = cut(rows.groupBy("source", "grp").agg(F.sum("size").alias("words")), "groups")
    rank = F.row_number().over(Window.orderBy("source")) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int"))
    plan = water_fill(groups.groupBy("source").agg(F.sum("words").alias("source_size")).withColumn("weight", weight), share, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    plan = plan.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    before = F.sum("words").over(Window.partitionBy("source").orderBy("grp")) - F.col("words")
    placed = cut(groups.select("source", "grp", before.alias("before")).join(plan, "source"), "placed")

    within = Window.partitionBy("source", "grp").orderBy("key", "id", "size")
    out = rows.join(placed, ["source", "grp"])
    ahead = F.col("before") + F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    once_more = (F.col("rest") > 0) & (2 * ahead + F.col("size") <= 2 * F.col("rest"))
    out = out.withColumn("times", (F.col("whole") + once_more.cast("long")).cast("long"))
    out = out.withColumn("taken", F.col("size") * F.col("times"))
    return out.select(*(f"carried_{k}" for k in range(len(carry))), *columns)


ORACLE = """
WITH s AS (
  SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size, source,
         md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS key FROM documents),
w AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
  FROM s GROUP BY source),
c AS (SELECT *, 2.0::DOUBLE * source_size AS cap, 2.0::DOUBLE * source_size / weight AS ratio FROM w),
l AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () -
             coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) /
            (sum(weight) OVER () -
             coalesce(sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM c),
t AS (
  SELECT source, source_size,
         coalesce(least(cap, weight * (SELECT level FROM l WHERE level <= ratio ORDER BY ratio, level LIMIT 1)), cap) AS target
  FROM l),
p AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t),
r AS (
  SELECT s.doc_id, s.size, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS rest,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size ROWS UNBOUNDED PRECEDING) - s.size AS ahead
  FROM s JOIN p ON s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
       (size * (whole + (rest > 0 AND 2 * ahead + size <= 2 * rest)::INT))::BIGINT AS taken,
       (whole + (rest > 0 AND 2 * ahead + size <= 2 * rest)::INT)::BIGINT AS times
FROM r
"""


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of docs, each as often as mix_sources takes it, with all their columns. Null and empty texts are
    repeated as others of their source are, and cost no words; null ids and repeated rows are rows like others. No rows: none."""
    mixed = mix_sources(docs, id_col=id_col, text_col=text_col, source_col=source_col, carry=tuple(docs.columns), columns=("times",), **options)
    again = mixed.where("times > 0").withColumn("repetition_", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return again.select(*(F.col(f"carried_{k}").alias(c) for k, c in enumerate(docs.columns)))
