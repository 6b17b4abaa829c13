"""Counters that a run fills in, without a second pass over the data."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..operators.run import current


class Counters:
    """Counts of rows that meet conditions, taken by observation as the rows pass: each is exact once the job that
    reads them has ended, and a task that is run again is not counted twice. Frames that are watched one after the other,
    such as a stream's micro-batches, add up; a planning pass counts nothing."""

    def __init__(self, group: str, **conditions: Callable[[], Column]):
        self.group, self.conditions = group, conditions
        self.watched: list[Observation] = []

    def watch(self, df: DataFrame) -> DataFrame:
        run = current()
        if run and run.mode == "plan":
            return df
        self.watched.append(Observation(f"{self.group}-{len(self.watched)}"))
        each = [F.count_if(c()).alias(n) for n, c in self.conditions.items()]
        return df.observe(self.watched[-1], F.count(F.lit(1)).alias("rows"), *each)

    @property
    def values(self) -> dict[str, int]:
        total: Counter[str] = Counter({"rows": 0} | dict.fromkeys(self.conditions, 0))
        for w in self.watched:
            total.update(w.get)
        return dict(total)
