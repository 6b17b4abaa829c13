"""Files through Hadoop's file systems, so paths may be in any store that Spark reads; time-ranged sources."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass, replace
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.time import DAY, HOUR, Interval, to_ms

EPOCH = datetime(1970, 1, 1, tzinfo=UTC)


class Files:
    """The few file operations that planning needs."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def _at(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def names(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def write(self, path: str, text: str = "") -> None:
        fs, p = self._at(path)
        out = fs.create(p, True)
        out.write(bytearray(text.encode()))
        out.close()

    def claim(self, path: str) -> bool:
        """Make a file, unless it is there."""
        fs, p = self._at(path)
        fs.mkdirs(p.getParent())
        return fs.createNewFile(p)

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()


@dataclass
class Source:
    """Rows with event time. frame() gives (ts_ms, seq, value columns...) inside an interval; `available` is what it has.

    exact: an interval that is not available whole is an error, else it is shortened to its available beginning.
    margin: so much more is read on each side, for rows that are filed by arrival; event times outside are then cut.
    probe: says of an interval whether it can be read, where `available` isn't known; satisfiable() then bisects.
    """

    read: Callable[[SparkSession, Interval], DataFrame]
    ts: str | Column
    ts_type: str = "timestamp"
    seq: str | Column | None = None
    available: Interval = Interval()
    exact: bool = False
    margin: int = 0
    probe: Callable[[Interval], bool] | None = None

    def satisfiable(self, wanted: Interval) -> Interval:
        got = wanted & self.available
        if self.probe and not got.empty:
            got = longest_prefix(got, self.probe)
        if got.empty or got.lower != wanted.lower:
            if self.exact:
                raise ValueError(f"{wanted} is not available: the source has {self.available}")
            return got if not got.empty and wanted.lower is None else Interval(0, 0)
        if self.exact and got != wanted:
            raise ValueError(f"{wanted} is not available: the source has {self.available}")
        return got

    def covers(self, wanted: Interval) -> bool:
        """Whether the interval is there from its beginning to its end, where the source says what it has."""
        low, high = self.available.lower, self.available.upper
        known = (wanted.lower is None or low is None or low <= wanted.lower) and (high is None or (wanted.upper is not None and wanted.upper <= high))
        return known and (self.probe is None or self.probe(wanted))

    def frame(self, spark: SparkSession, interval: Interval = Interval()) -> DataFrame:
        if self.exact and interval != Interval():
            self.satisfiable(interval)
        wide = Interval(None if interval.lower is None else interval.lower - self.margin, None if interval.upper is None else interval.upper + self.margin)
        df = self.read(spark, wide)
        out = df.withColumn("ts_ms", to_ms(self.ts, self.ts_type))
        seq = F.xxhash64(F.to_json(F.struct(*df.columns))) if self.seq is None else (F.col(self.seq) if isinstance(self.seq, str) else self.seq).cast("long")
        return out.withColumn("seq", seq).where((interval if interval == Interval() else interval & self.available).condition())

    def mapped(self, f: Callable[[DataFrame], DataFrame]) -> Source:
        """Edit the rows before time is taken: parse and so on."""
        return replace(self, read=lambda spark, i: f(self.read(spark, i)))

    def option_mapped(self, f: Callable[[Column], Column], column: str) -> Source:
        """Parse a column, and drop rows where that gives null."""
        return self.mapped(lambda df: df.withColumn(column, f(F.col(column))).where(F.col(column).isNotNull()))

    def widened(self, by: int = HOUR) -> Source:
        return replace(self, margin=by)


def longest_prefix(wanted: Interval, probe: Callable[[Interval], bool], least: int = 1) -> Interval:
    """The longest beginning of a finite interval that a probe accepts, to `least` milliseconds, by bisection; a probe that
    accepts an interval accepts its beginnings."""
    if wanted.lower is None or wanted.upper is None:
        return wanted if probe(wanted) else Interval(0, 0)
    good, bad = wanted.lower, wanted.upper + least
    while bad - good > least:
        middle = (good + bad) // 2
        if probe(Interval(wanted.lower, min(middle, wanted.upper))):
            good = middle
        else:
            bad = middle
    return Interval(wanted.lower, min(good, wanted.upper)) if good > wanted.lower else Interval(0, 0)


def table(path: str, ts: str | Column, format: str = "parquet", reader: dict | None = None, **options) -> Source:
    """A source of Parquet, JSON, CSV, text or ORC files; reader: options of Spark's reader, `schema` among them."""

    def read(spark: SparkSession, _: Interval) -> DataFrame:
        given = dict(reader or {})
        schema = given.pop("schema", None)
        out = spark.read.format(format).options(**given)
        return (out.schema(schema) if schema else out).load(path)

    return Source(read, ts, **options)


def rows(spark: SparkSession, items: list, schema: str, ts: str = "ts_ms") -> Source:
    """A source of values in memory."""
    return Source(lambda s, _: s.createDataFrame(items, schema), ts, "bigint")


class TimePaths:
    """Folders by time, such as /logs/{:%Y/%m/%d}: the part of an interval up to the first folder missing.

    step: milliseconds to a folder, or "month" or "year"."""

    def __init__(self, spark: SparkSession, pattern: str, step: int | str = DAY):
        self.files, self.spark, self.pattern, self.step = Files(spark), spark, pattern, step

    def _place(self, ms: int) -> int:
        """The number of the folder that a time lies in."""
        if isinstance(self.step, int):
            return ms // self.step
        t = EPOCH + timedelta(milliseconds=ms)
        return t.year if self.step == "year" else t.year * 12 + t.month - 1

    def _begin(self, k: int) -> datetime:
        if isinstance(self.step, int):
            return EPOCH + timedelta(milliseconds=k * self.step)
        return datetime(k, 1, 1, tzinfo=UTC) if self.step == "year" else datetime(k // 12, k % 12 + 1, 1, tzinfo=UTC)

    def _start(self, k: int) -> int:
        return (self._begin(k) - EPOCH) // timedelta(milliseconds=1)

    def _path(self, k: int) -> str:
        return self.pattern.format(self._begin(k))

    def satisfiable(self, wanted: Interval) -> Interval:
        if wanted.lower is None or wanted.upper is None:
            raise ValueError("folders by time need a finite interval")
        k = self._place(wanted.lower)
        while self._start(k) < wanted.upper and self.files.exists(self._path(k)):
            k += 1
        return wanted & Interval(wanted.lower, self._start(k))

    def whole(self, wanted: Interval) -> Interval:
        """The folders that an interval touches, as an interval: as far as they are there without a hole."""
        if wanted.empty or wanted.lower is None or wanted.upper is None:
            return Interval(0, 0)
        return self.satisfiable(Interval(self._start(self._place(wanted.lower)), self._start(self._place(wanted.upper - 1) + 1)))

    def paths(self, i: Interval) -> list[str]:
        return [] if i.empty else [self._path(k) for k in range(self._place(i.lower), self._place(i.upper - 1) + 1)]

    def source(self, wanted: Interval, ts: str, format: str = "parquet", exact: bool = False, **options) -> Source:
        got = self.satisfiable(wanted)
        if got.empty or (exact and got != wanted):
            raise ValueError(f"{wanted} is not available: the folders hold {got}")
        return Source(lambda spark, i: spark.read.format(format).load(self.paths(i & self.whole(got))), ts, available=got, exact=exact, **options)


def stream(path: str, schema, ts: str, format: str = "parquet", max_files: int | None = None, **options) -> Source:
    """A streaming source over files; a Kafka one is Source(lambda spark, _: spark.readStream.format("kafka")..., ts)."""

    def read(spark: SparkSession, _: Interval) -> DataFrame:
        reader = spark.readStream.format(format).schema(schema)
        return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).load(path)

    return Source(read, ts, **options)


def shared_path(spark: SparkSession, label: str) -> str:
    """A new folder that driver and executors share, under spark.checkpoint.dir. Where that is unset, a session on this
    machine alone gets a folder of its own; any other is refused."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        context = spark.sparkContext
        held = context._jsc.sc().getCheckpointDir()
        if not held.isDefined():
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir names no folder that all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="tidefold-"))
        where = context._jsc.sc().getCheckpointDir().get()
    return f"{where.rstrip('/')}/tidefold-{label}-{uuid.uuid4().hex}"
