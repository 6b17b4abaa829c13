"""Sinks: side effects that pass every row on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.time import Batcher, Interval
from ..sources.files import Files


class Sink:
    def write(self, df: DataFrame, wanted: Interval) -> DataFrame:
        """In a batch run: the rows of an interval."""
        raise NotImplementedError

    def add(self, df: DataFrame, writer: str, epoch: int) -> DataFrame:
        """In a stream: the rows of a micro-batch, which may come again."""
        return self.write(df, Interval())


class BatchedSink(Sink):
    """Rows under path/data/batch_id=<b>. Batches that are there already are read back; only the others are
    computed, written in one job, and marked done last. Rows outside whole batches are passed over."""

    def __init__(self, spark: SparkSession, path: str, batcher: Batcher):
        self.spark, self.path, self.batcher, self.files = spark, path.rstrip("/"), batcher, Files(spark)

    def done(self) -> set[int]:
        return {int(n) for n in self.files.names(f"{self.path}/done")}

    def write(self, df: DataFrame, wanted: Interval) -> DataFrame:
        batches = list(self.batcher.covered_by(wanted))
        missing = [b for b in batches if b not in self.done()]
        if missing:
            ids = F.col("batch_id").isin(missing) if len(missing) < 100 else (F.col("batch_id") >= missing[0]) & (F.col("batch_id") <= missing[-1]) & ~F.col("batch_id").isin([b for b in batches if b not in missing])
            new = df.withColumn("batch_id", self.batcher.column(F.col("ts_ms"))).where(ids)
            new.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("batch_id").parquet(f"{self.path}/data")
            for b in missing:
                self.files.write(f"{self.path}/done/{b}")
        return self.read(wanted, df.schema)

    def add(self, df: DataFrame, writer: str, epoch: int) -> DataFrame:
        raise TypeError("batches of a stream are never complete: give it an EpochSink, or a Pair of sinks")

    def read(self, wanted: Interval, schema) -> DataFrame:
        """What the sink holds of an interval, as a stream of rows that a service can serve."""
        names = [f.name for f in schema.fields]
        if not self.files.names(f"{self.path}/data"):
            return self.spark.createDataFrame([], schema)
        fields = [*schema.fields, *[StructField("batch_id", LongType())] * ("batch_id" not in names)]
        held = self.spark.read.schema(StructType(fields)).parquet(f"{self.path}/data")
        batches = self.batcher.covered_by(wanted)
        return held.where(batches.condition()).select(*names)


class EpochSink(Sink):
    """Rows under path/writer=<source>/epoch=<micro-batch>, replaced when a micro-batch is run again; a batch run replaces
    what it wrote of the same interval."""

    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def write(self, df: DataFrame, wanted: Interval) -> DataFrame:
        return self.add(df, f"batch_{wanted.lower}_{wanted.upper}", 0)

    def add(self, df: DataFrame, writer: str, epoch: int) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.path}/writer={writer}/epoch={epoch}")
        return df

    def folders(self, spark: SparkSession) -> list[str]:
        files = Files(spark)
        each = [f"{self.path}/{w}/{e}" for w in files.names(self.path) if w.startswith("writer=") for e in files.names(f"{self.path}/{w}")]
        return [f for f in each if files.exists(f"{f}/_SUCCESS")]


class Buffer(EpochSink):
    """A sink of (ts_ms, seq, key, value) that is read back whole, to be joined with."""

    def __init__(self, spark: SparkSession, path: str):
        super().__init__(path)
        self.spark = spark

    def log(self, schema) -> DataFrame:
        """All rows so far; a null value deletes."""
        found = self.folders(self.spark)
        return self.spark.read.schema(schema).parquet(*found) if found else self.spark.createDataFrame([], schema)


class StoreSink(Sink):
    """Puts (key, value) into a DeltaStore, whose semigroup says what becomes of several; sg.last keeps the newest."""

    def __init__(self, store):
        self.store = store

    def write(self, df: DataFrame, wanted: Interval) -> DataFrame:
        self.store.merge(df, wanted)
        return df

    def add(self, df: DataFrame, writer: str, epoch: int) -> DataFrame:
        self.store.add(df, epoch, writer)
        return df


class OfflineSink(Sink):
    """Writes rows without their time; never read back."""

    def __init__(self, path: str, format: str = "parquet", mode: str = "append"):
        self.path, self.format, self.mode = path, format, mode

    def write(self, df: DataFrame, wanted: Interval) -> DataFrame:
        df.drop("ts_ms", "seq").write.format(self.format).mode(self.mode).save(self.path)
        return df


class FunctionSink(Sink):
    """Calls f(df) for its effect, such as a write to another system from the executors."""

    def __init__(self, f: Callable[[DataFrame], None]):
        self.f = f

    def write(self, df: DataFrame, wanted: Interval) -> DataFrame:
        self.f(df)
        return df


class NoSink(Sink):
    def write(self, df: DataFrame, wanted: Interval) -> DataFrame:
        return df


class ConvertedSink(Sink):
    """Writes a converted copy and passes the original on."""

    def __init__(self, sink: Sink, convert: Callable[[DataFrame], DataFrame]):
        self.sink, self.convert = sink, convert

    def write(self, df: DataFrame, wanted: Interval) -> DataFrame:
        self.sink.write(self.convert(df), wanted)
        return df

    def add(self, df: DataFrame, writer: str, epoch: int) -> DataFrame:
        self.sink.add(self.convert(df), writer, epoch)
        return df
