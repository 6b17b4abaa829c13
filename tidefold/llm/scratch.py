"""Tables that cut lineage: Parquet in the folder all executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.files import Files, shared_path


def new_path(spark: SparkSession, label: str) -> str:
    return shared_path(spark, label)


def cut(df: DataFrame, label: str, by: str | None = None, path: str | None = None) -> DataFrame:
    """df as written to the shared folder, in folders by a column if given, and read again: a lost executor costs no
    recomputation. path: replaces what is there, instead of a new folder."""
    spark = df.sparkSession
    writer = df.write.mode("overwrite") if path else df.write
    path = path or new_path(spark, label)
    (writer.partitionBy(by) if by else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tidefold_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables that cut() wrote and that no plan still reads."""
    for df in tables:
        path = getattr(df, "_tidefold_path", None)
        if path:
            Files(df.sparkSession).delete(path)
