"""Running a stream over what is there now, into a table in the shared folder."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.plans.ordered import last_row
from foliant.plans.session import scratch_path


def append_to(stream: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write every available row once (exactly-once file sink) and stop."""
    query = (
        stream.writeStream.format(fmt)
        .option("checkpointLocation", f"{path}/_state")
        .option("path", f"{path}/data")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def append_result(stream: DataFrame, name: str) -> DataFrame:
    spark = stream.sparkSession
    path = scratch_path(spark, name)
    append_to(stream, path)
    return spark.read.schema(stream.schema).parquet(f"{path}/data")


def update_result(stream: DataFrame, name: str, keys: Sequence[str]) -> DataFrame:
    """Updated rows of every batch, then the last one per key.

    Each batch writes its own folder, so a repeated batch replaces itself; a stream without rows has none but the empty one.
    """
    spark = stream.sparkSession
    path = scratch_path(spark, name)
    spark.createDataFrame([], stream.schema).write.parquet(f"{path}/data/batch=-1")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/data/batch={number}")

    query = (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", f"{path}/_state")
        .outputMode("update")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    rows = spark.read.option("basePath", f"{path}/data").parquet(f"{path}/data")
    return last_row(rows, list(keys), [F.col("batch")]).drop("batch")


def watch_files(spark: SparkSession, pattern: str, schema) -> DataFrame:
    """A stream of the files that match a path pattern, and of the files in the folders that match it."""
    return spark.readStream.schema(schema).parquet(pattern)


def read_ndjson(spark: SparkSession, folder: str, schema) -> DataFrame:
    """NDJSON event stream with a fixed schema; broken lines give NULL fields."""
    return spark.readStream.schema(schema).json(folder)


def event_time(us: Column) -> Column:
    return F.timestamp_micros(us)


def finite_stream(rows: DataFrame, time: str, name: str, **marks: object) -> DataFrame:
    """``rows`` as a stream that flushes: a last row, NULL but for a ``time`` a year after all others, moves
    the watermark past everything, so that nothing stays open when the run ends. ``marks`` gives it values; a join
    key needs one, as rows without are dropped before the watermark sees them."""
    spark = rows.sparkSession
    path = scratch_path(spark, name)
    rows.write.parquet(path)
    last = spark.read.schema(rows.schema).parquet(path).agg(F.max(time).alias("last"))
    closing = [
        (F.col("last") + F.expr("INTERVAL 365 DAYS") if f.name == time else F.lit(marks.get(f.name))).cast(f.dataType).alias(f.name) for f in rows.schema
    ]
    last.select(*closing).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).parquet(path)
