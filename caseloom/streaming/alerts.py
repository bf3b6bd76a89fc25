"""M1-M5: the time-based rules as streams. Events later than an hour behind the newest are dropped by the stateful steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LATE = "1 hour"


def rapid(events: DataFrame, least: int) -> DataFrame:
    """M1: users with ``least`` events within an hour, in windows that start every ten minutes."""
    w = F.window("ts", "1 hour", "10 minutes")
    return events.withWatermark("ts", LATE).groupBy(w.alias("w"), "user_id").agg(F.count("*").alias("n")).filter(F.col("n") >= least).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


def night(events: DataFrame, least: int) -> DataFrame:
    """M2: users with ``least`` events between 0 and 6 o'clock of a day."""
    e = events.withWatermark("ts", LATE).filter(F.hour("ts") < 6)
    return e.groupBy(F.window("ts", "1 day").alias("w"), "user_id").agg(F.count("*").alias("n")).filter(F.col("n") >= least).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


def followed(first: DataFrame, second: DataFrame, within: str) -> DataFrame:
    """M3: events of ``second`` that follow one of ``first`` of the same user within a time, as a join of two streams."""
    a = first.select(F.col("user_id").alias("u1"), F.col("ts").alias("t1"), F.col("event_id").alias("first_id")).withWatermark("t1", LATE)
    b = second.select(F.col("user_id").alias("u2"), F.col("ts").alias("t2"), F.col("event_id").alias("second_id")).withWatermark("t2", LATE)
    return a.join(b, F.expr(f"u1 = u2 AND t2 >= t1 AND t2 <= t1 + INTERVAL {within}")).select(F.col("u1").alias("user_id"), "first_id", "second_id")


def bursts(events: DataFrame, gap: str, least: int) -> DataFrame:
    """M4: sessions of a user, ended by a pause of ``gap``, with ``least`` events or more."""
    e = events.withWatermark("ts", LATE).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return e.filter(F.col("n") >= least).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


def run(stream: DataFrame, path: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over all that is there and returns its result table, which lies at ``path``."""
    spark = stream.sparkSession

    def write(df, batch):
        df.write.mode("overwrite").parquet(f"{path}/out" if mode == "complete" else f"{path}/out/batch={batch}")  # a replay writes the same again

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out" if mode == "complete" else f"{path}/out/batch=*")


def read(spark: SparkSession, path: str, files_per_batch: int | None = 4) -> DataFrame:
    """A stream over Parquet files with the schema that the table has; ``path`` may be a file or a folder.

    None gives all files that are there to one batch. A finished table's files need not be in time order, so
    steps that drop late events lose none of it only then.
    """
    files = spark.readStream.schema(spark.read.parquet(path).schema)
    return (files.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else files).parquet(f"{path}*")
