"""Structured Streaming over `events`: an extension, there is no stream among the operators the engine set out to cover."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions.expressions import evaluated
from brindle.session import scratch


def exactly(path: str) -> str:
    """A pattern that only this path matches: a stream reads a folder or a pattern, not a file."""
    return f"{path[:-1]}[{path[-1]}]"


def source(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """The Parquet file or folder at a path as a stream; new files in the folder are new data."""
    return spark.readStream.schema(schema or spark.read.parquet(path).schema).parquet(exactly(path))


def lines(spark: SparkSession, folder: str) -> DataFrame:
    """(value) of the lines of the text files in a folder, as a stream."""
    return spark.readStream.text(folder)


def evaluated_lines(spark: SparkSession, folder: str) -> DataFrame:
    """(expression, result) of every line as it arrives; no state."""
    return evaluated(lines(spark, folder))


def _stamped(events: DataFrame, late: str) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def tumbling(events: DataFrame, width: str = "1 day", late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """(start, event_type, n, total) by windows of time, which overlap where they slide by less than their width; an event that is later than `late` is dropped, and so is the state of windows that end before."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return _stamped(events, late).groupBy(window.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).cast("decimal(24,4)").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, start, end, n) of the sessions of every user, which end after `gap` without an event."""
    return _stamped(events, late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_of_each(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """The first row of each key to arrive; repeats are known for as long as `late` after it."""
    return _stamped(events, late).dropDuplicatesWithinWatermark(keys)


def run_once(stream: DataFrame, mode: str = "append", keys: tuple[str, ...] = ()) -> DataFrame:
    """What a stream yields of all data there is by now, worked off in batches, from a table in the shared folder.

    In mode "append" these are the rows that no later data can change: windows
    and sessions that the watermark has passed. In mode "update" every batch
    writes the rows that it changes, and the last row of each of the keys counts.
    Either way the state is that of open windows, and a batch that is run again
    overwrites its own rows.
    """
    folder = scratch(stream.sparkSession, "stream")
    empty = stream.sparkSession.createDataFrame([], stream.schema).withColumn("batch", F.lit(0).cast("long"))
    empty.write.parquet(f"{folder}/rows/part=-1")

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{folder}/rows/part={number}")

    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(put)
    writer.start().awaitTermination()
    rows = stream.sparkSession.read.parquet(f"{folder}/rows").drop("part")
    if mode != "update":
        return rows.drop("batch")
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in keys]), "batch").alias("__last")).select(*keys, *[f"__last.{c}" for c in rows.columns if c not in (*keys, "batch")])
