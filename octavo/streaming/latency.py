"""Live-frame latency as a stream: the same columns as the batch form, in event-time windows with a watermark."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.latency import lateness_bin


def windowed(frames: DataFrame, window: str = "5 minutes", behind: str = "10 minutes", frame: int = 10_000, width: int = 2_000) -> DataFrame:
    """From (event_type, ts TIMESTAMP, late): frames, misses and the worst by type and window. Later rows than the watermark are dropped, and state goes with it."""
    late = F.greatest(F.col("late"), F.lit(0))
    t = frames.withWatermark("ts", behind).groupBy("event_type", F.window("ts", window).alias("w"))
    t = t.agg(F.count(F.lit(1)).alias("frames"), F.count_if(late > frame).alias("misses"), F.max(late).alias("worst"), F.max(lateness_bin(late, width)).alias("bin"))
    return t.select("event_type", F.col("w.start").alias("start"), "frames", "misses", "worst", "bin")


def replay(spark: SparkSession, path: str, folder: str, files: int = 1) -> DataFrame:
    """Runs the stream over the events' Parquet files, all there is and once, into a table below folder, and reads that."""
    schema = spark.read.parquet(path).schema
    # A file of the same name in the parent is what the streaming source can watch.
    parent, _, name = path.rpartition("/")
    e = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", name if "." in name else "*").parquet(parent)
    e = e.select("event_type", F.col("ts").cast("timestamp").alias("ts"), (F.round(F.col("value") * 1000).cast("long") - 20000).alias("late"))
    own = f"{folder.rstrip('/')}/latency-{uuid.uuid4().hex}"
    run = windowed(e).writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", f"{own}/state")

    def keep(df: DataFrame, epoch: int) -> None:
        """A row's newest epoch wins: replays of an epoch overwrite their own folder."""
        df.write.mode("overwrite").parquet(f"{own}/out/epoch={epoch}")

    q = run.foreachBatch(keep).start()
    q.awaitTermination()
    t = spark.read.parquet(f"{own}/out").groupBy("event_type", "start")
    return t.agg(*[F.max_by(c, "epoch").alias(c) for c in ("frames", "misses", "worst", "bin")])
