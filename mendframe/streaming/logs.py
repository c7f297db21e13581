"""Append-only logs as streams: resumable ingestion and event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def read_log(spark: SparkSession, folder: str, schema: T.StructType, fmt: str = "json", per_trigger: int = 100) -> DataFrame:
    """New files of a log folder, at most ``per_trigger`` at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).format(fmt).load(folder)


def _known(spark: SparkSession, out: str, key: T.StructField, buckets: int) -> DataFrame | None:
    """The keys already in ``out`` with their buckets; None while the folder doesn't exist. Any other error is raised."""
    path = spark._jvm.org.apache.hadoop.fs.Path(out)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.schema(T.StructType([key, T.StructField("_bucket", T.IntegerType())])).parquet(out)


def ingest(log: DataFrame, key: str, out: str, state: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """Each key of a log once into ``out``, then its state row into ``state``; restarts go on where they stopped.

    Rows are written before their state, and a batch leaves out the keys already there, so a batch that is
    run again after a crash adds nothing twice. ``out`` is partitioned by ``_bucket``, a hash of the key, and a batch
    reads the keys of its own buckets only; rows without a key are left out. An output that cannot be read is an error.
    """

    def sink(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        fresh = batch.where(F.col(key).isNotNull()).dropDuplicates([key]).withColumn("_bucket", F.pmod(F.hash(key), F.lit(buckets)))
        fresh.persist()
        try:
            done = _known(spark, out, batch.schema[key], buckets)
            new = fresh
            if done is not None:
                mine = [r[0] for r in fresh.select("_bucket").distinct().collect()]  # at most ``buckets``
                new = fresh.join(done.where(F.col("_bucket").isin(mine)).select(key), key, "left_anti")
            keys = new.select(key, F.lit("done").alias("state")).persist()
            keys.count()
            new.write.mode("append").partitionBy("_bucket").parquet(out)
            keys.write.mode("append").parquet(state)
            keys.unpersist()
        finally:
            fresh.unpersist()

    return log.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_within(log: DataFrame, key: str, time: str, late: str, out: str, checkpoint: str) -> StreamingQuery:
    """As ``ingest`` for logs whose repeats come within ``late`` of each other: the state store forgets older keys,
    so what it holds doesn't grow with history and nothing that was written is read again."""
    once = log.where(F.col(key).isNotNull() & F.col(time).isNotNull()).withWatermark(time, late).dropDuplicatesWithinWatermark([key])
    return once.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def tumbling(events: DataFrame, time: str, size: str, key: str, value: str, late: str | None = None) -> DataFrame:
    """(start, key, n, total) by event-time windows; with ``late`` also a watermark, for streams."""
    e = events.withWatermark(time, late) if late else events
    g = e.groupBy(F.window(time, size), key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return g.select(F.col("window.start").alias("start"), key, "n", "total")


def sliding(events: DataFrame, time: str, size: str, step: str, key: str, late: str | None = None) -> DataFrame:
    """(start, key, n) by overlapping event-time windows."""
    e = events.withWatermark(time, late) if late else events
    return e.groupBy(F.window(time, size, step), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), key, "n")


def sessions(events: DataFrame, time: str, gap: str, key: str, late: str | None = None) -> DataFrame:
    """(key, start, n) of sessions that end after ``gap`` without an event."""
    e = events.withWatermark(time, late) if late else events
    return e.groupBy(F.session_window(time, gap), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("session_window.start").alias("start"), "n")
