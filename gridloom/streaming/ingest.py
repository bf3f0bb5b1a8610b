"""Structured Streaming forms of the resumable and incremental operators: a checkpointed file source instead of lists of
covered files, stateful deduplication instead of an event table, watermarked windows, a dead-letter table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def file_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", files_per_batch: int = 100, **options: str) -> DataFrame:
    """New files of a folder as a stream; what was read is in the query's checkpoint, so a restart resumes."""
    return spark.readStream.schema(schema).options(maxFilesPerTrigger=str(files_per_batch), **options).format(fmt).load(path)


def distinct_events(stream: DataFrame, keys: list[str], time: str, lateness: str) -> DataFrame:
    """Each key's first event within the watermark; state older than `lateness` is dropped."""
    return stream.withWatermark(time, lateness).dropDuplicatesWithinWatermark(keys)


def period_counts(stream: DataFrame, time: str, keys: list[str], lateness: str, quarterly: bool = False) -> DataFrame:
    """Counts by calendar year (and quarter) and keys. Calendar periods have no fixed width, so they are derived keys over
    daily windows: append mode emits a day once it is final, and days add up to periods downstream."""
    day = F.window(time, "1 day")
    daily = stream.withWatermark(time, lateness).groupBy(day, *keys).agg(F.count(F.lit(1)).alias("n"))
    out = daily.withColumn("year", F.year("window.start"))
    return (out.withColumn("quarter", F.quarter("window.start")) if quarterly else out).drop("window")


def split_failures(df: DataFrame, ok: Column) -> tuple[DataFrame, DataFrame]:
    """Good rows, and the others for the dead-letter table (null conditions count as failures)."""
    good = F.coalesce(ok, F.lit(False))
    return df.where(good), df.where(~good)


def write_available(stream: DataFrame, target: str, checkpoint: str, dead_letter: str | None = None, ok: Column | None = None) -> StreamingQuery:
    """Write all that is available now to Parquet, exactly once per batch id, and stop; rerun to go on.

    With `ok`, rows that fail it go to `dead_letter`. A batch that is repeated after a failure overwrites its own folder."""

    def batch(df: DataFrame, batch_id: int) -> None:
        good, bad = split_failures(df, ok) if ok is not None else (df, None)
        good.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")
        if bad is not None and dead_letter:
            bad.write.mode("overwrite").parquet(f"{dead_letter}/batch={batch_id}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def versioned_path(base: str, version: int) -> str:
    """A cache's path by its version: raising the version makes an old cache invisible without deleting it."""
    return f"{base}/v{version}"
