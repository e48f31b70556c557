"""Late posts of closed windows: a side table behind the watermark, and a catch-up digest that reads each of them once.

A batch's rows are late where their window has been closed by an earlier batch. The ledger holds, for each batch, up to
when windows are closed after it; batches are written by number and a batch that runs again replaces its own files, so a
restart changes nothing. The catch-up digest takes the batches after the last one that a digest has taken and records
that with its own number; one that failed before its record is made again, with the same rows, in the same place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsmill.sources.ledger import Ledger


def late_rows(rows: DataFrame, closed: int | None, minutes: int = 30) -> tuple[DataFrame, DataFrame]:
    """Rows whose window (end - minutes, end] is open, and rows whose window closed at `closed` (seconds) or before."""
    end = F.ceil(F.unix_micros("ts") / (minutes * 60_000_000)) * (minutes * 60)
    rows = rows.withColumn("window_end", F.timestamp_seconds(end))
    if closed is None:
        return rows, rows.where(F.lit(False))
    late = F.unix_seconds("window_end") <= closed
    return rows.where(~late), rows.where(late)


def late_stream(stream: DataFrame, folder: str, checkpoint: str, minutes: int = 30, delay_seconds: int = 600):
    """A started query that writes rows in time to folder/in_time and late ones to folder/late, batch by batch."""

    def step(batch: DataFrame, number: int) -> None:
        ledger = Ledger(batch.sparkSession, f"{folder}/ledger")
        before = ledger.last(number)
        closed = before[1]["closed"] if before else None
        held = batch.persist()
        try:
            in_time, late = late_rows(held, closed, minutes)
            in_time.write.mode("overwrite").parquet(f"{folder}/in_time/batch={number}")
            late.write.mode("overwrite").parquet(f"{folder}/late/batch={number}")
            newest = held.agg(F.max(F.unix_seconds("ts"))).first()[0]
        finally:
            held.unpersist()
        if newest is not None:
            now = (newest - delay_seconds) // (60 * minutes) * (60 * minutes)
            closed = now if closed is None else max(closed, now)
        ledger.put(number, {"closed": closed}, replace=True)
        ledger.delete([n for n in ledger.numbers() if n < number - 1])  # the batch may run again and asks for the one before

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def catch_up(spark: SparkSession, folder: str, by: str = "channel_id") -> DataFrame | None:
    """by, window_end, posts, first_ts, last_ts of the late rows that no digest has had; none where there are none.

    The digest is written to folder/digests/run=n before its record, which says up to which batch it reaches.
    """
    done, batches = Ledger(spark, f"{folder}/digests-done"), Ledger(spark, f"{folder}/ledger").numbers()  # a batch is complete once it has its record
    last = done.last()
    run, after = (last[0] + 1, last[1]["batch"]) if last else (0, -1)
    if not batches or batches[-1] <= after:
        return None
    rows = spark.read.parquet(f"{folder}/late").where((F.col("batch") > after) & (F.col("batch") <= batches[-1]))
    digest = rows.groupBy(by, "window_end").agg(F.count(F.lit(1)).alias("posts"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    digest.write.mode("overwrite").parquet(f"{folder}/digests/run={run}")
    done.put(run, {"batch": batches[-1]})
    return spark.read.parquet(f"{folder}/digests/run={run}")
