"""Clock-aligned windows, sessions and dedup with the same meaning in batch and in streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsmill.sources.ledger import Ledger


def tumbling(posts: DataFrame, by: list[str], minutes: int = 30) -> DataFrame:
    """Right-closed windows (end - 30 min, end]: a post at the border belongs to the window that ends there."""
    w = F.window(F.col("ts") - F.expr("interval 1 microsecond"), f"{minutes} minutes")
    g = posts.groupBy(*by, w.alias("w")).agg(F.count(F.lit(1)).alias("posts"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return g.select(*by, F.col("w.end").alias("window_end"), "posts", "first_ts", "last_ts")


def with_quiet_windows(counts: DataFrame, start, end, minutes: int = 30) -> DataFrame:
    """A row for every window end between two times, also where nothing was posted."""
    spine = counts.sparkSession.range(1).select(F.explode(F.sequence(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"), F.expr(f"interval {minutes} minutes"))).alias("window_end"))
    return spine.join(counts, "window_end", "left").withColumn("posts", F.coalesce("posts", F.lit(0)))


def albums(parts: DataFrame, by: list[str], id_column: str, gap: str = "1500 milliseconds") -> DataFrame:
    """Parts that follow each other within the gap, merged: ordered ids, the lowest one first."""
    g = parts.groupBy(*by, F.session_window("ts", gap).alias("w")).agg(F.sort_array(F.collect_list(id_column)).alias("ids"), F.min("ts").alias("started"), F.max("ts").alias("last"), F.count(F.lit(1)).alias("parts"))
    return g.withColumn("primary_id", F.get("ids", F.lit(0))).drop("w")


def dedup_stream(stream: DataFrame, keys: list[str], delay: str = "4 hours") -> DataFrame:
    """The first post of each key within the history; later ones are dropped."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def pieces(rows: DataFrame, by: str, seconds: int) -> DataFrame:
    """Adds piece, a number that changes where a key is silent for longer than some seconds.

    Inside a slot of that length there is no such silence, so only the first and last time of each slot are compared;
    they are pre-aggregated, and no key's rows are sorted in one task.
    """
    t, slot = F.unix_seconds("ts"), F.floor(F.unix_seconds("ts") / seconds)
    ends = rows.groupBy(by, slot.alias("slot")).agg(F.min(t).alias("first"), F.max(t).alias("last"))
    order = Window.partitionBy(by).orderBy("slot")
    gap = F.coalesce(F.col("first") - F.lag("last").over(order) > seconds, F.lit(True))
    marks = ends.withColumn("gap", gap.cast("int")).select(F.col(by).alias("_by"), F.col("slot").alias("_slot"), F.sum("gap").over(order).alias("piece"))
    return rows.join(marks, rows[by].eqNullSafe(marks["_by"]) & (slot == marks["_slot"])).drop("_by", "_slot")


def routed(posts: DataFrame, delay: str = "4 hours") -> DataFrame:
    """Live intake of posts (channel_id, message_id, text_hash, has_media, grouped_id, ts): each post and text once, with its route.

    Posts already seen go, then texts already seen within the delay (an empty hash is no text); what is left is skipped
    for its media, held for its album, or single. For streams; `route` is the last step alone.
    """
    seen = posts.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["channel_id", "message_id"])
    key = F.when(F.col("text_hash") == "", F.concat_ws("/", "channel_id", F.col("message_id").cast("string"))).otherwise(F.col("text_hash"))
    return route(seen.withColumn("_text", key).dropDuplicatesWithinWatermark(["_text"]).drop("_text"))


def route(posts: DataFrame) -> DataFrame:
    return posts.withColumn("route", F.when(F.coalesce("has_media", F.lit(False)), "skip").when(F.col("grouped_id").isNotNull(), "album").otherwise("single"))


def cooldown_stream(stream: DataFrame, folder: str, checkpoint: str, seconds: int = 3600, most: int = 3, delay: int = 86400):
    """A started query that writes scored posts (id, channel_id, ts, severity) after the source cooldown, batch by batch.

    A ledger knows the last time of each batch, so only batches that reach into the span are read; batches that ended
    more than the span and the delay (seconds) before the present one are forgotten.

    Each micro-batch is folded together with the granted highs of the span before it, which a table in `folder` keeps;
    a batch that runs again replaces its own files, so the result is the same after a failure.
    """
    from newsmill.operators.rules import cooldown

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.select("id", "channel_id", "ts", "severity")
        start, last = rows.agg(F.min(F.unix_seconds("ts")), F.max(F.unix_seconds("ts"))).first()
        if start is None:
            return
        # of earlier batches only those that reach into the span before this one are read
        known = Ledger(spark, f"{folder}/batches")
        ends = {n: known.get(n)["last"] for n in known.numbers() if n < number}
        open_ = [n for n, end in ends.items() if end >= start - seconds]
        before = spark.read.schema(rows.schema).parquet(*[f"{folder}/done/batch={n}" for n in open_]) if open_ else rows.limit(0)
        granted = before.where((F.col("severity") == "high") & (F.unix_seconds("ts") >= start - seconds))
        own = rows.select("id").withColumn("_own", F.lit(True))
        out = cooldown(granted.unionByName(rows), "channel_id", seconds, most).join(own, "id", "left_semi")
        out.write.mode("overwrite").parquet(f"{folder}/done/batch={number}")
        known.put(number, {"last": last}, replace=True)
        known.delete([n for n, end in ends.items() if end < start - seconds - delay])

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
