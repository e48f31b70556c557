"""Streams give what the batch forms give."""

import datetime as dt
import random

from pyspark.sql import functions as F

from newsmill.operators import keyed, rules
from newsmill.streaming import windows

T0 = dt.datetime(2024, 1, 1)


def source(spark, df, at, parts=4):
    """df as a stream of several files, oldest first."""
    for i, rows in enumerate(df.orderBy("ts").randomSplit([1.0] * parts, 1)):
        rows.coalesce(1).write.mode("append").parquet(f"{at}/in")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")


def test_live_intake(spark, tmp_path):
    r = random.Random(1)
    rows = [(f"c{i % 3}", i, r.choice(["a", "b", "", f"t{i}"]), i % 7 == 0, i % 5 if i % 11 == 0 else None, T0 + dt.timedelta(seconds=60 * i)) for i in range(90)]
    rows += rows[:10]
    df = spark.createDataFrame(rows, "channel_id string, message_id long, text_hash string, has_media boolean, grouped_id long, ts timestamp")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = windows.routed(stream).writeStream.format("memory").queryName("live").trigger(availableNow=True).start()
    q.awaitTermination(180)
    got = spark.table("live").collect()
    batch = df.dropDuplicates(["channel_id", "message_id"])
    want = windows.route(keyed.exact_duplicates(batch.where("text_hash <> ''")).where("matched_message_id IS NULL").select(df.columns).unionByName(batch.where("text_hash = ''")))
    key = lambda xs: sorted((x.text_hash if x.text_hash else str(x.message_id)) for x in xs)
    assert key(got) == key(want.collect()) and {x.route for x in got} == {"skip", "album", "single"}


def test_exact_dedup(spark, tmp_path):
    df = spark.createDataFrame([(i, f"k{i % 13}", T0 + dt.timedelta(seconds=10 * i)) for i in range(60)], "id long, text_hash string, ts timestamp")
    q = windows.dedup_stream(source(spark, df, tmp_path), ["text_hash"]).writeStream.format("memory").queryName("once").trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert sorted(x.text_hash for x in spark.table("once").collect()) == sorted(f"k{i}" for i in range(13))


def test_cooldown(spark, tmp_path):
    r = random.Random(2)
    rows = [(i, f"c{r.randint(0, 2)}", T0 + dt.timedelta(seconds=300 * i), r.choice(["high", "high", "medium", "low"])) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, channel_id string, ts timestamp, severity string")
    for i in range(4):
        df.where(F.floor(F.col("id") / 30) == i).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    names = spark.read.parquet(f"{tmp_path}/in").select("id", F.input_file_name().alias("f")).groupBy("f").agg(F.min("id").alias("first")).orderBy("first").collect()
    import os
    import time
    from urllib.parse import urlparse

    for k, x in enumerate(names):  # files are taken in order of their times
        os.utime(urlparse(x.f).path, (time.time() - 100 + k, time.time() - 100 + k))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    windows.cooldown_stream(stream, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination(300)
    got = {x.id: x.severity for x in spark.read.parquet(f"{tmp_path}/out/done").collect()}
    assert got == {x.id: x.severity for x in rules.cooldown(df).collect()} and "medium" in got.values()
