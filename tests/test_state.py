"""Stateful streams give what the batch forms give, over a restart as well."""

import datetime as dt
import os
import random
import time
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from newsmill.operators import clusters as C
from newsmill.operators import dedup as D
from newsmill.streaming import state
from tests.test_clusters import frame

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture
def rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, state.ROCKSDB)
    yield spark
    spark.conf.set(key, before)


def put(df, at, first, parts):
    """df in time order as files that a stream takes one by one; first: the number of the first file."""
    rows = df.orderBy("ts", "id").collect()
    step = -(-len(rows) // parts)
    for k in range(parts):
        df.sparkSession.createDataFrame(rows[k * step : (k + 1) * step], df.schema).coalesce(1).write.mode("append").parquet(at)
        for x in df.sparkSession.read.parquet(at).select(F.input_file_name().alias("f")).distinct().collect():
            path = urlparse(x.f).path
            if os.path.getmtime(path) > time.time() - 3600:
                os.utime(path, (1_700_000_000 + first + k, 1_700_000_000 + first + k))


def run(stream, name, at):
    q = stream.writeStream.outputMode("append").format("parquet").option("path", f"{at}/{name}").option("checkpointLocation", f"{at}/{name}-check").trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert q.exception() is None


def test_story_stream_equals_batch(rocksdb, tmp_path):
    spark, r, at = rocksdb, random.Random(8), str(tmp_path)
    rows, t = [], 0
    for i in range(90):
        t += r.choice([60, 600, 4000, 9000])
        text = f"{r.choice(['Iran', 'Hamas'])} {r.choice(['strike', 'launch'])} near {r.choice(['Haifa', 'Kyiv'])} {r.choice(['', '3 killed', '5 killed'])}"
        rows.append((i, t, r.choice([text, ""]), text, r.choice(["attack", "disaster"])))
    posts = frame(spark, rows)
    facts = C.story_facts(posts).withColumn("lane", F.col("taxonomy_key"))
    want = {}
    for lane in ("attack", "disaster"):
        want |= {x.id: (x.cluster, x.decision, x.updates) for x in C.story_clusters(facts.where(F.col("lane") == lane).drop("lane")).collect()}
    stream = lambda: state.story_stream(C.story_facts(spark.readStream.schema(posts.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")).withColumn("lane", F.col("taxonomy_key")), "lane")
    put(posts.where("id < 50"), f"{at}/in", 0, 2)
    run(stream(), "out", at)
    put(posts.where("id >= 50"), f"{at}/in", 10, 2)
    run(stream(), "out", at)  # goes on from the checkpoint
    got = {x.id: (x.cluster, x.decision, x.updates) for x in spark.read.parquet(f"{at}/out").collect()}
    assert got == want and {d for _, d, _ in want.values()} >= {"new_story", "material_update", "duplicate_echo"}


def test_near_dedup_stream_equals_greedy(rocksdb, tmp_path):
    spark, r, at = rocksdb, random.Random(9), str(tmp_path)
    vocab = ["alpha", "bravo", "charlie", "delta", "echo", "foxtrot", "golf", "hotel", "india", "missile", "kyiv", "42"]
    rows, t = [], 0
    for i in range(40):
        w = [r.choice(vocab) for _ in range(12)]
        for _ in range(3):
            rows.append((f"c{len(rows) % 3}", len(rows), " ".join(w), T0 + dt.timedelta(seconds=t), "ab"[i % 2]))
            t += r.choice([60, 1200, 5000])
            w[r.randrange(12)] = r.choice(vocab)
    posts = spark.createDataFrame(rows, "channel_id string, message_id long, raw_text string, ts timestamp, lane string")
    want = {}
    for lane in "ab":
        p = posts.where(F.col("lane") == lane)
        pairs = D.near_duplicates(p).cache()
        kept = D.greedy_keep(p.select(F.col("message_id").alias("id")), pairs)
        best = {x.id: x.matched for x in D.best_match(pairs, kept).collect()}
        want |= {x.id: (x.kept, None if x.kept else best[x.id]) for x in kept.collect()}
    put(posts.withColumn("id", F.col("message_id")), f"{at}/in", 0, 3)
    schema = posts.withColumn("id", F.col("message_id")).schema
    run(state.near_dedup_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in").drop("id"), "lane"), "out", at)
    got = {x.id: (x.kept, x.matched) for x in spark.read.parquet(f"{at}/out").collect()}
    assert got == want and {k for k, _ in want.values()} == {True, False}


def test_scores_agree_with_the_batch_form(spark):
    r = random.Random(4)
    vocab = ["alpha", "bravo", "charlie", "missile", "kyiv", "42", "emergency"]
    rows = [("c", i, " ".join(r.choice(vocab) for _ in range(r.randint(3, 9))), T0 + dt.timedelta(seconds=i)) for i in range(60)]
    posts = spark.createDataFrame(rows, "channel_id string, message_id long, raw_text string, ts timestamp")
    f = {x.id: {"hash": x.text_hash, "tokens": x.tokens, "key": x.key, "anchors": x.anchors} for x in D.features(posts).collect()}
    pairs = {(x.a, x.b): round(x.score, 9) for x in D.near_duplicates(posts).collect()}
    own = {(a, b): round(s, 9) for a in f for b in f if b < a and (s := state.dup_score(f[a], f[b]))}
    assert own == pairs and len(own) > 20
