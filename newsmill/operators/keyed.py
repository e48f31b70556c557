"""Keyed tables: seen keys, archives, last writes, samples, ranks and merges."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsmill.sources.ledger import KeyedTable
from newsmill.sources.views import stage

KEYS = ["channel_id", "message_id"]


def incremental(posts: DataFrame, marks: DataFrame, start=None, end=None) -> DataFrame:
    """Posts beyond their channel's high-water mark (marks: channel_id, last_id); marks are one row a channel."""
    new = posts.join(marks, "channel_id", "left").where(F.col("message_id") > F.coalesce("last_id", F.lit(-1))).drop("last_id")
    if start is not None:
        new = new.where(F.col("ts") >= F.lit(start))
    return new if end is None else new.where(F.col("ts") <= F.lit(end))


def next_marks(posts: DataFrame, marks: DataFrame) -> DataFrame:
    seen = posts.groupBy("channel_id").agg(F.max("message_id").alias("last_id"))
    return marks.unionByName(seen).groupBy("channel_id").agg(F.max("last_id").alias("last_id"))


def drop_seen(posts: DataFrame, seen: DataFrame) -> DataFrame:
    return posts.join(seen.select(*KEYS), KEYS, "left_anti")


def append_archive(posts: DataFrame, archive: DataFrame) -> DataFrame:
    """What an insert-or-ignore adds: trimmed, non-empty, first of each key, keys not yet there."""
    new = posts.withColumn("raw_text", F.trim("raw_text")).where("raw_text != ''").dropDuplicates(KEYS)
    return new.join(archive.select(*KEYS), KEYS, "left_anti")


def upsert_latest(base: DataFrame, updates: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Last write wins per key; partial aggregation, so hot keys are reduced before the shuffle."""
    both = base.unionByName(updates)
    rest = [c for c in both.columns if c not in keys]
    best = both.groupBy(*keys).agg(F.max(F.struct(order, *[c for c in rest if c != order])).alias("_b"))
    return best.select(*keys, *[F.col(f"_b.{c}").alias(c) for c in rest])


def ack_marks(base: DataFrame, acks: DataFrame, keys: list[str], mark: str) -> DataFrame:
    """Checkpoints that never move back."""
    return base.unionByName(acks).groupBy(*keys).agg(F.max(mark).alias(mark))


def window_slice(rows: DataFrame, since, until=None, newest: int | None = None) -> DataFrame:
    """ts in [since, until); the newest rows only where asked for, oldest first."""
    out = rows.where(F.col("ts") >= F.lit(since))
    out = out if until is None else out.where(F.col("ts") < F.lit(until))
    return out if newest is None else out.orderBy(F.desc("ts")).limit(newest).orderBy("ts")


def exact_duplicates(posts: DataFrame, hours: int = 4) -> DataFrame:
    """For each post the first earlier one of equal hash within some hours, or null.

    Posts also stand as history in the next time slot, so a group is what one hash had within two slots, however
    many copies the whole table has.
    """
    span = hours * 3600
    slot = F.floor(F.unix_seconds("ts") / span)
    rows = posts.withColumn("_slot", slot).withColumn("_in", F.explode(F.array(F.col("_slot"), F.col("_slot") + 1)))
    age = Window.partitionBy("text_hash", "_in").orderBy(F.unix_seconds("ts")).rangeBetween(-span, 0)
    rows = rows.withColumn("_first", F.min(F.struct("ts", "message_id", "channel_id")).over(age)).where("_in = _slot")
    hit = (F.col("text_hash") != "") & (F.struct("ts", "message_id") != F.struct("_first.ts", "_first.message_id"))
    return rows.withColumn("matched_message_id", F.when(hit, F.col("_first.message_id"))).withColumn("matched_channel_id", F.when(hit, F.col("_first.channel_id"))).drop("_slot", "_in", "_first")


def keep_latest_n(texts: DataFrame, n: int) -> DataFrame:
    """The newest n distinct normalised texts of 12 characters or more."""
    last = texts.where(F.length("text_norm") >= 12).groupBy("text_norm").agg(F.max("ts").alias("last_seen"))
    return last.orderBy(F.desc("last_seen"), "text_norm").limit(n)


def systematic_sample(rows: DataFrame, limit: int, order: list[str], by: list[str]) -> DataFrame:
    """Per group, all rows if they are few, else every step-th (and the first) up to the limit."""
    group = Window.partitionBy(*by)
    r = rows.withColumns({"rn": F.row_number().over(group.orderBy(*order)), "n": F.count(F.lit(1)).over(group)})
    step = F.greatest(F.lit(1), F.floor(F.col("n") / limit))
    kept = r.where((F.col("n") <= limit) | (F.col("rn") % step == 0) | (F.col("rn") == 1))
    return kept.withColumn("k", F.row_number().over(group.orderBy("rn"))).where(F.col("k") <= limit).drop("n", "k")


def top_k_with_cap(scored: DataFrame, query: str, source: str, order: list[Column], per_source: int = 3, k: int = 6, within: list[Column] | None = None) -> DataFrame:
    """Positive scores only, at most per_source of each source (in the order within, if given), the first k of each query."""
    by_source = F.row_number().over(Window.partitionBy(query, source).orderBy(*(within or order)))
    r = scored.where("score > 0").withColumn("_s", by_source).where(F.col("_s") <= per_source).drop("_s")
    return r.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(*order))).where(F.col("rank") <= k)


def trailing_rate(events: DataFrame, by: str, seconds: int = 3600, limit: int = 3) -> DataFrame:
    """Events of the trailing span and the status that follows."""
    w = Window.partitionBy(by).orderBy(F.unix_seconds("ts")).rangeBetween(-seconds, 0)
    r = events.withColumn("recent", F.count(F.lit(1)).over(w))
    status = F.when(F.col("recent") > limit, "degraded").when(F.col("recent") > 0, "warm").otherwise("healthy")
    return r.withColumn("status", status).withColumn("batch_scale", F.when(F.col("recent") > limit, 0.5).when(F.col("recent") > 0, 0.75).otherwise(1.0))


def corroboration(wins: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """Hits per channel and the tier round(0.8 + 1.2 * hits / most, 3)."""
    hits = wins.groupBy("channel_id").agg(F.count(F.lit(1)).alias("hits"))
    if base is not None:
        hits = hits.unionByName(base).groupBy("channel_id").agg(F.sum("hits").alias("hits"))
    most = hits.agg(F.max("hits").alias("most"))
    return hits.crossJoin(F.broadcast(most)).select("channel_id", "hits", F.round(0.8 + F.col("hits") / F.col("most") * 1.2, 3).alias("tier"))


def decay(hits: DataFrame, weeks: int, rate: float = 0.85) -> DataFrame:
    """Hits after some weekly decays, each rounded half up."""
    if weeks <= 0:
        return hits
    return hits.withColumn("hits", F.aggregate(F.sequence(F.lit(1), F.lit(weeks)), F.col("hits").cast("double"), lambda h, _: F.round(h * rate)).cast("long"))


def hydrate_sources(rows: DataFrame, channels: DataFrame) -> DataFrame:
    """Missing source names from the channel dimension."""
    return rows.join(channels.withColumnRenamed("source_name", "_name"), "channel_id", "left").withColumn("source_name", F.coalesce(F.when(F.trim("source_name") != "", F.col("source_name")), "_name")).drop("_name")


def merge_evidence(parts: list[DataFrame]) -> DataFrame:
    """Rows of several origins, one for each identity (link, else text hash); rows that aren't from the web win, then earlier parts."""
    rows = parts[0].withColumn("_part", F.lit(0))
    for i, p in enumerate(parts[1:], 1):
        rows = rows.unionByName(p.withColumn("_part", F.lit(i)))
    key = F.coalesce(F.when(F.col("link") != "", F.col("link")), F.sha1(F.col("text").cast("binary")))
    rest = [c for c in rows.columns if c not in ("is_web", "_part", "ts")]
    best = rows.withColumn("identity", key).groupBy("identity").agg(F.min(F.struct("is_web", "_part", F.col("ts"), *rest)).alias("b"))
    return best.select("identity", "b.is_web", "b.ts", *[F.col(f"b.{c}") for c in rest])


def decision_cache(posts: DataFrame, cache: DataFrame, ttl_seconds: int) -> DataFrame:
    """Posts with the cached decision of their hash where it is young enough, else null."""
    hit = posts.join(cache.withColumnRenamed("ts", "cached_at"), "text_hash", "left")
    fresh = F.unix_seconds("ts") - F.unix_seconds("cached_at") <= ttl_seconds
    return hit.withColumn("hit", F.coalesce(fresh, F.lit(False))).withColumn("decision", F.when(F.col("hit"), F.col("decision"))).drop("cached_at")


DECISION = "text_hash string, prompt_version string, model string, decision string, decided_at timestamp"


def decision_table(spark: SparkSession, at: str) -> KeyedTable:
    """Decisions by (text_hash, prompt_version, model) in a shared folder."""
    return KeyedTable(spark, at, DECISION, ["text_hash", "prompt_version", "model"], "decided_at")


def decide_through_cache(posts: DataFrame, known: KeyedTable, prompt_version: str, model: str, ttl_seconds: int, decide: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """id, text_hash, ts, decision and hit of posts (id, text_hash, ts); what the table doesn't know is decided and stored.

    A stored decision of the same version and model serves posts up to `ttl_seconds` after it. Of the other posts each
    text is decided once, on its first post: decide gets id, text_hash, ts and gives id, decision. The new decisions
    become the table's next version in one step, so a failure leaves the table as it was.
    """
    fresh = known.read().where((F.col("prompt_version") == prompt_version) & (F.col("model") == model)).select("text_hash", F.col("decision").alias("_known"), "decided_at")
    age = F.unix_seconds("ts") - F.unix_seconds("decided_at")
    asked = posts.select("id", "text_hash", "ts").join(fresh, "text_hash", "left").withColumn("hit", F.coalesce(age.between(0, ttl_seconds), F.lit(False)))
    asked = stage(asked, "asked")
    first = asked.where("NOT hit").groupBy("text_hash").agg(F.min(F.struct("ts", "id")).alias("f")).select(F.col("f.id").alias("id"), "text_hash", F.col("f.ts").alias("ts"))
    first = stage(first, "undecided")
    new = stage(first.join(decide(first), "id").select("text_hash", "decision", "ts"), "decided")
    if not new.isEmpty():
        known.upsert(new.select("text_hash", F.lit(prompt_version).alias("prompt_version"), F.lit(model).alias("model"), F.col("decision").cast("string").alias("decision"), F.col("ts").alias("decided_at")))
    out = asked.join(new.select("text_hash", F.col("decision").cast("string").alias("_new")), "text_hash", "left")
    return out.select("id", "text_hash", "ts", F.when(F.col("hit"), F.col("_known")).otherwise(F.col("_new")).alias("decision"), "hit")


def top_tokens(rows: DataFrame, by: str, token: str, most: int = 8) -> DataFrame:
    """by, rank, token, n: the commonest tokens of each group, counted exactly."""
    counts = rows.groupBy(by, token).agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), token))
    return counts.withColumn("rank", rank).where(F.col("rank") <= most).select(by, "rank", F.col(token).alias("token"), "n")


def token_sketches(rows: DataFrame, by: str, token: str, items: int = 4096) -> DataFrame:
    """by, sketch: a frequent-items sketch of each group, of bounded size; merge with `merged_top`.

    With m items kept, a count is at most 8/3 of (all tokens / m) too large or too small; a token more frequent than
    that is never missed.
    """
    return rows.groupBy(by).agg(F.call_function("approx_top_k_accumulate", F.col(token), F.lit(items)).alias("sketch"), F.count(F.lit(1)).alias("tokens"))


def merged_top(sketches: DataFrame, by: list[Column], most: int = 8, items: int = 4096) -> DataFrame:
    """Groups of sketches as one: their commonest tokens with estimated counts (top, an array of item and count), tokens and error."""
    merged = sketches.groupBy(*by).agg(F.call_function("approx_top_k_combine", F.col("sketch"), F.lit(items)).alias("sketch"), F.sum("tokens").alias("tokens"))
    return merged.withColumn("top", F.call_function("approx_top_k_estimate", "sketch", F.lit(most))).withColumn("error", F.ceil(F.col("tokens") * (8.0 / 3.0) / items).cast("long")).drop("sketch")


def accepted_requests(requests: DataFrame, by: str, gap_seconds: int = 10) -> DataFrame:
    """Requests (ts and a number, id) with accepted: one a sender within the gap, counted from the last accepted one.

    A sender's requests are cut where they are further apart than the gap, as the next one is accepted there anyhow; a
    sorted stream of pieces is folded with one time of state.
    """
    from newsmill.streaming.windows import pieces

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in requests.schema) + ", accepted boolean"
    names = requests.columns

    def fold(batches):
        key, last = None, None
        for pdf in batches:
            out = []
            for k, t in zip(zip(pdf[by], pdf["piece"], strict=True), pdf["_t"], strict=True):
                ok = k != key or t - last >= gap_seconds
                if ok:
                    key, last = k, t
                out.append(ok)
            yield pdf[names].assign(accepted=out)

    cut = pieces(requests, by, gap_seconds).withColumn("_t", F.unix_seconds("ts"))
    return cut.repartition(by, "piece").sortWithinPartitions(by, "piece", "_t", "id").mapInPandas(fold, kinds)


def top_k_or_newest(scored: DataFrame, query: str, source: str, order: list[Column], per_source: int = 3, k: int = 6) -> DataFrame:
    """top_k_with_cap; of queries none of whose rows scores, the newest k rows."""
    best = top_k_with_cap(scored, query, source, order, per_source, k)
    none = scored.join(best.select(query).distinct(), query, "left_anti")
    newest = F.row_number().over(Window.partitionBy(query).orderBy(F.desc("ts"), *order))
    return best.unionByName(none.withColumn("rank", newest).where(F.col("rank") <= k))


def merged_evidence(parts: list[DataFrame], limit: int) -> DataFrame:
    """identity, is_web, source, ts, text of rows (link, text, source, ts, is_web) of several origins, the newest `limit`.

    Rows are the same by link, else by text whatever its case, else by source and time; what isn't from the web wins,
    then the earlier origin.
    """
    rows = parts[0].withColumn("_part", F.lit(0))
    for i, p in enumerate(parts[1:], 1):
        rows = rows.unionByName(p.withColumn("_part", F.lit(i)))
    bare = lambda c: F.trim(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"\s+", " "))
    link, text = F.lower(bare("link")), F.lower(bare("text"))
    stamp = F.coalesce(F.unix_seconds("ts").cast("string"), F.lit(""))
    identity = F.when(link != "", F.concat(F.lit("link:"), link)).when(text != "", F.concat(F.lit("text:"), F.sha1(text.cast("binary")))).otherwise(F.concat(F.lit("meta:"), bare("source"), F.lit("|"), stamp))
    best = rows.withColumn("identity", identity).groupBy("identity").agg(F.min(F.struct("is_web", "_part", "ts", "source", "text")).alias("b"))
    return best.select("identity", "b.is_web", "b.source", "b.ts", "b.text").orderBy(F.desc_nulls_last("ts"), "identity").limit(limit)


def pipeline_report(decisions: DataFrame) -> DataFrame:
    """One row on decisions (text_hash, took_ms, hit): totals, duplicates, calls, latency and the cache's hit rate."""
    d = decisions.agg(F.count(F.lit(1)).alias("messages"), F.count_distinct("text_hash").alias("kinds"), F.count_if(~F.col("hit")).alias("calls"), F.round(F.avg("took_ms"), 4).alias("mean_ms"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY took_ms)").alias("p95_ms"), F.count_if("hit").alias("hits"))
    all_ = F.greatest(F.col("messages"), F.lit(1))
    return d.select("messages", (F.col("messages") - F.col("kinds")).alias("duplicates"), F.round((F.col("messages") - F.col("kinds")) / all_, 4).alias("duplicate_rate"), "calls", F.round(100 * F.col("calls") / all_, 2).alias("calls_per_100"), "mean_ms", "p95_ms", F.round(F.col("hits") / all_, 4).alias("cache_hit_rate"))


def newest_failures(jobs: DataFrame, by: str, failed: Column, most: int = 5) -> DataFrame:
    """The newest failed jobs (id, ts) of each group, at most some."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("ts"), F.desc("id")))
    return jobs.where(failed).withColumn("rank", rank).where(F.col("rank") <= most)
