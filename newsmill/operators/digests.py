"""Digest building blocks: packing under a budget, backlog, daily windows, retention, history, language."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsmill.functions import vocab as V
from newsmill.operators.keyed import systematic_sample
from newsmill.sources.views import stage


def in_order(rows: DataFrame, by: str, order: list[str], cost: str) -> DataFrame:
    """Adds before (the costs of the rows before it in its group), for groups of any size.

    Rows are dealt by ranges of (group, order), summed up in their part, and shifted by the sums of the parts before, of
    which there is one row for each part and group.
    """
    ranged = rows.repartitionByRange(by, *order).sortWithinPartitions(by, *order)
    held = stage(ranged.withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}), "in-order")
    own = Window.partitionBy(by, "_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    sums = held.groupBy(by, "_part").agg(F.sum(cost).alias("_sum"))
    earlier = Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col(by).alias("_by"), F.col("_part").alias("_p"), F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_shift"))
    out = held.withColumn("_inside", F.coalesce(F.sum(cost).over(own), F.lit(0)))
    out = out.join(sums, out[by].eqNullSafe(sums["_by"]) & (out["_part"] == sums["_p"]))
    return out.withColumn("before", (F.col("_inside") + F.col("_shift")).cast("long")).drop("_part", "_row", "_inside", "_shift", "_by", "_p")


def pack_by_budget(rows: DataFrame, by: str, order: list[str], cost: str, budget: int, width: int = 64) -> DataFrame:
    """part: rows in order are packed into parts whose costs stay within the budget; a row costs 1 to the budget.

    Where a part begins depends on all before it, yet from any row the next part's begin is known: the last row whose
    sum of costs before it exceeds its own by no more than the budget. A group is cut into blocks of `width` budgets. A
    part can enter a block at few rows, those of its first budget; for each of them the way through the block is
    followed once, giving the row where it enters the next block and how many parts began. These links are doubled
    (2, 4, 8 blocks at a time), each block picks its true entry from the doublings that make up its number, and its rows
    are numbered from there. So a group is spread over as many tasks as it has blocks, and no task holds it.
    """
    if {"before", "_block", "_tail", "_price"} & set(rows.columns):
        raise ValueError("columns before, _block, _tail and _price are taken")
    wide = width * budget
    priced = rows.withColumn("_price", F.least(F.greatest(F.col(cost).cast("long"), F.lit(1)), F.lit(budget)))
    held = stage(in_order(priced, by, order, "_price"), "priced")
    block = F.expr(f"before div {wide}")
    own = held.select(F.col(by).alias("g"), block.alias("block"), "before", F.lit(False).alias("tail"))
    # a block also sees the next one's first budget, where its last part may end
    tails = own.where((F.col("block") > 0) & (F.col("before") <= F.col("block") * wide + budget)).select("g", (F.col("block") - 1).alias("block"), "before", F.lit(True).alias("tail"))
    kind = rows.schema[by].dataType.simpleString()

    def ways(pdf: pd.DataFrame) -> pd.DataFrame:
        """From each row where a part may begin first in a block: where the next block is entered, and how many parts began."""
        before = np.sort(pdf["before"].to_numpy())
        begin = int(pdf["block"].iloc[0]) * wide
        inside = int(np.searchsorted(before, begin + wide, "left"))
        further = np.searchsorted(before, before + budget, "right") - 1  # the next part's first row
        to, n = np.full(len(before), -1, "int64"), np.ones(len(before), "int64")
        for i in range(inside - 1, -1, -1):
            j = int(further[i])
            if j <= i:
                continue  # the last row of the group
            if j >= inside:
                to[i] = before[j]
            else:
                to[i], n[i] = to[j], n[j] + 1
        first = int(np.searchsorted(before, begin + budget, "right")) if begin else 1
        first = min(first, inside)
        return pd.DataFrame({"g": pdf["g"].iloc[:first].tolist(), "at": before[:first], "to": [None if x < 0 else x for x in to[:first]], "n": n[:first]}).astype({"to": "Int64"})

    links = own.unionByName(tails).groupBy("g", "block").applyInPandas(ways, f"g {kind}, at long, to long, n long")
    jump = stage(links, "links")
    blocks = own.groupBy("g").agg(F.max("block").alias("last"))
    most = blocks.agg(F.max("last")).first()[0] or 0
    jumps = [jump]
    while 2 ** len(jumps) <= most:
        next_ = jumps[-1].select(F.col("g").alias("_g"), F.col("at").alias("_at"), F.col("to").alias("_to"), F.col("n").alias("_n"))
        two = jumps[-1].where("to IS NOT NULL").join(next_, F.col("g").eqNullSafe(F.col("_g")) & (F.col("to") == F.col("_at")))
        jumps.append(stage(two.select("g", "at", F.col("_to").alias("to"), (F.col("n") + F.col("_n")).alias("n")), "links"))
    entry = blocks.select("g", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("block"), F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("parts"))
    for k in range(len(jumps) - 1, -1, -1):
        # one left join a doubling: with a branch for each value of the bit, the plan would double with the doublings
        far = jumps[k].select(F.col("g").alias("_g"), F.col("at").alias("_at"), F.col("to").alias("_to"), F.col("n").alias("_n"))
        bit = F.shiftright("block", k).bitwiseAND(F.lit(1)) == 1
        moved = entry.withColumn("_from", F.when(bit, F.col("at"))).join(far, F.col("g").eqNullSafe(F.col("_g")) & (F.col("_from") == F.col("_at")), "left")
        moved = moved.where(~bit | F.col("_at").isNotNull())
        entry = moved.select("g", "block", F.when(bit, F.col("_to")).otherwise(F.col("at")).alias("at"), (F.col("parts") + F.when(bit, F.col("_n")).otherwise(F.lit(0))).alias("parts"))
    entry = stage(entry, "entries")

    def number(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("before")
        before, at = pdf["before"].to_numpy(), int(pdf["at"].iloc[0]) if pdf["at"].notna().iloc[0] else None
        begins = np.zeros(len(before), "int64")
        i = len(before) if at is None else int(np.searchsorted(before, at, "left"))
        while i < len(before):
            begins[i] = 1
            j = int(np.searchsorted(before, before[i] + budget, "right")) - 1
            if j <= i or before[-1] <= before[i]:
                break
            if j == len(before) - 1 and before[j] + int(pdf["price"].iloc[-1]) <= before[i] + budget:
                break  # the part goes on beyond the block
            i = j
        return pd.DataFrame({"g": pdf["g"], "before": before, "part": int(pdf["parts"].iloc[0]) + np.cumsum(begins)})

    numbers = held.select(F.col(by).alias("g"), block.alias("block"), "before", F.col("_price").alias("price"))
    e = entry.select(F.col("g").alias("_g"), F.col("block").alias("_b"), "at", "parts")
    numbers = numbers.join(e, F.col("g").eqNullSafe(F.col("_g")) & (F.col("block") == F.col("_b"))).select("g", "block", "before", "price", "at", "parts")
    numbers = numbers.groupBy("g", "block").applyInPandas(number, f"g {kind}, before long, part long").withColumnRenamed("before", "_before")
    return held.join(numbers, F.col(by).eqNullSafe(F.col("g")) & (F.col("before") == F.col("_before"))).select(*rows.columns, "part")


def backlog(window_counts: DataFrame, last_closed, behind: int = 4, minutes: int = 30) -> DataFrame:
    """Per channel: the oldest due window, how far it is behind, and whether its rows form one catch-up digest."""
    due = window_counts.where(F.col("window_end") <= F.lit(last_closed).cast("timestamp"))
    late = (F.unix_seconds(F.lit(last_closed).cast("timestamp")) - F.unix_seconds("oldest")) / (60 * minutes)
    g = due.groupBy("channel_id").agg(F.min("window_end").alias("oldest"), F.sum("posts").alias("posts"))
    return g.select("channel_id", "oldest", "posts", late.cast("long").alias("intervals_behind"), F.when(late >= behind, "catchup").otherwise("single").alias("mode"))


def due_windows(window_counts: DataFrame, last_closed, behind: int = 4, minutes: int = 30) -> DataFrame:
    """channel_id, window_end, posts, behind, stranded, place and mode of every closed window, the oldest first.

    A window is stranded if it lies `behind` windows or more behind the last closed one; a channel that has such a one
    gets one catch-up digest of all its due windows.
    """
    last = F.lit(last_closed).cast("timestamp")
    due = window_counts.where(F.col("window_end") <= last)
    late = ((F.unix_seconds(last) - F.unix_seconds("window_end")) / (60 * minutes)).cast("long")
    channel = Window.partitionBy("channel_id")
    due = due.withColumn("behind", late)
    mode = F.when(F.max("behind").over(channel) >= behind, "catchup").otherwise("single")
    return due.select("channel_id", "window_end", "posts", "behind", (F.col("behind") >= behind).alias("stranded"), F.row_number().over(channel.orderBy("window_end")).alias("place"), mode.alias("mode"))


def daily_sample(posts: DataFrame, most: int = 300) -> DataFrame:
    """channel_id, day, posts, sampled, first_id, last_id: each day's digest takes at most some posts, in even steps."""
    day = posts.withColumn("day", F.date_trunc("day", "ts"))
    whole = day.groupBy("channel_id", "day").agg(F.count(F.lit(1)).alias("posts"))
    kept = systematic_sample(day.select("channel_id", "day", "ts", "message_id"), most, ["ts", "message_id"], ["channel_id", "day"])
    kept = kept.groupBy("channel_id", "day").agg(F.count(F.lit(1)).alias("sampled"), F.min("message_id").alias("first_id"), F.max("message_id").alias("last_id"))
    return whole.join(kept, ["channel_id", "day"]).select("channel_id", "day", "posts", "sampled", "first_id", "last_id")


def prune(archive: DataFrame, now, hours: int = 24, least_hours: int = 72) -> DataFrame:
    """Rows of the archive that a digest of some hours still keeps: three times as long, but at least some hours."""
    return expire(archive, now, max(3 * hours, least_hours))


def last_closed(posts: DataFrame, minutes: int = 30):
    """The end of the last window that the newest post closes; null without posts."""
    newest = posts.agg(F.max(F.unix_seconds("ts"))).first()[0]
    return F.timestamp_seconds(F.lit(None if newest is None else newest - newest % (60 * minutes)).cast("long"))


def daily(posts: DataFrame) -> DataFrame:
    """A digest row per channel and day, [00:00, 24:00), for every day that has posts."""
    g = posts.groupBy("channel_id", F.date_trunc("day", "ts").alias("day"))
    return g.agg(F.count(F.lit(1)).alias("posts"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def recent_history(turns: DataFrame, by: str, order: str, k: int) -> DataFrame:
    """The last k turns of each conversation."""
    return turns.withColumn("back", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order)))).where(F.col("back") <= k)


def live_history(turns: DataFrame, by: str, order: list[str], k: int, now, hours: int = 24) -> DataFrame:
    """The last k turns (with ts) of each sender whose newest one is at most `hours` before now; order breaks ties of ts.

    Turns older than that stay where the sender is live. Null times are the oldest; a sender without any time isn't live.
    The newest k are found before the shuffle, so a hot sender moves k rows a task.
    """
    newest = Window.partitionBy(by).orderBy(F.desc("ts"), *[F.desc(c) for c in order])
    last = turns.withColumn("back", F.row_number().over(newest)).where(F.col("back") <= k)
    last = last.withColumn("_newest", F.max("ts").over(Window.partitionBy(by)))
    return last.where(F.unix_micros("_newest") >= F.unix_micros(F.lit(now).cast("timestamp")) - hours * 3_600_000_000).drop("_newest")


def expire(rows: DataFrame, now, hours: int) -> DataFrame:
    """Rows no older than their time to live."""
    return rows.where(F.unix_seconds("ts") >= F.unix_seconds(F.lit(now).cast("timestamp")) - hours * 3600)


def needs_translation(text, english=V.ENGLISH_WORDS, cues=V.FOREIGN_CUES):
    """Whether a line isn't English; false for null and empty ones.

    It isn't if it has an Arabic or Cyrillic letter, or four letters or more outside ASCII. Among six words or more two
    such letters and one English word at most are enough, among eight one letter and no English word; and among five
    words or more without an English one, a cue word is.
    """
    text = F.coalesce(text, F.lit(""))
    foreign = F.regexp_count(text, F.lit(r"\p{L}")) - F.regexp_count(text, F.lit("[A-Za-z]"))

    def known(pattern, words):
        found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.lower)
        return F.size(found), F.size(F.filter(found, lambda w: w.isin(*words)))

    n, some = known(r"[A-Za-z\x{C0}-\x{FF}][A-Za-z\x{C0}-\x{FF}'/-]*", english)
    plain, cue = known("[A-Za-z][A-Za-z'/-]*", cues)
    _, plain_some = known("[A-Za-z][A-Za-z'/-]*", english)
    script = text.rlike(r"[\x{600}-\x{6FF}\x{750}-\x{77F}\x{8A0}-\x{8FF}\x{400}-\x{4FF}]")
    few = (n >= 6) & (((foreign >= 2) & (some <= 1)) | ((foreign >= 1) & (some == 0) & (n >= 8)))
    return script | (foreign >= 4) | few | ((plain >= 5) & (plain_some == 0) & (cue > 0))
