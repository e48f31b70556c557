"""Feed files as evidence rows, and posts without the names of their sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsmill.functions import text as T

ITEM = "title string, link string, description string, pubDate string"
#: Formats of a publication date that feeds use, without the name of the day.
DATES = ("d MMM yyyy HH:mm:ss z", "d MMM yyyy HH:mm:ss Z", "yyyy-MM-dd'T'HH:mm:ssXXX")


def feed_items(spark: SparkSession, path: str, allowed: list[str], start, end, now) -> DataFrame:
    """host, title, link, published, snippet: items of fetched feed files with a title and link of an allowed host.

    Items are published in [start, end) and at most five minutes after now; of items of one host and title (whatever
    its case) the newest stays.
    """
    i = spark.read.schema(ITEM).format("xml").option("rowTag", "item").load(path)
    time = lambda x: F.lit(x).cast("timestamp")
    i = i.select(T.squeeze(F.coalesce("title", F.lit(""))).alias("title"), T.squeeze(F.coalesce("link", F.lit(""))).alias("link"), T.squeeze(F.coalesce("description", F.lit(""))).alias("description"), F.coalesce(*[F.try_to_timestamp(F.regexp_replace(F.trim("pubDate"), "^[A-Za-z]{3},\\s*", ""), F.lit(d)) for d in DATES]).alias("published"))
    i = i.withColumn("host", F.lower(F.try_parse_url("link", F.lit("HOST")))).where((F.col("title") != "") & F.col("link").rlike("^https?://"))
    i = i.where(allowed_host(F.col("host"), allowed) & (F.col("published") >= time(start)) & (F.col("published") < time(end)) & (F.col("published") <= time(now) + F.expr("interval 5 minutes")))
    once = Window.partitionBy("host", F.lower("title")).orderBy(F.desc("published"), "link")
    i = i.withColumn("rank", F.row_number().over(once)).where("rank = 1")
    text = F.when(F.col("description") == "", F.col("title")).otherwise(F.concat_ws(". ", "title", "description"))
    return i.select("host", "title", "link", "published", T.cut_at_word(text, 700).alias("snippet"))


def allowed_host(host: Column, allowed: list[str]) -> Column:
    """Whether a host is one of the domains or below one; an empty list allows all."""
    if not allowed:
        return F.lit(True)
    return host.rlike(r"(?:^|\.)(?:" + "|".join(d.lower().replace(".", r"\.") for d in allowed) + ")$")


def strip_aliases(posts: DataFrame, aliases: DataFrame) -> DataFrame:
    """Posts whose text no longer names its channel (channel_id, alias): mentions, prefixes and lines of only a name go.

    A channel's aliases are a few rows; they become one pattern, the longest alias first, and join on the channel.
    """
    quoted = F.regexp_replace("alias", r"([\\.\[\]{}()*+?^$|-])", r"\\$1")
    order = F.transform(F.sort_array(F.collect_set(F.struct((-F.length("alias")).alias("n"), quoted.alias("a")))), lambda x: x["a"])
    patterns = aliases.where("alias <> ''").groupBy("channel_id").agg(F.array_join(order, "|").alias("any"))
    p = posts.join(patterns, "channel_id", "left")
    pattern = lambda head, tail: F.concat(F.lit(head), F.col("any"), F.lit(tail))
    clean = lambda t: F.trim(F.regexp_replace(F.regexp_replace(t, pattern(r"(?i)^\s*(?:", r")\s*[:|-]\s*"), F.lit("")), pattern("(?i)@(?:", r")\b"), F.lit("")))
    lines = F.filter(F.transform(F.split("raw_text", "\n", -1), clean), lambda t: ~F.regexp_like(t, pattern("(?i)^(?:", r")\W*$")))
    return p.withColumn("raw_text", F.when(F.col("any").isNull(), F.col("raw_text")).otherwise(F.array_join(lines, "\n"))).select(*posts.columns)
