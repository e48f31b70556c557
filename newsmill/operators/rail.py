"""Headline rails: matching headlines with the posts of their window, ranking them, and digest rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsmill.functions import text as T
from newsmill.functions import vocab as V
from newsmill.functions.fuzzy import profile, ratio_bound, ratio_once
from newsmill.sources.views import stage

SEVERITY = {"high": 3.0, "medium": 1.5}


def line_key(x: Column) -> Column:
    return T.alphanumeric(F.lower(F.coalesce(x, F.lit(""))))


def topics(words: Column) -> Column:
    """The distinct words of a line_key that are four letters or longer and no stop words."""
    return F.array_except(F.filter(words, lambda w: F.length(w) >= 4), F.array(*[F.lit(w) for w in V.DUPE_STOP_WORDS]))


#: A headline and a post are compared if they share so many topic words, or so large a part of the headline's.
SHARED, COVERED = 3, 0.42
#: Otherwise their characters must agree to this degree.
ALIKE = 0.55


#: A window's lines are dealt into blocks of about so many lines and characters.
LINES, CHARS = 1024, 1_000_000


#: What lines and posts may share, and its elements in a text.
SHARES = ("topic", "numbers", "names")


def _rail_side(rows: DataFrame, text: str) -> DataFrame:
    """rows without a text, but with its line of characters, length, topic words, numbers and names."""
    held, x = [c for c in rows.columns if c != text], F.col(text)
    r = rows.select(*held, x.alias("_text"), line_key(x).alias("line")).withColumn("_words", F.split("line", " "))
    # a number word is a word of the line, unless digits stand beside it
    some = F.arrays_overlap("_words", F.array(*[F.lit(w) for w in V.NUMBER_WORDS])) | F.col("line").rlike("[0-9]")
    numbers = F.when(some, T.numbers(F.col("_text"))).otherwise(F.array().cast("array<string>"))
    return r.select(*held, "line", F.length("line").alias("length"), topics(F.col("_words")).alias("topic"), numbers.alias("numbers"), T.names(F.col("_text")).alias("names"))


def _places(some: Column, among: Column) -> Column:
    """The places of some elements in an array."""
    return F.transform(some, lambda w: F.array_position(among, w))


def blocks(headlines: DataFrame) -> DataFrame:
    """window_end, lines and all their topic words, numbers and names: one row a window, more where it has many lines.

    The lines have the places of theirs among all of them.
    """
    size = F.greatest(F.count(F.lit(1)) / LINES, F.sum(F.length("headline")) / CHARS, F.lit(1.0))
    deals = headlines.groupBy("window_end").agg(F.ceil(size).alias("deals"))
    h = headlines.select("window_end", "line_id", "headline").join(deals, "window_end").withColumn("deal", F.pmod(F.xxhash64("line_id"), "deals")).drop("deals")
    h = _rail_side(h, "headline").withColumn("profile", profile(F.col("line")))
    dealt = h.groupBy("window_end", "deal").agg(F.collect_list(F.struct("line_id", "line", "length", "profile", *SHARES)).alias("lines"))
    dealt = dealt.select("window_end", "lines", *[F.array_distinct(F.flatten(F.col(f"lines.{c}"))).alias(f"all_{c}") for c in SHARES])
    coded = lambda m: F.struct(*[m[c].alias(c) for c in ("line_id", "line", "length", "profile")], *[_places(m[c], F.col(f"all_{c}")).alias(c) for c in SHARES])
    return stage(dealt.withColumn("lines", F.transform("lines", coded)), "rail-lines")


def overlaps(headlines: DataFrame, posts: DataFrame) -> DataFrame:
    """Pairs of a window that the rejection rules leave open, with what they share: both, coverage, density, num, name,
    same, the two lines of characters and the bound of their ratio.

    A post's text moves once, to the lines of its window; there its words that no line has are left out, the others are
    told by their places, and only pairs that stay become rows. Pairs that share only a number or a name must be alike in
    their characters, which bounds the quotient of their lengths.
    """
    p = _rail_side(posts.select("window_end", "id", "text").join(blocks(headlines), "window_end"), "text")
    met = [F.array_intersect(c, f"all_{c}").alias(c) for c in SHARES]
    p = p.select("window_end", "id", "lines", F.col("line").alias("p_line"), F.col("length").alias("p_length"), F.size("topic").alias("p_words"), *met, *[f"all_{c}" for c in SHARES])
    p = p.select("window_end", "id", "lines", "p_line", "p_length", "p_words", profile(F.col("p_line")).alias("p_profile"), *[_places(F.col(c), F.col(f"all_{c}")).alias(f"p_{c}") for c in SHARES])
    m = p.select(*[c for c in p.columns if c != "lines"], F.explode("lines").alias("m"))
    share = lambda n: F.col("both") / F.greatest(n, F.lit(1))
    pairs = m.withColumns({"both": F.size(F.array_intersect("p_topic", "m.topic")), "num": F.arrays_overlap("p_numbers", "m.numbers"), "name": F.arrays_overlap("p_names", "m.names")})
    pairs = pairs.withColumns({"coverage": share(F.size("m.topic")), "density": share(F.col("p_words"))})
    close = 2 * F.least("m.length", "p_length") >= ALIKE * (F.col("m.length") + F.col("p_length"))
    pairs = pairs.where((F.col("coverage") >= COVERED) | (F.col("both") >= SHARED) | close & (F.col("num") | F.col("name")))
    same = (F.col("coverage") >= 0.6) & (F.col("both") >= 3)
    return pairs.select("window_end", "m.line_id", "id", F.col("m.line").alias("h_line"), "p_line", ratio_bound(F.col("m.profile"), F.col("p_profile")).alias("most"), "both", "coverage", "density", "num", "name", same.alias("same"))


def match_posts(headlines: DataFrame, posts: DataFrame) -> DataFrame:
    """line_id, id, match: headlines (window_end, line_id, headline) with posts (window_end, id, text, ...) of their window."""
    pairs = overlaps(headlines, posts)
    sure = F.col("same") | (F.col("coverage") >= 0.58)
    pairs = pairs.where(sure | (F.col("most") >= ALIKE)).withColumn("sure", sure).withColumn("ratio", ratio_once("h_line", "p_line"))
    pairs = pairs.where(F.col("sure") | (F.col("ratio") >= ALIKE))
    score = F.col("ratio") + F.col("coverage") + 0.35 * F.col("density") + 1.5 * F.col("same").cast("int") + 0.4 * F.col("num").cast("int") + 0.35 * F.col("name").cast("int")
    return pairs.select("window_end", "line_id", "id", score.alias("match"))


def strength(headline: Column) -> Column:
    """Numbers, names and length of a line, each up to a bound."""
    n = lambda c, most: F.least(F.lit(most), c.cast("double"))
    return n(F.regexp_count(headline, F.lit(r"\b\d+\b")), 2.0) + n(F.size(T.names(headline)), 2.0) + n(F.size(F.split(headline, " ")) / 10.0, 1.5)


def rank(headlines: DataFrame, posts: DataFrame, matches: DataFrame, half_life: float = 900.0) -> DataFrame:
    """window_end, line_id, headline, score, rank: each line by its best post, freshness, severity and corroboration.

    headlines: window_end, line_id, headline, place (from 0); posts: window_end, id, source, ts, severity, bonus. The
    window's end is the present.
    """
    m = matches.join(posts.select("id", "source", "ts", "severity", "bonus"), "id")
    best = m.groupBy("line_id").agg(F.max_by(F.struct("ts", "severity", "bonus", "match"), F.struct("match", "ts", "id")).alias("b"), F.count_distinct("source").alias("sources"))
    r = headlines.join(best, "line_id", "left")
    age = F.greatest(F.lit(0), F.unix_seconds("window_end") - F.unix_seconds("b.ts"))
    fresh = F.when(F.col("b").isNull(), 0.35).otherwise(F.pow(F.lit(0.5), age / half_life))
    severity = F.lit(0.5)
    for name, value in SEVERITY.items():
        severity = F.when(F.col("b.severity") == name, value).otherwise(severity)
    together = F.least(F.lit(1.2), 0.4 * F.greatest(F.coalesce("sources", F.lit(1)) - 1, F.lit(0)))
    score = 0.15 * strength(F.col("headline")) + 1 / (1 + 0.35 * F.col("place")) + severity + fresh + F.coalesce("b.bonus", F.lit(0.0)) + together + 0.25 * F.coalesce("b.match", F.lit(0.0))
    r = r.withColumn("score", F.round(score, 6))
    return r.withColumn("rank", F.row_number().over(Window.partitionBy("window_end").orderBy(F.desc("score"), "place"))).select("window_end", "line_id", "headline", "score", "rank")


def digest_rows(ranked: DataFrame, most: int = 12) -> DataFrame:
    """window_end, section, pos, line: distinct lines as headline, highlights and what also moves."""
    once = Window.partitionBy("window_end", line_key(F.col("headline"))).orderBy("rank")
    r = ranked.withColumn("_k", F.row_number().over(once)).where("_k = 1")
    w = Window.partitionBy("window_end")
    r = r.withColumns({"pos": F.row_number().over(w.orderBy("rank")), "n": F.count(F.lit(1)).over(w)})
    also = F.greatest(F.lit(1), F.least(F.lit(3), F.floor(F.col("n") / 3)))
    section = F.when(F.col("pos") == 1, "headline").when(F.col("pos") <= most + 1, "highlights").otherwise("also_moving")
    return r.where(F.col("pos") <= most + 1 + also).select("window_end", section.alias("section"), F.col("pos").cast("long").alias("pos"), F.col("headline").alias("line"))
