"""Attributions in posts: who a line is from is cut off or said in general terms, with counts of what was cut.

A label is looked up in an array (of a post's channel, say), so any number of labels costs no pattern of its own.
All steps are column functions: no post moves, and a dimension of labels is joined by its channel.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsmill.functions import text as T


@dataclass(frozen=True)
class Wording:
    """Words that show an attribution; all of them are matched in either case as whole words."""

    verbs: tuple = ("reported", "reports", "said", "says", "claimed", "claims", "indicated", "indicates", "warned")
    opening: str = "according to"
    kinds: tuple = ("media", "source", "sources", "outlet", "channel", "network", "agency", "press", "radio", "tv")
    early: tuple = ("preliminary", "initial", "early", "unconfirmed")
    hedges: tuple = ("reportedly", "alleged", "allegedly", "unconfirmed", "claims", "claimed", "may", "might", "could", "possibly", "suspected", "reports")


def _whole(words) -> str:
    return rf"(?<![A-Za-z0-9_])(?:{'|'.join(words)})(?![A-Za-z0-9_])"


def rewrite(line: Column, labels: Column, w: Wording = Wording()) -> Column:
    """text and cut: a line (white space squeezed) without its attributions, and how many were cut.

    In order: `label: rest` and `label | rest`, `label said (that) rest`, each for a label of the array (lower-case; null:
    none); every `according to ... agency`; `reports of rest` becomes `Reports indicate rest`, with its first word kept
    where that says how early they are. Where something was cut and no hedge is left, initial reports are what the line says.
    A line that is all attribution becomes empty; null is an empty line.
    """
    known = lambda x: F.coalesce(F.array_contains(labels, F.lower(F.trim(x))), F.lit(False))
    state = lambda text, cut: F.struct(text.alias("text"), cut.cast("int").alias("cut"))

    def led(pattern):
        def step(s):
            label, rest = (F.regexp_extract(s["text"], pattern, i) for i in (1, 2))
            return F.when((label != "") & known(label), state(F.trim(rest), s["cut"] + 1)).otherwise(s)

        return step

    clause = rf"(?i),? ?{_whole([w.opening])} [^.,;:]{{0,80}}?{_whole(w.kinds)}[,:]? ?"

    def according(s):
        n = F.regexp_count(s["text"], F.lit(clause))
        return F.when(n > 0, state(T.squeeze(F.regexp_replace(s["text"], clause, " ")), s["cut"] + n)).otherwise(s)

    of = rf"(?is)^(?:({'|'.join(w.early)}) (?:[a-z-]+ )?|there (?:are|were) )?reports? of (.+)$"

    def reports(s):
        first, rest = (F.regexp_extract(s["text"], of, i) for i in (1, 2))
        said = F.when(first == "", F.lit("Reports")).otherwise(F.concat(F.upper(F.substring(first, 1, 1)), F.lower(F.substring(first, 2, 99)), F.lit(" reports")))
        return F.when(rest != "", state(F.concat(said, F.lit(" indicate "), rest), s["cut"])).otherwise(s)

    def hedged(s):
        bare = (s["cut"] > 0) & (s["text"] != "") & ~s["text"].rlike(f"(?i){_whole(w.hedges)}")
        return F.when(bare, state(F.concat(F.lit("Initial reports indicate "), s["text"]), s["cut"])).otherwise(s)

    out = state(T.squeeze(F.coalesce(line, F.lit(""))), F.lit(0))
    steps = (led(r"(?s)^([^:|]{1,60}?) ?[:|] (.+)$"), led(rf"(?is)^(.{{1,60}}?) (?:{'|'.join(w.verbs)}) (?:that )?(.+)$"), according, reports, hedged)
    for step in steps:
        out = T.let(out, step)
    return out


def clean_posts(posts: DataFrame, labels: DataFrame, w: Wording = Wording()) -> DataFrame:
    """message_id, ts, text, kept, removed and citations of posts (message_id, channel_id, ts, raw_text).

    labels: channel_id, label, in any case; a channel without labels loses clauses only. Lines are cleaned of markup, links
    and handles, then rewritten; empty ones and later repeats (whatever their case) go. removed counts the lines of the
    post that are gone, citations the attributions that were cut. A null text has one line, which goes.
    """
    known = labels.where("label IS NOT NULL").groupBy(F.col("channel_id").alias("_of")).agg(F.collect_set(F.lower(F.trim("label"))).alias("_labels"))
    p = posts.select("message_id", "channel_id", "ts", F.coalesce("raw_text", F.lit("")).alias("raw_text")).join(known, F.col("channel_id") == F.col("_of"), "left")
    lines = F.transform(T.clean_lines(F.col("raw_text")), lambda t: rewrite(t, F.col("_labels"), w))
    p = p.select("message_id", "ts", F.size(F.split("raw_text", "\n", -1)).alias("n"), lines.alias("lines"))
    some = F.filter(F.transform("lines", lambda s: s["text"]), lambda t: t != "")
    once = T.let(some, lambda ls: F.filter(ls, lambda t, i: F.array_position(F.transform(ls, F.lower), F.lower(t)) == i + 1))
    cut = F.aggregate("lines", F.lit(0), lambda a, s: a + s["cut"])
    p = p.select("message_id", "ts", "n", once.alias("kept"), cut.alias("citations"))
    return p.select("message_id", "ts", F.array_join("kept", "\n").alias("text"), F.size("kept").alias("kept"), (F.col("n") - F.size("kept")).alias("removed"), "citations")


def digest_counts(cleaned: DataFrame, length: str = "30 minutes") -> DataFrame:
    """window_end, posts, empty, removed and citations of windows closed on the right, from a result of clean_posts."""
    end = F.window(F.col("ts") - F.expr("interval 1 microsecond"), length).getField("end")
    return cleaned.groupBy(end.alias("window_end")).agg(F.count(F.lit(1)).alias("posts"), F.count_if(F.col("kept") == 0).alias("empty"), F.sum("removed").alias("removed"), F.sum("citations").alias("citations"))
