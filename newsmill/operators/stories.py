"""Story facts, changes between them, headlines, subjects and topics across digests."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsmill.functions import text as T
from newsmill.sources.views import stage
from newsmill.streaming.windows import pieces


def bounded(word: str) -> str:
    """A pattern for a word with no ASCII letter, digit or underscore at its sides."""
    return rf"(?i)(?<![A-Za-z0-9_]){word}(?![A-Za-z0-9_])"


def neutralise(text: Column, replacements: list[tuple[str, str]]) -> Column:
    """Loaded words replaced in the order of the rules."""
    for word, by in replacements:
        text = F.regexp_replace(text, bounded(word), by)
    return text


def facts(posts: DataFrame, actors: list[str], official: list[str]) -> DataFrame:
    """id, channel_id, ts, numbers, actors, official of each post."""
    low = F.lower(F.coalesce(F.col("raw_text"), F.lit("")))
    words = F.array_distinct(F.regexp_extract_all(low, F.lit("[a-z0-9]+"), F.lit(0)))
    return posts.select(F.col("message_id").alias("id"), "channel_id", "ts", F.array_distinct(F.regexp_extract_all(low, F.lit("[0-9]+"), F.lit(0))).alias("numbers"), F.filter(words, lambda w: w.isin(actors)).alias("actors"), F.exists(words, lambda w: w.isin(official)).alias("official"))


def delta_kind(now: str, before: str) -> Column:
    """The first material change between two fact sets, or none."""
    n, b = (lambda c: F.col(f"{now}.{c}")), (lambda c: F.col(f"{before}.{c}"))
    counts = (F.size(n("numbers")) > 0) & ((F.size(F.array_except(n("numbers"), b("numbers"))) > 0) | (F.size(F.array_except(b("numbers"), n("numbers"))) > 0))
    actors = (F.size(n("actors")) > 0) & (F.size(b("actors")) > 0) & ~F.arrays_overlap(n("actors"), b("actors"))
    return F.when(F.col(before).isNull(), "first").when(counts, "count_change").when(actors, "actor_change").when(n("official") & ~b("official"), "official_confirmation").otherwise("none")


def changes(story_facts: DataFrame, by: str) -> DataFrame:
    """Each post's change against the one before it in its group."""
    f = story_facts.withColumn("now", F.struct("numbers", "actors", "official"))
    f = f.withColumn("before", F.lag("now").over(Window.partitionBy(by).orderBy("ts", "id")))
    return f.select("id", by, delta_kind("now", "before").alias("delta_kind"))


def headlines(posts: DataFrame, keywords: list[str]) -> DataFrame:
    """The sentence of each post with most keywords, then the shortest, then the first."""
    s = posts.select(F.col("message_id").alias("id"), F.posexplode(T.sentences(F.col("raw_text"))).alias("at", "sentence"))
    words = F.regexp_extract_all(F.lower("sentence"), F.lit("[a-z0-9]+"), F.lit(0))
    hits = F.size(F.array_intersect(words, F.array(*[F.lit(k) for k in keywords])))
    return s.groupBy("id").agg(F.min_by(F.struct("sentence", hits.alias("hits")), F.struct(-hits, F.length("sentence"), "at")).alias("b")).select("id", F.col("b.sentence").alias("headline"), F.col("b.hits").alias("hits"))


def name_runs(text: Column) -> Column:
    """Runs of adjacent capitalised words, as arrays of their words; other characters than letters end a run."""
    t = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"[ \t\r\n]+", "  "), "[^A-Za-z ]", "|")
    # a possessive loop needs no stack, so runs may be of any length
    runs = F.regexp_extract_all(F.concat(F.lit(" "), t, F.lit(" ")), F.lit(r" \|*((?:[A-Z][a-z]{2,}  (?=[A-Z][a-z]{2,}\|* ))*+[A-Z][a-z]{2,})\|* "), F.lit(1))
    return F.transform(runs, lambda r: F.split(r, "  "))


def stretches(run: Column) -> Column:
    """For 1, 2, 4, ... words the hashes of a run's stretches of that length, one for each word where one begins.

    A hash is made of those of its two halves, so a run of n words costs n log n.
    """
    first = F.transform(run, lambda w: F.xxhash64(w))
    half = lambda j: F.pow(F.lit(2), j - 1).cast("int")
    join = lambda h, d: F.zip_with(F.slice(h, F.lit(1), F.size(h) - d), F.slice(h, d + 1, F.size(h) - d), lambda a, b: F.xxhash64(a, b))
    steps = F.when(F.size(run) > 1, F.sequence(F.lit(1), F.length(F.bin(F.size(run))) - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, F.array(first), lambda all_, j: F.concat(all_, F.array(join(F.element_at(all_, -1), half(j)))))


#: Weights of a mention: on the web, of a name of several words, of a single word.
ON_WEB, SEVERAL, SINGLE = 0.35, 0.75, 0.15


def phrase_mentions(posts: DataFrame, by: str) -> DataFrame:
    """by, name, words, mentions, web_mentions: names of one or more words, with nested ones corrected for.

    A name is a whole run of capitalised words somewhere in its group. Inside a longer run it counts only if that run
    occurs once in the group: a run that recurs is a name of its own, and its parts aren't mentioned. Names meet runs on
    the hash of their first words, as many as the largest power of two that a name has; what meets is compared.
    """
    web = F.col("is_web") if "is_web" in posts.columns else F.lit(False)
    runs = posts.select(by, web.cast("int").alias("web"), F.explode(name_runs(F.col("raw_text"))).alias("run"))
    whole = runs.groupBy(by, "run").agg(F.count(F.lit(1)).alias("n"), F.sum("web").alias("w"))
    whole = stage(whole.withColumn("id", F.monotonically_increasing_id()), "name-runs")
    m = F.size("run")
    once = whole.where((F.col("n") == 1) & (m > 1))
    at = once.select(F.col(by).alias("_by"), "id", m.alias("m"), F.posexplode(stretches(F.col("run"))).alias("j", "hashes"))
    at = at.select("_by", "id", "m", "j", F.posexplode("hashes").alias("i", "h"))
    last = F.element_at(stretches(F.col("run")), -1)
    names = whole.select(by, F.col("run").alias("name"), (F.length(F.bin(m)) - 1).alias("_j"), F.get(last, F.lit(0)).alias("_h"))
    near = names.join(at, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_j") == F.col("j")) & (F.col("_h") == F.col("h"))).where(F.size("name") < F.col("m")).select("id", "i", "name")
    nested = near.join(once, "id").where(F.slice("run", F.col("i") + 1, F.size("name")) == F.col("name"))
    both = whole.drop("id").unionByName(nested.select(by, F.col("name").alias("run"), F.lit(1).cast("long").alias("n"), "w"))
    sums = both.groupBy(by, "run").agg(F.sum("n").alias("mentions"), F.sum("w").alias("web_mentions"))
    return sums.select(by, F.array_join("run", " ").alias("name"), F.size("run").alias("words"), "mentions", "web_mentions")


def subject_votes(posts: DataFrame, by: str, least: float = 1.5) -> DataFrame:
    """The capitalised name with most votes in each group, by score, words, length.

    A mention counts 1, more on the web (is_web, where there is such a column) and for names of several words.
    """
    names = phrase_mentions(posts, by)
    each = F.when(F.col("words") > 1, 1 + SEVERAL).otherwise(1 + SINGLE)
    votes = names.withColumn("score", F.round(each * F.col("mentions") + ON_WEB * F.col("web_mentions"), 4)).where(F.col("score") >= least)
    best = F.max(F.struct("score", "words", F.length("name").alias("length"), "name")).alias("b")
    return votes.groupBy(by).agg(best).select(by, F.col("b.name").alias("subject"), F.col("b.words").alias("words"), F.col("b.score").alias("score"))


def cross_digest_topics(lines: DataFrame, by: str, seconds: int = 3600) -> DataFrame:
    """section: a topic promoted within the span is demoted unless it rises to high; promotions refresh the span.

    lines: id, ts, severity and the topic column. A topic is split where it is silent for longer than the span, as the
    next line is promoted there anyhow; a sorted stream of pieces is folded with one promotion of state.
    """
    names = lines.columns
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in lines.schema) + ", section string"

    def fold(batches):
        key, last, level = None, None, None
        for pdf in batches:
            out = []
            for topic, t, sev in zip(zip(pdf[by], pdf["piece"], strict=True), [pd.Timestamp(x).timestamp() // 1 for x in pdf["ts"]], pdf["severity"], strict=True):
                if topic != key:
                    key, last, level = topic, None, None
                main = last is None or t - last > seconds or (sev == "high" and level != "high")
                if main:
                    last, level = t, sev
                out.append("main" if main else "also")
            yield pdf[names].assign(section=out)

    return pieces(lines, by, seconds).repartition(by, "piece").sortWithinPartitions(by, "piece", "ts", "id").mapInPandas(fold, kinds)


def apply_hooks(df: DataFrame, hooks: list, context: dict) -> tuple[DataFrame, list[str]]:
    """User hooks in order; one that can't be planned is skipped and named."""
    skipped = []
    for hook in hooks:
        try:
            df = hook(df, context)
        except Exception as e:  # a user's hook may raise anything
            skipped.append(f"{getattr(hook, '__name__', 'hook')}: {e}")
    return df, skipped
