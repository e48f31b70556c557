"""Questions as rows: prepared terms, evidence by a token join, scores, ranks, answerability and answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsmill.functions import text as T
from newsmill.functions import vocab as V
from newsmill.operators.keyed import top_k_with_cap
from newsmill.sources.views import release, stage


#: Units of a stated span, in hours, with the words and letters for them.
UNITS = (("minutes?|mins?", 1 / 60), ("hours?|hrs?|h", 1.0), ("days?|d", 24.0), ("weeks?|w", 168.0))
_N_UNITS = r"\b(\d{1,4})\s*(?:minutes?|mins?|hours?|hrs?|h|days?|d|weeks?|w)\b"
#: Posts whose words one task meets with the questions.
POSTS_A_TASK = 4096
#: Words whose terms one task meets with the questions.
WORDS_A_TASK = 20_000
#: Patterns of what a question is like.
BROAD = r"\b(?:latest|news|headlines|updates?|what'?s new|what is new|what happened|what is happening|summary|recap)\b"
IDENTITY = r"^(?:who|whom|what) (?:is|was|are|were)\b"
CASUALTY = r"\b(?:killed|dead|deaths?|died|injured|wounded|casualt(?:y|ies)|toll)\b"
CONFIRM = r"\b(?:confirm(?:ed|s)?|verif(?:y|ied)|true that|is it true|really)\b"


def time_window(question: Column, now: Column, zone: str = "UTC") -> Column:
    """since and until (a struct of timestamps, null where nothing is stated) of the span that a question speaks of.

    The last or past N minutes, hours, days or weeks (or one of them), N h or N d alone, today and yesterday as days of
    the zone, this week from its Monday on; the first of these that fits.
    """
    q = F.lower(T.squeeze(F.coalesce(question, F.lit(""))))
    seconds = F.lit(None).cast("long")
    for words, hours in reversed(UNITS):
        n = F.try_to_number(F.nullif(F.regexp_extract(q, rf"\b(\d{{1,4}})\s*(?:{words})\b", 1), F.lit("")), F.lit("9999")).cast("long")
        one = F.when(q.rlike(rf"\b(?:last|past)\s+(?:{words.split('|')[0]})\b"), 1)
        seconds = F.coalesce(F.coalesce(n, one) * int(hours * 3600), seconds)
    local = F.from_utc_timestamp(now, zone)
    start = lambda unit: F.to_utc_timestamp(F.date_trunc(unit, local), zone)
    day = F.to_utc_timestamp(F.date_trunc("day", local) - F.expr("interval 1 day"), zone)
    span = lambda a, b: F.struct(a.alias("since"), b.alias("until"))
    none = F.lit(None).cast("timestamp")
    back = F.timestamp_seconds(F.unix_seconds(now) - seconds)
    return F.when(seconds.isNotNull(), span(back, now)).when(q.rlike(r"\btoday\b"), span(start("day"), now)).when(q.rlike(r"\byesterday\b"), span(day, start("day"))).when(q.rlike(r"\bthis week\b"), span(start("week"), now)).otherwise(span(none, none))


def alias_closure(aliases: DataFrame) -> DataFrame:
    """name, root: all names that pairs (alias, name) connect, directly or over others, have one root, their least.

    Least names spread over the pairs and along themselves, so a chain of n names takes about log n rounds.
    """
    low = lambda c: F.lower(T.squeeze(F.col(c)))
    pairs = aliases.select(low("alias").alias("a"), low("name").alias("b")).where("a <> '' AND b <> ''")
    both = stage(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "aliases")
    roots = stage(both.groupBy(F.col("a").alias("name")).agg(F.least(F.min("b"), F.col("a")).alias("root")), "alias-roots")
    while True:
        near = both.join(roots.withColumnRenamed("name", "b"), "b").groupBy(F.col("a").alias("name")).agg(F.min("root").alias("near"))
        least = roots.join(near, "name").select("name", F.least("root", "near").alias("root"))
        jump = least.join(least.select(F.col("name").alias("root"), F.col("root").alias("far")), "root").select("name", F.col("far").alias("root"))
        old, roots = roots, stage(jump, "alias-roots")
        if roots.join(old.withColumnRenamed("root", "was"), "name").where("root <> was").isEmpty():
            release(old, both)
            return roots
        release(old)


def prepare(queries: DataFrame, now=None, zone: str = "UTC", aliases: DataFrame | None = None) -> DataFrame:
    """query_id, question, keywords, numbers, intent, aliases, since, until and flags of each question (query_id, question).

    now: the present, for spans that a question states; aliases (alias, name): other names of keywords are found by
    their closure. Flags: broad, identity, casualty, confirm, direct (a question that wants one answer).
    """
    q = F.lower(T.squeeze(F.coalesce(F.col("question"), F.lit(""))))
    bare = F.regexp_replace(q, _N_UNITS, " ")
    words = F.array_distinct(F.filter(F.regexp_extract_all(bare, F.lit("[a-z0-9]{3,}"), F.lit(0)), lambda w: ~w.rlike("^[0-9]+$") & ~w.isin(V.QUERY_GENERIC_TERMS)))
    numbers = F.array_distinct(F.regexp_extract_all(bare, F.lit(r"\b\d{2,6}\b"), F.lit(0)))
    intent = F.when(q.rlike(IDENTITY), "who")
    for word in ("where", "when", "which", "why"):
        intent = intent.when(q.rlike(rf"^{word}\b"), word)
    intent = intent.when(q.rlike(r"^what (?:happened|is happening)\b"), "what").otherwise("general")
    window = time_window(F.col("question"), F.lit(now).cast("timestamp"), zone)
    identity, casualty = q.rlike(IDENTITY), q.rlike(CASUALTY)
    p = queries.select("query_id", "question", words.alias("keywords"), numbers.alias("numbers"), intent.alias("intent"), window["since"].alias("since"), window["until"].alias("until"), (q.rlike(BROAD) & (F.size(words) <= 2)).alias("broad"), identity.alias("identity"), casualty.alias("casualty"), q.rlike(CONFIRM).alias("confirm"), (identity | q.rlike(r"^(?:how many|how much|when|where|which|did|does|is|are|was|were|has|have)\b")).alias("direct"))
    if aliases is None:
        return p.withColumn("aliases", F.array().cast("array<string>"))
    names = stage(alias_closure(aliases), "alias-names")
    asked = p.select("query_id", F.explode("keywords").alias("name")).join(names, "name").select("query_id", "root").distinct()
    others = asked.join(names, "root").groupBy("query_id").agg(F.sort_array(F.collect_set("name")).alias("aliases"))  # the names of one question's subjects
    p = p.join(others, "query_id", "left")
    return p.withColumn("aliases", F.array_except(F.coalesce("aliases", F.array().cast("array<string>")), "keywords"))


def evidence(prepared: DataFrame, posts: DataFrame, since=None, until=None) -> DataFrame:
    """query_id, id, source, ts, kw_hits, num_hits: posts that share a keyword or number with a question.

    Both sides are exploded into distinct terms and meet in an equi-join; a frequent term costs its own pairs only. Nearly
    every post may answer nearly every question, so the counts of a task are bounded by the posts that it has: the words
    of some posts are dealt to a partition, and the pairs are counted there.
    """
    p = posts if since is None else posts.where(F.col("ts") >= F.lit(since))
    p = p if until is None else p.where(F.col("ts") < F.lit(until))
    rows = p.select(F.col("message_id").alias("id"), F.col("channel_id").alias("source"), "ts", T.runs(F.col("raw_text"), 2).alias("words"))
    tokens = rows.repartition(p.count() // POSTS_A_TASK + 1, "id").select("id", "source", "ts", F.explode_outer("words").alias("term")).where("term IS NOT NULL")  # not explode: Spark would filter by the words first, which finds them twice
    terms = prepared.select("query_id", F.explode(F.concat(F.transform("keywords", lambda k: F.struct(k.alias("term"), F.lit(False).alias("is_number"))), F.transform("numbers", lambda k: F.struct(k.alias("term"), F.lit(True).alias("is_number"))))).alias("t")).select("query_id", "t.term", "t.is_number")
    j = tokens.join(terms, "term")
    return j.groupBy("query_id", "id", "source", "ts").agg(F.count_if(~F.col("is_number")).alias("kw_hits"), F.count_if("is_number").alias("num_hits"))


def score(found: DataFrame, prepared: DataFrame, now) -> DataFrame:
    """Adds score: keyword share, numbers (all of them count more) and linear recency over 48 hours."""
    s = found.join(prepared.select("query_id", F.size("keywords").alias("n_kw"), F.size("numbers").alias("n_num")), "query_id")
    age = (F.unix_seconds(F.lit(now).cast("timestamp")) - F.unix_seconds("ts")) / 3600.0
    recency = F.greatest(F.lit(0.0), 1.0 - F.least(F.greatest(age, F.lit(0.0)) / 48.0, F.lit(1.0)))
    share = F.col("kw_hits") / F.greatest(F.col("n_kw"), F.lit(1))
    numbers = 2.5 * F.col("num_hits") + F.when((F.col("n_num") > 0) & (F.col("num_hits") == F.col("n_num")), 2.0).otherwise(0.0)
    return s.withColumn("score", F.round(share * 3.5 + share * 4.0 + numbers + 0.15 + recency, 6))


def ranked(scored: DataFrame, k: int = 18) -> DataFrame:
    """The first posts of each question, at most three of a source."""
    return top_k_with_cap(scored, "query_id", "source", [F.desc("score"), F.desc("ts"), F.asc("id")], 3, k)


def answerable(prepared: DataFrame, ranks: DataFrame) -> DataFrame:
    """query_id, ok: a top score of 2.6, or two sources among the first six; a missing number needs 4.5."""
    top = ranks.where("rank <= 6").groupBy("query_id").agg(F.max("score").alias("top"), F.count_distinct("source").alias("sources"), F.max_by("num_hits", "score").alias("num_hits"))
    q = prepared.join(top, "query_id", "left")
    numbers_ok = (F.size("numbers") == 0) | (F.col("num_hits") > 0) | (F.col("top") >= 4.5)
    return q.select("query_id", F.coalesce(numbers_ok & ((F.col("top") >= 2.6) | (F.col("sources") >= 2)), F.lit(False)).alias("ok"))


def sentences(prepared: DataFrame, ranks: DataFrame, posts: DataFrame, k: int = 3) -> DataFrame:
    """query_id, pos, sentence: the best sentences of the ranked posts by shared terms, each once."""
    s = ranks.join(posts.select(F.col("message_id").alias("id"), "raw_text"), "id").join(prepared.select("query_id", "keywords", "numbers", "intent"), "query_id")
    s = s.select("query_id", "rank", "score", "intent", "keywords", "numbers", F.posexplode(T.sentences(F.col("raw_text"))).alias("at", "sentence"))
    words = F.regexp_extract_all(F.lower("sentence"), F.lit("[a-z0-9]{2,}"), F.lit(0))
    hits = F.size(F.array_intersect(words, F.concat("keywords", "numbers")))
    bonus = F.when((F.col("intent") == "when") & F.col("sentence").rlike(r"\d{1,2}:\d{2}|\d{4}"), 2.0).when((F.col("intent") == "why") & F.col("sentence").rlike(r"(?i)because|due to|after"), 2.5).otherwise(0.0)
    s = s.withColumn("value", F.col("score") + F.least(F.lit(4.0), 0.9 * hits) + bonus).withColumn("line_key", F.regexp_replace(F.lower("sentence"), "[^a-z0-9]+", " "))
    once = Window.partitionBy("query_id", "line_key").orderBy(F.desc("value"), "rank", "at")
    s = s.withColumn("_r", F.row_number().over(once)).where("_r = 1 AND length(line_key) > 0")
    best = Window.partitionBy("query_id").orderBy(F.desc("value"), "rank", "at")
    return s.withColumn("pos", F.row_number().over(best)).where(F.col("pos") <= k).select("query_id", "pos", T.cut_at_word(F.col("sentence"), 260).alias("sentence"))


def answers(prepared: DataFrame, ok: DataFrame, lines: DataFrame) -> DataFrame:
    """One row a question: its sentences in order, or a no-match row."""
    text = lines.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "sentence"))), lambda x: x["sentence"]), " ").alias("text"))
    a = prepared.select("query_id").join(ok, "query_id").join(text, "query_id", "left")
    return a.select("query_id", F.when(F.col("ok") & F.col("text").isNotNull(), F.col("text")).otherwise(F.lit("no match")).alias("answer"), (F.col("ok") & F.col("text").isNotNull()).alias("answered"))


def widen(prepared: DataFrame, narrow: DataFrame, wide: Callable[[DataFrame], DataFrame], least: int = 3) -> DataFrame:
    """Evidence of the narrow window; questions with fewer rows there take the wide window's, which is found for them alone."""
    n = narrow.groupBy("query_id").count()
    thin = stage(prepared.join(n, "query_id", "left").where(F.coalesce("count", F.lit(0)) < least).drop("count"), "thin-questions")
    near = narrow.withColumn("expanded", F.lit(False))
    if thin.isEmpty():
        return near
    return near.join(thin.select("query_id"), "query_id", "left_anti").unionByName(wide(thin).withColumn("expanded", F.lit(True)))


def words_with_terms(words: DataFrame, terms: DataFrame) -> DataFrame:
    """word, term: which words hold which terms as a part, by an index of character trigrams.

    words (word) and terms (term) are distinct runs of a-z and 0-9. Each word is listed under its stretches of three and
    of two characters; a term is looked up under its rarest stretch alone (its rarest pair if it has two characters),
    and what that list holds is verified. The index is one of the vocabulary, not of the posts.
    """
    stretches = lambda c, n: F.array_distinct(F.regexp_extract_all(c, F.lit(f"(?=(.{{{n}}}))"), F.lit(1)))
    grams = lambda c: F.when(F.length(c) >= 3, stretches(c, 3)).otherwise(stretches(c, 2))
    index = words.select("word", F.explode(F.concat(stretches(F.col("word"), 3), stretches(F.col("word"), 2))).alias("gram"))
    asked = terms.where(F.length("term") >= 2).select("term", F.explode(grams(F.col("term"))).alias("gram"))
    used = stage(index.join(asked.select("gram").distinct(), "gram", "left_semi"), "word-grams")
    often = used.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    rarest = asked.join(often, "gram").groupBy("term").agg(F.count(F.lit(1)).alias("found"), F.min(F.struct("df", "gram")).alias("rare"))
    # a term one of whose stretches no word has is in no word
    whole = rarest.join(terms, "term").where(F.col("found") == F.size(grams(F.col("term")))).select("term", F.col("rare.gram").alias("gram"))
    single = terms.where(F.length("term") == 1).select("term")
    near = whole.join(used, "gram").where(F.contains("word", "term")).select("word", "term")
    letters = words.select("word", F.explode(F.array_distinct(F.split("word", ""))).alias("term")).join(single, "term", "left_semi").select("word", "term")
    return near.unionByName(letters)


def query_bits(queries: DataFrame, width: int = 64) -> DataFrame:
    """query_id, part, bit: queries (query_id) dealt into parts of at most width, each with a bit of its own in its part."""
    many = max(1, -(-queries.count() * 3 // (width * 2)))
    dealt = queries.withColumn("_p", F.pmod(F.xxhash64("query_id"), F.lit(many)))
    place = F.row_number().over(Window.partitionBy("_p").orderBy("query_id")) - 1
    return dealt.withColumn("_n", place).select("query_id", (F.floor(F.col("_n") / width) * many + F.col("_p")).cast("long").alias("part"), (F.col("_n") % width).cast("int").alias("bit"))


def keyword_filter(prepared: DataFrame, posts: DataFrame, since=None, until=None) -> DataFrame:
    """query_id, id: posts whose text holds any keyword or number of a question as a part of it.

    Terms are runs of letters and digits, so a term that a text holds lies inside one of the text's own runs. The
    distinct runs of all posts are matched with the distinct terms (`words_with_terms`). Posts then meet, by an equi-join
    on the runs, the questions of each run as bits of a few numbers, so a run that many questions ask for is a few rows.
    """
    p = posts if since is None else posts.where(F.col("ts") >= F.lit(since))
    p = p if until is None else p.where(F.col("ts") < F.lit(until))
    held = stage(p.select(F.col("message_id").alias("id"), F.explode_outer(T.runs(F.col("raw_text"))).alias("word")).where("word IS NOT NULL"), "post-words")
    words = stage(held.select("word").distinct(), "words")
    terms = stage(prepared.select("query_id", F.explode(F.array_distinct(F.concat("keywords", "numbers"))).alias("term")), "query-terms")
    bits = stage(query_bits(terms.select("query_id").distinct()), "query-bits")
    either = F.bit_or("bits").alias("bits")
    asked = terms.join(bits, "query_id").withColumn("bits", F.expr("shiftleft(1L, bit)")).groupBy("term", "part").agg(either)
    found = words_with_terms(words, terms.select("term").distinct())
    found = found.repartition(words.count() // WORDS_A_TASK + 1, "word")
    each = found.join(asked, "term").groupBy("word", "part").agg(either)
    asked = stage(each.groupBy("word").agg(F.collect_list(F.struct("part", "bits")).alias("parts")), "query-words")
    hit = held.join(asked.hint("shuffle_hash"), "word").select("id", F.inline("parts")).groupBy("id", "part").agg(either)
    return hit.join(bits, "part").where("shiftright(bits, bit) & 1L = 1L").select("query_id", "id")


def reply_targets(replies: DataFrame, delivered: DataFrame, topic: DataFrame | None = None) -> DataFrame:
    """channel_id, id, target: the delivered parent of a reply, else its topic's thread, else null."""
    refs = delivered.select("channel_id", F.col("message_id").alias("reply_to"), F.col("destination").alias("_parent"))
    r = replies.join(refs, ["channel_id", "reply_to"], "left")
    if topic is None:
        return r.select("channel_id", "id", F.col("_parent").alias("target"))
    return r.join(topic.select("id", F.col("destination").alias("_thread")), "id", "left").select("channel_id", "id", F.coalesce("_parent", "_thread").alias("target"))


def trend_signal(sentence: Column, markers: dict = V.TREND) -> Column:
    """escalating, de-escalating, mixed, steady or none, by the markers that a sentence holds; denied widening eases."""
    low = F.lower(T.squeeze(F.coalesce(sentence, F.lit(""))))
    has = lambda kind: F.exists(F.lit(list(markers[kind])), lambda m: F.contains(low, m))
    denied = low.rlike(r"\b(?:not|no|without|neither side(?:\s+(?:was|is))?)\b.{0,24}\b(?:widen(?:ing)?|broader|expand(?:ing|ed)?)\b")
    up, down = has("escalating"), has("de-escalating")
    return F.when(denied, "de-escalating").when(has("mixed") | up & down, "mixed").when(up, "escalating").when(down, "de-escalating").when(has("steady"), "steady").otherwise("none")


def strategic_trend(sentences: DataFrame, markers: dict = V.TREND) -> DataFrame:
    """query_id, verdict, escalating, easing (sums of scores), sources, span_hours of sentences (query_id, source, ts, sentence, score).

    A source counts once for each signal, by its best sentence. A verdict needs two sources, and a clear lead where both
    signs occur; questions without evidence have no row.
    """
    e = sentences.where("score > 0").withColumn("signal", trend_signal(F.col("sentence"), markers)).where("signal <> 'none'")
    span = F.round((F.max(F.unix_seconds("ts")) - F.min(F.unix_seconds("ts"))) / 3600.0, 2)
    whole = e.groupBy("query_id").agg(F.count_distinct(F.lower("source")).alias("sources"), span.alias("span_hours"))
    best = e.groupBy("query_id", F.lower("source").alias("source"), "signal").agg(F.max("score").alias("score"))
    of = lambda k: (F.sum(F.when(F.col("signal") == k, F.col("score")).otherwise(0.0)), F.count_if(F.col("signal") == k))
    (up, n_up), (down, n_down) = of("escalating"), of("de-escalating")
    r = best.groupBy("query_id").agg(F.round(up, 4).alias("escalating"), F.round(down, 4).alias("easing"), n_up.alias("n_up"), n_down.alias("n_down")).join(whole, "query_id")
    a, b = F.col("escalating"), F.col("easing")
    both, near = (a > 0) & (b > 0), (F.greatest(a, b) < F.least(a, b) + 3.0) | (F.least(a, b) >= 3.0)
    rise, ease = (F.col("n_up") >= 2), (F.col("n_down") >= 2)
    verdict = F.when(F.col("sources") < 2, "insufficient").when(both & near, "mixed").when(both & (a > b) & rise, "escalating").when(both & (b > a) & ease, "de-escalating").when(both, "mixed")
    verdict = verdict.when((a >= b + 2.0) & rise, "escalating").when((b >= a + 2.0) & ease, "de-escalating").otherwise("mixed")
    return r.select("query_id", verdict.alias("verdict"), "escalating", "easing", "sources", "span_hours")
