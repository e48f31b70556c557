"""From typed requests to answers: bounded evidence with other names, scores, gates, and rows of title, lead and bullets.

Requests are rows of retrieval.prepare. Posts meet them by an equi-join on terms inside each request's own span; what a
pair shares is counted in partially aggregated group-bys. The sequence ratio is taken on the shortlist alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsmill.functions import text as T
from newsmill.functions.fuzzy import ratio
from newsmill.operators.keyed import top_k_with_cap
from newsmill.operators.rail import line_key
from newsmill.operators.retrieval import CASUALTY
from newsmill.sources.views import stage

#: Points for the share of keywords, of all names, for each number, all numbers, the whole question, and full similarity.
POINTS = {"keywords": 3.5, "names": 4.0, "number": 2.5, "numbers": 2.0, "phrase": 2.0, "similarity": 1.8}
#: Points where the post answers the question's intent.
INTENT = {"identity": 1.4, "subject": 5.0, "no_subject": -6.0, "casualty": 1.2}
#: Points for a known source and for a link; hours until a post counts as old.
SOURCE, LINK, OLD = 0.15, 0.2, 48.0
#: Least top scores in general, of identity questions, and where a number is missing.
CONFIDENT, CONFIDENT_WHO, CONFIDENT_NUMBER = 2.6, 4.2, 4.5
#: Words by which a sentence says who or what something is.
IDENTITY_MARKER = r"\b(?:is|was|are|were|named|called|known as)\b"


def request_terms(prepared: DataFrame) -> DataFrame:
    """query_id, kind (keyword, alias or number), name, words and term: a row for each word of each name."""
    of = lambda kind, c: F.transform(c, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("name"), F.regexp_extract_all(x, F.lit("[a-z0-9]+"), F.lit(0)).alias("each")))
    names = prepared.select("query_id", F.explode(F.concat(of("keyword", "keywords"), of("alias", "aliases"), of("number", "numbers"))).alias("n"))
    return names.select("query_id", "n.kind", "n.name", F.size(F.array_distinct("n.each")).alias("words"), F.explode(F.array_distinct("n.each")).alias("term"))


def bounded_evidence(prepared: DataFrame, posts: DataFrame) -> DataFrame:
    """query_id, id, source, ts, kw_hits, alias_hits, num_hits and what the post is like (says_who, says_toll, linked).

    A post counts for a request if it lies in the request's span and has a keyword, a number, or all words of another
    name; alias_hits counts the keywords and other names that it has. Posts outside all spans are left out before their
    texts are read.
    """
    # no request leaves no bounds, and no post
    ends = prepared.agg(F.coalesce(F.bool_or(F.col("since").isNull()), F.lit(False)).alias("_open"), F.min("since").alias("_since"), F.coalesce(F.bool_or(F.col("until").isNull()), F.lit(False)).alias("_endless"), F.max("until").alias("_until"))
    within = (F.col("_open") | (F.col("ts") >= F.col("_since"))) & (F.col("_endless") | (F.col("ts") < F.col("_until")))
    posts = posts.join(F.broadcast(ends), within, "left_semi")
    low = F.lower(F.coalesce("raw_text", F.lit("")))
    words = T.runs(F.col("raw_text"), 2)
    like = [low.rlike(IDENTITY_MARKER).alias("says_who"), low.rlike(CASUALTY).alias("says_toll"), low.contains("http").alias("linked")]
    tokens = posts.select(F.col("message_id").alias("id"), F.col("channel_id").alias("source"), "ts", *like, words.alias("each"))
    tokens = tokens.select("id", "source", "ts", "says_who", "says_toll", "linked", F.explode_outer("each").alias("term")).where("term IS NOT NULL")  # once a post, not once a word
    spans = prepared.select("query_id", "since", "until")
    terms = request_terms(prepared).join(spans, "query_id")
    inside = (F.col("since").isNull() | (F.col("ts") >= F.col("since"))) & (F.col("until").isNull() | (F.col("ts") < F.col("until")))
    pair = ["query_id", "id", "source", "ts", "says_who", "says_toll", "linked"]
    names = tokens.join(terms, "term").where(inside).groupBy(*pair, "kind", "name", "words").agg(F.count(F.lit(1)).alias("n")).where("n = words")
    kind = F.col("kind")
    return names.groupBy(*pair).agg(F.count_if(kind == "keyword").alias("kw_hits"), F.count_if(kind != "number").alias("alias_hits"), F.count_if(kind == "number").alias("num_hits"))


def score_evidence(found: DataFrame, prepared: DataFrame, posts: DataFrame, now: Column, reliability: DataFrame | None = None) -> DataFrame:
    """Adds score (reliability: source, bonus); only pairs that have all keywords are looked up for the whole question."""
    q = prepared.select("query_id", F.lower(T.squeeze(F.col("question"))).alias("asked"), F.size("keywords").alias("n_kw"), F.size("aliases").alias("n_alias"), F.size("numbers").alias("n_num"), "intent", "identity", "casualty")
    s = found.join(q, "query_id")
    whole = (F.col("n_kw") > 0) & (F.col("kw_hits") == F.col("n_kw"))
    texts = posts.select(F.col("message_id").alias("id"), F.lower(T.squeeze(F.coalesce("raw_text", F.lit("")))).alias("low"))
    full = s.where(whole).select("query_id", "id", "asked").join(texts, "id").where((F.col("asked") != "") & F.contains("low", "asked")).select("query_id", "id", F.lit(True).alias("phrase"))
    s = s.join(full, ["query_id", "id"], "left")
    points = POINTS["keywords"] * F.col("kw_hits") / F.greatest(F.col("n_kw"), F.lit(1)) + POINTS["names"] * F.col("alias_hits") / F.greatest(F.col("n_kw") + F.col("n_alias"), F.lit(1))
    points = points + POINTS["number"] * F.col("num_hits") + F.when((F.col("n_num") > 0) & (F.col("num_hits") == F.col("n_num")), POINTS["numbers"]).otherwise(0.0) + F.when(F.col("phrase"), POINTS["phrase"]).otherwise(0.0)
    who = (F.col("intent") == "who") & (F.col("n_kw") > 0)
    points = points + F.when(F.col("identity") & F.col("says_who"), INTENT["identity"]).otherwise(0.0) + F.when(who & whole, INTENT["subject"]).when(who, INTENT["no_subject"]).otherwise(0.0) + F.when(F.col("casualty") & F.col("says_toll"), INTENT["casualty"]).otherwise(0.0)
    points = points + F.when(F.coalesce("source", F.lit("")) != "", SOURCE).otherwise(0.0) + F.when(F.col("linked"), LINK).otherwise(0.0)
    age = F.greatest(F.lit(0.0), (F.unix_seconds(now) - F.unix_seconds("ts")) / 3600.0)
    points = points + F.greatest(F.lit(0.0), 1.0 - F.least(age / OLD, F.lit(1.0)))
    if reliability is not None:
        s = s.join(reliability.select("source", "bonus"), "source", "left")
        points = points + F.coalesce("bonus", F.lit(0.0))
    return s.select(*found.columns, F.round(points, 6).alias("score"))


def shortlist(scored: DataFrame, k: int = 18, per_source: int = 3) -> DataFrame:
    """The first posts of each request, at most some of a source; where none scores, its newest posts."""
    order = [F.desc("score"), F.desc("ts"), F.asc("id")]
    best = top_k_with_cap(scored, "query_id", "source", order, per_source, k)
    none = scored.join(best.select("query_id").distinct(), "query_id", "left_anti")
    newest = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("ts"), F.asc("id")))
    return best.unionByName(none.withColumn("rank", newest).where(F.col("rank") <= k))


def rerank(listed: DataFrame, prepared: DataFrame, posts: DataFrame) -> DataFrame:
    """The shortlist in order of its scores with the similarity of question and post; Python runs on the shortlist alone."""
    q = prepared.select("query_id", F.substring(F.lower(T.squeeze(F.col("question"))), 1, 320).alias("asked"))
    texts = posts.select(F.col("message_id").alias("id"), F.substring(F.lower(T.squeeze(F.coalesce("raw_text", F.lit("")))), 1, 900).alias("said"))
    r = listed.join(q, "query_id").join(texts, "id").withColumn("score", F.round(F.col("score") + POINTS["similarity"] * ratio("asked", "said"), 6))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("ts"), F.asc("id"))
    return r.withColumn("rank", F.row_number().over(order)).select(listed.columns)


def gates(prepared: DataFrame, ranks: DataFrame) -> DataFrame:
    """query_id, ok and why: whether a request's first posts allow an answer, and the rule that decided."""
    top = ranks.groupBy("query_id").agg(F.count(F.lit(1)).alias("rows"), F.max_by("score", -F.col("rank")).alias("top"), F.max_by("num_hits", -F.col("rank")).alias("num_hits"), F.count_distinct(F.when(F.col("rank") <= 6, F.lower("source"))).alias("sources"))
    g = prepared.select("query_id", "broad", "identity", "confirm", F.size("numbers").alias("n_num")).join(top, "query_id", "left")
    least = F.when(F.col("identity"), CONFIDENT_WHO).otherwise(CONFIDENT)
    why = F.when(F.col("rows").isNull(), "no_evidence").when(F.col("confirm") & (F.col("sources") < 2), "one_source").when(F.col("broad"), F.when(F.col("rows") >= 2, "broad").otherwise("thin"))
    why = why.when((F.col("n_num") > 0) & (F.col("num_hits") == 0) & (F.col("top") < CONFIDENT_NUMBER), "number_missing").when(F.col("top") >= least, "score").when(F.col("sources") >= 2, "sources").otherwise("weak")
    return g.select("query_id", why.isin("broad", "score", "sources").alias("ok"), why.alias("why"))


def answer_rows(prepared: DataFrame, gate: DataFrame, lines: DataFrame, verdicts: DataFrame | None = None, bullets: int = 2, room: int = 260) -> DataFrame:
    """query_id, answered, verdict, title, lead and bullets of each request.

    lines (query_id, pos, sentence) are the best sentences; the first names the title, the first two make the lead, the
    others the bullets, none of which repeats the lead. verdicts (query_id, verdict) are those of strategic_trend.
    """
    listed = F.transform(F.sort_array(F.collect_list(F.struct("pos", "sentence"))), lambda x: x["sentence"])
    said = lines.groupBy("query_id").agg(listed.alias("said"))  # a few lines each
    a = prepared.select("query_id").join(gate, "query_id").join(said, "query_id", "left")
    a = a.join(verdicts.select("query_id", "verdict"), "query_id", "left") if verdicts is not None else a.withColumn("verdict", F.lit(None).cast("string"))
    lead = T.cut_at_word(F.array_join(F.slice("said", 1, 2), " "), room)
    first = F.get("said", F.lit(0))
    rest = F.filter(F.slice("said", 3, 1000), lambda x: (line_key(x) != "") & ~F.contains(line_key(lead), line_key(x)))
    ok = F.col("ok") & F.col("said").isNotNull()
    return a.select("query_id", ok.alias("answered"), F.when(ok, F.col("verdict")).alias("verdict"), F.when(ok, T.cut_at_word(first, 90)).otherwise("no match").alias("title"), F.when(ok, lead).alias("lead"), F.when(ok, F.array_join(F.slice(rest, 1, bullets), "\n")).alias("bullets"))


def widened(prepared: DataFrame, posts: DataFrame, now: Column, near_hours: int = 24, far_hours: int = 168, identity_hours: int = 336, least: int = 3, least_broad: int = 4) -> DataFrame:
    """Evidence of each request (bounded_evidence) with expanded: whether its near window was too thin.

    A request that states no span looks back near_hours; with fewer posts there than asked for, or none among the six
    newest that has a keyword or other name, it looks back far_hours (identity questions identity_hours).
    """
    stated = F.col("since").isNotNull()
    back = lambda h: F.timestamp_seconds(F.unix_seconds(now) - h * 3600)
    until = F.coalesce("until", F.timestamp_seconds(F.unix_seconds(now) + 1))
    near = prepared.withColumns({"stated": stated, "since": F.when(stated, F.col("since")).otherwise(back(F.lit(near_hours))), "until": until})
    found = stage(bounded_evidence(near, posts), "near-evidence")
    newest = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("ts"), F.asc("id")))
    seen = found.withColumn("place", newest).groupBy("query_id").agg(F.count(F.lit(1)).alias("rows"), F.count_if((F.col("place") <= 6) & (F.col("alias_hits") > 0)).alias("named"))
    need = F.when(F.col("broad"), least_broad).otherwise(least)
    rows, named = F.coalesce("rows", F.lit(0)), F.coalesce("named", F.lit(0))
    has_names = F.size("keywords") + F.size("aliases") > 0
    thin = near.where("NOT stated").join(seen, "query_id", "left").where((rows < need) | has_names & (named == 0))
    wide = thin.withColumn("since", back(F.when(F.col("identity"), identity_hours).otherwise(far_hours))).select(prepared.columns)
    more = bounded_evidence(wide, posts).withColumn("expanded", F.lit(True))
    return found.join(thin.select("query_id"), "query_id", "left_anti").withColumn("expanded", F.lit(False)).unionByName(more)
