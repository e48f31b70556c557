"""Story queries with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsmill.functions import text as T
from newsmill.operators import stories as S
from newsmill.plans.base import NORMED, POSTS, quoted, registry, squeeze
from newsmill.sources.views import posts, table

QUERIES, ORACLES = {}, {}
query = registry(QUERIES, ORACLES)
#: Our own rule data over the corpus vocabulary.
WORDING = [("ouble", "double"), ("thor", "tower"), ("ering", "erring")]
ACTORS, OFFICIAL, KEYWORDS = ["thor", "inti", "ouble", "pour", "der"], ["erin", "onand"], ["thor", "inti", "thre", "ther", "de", "la"]


def _worded(x):
    for w, by in WORDING:
        x = f"regexp_replace({x}, '(?i)\\b{w}\\b', '{by}', 'g')"
    return x


@query(f"SELECT message_id, sha1({_worded('raw_text')}) AS text_id FROM {POSTS}")
def c5_neutralise(spark, sf_dir):
    return posts(spark, sf_dir).select("message_id", F.sha1(S.neutralise(F.col("raw_text"), WORDING).cast("binary")).alias("text_id"))


@query(f"""WITH f AS (SELECT message_id AS id, channel_id, ts, list_sort(list_distinct(regexp_extract_all(lower(raw_text), '[0-9]+'))) AS numbers,
  list_filter(list_distinct(regexp_extract_all(lower(raw_text), '[a-z0-9]+')), lambda w: w IN ({quoted(ACTORS)})) AS actors,
  len(list_filter(regexp_extract_all(lower(raw_text), '[a-z0-9]+'), lambda w: w IN ({quoted(OFFICIAL)}))) > 0 AS official FROM {POSTS}),
l AS (SELECT *, lag(numbers) OVER w AS bn, lag(actors) OVER w AS ba, lag(official) OVER w AS bo, row_number() OVER w AS n FROM f WINDOW w AS (PARTITION BY channel_id ORDER BY ts, id))
SELECT id, channel_id, CASE WHEN n = 1 THEN 'first' WHEN len(numbers) > 0 AND numbers <> bn THEN 'count_change' WHEN len(actors) > 0 AND len(ba) > 0 AND NOT list_has_any(actors, ba) THEN 'actor_change'
  WHEN official AND NOT bo THEN 'official_confirmation' ELSE 'none' END AS delta_kind FROM l""")
def h3_set_delta(spark, sf_dir):
    return S.changes(S.facts(posts(spark, sf_dir), ACTORS, OFFICIAL), "channel_id")


@query(f"""SELECT message_id, len(list_filter([{quoted(KEYWORDS)}], lambda k: list_contains(regexp_extract_all(lower(raw_text), '[a-z0-9]+'), k))) >= 3 AS breaking FROM {POSTS}""")
def b12_keyword_gate(spark, sf_dir):
    words = F.regexp_extract_all(F.lower("raw_text"), F.lit("[a-z0-9]+"), F.lit(0))
    return posts(spark, sf_dir).select("message_id", (F.size(F.array_intersect(words, F.array(*[F.lit(k) for k in KEYWORDS]))) >= 3).alias("breaking"))


@query(f"""WITH s AS (SELECT message_id AS id, unnest(parts) AS sentence, generate_subscripts(parts, 1) AS place FROM (SELECT message_id, list_filter(string_split(regexp_replace({squeeze("raw_text")}, '([.!?]) ', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS parts FROM {POSTS})),
h AS (SELECT *, len(list_filter([{quoted(KEYWORDS)}], lambda k: list_contains(regexp_extract_all(lower(sentence), '[a-z0-9]+'), k))) AS hits FROM s)
SELECT id, sentence AS headline, hits FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY hits DESC, len(sentence), place) AS r FROM h) WHERE r = 1""")
def c11_pick_headline(spark, sf_dir):
    return S.headlines(posts(spark, sf_dir), KEYWORDS)


@query(f"""WITH t AS (SELECT channel_id, contains(raw_text, 'http') AS web, ' ' || regexp_replace(regexp_replace(coalesce(raw_text, ''), '[ \\t\\r\\n]+', '  ', 'g'), '[^A-Za-z ]', '|', 'g') || ' ' AS t FROM {POSTS}),
r AS (SELECT channel_id, web::INT AS web, string_split(unnest(regexp_extract_all(t, ' \\|*((?:[A-Z][a-z]{{2,}}  )*[A-Z][a-z]{{2,}})\\|* ', 1)), '  ') AS run FROM t),
whole AS (SELECT channel_id, run, count(*) AS n, sum(web) AS w FROM r GROUP BY ALL),
sub AS (SELECT channel_id, run[i:i + k - 1] AS run, 1 AS n, w FROM whole, unnest(range(1, len(run))) AS a(k), unnest(range(1, len(run) - k + 2)) AS b(i) WHERE whole.n = 1 AND len(run) > 1),
both_ AS (SELECT * FROM whole UNION ALL SELECT * FROM sub WHERE EXISTS (SELECT 1 FROM whole WHERE whole.channel_id IS NOT DISTINCT FROM sub.channel_id AND whole.run = sub.run)),
m AS (SELECT channel_id, run, sum(n) AS n, sum(w) AS w FROM both_ GROUP BY ALL),
v AS (SELECT channel_id, array_to_string(run, ' ') AS name, len(run) AS words, round(CASE WHEN len(run) > 1 THEN 1.75 ELSE 1.15 END * n + 0.35 * w, 4)::DOUBLE AS score FROM m)
SELECT channel_id, name AS subject, words, score FROM (SELECT *, row_number() OVER (PARTITION BY channel_id ORDER BY score DESC, words DESC, len(name) DESC, name DESC) AS r FROM v WHERE score >= 1.5) WHERE r = 1""")
def e13_subject_vote(spark, sf_dir):
    """A link stands for a post from the web."""
    return S.subject_votes(posts(spark, sf_dir).withColumn("is_web", F.col("raw_text").contains("http")), "channel_id")


@query(f"""WITH n AS (SELECT time_bucket(INTERVAL 30 MINUTE, ts - INTERVAL 1 MICROSECOND) + INTERVAL 30 MINUTE AS window_end, text_hash, norm FROM {NORMED})
SELECT window_end, count(*) AS posts, count(*) - count(DISTINCT text_hash) AS collapsed, count(*) FILTER (len(norm) < 12) AS too_short FROM n GROUP BY window_end""")
def e17_digest_stats(spark, sf_dir):
    p = posts(spark, sf_dir).withColumn("norm", T.normalize(F.col("raw_text")))
    w = F.window(F.col("ts") - F.expr("interval 1 microsecond"), "30 minutes")
    g = p.groupBy(w.alias("w")).agg(F.count(F.lit(1)).alias("posts"), F.count_distinct(T.fingerprint(F.col("norm"))).alias("kinds"), F.count_if(F.length("norm") < 12).alias("too_short"))
    return g.select(F.col("w.end").alias("window_end"), "posts", (F.col("posts") - F.col("kinds")).alias("collapsed"), "too_short")


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id AS id, floor(epoch(ts))::BIGINT AS t, value > 40 AS high, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
g(user_id, n, id, main, last, level) AS (SELECT user_id, n, id, true, t, high FROM e WHERE n = 1
  UNION ALL SELECT e.user_id, e.n, e.id, e.t - last > 3600 OR (e.high AND NOT level), CASE WHEN e.t - last > 3600 OR (e.high AND NOT level) THEN e.t ELSE last END, CASE WHEN e.t - last > 3600 OR (e.high AND NOT level) THEN e.high ELSE level END
  FROM g JOIN e ON e.user_id = g.user_id AND e.n = g.n + 1)
SELECT id, CASE WHEN main THEN 'main' ELSE 'also' END AS section FROM g""")
def i9_cross_digest(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("topic"), "ts", F.when(F.col("value") > 40, "high").otherwise("medium").alias("severity"))
    return S.cross_digest_topics(e, "topic").select("id", "section")


@query(f"""WITH b AS (SELECT message_id, string_split(regexp_replace(regexp_replace(regexp_replace(raw_text, '<[^>]+>', ' ', 'g'), '(?i)https?://\\S+|t\\.me/\\S+', ' ', 'g'), '@[A-Za-z0-9_]+', ' ', 'g'), chr(10)) AS raw FROM {POSTS}),
c AS (SELECT message_id, len(raw) AS n, list_filter(list_transform(raw, lambda t: {squeeze("t")}), lambda t: t <> '') AS ls FROM b),
l AS (SELECT message_id, n, ls, list_transform(ls, lambda t: lower(t)) AS low FROM c),
k AS (SELECT message_id, n, list_filter(ls, lambda t, i: list_position(low, lower(t)) = i) AS kept FROM l)
SELECT message_id, len(kept) AS kept, n - len(kept) AS removed, sha1(array_to_string(kept, chr(10))) AS text_id FROM k""")
def c3_clean_posts(spark, sf_dir):
    p = posts(spark, sf_dir).select("message_id", F.size(F.split("raw_text", "\n", -1)).alias("n"), T.clean_lines(F.col("raw_text")).alias("kept"))
    return p.select("message_id", F.size("kept").alias("kept"), (F.col("n") - F.size("kept")).alias("removed"), F.sha1(F.array_join("kept", "\n").cast("binary")).alias("text_id"))
