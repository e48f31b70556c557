"""Retrieval and digest queries; the benchmark's items serve as questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsmill.functions import text as T
from newsmill.functions import vocab as V
from newsmill.operators import answers as A
from newsmill.operators import digests as G
from newsmill.operators import retrieval as Q
from newsmill.plans.base import POSTS, quoted, registry, squeeze
from newsmill.sources.views import posts, stage, table
from newsmill.streaming.windows import tumbling

QUERIES, ORACLES = {}, {}
query = registry(QUERIES, ORACLES)
NOW = "2024-01-02 00:00:00"


def _prepared(spark, sf_dir):
    return Q.prepare(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question")))


_Q = f"""q AS (SELECT item_id AS query_id, lower({squeeze("text")}) AS t FROM benchmark),
k AS (SELECT query_id, list_distinct(list_filter(regexp_extract_all(t, '[a-z0-9]{{3,}}'), lambda w: NOT regexp_full_match(w, '[0-9]+') AND w NOT IN ({quoted(V.QUERY_GENERIC_TERMS)}))) AS kw,
  list_distinct(regexp_extract_all(regexp_replace(t, '\\b(?:24|48|72)\\s*(?:hours?|hrs?|h)\\b', ' ', 'g'), '\\b\\d{{2,6}}\\b')) AS nums FROM q)"""
_E = f"""{_Q}, terms AS (SELECT query_id, unnest(kw) AS term, false AS is_number FROM k UNION ALL SELECT query_id, unnest(nums), true FROM k),
tok AS (SELECT message_id AS id, channel_id AS source, ts, unnest(list_distinct(regexp_extract_all(lower(raw_text), '[a-z0-9]{{2,}}'))) AS term FROM {POSTS}),
e AS (SELECT query_id, id, source, ts, count(*) FILTER (NOT is_number) AS kw_hits, count(*) FILTER (is_number) AS num_hits FROM tok JOIN terms USING (term) GROUP BY ALL)"""
_S = f"""{_E}, s AS (SELECT e.*, round(7.5 * kw_hits / greatest(len(kw), 1) + 2.5 * num_hits + CASE WHEN len(nums) > 0 AND num_hits = len(nums) THEN 2.0 ELSE 0.0 END + 0.15
  + greatest(0.0, 1.0 - least(greatest((epoch(TIMESTAMP '{NOW}') - epoch(ts)) / 3600.0, 0.0) / 48.0, 1.0)), 6) AS score FROM e JOIN k USING (query_id)),
c AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, ts DESC, id) AS r FROM s WHERE score > 0),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ts DESC, id) AS rank FROM c WHERE r <= 3)"""


@query(f"WITH {_Q} SELECT query_id, len(kw) AS n_keywords, array_to_string(list_sort(kw), ' ') AS keywords, len(nums) AS n_numbers FROM k")
def k1_prepare_queries(spark, sf_dir):
    return _prepared(spark, sf_dir).select("query_id", F.size("keywords").alias("n_keywords"), F.array_join(F.sort_array("keywords"), " ").alias("keywords"), F.size("numbers").alias("n_numbers"))


#: Ways to ask about a word of the benchmark; w stands for the word, n for a number.
ASKED = ("what happened with w in the last n hours", "who is w", "any latest news on w today", "how many killed at w yesterday", "is it true that w fell nd", "w 77 past week", "when did w open")
#: Other names of words of the prose; the first column may be the second of another pair.
ALIASES = [("thor", "inti"), ("inti", "ouble"), ("edst", "ering"), ("thand", "that")]


def questions(spark, sf_dir):
    """query_id and question: one short question on each item's first long word, in turn."""
    b = table(spark, sf_dir, "benchmark")
    word = F.regexp_extract(F.lower("text"), "[a-z]{4,}", 0)
    way = F.get(F.array(*map(F.lit, ASKED)), F.pmod("item_id", F.lit(len(ASKED))).cast("int"))
    n = (F.pmod("item_id", F.lit(23)) + 1).cast("string")
    return b.select(F.col("item_id").alias("query_id"), F.regexp_replace(F.regexp_replace(way, r"\bw\b", word), r"\bn(?=d?\b)", n).alias("question"))


_WAYS = "CASE item_id % {} {} END".format(len(ASKED), " ".join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(ASKED)))
_ASKED = f"""asked AS (SELECT item_id AS query_id, regexp_replace(regexp_replace(regexp_replace({_WAYS}, '\\bw\\b', regexp_extract(lower(text), '[a-z]{{4,}}'), 'g'), '\\bn\\b', (item_id % 23 + 1)::VARCHAR, 'g'), '\\bnd\\b', (item_id % 23 + 1)::VARCHAR || 'd', 'g') AS question FROM benchmark)"""
_PAIRS = ", ".join(f"('{a}', '{b}')" for a, b in ALIASES)
_BARE = "regexp_replace(question, '\\b\\d{1,4}\\s*(?:minutes?|mins?|hours?|hrs?|h|days?|d|weeks?|w)\\b', ' ', 'g')"


@query(f"""WITH RECURSIVE {_ASKED}, pair(a, b) AS (SELECT * FROM (VALUES {_PAIRS}) UNION ALL SELECT col1, col0 FROM (VALUES {_PAIRS})),
same(a, b) AS (SELECT a, a FROM pair UNION SELECT same.a, pair.b FROM same JOIN pair ON pair.a = same.b),
k AS (SELECT *, list_distinct(list_filter(regexp_extract_all({_BARE}, '[a-z0-9]{{3,}}'), lambda w: NOT regexp_full_match(w, '[0-9]+') AND w NOT IN ({quoted(V.QUERY_GENERIC_TERMS)}))) AS kw,
  list_distinct(regexp_extract_all({_BARE}, '\\b\\d{{2,6}}\\b')) AS nums, TIMESTAMP '{NOW}' AS now FROM asked),
o AS (SELECT query_id, list(DISTINCT b) AS names FROM (SELECT query_id, unnest(kw) AS a FROM k) JOIN same USING (a) GROUP BY query_id)
SELECT query_id, array_to_string(list_sort(kw), ' ') AS keywords, array_to_string(list_sort(list_filter(coalesce(names, []), lambda x: NOT list_contains(kw, x))), ' ') AS aliases, array_to_string(list_sort(nums), ' ') AS numbers,
  CASE query_id % 7 WHEN 0 THEN now - to_hours(query_id % 23 + 1) WHEN 2 THEN date_trunc('day', now) WHEN 3 THEN date_trunc('day', now) - INTERVAL 1 DAY WHEN 4 THEN now - to_days((query_id % 23 + 1)::INT) WHEN 5 THEN now - INTERVAL 7 DAY END::TIMESTAMP AS since,
  CASE query_id % 7 WHEN 0 THEN now WHEN 2 THEN now WHEN 3 THEN date_trunc('day', now) WHEN 4 THEN now WHEN 5 THEN now END::TIMESTAMP AS until,
  query_id % 7 IN (0, 2) AND len(kw) <= 2 AS broad, query_id % 7 = 1 AS identity, query_id % 7 = 3 AS casualty, query_id % 7 = 4 AS confirm, query_id % 7 IN (1, 3, 4, 6) AS direct
FROM k LEFT JOIN o USING (query_id)""")
def k1_typed_requests(spark, sf_dir):
    p = Q.prepare(questions(spark, sf_dir), NOW, aliases=spark.createDataFrame(ALIASES, "alias string, name string"))
    line = lambda c: F.array_join(F.sort_array(c), " ").alias(c)
    return p.select("query_id", line("keywords"), line("aliases"), line("numbers"), "since", "until", "broad", "identity", "casualty", "confirm", "direct")


@query(f"WITH {_E} SELECT query_id, count(*) AS posts, sum(kw_hits)::BIGINT AS kw_hits, count(DISTINCT source) AS sources FROM e GROUP BY query_id")
def d16_evidence(spark, sf_dir):
    e = Q.evidence(_prepared(spark, sf_dir), posts(spark, sf_dir))
    return e.groupBy("query_id").agg(F.count(F.lit(1)).alias("posts"), F.sum("kw_hits").alias("kw_hits"), F.count_distinct("source").alias("sources"))


@query(f"WITH {_S} SELECT query_id, rank, round(score, 4) AS score FROM top WHERE rank <= 18")
def k2_ranked_evidence(spark, sf_dir):
    p = _prepared(spark, sf_dir)
    return Q.ranked(Q.score(Q.evidence(p, posts(spark, sf_dir)), p, NOW)).select("query_id", "rank", F.round("score", 4).alias("score"))


def _ranks(spark, sf_dir):
    p = _prepared(spark, sf_dir)
    return p, Q.ranked(Q.score(Q.evidence(p, posts(spark, sf_dir)), p, NOW))


@query(f"""WITH {_S}, a AS (SELECT query_id, max(score) AS top, count(DISTINCT source) AS sources, max_by(num_hits, score) AS nh FROM top WHERE rank <= 6 GROUP BY query_id)
SELECT query_id, coalesce((len(nums) = 0 OR nh > 0 OR top >= 4.5) AND (top >= 2.6 OR sources >= 2), false) AS ok FROM k LEFT JOIN a USING (query_id)""")
def e15_answerability(spark, sf_dir):
    return Q.answerable(*_ranks(spark, sf_dir))


@query()
def g3_answer_sentences(spark, sf_dir):
    p, r = _ranks(spark, sf_dir)
    return Q.sentences(p, r, posts(spark, sf_dir))


@query()
def k3_answers(spark, sf_dir):
    p, r = _ranks(spark, sf_dir)
    return Q.answers(p, Q.answerable(p, r), Q.sentences(p, r, posts(spark, sf_dir)))


@query()
def i12_widen_window(spark, sf_dir):
    p, all_posts = _prepared(spark, sf_dir), posts(spark, sf_dir)
    near, far = (F.lit(x).cast("timestamp") for x in ("2024-01-01 12:00:00", "2024-01-01 00:00:00"))
    w = Q.widen(p, Q.evidence(p, all_posts, near), lambda thin: Q.evidence(thin, all_posts, far))
    return w.groupBy("query_id", "expanded").agg(F.count(F.lit(1)).alias("posts"))


_GATE = f"""WITH l AS (SELECT message_id, channel_id, unnest(string_split(coalesce(raw_text, ''), chr(10))) AS t FROM {POSTS}),
w AS (SELECT *, len(regexp_extract_all(t, '\\p{{L}}')) - len(regexp_extract_all(t, '[A-Za-z]')) AS f, regexp_extract_all(t, '[A-Za-z\\x{{C0}}-\\x{{FF}}][A-Za-z\\x{{C0}}-\\x{{FF}}''/-]*') AS ws, regexp_extract_all(t, '[A-Za-z][A-Za-z''/-]*') AS ps FROM l),
h AS (SELECT *, len(ws) AS n, len(list_filter(ws, lambda x: lower(x) IN ({quoted(V.ENGLISH_WORDS)}))) AS hits, len(list_filter(ps, lambda x: lower(x) IN ({quoted(V.ENGLISH_WORDS)}))) AS plain_hits, len(list_filter(ps, lambda x: lower(x) IN ({quoted([*V.FOREIGN_CUES, 'der', 'los'])}))) AS cues FROM w),
g AS (SELECT *, regexp_matches(t, '[\\x{{600}}-\\x{{6FF}}\\x{{750}}-\\x{{77F}}\\x{{8A0}}-\\x{{8FF}}\\x{{400}}-\\x{{4FF}}]') OR f >= 4 OR (n >= 6 AND ((f >= 2 AND hits <= 1) OR (f >= 1 AND hits = 0 AND n >= 8))) OR (len(ps) >= 5 AND plain_hits = 0 AND cues > 0) AS foreign_ FROM h)"""


@query(f"""{_GATE} SELECT message_id, count(*) FILTER (trim(t) <> '') AS lines, count(*) FILTER (foreign_) AS foreign_lines FROM g GROUP BY message_id""")
def b7_foreign_lines(spark, sf_dir):
    """Line by line, with two words of the invented corpus as further cues."""
    line = posts(spark, sf_dir).select("message_id", F.explode(F.split(F.coalesce("raw_text", F.lit("")), "\n", -1)).alias("t"))
    foreign = G.needs_translation(F.col("t"), cues=[*V.FOREIGN_CUES, "der", "los"])
    return line.groupBy("message_id").agg(F.count_if(F.trim("t") != "").alias("lines"), F.count_if(foreign).alias("foreign_lines"))


@query(f"""{_GATE.replace("unnest(string_split(coalesce(raw_text, ''), chr(10)))", "coalesce(raw_text, '')").replace(", 'der', 'los'", "")} SELECT message_id, foreign_ AS needs_translation FROM g""")
def b7_language_gate(spark, sf_dir):
    return posts(spark, sf_dir).select("message_id", G.needs_translation(F.col("raw_text")).alias("needs_translation"))


@query(f"""WITH RECURSIVE r AS (SELECT channel_id, message_id, least(4000, greatest(48, len(raw_text) // 4 + 32)) AS c, row_number() OVER (PARTITION BY channel_id ORDER BY ts, message_id) AS n FROM {POSTS}),
g(channel_id, n, message_id, part, used) AS (SELECT channel_id, n, message_id, 1::BIGINT, c FROM r WHERE n = 1
  UNION ALL SELECT r.channel_id, r.n, r.message_id, CASE WHEN used + c > 4000 THEN part + 1 ELSE part END, CASE WHEN used + c > 4000 THEN c ELSE used + c END FROM g JOIN r ON r.channel_id = g.channel_id AND r.n = g.n + 1)
SELECT channel_id, message_id, part FROM g""")
def f7_pack_by_budget(spark, sf_dir):
    rows = posts(spark, sf_dir).select("channel_id", "message_id", "ts", F.greatest(F.lit(48), F.floor(F.length("raw_text") / 4) + 32).cast("long").alias("cost"))
    return G.pack_by_budget(rows, "channel_id", ["ts", "message_id"], "cost", 4000).select("channel_id", "message_id", "part")


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations) WHERE back <= 4")
def f9_recent_history(spark, sf_dir):
    return G.recent_history(table(spark, sf_dir, "conversations"), "conv_id", "turn", 4).select("conv_id", "turn", "role")


@query("""WITH l AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back, max(ts) OVER (PARTITION BY user_id) AS newest FROM events)
SELECT user_id, event_id, back FROM l WHERE back <= 4 AND newest >= (SELECT max(ts) FROM events) - INTERVAL 24 HOUR""")
def f9_live_history(spark, sf_dir):
    """Events as requests; the newest one tells the time."""
    e = table(spark, sf_dir, "events")
    now = e.agg(F.max("ts")).first()[0]
    return G.live_history(e, "user_id", ["event_id"], 4, now).select("user_id", "event_id", "back")


_DUE = f"""e AS (SELECT channel_id, time_bucket(INTERVAL 30 MINUTE, ts - INTERVAL 1 MICROSECOND) + INTERVAL 30 MINUTE AS window_end FROM {POSTS}),
n AS (SELECT time_bucket(INTERVAL 30 MINUTE, max(ts)) AS last FROM {POSTS})"""


@query(f"""WITH {_DUE}, w AS (SELECT channel_id, window_end, last, count(*) AS posts, (epoch(last) - epoch(window_end))::BIGINT // 1800 AS behind FROM e, n WHERE window_end <= last GROUP BY ALL)
SELECT channel_id, window_end, posts, behind, behind >= 4 AS stranded, row_number() OVER (PARTITION BY channel_id ORDER BY window_end) AS place,
  CASE WHEN max(behind) OVER (PARTITION BY channel_id) >= 4 THEN 'catchup' ELSE 'single' END AS mode FROM w""")
def i3_catchup(spark, sf_dir):
    """All due windows of each channel, the stranded ones first."""
    p = posts(spark, sf_dir)
    return G.due_windows(tumbling(p, ["channel_id"]), G.last_closed(p))


@query(f"""WITH e AS (SELECT channel_id, time_bucket(INTERVAL 30 MINUTE, ts - INTERVAL 1 MICROSECOND) + INTERVAL 30 MINUTE AS window_end FROM {POSTS}),
n AS (SELECT time_bucket(INTERVAL 30 MINUTE, max(ts)) AS last FROM {POSTS}),
g AS (SELECT channel_id, last, min(window_end) AS oldest, count(*) AS posts FROM e, n WHERE window_end <= last GROUP BY ALL)
SELECT channel_id, oldest, posts, (epoch(last) - epoch(oldest))::BIGINT // 1800 AS intervals_behind, CASE WHEN epoch(last) - epoch(oldest) >= 7200 THEN 'catchup' ELSE 'single' END AS mode FROM g""")
def i3_whole_backlog(spark, sf_dir):
    p = posts(spark, sf_dir)
    return G.backlog(tumbling(p, ["channel_id"]), G.last_closed(p))


@query("SELECT event_type, count(*) AS kept FROM events WHERE floor(epoch(ts)) >= epoch(TIMESTAMP '2024-01-31') - 168 * 3600 GROUP BY event_type")
def i10_ttl_retention(spark, sf_dir):
    return G.expire(table(spark, sf_dir, "events"), "2024-01-31", 168).groupBy("event_type").agg(F.count(F.lit(1)).alias("kept"))


@query(f"""WITH r AS (SELECT channel_id, date_trunc('day', ts)::TIMESTAMP AS day, message_id, ts, row_number() OVER (PARTITION BY channel_id, date_trunc('day', ts) ORDER BY ts, message_id) AS rn,
  count(*) OVER (PARTITION BY channel_id, date_trunc('day', ts)) AS n FROM {POSTS}),
k AS (SELECT *, row_number() OVER (PARTITION BY channel_id, day ORDER BY rn) AS k FROM r WHERE n <= 30 OR rn % greatest(1, n // 30) = 0 OR rn = 1)
SELECT channel_id, day, any_value(n) AS posts, count(*) AS sampled, min(message_id) AS first_id, max(message_id) AS last_id FROM k WHERE k <= 30 GROUP BY channel_id, day""")
def i2_daily_digest(spark, sf_dir):
    """Every day of every channel, sampled in even steps to 30 posts, as these channels have few posts a day."""
    return G.daily_sample(posts(spark, sf_dir), 30)


@query(f"SELECT channel_id, date_trunc('day', ts)::TIMESTAMP AS day, count(*) AS posts, min(ts) AS first_ts, max(ts) AS last_ts FROM {POSTS} GROUP BY ALL")
def i2_all_daily_digests(spark, sf_dir):
    return G.daily(posts(spark, sf_dir))


@query(f"""WITH {_Q}, p AS (SELECT message_id AS id, lower(raw_text) AS low FROM {POSTS}), t AS (SELECT query_id, list_concat(kw, nums) AS terms FROM k)
SELECT query_id, count(*) AS posts, min(id) AS first_id FROM p, t WHERE len(list_filter(terms, lambda x: contains(low, x))) > 0 GROUP BY query_id""")
def b5_keyword_filter(spark, sf_dir):
    return Q.keyword_filter(_prepared(spark, sf_dir), posts(spark, sf_dir)).groupBy("query_id").agg(F.count(F.lit(1)).alias("posts"), F.min("id").alias("first_id"))


@query("""WITH d AS (SELECT conv_id, turn, turn * 10 AS destination FROM conversations WHERE role = 'user')
SELECT c.conv_id AS channel_id, c.turn AS id, d.destination AS target FROM conversations c LEFT JOIN d ON d.conv_id = c.conv_id AND d.turn = c.turn - 1""")
def d8_reply_targets(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("channel_id", F.col("conv_id"))
    delivered = c.where("role = 'user'").select("channel_id", F.col("turn").alias("message_id"), (F.col("turn") * 10).alias("destination"))
    return Q.reply_targets(c.select("channel_id", F.col("turn").alias("id"), (F.col("turn") - 1).alias("reply_to")), delivered)


#: Words of the invented prose that stand for signs of a trend.
TREND = {"escalating": ("ering", "thorst"), "de-escalating": ("wither", "inti"), "mixed": ("ouble",), "steady": ("hand",)}
_HAS = lambda k: "(" + " OR ".join(f"contains(low, '{w}')" for w in TREND[k]) + ")"
_PARTS = f"list_filter(string_split(regexp_replace({squeeze('raw_text')}, '([.!?]) ', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '')"


@query(f"""WITH {_S}, n AS (SELECT query_id, top.source, top.ts, score, unnest({_PARTS}) AS sentence FROM top JOIN {POSTS} AS p ON p.message_id = top.id WHERE rank <= 18),
l AS (SELECT *, lower(sentence) AS low FROM n),
g AS (SELECT *, CASE WHEN {_HAS('mixed')} OR ({_HAS('escalating')} AND {_HAS('de-escalating')}) THEN 'mixed' WHEN {_HAS('escalating')} THEN 'escalating' WHEN {_HAS('de-escalating')} THEN 'de-escalating' WHEN {_HAS('steady')} THEN 'steady' ELSE 'none' END AS signal FROM l),
ev AS (SELECT * FROM g WHERE signal <> 'none' AND score > 0),
w AS (SELECT query_id, count(DISTINCT lower(source)) AS sources, round((max(epoch(ts)) - min(epoch(ts))) / 3600.0, 2)::DOUBLE AS span_hours FROM ev GROUP BY query_id),
b AS (SELECT query_id, lower(source) AS source, signal, max(score) AS score FROM ev GROUP BY ALL),
r AS (SELECT query_id, round(coalesce(sum(score) FILTER (signal = 'escalating'), 0.0), 4)::DOUBLE AS a, round(coalesce(sum(score) FILTER (signal = 'de-escalating'), 0.0), 4)::DOUBLE AS e, count(*) FILTER (signal = 'escalating') AS na, count(*) FILTER (signal = 'de-escalating') AS ne FROM b GROUP BY query_id)
SELECT query_id, CASE WHEN sources < 2 THEN 'insufficient' WHEN a > 0 AND e > 0 AND (greatest(a, e) < least(a, e) + 3.0 OR least(a, e) >= 3.0) THEN 'mixed' WHEN a > 0 AND e > 0 AND a > e AND na >= 2 THEN 'escalating' WHEN a > 0 AND e > 0 AND e > a AND ne >= 2 THEN 'de-escalating'
  WHEN a > 0 AND e > 0 THEN 'mixed' WHEN a >= e + 2.0 AND na >= 2 THEN 'escalating' WHEN e >= a + 2.0 AND ne >= 2 THEN 'de-escalating' ELSE 'mixed' END AS verdict, a AS escalating, e AS easing, sources, span_hours FROM r JOIN w USING (query_id)""")
def e10_strategic_trend(spark, sf_dir):
    _, r = _ranks(spark, sf_dir)
    s = r.join(posts(spark, sf_dir).select(F.col("message_id").alias("id"), "raw_text"), "id").select("query_id", "source", "ts", "score", F.explode(T.sentences(F.col("raw_text"))).alias("sentence"))
    return Q.strategic_trend(s, TREND)


# ---- typed requests: short questions with spans and other names, the table's newest post as the present -----------


def _requests(spark, sf_dir):
    """Prepared requests, posts and the time of the newest post."""
    p = posts(spark, sf_dir)
    now = F.lit(p.agg(F.max("ts")).first()[0]).cast("timestamp")
    return Q.prepare(questions(spark, sf_dir), now, aliases=spark.createDataFrame(ALIASES, "alias string, name string")), p, now


def _scored(spark, sf_dir):
    r, p, now = _requests(spark, sf_dir)
    r = stage(r, "requests")
    return r, p, stage(A.score_evidence(A.bounded_evidence(r, p), r, p, now), "scored-evidence")


_REQUESTS = f"""{_ASKED}, pair(a, b) AS (SELECT * FROM (VALUES {_PAIRS}) UNION ALL SELECT col1, col0 FROM (VALUES {_PAIRS})),
same(a, b) AS (SELECT a, a FROM pair UNION SELECT same.a, pair.b FROM same JOIN pair ON pair.a = same.b),
present AS (SELECT max(ts) AS now FROM {POSTS}),
k0 AS (SELECT *, list_distinct(list_filter(regexp_extract_all({_BARE}, '[a-z0-9]{{3,}}'), lambda w: NOT regexp_full_match(w, '[0-9]+') AND w NOT IN ({quoted(V.QUERY_GENERIC_TERMS)}))) AS kw,
  list_distinct(regexp_extract_all({_BARE}, '\\b\\d{{2,6}}\\b')) AS nums FROM asked, present),
o AS (SELECT query_id, list(DISTINCT b) AS names FROM (SELECT query_id, unnest(kw) AS a FROM k0) JOIN same USING (a) GROUP BY query_id),
k AS (SELECT k0.*, list_filter(coalesce(names, []), lambda x: NOT list_contains(kw, x)) AS al,
  CASE query_id % 7 WHEN 0 THEN now - to_hours(query_id % 23 + 1) WHEN 2 THEN date_trunc('day', now) WHEN 3 THEN date_trunc('day', now) - INTERVAL 1 DAY WHEN 4 THEN now - to_days((query_id % 23 + 1)::INT) WHEN 5 THEN now - INTERVAL 7 DAY END::TIMESTAMP AS since,
  CASE query_id % 7 WHEN 0 THEN now WHEN 2 THEN now WHEN 3 THEN date_trunc('day', now) WHEN 4 THEN now WHEN 5 THEN now END::TIMESTAMP AS until,
  query_id % 7 IN (0, 2) AND len(kw) <= 2 AS broad, query_id % 7 = 1 AS identity, query_id % 7 = 3 AS casualty, query_id % 7 = 4 AS confirm FROM k0 LEFT JOIN o USING (query_id))"""
_TOKENS = f"""tok AS (SELECT message_id AS id, channel_id AS source, ts, regexp_matches(lower(raw_text), '{A.IDENTITY_MARKER}') AS says_who, regexp_matches(lower(raw_text), '{Q.CASUALTY}') AS says_toll, contains(lower(raw_text), 'http') AS linked,
  unnest(list_distinct(regexp_extract_all(lower(raw_text), '[a-z0-9]{{2,}}'))) AS term FROM {POSTS})"""
_FOUND = f"""{_REQUESTS}, terms AS (SELECT query_id, since, until, 'keyword' AS kind, unnest(kw) AS term FROM k UNION ALL SELECT query_id, since, until, 'alias', unnest(al) FROM k UNION ALL SELECT query_id, since, until, 'number', unnest(nums) FROM k),
{_TOKENS},
found AS (SELECT query_id, id, source, ts, says_who, says_toll, linked, count(*) FILTER (kind = 'keyword') AS kw_hits, count(*) FILTER (kind <> 'number') AS alias_hits, count(*) FILTER (kind = 'number') AS num_hits
  FROM tok JOIN terms USING (term) WHERE (since IS NULL OR ts >= since) AND (until IS NULL OR ts < until) GROUP BY ALL)"""
_SCORED = f"""{_FOUND}, scored AS (SELECT f.*, round(3.5 * kw_hits / greatest(len(kw), 1) + 4.0 * alias_hits / greatest(len(kw) + len(al), 1) + 2.5 * num_hits + CASE WHEN len(nums) > 0 AND num_hits = len(nums) THEN 2.0 ELSE 0.0 END
  + CASE WHEN contains({squeeze("lower(p.raw_text)")}, lower(question)) AND kw_hits = len(kw) AND len(kw) > 0 THEN 2.0 ELSE 0.0 END + CASE WHEN identity AND says_who THEN 1.4 ELSE 0.0 END
  + CASE WHEN identity AND len(kw) > 0 AND kw_hits = len(kw) THEN 5.0 WHEN identity AND len(kw) > 0 THEN -6.0 ELSE 0.0 END + CASE WHEN casualty AND says_toll THEN 1.2 ELSE 0.0 END + CASE WHEN coalesce(source, '') <> '' THEN 0.15 ELSE 0.0 END + CASE WHEN linked THEN 0.2 ELSE 0.0 END
  + greatest(0.0, 1.0 - least(greatest(0.0, (floor(epoch(now)) - floor(epoch(f.ts))) / 3600.0) / 48.0, 1.0)), 6)::DOUBLE AS score FROM found AS f JOIN k USING (query_id) JOIN {POSTS} AS p ON p.message_id = f.id),
capped AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, ts DESC, id) AS r FROM scored WHERE score > 0),
best AS (SELECT query_id, id, source, ts, num_hits, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ts DESC, id) AS rank FROM capped WHERE r <= 3),
fresh AS (SELECT query_id, id, source, ts, num_hits, score, row_number() OVER (PARTITION BY query_id ORDER BY ts DESC, id) AS rank FROM scored WHERE query_id NOT IN (SELECT query_id FROM best)),
short AS (SELECT * FROM best WHERE rank <= 18 UNION ALL SELECT * FROM fresh WHERE rank <= 18)"""


@query(f"WITH RECURSIVE {_FOUND} SELECT query_id, count(*) AS posts, sum(kw_hits)::BIGINT AS kw_hits, sum(alias_hits)::BIGINT AS alias_hits, sum(num_hits)::BIGINT AS num_hits, min(ts) AS first_ts, max(ts) AS last_ts FROM found GROUP BY query_id")
def d16_bounded_evidence(spark, sf_dir):
    r, p, _ = _requests(spark, sf_dir)
    sums = [F.sum(c).alias(c) for c in ("kw_hits", "alias_hits", "num_hits")]
    return A.bounded_evidence(r, p).groupBy("query_id").agg(F.count(F.lit(1)).alias("posts"), *sums, F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query(f"WITH RECURSIVE {_SCORED} SELECT query_id, rank, id, round(score, 4) AS score FROM short")
def k2_request_scores(spark, sf_dir):
    _, _, s = _scored(spark, sf_dir)
    return A.shortlist(s).select("query_id", "rank", "id", F.round("score", 4).alias("score"))


@query(f"""WITH RECURSIVE {_SCORED}, top AS (SELECT query_id, count(*) AS n, min_by(score, rank) AS top, min_by(num_hits, rank) AS nh, count(DISTINCT lower(source)) FILTER (rank <= 6) AS sources FROM short GROUP BY query_id),
g AS (SELECT query_id, CASE WHEN n IS NULL THEN 'no_evidence' WHEN confirm AND sources < 2 THEN 'one_source' WHEN broad THEN CASE WHEN n >= 2 THEN 'broad' ELSE 'thin' END WHEN len(nums) > 0 AND nh = 0 AND top < 4.5 THEN 'number_missing'
  WHEN top >= CASE WHEN identity THEN 4.2 ELSE 2.6 END THEN 'score' WHEN sources >= 2 THEN 'sources' ELSE 'weak' END AS why FROM k LEFT JOIN top USING (query_id))
SELECT query_id, why IN ('broad', 'score', 'sources') AS ok, why FROM g""")
def e15_request_gates(spark, sf_dir):
    r, _, s = _scored(spark, sf_dir)
    return A.gates(r, A.shortlist(s))


@query()
def k2_reranked(spark, sf_dir):
    r, p, s = _scored(spark, sf_dir)
    return A.rerank(A.shortlist(s), r, p).select("query_id", "rank", "id", F.round("score", 4).alias("score"))


@query()
def k3_answer_rows(spark, sf_dir):
    r, p, s = _scored(spark, sf_dir)
    short = stage(A.rerank(A.shortlist(s), r, p), "ranked")
    lines = stage(Q.sentences(r, short, p, 6), "answer-lines")
    said = short.join(p.select(F.col("message_id").alias("id"), "raw_text"), "id").select("query_id", "source", "ts", "score", F.explode(T.sentences(F.col("raw_text"))).alias("sentence"))
    return A.answer_rows(r, A.gates(r, short), lines, Q.strategic_trend(said, TREND))


@query(f"""WITH RECURSIVE {_REQUESTS}, ask AS (SELECT query_id, 'keyword' AS kind, unnest(kw) AS term FROM k UNION ALL SELECT query_id, 'alias', unnest(al) FROM k UNION ALL SELECT query_id, 'number', unnest(nums) FROM k),
{_TOKENS},
hits AS (SELECT query_id, id, ts, count(*) FILTER (kind <> 'number') AS named FROM tok JOIN ask USING (term) GROUP BY ALL),
near AS (SELECT h.*, row_number() OVER (PARTITION BY query_id ORDER BY h.ts DESC, id) AS place FROM hits AS h JOIN k USING (query_id) WHERE h.ts >= coalesce(since, now - INTERVAL 2 HOUR) AND h.ts < coalesce(until, now + INTERVAL 1 SECOND)),
seen AS (SELECT query_id, count(*) AS n, count(*) FILTER (place <= 6 AND named > 0) AS m FROM near GROUP BY query_id),
thin AS (SELECT query_id FROM k LEFT JOIN seen USING (query_id) WHERE since IS NULL AND (coalesce(n, 0) < CASE WHEN broad THEN 4 ELSE 3 END OR (len(kw) + len(al) > 0 AND coalesce(m, 0) = 0))),
far AS (SELECT h.* FROM hits AS h JOIN k USING (query_id) JOIN thin USING (query_id) WHERE h.ts >= now - CASE WHEN identity THEN INTERVAL 12 HOUR ELSE INTERVAL 6 HOUR END AND h.ts < coalesce(until, now + INTERVAL 1 SECOND))
SELECT query_id, false AS expanded, count(*) AS posts FROM near WHERE query_id NOT IN (SELECT query_id FROM thin) GROUP BY query_id UNION ALL SELECT query_id, true, count(*) FROM far GROUP BY query_id""")
def i12_widened_requests(spark, sf_dir):
    """Windows of 2 hours, 6 and 12 behind the newest post, as the table has a post each minute."""
    r, p, now = _requests(spark, sf_dir)
    return A.widened(stage(r, "requests"), p, now, 2, 6, 12).groupBy("query_id", "expanded").agg(F.count(F.lit(1)).alias("posts"))
