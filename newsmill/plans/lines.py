"""Queries over headline lines, feeds and hooks, with their oracles."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from newsmill.functions import fuzzy as Z
from newsmill.functions import text as T
from newsmill.functions import vocab as V
from newsmill.operators import hooks as H
from newsmill.operators import lines as L
from newsmill.operators.stories import headlines
from newsmill.plans.base import POSTS, foreign_lines, names, quoted, registry, squeeze
from newsmill.plans.story import KEYWORDS
from newsmill.sources import feeds
from newsmill.sources.views import posts, shared_path, stage, table

QUERIES, ORACLES = {}, {}
query = registry(QUERIES, ORACLES)

_BEST = f"""l AS (SELECT message_id AS id, unnest(parts) AS sentence, generate_subscripts(parts, 1) AS place FROM (SELECT message_id, list_filter(string_split(regexp_replace({squeeze("raw_text")}, '([.!?]) ', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS parts FROM {POSTS})),
hit AS (SELECT *, len(list_filter([{quoted(KEYWORDS)}], lambda k: list_contains(regexp_extract_all(lower(sentence), '[a-z0-9]+'), k))) AS hits FROM l),
best AS (SELECT id, sentence AS line, hits FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY hits DESC, len(sentence), place) AS r FROM hit) WHERE r = 1),
w AS (SELECT message_id AS id, channel_id, ts, raw_text, time_bucket(INTERVAL 30 MINUTE, ts - INTERVAL 1 MICROSECOND) + INTERVAL 30 MINUTE AS "by" FROM {POSTS}),
h AS (SELECT w.*, line, hits FROM w JOIN best USING (id))"""


def _lines(spark, sf_dir):
    """by (window end), pos (post), line (its headline), hits."""
    p = posts(spark, sf_dir)
    end = F.window(F.col("ts") - F.expr("interval 1 microsecond"), "30 minutes").getField("end")
    h = headlines(p, KEYWORDS)
    return p.withColumnRenamed("message_id", "id").join(h, "id").select(end.alias("by"), F.col("id").alias("pos"), F.col("headline").alias("line"), "hits", "channel_id", "ts", "raw_text")


def _when(checks):
    return " ".join(f"WHEN regexp_matches(x, '{p[0]}')" + (f" AND NOT regexp_matches(x, '{p[1]}')" if p[1:] else "") + f" THEN '{c}'" for c, *p in checks)


_ISSUE = f"CASE WHEN x = '' THEN 'empty_output' {{}} {_when(L.CHECKS)} WHEN len(regexp_extract_all(x, '[A-Za-z0-9_]+')) < 5 THEN 'headline_too_thin' WHEN NOT regexp_matches(x, 'thor|[0-9]') THEN 'headline_too_thin' {_when(L.LAST_CHECKS)} ELSE '' END"


@query(f"WITH {_BEST} SELECT {_ISSUE.replace('{}', '')} AS issue, count(*) AS lines FROM (SELECT {squeeze('line')} AS x FROM h) GROUP BY 1")
def b8_line_audit(spark, sf_dir):
    return L.audit_counts(_lines(spark, sf_dir), action="thor|[0-9]")


@query(f"""WITH {_BEST}, {foreign_lines(f"SELECT id, {squeeze('line')} AS t FROM h", V.FOREIGN_CUES)}
SELECT {_ISSUE.replace('{}', "WHEN foreign_ THEN 'non_english_leftovers'")} AS issue, count(*) AS lines FROM (SELECT *, t AS x FROM g) GROUP BY 1""")
def b8_english_audit(spark, sf_dir):
    return L.audit_counts(_lines(spark, sf_dir), action="thor|[0-9]", english=True)


_KEY = "trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g'))"


@query(f"""WITH {_BEST}, x AS (SELECT "by", id AS pos, {squeeze('line')} AS x FROM h),
ok AS (SELECT *, {_KEY} AS k FROM x WHERE x <> '' AND NOT regexp_matches(x, '[?]') AND len(regexp_extract_all(x, '[A-Za-z0-9_]+')) >= 5 AND (len({names('x')}) > 0 OR regexp_matches(x, '[0-9]'))),
once AS (SELECT *, row_number() OVER (PARTITION BY "by", k ORDER BY pos) AS r FROM ok)
SELECT "by", pos, x AS line FROM (SELECT *, row_number() OVER (PARTITION BY "by" ORDER BY pos) AS n FROM once WHERE r = 1 OR k = '') WHERE n <= 4""")
def b9_rail_scrub(spark, sf_dir):
    return L.scrub(_lines(spark, sf_dir), "also_moving", r"\?", 4)


_LOW = "regexp_extract_all(lower({}), '[a-z0-9]+')"
_NUMBERS = f"list_concat(regexp_extract_all(lower({{0}}), '[0-9]+'), list_transform(list_filter(regexp_extract_all(lower({{0}}), '[a-z]+'), lambda w: w IN ({quoted(V.NUMBER_WORDS)})), lambda w: map {{{{{', '.join(f"'{k}': '{v}'" for k, v in V.NUMBER_WORDS.items())}}}}}[w]))"
_EXTRA = "len(list_filter({}, lambda v: NOT list_contains({}, v))) > 0"
_OF = "list_filter(" + _LOW + ", lambda v: v IN ({}))"
_TOK = "list_distinct(list_filter(" + _LOW + ", lambda v: len(v) >= 4))"


@query(f"""WITH {_BEST}, p AS (SELECT id, channel_id, raw_text AS s, lag(line) OVER (PARTITION BY channel_id ORDER BY ts, id) AS c FROM h)
SELECT id, CASE WHEN {squeeze("coalesce(s, '')")} = '' OR {squeeze("coalesce(c, '')")} = '' THEN 'empty_output' WHEN regexp_matches(c, '(^|[^\\p{{L}}\\p{{N}}_])(?:{L.PRONOUNS})($|[^\\p{{L}}\\p{{N}}_])') THEN 'pronoun_leak' WHEN len(regexp_extract_all(c, '[A-Za-z0-9_]+')) < 4 THEN 'headline_too_thin'
  WHEN {_EXTRA.format(_NUMBERS.format('c'), _NUMBERS.format('s'))} THEN 'invented_number'
  WHEN len({_OF.format('s', quoted(['thor', 'inti']))}) > 0 AND len({_OF.format('c', quoted(['thor', 'inti']))}) = 0 THEN 'lost_hedge'
  WHEN {_EXTRA.format(_OF.format('c', quoted(['ouble', 'pour'])), _LOW.format('s'))} THEN 'unsupported_actor'
  WHEN {_EXTRA.format(names('c'), _LOW.format('s'))} THEN 'unsupported_name'
  WHEN {_EXTRA.format(_OF.format('c', quoted(['edst'])), _LOW.format('s'))} THEN 'unsupported_escalation'
  WHEN len({_TOK.format('c')}) >= 6 AND len(list_intersect({_TOK.format('c')}, {_TOK.format('s')})) < 2 THEN 'low_overlap' ELSE '' END AS issue FROM p""")
def b10_grounding_audit(spark, sf_dir):
    """The headline before in a post's channel stands for a copy of it."""
    from pyspark.sql import Window

    p = _lines(spark, sf_dir).withColumn("copy", F.lag("line").over(Window.partitionBy("channel_id").orderBy("ts", "pos")))
    return p.select(F.col("pos").alias("id"), L.grounding_issue(F.col("raw_text"), F.col("copy"), ("thor", "inti"), ("edst",), ("ouble", "pour"), least=4).alias("issue"))


@query()
def f8_keep_stronger(spark, sf_dir):
    return L.keep_stronger(_lines(spark, sf_dir).select("by", "pos", "line"))


@query(f"""WITH {_BEST}, s AS (SELECT "by", id, line, CASE WHEN hits >= 3 THEN 0 WHEN hits >= 1 THEN 1 ELSE 2 END AS o FROM h),
r AS (SELECT *, count(*) FILTER (o = 0) OVER (PARTITION BY "by") AS mains, row_number() OVER (PARTITION BY "by" ORDER BY o, id) AS place FROM s),
k AS (SELECT *, CASE WHEN o = 0 OR (mains = 0 AND place = 1) THEN 'main' ELSE 'also' END AS section FROM r)
SELECT "by", section, pos, line FROM (SELECT *, row_number() OVER (PARTITION BY "by", section ORDER BY place) AS pos FROM k) WHERE pos <= 12""")
def h4_backfill(spark, sf_dir):
    section = F.when(F.col("hits") >= 3, "main").when(F.col("hits") >= 1, "also").otherwise("demoted")
    return L.backfill(_lines(spark, sf_dir).select("by", section.alias("section"), "pos", "line"))


@query(f"""WITH d AS (SELECT message_id AS id, len(raw_text) AS n FROM {POSTS})
SELECT id, CASE WHEN n % 3 = 0 THEN 'deliver' ELSE 'digest' END AS action, CASE WHEN n % 3 = 0 THEN 'high' ELSE 'low' END AS severity, CASE WHEN n % 3 = 0 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS confidence, CASE WHEN n % 3 = 0 THEN 'model' ELSE 'rules' END AS decided_by FROM d""")
def j2_model_decisions(spark, sf_dir):
    """A stand-in for a model: by length its answer is valid, has an unknown action, or isn't JSON."""

    @F.arrow_udf("string")
    def answer(texts: pa.Array) -> pa.Array:
        say = ('{"action": "deliver", "severity": "high", "confidence": 7}', '{"action": "shout", "severity": "high"}', "no answer")
        n = pc.fill_null(pc.utf8_length(texts), 2)  # no text becomes a Python object; there is no answer to a null one
        return pa.array(say).take(pa.array(n.to_numpy() % 3))

    rules = posts(spark, sf_dir).select(F.col("message_id").alias("id"), "raw_text", F.lit("digest").alias("action"), F.lit("low").alias("severity"), F.lit(0.5).alias("confidence"), F.lit(None).cast("string").alias("headline"))
    return H.model_decisions(rules, answer(F.col("raw_text"))).select("id", "action", "severity", "confidence", "decided_by")


@query(f"SELECT message_id AS id, len(raw_text) - len(replace(raw_text, 'a', '')) AS first, len(raw_text) - len(replace(raw_text, 'e', '')) AS second FROM {POSTS}")
def j4_embed(spark, sf_dir):
    """A stand-in for an encoder: it counts two letters."""
    v = H.embed(posts(spark, sf_dir), "raw_text", lambda texts: [[t.count("a"), t.count("e")] for t in texts])
    return v.select(F.col("message_id").alias("id"), *[F.get("embedding", F.lit(i)).cast("long").alias(n) for i, n in enumerate(("first", "second"))])


_HOST = "lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1))"


@query(f"""WITH p AS (SELECT page_id, url, {_HOST} AS host, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title, TIMESTAMP '2024-01-01' + to_minutes(page_id) AS ts FROM pages),
k AS (SELECT * FROM p WHERE title <> '' AND starts_with(url, 'http') AND regexp_matches(host, '(^|[.])example[.](net|org)$') AND ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-03' AND ts <= TIMESTAMP '2024-01-02 12:00:00' + INTERVAL 5 MINUTE)
SELECT host, title, ts AS published FROM (SELECT *, row_number() OVER (PARTITION BY host, lower(title) ORDER BY ts DESC, url) AS r FROM k) WHERE r = 1""")
def a6_feed_items(spark, sf_dir):
    """The pages written as feed files and read again."""
    pages = table(spark, sf_dir, "pages")
    item = pages.select(F.trim(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title"), F.col("url").alias("link"), F.lit("").alias("description"), F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.col("page_id") * 60), "EEE, dd MMM yyyy HH:mm:ss 'GMT'").alias("pubDate"))
    at = shared_path(spark, "feeds")
    item.write.format("xml").option("rowTag", "item").option("rootTag", "channel").save(at)
    got = feeds.feed_items(spark, at, ["example.net", "example.org"], "2024-01-01", "2024-01-03", "2024-01-02 12:00:00")
    return got.select("host", "title", "published")


@query(f"""WITH b AS (SELECT message_id, channel_id, CASE WHEN channel_id = 'src0' THEN list_transform(string_split(raw_text, chr(10)), lambda t: trim(regexp_replace(regexp_replace(t, '(?i)^\\s*(?:thor|inti)\\s*[:|-]\\s*', ''), '(?i)@(?:thor|inti)\\b', '', 'g'))) ELSE string_split(raw_text, chr(10)) END AS ls FROM {POSTS})
SELECT message_id, sha1(array_to_string(CASE WHEN channel_id = 'src0' THEN list_filter(ls, lambda t: NOT regexp_full_match(t, '(?i)(?:thor|inti)\\W*')) ELSE ls END, chr(10))) AS text_id FROM b""")
def c6_source_aliases(spark, sf_dir):
    aliases = spark.createDataFrame([("src0", "thor"), ("src0", "inti")], "channel_id string, alias string")
    p = feeds.strip_aliases(posts(spark, sf_dir), aliases)
    return p.select("message_id", F.sha1(F.col("raw_text").cast("binary")).alias("text_id"))


@query()
def j3_line_ratio(spark, sf_dir):
    """Each headline against the one before in its channel: ratio, ratio with words in order, and the bound of the ratio."""
    from pyspark.sql import Window

    p = _lines(spark, sf_dir).withColumn("before", F.lag("line").over(Window.partitionBy("channel_id").orderBy("ts", "pos"))).where("before IS NOT NULL")
    x, y = (T.normalize(F.col(c)) for c in ("line", "before"))
    p = p.select(F.col("pos").alias("id"), x.alias("x"), y.alias("y"))
    bound = Z.ratio_bound(Z.profile(F.col("x")), Z.profile(F.col("y")))
    return p.select("id", F.round(Z.ratio("x", "y"), 6).alias("ratio"), F.round(Z.token_sort_ratio(F.col("x"), F.col("y")), 6).alias("sorted_ratio"), F.round(bound, 6).alias("bound"))
