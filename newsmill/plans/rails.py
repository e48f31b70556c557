"""Rail queries: headlines of half-hour windows matched, ranked and laid out; tests compare with brute force."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from newsmill.functions import vocab as V
from newsmill.operators import rail as R
from newsmill.operators.stories import headlines
from newsmill.plans.base import POSTS, names, quoted, registry, squeeze
from newsmill.plans.story import KEYWORDS
from newsmill.sources.views import posts, stage

QUERIES, ORACLES = {}, {}
query = registry(QUERIES, ORACLES)


def _inputs(spark, sf_dir):
    """Lines with the narrow columns of their posts, and the posts' texts, which aren't staged and move with no other step."""
    end = F.window(F.col("ts") - F.expr("interval 1 microsecond"), "30 minutes").getField("end")
    p = posts(spark, sf_dir).withColumnRenamed("message_id", "id").withColumn("window_end", end)
    severity = F.when(F.col("hits") >= 3, "high").when(F.col("hits") >= 1, "medium").otherwise("low")
    rows = p.select("window_end", "id", F.col("channel_id").alias("source"), "ts").join(headlines(posts(spark, sf_dir), KEYWORDS), "id")
    place = F.row_number().over(Window.partitionBy("window_end").orderBy("ts", "id")) - 1
    lines = stage(rows.select("window_end", F.col("id").alias("line_id"), "headline", place.alias("place"), "id", "source", "ts", severity.alias("severity"), F.lit(0.0).alias("bonus")), "rail-posts")
    said = F.col("raw_text").rlike(r"\S")  # others have no headline
    return lines, p.where(said).select("window_end", "id", F.col("raw_text").alias("text"))


def _ranked(spark, sf_dir):
    lines, texts = _inputs(spark, sf_dir)
    return R.rank(lines.select("window_end", "line_id", "headline", "place"), lines, R.match_posts(lines, texts))


_KEY = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"
_SIDE = f"""list_distinct(list_filter(string_split(k, ' '), lambda w: len(w) >= 4 AND w NOT IN ({quoted(V.DUPE_STOP_WORDS)}))) AS topic,
  list_distinct(list_concat(regexp_extract_all(lower(t), '[0-9]+'), list_transform(list_filter(regexp_extract_all(lower(t), '[a-z]+'), lambda w: w IN ({quoted(V.NUMBER_WORDS)})), lambda w: map {{{", ".join(f"'{k}': '{v}'" for k, v in V.NUMBER_WORDS.items())}}}[w]))) AS numbers,
  {names('t')} AS names"""
_OVERLAPS = f"""WITH w AS (SELECT message_id AS id, raw_text AS t, time_bucket(INTERVAL 30 MINUTE, ts - INTERVAL 1 MICROSECOND) + INTERVAL 30 MINUTE AS window_end FROM {POSTS}),
l AS (SELECT message_id AS id, unnest(parts) AS sentence, generate_subscripts(parts, 1) AS place FROM (SELECT message_id, list_filter(string_split(regexp_replace({squeeze("raw_text")}, '([.!?]) ', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS parts FROM {POSTS})),
hit AS (SELECT *, len(list_filter([{quoted(KEYWORDS)}], lambda k: list_contains(regexp_extract_all(lower(sentence), '[a-z0-9]+'), k))) AS hits FROM l),
best AS (SELECT id, sentence AS t FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY hits DESC, len(sentence), place) AS r FROM hit) WHERE r = 1),
h AS (SELECT *, {_SIDE} FROM (SELECT best.id, best.t, window_end, {_KEY.format("best.t")} AS k FROM best JOIN w USING (id))),
p AS (SELECT *, {_SIDE} FROM (SELECT w.*, {_KEY.format("w.t")} AS k FROM w JOIN best USING (id))),
j AS (SELECT window_end, h.id AS line_id, p.id AS id, len(list_intersect(h.topic, p.topic)) AS "both", len(h.topic) AS nh, len(p.topic) AS np, list_has_any(h.numbers, p.numbers) AS num, list_has_any(h.names, p.names) AS name,
  2 * least(len(h.k), len(p.k)) >= 0.55 * (len(h.k) + len(p.k)) AS close FROM h JOIN p USING (window_end)),
c AS (SELECT *, "both" / greatest(nh, 1) AS coverage FROM j)
SELECT window_end, line_id, id, "both", round(coverage, 6) AS coverage, round("both" / greatest(np, 1), 6) AS density, num, name, coverage >= 0.6 AND "both" >= 3 AS same
FROM c WHERE coverage >= 0.42 OR "both" >= 3 OR close AND (num OR name)"""


@query(_OVERLAPS)
def d14_headline_overlap(spark, sf_dir):
    o = R.overlaps(*_inputs(spark, sf_dir))
    return o.select("window_end", "line_id", "id", "both", F.round("coverage", 6).alias("coverage"), F.round("density", 6).alias("density"), "num", "name", "same")


@query()
def d14_headline_match(spark, sf_dir):
    return R.match_posts(*_inputs(spark, sf_dir)).withColumn("match", F.round("match", 6))


@query()
def f4_rail_rank(spark, sf_dir):
    return _ranked(spark, sf_dir)


@query()
def k4_digest_rows(spark, sf_dir):
    return R.digest_rows(_ranked(spark, sf_dir))
