"""Similarity joins over posts, with oracles for what SQL states exactly."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsmill.functions import text as T
from newsmill.operators import dedup as D
from newsmill.plans.base import NORMED, registry, tokens
from newsmill.sources.views import posts, stage, table

QUERIES, ORACLES = {}, {}
query = registry(QUERIES, ORACLES)

_TF = f"""t AS (SELECT message_id AS id, epoch(ts)::BIGINT AS t, unnest({tokens('norm')}) AS token FROM {NORMED} WHERE len(norm) >= 12),
tf AS (SELECT id, t, token, count(*) AS tf FROM t GROUP BY ALL),
s AS (SELECT *, count(*) OVER (PARTITION BY id) AS n, sum(tf * tf) OVER (PARTITION BY id) AS sq FROM tf),
j AS (SELECT a.id AS a, b.id AS b, a.n AS na, b.n AS nb, a.sq AS qa, b.sq AS qb, count(*) AS common, sum(a.tf * b.tf)::DOUBLE AS dot, sum(a.tf * a.tf)::DOUBLE AS sa, sum(b.tf * b.tf)::DOUBLE AS sb
  FROM s AS a JOIN s AS b ON a.token = b.token AND b.t >= a.t - 14400 AND b.t < a.t GROUP BY ALL)"""


@query(f"""WITH {_TF},
p AS (SELECT a, b, common / (na + nb - common) AS jaccard, least(1.0, dot / (sqrt(sa + {D.ALONE * D.ALONE} * (qa - sa)) * sqrt(sb + {D.ALONE * D.ALONE} * (qb - sb)))) AS tfidf FROM j)
SELECT a, b, round(jaccard, 6) AS jaccard, round(tfidf, 6) AS tfidf FROM p WHERE tfidf >= 0.48 OR jaccard >= 0.40""")
def d2_token_components(spark, sf_dir):
    f = stage(D.features(posts(spark, sf_dir)).select("id", "ts", "text_hash", "tokens"), "features")
    p = D.token_pairs(f, jaccard=0.40, tfidf=0.48)
    return p.select("a", "b", F.round("jaccard", 6).alias("jaccard"), F.round("tfidf", 6).alias("tfidf"))


@query()
def d2_near_duplicates(spark, sf_dir):
    p = D.near_duplicates(posts(spark, sf_dir))
    return p.select("a", "b", *[F.round(c, 6).alias(c) for c in ("score", "semantic", "tfidf", "fuzzy")])


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)
SELECT a.vec_id AS a, b.vec_id AS b, round(greatest(0.0, least(1.0, list_cosine_similarity(a.e, b.e))), 5) AS cosine
FROM v AS a JOIN v AS b ON b.vec_id < a.vec_id AND b.vec_id >= a.vec_id - 240 WHERE list_cosine_similarity(a.e, b.e) >= 0.3""")
def d3_embedding_cosine(spark, sf_dir):
    """A vector follows every minute, as posts do."""
    v = table(spark, sf_dir, "embeddings").withColumn("ts", F.timestamp_seconds(F.col("vec_id") * 60))
    return D.cosine_pairs(v, 0.3).withColumn("cosine", F.round("cosine", 5))


@query(f"WITH {_TF} SELECT a, b, round(dot / sqrt(qa * qb), 6) AS score FROM j WHERE round(dot / sqrt(qa * qb), 6) >= 0.83")
def d5_tf_cosine(spark, sf_dir):
    return D.tf_cosine(stage(D.features(posts(spark, sf_dir)).select("id", "ts", "text_hash", "tokens"), "features"))


@query()
def d6_match_history(spark, sf_dir):
    """The archive of one channel is the history; posts of all others are matched with its last day before them."""
    p = posts(spark, sf_dir)
    old = p.where("channel_id = 'src0'")
    return D.near_duplicates(p.where("channel_id IS DISTINCT FROM 'src0'"), old, hours=24).select("a", "b", F.round("score", 6).alias("score"))


@query()
def i5_near_dedup(spark, sf_dir):
    p = posts(spark, sf_dir)
    pairs = D.near_duplicates(p)
    kept = D.greedy_keep(p.select(F.col("message_id").alias("id")), pairs)
    return kept.join(D.best_match(pairs, kept), "id", "left").select("id", "kept", F.when(~F.col("kept"), F.col("matched")).alias("matched"))


@query()
def e9_duplicate_merge(spark, sf_dir):
    p = posts(spark, sf_dir)
    pairs = D.near_duplicates(p)
    kept = D.greedy_keep(p.select(F.col("message_id").alias("id")), pairs)
    return D.merge_reports(D.best_match(pairs, kept).join(kept.where("NOT kept"), "id"), p)


@query(f"""WITH RECURSIVE n AS (SELECT message_id AS id, channel_id AS source, epoch(ts)::BIGINT AS t, min(message_id) OVER (PARTITION BY text_hash) AS matched FROM {NORMED}),
f AS (SELECT n.matched, n.source, min(n.t) AS t, any_value(o.t) AS begin_ FROM n JOIN n AS o ON o.id = n.matched WHERE n.id <> n.matched AND n.source <> o.source GROUP BY n.matched, n.source),
o AS (SELECT *, row_number() OVER (PARTITION BY matched ORDER BY t, source) AS r FROM f),
g(matched, r, source, t) AS (SELECT matched, r, source, t FROM o WHERE r = 1 AND t - begin_ <= 21600
  UNION ALL SELECT o.matched, o.r, o.source, o.t FROM g JOIN o ON o.matched = g.matched AND o.r = g.r + 1 WHERE o.t - g.t <= 21600)
SELECT matched AS id, array_to_string(list_sort(list(source))[1:6], ', ') AS also_reported_by, count(*) AS reports, (TIMESTAMP '1970-01-01' + to_seconds(max(t)))::TIMESTAMP AS last_ts FROM g GROUP BY matched""")
def e9_live_reports(spark, sf_dir):
    """Posts of equal text report the earliest of them, which is live for six hours, as the table has a post each minute."""
    p = posts(spark, sf_dir)
    keys = stage(p.select(F.col("message_id").alias("id"), T.fingerprint(T.normalize(F.col("raw_text"))).alias("k")), "hashes")
    first = keys.groupBy("k").agg(F.min("id").alias("matched"))
    dups = keys.join(first, "k").where("id <> matched")
    return D.live_reports(dups, p, 360)


@query()
def d4_media_duplicates(spark, sf_dir):
    """A text's length stands for the hash of its media."""
    p = posts(spark, sf_dir)
    return D.media_duplicates(p.select(F.col("message_id").alias("id"), "ts", F.sha1(F.length("raw_text").cast("string").cast("binary")).alias("media_hash"), "raw_text"))
