"""Queries on keyed tables, text enrichment and simple windows, with their oracles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from newsmill.functions import text as T
from newsmill.functions import vocab as V
from newsmill.operators import gates as G
from newsmill.operators import keyed as K
from newsmill.plans.base import NORMED, POSTS, quoted, registry, squeeze, tokens
from newsmill.sources.views import posts, read_posts_jsonl, shared_path, stage, table
from newsmill.streaming.windows import route

QUERIES, ORACLES = {}, {}
query = registry(QUERIES, ORACLES)


def normed(spark, sf_dir):
    return posts(spark, sf_dir).withColumn("norm", T.normalize(F.col("raw_text"))).withColumn("text_hash", T.fingerprint(F.col("norm")))


@query("SELECT source AS chat_id, count(*) AS posts, sum(len(text))::BIGINT AS chars FROM documents GROUP BY source")
def a1_posts_jsonl(spark, sf_dir):
    at = shared_path(spark, "posts-jsonl")
    p = posts(spark, sf_dir)
    p.select(F.to_json(F.struct(F.col("channel_id").alias("chat_id"), F.col("source_name").alias("chat_title"), "message_id", F.col("ts").alias("date"), F.col("raw_text").alias("text")))).write.text(at)
    return read_posts_jsonl(spark, at).groupBy("chat_id").agg(F.count(F.lit(1)).alias("posts"), F.sum(F.length("text")).alias("chars"))


@query(f"""
WITH marks AS (SELECT channel_id, max(message_id) AS last_id FROM {POSTS} p JOIN labels l ON l.doc_id = p.message_id WHERE l.quality = 0 GROUP BY channel_id),
new AS (SELECT p.* FROM {POSTS} p LEFT JOIN marks USING (channel_id) WHERE message_id > coalesce(last_id, -1))
SELECT channel_id, count(*) AS new_posts, max(message_id) AS next_mark FROM new GROUP BY channel_id""")
def a2_incremental_backfill(spark, sf_dir):
    p, low = posts(spark, sf_dir), table(spark, sf_dir, "labels").where("quality = 0")
    marks = p.join(low, p["message_id"] == low["doc_id"]).groupBy("channel_id").agg(F.max("message_id").alias("last_id"))
    new = K.incremental(p, marks)
    return new.groupBy("channel_id").agg(F.count(F.lit(1)).alias("new_posts"), F.max("message_id").alias("next_mark"))


@query(f"""SELECT channel_id, message_id, len(raw_text) AS chars FROM (SELECT channel_id, message_id, trim(raw_text, ' ') AS raw_text FROM {POSTS})
WHERE raw_text <> '' AND message_id NOT IN (SELECT doc_id FROM labels)""")
def a4_append_archive(spark, sf_dir):
    p = posts(spark, sf_dir)
    archive = p.join(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("message_id")), "message_id", "left_semi")
    return K.append_archive(p, archive).select("channel_id", "message_id", F.length("raw_text").alias("chars"))


@query(r"""
WITH b AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script>', ' ', 'g'),
  '(?is)<style\b[^>]*>.*?</style>', ' ', 'g'), '(?is)<nav\b[^>]*>.*?</nav>', ' ', 'g'), '(?is)<footer\b[^>]*>.*?</footer>', ' ', 'g') AS bare FROM pages),
p AS (SELECT page_id, bare, list_filter(list_transform(regexp_extract_all(bare, '(?is)<p\b[^>]*>(.*?)</p>', 1),
  lambda x: trim(regexp_replace(regexp_replace(x, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))), lambda x: len(string_split(x, ' ')) >= 8) AS good FROM b),
a AS (SELECT page_id, CASE WHEN len(good) > 0 THEN array_to_string(good, ' ') ELSE trim(regexp_replace(regexp_replace(bare, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) END AS t FROM p)
SELECT page_id, CASE WHEN len(t) <= 1200 THEN t ELSE regexp_replace(t[:1197], ' [^ ]*$', '') || '...' END AS article_text FROM a""")
def a5_extract_articles(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.article(F.coalesce("html", F.lit(""))).alias("article_text"))


@query("""SELECT user_id, max_by(event_id, ts) AS event_id, max_by(event_type, ts) AS event_type, max(ts) AS ts FROM events GROUP BY user_id""")
def a7_upsert_latest(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    return K.upsert_latest(e.where("event_type = 'view'"), e.where("event_type <> 'view'"), ["user_id"], "ts").select("user_id", "event_id", "event_type", "ts")


@query("""SELECT event_id, coalesce(CAST(json_extract(props, '$.k') AS BIGINT), 0) AS k, CASE WHEN json_valid(props) THEN 'ok' ELSE 'bad' END AS state FROM events""")
def a8_facts_json(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    facts = F.from_json("props", "k long", {"mode": "PERMISSIVE"})
    back = e.withColumn("facts", facts).withColumn("again", F.from_json(F.to_json("facts"), "k long"))
    return back.select("event_id", F.coalesce("again.k", F.lit(0)).alias("k"), F.when(F.col("facts").isNotNull(), "ok").otherwise("bad").alias("state"))


@query(f"SELECT channel_id, count(*) AS unseen FROM {POSTS} WHERE message_id NOT IN (SELECT doc_id FROM labels) GROUP BY channel_id")
def b1_drop_seen(spark, sf_dir):
    p = posts(spark, sf_dir)
    seen = p.join(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("message_id")), "message_id").select("channel_id", "message_id")
    return K.drop_seen(p, seen).groupBy("channel_id").agg(F.count(F.lit(1)).alias("unseen"))


@query(f"""SELECT message_id, (hits >= 2 OR (hits >= 1 AND links >= 1) OR tags >= 12) AS is_noise FROM (
  SELECT message_id, len(list_filter([{quoted(V.SPAM_TERMS)}], lambda t: contains(lower(raw_text), t))) AS hits,
    len(regexp_extract_all(lower(raw_text), 'http://|https://|t\\.me/')) AS links, len(regexp_extract_all(lower(raw_text), '#[a-z0-9_]+')) AS tags FROM {POSTS})""")
def b2_drop_noise(spark, sf_dir):
    return posts(spark, sf_dir).select("message_id", T.is_noise(F.col("raw_text")).alias("is_noise"))


@query("""SELECT event_type, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM events
WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20' GROUP BY event_type""")
def b4_window_slice(spark, sf_dir):
    rows = K.window_slice(table(spark, sf_dir, "events"), F.lit("2024-01-10").cast("timestamp"), F.lit("2024-01-20").cast("timestamp"))
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


@query("""WITH h AS (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS host FROM pages)
SELECT page_id, host FROM h WHERE host = 'example.net' OR ends_with(host, '.example.net') OR host = 'example.org' OR ends_with(host, '.example.org')""")
def b6_allowlist(spark, sf_dir):
    allowed = spark.createDataFrame([("example.net",), (".Example.org ",)], "domain string")
    hosts = table(spark, sf_dir, "pages").select("page_id", F.lower(F.expr("try_parse_url(url, 'HOST')")).alias("host"))
    return G.allowlist(hosts, allowed, "host")


@query(f"""WITH b AS (SELECT message_id, channel_id, trim(regexp_replace(lower(coalesce(channel_id, '')), '[^a-z0-9. -]+', '', 'g')) AS b FROM {POSTS})
SELECT message_id, channel_id FROM b WHERE b || '.co.uk' = 'src1.co.uk' OR b || '.com' = 'src12.com' OR b = 'src3' OR b || '.org' = 'src0.org'""")
def b6_source_labels(spark, sf_dir):
    """Posts without a host, by their source's label."""
    allowed = spark.createDataFrame([("src1.co.uk",), ("SRC12.com",), ("src3",), (".src0.org",), ("other.example",), (None,)], "domain string")
    return G.allowlist(posts(spark, sf_dir).withColumn("host", F.lit(None).cast("string")), allowed, "host", "channel_id").select("message_id", "channel_id")


@query(f"""SELECT message_id FROM {POSTS} WHERE CAST(('0x' || sha256(lower(raw_text))[1:8]) AS BIGINT) / 4294967295.0 < 0.25""")
def b11_hash_sample(spark, sf_dir):
    part = F.conv(F.substring(F.sha2(F.lower("raw_text").cast("binary"), 256), 1, 8), 16, 10).cast("double") / 4294967295.0
    return posts(spark, sf_dir).where(part < 0.25).select("message_id")


@query(f"SELECT message_id, len(norm) AS n, text_hash FROM {NORMED}")
def c1_fingerprint(spark, sf_dir):
    return normed(spark, sf_dir).select("message_id", F.length("norm").alias("n"), "text_hash")


@query(f"""WITH t AS (SELECT message_id, {tokens('norm')} AS tok FROM {NORMED}),
k AS (SELECT message_id, tok, array_to_string(list_sort(tok), ' ') AS key FROM t)
SELECT message_id, len(tok) AS n_tokens, len(list_distinct(tok)) AS n_distinct, sha1(key) AS key_hash, greatest(len(tok) - 1, 0) AS n_bigrams,
  len(list_distinct(list_transform(range(1, greatest(len(key) - 2, 1)), lambda i: key[i:i + 3]))) AS n_chargrams,
  len(list_filter(tok, lambda w: regexp_full_match(w, '[0-9]+') OR w IN ({quoted([*V.BREAKING_HINTS, *V.GEO_HINTS])}) OR len(w) >= 8)) AS n_anchors FROM k""")
def c2_dedup_features(spark, sf_dir):
    t = normed(spark, sf_dir).select("message_id", T.tokens(F.col("norm")).alias("tok")).withColumn("key", F.array_join(F.sort_array("tok"), " "))
    return t.select("message_id", F.size("tok").alias("n_tokens"), F.size(F.array_distinct("tok")).alias("n_distinct"), F.sha1(F.col("key").cast("binary")).alias("key_hash"), F.size(T.bigrams(F.col("tok"))).alias("n_bigrams"), F.size(T.key_grams(F.col("tok"))).alias("n_chargrams"), F.size(T.anchors(F.col("tok"))).alias("n_anchors"))


@query(f"""WITH s AS (SELECT message_id, list_filter(string_split(regexp_replace({squeeze("raw_text")}, '([.!?]) ', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS parts FROM {POSTS})
SELECT message_id, len(parts) AS sentences, len(parts[1]) AS first_chars FROM s""")
def c4_sentences(spark, sf_dir):
    s = posts(spark, sf_dir).select("message_id", T.sentences(F.col("raw_text")).alias("parts"))
    return s.select("message_id", F.size("parts").alias("sentences"), F.length(F.get("parts", F.lit(0))).alias("first_chars"))


@query(rf"""WITH n AS (SELECT message_id, regexp_extract_all(lower(raw_text), '\d+') AS digits, regexp_extract_all(lower(raw_text), '[a-z]+') AS words FROM {POSTS})
SELECT message_id, len(list_distinct(list_concat(digits, list_transform(list_filter(words, lambda w: w IN ({quoted(V.NUMBER_WORDS)})), lambda w: MAP {{{', '.join(f"'{k}': '{v}'" for k, v in V.NUMBER_WORDS.items())}}}[w])))) AS n_numbers,
  coalesce(digits[1], '') AS first_number FROM n""")
def c7_extract_tokens(spark, sf_dir):
    return posts(spark, sf_dir).select("message_id", F.size(T.numbers(F.col("raw_text"))).alias("n_numbers"), F.coalesce(F.get(F.regexp_extract_all("raw_text", F.lit(r"\d+"), F.lit(0)), F.lit(0)), F.lit("")).alias("first_number"))


@query(f"""SELECT message_id, 'https://t.me/' || channel_id || '/' || message_id AS link, strftime(ts + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M') AS date_label FROM {POSTS}""")
def c9_links_and_labels(spark, sf_dir):
    local = F.from_utc_timestamp("ts", "Africa/Lagos")
    return posts(spark, sf_dir).select("message_id", F.concat(F.lit("https://t.me/"), "channel_id", F.lit("/"), F.col("message_id").cast("string")).alias("link"), F.date_format(local, "yyyy-MM-dd HH:mm").alias("date_label"))


@query(f"""SELECT message_id, CASE WHEN len(raw_text) = 0 THEN 0 ELSE greatest(1, len(raw_text) // 4) END AS est_tokens,
  greatest(48, CASE WHEN len(raw_text) = 0 THEN 0 ELSE greatest(1, len(raw_text) // 4) END + 32) AS row_cost,
  CASE WHEN len(raw_text) <= 120 THEN raw_text ELSE regexp_replace(raw_text[:117], ' [^ ]*$', '') || '...' END AS short_text FROM {POSTS}""")
def c10_estimate_tokens(spark, sf_dir):
    est = T.estimate_tokens(F.col("raw_text"))
    return posts(spark, sf_dir).select("message_id", est.alias("est_tokens"), F.greatest(F.lit(48), est + 32).alias("row_cost"), T.cut_at_word(F.col("raw_text"), 120).alias("short_text"))


@query(f"""WITH n AS (SELECT message_id, channel_id, ts, text_hash, epoch(ts) AS t FROM {NORMED} WHERE text_hash <> ''),
w AS (SELECT message_id, first_value(message_id) OVER (PARTITION BY text_hash ORDER BY t RANGE BETWEEN 14400 PRECEDING AND CURRENT ROW) AS m FROM n)
SELECT message_id, CASE WHEN m <> message_id THEN m END AS matched_message_id FROM w""")
def d1_exact_duplicates(spark, sf_dir):
    n = stage(normed(spark, sf_dir).select("channel_id", "message_id", "ts", "text_hash"), "hashes")  # else the filter would hash once more
    return K.exact_duplicates(n.where("text_hash <> ''")).select("message_id", "matched_message_id")


@query(f"""WITH n AS (SELECT message_id, ts, text_hash, contains(raw_text, 'http') AS media, epoch(ts) AS t FROM {NORMED}),
w AS (SELECT *, CASE WHEN text_hash = '' THEN message_id ELSE first_value(message_id) OVER (PARTITION BY text_hash ORDER BY t RANGE BETWEEN 14400 PRECEDING AND CURRENT ROW) END AS m FROM n)
SELECT message_id, CASE WHEN media THEN 'skip' ELSE 'single' END AS route FROM w WHERE m = message_id""")
def a3_live_posts(spark, sf_dir):
    """The intake's batch form over the whole table; a link stands for media. tests run the stream."""
    n = normed(spark, sf_dir).select("channel_id", "message_id", "ts", "text_hash", F.col("raw_text").contains("http").alias("has_media"), F.lit(None).cast("long").alias("grouped_id"))
    fresh = K.exact_duplicates(stage(n, "live")).where("matched_message_id IS NULL")
    return route(fresh).select("message_id", "route")


@query(f"""WITH cache AS (SELECT text_hash, max_by(l.quality, p.ts) AS decision, max(p.ts) AS cached_at FROM {NORMED} p JOIN labels l ON l.doc_id = p.message_id GROUP BY text_hash)
SELECT channel_id, count(*) AS posts, count(*) FILTER (hit) AS hits, count(*) FILTER (hit AND decision = 1) AS good
FROM (SELECT p.channel_id, c.decision, coalesce(epoch(p.ts) - epoch(c.cached_at) <= 86400, false) AS hit FROM {NORMED} p LEFT JOIN cache c USING (text_hash)) GROUP BY channel_id""")
def d12_decision_cache(spark, sf_dir):
    n = stage(normed(spark, sf_dir).select("channel_id", "message_id", "ts", "text_hash"), "hashes")  # the posts and the cache take the same ones
    lab = table(spark, sf_dir, "labels")
    cache = n.join(lab, n["message_id"] == lab["doc_id"]).groupBy("text_hash").agg(F.max_by("quality", "ts").alias("decision"), F.max("ts").alias("ts"))
    got = K.decision_cache(n.select("channel_id", "ts", "text_hash"), cache, 86400)
    return got.groupBy("channel_id").agg(F.count(F.lit(1)).alias("posts"), F.count_if("hit").alias("hits"), F.count_if(F.col("hit") & (F.col("decision") == 1)).alias("good"))


@query(f"""WITH p AS (SELECT message_id AS id, channel_id, text_hash, ts FROM {NORMED}), half AS (SELECT min(ts) + (max(ts) - min(ts)) / 2 AS mid FROM p),
run1 AS (SELECT p.* FROM p, half WHERE ts <= mid), known AS (SELECT text_hash, min(ts) AS decided_at FROM run1 GROUP BY text_hash),
two AS (SELECT p.channel_id, known.text_hash IS NOT NULL AND epoch(ts) - epoch(decided_at) BETWEEN 0 AND 86400 * 3 AS hit FROM p LEFT JOIN known USING (text_hash))
SELECT channel_id, count(*) AS posts, count(*) FILTER (hit) AS hits FROM two GROUP BY channel_id""")
def d12_cache_upsert(spark, sf_dir):
    """Two runs over one table of decisions: the older half of the posts, then all of them."""
    p = stage(normed(spark, sf_dir).select(F.col("message_id").alias("id"), "channel_id", "text_hash", "ts"), "hashes")
    low, high = p.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    known = K.decision_table(spark, shared_path(spark, "decisions"))
    decide = lambda rows: rows.select("id", F.when(F.substring("text_hash", 1, 1) < "8", "deliver").otherwise("digest").alias("decision"))
    half = p if low is None else p.where(F.col("ts") <= F.timestamp_micros(F.lit(low + (high - low) // 2)))
    K.decide_through_cache(half, known, "v1", "rules", 3 * 86400, decide)
    got = K.decide_through_cache(p, known, "v1", "rules", 3 * 86400, decide).join(p.select("id", "channel_id"), "id")
    return got.groupBy("channel_id").agg(F.count(F.lit(1)).alias("posts"), F.count_if("hit").alias("hits"))


@query("""WITH c AS (SELECT l_suppkey AS channel_id, count(*) AS lines FROM lineitem GROUP BY l_suppkey)
SELECT channel_id, s_name AS source_name, lines FROM c LEFT JOIN supplier ON s_suppkey = channel_id""")
def d15_hydrate_sources(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("channel_id")).agg(F.count(F.lit(1)).alias("lines")).withColumn("source_name", F.lit(""))
    dim = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("channel_id"), F.col("s_name").alias("source_name"))
    return K.hydrate_sources(rows, dim).select("channel_id", "source_name", "lines")


@query("""SELECT user_id, event_type, count(*) AS n, epoch(max(max(ts)) OVER () - min(ts))::BIGINT AS oldest_age_s FROM events GROUP BY user_id, event_type""")
def e5_job_rollup(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    now = e.agg(F.max("ts").alias("now"))
    g = e.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("oldest"))
    age = F.rint((F.unix_micros("now") - F.unix_micros("oldest")) / 1e6)
    return g.crossJoin(F.broadcast(now)).select("user_id", "event_type", "n", age.cast("long").alias("oldest_age_s"))


@query("""SELECT event_type, count(*) AS decisions, count(DISTINCT user_id) AS clusters FROM events WHERE ts >= TIMESTAMP '2024-01-08' GROUP BY event_type""")
def e6_story_rollup(spark, sf_dir):
    e = table(spark, sf_dir, "events").where(F.col("ts") >= F.lit("2024-01-08").cast("timestamp"))
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("decisions"), F.countDistinct("user_id").alias("clusters"))


@query("""WITH h AS (SELECT source AS channel_id, count(*) AS hits FROM documents JOIN labels USING (doc_id) WHERE quality = 1 GROUP BY source)
SELECT channel_id, hits, round(0.8 + hits / max(hits) OVER () * 1.2, 3) AS tier FROM h""")
def e7_corroboration(spark, sf_dir):
    p, good = posts(spark, sf_dir), table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("message_id"))
    return K.corroboration(p.join(good, "message_id"))


@query(f"SELECT channel_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS rows FROM {POSTS} GROUP BY channel_id")
def e8_batch_bounds(spark, sf_dir):
    return posts(spark, sf_dir).groupBy("channel_id").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("rows"))


@query("""SELECT event_type AS stage, count(*) AS runs, round(avg(value), 6) AS mean_ms, quantile_disc(value, 0.95) AS p95_ms FROM events GROUP BY event_type""")
def e11_stage_latency(spark, sf_dir):
    p95 = F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY value)")
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("stage")).agg(F.count(F.lit(1)).alias("runs"), F.round(F.avg("value"), 6).alias("mean_ms"), p95.alias("p95_ms"))


@query(f"""SELECT channel_id, count(*) AS posts, count(*) - count(DISTINCT text_hash) AS duplicates, round((count(*) - count(DISTINCT text_hash)) / count(*), 6) AS duplicate_rate FROM {NORMED} GROUP BY channel_id""")
def e12_corpus_report(spark, sf_dir):
    g = normed(spark, sf_dir).groupBy("channel_id").agg(F.count(F.lit(1)).alias("posts"), F.countDistinct("text_hash").alias("kinds"))
    gone = F.col("posts") - F.col("kinds")
    return g.select("channel_id", "posts", gone.alias("duplicates"), F.round(gone / F.col("posts"), 6).alias("duplicate_rate"))


@query("""SELECT date_trunc('hour', ts) AS hour, CASE WHEN event_type = 'error' THEN 'ERROR' WHEN event_type IN ('signup', 'purchase') THEN 'FLOW' ELSE 'INFO' END AS category,
  count(*) AS n, sum(CAST(json_extract(props, '$.k') AS BIGINT))::BIGINT AS k FROM events GROUP BY 1, 2""")
def e16_log_rollup(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("category", F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type").isin("signup", "purchase"), "FLOW").otherwise("INFO"))
    g = e.groupBy(F.window("ts", "1 hour").alias("w"), "category").agg(F.count(F.lit(1)).alias("n"), F.sum(F.from_json("props", "k long")["k"]).alias("k"))
    return g.select(F.col("w.start").alias("hour"), "category", "n", "k")


@query(f"""WITH r AS (SELECT channel_id, message_id, row_number() OVER (PARTITION BY channel_id ORDER BY ts, message_id) AS rn, count(*) OVER (PARTITION BY channel_id) AS n FROM {POSTS}),
k AS (SELECT *, row_number() OVER (PARTITION BY channel_id ORDER BY rn) AS k FROM r WHERE n <= 30 OR rn % greatest(1, n // 30) = 0 OR rn = 1)
SELECT channel_id, message_id, rn FROM k WHERE k <= 30""")
def f1_systematic_sample(spark, sf_dir):
    return K.systematic_sample(posts(spark, sf_dir).select("channel_id", "message_id", "ts"), 30, ["ts", "message_id"], ["channel_id"]).select("channel_id", "message_id", "rn")


@query("""WITH s AS (SELECT user_id, event_type, event_id, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, ts DESC, event_id) AS s FROM events WHERE value > 0),
r AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM s WHERE s <= 3)
SELECT * FROM r WHERE rank <= 6""")
def f2_top_k_with_source_cap(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("score", F.col("value"))
    within = [F.desc("score"), F.desc("ts"), F.asc("event_id")]
    return K.top_k_with_cap(e, "user_id", "event_type", [F.desc("score"), F.asc("event_id")], within=within).select("user_id", "event_type", "event_id", "rank")


@query(f"""SELECT sha1(norm) AS text_id, max(ts) AS last_seen FROM {NORMED} WHERE len(norm) >= 12 GROUP BY norm ORDER BY last_seen DESC, norm LIMIT 500""")
def f5_keep_latest_n(spark, sf_dir):
    t = normed(spark, sf_dir).select(F.col("norm").alias("text_norm"), "ts")
    return K.keep_latest_n(t, 500).select(F.sha1(F.col("text_norm").cast("binary")).alias("text_id"), "last_seen")


@query("""WITH r AS (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY floor(epoch(ts))::BIGINT RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS recent FROM events WHERE event_type = 'error')
SELECT event_id, recent, CASE WHEN recent > 3 THEN 'degraded' WHEN recent > 0 THEN 'warm' ELSE 'healthy' END AS status, CASE WHEN recent > 3 THEN 0.5 WHEN recent > 0 THEN 0.75 ELSE 1.0 END::DOUBLE AS batch_scale FROM r""")
def f6_trailing_rate(spark, sf_dir):
    return K.trailing_rate(table(spark, sf_dir, "events").where("event_type = 'error'"), "user_id").select("event_id", "recent", "status", "batch_scale")


@query("SELECT event_id, value FROM events WHERE event_type = 'error' ORDER BY value DESC, ts, event_id LIMIT 100")
def g1_priority_top_k(spark, sf_dir):
    return table(spark, sf_dir, "events").where("event_type = 'error'").orderBy(F.desc("value"), "ts", "event_id").limit(100).select("event_id", "value")


@query("""WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id, event_id, CASE WHEN rank <= 12 THEN 'highlights' ELSE 'also_moving' END AS section, CASE WHEN rank <= 12 THEN rank ELSE rank - 12 END AS pos
FROM r WHERE rank <= 12 + greatest(1, least(3, n // 3))""")
def g2_cap_lists(spark, sf_dir):
    w = Window.partitionBy("user_id")
    r = table(spark, sf_dir, "events").withColumns({"rank": F.row_number().over(w.orderBy(F.desc("value"), "event_id")), "n": F.count(F.lit(1)).over(w)})
    r = r.where(F.col("rank") <= 12 + F.greatest(F.lit(1), F.least(F.lit(3), F.floor(F.col("n") / 3))))
    main = F.col("rank") <= 12
    return r.select("user_id", "event_id", F.when(main, "highlights").otherwise("also_moving").alias("section"), F.when(main, F.col("rank")).otherwise(F.col("rank") - 12).alias("pos"))


@query(f"""WITH a AS (SELECT sha1(text) AS identity, false AS is_web, 0 AS part, text FROM documents UNION ALL SELECT sha1(text), true, 1, text FROM benchmark)
SELECT identity, min(is_web) AS is_web, count(*) AS copies FROM a GROUP BY identity""".replace("count(*) AS copies", "any_value(len(text)) AS chars"))
def h1_merge_evidence(spark, sf_dir):
    p = posts(spark, sf_dir).select(F.lit("").alias("link"), F.col("raw_text").alias("text"), F.lit(False).alias("is_web"), "ts")
    b = table(spark, sf_dir, "benchmark").select(F.lit("").alias("link"), "text", F.lit(True).alias("is_web"), F.lit(None).cast("timestamp").alias("ts"))
    return K.merge_evidence([p, b]).select("identity", "is_web", F.length("text").alias("chars"))


@query("""SELECT doc_id, len(string_split(text, chr(10))) AS lines, len(list_distinct(string_split(text, chr(10)))) AS kept FROM documents""")
def h2_ordered_distinct(spark, sf_dir):
    lines = F.split("text", "\n", -1)
    return table(spark, sf_dir, "documents").select("doc_id", F.size(lines).alias("lines"), F.size(F.array_distinct(lines)).alias("kept"))


@query(f"""SELECT channel_id, date_trunc('minute', ts) - to_minutes(((epoch(ts) - 1)::BIGINT % 1800 + 1)::BIGINT // 60) + INTERVAL 30 MINUTE AS window_end, count(*) AS posts FROM {POSTS} GROUP BY 1, 2""")
def i1_tumbling_digest(spark, sf_dir):
    from newsmill.streaming.windows import tumbling

    return tumbling(posts(spark, sf_dir), ["channel_id"]).select("channel_id", "window_end", "posts")


@query("""WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS first FROM events),
g AS (SELECT user_id, ts, sum(first) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM s)
SELECT user_id, min(ts) AS started, max(ts) AS last, count(*) AS parts FROM g GROUP BY user_id, g""")
def i8_album_sessions(spark, sf_dir):
    from newsmill.streaming.windows import albums

    return albums(table(spark, sf_dir, "events"), ["user_id"], "event_id", "30 minutes").select("user_id", "started", "last", "parts")


@query("""WITH h AS (SELECT source AS channel_id, count(*) AS h0 FROM documents GROUP BY source),
a AS (SELECT *, round(h0 * 0.85) AS h1 FROM h), b AS (SELECT *, round(h1 * 0.85) AS h2 FROM a), c AS (SELECT *, round(h2 * 0.85) AS h3 FROM b)
SELECT channel_id, h3::BIGINT AS hits FROM c""")
def i11_periodic_decay(spark, sf_dir):
    return K.decay(posts(spark, sf_dir).groupBy("channel_id").agg(F.count(F.lit(1)).alias("hits")), 3)


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id AS id, floor(epoch(ts))::BIGINT AS t, row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch(ts))::BIGINT, event_id) AS n FROM events),
g(user_id, n, id, ok, last) AS (SELECT user_id, n, id, true, t FROM e WHERE n = 1
  UNION ALL SELECT e.user_id, e.n, e.id, e.t - last >= 7200, CASE WHEN e.t - last >= 7200 THEN e.t ELSE last END FROM g JOIN e ON e.user_id = g.user_id AND e.n = g.n + 1)
SELECT id, ok AS accepted FROM g""")
def f9_accepted_requests(spark, sf_dir):
    """An accepted request in two hours, as users of the table are silent for long."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "user_id", "ts")
    return K.accepted_requests(e, "user_id", 7200).select("id", "accepted")


@query("""WITH s AS (SELECT user_id, event_type, event_id, value - 30 AS score, ts FROM events),
c AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY score DESC, event_id) AS s FROM s WHERE score > 0),
b AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, event_id) AS rank FROM c WHERE s <= 3),
n AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, score DESC, event_id) AS rank FROM s WHERE user_id NOT IN (SELECT user_id FROM b))
SELECT * FROM b WHERE rank <= 6 UNION ALL SELECT * FROM n WHERE rank <= 6""")
def f2_top_k_or_newest(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("score", F.col("value") - 30)
    return K.top_k_or_newest(e, "user_id", "event_type", [F.desc("score"), F.asc("event_id")]).select("user_id", "event_id", "rank")


@query(f"""WITH r AS (SELECT CASE WHEN message_id % 3 = 0 THEN 'HTTP://x/' || (message_id % 400) ELSE '' END AS link, CASE WHEN message_id % 5 = 0 THEN '' ELSE raw_text END AS text, channel_id AS source, ts, message_id % 2 = 1 AS is_web, 0 AS part FROM {POSTS}
  UNION ALL SELECT '', text, 'benchmark', NULL, true, 1 FROM benchmark),
i AS (SELECT *, CASE WHEN link <> '' THEN 'link:' || lower(link) WHEN {squeeze("text")} <> '' THEN 'text:' || sha1(lower({squeeze("text")})) ELSE 'meta:' || source || '|' || coalesce(epoch(ts)::BIGINT::VARCHAR, '') END AS identity FROM r),
b AS (SELECT *, row_number() OVER (PARTITION BY identity ORDER BY is_web, part, ts NULLS FIRST, source, text) AS k FROM i)
SELECT identity, is_web, source, ts FROM b WHERE k = 1 ORDER BY ts DESC NULLS LAST, identity LIMIT 500""")
def h1_newest_evidence(spark, sf_dir):
    """The newest 500 rows are what the operator is for."""
    p = posts(spark, sf_dir)
    m = F.col("message_id")
    one = p.select(F.when(m % 3 == 0, F.concat(F.lit("HTTP://x/"), (m % 400).cast("string"))).otherwise("").alias("link"), F.when(m % 5 == 0, "").otherwise(F.col("raw_text")).alias("text"), F.col("channel_id").alias("source"), "ts", (m % 2 == 1).alias("is_web"))
    two = table(spark, sf_dir, "benchmark").select(F.lit("").alias("link"), "text", F.lit("benchmark").alias("source"), F.lit(None).cast("timestamp").alias("ts"), F.lit(True).alias("is_web"))
    return K.merged_evidence([one, two], 500).select("identity", "is_web", "source", "ts")


@query(f"""WITH p AS (SELECT text_hash, len(raw_text) / 10.0 AS took_ms, row_number() OVER (PARTITION BY text_hash ORDER BY ts, message_id) > 1 AS hit FROM {NORMED})
SELECT count(*) AS messages, count(*) - count(DISTINCT text_hash) AS duplicates, round((count(*) - count(DISTINCT text_hash)) / greatest(count(*), 1), 4) AS duplicate_rate, count(*) FILTER (NOT hit) AS calls,
  round(100 * count(*) FILTER (NOT hit) / greatest(count(*), 1), 2) AS calls_per_100, round(avg(took_ms), 4) AS mean_ms, quantile_disc(took_ms, 0.95)::DOUBLE AS p95_ms, round(count(*) FILTER (hit) / greatest(count(*), 1), 4) AS cache_hit_rate FROM p""")
def e12_pipeline_report(spark, sf_dir):
    """A text's first post is a call, the others are hits; the length of a text stands for the time that it took."""
    first = F.row_number().over(Window.partitionBy("text_hash").orderBy("ts", "message_id")) > 1
    return K.pipeline_report(normed(spark, sf_dir).select("text_hash", (F.length("raw_text") / 10.0).alias("took_ms"), first.alias("hit")))


@query("""SELECT user_id, event_id AS id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank FROM events WHERE event_type = 'error' QUALIFY rank <= 5""")
def e5_newest_failures(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "user_id", "ts", "event_type")
    return K.newest_failures(e, "user_id", F.col("event_type") == "error").select("user_id", "id", "ts", "rank")
