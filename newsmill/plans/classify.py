"""Classification queries. The rules speak of words of the given corpus, as its prose is invented."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsmill.functions import text as T
from newsmill.functions import vocab as V
from newsmill.operators import keyed as K
from newsmill.operators import rules as R
from newsmill.plans.base import NORMED, POSTS, quoted, registry, squeeze
from newsmill.sources.views import posts, table

QUERIES, ORACLES = {}, {}
query = registry(QUERIES, ORACLES)

#: Our own rules: category, field, phrase.
RULES = [
    ("north", "primary", "thor"), ("north", "alias", "inti"), ("north", "event", "ouble"), ("north", "target", "thre"), ("north", "blocked", "ntble"),
    ("south", "primary", "of the"), ("south", "required", "edst"), ("south", "actor", "ther"), ("south", "action", "ering"),
    ("coast", "primary", "de la"), ("coast", "alias", "los"), ("coast", "event", "ouleou"), ("coast", "negative", "et au"),
    ("hills", "event", "thereand"), ("hills", "action", "hand"), ("hills", "target", "wither"), ("hills", "actor", "andre"), ("hills", "alias", "der die"),
    ("*", "recency", "erin"), ("*", "official", "onand"), ("*", "negative", "oning"), ("*", "hedge", "anthe"),
]
CATEGORIES = [("north", "North", 5, True, "high", 0), ("south", "South", 3, False, "medium", 1), ("coast", "Coast", 4, True, "low", 2), ("hills", "Hills", 1, True, "medium", 3)]
TIERS = [("src1", "S"), ("src0", "A"), ("src5", "B")]
HARD, SOFT, INFLAMMATORY = ["shtion ouble"], ["thor", "inti", "ouble"], ["edst er"]


def _rules(spark):
    return R.rule_table(spark, RULES)


def _hits(spark, sf_dir):
    return R.rule_hits(posts(spark, sf_dir), _rules(spark))


def _categories(spark):
    return spark.createDataFrame(CATEGORIES, "category string, label string, priority int, breaking boolean, bias string, file_order int")


_VARIANTS = ", ".join(f"('{c}', '{f}', '{p}', '{v}')" for c, f, p in RULES for v in R.variants(p))
_HITS = f"""v(category, field, phrase, variant) AS (VALUES {_VARIANTS}),
p AS (SELECT message_id AS id, trim(regexp_replace(regexp_replace(lower(raw_text), '[()\\[\\]{{}}|]', ' ', 'g'), '\\s+', ' ', 'g')) AS t FROM {POSTS}),
raw AS (SELECT DISTINCT id, category, field, phrase FROM p, v WHERE contains(t, variant) AND regexp_matches(t, '(^|[^a-z0-9])' || variant || '([^a-z0-9]|$)')),
hits AS (SELECT * FROM raw WHERE field <> 'blocked' AND NOT EXISTS (SELECT 1 FROM raw AS b WHERE b.id = raw.id AND b.category = raw.category AND b.field = 'blocked'))"""
_FIELDS = [f for f in R.FIELDS if f != "blocked"]
_SCORES = f"""{_HITS},
per AS (SELECT id, category, {', '.join(f"count(*) FILTER (field = '{f}') AS n_{f}" for f in _FIELDS)}, coalesce(max(len(phrase)) FILTER (field = 'primary'), 0) AS longest FROM hits GROUP BY id, category),
fr AS (SELECT id, n_recency AS fr, n_official AS fo, n_negative AS fn, n_hedge AS fh FROM per WHERE category = '*'),
j AS (SELECT per.*, coalesce(fr, 0) AS fr, coalesce(fo, 0) AS fo, coalesce(fn, 0) AS fn, coalesce(fh, 0) AS fh, n_negative + coalesce(fn, 0) AS bad FROM per LEFT JOIN fr USING (id) WHERE category <> '*'),
s AS (SELECT *, 3.0 * n_primary + 2.0 * n_alias + least(n_required, 1) + 0.75 * least(n_event, 2) + 0.75 * least(n_action, 2) + 0.5 * least(n_actor, 2) + 0.5 * least(n_target, 2)
  + 0.4 * (n_recency + fr > 0)::INT + 0.4 * (n_official + fo > 0)::INT - CASE WHEN bad > 0 AND n_primary = 0 THEN least(1.25, 0.5 * bad) ELSE 0 END - CASE WHEN fh > 0 AND n_primary = 0 THEN 0.2 ELSE 0 END AS base FROM j),
r AS (SELECT *, base < 3.0 AND n_action + n_event > 0 AND (n_target + n_actor > 0 OR (n_event > 0 AND fr + fo > 0)) AND bad = 0 AS rescued FROM s),
scores AS (SELECT *, round(CASE WHEN rescued THEN 3.0 + least(1.25, 0.5 * n_action + 0.5 * n_event + 0.25 * n_target) ELSE base END::DOUBLE, 4) AS score FROM r WHERE base >= 3.0 OR rescued)"""


@query(f"WITH {_HITS} SELECT * FROM hits")
def d7_rule_hits(spark, sf_dir):
    return _hits(spark, sf_dir)


@query(f"WITH {_SCORES} SELECT id, category, score, rescued FROM scores")
def e1_category_scores(spark, sf_dir):
    return R.category_scores(_hits(spark, sf_dir)).select("id", "category", "score", "rescued")


_CATS = ", ".join(f"('{a}', '{b}', {c}, {str(d).lower()}, '{e}', {f})" for a, b, c, d, e, f in CATEGORIES)


@query(f"""WITH {_SCORES}, c(category, label, priority, breaking, bias, file_order) AS (VALUES {_CATS}),
k AS (SELECT scores.*, label, row_number() OVER (PARTITION BY id ORDER BY score DESC, longest DESC, priority DESC, n_primary DESC, file_order) AS rank FROM scores JOIN c USING (category))
SELECT id, min_by(category, rank) AS category, min_by(label, rank) AS label, string_agg(category, ',' ORDER BY rank) AS top_keys FROM k WHERE rank <= 6 GROUP BY id""")
def f3_top_category(spark, sf_dir):
    return R.top_category(R.category_scores(_hits(spark, sf_dir)), _categories(spark)).select("id", "category", "label", "top_keys")


@query(f"""WITH {_SCORES}, c(category, label, priority, breaking, bias, file_order) AS (VALUES {_CATS}),
k AS (SELECT id, label, row_number() OVER (PARTITION BY id ORDER BY score DESC, longest DESC, priority DESC, n_primary DESC, file_order) AS rank FROM scores JOIN c USING (category))
SELECT message_id AS id, coalesce(label, 'Update') AS label FROM {POSTS} LEFT JOIN (SELECT * FROM k WHERE rank = 1) ON id = message_id""")
def c12_label_posts(spark, sf_dir):
    top = R.top_category(R.category_scores(_hits(spark, sf_dir)), _categories(spark))
    return posts(spark, sf_dir).select(F.col("message_id").alias("id")).join(top, "id", "left").select("id", F.coalesce("label", F.lit("Update")).alias("label"))


def _signals(spark, sf_dir):
    hits = _hits(spark, sf_dir)
    top = R.top_category(R.category_scores(hits), _categories(spark))
    return R.story_signals(hits, top, posts(spark, sf_dir)), top


_WORDS = ", ".join(f"'{k}': '{v}'" for k, v in V.NUMBER_WORDS.items())
_SIGNALS = f"""{_SCORES}, c(category, label, priority, breaking, bias, file_order) AS (VALUES {_CATS}),
top AS (SELECT * FROM (SELECT id, category, breaking, row_number() OVER (PARTITION BY id ORDER BY score DESC, longest DESC, priority DESC, n_primary DESC, file_order) AS rank FROM scores JOIN c USING (category)) WHERE rank = 1),
frame AS (SELECT id, {', '.join(f"count(DISTINCT phrase) FILTER (field = '{f}') AS {f}" for f in ('action', 'target'))}, {', '.join(f"count(DISTINCT phrase) FILTER (field = '{f}' AND category = '*') AS {f}" for f in ('recency', 'official', 'negative', 'hedge'))} FROM hits GROUP BY id),
t AS (SELECT message_id AS id, {squeeze("raw_text")} AS text, len(list_distinct(list_concat(regexp_extract_all(lower(raw_text), '[0-9]+'), list_transform(list_filter(regexp_extract_all(lower(raw_text), '[a-z]+'), lambda w: w IN ({quoted(V.NUMBER_WORDS)})), lambda w: map {{{_WORDS}}}[w])))) AS counts FROM {POSTS}),
f0 AS (SELECT t.id, category, coalesce(breaking, false) AS breaking, counts, text, {', '.join(f"coalesce({f}, 0) AS {f}" for f in ('action', 'target', 'recency', 'official', 'negative', 'hedge'))} FROM t LEFT JOIN frame USING (id) LEFT JOIN top USING (id)),
f1 AS (SELECT *, round(greatest(0.0::DOUBLE, least(1.2::DOUBLE, 0.35::DOUBLE * action) + least(0.8::DOUBLE, 0.2::DOUBLE * target) + least(0.5::DOUBLE, 0.15::DOUBLE * least(counts, 8)) + least(1.0::DOUBLE, 0.45::DOUBLE * recency) + least(1.0::DOUBLE, 0.4::DOUBLE * official) + CASE WHEN breaking THEN 0.35::DOUBLE ELSE 0.0::DOUBLE END - least(2.0::DOUBLE, 0.65::DOUBLE * negative) - least(0.5::DOUBLE, 0.2::DOUBLE * hedge)), 4) AS live_event_score,
  regexp_matches(text, '(?i)^(what|why|how|who|when|where|is|are|can|will)\\b') AS question_led, category IS NOT NULL OR action + target + counts > 0 AS concrete_event, official > 0 AND hedge = 0 AS official_development FROM f0),
f2 AS (SELECT *, negative > 0 OR question_led AS explainer_like, (negative > 0 OR question_led) AND NOT (official_development OR (breaking AND recency > 0 AND concrete_event)) AS downgrade_explainer FROM f1),
sig AS (SELECT *, (live_event_score >= 1.6 OR (concrete_event AND (official_development OR recency > 0) AND least(2.0::DOUBLE, 0.65::DOUBLE * negative) < 0.8)) AND NOT downgrade_explainer AS live_event_update FROM f2)"""


@query(f"WITH {_SIGNALS} SELECT id, category, breaking, action, target, recency, official, negative, hedge, live_event_score, question_led, concrete_event, official_development, explainer_like, downgrade_explainer, live_event_update FROM sig")
def e2_story_signals(spark, sf_dir):
    return _signals(spark, sf_dir)[0]


#: Our own keywords of breaking news, over the corpus vocabulary.
KEYWORDS = ["thor", "inti ", "ouble.", "PORTH"]


@query(f"""WITH {_SIGNALS}, k AS (SELECT *, {' + '.join(f"contains(lower(text), '{k.strip().lower()}')::INT" for k in KEYWORDS)} AS keyword_hits FROM sig)
SELECT id, keyword_hits, live_event_update AND NOT downgrade_explainer AND (breaking OR keyword_hits >= 2) AS admitted FROM k""")
def b12_breaking_gate(spark, sf_dir):
    return R.breaking_gate(_signals(spark, sf_dir)[0], posts(spark, sf_dir), KEYWORDS, 2)


@query(f"""WITH {_SIGNALS}, w AS (SELECT sig.*, time_bucket(INTERVAL 6 HOUR, ts) + INTERVAL 6 HOUR AS window_end FROM sig JOIN {POSTS} AS d ON d.message_id = sig.id)
SELECT window_end, count(*) AS posts, round(avg((category IS NULL)::INT), 6) AS fallback_rate, round(avg((category IS NULL)::INT) FILTER (concrete_event), 6) AS unmatched_rate FROM w GROUP BY window_end""")
def e14_taxonomy_health(spark, sf_dir):
    s = _signals(spark, sf_dir)[0].join(posts(spark, sf_dir).select(F.col("message_id").alias("id"), "ts"), "id")
    live = F.col("concrete_event")
    return s.groupBy(F.window("ts", "6 hours").alias("w")).agg(F.count(F.lit(1)).alias("posts"), F.round(F.avg(F.col("category").isNull().cast("int")), 6).alias("fallback_rate"), F.round(F.avg(F.when(live, F.col("category").isNull().cast("int"))), 6).alias("unmatched_rate")).select(F.col("w.end").alias("window_end"), "posts", "fallback_rate", "unmatched_rate")


#: Tokens that posts without a category have, by windows of six hours.
_UNMATCHED = f"""{_SCORES}, tok AS (SELECT time_bucket(INTERVAL 6 HOUR, ts) + INTERVAL 6 HOUR AS window_end, unnest(list_filter(regexp_extract_all(lower(raw_text), '[a-z0-9]{{4,}}'), lambda w: w NOT IN ({quoted(V.DUPE_STOP_WORDS)}))) AS token
  FROM {POSTS} WHERE message_id NOT IN (SELECT id FROM scores)),
n AS (SELECT window_end, token, count(*) AS n FROM tok GROUP BY ALL)"""


def _unmatched(spark, sf_dir):
    found = R.category_scores(_hits(spark, sf_dir)).select(F.col("id").alias("message_id")).distinct()
    words = F.filter(F.regexp_extract_all(F.lower("raw_text"), F.lit("[a-z0-9]{4,}"), F.lit(0)), lambda w: ~w.isin(V.DUPE_STOP_WORDS))
    p = posts(spark, sf_dir).join(found, "message_id", "left_anti")
    return p.select(F.window("ts", "6 hours").getField("end").alias("window_end"), F.explode(words).alias("token"))


@query(f"""WITH {_UNMATCHED} SELECT window_end, rank, token, n FROM (SELECT *, row_number() OVER (PARTITION BY window_end ORDER BY n DESC, token) AS rank FROM n) WHERE rank <= 8""")
def e14_unmatched_tokens(spark, sf_dir):
    return K.top_tokens(_unmatched(spark, sf_dir), "window_end", "token", 8)


@query()
def e14_token_sketch(spark, sf_dir):
    """Sketches of six hours each, merged into days; counts are estimates within error."""
    sketches = K.token_sketches(_unmatched(spark, sf_dir), "window_end", "token")
    days = K.merged_top(sketches, [F.date_trunc("day", F.col("window_end") - F.expr("interval 1 second")).alias("day")], 8)
    return days.select("day", "tokens", "error", F.posexplode("top").alias("pos", "t")).select("day", (F.col("pos") + 1).alias("rank"), F.col("t.item").alias("token"), F.col("t.count").alias("n"), "tokens", "error")


def _count(t):
    return f"(len(regexp_extract_all(' ' || regexp_replace(t, ' ', '  ', 'g') || ' ', '[^a-z0-9]{t.replace(' ', '  ')}[^a-z0-9]')))"


@query(f"""WITH p AS (SELECT message_id AS id, regexp_replace(translate(lower(trim(regexp_replace(raw_text, '\\s+', ' ', 'g'))), '@43!1|0$57#', 'aaeiiiossti'), '[^a-z0-9\\s]+', ' ', 'g') AS t FROM {POSTS}),
c AS (SELECT id, {' + '.join(_count(t) for t in SOFT)} + 2 * ({' + '.join(f'({_count(t)} > 0)::INT' for t in INFLAMMATORY)}) AS frequency, {' + '.join(f'({_count(t)} > 0)::INT' for t in HARD)} AS hard FROM p)
SELECT id, frequency, hard > 0 AS hard_blocked FROM c""")
def e3_moderation(spark, sf_dir):
    return R.moderation(posts(spark, sf_dir), HARD, SOFT, INFLAMMATORY).select("id", "frequency", "hard_blocked")


@query(f"""WITH t(name, tier) AS (VALUES {', '.join(f"('{a}', '{b}')" for a, b in TIERS)}), s AS (SELECT DISTINCT source AS source_name FROM documents)
SELECT source_name, coalesce(min_by(tier, instr('SABC', tier)), 'C') AS tier FROM s LEFT JOIN t ON contains(lower(source_name), name) GROUP BY source_name""")
def d13_source_tiers(spark, sf_dir):
    return R.source_tiers(posts(spark, sf_dir), spark.createDataFrame(TIERS, "name string, tier string")).select("source_name", "tier")


def _severity(spark, sf_dir):
    p = posts(spark, sf_dir)
    signals, top = _signals(spark, sf_dir)
    tiers = R.source_tiers(p, spark.createDataFrame(TIERS, "name string, tier string"))
    return R.severity(p, signals, top, tiers, R.moderation(p, HARD, SOFT, INFLAMMATORY))


@query()
def e4_severity(spark, sf_dir):
    s = _severity(spark, sf_dir)
    return s.select("id", "severity", "raw_score", F.round(R.calibrate(F.col("raw_score"), F.col("severity")), 4).alias("final_score"))


#: Our own label rules in order: label, phrase.
LABELS = [("Alarm", "shtion ouble"), ("Storm", "thor"), ("Harbour", "of the"), ("Storm", "inti"), ("Coast", "de la")]
_LABELS = ", ".join(f"({i}, '{label}', '{v}')" for i, (label, phrase) in enumerate(LABELS) for v in R.variants(phrase))
_LEVEL = "CASE WHEN len(raw_text) % 7 = 0 THEN 'high' WHEN len(raw_text) % 7 < 3 THEN 'medium' ELSE 'low' END"


def _level():
    """A severity by the length of the text, which SQL can state as well."""
    n = F.length("raw_text") % 7
    return F.when(n == 0, "high").when(n < 3, "medium").otherwise("low")


@query(f"""WITH {_SCORES}, c(category, label, priority, breaking, bias, file_order) AS (VALUES {_CATS}),
k AS (SELECT id, label, row_number() OVER (PARTITION BY id ORDER BY score DESC, longest DESC, priority DESC, n_primary DESC, file_order) AS rank FROM scores JOIN c USING (category)),
lr(rule_order, label, variant) AS (VALUES {_LABELS}),
ru AS (SELECT id, min_by(label, rule_order) AS ruled FROM p, lr WHERE contains(t, variant) AND regexp_matches(t, '(^|[^a-z0-9])' || variant || '([^a-z0-9]|$)') GROUP BY id),
e AS (SELECT DISTINCT id FROM hits WHERE field = 'negative')
SELECT message_id AS id, CASE WHEN e.id IS NULL AND ruled IS NOT NULL THEN ruled WHEN e.id IS NULL AND k.label IS NOT NULL THEN k.label ELSE CASE {_LEVEL} WHEN 'high' THEN 'Breaking' WHEN 'medium' THEN 'Live update' ELSE 'News update' END END AS label,
  CASE WHEN e.id IS NULL AND ruled IS NOT NULL THEN 'rule' WHEN e.id IS NULL AND k.label IS NOT NULL THEN 'category' ELSE 'generic' END AS origin
FROM {POSTS} LEFT JOIN ru ON ru.id = message_id LEFT JOIN (SELECT * FROM k WHERE rank = 1) AS k ON k.id = message_id LEFT JOIN e ON e.id = message_id""")
def c12_ordered_labels(spark, sf_dir):
    """Posts with a phrase against them stand for explainers."""
    p, hits = posts(spark, sf_dir), _hits(spark, sf_dir)
    top = R.top_category(R.category_scores(hits), _categories(spark))
    calm = hits.where("field = 'negative'").select("id").distinct()
    return R.label_posts(p, R.label_table(spark, LABELS), top, p.select(F.col("message_id").alias("id"), _level().alias("severity")), calm)


def _routed(spark, sf_dir, digest_mode=False):
    p = posts(spark, sf_dir)
    hits = _hits(spark, sf_dir).where("field = 'negative'").select("id", F.lit(True).alias("explainer")).distinct()
    rows = p.select(F.col("message_id").alias("id"), "raw_text", F.col("raw_text").contains("http").alias("has_media"), _level().alias("severity"))
    rows = rows.join(R.moderation(p, HARD, SOFT, INFLAMMATORY).select("id", "frequency", "hard_blocked"), "id").join(hits, "id", "left").fillna(False, ["explainer"])
    return R.route_posts(rows, digest_mode)


_SPAMMY = " + ".join(f"contains(low, '{t}')::INT" for t in V.SPAM_TERMS)
_CLEAN = squeeze("coalesce(raw_text, '')")
_ROUTE = f"""WITH {_HITS}, m AS (SELECT message_id AS id, regexp_replace(translate(lower(trim(regexp_replace(raw_text, '\\s+', ' ', 'g'))), '@43!1|0$57#', 'aaeiiiossti'), '[^a-z0-9\\s]+', ' ', 'g') AS t FROM {POSTS}),
mod AS (SELECT id, {' + '.join(_count(t) for t in SOFT)} + 2 * ({' + '.join(f'({_count(t)} > 0)::INT' for t in INFLAMMATORY)}) AS frequency, {' + '.join(f'({_count(t)} > 0)::INT' for t in HARD)} > 0 AS hard FROM m),
e AS (SELECT DISTINCT id FROM hits WHERE field = 'negative'),
x AS (SELECT n.message_id AS id, {_CLEAN} AS txt, lower({_CLEAN}) AS low, contains(raw_text, 'http') AS media, len(norm) >= 12 AS said, {_LEVEL} AS sev, frequency, hard, e.id IS NOT NULL AS expl
  FROM {NORMED} AS n JOIN mod ON mod.id = message_id LEFT JOIN e ON e.id = message_id),
y AS (SELECT *, ({_SPAMMY}) AS terms, len(regexp_extract_all(low, 'http://|https://|t\\.me/')) AS links, len(regexp_extract_all(low, '#[a-z0-9_]+')) AS tags FROM x),
z AS (SELECT *, CASE WHEN txt = '' THEN 'empty' WHEN coalesce(media, false) THEN 'has_media' WHEN hard THEN 'moderation_block' WHEN terms >= 2 OR (terms >= 1 AND links >= 1) OR tags >= 12 THEN 'likely_noise' END AS skip FROM y),
l AS (SELECT *, CASE WHEN skip IS NOT NULL THEN 'low' WHEN expl THEN CASE WHEN said THEN 'medium' ELSE 'low' END WHEN sev = 'low' AND frequency >= 2 THEN 'medium' ELSE sev END AS level FROM z),
a AS (SELECT *, CASE WHEN skip IS NOT NULL THEN 'skip' WHEN expl THEN CASE WHEN said THEN 'digest' ELSE 'skip' END WHEN level = 'high' THEN 'deliver' ELSE 'digest' END AS action FROM l)
SELECT id, action, level AS severity, CASE WHEN skip IS NOT NULL THEN skip WHEN expl THEN 'explainer' WHEN action = 'deliver' THEN 'high_severity' ELSE 'routine' END AS reason,
  CASE WHEN skip IS NOT NULL THEN 0.2 WHEN said THEN 0.55 ELSE 0.35 END::DOUBLE AS confidence, CASE level WHEN 'high' THEN 10 WHEN 'medium' THEN 50 ELSE 80 END::BIGINT AS priority FROM a"""


@query(_ROUTE)
def b3_route_posts(spark, sf_dir):
    """A link stands for media, the text's length for severity, a phrase against a category for an explainer."""
    return _routed(spark, sf_dir)


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id AS id, floor(epoch(ts))::BIGINT AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE value > 20),
g(user_id, n, id, ok, granted) AS (
  SELECT user_id, n, id, true, [t] FROM e WHERE n = 1
  UNION ALL
  SELECT e.user_id, e.n, e.id, len(list_filter(granted, lambda x: e.t - x <= 3600)) < 3,
    CASE WHEN len(list_filter(granted, lambda x: e.t - x <= 3600)) < 3 THEN list_append(list_filter(granted, lambda x: e.t - x <= 3600), e.t) ELSE list_filter(granted, lambda x: e.t - x <= 3600) END
  FROM g JOIN e ON e.user_id = g.user_id AND e.n = g.n + 1)
SELECT events.event_id AS id, CASE WHEN value <= 20 THEN 'low' WHEN ok THEN 'high' ELSE 'medium' END AS severity FROM events LEFT JOIN g ON g.id = events.event_id""")
def i6_source_cooldown(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "user_id", "ts", F.when(F.col("value") > 20, "high").otherwise("low").alias("severity"))
    return R.cooldown(e, "user_id").select("id", "severity")
