"""Queries over attributions, with their oracles; words of the corpus stand for labels and verbs."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsmill.operators import attribution as A
from newsmill.plans.base import POSTS, quoted, registry, squeeze
from newsmill.sources.views import posts

QUERIES, ORACLES = {}, {}
query = registry(QUERIES, ORACLES)
LABELS = {"src0": ("The", "Der", "And", "Of", "In"), "src1": ("la", "was", "to")}
WORDING = A.Wording(verbs=("of", "de", "and", "to"), opening="the", kinds=("and", "was", "der"), early=("ouble", "thor"), hedges=("is", "que", "und"))

_ANY = "|".join
_CLAUSE = f"(?i),? ?\\b{WORDING.opening} [^.,;:]{{0,80}}?\\b(?:{_ANY(WORDING.kinds)})\\b[,:]? ?"
_OF = f"(?is)^(?:({_ANY(WORDING.early)}) (?:[a-z-]+ )?|there (?:are|were) )?reports? of (.+)$"
_KNOWN = "CASE channel_id " + " ".join(f"WHEN '{c}' THEN [{quoted([x.lower() for x in ls])}]" for c, ls in LABELS.items()) + " ELSE [] END"


def _led(pattern, before, after):
    label, rest = (f"regexp_extract(t, '{pattern}', {i})" for i in (1, 2))
    fits = f"{label} <> '' AND list_contains({_KNOWN}, lower(trim({label})))"
    return f"{after} AS (SELECT * REPLACE (CASE WHEN {fits} THEN trim({rest}) ELSE t END AS t, CASE WHEN {fits} THEN cut + 1 ELSE cut END AS cut) FROM {before})"


_CLEANED = f"""b AS (SELECT message_id, channel_id, ts, string_split(regexp_replace(regexp_replace(regexp_replace(coalesce(raw_text, ''), '<[^>]+>', ' ', 'g'), '(?i)https?://\\S+|t\\.me/\\S+', ' ', 'g'), '@[A-Za-z0-9_]+', ' ', 'g'), chr(10)) AS raw FROM {POSTS}),
c AS (SELECT message_id, channel_id, ts, list_filter(list_transform(raw, lambda t: {squeeze("t")}), lambda t: t <> '') AS ls FROM b),
l AS (SELECT *, list_transform(ls, lambda t: lower(t)) AS low FROM c),
k AS (SELECT message_id, channel_id, list_filter(ls, lambda t, i: list_position(low, lower(t)) = i) AS kept FROM l),
s0 AS (SELECT message_id, channel_id, unnest(kept) AS t, generate_subscripts(kept, 1) AS place, 0 AS cut FROM k),
{_led("(?s)^([^:|]{1,60}?) ?[:|] (.+)$", "s0", "s1")},
{_led(f"(?is)^(.{{1,60}}?) (?:{_ANY(WORDING.verbs)}) (?:that )?(.+)$", "s1", "s2")},
s3 AS (SELECT * REPLACE (CASE WHEN regexp_matches(t, '{_CLAUSE}') THEN {squeeze(f"regexp_replace(t, '{_CLAUSE}', ' ', 'g')")} ELSE t END AS t, cut + len(regexp_extract_all(t, '{_CLAUSE}')) AS cut) FROM s2),
s4 AS (SELECT * REPLACE (CASE WHEN regexp_matches(t, '{_OF}') THEN CASE WHEN regexp_extract(t, '{_OF}', 1) = '' THEN 'Reports' ELSE upper(regexp_extract(t, '{_OF}', 1)[1]) || lower(regexp_extract(t, '{_OF}', 1)[2:]) || ' reports' END || ' indicate ' || regexp_extract(t, '{_OF}', 2) ELSE t END AS t) FROM s3),
s5 AS (SELECT * REPLACE (CASE WHEN cut > 0 AND t <> '' AND NOT regexp_matches(t, '(?i)\\b(?:{_ANY(WORDING.hedges)})\\b') THEN 'Initial reports indicate ' || t ELSE t END AS t) FROM s4),
o AS (SELECT *, t <> '' AND row_number() OVER (PARTITION BY message_id, lower(t) ORDER BY place) = 1 AS once FROM s5),
m AS (SELECT message_id, count(*) FILTER (once) AS kept, string_agg(t, chr(10) ORDER BY place) FILTER (once) AS text, sum(cut) AS citations FROM o GROUP BY 1),
r AS (SELECT b.message_id, b.ts, coalesce(m.text, '') AS text, coalesce(m.kept, 0) AS kept, len(b.raw) - coalesce(m.kept, 0) AS removed, coalesce(m.citations, 0)::BIGINT AS citations FROM b LEFT JOIN m USING (message_id))"""


def _cleaned(spark, sf_dir):
    labels = spark.createDataFrame([(c, x) for c, ls in LABELS.items() for x in ls], "channel_id string, label string")
    return A.clean_posts(posts(spark, sf_dir), labels, WORDING)


@query(f"WITH {_CLEANED} SELECT message_id, sha1(text) AS text_id, kept, removed, citations FROM r")
def c3_attributions(spark, sf_dir):
    return _cleaned(spark, sf_dir).select("message_id", F.sha1(F.col("text").cast("binary")).alias("text_id"), "kept", "removed", "citations")


@query(f"""WITH {_CLEANED} SELECT time_bucket(INTERVAL 30 MINUTE, ts - INTERVAL 1 MICROSECOND) + INTERVAL 30 MINUTE AS window_end, count(*) AS posts, count(*) FILTER (kept = 0) AS "empty",
  sum(removed)::BIGINT AS removed, sum(citations)::BIGINT AS citations FROM r GROUP BY 1""")
def e17_digest_counts(spark, sf_dir):
    return A.digest_counts(_cleaned(spark, sf_dir))
