"""Shared pieces of the oracles, in DuckDB's SQL."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import functions as F

from newsmill.functions import vocab as V


def registry(queries: dict, oracles: dict):
    """A decorator that registers a query under its name; whole numbers are given as 64-bit ones."""

    def query(sql: str | None = None):
        def add(f):
            @wraps(f)
            def run(spark, sf_dir):
                df = f(spark, sf_dir)
                return df.select(*[F.col(f"`{n}`").cast("long").alias(n) if t == "int" else F.col(f"`{n}`") for n, t in df.dtypes])

            queries[f.__name__] = run
            if sql:
                oracles[f.__name__] = sql
            return run

        return add

    return query


POSTS = "(SELECT source AS channel_id, doc_id AS message_id, source AS source_name, text AS raw_text, lang, TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS ts FROM documents)"


def squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def normalize(x: str) -> str:
    x = squeeze(f"coalesce({x}, '')")
    for p in (V.URL, V.EMOJI, V.CLOCK, V.DATE, V.NOISE):
        x = f"regexp_replace({x}, '{p}', ' ', 'g')"
    return squeeze(f"regexp_replace(lower({x}), '[^a-z0-9\\s]', ' ', 'g')")


def quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def tokens(norm: str) -> str:
    return f"list_filter(regexp_extract_all({norm}, '[a-z0-9]{{2,}}'), lambda w: w NOT IN ({quoted(V.DUPE_STOP_WORDS)}))"


NORMED = f"(SELECT *, CASE WHEN norm = '' THEN '' ELSE sha1(norm) END AS text_hash FROM (SELECT *, {normalize('raw_text')} AS norm FROM {POSTS}))"


def names(x: str) -> str:
    """Capitalised words, lower-cased; letters of any script make words."""
    return f"list_distinct(list_transform(list_filter(regexp_extract_all({x}, '[\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, '[A-Z][a-z]{{2,}}')), lambda w: lower(w)))"


def foreign_lines(rows: str, cues) -> str:
    """CTEs w_, h2 and g: rows with a line t, and whether it isn't English."""
    return f"""w_ AS (SELECT *, len(regexp_extract_all(t, '\\p{{L}}')) - len(regexp_extract_all(t, '[A-Za-z]')) AS f, regexp_extract_all(t, '[A-Za-z\\x{{C0}}-\\x{{FF}}][A-Za-z\\x{{C0}}-\\x{{FF}}''/-]*') AS ws, regexp_extract_all(t, '[A-Za-z][A-Za-z''/-]*') AS ps FROM ({rows})),
h2 AS (SELECT *, len(ws) AS n, len(list_filter(ws, lambda x: lower(x) IN ({quoted(V.ENGLISH_WORDS)}))) AS en, len(list_filter(ps, lambda x: lower(x) IN ({quoted(V.ENGLISH_WORDS)}))) AS plain_en, len(list_filter(ps, lambda x: lower(x) IN ({quoted(cues)}))) AS cues FROM w_),
g AS (SELECT *, regexp_matches(t, '[\\x{{600}}-\\x{{6FF}}\\x{{750}}-\\x{{77F}}\\x{{8A0}}-\\x{{8FF}}\\x{{400}}-\\x{{4FF}}]') OR f >= 4 OR (n >= 6 AND ((f >= 2 AND en <= 1) OR (f >= 1 AND en = 0 AND n >= 8))) OR (len(ps) >= 5 AND plain_en = 0 AND cues > 0) AS foreign_ FROM h2)"""
