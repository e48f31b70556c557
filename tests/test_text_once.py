"""Texts are normalised once a query, and by plain steps the same."""

import re

from pyspark.sql import functions as F

from newsmill.functions import text as T
from newsmill.functions import vocab as V
from newsmill.plans import catalog

from .conftest import SF

ODD = [
    "12:30\n\n utc and 7.45pm", "12:30 \U0001F680utc", "12:30\U0001F680UTC", "at 12:30https://x.y/z utc", "t.me/a\tb", "HTTPS://X.Y Breaking_news news",
    "café newsé 1/2/2024", "2024-01-02T10:11", "Привет, мир! 10:11", "中文 a中b", "  \x0b a\x00b\x7fc  ", "A{b}[c]`d^e_f/g:h@i", "", "   ", "☀➿ x",
]


def plain(x: str) -> str:
    x = re.sub(r"\s+", " ", x, flags=re.ASCII).strip(" ")
    for p in (V.URL, "[\U0001F1E0-\U0001F1FF\U0001F300-\U0001FAFF☀-➿]+", V.CLOCK, V.DATE, V.NOISE):
        x = re.sub(p, " ", x)
    return re.sub("[^a-z0-9]+", " ", x.lower()).strip(" ")


def test_normalize_equals_plain_steps(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(ODD)], "i int, x string")
    got = {r.i: r for r in df.select("i", T.normalize(F.col("x")).alias("n"), T.alphanumeric(F.lower("x")).alias("a"), T.tokens(T.normalize(F.col("x"))).alias("t")).collect()}
    assert {i: got[i].n for i in got} == {i: plain(x) for i, x in enumerate(ODD)}
    assert {i: got[i].a for i in got} == {i: re.sub("[^a-z0-9]+", " ", x.lower()).strip(" ") for i, x in enumerate(ODD)}
    assert {i: got[i].t for i in got} == {i: [w for w in re.findall("[a-z0-9]{2,}", plain(x)) if w not in V.DUPE_STOP_WORDS] for i, x in enumerate(ODD)}


def plan(spark, name: str) -> str:
    return catalog.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def test_live_reports_take_hashes_that_were_made_once(spark):
    assert "regexp_replace" not in plan(spark, "e9_live_reports")


def test_decision_cache_takes_hashes_that_were_made_once(spark):
    assert "regexp_replace" not in plan(spark, "d12_decision_cache")
