from newsmill.operators import dedup as D
from newsmill.operators import digests as G
from newsmill.operators import gates
from newsmill.operators import rules as R
from pyspark.sql import functions as F


def test_allowlist(spark):
    rows = [(1, "News.Example.org", None), (2, "example.org", "x"), (3, "badexample.org", None), (4, None, "Daily  Post!"), (5, "wrap.example", "The Daily Post"), (6, None, "daily.post"), (7, None, None), (8, "", ""), (9, None, "post"), (10, None, "a.daily-post"), (1, "News.Example.org", None)]
    df = spark.createDataFrame(rows, "id long, host string, label string").withColumn("domain", F.lit("clash"))
    allow = lambda *d: sorted(r.id for r in gates.allowlist(df, spark.createDataFrame([(x,) for x in d], "domain string"), "host", "label").collect())
    assert allow() == allow(None, " ", ".") == sorted(r[0] for r in rows)
    assert allow(".Example.ORG ") == [1, 1, 2]
    assert allow("dailypost.co.uk") == [4] and allow("daily-post") == [4, 10] and allow("thedailypost.net") == [5]
    assert allow("post") == [6, 9] and allow("daily.post", "example.org") == [1, 1, 2, 6]
    assert allow("nowhere.example") == []
    assert gates.allowlist(df.limit(0), spark.createDataFrame([("a",)], "domain string"), "host", "label").count() == 0


def test_language_gate(spark):
    said = {
        "Troops moved into the city at night": False, "": False, None: False,
        "\u0645": True, "\u0414": True, "\u00e9\u00e9\u00e9": False, "\u00e9\u00e9\u00e9\u00e9": True, "\u65e5\u672c\u8a9e\u8a71": True,
        "caf\u00e9 na\u00efve uno dos tres cuatro": True, "caf\u00e9 na\u00efve is on the list": False,
        "uno dos tres cuatro cinco seis siete caf\u00e9": True, "uno dos tres cuatro cinco seis caf\u00e9": False,
        "kebakaran terjadi uno dos tres": True, "kebakaran terjadi at uno dos": False, "kebakaran uno dos tres": False,
    }
    df = spark.createDataFrame([(k, v) for k, v in said.items()], "text string, want boolean")
    for r in df.select("text", "want", G.needs_translation(F.col("text")).alias("got")).collect():
        assert r.got == r.want, r.text


def test_breaking_gate(spark):
    sig = spark.createDataFrame([(1, True, False, True), (2, True, False, False), (3, True, True, True), (4, False, False, True), (5, True, False, False)], "id long, live_event_update boolean, downgrade_explainer boolean, breaking boolean")
    posts = spark.createDataFrame([(1, "calm"), (2, "Big  STORM hits"), (3, "storm"), (4, "storm"), (5, None), (6, "storm flood")], "message_id long, raw_text string")
    gate = lambda words, least=1: {r.id: (r.keyword_hits, r.admitted) for r in R.breaking_gate(sig, posts, words, least).collect()}
    assert gate(["storm", "big storm", " Storm"]) == {1: (0, True), 2: (2, True), 3: (1, False), 4: (1, False), 5: (0, False), 6: (1, False)}
    assert not gate(["storm"], 2)[2][1] and not gate([])[2][1] and gate([])[1][1]


def test_live_reports(spark):
    minute = {1: (0, "a"), 2: (10, "b"), 3: (35, "b"), 4: (40, "c"), 5: (75, "d"), 6: (80, "e"), 11: (0, "a"), 12: (5, "a"), 13: (31, "b"), 21: (0, None), 22: (30, " "), 23: (30, "z"), 24: (60, "y")}
    posts = spark.createDataFrame([(i, s, t) for i, (t, s) in minute.items()], "message_id long, source_name string, t int").select("message_id", "source_name", F.timestamp_seconds(F.col("t") * 60).alias("ts"))
    dups = spark.createDataFrame([(i, i // 10 * 10 + 1) for i in minute if i % 10 != 1] * 2, "id long, matched long")
    got = {r.id: (r.also_reported_by, r.reports) for r in D.live_reports(dups, posts).collect()}
    assert got == {1: ("b, c", 2), 21: ("y, z", 2)}  # d comes 35 minutes after c, and e finds the post gone
    assert D.live_reports(dups, posts, most=1).where("id = 1").first()[1:3] == ("b", 2)
    assert D.live_reports(dups.limit(0), posts).count() == 0
