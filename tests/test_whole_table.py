import datetime as dt

from newsmill.plans import catalog, classify

TEXT = "Harbour authority closes the northern terminal after heavy storm damage to several loading cranes"


def test_late_documents_count(spark, tmp_path):
    ids = [0, 30, 1500, 899_000, 900_000]
    texts = ["short words only here today", "nothing alike in this one either", "a third text about other matters", TEXT, TEXT + " today"]
    docs = [(i, t, "en", s, len(t)) for i, t, s in zip(ids, texts, ["s", "s", "s", "src0", None], strict=True)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    run = lambda name: catalog.QUERIES[name](spark, str(tmp_path)).collect()

    assert {(x.a, x.b) for x in run("d6_match_history")} == {(900_000, 899_000)}

    start = dt.datetime(2024, 1, 1)
    days = {x.day: (x.posts, x.last_ts) for x in run("i2_all_daily_digests")}
    assert sum(n for n, _ in days.values()) == 5 and len(days) == 4 and days[start][0] == 2
    assert days[start + dt.timedelta(days=625)] == (1, start + dt.timedelta(minutes=900_000))

    late = {x.channel_id: (x.oldest, x.posts, x.intervals_behind, x.mode) for x in run("i3_whole_backlog")}
    assert late["s"] == (start, 3, 30_000, "catchup") and late[None][1:] == (1, 0, "single") and sum(n for _, n, *_ in late.values()) == 5


def test_blocked_and_noisy_posts_are_skipped(spark, tmp_path):
    texts = [f"They said {classify.HARD[0]} in the street", "#a #b #c #d #e #f #g #h #i #j #k #l #m plain", " ", "An ordinary line of the day"]
    docs = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {x.id: (x.action, x.reason) for x in catalog.QUERIES["b3_route_posts"](spark, str(tmp_path)).collect()}
    assert got[0] == ("skip", "moderation_block") and got[1] == ("skip", "likely_noise") and got[2] == ("skip", "empty") and got[3][0] != "skip"


def test_age_halves_go_to_even(spark, tmp_path):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    rows = [(1, at(0), 1, "a"), (2, at(1), 1, "b"), (3, at(2), 2, "a"), (4, at(2.5), 3, "a")]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    got = {(x.user_id, x.event_type): x.oldest_age_s for x in catalog.QUERIES["e5_job_rollup"](spark, str(tmp_path)).collect()}
    assert got == {(1, "a"): 2, (1, "b"): 2, (2, "a"): 0, (3, "a"): 0}  # 2.5, 1.5, 0.5 and 0 seconds


def test_ties_of_a_source_go_by_time(spark, tmp_path):
    """Of equal values the newest three of a source stay, and are then ranked by id."""
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    rows = [(i, at(i), 1, "a", 5.0) for i in range(1, 6)] + [(9, at(0), 1, "b", 5.0)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = sorted((x.rank, x.event_id) for x in catalog.QUERIES["f2_top_k_with_source_cap"](spark, str(tmp_path)).collect())
    assert got == [(1, 3), (2, 4), (3, 5), (4, 9)]
