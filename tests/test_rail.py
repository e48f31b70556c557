import datetime as dt
import random
import re
from difflib import SequenceMatcher
from pathlib import Path

from newsmill.functions import vocab as V
from newsmill.operators import rail
from newsmill.plans import rails

END = dt.datetime(2024, 1, 1, 12)


def order(spark, items):
    """items: text, severity, age in seconds, sources that report it; the ranked texts."""
    lines = spark.createDataFrame([(END, i, t, 0) for i, (t, *_) in enumerate(items)], "window_end timestamp, line_id long, headline string, place int")
    rows = [(END, 100 * i + k, f"s{i}-{k}", END - dt.timedelta(seconds=age), t, sev, 0.0) for i, (t, sev, age, n) in enumerate(items) for k in range(n)]
    posts = spark.createDataFrame(rows, "window_end timestamp, id long, source string, ts timestamp, text string, severity string, bonus double")
    return [r.headline for r in rail.rank(lines, posts, rail.match_posts(lines, posts)).orderBy("rank").collect()]


A, B = "Minister opens northern bridge today", "Harbour strike halts seven ferries"


def test_high_before_low_and_fresh_before_stale(spark):
    assert order(spark, [(A, "low", 60, 1), (B, "high", 60, 1)])[0] == B
    assert order(spark, [(A, "medium", 6000, 1), (B, "medium", 10, 1)])[0] == B
    assert order(spark, [(A, "low", 0, 1), (B, "high", 7200, 1)])[0] == B


def test_corroborated_before_single(spark):
    assert order(spark, [(A, "medium", 60, 1), (B, "medium", 60, 4)])[0] == B
    assert order(spark, [(A, "medium", 60, 4), (B, "medium", 60, 1)])[0] == A


def brute_match(lines, posts):
    """line_id, id and score of all pairs of a window, straight from the rules."""
    key = lambda t: " ".join(re.findall("[a-z0-9]+", t.lower()))
    topic = lambda t: {w for w in key(t).split() if len(w) >= 4 and w not in V.DUPE_STOP_WORDS}
    names = lambda t: {w.lower() for w in re.findall(r"\b[A-Z][a-z]{2,}\b", t)}
    numbers = lambda t: {*re.findall(r"\d+", t), *(V.NUMBER_WORDS[w] for w in re.findall("[a-z]+", t.lower()) if w in V.NUMBER_WORDS)}
    out = {}
    for w, i, t in lines:
        for v, j, u in posts:
            if v != w or not key(t) or not key(u):
                continue
            both = topic(t) & topic(u)
            cover, dense = len(both) / max(1, len(topic(t))), len(both) / max(1, len(topic(u)))
            num, name, same = bool(numbers(t) & numbers(u)), bool(names(t) & names(u)), cover >= 0.6 and len(both) >= 3
            r = SequenceMatcher(None, key(t), key(u)).ratio()
            if not same and (cover < 0.42 and len(both) < 3 and not (num or name) or r < 0.55 and cover < 0.58):
                continue
            out[i, j] = round(r + cover + 0.35 * dense + 1.5 * same + 0.4 * num + 0.35 * name, 6)
    return out


def test_matches_against_brute_force(spark):
    r = random.Random(3)
    words = ["harbour", "ferry", "Minister", "bridge", "storm", "seven", "12", "strike", "North", "opens", "the", "council", "Vote", "river", "of"]
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    ends = [END, END + dt.timedelta(minutes=30)]
    lines = [(r.choice(ends), i, say(r.randint(0, 7))) for i in range(40)]
    posts = [(r.choice(ends), 100 + i, say(r.choice([0, 3, 6, 9, 40]))) for i in range(60)] + [(END, 500, lines[0][2]), (END, 501, lines[0][2])]
    h = spark.createDataFrame(lines, "window_end timestamp, line_id long, headline string")
    p = spark.createDataFrame(posts, "window_end timestamp, id long, text string")
    got = {(x.line_id, x.id): round(x.match, 6) for x in rail.match_posts(h, p).collect()}
    assert got == brute_match(lines, posts) and len(got) > 100


def long_window(spark, windows=2, n=30):
    """Windows of long posts without a common word, and their first words as headlines."""
    r = random.Random(5)
    rows = [(END + dt.timedelta(minutes=30 * w), 100 * w + i, " ".join(f"{r.getrandbits(36):09x}" for _ in range(3000))) for w in range(windows) for i in range(n)]
    p = spark.createDataFrame(rows, "window_end timestamp, id long, text string").repartition(2).localCheckpoint()
    h = spark.createDataFrame([(w, i, t[:59]) for w, i, t in rows], "window_end timestamp, line_id long, headline string").localCheckpoint()
    return h, p, sum(len(t) for *_, t in rows)


def moved(spark, df):
    """Rows of a result, and bytes that were shuffled and staged for it."""
    store, at = spark.sparkContext._jsc.sc().statusStore(), Path(spark.conf.get("spark.checkpoint.dir"))
    now = lambda: store.executorSummary("driver").totalShuffleWrite() + sum(f.stat().st_size for f in at.rglob("*.parquet"))
    before = now()
    rows = df().collect()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return rows, now() - before


def test_texts_move_once_for_overlaps(spark):
    h, p, size = long_window(spark)
    rows, most = moved(spark, lambda: rail.overlaps(h, p).select("line_id", "id", "both"))
    assert {(x.line_id, x.id) for x in rows if x.line_id == x.id} == {(i, i) for w in (0, 100) for i in range(w, w + 30)}
    assert most < 1.5 * size


def test_texts_move_once_for_matches(spark):
    h, p, size = long_window(spark)
    rows, most = moved(spark, lambda: rail.match_posts(h, p))
    assert {(x.line_id, x.id) for x in rows} == {(i, i) for w in (0, 100) for i in range(w, w + 30)}
    assert most < 1.5 * size


def test_lines_of_a_window_are_dealt_into_blocks(spark, monkeypatch):
    r = random.Random(4)
    words = ["harbour", "ferry", "Minister", "bridge", "storm", "seven", "12", "1two", "North", "opens", "the", "Vote", "of", "Über"]
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    lines = [(END, i, say(r.randint(0, 7))) for i in range(40)]
    posts = [(END, 100 + i, say(r.choice([0, 3, 6, 9, 40]))) for i in range(40)] + [(END, 500, None)]
    h = spark.createDataFrame(lines, "window_end timestamp, line_id long, headline string")
    p = spark.createDataFrame(posts, "window_end timestamp, id long, text string")
    for few, long in ((6, 1_000_000), (1024, 200)):
        monkeypatch.setattr(rail, "LINES", few)
        monkeypatch.setattr(rail, "CHARS", long)
        blocks = rail.blocks(h).collect()
        assert len(blocks) > 2 and sorted(m.line_id for b in blocks for m in b.lines) == list(range(40))
        got = [(x.line_id, x.id) for x in rail.match_posts(h, p).collect()]
        assert len(got) > 100 and len(got) == len(set(got))
        assert set(got) == set(brute_match(lines, posts[:-1]))


def long_documents(spark, path):
    """Two windows of long documents that begin with a sentence of their own, one without a text and one of blanks."""
    r = random.Random(6)
    texts = [". ".join(" ".join(f"{r.getrandbits(36):09x}" for _ in range(n)) for n in (6, 3000)) for _ in range(56)] + [None, " \t\n"]
    docs = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts, 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return sum(len(t or "") for t in texts)


def test_texts_move_once_for_ranks(spark, tmp_path):
    size = long_documents(spark, tmp_path)
    rows, most = moved(spark, lambda: rails.QUERIES["f4_rail_rank"](spark, str(tmp_path)))
    assert sorted(x.line_id for x in rows) == list(range(1, 57))
    assert sorted((x.window_end.minute, x["rank"]) for x in rows) == [(0, i) for i in range(1, 27)] + [(30, i) for i in range(1, 31)]
    assert most < 1.5 * size


def test_texts_move_once_for_digests(spark, tmp_path):
    size = long_documents(spark, tmp_path)
    rows, most = moved(spark, lambda: rails.QUERIES["k4_digest_rows"](spark, str(tmp_path)))
    sections = [x.section for x in sorted(rows, key=lambda x: (x.window_end, x.pos))]
    assert sections == 2 * (["headline"] + 12 * ["highlights"] + 3 * ["also_moving"])
    assert most < 1.5 * size


def test_pairs_are_matched_once(spark):
    h = spark.createDataFrame([(END, 1, A), (END, 2, B)], "window_end timestamp, line_id long, headline string")
    plan = rail.match_posts(h, h.select("window_end", h.line_id.alias("id"), h.headline.alias("text")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [ratio") == 1
