import datetime as dt
import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from newsmill.operators import digests, hooks, lines, retrieval
from newsmill.sources import feeds


def brute_slots(rows):
    """Sequential collapse: (winner, removed) of each slot by (by, first pos)."""
    key = lambda t: "".join(c if c.isascii() and c.isalnum() else " " for c in t.lower()).split()

    def near(x, y):
        a, b = " ".join(key(x)), " ".join(key(y))
        if not a or not b:
            return False
        short, long = sorted((a, b), key=len)
        return a == b or len(short.split()) >= 8 and short in long or SequenceMatcher(None, a, b).ratio() >= 0.94

    out = {}
    for by in sorted({r[0] for r in rows}):
        slots = []
        for _, pos, line, power in sorted(r for r in rows if r[0] == by):
            s = next((s for s in slots if near(line, s["line"])), None)
            if s is None:
                slots.append({"pos": pos, "row": pos, "line": line, "power": power, "gone": 0})
                continue
            s["gone"] += 1
            if power > s["power"]:
                s.update(row=pos, line=line, power=power)
        out |= {(by, s["pos"]): (s["row"], s["gone"]) for s in slots}
    return out


def test_keep_stronger_against_brute_force(spark):
    r = random.Random(4)
    vocab = "Harbour ferry storm closes northern bridge council river vote 12 strike pilots return after long night".split()
    rows, pos = [], 0
    for by in ("a", "b"):
        for _ in range(12):
            w = [r.choice(vocab) for _ in range(r.randint(6, 14))]
            for _ in range(r.randint(1, 3)):
                v = list(w)
                if r.random() < 0.5:
                    v[r.randrange(len(v))] += r.choice(["s", "", "!"])
                if r.random() < 0.3:
                    v += ["Officials", "7"]
                rows.append((by, pos, " ".join(v)))
                pos += 1
    df = spark.createDataFrame(rows, "by string, pos long, line string")
    power = {x.pos: x.p for x in df.select("pos", lines.strength(F.col("line")).alias("p")).collect()}
    got = {(x.by, x.pos): (x.winner, x.removed) for x in lines.keep_stronger(df).collect()}
    assert got == brute_slots([(b, p, t, power[p]) for b, p, t in rows]) and any(n for _, n in got.values())
    assert lines.keep_stronger(df.limit(0)).count() == 0


def test_scrub_modes_and_grounding(spark):
    rows = [("w", 0, "Ferry strike halts seven Harbour routes tonight again"), ("w", 1, "ferry strike halts seven harbour routes tonight again!"), ("w", 2, "too short"), ("w", 3, None), ("w", 4, "no name or number here at all")]
    df = spark.createDataFrame(rows, "by string, pos long, line string")
    keep = lambda mode: sorted(x.pos for x in lines.scrub(df, mode).collect())
    assert keep("main") == [0, 2, 4] and keep("also_moving") == [0] and keep("catchup") == [0]
    pairs = [("Police reportedly saw 3 boats near Haifa", "Police reportedly saw 4 boats", "invented_number"), ("Police reportedly saw boats", "Police saw boats", "lost_hedge"), ("Police saw boats", "Police saw Marines", "unsupported_name"), ("Police saw boats", "Police saw massive boats", "unsupported_escalation"), ("Police saw boats", "Police saw boats", ""), ("", "x", "empty_output"), ("Police saw our boats", "Police saw our boats", "pronoun_leak"), ("Police warn us", "Police warn us", "pronoun_leak"), ("US police saw boats", "US police saw boats", ""), ("Meñ saw boats", "Meñ saw boats", "")]
    df = spark.createDataFrame(pairs, "s string, c string, want string")
    assert [x.got for x in df.select(lines.grounding_issue(F.col("s"), F.col("c")).alias("got")).collect()] == [p[2] for p in pairs]


def test_line_issues_in_order(spark):
    rows = [
        ("Did 3 boats sink off Haifa?", "question_line"), ("And 3 boats sank off Haifa today", "continuation_line"), ("They lost 3 boats off Haifa today", "dependent_line"), ("We must stop 3 boats off Haifa", "banter_line"),
        ("Of course 3 boats sank off Haifa", "banter_line"), ("Imagine 3 boats sank off Haifa today", "vague_copy"), ("More details to follow after 3 blasts", "vague_copy"), ("Officially confirmed!", "vague_copy"),
        ("Video has 300 views after one day", "banter_line"), ("Video has 300 views after 2 men were killed", ""), ("We will strike 3 more ports today", "ungrounded_copy"), ("Says 3 boats sank off Haifa today", "dependent_line"),
        ("Three boats sank off Haifa today!!", "low_value"), ("“3 boats sank off Haifa today”", "low_value"), ("3 boats sank off Haifa and the", "incomplete_copy"), ('Captain says "3 boats sank off Haifa', "incomplete_copy"),
        ("boats sank off Haifa, 3 men lost", "continuation_line"), ("What we know about 3 lost boats", "soft_news"), ("3 boats sank", "headline_too_thin"), ("Boats sank near the coast today", "headline_too_thin"),
        ("Tensions are high over 3 lost boats", "vague_copy"), ("3 boats sank off Haifa at dawn", ""), ("", "empty_output"), (None, "empty_output"), ("3 лодки затонули у берега Хайфы", "headline_too_thin"),  # words are of Latin letters
    ]
    df = spark.createDataFrame(rows, "line string, want string")
    assert [(x.line, x.got) for x in df.select("line", lines.line_issue(F.col("line")).alias("got")).collect()] == rows
    got = {x.line: x.got for x in df.select("line", lines.line_issue(F.col("line"), english=True).alias("got")).collect()}
    assert got["3 лодки затонули у берега Хайфы"] == "non_english_leftovers" and got["3 boats sank off Haifa at dawn"] == ""


def test_live_history(spark):
    at = lambda h: dt.datetime(2024, 1, 3, tzinfo=dt.UTC) - dt.timedelta(hours=h)
    rows = [("a", 1, at(60)), ("a", 2, at(24)), ("a", 3, at(24)), ("b", 4, at(25)), ("c", 5, at(0)), ("c", 6, None), (None, 7, at(1)), ("d", 8, None)]
    df = spark.createDataFrame(rows, "user string, id long, ts timestamp")
    got = sorted((str(x.user), x.id, x.back) for x in digests.live_history(df, "user", ["id"], 2, at(0)).collect())
    assert got == [("None", 7, 1), ("a", 2, 2), ("a", 3, 1), ("c", 5, 1), ("c", 6, 2)]
    assert digests.live_history(df.limit(0), "user", ["id"], 2, at(0)).count() == 0


def test_backfill_promotes_the_first_line(spark):
    rows = [("a", "also", 1, "x"), ("a", "demoted", 0, "y"), ("b", "main", 0, "m"), ("b", "demoted", 1, "d"), ("b", "also", 2, "e")]
    got = sorted((x.by, x.section, x.pos, x.line) for x in lines.backfill(spark.createDataFrame(rows, "by string, section string, pos long, line string")).collect())
    assert got == [("a", "also", 1, "y"), ("a", "main", 1, "x"), ("b", "also", 1, "e"), ("b", "also", 2, "d"), ("b", "main", 1, "m")]


def test_hooks(spark):
    rows = [(1, "Harbour closed", '{"action": "deliver", "severity": "high", "confidence": -2, "headline": "Harbour closed"}'), (2, "Harbour closed", '{"action": "deliver", "severity": "high", "headline": "Bridge 9 fell"}'), (3, "x", "[]"), (4, None, None)]
    df = spark.createDataFrame(rows, "id long, raw_text string, answer string").withColumns({"action": F.lit("digest"), "severity": F.lit("low"), "confidence": F.lit(0.5), "headline": F.lit(None).cast("string")})
    got = {x.id: (x.action, x.confidence, x.decided_by) for x in hooks.model_decisions(df, F.col("answer")).collect()}
    assert got == {1: ("deliver", 0.0, "model"), 2: ("digest", 0.5, "rules"), 3: ("digest", 0.5, "rules"), 4: ("digest", 0.5, "rules")}
    v = {x.id: x.embedding for x in hooks.embed(df, "raw_text", lambda ts: [[float(len(t))] for t in ts]).collect()}
    assert v == {1: [14.0], 2: [14.0], 3: [1.0], 4: None}


def test_aliases_and_hosts(spark):
    posts = spark.createDataFrame([("c", "The Wire: storm\n@the wire\nthe wire!\nby @The Wire staff"), ("d", "The Wire: storm")], "channel_id string, raw_text string")
    aliases = spark.createDataFrame([("c", "wire"), ("c", "the wire")], "channel_id string, alias string")
    got = {x.channel_id: x.raw_text for x in feeds.strip_aliases(posts, aliases).collect()}
    assert got["d"] == "The Wire: storm" and got["c"].split("\n")[0] == "storm" and got["c"].split("\n")[-1] == "by  staff"
    hosts = spark.createDataFrame([("a.example.org",), ("example.org",), ("badexample.org",), (None,)], "h string")
    assert [x.ok for x in hosts.select(feeds.allowed_host(F.col("h"), ["example.org"]).alias("ok")).collect()] == [True, True, False, None]


def test_strategic_trend(spark):
    rows = [("q", "a", 0, "Strikes are widening again", 5.0), ("q", "b", 3600, "A new wave of drones was launched", 4.0), ("q", "c", 7200, "Talks resumed", 1.0), ("r", "a", 0, "A ceasefire holds", 3.0), ("r", "b", 60, "No sign of it widening, officials say", 3.0), ("s", "a", 0, "More strikes", 3.0), ("t", "a", 0, "Still active but calmer", 2.0), ("t", "b", 0, "heavier fire", 1.0), ("u", "a", 0, "nothing here", 9.0), ("v", "a", 0, None, 1.0)]
    df = spark.createDataFrame([(q, s, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=t), x, v) for q, s, t, x, v in rows], "query_id string, source string, ts timestamp, sentence string, score double")
    got = {x.query_id: (x.verdict, x.sources, x.span_hours) for x in retrieval.strategic_trend(df).collect()}
    assert got == {"q": ("escalating", 3, 2.0), "r": ("de-escalating", 2, 0.02), "s": ("insufficient", 1, 0.0), "t": ("mixed", 2, 0.0)}


def test_keywords_inside_words(spark):
    q = retrieval.prepare(spark.createDataFrame([(i, t) for i, t in enumerate(["harbour storm", "bridge 1200", "and the", "ferry"])], "query_id long, question string"))
    posts = spark.createDataFrame([(1, "Harbours closed"), (2, "a BRIDGE"), (3, "at 12005"), (4, None), (5, "ferryman in the storm")], "message_id long, raw_text string").withColumn("ts", F.current_timestamp())
    assert sorted((x.query_id, x.id) for x in retrieval.keyword_filter(q, posts).collect()) == [(0, 1), (0, 5), (1, 2), (1, 3), (3, 5)]


def test_borders_of_words_are_ascii(spark):
    """As in the SQL, a letter outside ASCII borders a word: a line that ends in ña ends in the word a."""
    rows = [("Five people 9 left for the montaña",), ("Five people 9 left for the montana",), ("Five people 9 left of éor",), ("élol is a word with 9",)]
    got = [x.i for x in spark.createDataFrame(rows, "x string").select(lines.line_issue(F.col("x")).alias("i")).collect()]
    assert got == ["incomplete_copy", "", "incomplete_copy", "banter_line"]
