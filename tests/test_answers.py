"""Answer chain, labels, routing and request gaps against brute force and examples."""

import datetime as dt
import random
import re
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from newsmill.operators import answers as A
from newsmill.operators import keyed as K
from newsmill.operators import retrieval as Q
from newsmill.operators import rules as R

T0 = dt.datetime(2024, 1, 1)
NOW = dt.datetime(2024, 1, 2)


def corpus(r):
    words = ["harbour", "ferry", "storm", "bridge", "council", "vote", "pilot", "dam", "is", "killed", "12", "300", "http://x"]
    return [(f"s{r.randrange(4)}" if r.random() < 0.95 else None, i, " ".join(r.choice(words) for _ in range(r.randint(0, 9))) or None, T0 + dt.timedelta(minutes=r.randrange(1440))) for i in range(160)]


QUESTIONS = [(1, "who is pilot"), (2, "how many killed at harbour bridge 300"), (3, "ferry storm last 6 hours"), (4, "latest news on dam"), (5, "is it true that council vote"), (6, "nothing known zzz"), (7, None), (8, "quay 12 ferry")]


def brute_scores(prepared, rows):
    out = {}
    for q in prepared:
        names = list(q.keywords) + list(q.aliases)
        for source, i, text, ts in rows:
            low = (text or "").lower()
            tokens = {t for t in re.findall("[a-z0-9]{2,}", low)}
            if (q.since and ts < q.since) or (q.until and ts >= q.until):
                continue
            has = lambda n: set(re.findall("[a-z0-9]+", n)) <= tokens  # noqa: E731, B023
            kw, al, num = sum(map(has, q.keywords)), sum(map(has, names)), sum(map(has, q.numbers))
            if not kw + al + num:
                continue
            s = 3.5 * kw / max(1, len(q.keywords)) + 4.0 * al / max(1, len(names)) + 2.5 * num + 2.0 * (len(q.numbers) > 0 and num == len(q.numbers))
            whole = bool(q.keywords) and kw == len(q.keywords)
            s += 2.0 * (whole and " ".join((q.question or "").lower().split()) in " ".join(low.split()))
            s += 1.4 * (q.identity and bool(re.search(r"\b(?:is|was|are|were|named|called|known as)\b", low)))
            s += (5.0 if whole else -6.0) if q.intent == "who" and q.keywords else 0.0
            s += 1.2 * (q.casualty and "killed" in low) + 0.15 * bool(source) + 0.2 * ("http" in low)
            s += max(0.0, 1.0 - min(max(0.0, (NOW - ts).total_seconds() / 3600) / 48, 1.0))
            out[q.query_id, i] = round(s, 6)
    return out


def test_chain_against_brute_force(spark):
    r = random.Random(4)
    rows = corpus(r)
    posts = spark.createDataFrame(rows, "channel_id string, message_id long, raw_text string, ts timestamp")
    aliases = spark.createDataFrame([("harbour", "quay"), ("quay", "ferry bridge")], "alias string, name string")
    prepared = Q.prepare(spark.createDataFrame(QUESTIONS, "query_id long, question string"), NOW, aliases=aliases).cache()
    scored = A.score_evidence(A.bounded_evidence(prepared, posts), prepared, posts, F.lit(NOW)).cache()
    want = brute_scores(prepared.collect(), rows)
    got = {(x.query_id, x.id): x.score for x in scored.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-5 for k in want) and len(want) > 100

    short = A.shortlist(scored, 5).cache()
    at, src = {i: t for _, i, _, t in rows}, {i: s for s, i, _, _ in rows}
    for q in {q for q, _ in want}:
        order, seen, picks = sorted((i for p, i in want if p == q), key=lambda i: (-want[q, i], -at[i].timestamp(), i)), {}, []
        for i in order:
            if want[q, i] > 0 and seen.get(src[i], 0) < 3:
                seen[src[i]] = seen.get(src[i], 0) + 1
                picks.append(i)
        picks = picks[:5] or sorted((i for p, i in want if p == q), key=lambda i: (-at[i].timestamp(), i))[:5]
        assert [x.id for x in short.where(F.col("query_id") == q).orderBy("rank").collect()] == picks
    again = {(x.query_id, x.id): x.score for x in A.rerank(short, prepared, posts).collect()}
    asked, text = dict(QUESTIONS), {i: t for _, i, t, _ in rows}
    for (q, i), s in again.items():
        like = SequenceMatcher(None, asked[q].lower()[:320], (text[i] or "").lower()[:900]).ratio() if text[i] else 0.0
        assert abs(s - want[q, i] - 1.8 * like) < 1e-5

    why = {x.query_id: (x.ok, x.why) for x in A.gates(prepared, short).collect()}
    assert why[6] == (False, "no_evidence") and why[7] == (False, "no_evidence") and why[1][0] and len(why) == 8
    lines = Q.sentences(prepared, short, posts, 6)
    answers = {x.query_id: x for x in A.answer_rows(prepared, A.gates(prepared, short), lines).collect()}
    assert len(answers) == 8 and answers[6].title == "no match" and answers[6].lead is None
    said = {}
    for x in lines.orderBy("query_id", "pos").collect():
        said.setdefault(x.query_id, []).append(x.sentence)
    for q, a in answers.items():
        if a.answered:
            assert a.title == said[q][0][:90] and a.lead == " ".join(said[q][:2])[:260]
            assert all(b in said[q][2:] for b in a.bullets.split("\n") if b)


def test_gates(spark):
    flags = "query_id long, broad boolean, identity boolean, confirm boolean, numbers array<string>"
    p = spark.createDataFrame([(1, False, False, True, []), (2, True, False, False, []), (3, False, True, False, []), (4, False, False, False, ["30"]), (5, False, False, False, []), (6, False, True, False, [])], flags)
    ranks = spark.createDataFrame([(1, 1, 9.0, "a", 0), (1, 2, 8.0, "A", 0), (2, 1, 0.5, "a", 0), (2, 2, 0.4, "a", 0), (3, 1, 4.0, "a", 0), (4, 1, 4.4, "a", 0), (4, 2, 1.0, "b", 0), (5, 1, 1.0, "a", 0), (5, 2, 0.9, "b", 0), (6, 1, 4.2, "a", 0)], "query_id long, rank int, score double, source string, num_hits long")
    got = {x.query_id: (x.ok, x.why) for x in A.gates(p, ranks).collect()}
    assert got == {1: (False, "one_source"), 2: (True, "broad"), 3: (False, "weak"), 4: (False, "number_missing"), 5: (True, "sources"), 6: (True, "score")}


def test_widened_windows(spark):
    rows = [("a", i, "ferry", NOW - dt.timedelta(hours=h)) for i, h in enumerate([1, 2, 3, 30, 40, 200, 300])] + [("a", 10, "storm", NOW - dt.timedelta(hours=1)), ("a", 11, "storm", NOW - dt.timedelta(hours=100)), ("a", 12, "pilot", NOW - dt.timedelta(hours=300))]
    posts = spark.createDataFrame(rows, "channel_id string, message_id long, raw_text string, ts timestamp")
    prepared = Q.prepare(spark.createDataFrame([(1, "ferry"), (2, "storm"), (3, "who is pilot"), (4, "ferry last 2 hours")], "query_id long, question string"), NOW)
    got = {}
    for x in A.widened(prepared, posts, F.lit(NOW)).collect():
        got.setdefault(x.query_id, set()).add((x.id, x.expanded))
    assert got == {1: {(0, False), (1, False), (2, False)}, 2: {(10, True), (11, True)}, 3: {(12, True)}, 4: {(0, False), (1, False)}}


def test_labels_and_routes(spark):
    posts = spark.createDataFrame([(1, "Air strikes at the port"), (2, "port opens"), (3, "nothing much"), (4, "air strike explained"), (5, None)], "message_id long, raw_text string")
    rules = R.label_table(spark, [("Strike", "air strike"), ("Port", "port")])
    top = spark.createDataFrame([(3, "Themed"), (4, "Themed")], "id long, label string")
    level = spark.createDataFrame([(i, "high") for i in range(1, 6)], "id long, severity string")
    calm = spark.createDataFrame([(4,)], "id long")
    got = {x.id: (x.label, x.origin) for x in R.label_posts(posts, rules, top, level, calm).collect()}
    assert got == {1: ("Strike", "rule"), 2: ("Port", "rule"), 3: ("Themed", "category"), 4: ("Breaking", "generic"), 5: ("Breaking", "generic")}
    rows = [(1, "Bridge falls in storm", False, "high", 0, False, False), (2, "", False, "high", 0, False, False), (3, "with picture here", True, "high", 0, False, False), (4, "blocked words here", False, "low", 0, True, False), (5, "why bridges fall", False, "high", 0, False, True), (6, "quiet news of today", False, "low", 2, False, False), (7, "ab", False, "low", 0, False, True)]
    df = spark.createDataFrame(rows, "id long, raw_text string, has_media boolean, severity string, frequency long, hard_blocked boolean, explainer boolean")
    got = {x.id: (x.action, x.severity, x.reason, x.confidence, x.priority) for x in R.route_posts(df).collect()}
    assert got == {1: ("deliver", "high", "high_severity", 0.55, 10), 2: ("skip", "low", "empty", 0.2, 80), 3: ("skip", "low", "has_media", 0.2, 80), 4: ("skip", "low", "moderation_block", 0.2, 80), 5: ("digest", "medium", "explainer", 0.55, 50), 6: ("digest", "medium", "routine", 0.55, 50), 7: ("skip", "low", "explainer", 0.35, 80)}
    assert {x.id: x.reason for x in R.route_posts(df, digest_mode=True).collect()}[1] == "digest_mode"


def test_accepted_requests(spark):
    r = random.Random(6)
    rows = [(i, r.choice(["a", "b", None]), T0 + dt.timedelta(seconds=r.randrange(600))) for i in range(200)]
    want, last = {}, {}
    for i, who, t in sorted(rows, key=lambda x: (x[2], x[0])):
        want[i] = who not in last or (t - last[who]).total_seconds() >= 10
        if want[i]:
            last[who] = t
    got = {x.id: x.accepted for x in K.accepted_requests(spark.createDataFrame(rows, "id long, who string, ts timestamp"), "who", 10).collect()}
    assert got == want
