import datetime as dt
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from newsmill.functions import text as T
from newsmill.operators import dedup, keyed, rules
from newsmill.streaming import windows

T0 = dt.datetime(2024, 1, 1)


def at(s):
    return T0 + dt.timedelta(seconds=s)


def posts(spark, rows):
    return spark.createDataFrame([(c, i, c, t, at(s)) for c, i, t, s in rows], "channel_id string, message_id long, source_name string, raw_text string, ts timestamp")


def test_normalize_and_features(spark):
    df = spark.createDataFrame([("BREAKING: Strike at 10:30 UTC on 12/01/2024 — see https://x.y/z 🚨 two Dead!",), (None,), ("",)], "x string")
    got = [r[0] for r in df.select(T.normalize(F.col("x"))).collect()]
    assert got == ["strike at on see two dead", "", ""]
    r = df.limit(1).select(T.anchors(T.tokens(T.normalize(F.col("x")))).alias("a"), T.numbers(F.col("x")).alias("n")).first()
    assert r.a == ["strike", "dead"] and "2" in r.n


def test_window_bounds_are_right_closed(spark):
    df = posts(spark, [("a", 1, "x", 1800), ("a", 2, "x", 1801), ("a", 3, "x", 3600), ("a", 4, "x", 3601)])
    got = {r.window_end: r.posts for r in windows.tumbling(df, ["channel_id"]).collect()}
    assert got == {at(1800): 1, at(3600): 2, at(5400): 1}
    quiet = windows.with_quiet_windows(windows.tumbling(df, []), at(1800), at(7200)).orderBy("window_end").collect()
    assert [r.posts for r in quiet] == [1, 2, 1, 0]


def test_tumbling_stream_equals_batch(spark, tmp_path):
    df = posts(spark, [("a", i, "x", 97 * i) for i in range(60)]).repartition(4)
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withWatermark("ts", "4 hours")
    q = windows.tumbling(stream, ["channel_id"]).writeStream.outputMode("complete").format("memory").queryName("tumbled").trigger(availableNow=True).start()
    q.awaitTermination(120)
    key = lambda rows: sorted((r.window_end, r.posts) for r in rows)
    assert key(spark.table("tumbled").collect()) == key(windows.tumbling(df, ["channel_id"]).collect())


def test_exact_duplicates_within_hours(spark):
    df = posts(spark, [("a", 1, "same text here", 0), ("b", 2, "same text here", 3600), ("c", 3, "same text here", 4 * 3600 + 10), ("d", 4, "other text", 5)])
    df = df.withColumn("text_hash", T.fingerprint(T.normalize(F.col("raw_text"))))
    got = {r.message_id: r.matched_message_id for r in keyed.exact_duplicates(df).collect()}
    assert got == {1: None, 2: 1, 3: 2, 4: None}


def test_checkpoint_never_moves_back(spark):
    base = spark.createDataFrame([("w", 3600)], "k string, mark long")
    assert keyed.ack_marks(base, spark.createDataFrame([("w", 1800)], "k string, mark long"), ["k"], "mark").first().mark == 3600


def test_near_duplicates_match_brute_force(spark):
    r = random.Random(9)
    vocab = ["alpha", "bravo", "charlie", "delta", "echo", "foxtrot", "golf", "hotel", "india", "missile", "kyiv", "42"]
    rows = []
    for i in range(40):
        w = [r.choice(vocab) for _ in range(12)]
        rows.append(("a", 2 * i, " ".join(w), 600 * i))
        w[r.randrange(12)] = r.choice(vocab)
        rows.append(("b", 2 * i + 1, " ".join(w), 600 * i + 60))
    df = posts(spark, rows)
    feats = {x.id: x for x in dedup.features(df).collect()}
    jac = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b)) if set(a) & set(b) else 0.0
    dice = lambda a, b: 2 * len(set(a) & set(b)) / (len(set(a)) + len(set(b))) if set(a) & set(b) else 0.0

    def tfidf(a, b):
        w = {t: 1.0 if t in a and t in b else dedup.ALONE for t in {*a, *b}}
        va, vb = {t: a.count(t) * x for t, x in w.items()}, {t: b.count(t) * x for t, x in w.items()}
        return sum(va[t] * vb[t] for t in w) / (sum(x * x for x in va.values()) ** 0.5 * sum(x * x for x in vb.values()) ** 0.5)

    want = set()
    for a in feats.values():
        for b in feats.values():
            age = (a.ts - b.ts).total_seconds()
            if not (0 < age <= 14400):
                continue
            o = SequenceMatcher(None, a.key, b.key).ratio()
            j, g, c, n, t = jac(a.tokens, b.tokens), dice(a.bigrams, b.bigrams), jac(a.chargrams, b.chargrams), dice(a.anchors, b.anchors), tfidf(a.tokens, b.tokens)
            s = 0.30 * j + 0.25 * g + 0.22 * c + 0.15 * n + 0.08 * o
            best = max([0.5 * s + 0.3 * t + 0.2 * o, *[v for ok, v in [(t >= 0.72 and o >= 0.88, 0.9), (s >= 0.78 and t >= 0.65, 0.89), (n >= 0.66 and t >= 0.62, 0.88), (n >= 0.5 and j >= 0.42 and o >= 0.62, 0.89), (g >= 0.45 and c >= 0.45 and t >= 0.48, 0.88), (o >= 0.85 and j >= 0.4, 0.87)] if ok]])
            if a.text_hash == b.text_hash or best >= 0.82:
                want.add((a.id, b.id))
    pairs = dedup.near_duplicates(df)
    got = {(x.a, x.b) for x in pairs.collect()}
    assert got == want and len(want) > 20
    kept, gone = set(), {}
    for i in sorted(feats):
        hits = [b for a, b in want if a == i and b in kept]
        if not hits:
            kept.add(i)
    state = dedup.greedy_keep(df.select(F.col("message_id").alias("id")), pairs)
    assert {x.id for x in state.where("kept").collect()} == kept and not gone


def test_media_duplicates_match_brute_force(spark):
    r = random.Random(6)
    vocab = ["alpha", "bravo", "explosion", "delta", "harbour", "42", "golf", "ab", "fire", "kyiv"]
    rows = [(i, r.choice(["m1", "m2", "m3", ""]), r.choice(["", None] + [" ".join(r.choice(vocab) for _ in range(r.randint(2, 8))) for _ in range(6)]), 400 * i) for i in range(150)]
    df = spark.createDataFrame([(i, at(s), h, t) for i, h, t, s in rows], "id long, ts timestamp, media_hash string, raw_text string")
    norm = {x.id: x for x in df.select("id", T.normalize(F.col("raw_text")).alias("n"), T.tokens(T.normalize(F.col("raw_text"))).alias("t"), T.anchors(T.tokens(T.normalize(F.col("raw_text")))).alias("c")).collect()}

    def score(a, b, age):
        if not a.n or not b.n:
            return 1.0
        w = {t: 1.0 if t in a.t and t in b.t else dedup.ALONE for t in {*a.t, *b.t}}
        va, vb = {t: a.t.count(t) * x for t, x in w.items()}, {t: b.t.count(t) * x for t, x in w.items()}
        den = (sum(x * x for x in va.values()) * sum(x * x for x in vb.values())) ** 0.5
        both, anchors = set(a.t) & set(b.t), set(a.c) & set(b.c)
        j, n = len(both) / max(1, len({*a.t, *b.t})), 2 * len(anchors) / max(1, len(set(a.c)) + len(set(b.c)))
        s = 0.35 * (sum(va[t] * vb[t] for t in w) / den if den else 0) + 0.2 * SequenceMatcher(None, a.n, b.n).ratio() + 0.2 * j + 0.25 * n
        strong = sum(t.isdigit() or len(t) >= 5 or t in dedup.V.BREAKING_HINTS for t in both)
        return max(s, 0.34 * (strong >= 3), 0.36 * (n >= 0.5 and j >= 0.18), 0.35 * (age <= 1800))

    want = {}
    for i, h, _, s in rows:
        old = [(j, s - u) for j, g, _, u in rows if g == h and u < s and h][-25:]
        best = max(((round(score(norm[i], norm[j], age), 6), -age, j) for j, age in old if age <= 14400), default=None)
        if best and best[0] >= 0.32:
            want[i] = (best[2], best[0])
    got = {x.id: (x.matched, x.score) for x in dedup.media_duplicates(df).collect()}
    assert got == want and len(want) > 20


def test_noun_forms():
    cases = {"ferry": "ferries", "ferries": "ferry", "quay": "quays", "torch": "torches", "glass": "glasses", "boats": "boat", "boxes": "box", "gas": "gases", "bus": "buses", "up": "up"}
    for word, form in cases.items():
        assert form in rules.noun_forms(word), word
    assert rules.noun_forms("it") == {"it"} and "quaies" not in rules.noun_forms("quay") and "glas" not in rules.noun_forms("glass")
    assert rules.variants("") == [] and rules.variants("Night-ferry") == sorted({"night ferry", "night-ferry", "nightferry", "night ferries", "night-ferries", "nightferries"})
    assert rules.noun_forms("strikes") == {"strikes", "strike"} and rules.noun_forms("dies") == {"dies", "die"} and rules.noun_forms("harbour") == {"harbour", "harbours"}


def test_long_phrases_match(spark):
    table = rules.rule_table(spark, [("law", "primary", "court of first instance ruling")])
    df = posts(spark, [("a", 1, "A court of first instance ruling today", 0), ("a", 2, "court of first instance", 1)])
    assert [(x.id, x.phrase) for x in rules.rule_hits(df, table).collect()] == [(1, "court of first instance ruling")]


def test_rule_variants_and_blocking(spark):
    assert {"air strike", "air-strike", "airstrikes"} <= set(rules.variants("air strike"))
    table = rules.rule_table(spark, [("war", "primary", "air strike"), ("war", "blocked", "drill"), ("*", "recency", "just now")])
    df = posts(spark, [("a", 1, "Air-strikes (just now) reported", 0), ("a", 2, "air strike drill", 1), ("a", 3, "fair strike", 2), ("a", 4, "air, strike", 3)])
    got = {(x.id, x.category, x.phrase) for x in rules.rule_hits(df, table).collect()}
    assert got == {(1, "war", "air strike"), (1, "*", "just now")}
    with pytest.raises(ValueError):
        rules.rule_table(spark, [("x", "primary", "é")])


def test_cooldown_counts_granted_highs_only(spark):
    rows = [(i, "s", at(600 * i), "high") for i in range(12)] + [(99, "s", at(10), "low")]
    got = {x.id: x.severity for x in rules.cooldown(spark.createDataFrame(rows, "id long, channel_id string, ts timestamp, severity string")).collect()}
    granted, want = [], {99: "low"}
    for i in range(12):
        granted = [g for g in granted if 600 * i - g <= 3600]
        want[i] = "high" if len(granted) < 3 else "medium"
        granted += [600 * i] if want[i] == "high" else []
    assert got == want


def test_blocks_cut_small_agree(spark, monkeypatch):
    """Pairs, counts and cosines are the same however posts are dealt into blocks, words are told apart and strips are cut."""
    r = random.Random(12)
    vocab = [f"w{i}" for i in range(8)] + [f"rare{i}" for i in range(60)]
    texts = [" ".join(r.choice(vocab[: r.choice((8, 68))]) for _ in range(r.randint(3, 15))) for _ in range(150)] + ["same old text again"] * 9 + [None, "", "a b"]
    rows = [("c", i, t, r.choice((0, 400, 1300)) * (i % 60)) for i, t in enumerate(texts)]
    f = dedup.features(posts(spark, rows)).select("id", "ts", "text_hash", "tokens").localCheckpoint()
    feats = f.collect()
    want, cosines = {}, {}
    for a in feats:
        for b in feats:
            age = (a.ts - b.ts).total_seconds()
            ta, tb = (set(x.tokens) for x in (a, b))
            if 0 <= age <= 14400 and (age or b.id < a.id) and ta & tb:
                want[a.id, b.id] = len(ta & tb) / len(ta | tb)
                c = sum(a.tokens.count(w) * b.tokens.count(w) for w in ta & tb) / (sum(a.tokens.count(w) ** 2 for w in ta) * sum(b.tokens.count(w) ** 2 for w in tb)) ** 0.5
                if age and round(c, 6) >= 0.6:
                    cosines[a.id, b.id] = round(c, 6)
    monkeypatch.setattr(dedup, "BLOCK", 60)
    got = dedup.token_pairs(f).collect()
    assert len(got) == len(want) and {(x.a, x.b): x.jaccard for x in got} == want
    assert {(x.a, x.b): x.score for x in dedup.tf_cosine(f, least=0.6).collect()} == cosines
    old, new = f.where("id % 3 = 0"), f.where("id % 3 <> 0")
    assert {(x.a, x.b) for x in dedup.token_pairs(new, old).collect()} == {(a, b) for a, b in want if a % 3 and not b % 3}
    every = dedup.Block(dedup.in_blocks(f, None, 10**9).toArrow())  # the workers have the module's own values, so cuts are tested here
    sums = lambda: [x.tolist() for x in every.products(every.one, every.two, (0, 0), (1, 1), (2, 0))]
    plain = sums()
    for strip, rare, pairs in ((7, 0, 1), (3, 1e9, 10), (5, 60, 100)):
        for name, value in (("STRIP", strip), ("RARE", rare), ("PAIRS", pairs)):
            monkeypatch.setattr(dedup, name, value)
        assert sums() == plain
    counts = {x.id: x.tokens for x in feats}
    ids = every.ids.to_pylist()
    assert all(plain[1][i][j] == sum(counts[ids[a]].count(w) * counts[ids[b]].count(w) for w in {*counts[ids[a]]}) for i, a in enumerate(every.one[:12]) for j, b in enumerate(every.two))


def test_phrases_are_looked_for_once(spark, monkeypatch):
    """Ways of the lookup agree, and what reads the hits doesn't search the posts again."""
    texts = ["Of-the rise; of the, thes of thes", "der  die (der) die-der of the", "OFTHE ofthe of  the9", None, "", "de la de-la dela", "of\tthe of.the"]
    rows = spark.createDataFrame(list(enumerate(texts)), "message_id long, raw_text string")
    table = rules.rule_table(spark, [("a", "primary", "of the"), ("a", "alias", "der die"), ("b", "primary", "de la"), ("b", "event", "rise")])
    hits = rules.rule_hits(rows, table)
    found = sorted(map(tuple, rules.phrase_grams(rows, table.select("variant")).collect()))
    assert found == [(0, "of the"), (0, "of thes"), (0, "of-the"), (0, "rise"), (1, "der die"), (1, "of the"), (2, "ofthe"), (5, "de la"), (5, "de-la"), (5, "dela"), (6, "of the")]
    assert "regexp" not in rules.category_scores(hits)._jdf.queryExecution().optimizedPlan().toString()
    want = sorted(map(tuple, hits.collect()))
    for name in ("FEW_FIRST", "FEW_VARIANTS"):
        monkeypatch.setattr(rules, name, 0)
        assert sorted(map(tuple, rules.rule_hits(rows, table).collect())) == want
