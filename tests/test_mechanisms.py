"""Mechanisms against brute force: indexes, blocks, tables of versions, sketches, late rows, names, spans."""

import datetime as dt
import random
import re
from collections import Counter
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsmill.functions import fuzzy as Z
from newsmill.functions import text as T
from newsmill.operators import dedup as D
from newsmill.operators import keyed as K
from newsmill.operators import retrieval as Q
from newsmill.operators import rules
from newsmill.operators import stories as S
from newsmill.sources.ledger import KeyedTable, Ledger
from newsmill.streaming import late

T0 = dt.datetime(2024, 1, 1)


def test_ratio_bound_holds(spark):
    r = random.Random(1)
    texts = [" ".join("".join(r.choice("abcde12") for _ in range(r.randint(1, 6))) for _ in range(r.randint(0, 8))) for _ in range(60)] + ["", None, "é x"]
    rows = [(a, b) for a in texts for b in r.sample(texts, 12)]
    df = spark.createDataFrame(rows, "a string, b string")
    got = df.select("a", "b", Z.ratio("a", "b").alias("r"), Z.ratio_bound(Z.profile(F.col("a")), Z.profile(F.col("b"))).alias("m"), Z.token_sort_ratio(F.col("a"), F.col("b")).alias("s")).collect()
    words = lambda x: " ".join(sorted((x or "").split()))
    plain = lambda x, y: SequenceMatcher(None, x, y).ratio() if x and y else 0.0
    for x in got:
        assert x.r == plain(x.a, x.b) and x.m >= x.r and x.s == plain(words(x.a), words(x.b))


def test_bound_spares_most_ratios(spark):
    """Of random headline pairs that share a topic and fit in length, few are left for the ratio."""
    r = random.Random(2)
    line = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz" if r.random() < 0.5 else "etaoin ") for _ in range(r.randint(30, 60)))
    df = spark.createDataFrame([(line(), line()) for _ in range(2000)], "a string, b string")
    bound = Z.ratio_bound(Z.profile(F.col("a")), Z.profile(F.col("b")))
    left = df.where(bound >= 0.94).count()
    assert left * 5 <= df.where("2 * least(length(a), length(b)) >= 0.94 * (length(a) + length(b))").count()


def test_ratio_from_a_bar(spark):
    """The exact ratio of pairs that reach the bar, null for others; of few pairs is all of the text matched."""
    r = random.Random(8)
    text = lambda n: " ".join(sorted("".join(r.choice("abcdefgh1") for _ in range(r.randint(2, 7))) for _ in range(n)))
    for n in (10, 90, 200):
        for _ in range(12):
            x = text(n)
            y = r.choice((text(n), x[: r.randint(0, len(x))] + x[r.randint(0, len(x)) :], x))
            want = SequenceMatcher(None, x, y).ratio()
            for least in (0.0, 0.5, 0.88, want):
                assert Z._ratio_from(x, y, least) == (want if want >= least else None)
    df = spark.createDataFrame([("ab", "ab", 0.9), ("ab", "cd", 0.1), (None, "a", 0.0), ("a", "", 0.1)], "a string, b string, m double")
    assert [x.r for x in df.select(Z.ratio_from("a", "b", "m").alias("r")).collect()] == [1.0, None, 0.0, None]


def test_words_with_terms(spark):
    r = random.Random(3)
    make = lambda n: "".join(r.choice("ab1") for _ in range(n))
    words, terms = {make(r.randint(1, 9)) for _ in range(300)}, {make(r.randint(1, 5)) for _ in range(60)} | {"zzz", "ba"}
    got = Q.words_with_terms(spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame([(t,) for t in terms], "term string"))
    rows = [tuple(x) for x in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == {(w, t) for w in words for t in terms if t in w}


def test_keyword_filter(spark):
    posts = spark.createDataFrame([("a", 1, "Northern harbours, 2024é", T0), ("a", 2, None, T0), ("a", 3, "harb our 20", T0), ("a", 4, "xharborx", T0 + dt.timedelta(hours=3))], "channel_id string, message_id long, raw_text string, ts timestamp")
    prepared = spark.createDataFrame([(1, ["harbour", "harb"], []), (2, [], ["02"]), (3, [], []), (4, ["xharborx"], ["20"])], "query_id long, keywords array<string>, numbers array<string>")
    got = {(x.query_id, x.id) for x in Q.keyword_filter(prepared, posts).collect()}
    assert got == {(1, 1), (1, 3), (1, 4), (2, 1), (4, 1), (4, 3), (4, 4)}
    assert {(x.query_id, x.id) for x in Q.keyword_filter(prepared, posts, until=T0 + dt.timedelta(hours=1)).collect()} == {(1, 1), (1, 3), (2, 1), (4, 1), (4, 3)}


@pytest.mark.parametrize("least", [0.3, 0.9])
def test_cosine_blocks_against_brute_force(spark, least):
    r = np.random.default_rng(4)
    centres = r.normal(size=(5, 8)) * 4
    rows = [(i, T0 + dt.timedelta(minutes=3 * (i % 300)), [float(x) for x in centres[i % 5] + r.normal(size=8)]) for i in range(400)]
    rows += [(900, T0, None), (901, T0, [0.0] * 8), (902, T0, [1.0, 2.0]), (903, T0 + dt.timedelta(minutes=1), [1.0, 2.1])]
    got = {(x.a, x.b): x.cosine for x in D.cosine_pairs(spark.createDataFrame(rows, "vec_id long, ts timestamp, embedding array<double>"), least, block=16, pivots=4).collect()}
    want = {}
    for i, t, e in rows:
        for j, u, f in rows:
            if e and f and len(e) == len(f) and any(e) and any(f) and 0 <= (t - u).total_seconds() <= 14_400 and (u, j) < (t, i):
                c = float(np.dot(e, f) / np.linalg.norm(e) / np.linalg.norm(f))
                if min(1.0, max(0.0, c)) >= least:
                    want[i, j] = min(1.0, max(0.0, c))
    near = lambda keys: {k for k in keys if abs((want.get(k) or got.get(k)) - least) > 1e-9}
    assert near(got) == near(want) and len(got) > 100
    assert all(abs(got[k] - want[k]) < 1e-9 for k in near(got))


def test_ledger_and_versions(spark, tmp_path):
    book = Ledger(spark, str(tmp_path / "book"))
    assert book.numbers() == [] and book.last() is None
    for n in (0, 1, 7):
        book.put(n, {"n": n, "x": "é"})
    with pytest.raises(FileExistsError):
        book.put(7, {})
    assert book.numbers() == [0, 1, 7] and book.last() == (7, {"n": 7, "x": "é"}) and book.last(7)[0] == 1
    book.put(7, {"n": 8}, replace=True)
    book.delete([0])
    assert book.get(7) == {"n": 8} and book.numbers() == [1, 7]

    table = KeyedTable(spark, str(tmp_path / "t"), "k string, v long, at long", ["k"], "at", merge_after=2)
    frame = lambda rows: spark.createDataFrame(rows, "k string, v long, at long")
    read = lambda n=None: {x.k: x.v for x in table.read(n).collect()}
    assert read() == {}
    assert table.upsert(frame([("a", 1, 1), ("b", 2, 1), ("a", 5, 0)])) == 0 and read() == {"a": 1, "b": 2}
    assert table.upsert(frame([("b", 3, 2), ("c", 4, 2)])) == 1 and read() == {"a": 1, "b": 3, "c": 4}

    def fails():
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        table.upsert(frame([("a", 99, 9)]), before_commit=fails)
    assert read() == {"a": 1, "b": 3, "c": 4}  # a failed write leaves the old version
    for i in range(4):
        table.upsert(frame([("d", i, 10 + i)]))
    assert read() == {"a": 1, "b": 3, "c": 4, "d": 3} and read(0) == {"a": 1, "b": 2}


def test_decisions_are_made_once(spark, tmp_path):
    asked = []

    def decide(rows):
        asked.append(rows.count())
        return rows.select("id", F.concat(F.lit("d"), "text_hash").alias("decision"))

    rows = [(i, f"h{i % 5}", T0 + dt.timedelta(hours=i)) for i in range(20)]
    posts = spark.createDataFrame(rows, "id long, text_hash string, ts timestamp")
    known = K.decision_table(spark, str(tmp_path / "d"))
    first = K.decide_through_cache(posts.where("id < 10"), known, "v1", "m", 8 * 3600, decide).collect()
    second = {x.id: x for x in K.decide_through_cache(posts, known, "v1", "m", 8 * 3600, decide).collect()}
    assert not any(x.hit for x in first) and {x.decision for x in first} == {f"dh{i}" for i in range(5)}
    assert {i for i, x in second.items() if x.hit} == {i for i in range(20) if i - i % 5 <= 8 and i - i % 5 >= 0 and i - (i % 5) <= 8}
    assert all(x.decision == f"dh{i % 5}" for i, x in second.items()) and asked == [5, 5]
    other = K.decide_through_cache(posts, known, "v2", "m", 8 * 3600, decide).collect()
    assert not any(x.hit for x in other)


def test_sketch_is_within_its_error(spark):
    r = random.Random(5)
    rows = [(h, f"t{int(r.paretovariate(0.8)) % 3000}") for h in range(6) for _ in range(4000)]
    df = spark.createDataFrame(rows, "hour long, token string").repartition(4)
    exact = Counter(t for _, t in rows)
    got = K.merged_top(K.token_sketches(df, "hour", "token", 256), [F.lit(1).alias("all")], 8, 256).first()
    assert got.tokens == len(rows) and got.error == -(-len(rows) * 8 // (3 * 256))
    assert all(abs(x["count"] - exact[x["item"]]) <= got.error for x in got.top)
    top = {x.token: x.n for x in K.top_tokens(df.withColumn("all", F.lit(1)), "all", "token", 8).collect()}
    assert top == dict(sorted(exact.items(), key=lambda x: (-x[1], x[0]))[:8])
    sure = {t for t, n in exact.items() if n > got.error and n - got.error > sorted(exact.values())[-9]}
    assert sure <= {x["item"] for x in got.top}


def test_late_rows_are_caught_up_once(spark, tmp_path):
    at = str(tmp_path)
    schema = "channel_id string, id long, ts timestamp"
    file = lambda k, rows: spark.createDataFrame([("a", i, T0 + dt.timedelta(minutes=m)) for i, m in rows], schema).coalesce(1).write.parquet(f"{at}/in/{k}")
    stream = lambda: spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    go = lambda: late.late_stream(stream(), f"{at}/out", f"{at}/check").awaitTermination(120)
    file(0, [(1, 5), (2, 70)])  # closes windows up to 60
    go()
    file(1, [(3, 20), (4, 59), (5, 75), (6, 60)])  # 20, 59 and 60 are late
    go()
    first = late.catch_up(spark, f"{at}/out")
    assert {(x.window_end, x.posts) for x in first.collect()} == {(T0 + dt.timedelta(minutes=30), 1), (T0 + dt.timedelta(minutes=60), 2)}
    assert late.catch_up(spark, f"{at}/out") is None
    go()  # nothing new
    file(2, [(7, 30), (8, 61)])
    go()
    second = late.catch_up(spark, f"{at}/out").collect()
    assert {(x.window_end, x.posts) for x in second} == {(T0 + dt.timedelta(minutes=30), 1)}
    kept = {x.id for x in spark.read.parquet(f"{at}/out/in_time").collect()}
    assert kept == {1, 2, 5, 8}
    # a digest that was written but not recorded is made again, the same
    Ledger(spark, f"{at}/out/digests-done").delete([1])
    again = late.catch_up(spark, f"{at}/out")
    assert again.collect() == second


def test_names_of_several_words(spark):
    texts = ["Northern Bridge fell. Northern Bridge, says Anna", "Anna Bell met Anna. The Northern Bridge Authority", "at Dover Port and Calais", None, "Dover, Port. Dover"]
    posts = spark.createDataFrame([("c", i, t, i % 2 == 0) for i, t in enumerate(texts)], "channel_id string, id long, raw_text string, is_web boolean")
    runs, web = [], []
    for i, t in enumerate(texts):
        for run in re.findall(r"(?<!\S)[A-Z][a-z]{2,}(?: [A-Z][a-z]{2,})*(?=[ .,]|$)", t or ""):
            runs.append(tuple(run.split(" ")))
            web.append(i % 2 == 0)
    n = Counter(runs)
    want = Counter(runs)
    for run in [x for x, k in n.items() if k == 1]:
        for k in range(1, len(run)):
            for i in range(len(run) - k + 1):
                if run[i : i + k] in n:
                    want[run[i : i + k]] += 1
    got = {tuple(x.name.split(" ")): x.mentions for x in S.phrase_mentions(posts, "channel_id").collect()}
    assert got == dict(want) and got["Northern", "Bridge"] == 3 and got["Dover",] == 3
    best = S.subject_votes(posts, "channel_id").first()
    assert best.subject == "Northern Bridge" and best.words == 2


def test_long_runs_of_names_are_not_cut_into_all_parts(spark):
    """4,000 words and 800 lengths would be 3 million parts of 400 words in one row."""
    words = ["W" + chr(97 + i // 676) + chr(97 + i // 26 % 26) + chr(97 + i % 26) for i in range(4000)]
    names = [" ".join(words[5 * k % 3000 :][:k]) for k in range(1, 801)]
    posts = spark.createDataFrame([("c", " ".join(words))] + [("c", f"{n}. {n}.") for n in names], "channel_id string, raw_text string")
    got = {x.name: (x.words, x.mentions) for x in S.phrase_mentions(posts, "channel_id").collect()}
    assert got == {" ".join(words): (4000, 1)} | {n: (k, 3) for k, n in enumerate(names, 1)}


def test_spans_that_questions_state(spark):
    now = dt.datetime(2024, 3, 6, 1, 30)  # a Wednesday; the day before at New York
    cases = {
        "what happened in the last 6 hours": (6, 0), "past 2 days of strikes": (48, 0), "news 24h": (24, 0), "in the last hour": (1, 0), "past week": (168, 0), "last 90 minutes": (1.5, 0),
        "who is he": None, None: None, "7d of news today": (168, 0),
    }
    df = spark.createDataFrame([(q,) for q in cases], "q string")
    at = lambda h: now - dt.timedelta(hours=h)
    for x in df.select("q", Q.time_window(F.col("q"), F.lit(now))["since"].alias("a"), Q.time_window(F.col("q"), F.lit(now))["until"].alias("b")).collect():
        want = cases[x.q]
        assert (x.a, x.b) == ((None, None) if want is None else (at(want[0]), at(want[1]))), x.q
    days = spark.createDataFrame([("today",), ("yesterday",), ("this week",)], "q string")
    for zone, shift in (("UTC", 0), ("America/New_York", -5)):
        local = now + dt.timedelta(hours=shift)
        day = dt.datetime(local.year, local.month, local.day) - dt.timedelta(hours=shift)
        week = day - dt.timedelta(days=local.weekday())
        w = Q.time_window(F.col("q"), F.lit(now), zone)
        got = {x.q: (x.a, x.b) for x in days.select("q", w["since"].alias("a"), w["until"].alias("b")).collect()}
        assert got == {"today": (day, now), "yesterday": (day - dt.timedelta(days=1), day), "this week": (week, now)}


def test_alias_closure(spark):
    pairs = [("b", "a"), ("c", "b"), ("d", "c"), ("x", "y"), ("Z ", "z"), ("", "q"), (None, "r")]
    got = {x.name: x.root for x in Q.alias_closure(spark.createDataFrame(pairs, "alias string, name string")).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": "a", "x": "x", "y": "x", "z": "z"}
    p = Q.prepare(spark.createDataFrame([(1, "did ccc sink with ddd", ), (2, "xyz 24h 300")], "query_id long, question string"), "2024-01-02", aliases=spark.createDataFrame([("ccc", "bbb"), ("bbb", "aaa")], "alias string, name string"))
    got = {x.query_id: (x.aliases, x.numbers, x.direct) for x in p.collect()}
    assert got == {1: (["aaa", "bbb"], [], True), 2: ([], ["300"], False)}


def test_matcher_has_the_blocks_of_difflib_and_keeps_the_later_text():
    rng, built = random.Random(4), []

    class Counting(Z._Matcher):
        def set_seq2(self, b):
            built.append(b) if b != self.b else None
            super().set_seq2(b)

    words = ["the", "ouble", "tion", "zq", "q", "jx", "77", "é", "😀", " ", "of ", "a"]
    some = lambda n: "".join(rng.choice(words) for _ in range(n))
    later = [some(n) for n in (2, 30, 60, 199, 300, 900) for _ in range(6)] + ["a" * 199 + "b", "a" * 200, "ab" * 150]
    match = Counting()
    for y in later:
        for x in [some(3), some(20), some(90), y[len(y) // 3 :][:120], y[::-1]]:
            if x and y and x != y:
                assert Z._ratio(match, x, y) == SequenceMatcher(None, x, y).ratio()
                assert match.get_matching_blocks() == SequenceMatcher(None, x, y).get_matching_blocks()
    assert [b for b in built if b] == later


def test_profiles_count_characters_in_one_pass(spark):
    """Made of 38 replacements a text before, which the plan shows."""
    rows = [(1, "ab a0"), (2, ""), (3, None), (4, "é😀zZ"), (5, "퟿\n")]
    p = spark.createDataFrame(rows, "id long, t string").select("id", Z.profile(F.col("t")).alias("p"))
    for r in p.collect():
        t = dict(rows)[r.id] or ""
        each = [t.count(c) for c in Z.COUNTED]
        assert r.p == [*each, len(t) - sum(each)]
    assert "replace(" not in p._jdf.queryExecution().optimizedPlan().toString()


def test_squeezing_leaves_single_blanks_alone(spark):
    cases = [" a  b ", "a\tb", "a \n b", "\n\n", "", None, "a b c", "a( b)[c]|d", "x\x0b y", "é  é"]
    d = spark.createDataFrame(list(enumerate(cases)), "id long, t string")
    got = {r.id: r for r in d.select("id", T.squeeze(F.col("t")).alias("s"), rules.plain(F.col("t")).alias("p"), T.alphanumeric(F.col("t")).alias("k")).collect()}
    for i, t in enumerate(cases):
        assert got[i].s == (None if t is None else re.sub(r"[ \t\n\x0b\f\r]+", " ", t).strip(" "))
        assert got[i].p == re.sub(r"[ \t\n\x0b\f\r()\[\]{}|]+", " ", (t or "").lower()).strip(" ")
        assert got[i].k == (None if t is None else re.sub("[^a-z0-9]+", " ", t).strip(" "))
    # a text of single blanks has nothing to replace
    one = d.where("id = 6").select(F.regexp_count(F.col("t"), F.lit(T.SPACES.format(kinds=""))).alias("n"))
    assert one.first().n == 0


def test_moderation_searches_only_texts_that_hold_a_term(spark):
    texts = {1: "The thor, THOR and thorn met.", 2: "shtion  ouble court courts", 3: None, 4: "", 5: "th0r edst er hate", 6: "thorn"}
    d = spark.createDataFrame(list(texts.items()), "message_id long, raw_text string")
    m = rules.moderation(d, ["shtion ouble"], ["thor"], ["edst er"])
    got = {r.id: (r.frequency, r.hard_blocked) for r in m.collect()}
    assert got == {1: (2, False), 2: (0, True), 3: (None, None), 4: (0, False), 5: (3, False), 6: (0, False)}
    assert "contains(" in m._jdf.queryExecution().optimizedPlan().toString().lower()
