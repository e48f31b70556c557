import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from newsmill.llm import decontaminate, mixing, quality, sharding
from tests.llm import test_decontaminate, test_jaccard

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words int, shard string"


def test_quality_counts(spark):
    texts = [None, "", "a b c a b c", "the cat " * 40, "x" * 100_000, "a b c " * 5000, "l1 a\nl1 a\n\n \nl2", "# " * 60, " ".join(f"w{i % 97} the" for i in range(200)), "é😀 the of " * 30]
    rows = [(i, t, "en", "s", 1, 7, "x") for i, t in enumerate(texts)] + [(None, None, None, None, None, None, None), (1, "", "en", "s", 1, 7, "x")]
    got = quality.judge(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    for r in got:
        t = r.text or ""
        w = WORD.findall(t)
        n = Counter(zip(w, w[1:], w[2:]))
        hit = {i + k for i in range(len(w) - 2) if n[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit))
        assert r.base_failed == (len(w) < 50 or 100 * len(hit) > 50 * len(w)) and not (r.base_failed and r.kept)
    assert quality.keep_good(spark.createDataFrame(rows, SCHEMA)).columns[-2:] == ["n_words", "shard"]


def sainte_lague(votes, seats):
    won = Counter()
    for _ in range(seats):
        i = max(votes, key=lambda k: (votes[k] / (2 * won[k] + 1), votes[k], [-ord(c) for c in str(k)]))
        won[i] += 1
    return won


def test_apportion_equals_highest_quotients(spark):
    votes = {"a": 5300.0, "b": 2400.0, "c": 2300.0, "d": 7.0, "e": 0.0, "f": 1111.0}
    for seats in (0, 1, 7, 100, 1003):
        df = spark.createDataFrame([(0, k, v, seats) for k, v in votes.items()], "g int, name string, votes double, seats long")
        got = {r._name: r.quota for r in mixing.apportion(df, ["g"], F.col("name"), "votes", "seats").collect()}
        want = sainte_lague(votes, seats)
        assert got == {k: want[k] for k in votes}


def level(size, weights, share=1.5):
    goal, cap, left = share * sum(size.values()), {k: 2 * v for k, v in size.items()}, dict(weights)
    out = {}
    while left:
        rate = (goal - sum(out.values())) / sum(left.values())
        over = [k for k in left if left[k] * rate > cap[k]]
        if not over:
            return out | {k: w * rate for k, w in left.items()}
        for k in over:
            out[k] = float(cap[k])
            del left[k]
    return out


def test_mixing_plan_and_texts(spark):
    rows = [(i, " ".join(f"w{j}" for j in range((i * 37) % 90)), "en", ["big", "mid", "low", None, "zed"][min(4, i % 9)], 1, 7, "x") for i in range(900)]
    rows += [(5000, None, "en", "mid", 0, 0, None), (None, "a b c", None, None, None, None, None), (8, rows[8][1], "en", rows[8][3], 1, 7, "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    plan = mixing.plan(df).collect()
    assert len(plan) == len(rows) and sorted(map(str, plan)) == sorted(map(str, mixing.plan(df).collect()))
    size, taken, target = Counter(), Counter(), {}
    for r in plan:
        assert 0 <= r.taken <= 2 * r.size
        size[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    names = sorted([k for k in size if k is not None]) + [None]
    want = level(size, {k: (5, 2, 1)[i % 3] for i, k in enumerate(names)})
    for k in names:
        assert target[k] == pytest.approx(want[k]) and abs(taken[k] - want[k]) <= max(64, 0.02 * want[k])
    out = mixing.mix(df)
    assert out.columns == df.columns
    words = Counter()
    for r in out.collect():
        words[r.source] += len(WORD.findall(r.text))
    assert words == +taken
    assert mixing.plan(df.limit(0)).count() == 0 and mixing.mix(df.limit(0)).count() == 0


def test_shards(spark, tmp_path):
    rows = [(i, "copy of one text " * 3 if i % 3 == 0 else f"text {i} " * (i % 50), "en", "s", 1, 7, "x") for i in range(3000)] + [(None, None, None, None, None, None, None), (1, "text 1 ", "en", "s", 1, 7, "x")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = sharding.shard(df, 7, at=str(tmp_path / "map")).collect()
    assert len(got) == len(rows) and {r.law for r in got} == {"bytes"}
    slots, load, where = defaultdict(list), Counter(), defaultdict(set)
    for r in got:
        slots[r.shard].append(r.slot)
        load[r.shard] += r["size"]
        where[r.text_crc32].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(s) == 1 for s in where.values())
    largest = max(Counter(r.text_crc32 for r in got).values()) * 67
    assert max(load.values()) <= sum(load.values()) / 7 + largest
    assert sharding.versions(spark, str(tmp_path / "map")) == [0, 1]
    held = {r.vslot: r.shard for r in sharding.load_map(spark, str(tmp_path / "map")).collect()}
    grown = sharding.grow(held, dict.fromkeys(held, 10), 7)
    moved = [s for s in held if grown[s] != held[s]]
    assert moved and all(grown[s] == 7 for s in moved) and abs(len(moved) - len(held) / 8) <= 1
    assert sharding.shard(df.limit(0), 7).count() == 0


def test_stored_map_is_read_and_edited(spark, tmp_path):
    """Two runs over one map agree; growth moves rows into the new shard alone; drifted sizes edit the map."""
    rows = [(i, f"text {i} " * (i % 50)) for i in range(2500)]
    df, at = spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path / "map")
    run = lambda d, n: {r.doc_id: (r.shard, r.slot) for r in sharding.shard(d, n, at=at).collect()}
    one = run(df, 7)
    assert len(one) == len(rows) and run(df, 7) == one and sharding.versions(spark, at) == [0, 1]
    grown = run(df, 8)
    assert sharding.versions(spark, at) == [0, 1, 2] and run(df, 8) == grown and sharding.versions(spark, at) == [0, 1, 2]
    moved = {i for i in one if one[i][0] != grown[i][0]}
    assert moved and {grown[i][0] for i in moved} == {7}
    size = {i: 16 + len(t) for i, t in rows}
    load = Counter()
    for i, (s, _) in grown.items():
        load[s] += size[i]
    assert max(load.values()) <= 1.1 * sum(size.values()) / 8
    more = df.unionByName(spark.createDataFrame([(9000 + i, "heavy one " * 900 + str(i)) for i in range(60)], "doc_id long, text string"))
    drifted = run(more, 8)
    assert len(drifted) == len(rows) + 60 and sharding.versions(spark, at) == [0, 1, 2, 3] and run(more, 8) == drifted
    with pytest.raises(ValueError):
        run(df, 7)
    with pytest.raises(Exception, match="(?i)exist"):
        sharding.store_map(spark, {0: 0}, 3, at)


def test_shards_against_brute_force(spark):
    """Slots by size, largest first, each to its own shard while that has room, else to the smallest one, until that doesn't help."""
    df = spark.createDataFrame([(i, f"text {i % 700} " * (i % 61)) for i in range(2000)], "doc_id long, text string")
    recs = sharding.records(df, 64).collect()
    size = Counter()
    for r in recs:
        size[r.vslot] += r["size"]
    held = {s: s % 5 for s in range(64)}
    load = lambda m: [sum(size[s] for s in m if m[s] == i) for i in range(5)]
    while True:
        new, full = {}, [0] * 5
        for s in sorted(held, key=lambda s: (-size[s], s)):
            own = held[s]
            to = own if full[own] + size[s] <= 0.97 * sum(size.values()) / 5 else min(range(5), key=lambda i: (full[i], i))
            new[s] = to
            full[to] += size[s]
        if max(load(held)) - max(load(new)) <= 0.01 * sum(size.values()) / 5:
            break
        held = new
    where = {r.doc_id: held[r.vslot] for r in recs}
    got = sharding.shard(df, 5, 64).collect()
    assert {r.doc_id: r.shard for r in got} == where


def test_targets_of_huge_sources(spark):
    """Products of many sources and trillions of words don't overflow."""
    names = [f"s{i:05d}" for i in range(3000)]
    size = {k: 30_000_000_000_000 if i == 7 else 1 + i for i, k in enumerate(names)}
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(size.items()), "source string, source_size long")).collect()}
    assert got == pytest.approx(level(size, {k: (5, 2, 1)[i % 3] for i, k in enumerate(names)}))


def test_pipeline_stages(spark):
    at = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{at}/documents.parquet")
    one = corpus_pipeline.quality_rules(spark, docs, at)
    kept = {r.doc_id for r in quality.judge(docs).where("kept").collect()}
    assert one.columns == docs.columns and {r.doc_id for r in one.collect()} == kept
    rows = [(r.doc_id, r.text) for r in one.collect()]
    two = corpus_pipeline.near_duplicates(spark, one, at)
    groups = test_jaccard.brute(rows, 5, 80)
    assert sorted(str(r.doc_id) for r in two.collect()) == sorted({c for *_, c in groups})
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{at}/benchmark.parquet").collect()]
    three = corpus_pipeline.decontamination(spark, two, at)
    assert {r.doc_id for r in three.collect()} == {r.doc_id for r in two.collect() if not test_decontaminate.brute(r.text, items)[-1]}
    four = corpus_pipeline.mixing_sources(spark, three, at)
    taken = mixing.plan(three).agg(F.sum("taken")).first()[0]
    assert four.columns == docs.columns and sum(len(WORD.findall(r.text)) for r in four.collect()) == taken
    five = corpus_pipeline.shards(spark, four, at)
    assert five.count() == four.count()
    assert isinstance(decontaminate.SPAN, int)
