import hashlib
import random
import re

import pytest

from newsmill.llm import decontaminate

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall((t or "").encode().lower())


def brute(text, items):
    w = words(text)
    hit, ids = set(), set()
    for item, t in items:
        v = words(t)
        n = min(10, len(v))
        wins = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if v else set()
        for i in range(len(w) - n + 1):
            if tuple(w[i : i + n]) in wins:
                hit |= set(range(i, i + n))
                ids.add("" if item is None else str(item))
    return len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("block", [5, 2_000_000])
def test_small_cases(spark, block):
    r = random.Random(3)
    vocab = [f"w{i}" for i in range(12)] + ["Éa", "ß", "x1"]
    say = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    items = [(i, say(r.choice([0, 1, 3, 9, 10, 11, 30]))) for i in range(12)] + [(None, say(15)), (3, say(20)), (20, None), (21, "")]
    docs = [(i, say(r.choice([0, 5, 40])) + " " + (r.choice(items)[1] or "").upper().replace(" ", ", ") + " " + say(9)) for i in range(60)]
    docs += [(100, None), (101, ""), (101, ""), (None, say(12)), (102, "a " * 30_000 + say(30)), (103, "z" * 70_000)]
    got = decontaminate.report(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block).collect()
    want = sorted((str(d), *brute(t, items)) for d, t in docs)
    assert sorted((str(x.doc_id), *x[1:]) for x in got) == want
    assert any(x[-1] for x in want)


def test_table_and_empty_benchmark(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(300)
    bench = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    items = [(r.item_id, r.text) for r in bench.collect()]
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = decontaminate.report(docs, bench).collect()
    for x in rows:
        assert tuple(x[1:]) == brute(texts[x.doc_id], items)
    none = decontaminate.drop_contaminated(docs.withColumn("n_words", docs.doc_id), bench.limit(0))
    assert none.count() == docs.count() and "n_words" in none.columns


def test_items_without_words_dont_count_towards_the_broadcast(spark):
    items = spark.createDataFrame([(i, t) for i, t in enumerate([None] * 400 + ["", " ..\n"] * 200 + ["one two three"])], "item_id long, text string")
    assert decontaminate._items(items).count() == 1 and decontaminate.fits(items, 20)
    docs = spark.createDataFrame([(1, "so one two three it is"), (2, None)], "doc_id long, text string")
    assert {(r.doc_id, r.n_items) for r in decontaminate.report(docs, items).collect()} == {(1, 1), (2, 0)}
