import random
import re

import pytest
from pyspark.sql import functions as F

from newsmill.llm import jaccard

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, width=3, percent=90):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    index = {}
    for i, s in enumerate(sets):
        for g in s:
            index.setdefault(g, []).append(i)
    for i, s in enumerate(sets):
        for j in {j for g in s for j in index[g] if j < i}:
            if 100 * len(s & sets[j]) >= percent * len(s | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted((str(d), len(s), str(least.get(find(i)) if s else d)) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def check(spark, rows, **how):
    got = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string"), **how).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute(rows, **{k: v for k, v in how.items() if k != "frequent"})
    return got


@pytest.mark.parametrize("how", [{"frequent": 1}, {}, {"width": 5, "percent": 80, "frequent": 2}])
def test_copies_passages_and_edges(spark, how):
    r = random.Random(4)
    vocab = [f"w{i}" for i in range(3000)]
    say = lambda n: [r.choice(vocab) for _ in range(n)]
    rows, passage = [], say(60)
    for n in (1, 2, 3, 9, 11, 12, 13, 25, 60, 150, 700):
        base = say(n)
        for _ in range(14):
            w = list(base)
            for _ in range(r.randint(0, 1 + n // 50)):
                w[r.randrange(len(w))] = r.choice(vocab)
            rows.append(" ".join(w if r.random() < 0.7 else w + say(1)))
    rows += [" ".join(passage + say(r.choice([3, 8, 40]))) for _ in range(40)]
    rows += ["A b\tC", "a B c", "", None, "  ", "x " * 3000, "X " * 2999]
    rows = [(i, t) for i, t in enumerate(rows)]
    rows += [(None, rows[20][1]), (None, "lonely text here"), (3, rows[3][1]), (None, None)]
    got = check(spark, rows, **how)
    assert len({x.component_id for x in got}) < len(got) - 50


def test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    check(spark, rows)
    kept = jaccard.keep_one(docs.withColumn("n", F.lit(1)))
    assert kept.columns == [*docs.columns, "n"] and kept.count() == len({c for *_, c in brute(rows)})
    assert jaccard.join(docs.limit(0)).count() == 0
