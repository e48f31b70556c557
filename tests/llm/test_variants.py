import random
import re
import zlib
from collections import Counter

import pytest

from newsmill.llm import variants


def one_apart(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    s, t = sorted((a, b), key=len)
    return any(t[:i] + t[i + 1 :] == s for i in range(len(t)))


def brute_words(rows, noise=31):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = run.translate(low)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if noise and h % noise == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                n[run] += 1
    return {w: k for w, k in n.items() if k >= 2}


def brute_group(n):
    near = {w: [v for v in n if one_apart(w, v)] for w in n}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def rows_of(df):
    return [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]


def test_against_brute_force(spark):
    r = random.Random(3)
    base = ["".join(r.choice("abcdé") for _ in range(r.randint(7, 11))) for _ in range(40)]

    def bent(w):
        i, c = r.randrange(len(w)), r.choice("abcdéÿ")
        return r.choice((w[:i] + w[i + 1 :], w[:i] + c + w[i:], w[:i] + c + w[i + 1 :], w.upper(), w))

    rows = [(i, " ".join(bent(r.choice(base)) if r.random() < 0.3 else r.choice(base) for _ in range(60))) for i in range(80)]
    long = "xy" * 5000
    rows += [(900, None), (901, ""), (None, f"{long} {long}z {base[0]}"), (902, f"{long} {long}z, {long[1:]} {long[1:]}"), (903, "ÀÉÎÕÜ ÀÉÎÕÜßx ÀÉÎÕÜßx Àéîõüßx×÷ a" + "\U0001f600" + "bcdefgh bcdefgh"), (5, rows[5][1]), (5, rows[5][1])]
    docs = spark.createDataFrame([(a, b, "x", "y") for a, b in rows], "doc_id long, text string, word string, n string").repartition(3)
    n = brute_words(rows)
    assert {(x.word, x.n) for x in variants.words(docs).collect()} == set(n.items())
    want = brute_group(n)
    got = rows_of(variants.group(variants.words(docs)))
    assert len(got) == len(want) and set(got) == want and any(x[1] for x in got) and any(x[4] > 2 for x in got)
    # small cells and blocks: every bucket is split
    split = rows_of(variants.group(variants.words(docs), bucket=3, block=16))
    assert sorted(split, key=str) == sorted(got, key=str)
    assert rows_of(variants.group(variants.words(docs.limit(0)))) == []


def test_one_bucket_holds_most_words(spark):
    """Words that all share their first half, and chains of forms."""
    r = random.Random(4)
    n = {f"commonhead{''.join(r.choice('ab') for _ in range(8))}": r.randint(2, 30) for _ in range(150)}
    n |= {"abcdefgh": 10**6, "abcdefghi": 10**5, "abcdefghij": 10**4, "abcdefghijk": 10**3, "abcdefghijkl": 100, "abcdefghijklm": 10, "zabcdefgh": 10**5}
    vocabulary = spark.createDataFrame(list(n.items()), "word string, n long")
    got = rows_of(variants.group(vocabulary, bucket=16))
    assert len(got) == len(n) and set(got) == brute_group(n)
    assert {x[0]: x[2] for x in got}["abcdefghijklm"] == "abcdefgh"


def test_one_error_on_short_words_and_ties(spark):
    words = ["a", "b", "ab", "ba", "abc", "acb", "aab", "aba", "bab", "c" * 130, "c" * 131, "c" * 129 + "d"] + [f"q{i:03d}" for i in range(200)]
    got = {(words[q], words[i]) for pairs in variants.one_error(words, words) for q, i in zip(*pairs, strict=True)}
    assert got == {(a, b) for a in words for b in words if one_apart(a, b)}
    with pytest.raises(ValueError):
        variants.group(None, ratio=1)
    tied = spark.createDataFrame([("aaaaaaa", 2), ("aaaaaab", 20), ("aaaaaaé", 20), ("zaaaaaaa", 19)], "word string, n long")
    assert {x[0]: x[1] for x in rows_of(variants.group(tied))}["aaaaaaa"] == "aaaaaab"
