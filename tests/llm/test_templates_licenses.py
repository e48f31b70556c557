import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from newsmill.llm import licenses, templates


def brute(texts, min_docs=10, constant=70):
    """For each text the numbers of its dropped lines."""
    toks = lambda l: re.findall(r"[^\x20\x09-\x0D]+", l)  # noqa: E731,E741
    mask = lambda t: "<*>" if re.search("[0-9]", t) else t
    leaf = lambda l: (len(toks(l)), *map(mask, toks(l)[:3]))  # noqa: E731,E741
    norm = lambda l: " ".join(toks(l))  # noqa: E731,E741
    docs = [[norm(x) for x in (t or "").split("\n") if len(toks(x)) >= 4] for t in texts]
    n_leaf = Counter(k for d in docs for k in {leaf(x) for x in d})
    line_docs = defaultdict(set)
    for i, d in enumerate(docs):
        for x in set(d):
            if n_leaf[leaf(x)] >= min_docs:
                line_docs[x].add(i)
    seen = Counter()
    for x, ts in line_docs.items():
        for p, t in enumerate(toks(x)):
            if not re.search("[0-9]", t):
                seen[leaf(x), p, t] += len(ts)
    shape, n = {}, defaultdict(set)
    for x in line_docs:
        t = [t if seen[leaf(x), p, t] >= min_docs else "<*>" for p, t in enumerate(toks(x))]
        if 100 * sum(seen[leaf(x), p, y] >= min_docs for p, y in enumerate(toks(x))) >= constant * len(t):
            shape[x] = (leaf(x), tuple(t))
    for i, d in enumerate(docs):
        for x in d:
            if x in shape:
                n[shape[x]].add(i)
    return [[x for x in (t or "").split("\n") if not (norm(x) in shape and len(n[shape[norm(x)]]) >= min_docs)] for t in texts]


def test_templates_against_brute_force(spark):
    r = random.Random(1)
    say = lambda n: " ".join(r.choice("abcdefghijklmnopqrstuvwxyz") * 3 + str(r.choice(["", "x"])) for _ in range(n))
    texts = []
    for i in range(60):
        lines = [say(12), f"user {i} logged in from host {r.choice(['alpha', 'beta', 'g' + str(i)])} today at noon", say(3)]
        if i % 4 == 0:
            lines.append("Subscribe to our letter now")
        texts.append("\n".join(lines + ["", say(20)]))
    texts += [None, "", "\n\n", "user 7 logged in from host alpha today at noon"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n", F.lit(1))
    got = {x.doc_id: x for x in templates.drop_lines(df).collect()}
    assert len(got) == len(texts)
    for i, (t, kept) in enumerate(zip(texts, brute(texts), strict=True)):
        assert got[i].text == (None if t is None else "\n".join(kept))
    assert sum(x.n_dropped for x in got.values()) > 60
    assert templates.drop_lines(df.limit(0)).count() == 0


def test_templates_on_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.orderBy("doc_id").collect()
    got = {x.doc_id: x.text for x in templates.drop_lines(docs).collect()}
    for x, kept in zip(rows, brute([x.text for x in rows]), strict=True):
        assert got[x.doc_id] == "\n".join(kept)


def _say(r, n):
    return " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(n))


def test_long_lines_of_two_different_documents(spark):
    r = random.Random(3)
    passage, common, copied, middle = (_say(r, n) for n in (60, 50, 70, 49))
    body = [[_say(r, 12) for _ in range(20)] for _ in range(5)]
    near = [" ".join(x.split()[:-1]) for x in body[2]]
    texts = [[passage, *body[0]], [*body[1], "  " + passage.replace(" ", "  ", 1), middle], [copied, *body[2]], [copied, *near], [copied, *near], [middle, common, *body[3]], [common, *body[4]], [common, *body[4][::-1]]]
    df = spark.createDataFrame([(i, "\n".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {x.doc_id: x for x in templates.drop_lines(df).collect()}
    assert [got[i].n_dropped for i in range(8)] == [1, 1, 0, 0, 0, 1, 1, 1]
    assert got[0].text == "\n".join(body[0]) and got[1].text == "\n".join([*body[1], middle])
    assert got[2].text == "\n".join(texts[2])


def test_short_lines_that_recur(spark):
    r = random.Random(4)
    texts = [[_say(r, 9), "All rights reserved.", f"Page {i}", "Page 7"] + ["Rare line."] * (i < 29) for i in range(30)]
    df = spark.createDataFrame([(i, "\n".join([*t, ""])) for i, t in enumerate(texts)], "doc_id long, text string")
    for x in templates.drop_lines(df).collect():
        t = texts[x.doc_id]
        assert x.text == "\n".join([t[0], *([] if x.doc_id == 7 else [t[2]]), *t[4:], ""])


def test_licenses(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = licenses.train(docs)
    assert model.accuracy > 0.95
    named = {r.doc_id: r.text for r in docs.collect()}
    truth = {"Apache License, Version 2.0": "Apache-2.0", "MIT License": "MIT", "GNU General Public License": "GPL", "CC BY-NC 4.0": "CC-BY-NC"}
    got = licenses.scan(docs, model).collect()
    assert len(got) == len(named)
    want = {i: {v for k, v in truth.items() if k in t} for i, t in named.items()}
    right = sum(set(filter(None, x.families.split(","))) == want[x.doc_id] for x in got)
    assert right >= 0.99 * len(got) and sum(map(bool, want.values())) > 10
    odd = spark.createDataFrame([(None, "Released under the MIT License."), (1, None), (2, ""), (3, "x " * 100_000), (3, "x " * 100_000)], "doc_id long, text string")
    out = {(x.doc_id, x.families) for x in licenses.scan(odd, model).collect()}
    assert (None, "MIT") in out and (1, "") in out and (3, "") in out
    assert licenses.scan(odd.limit(0), model).count() == 0


#: Licences of no family that the model knows.
OUTSIDE = [
    "Licensed under the European Union Public Licence, version 1.2 or later.",
    "Boost Software License, Version 1.0. Permission is granted to use, reproduce, display, distribute, execute, and transmit the software.",
    "This file is licensed under the Eclipse Public License, version 2.0, which accompanies this distribution.",
    "This work is licensed under the Open Data Commons Open Database License.",
    "Licensed under the Academic Free License, version 3.0.",
    "This package is free software; you can redistribute it and/or modify it under the terms of the Artistic License.",
    "The terms of the Microsoft Reciprocal License apply to this software and its documentation.",
    "Distributed under the terms of the Common Development and Distribution License.",
]


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


def brute_paragraphs(text):
    """(number of its first line, its lines) of each paragraph."""
    out, open_ = [], False
    for i, x in enumerate((text or "").split("\n")):
        if not x.strip(" \t\r\f\v"):
            open_ = False
            continue
        if open_:
            out[-1][1].append(x)
        else:
            out.append((i, [x]))
        open_ = not re.search(r"""[.!?:;]["')\]]*[ \t\r\f\v]*$""", x)
    return out


def brute_scan(model, text):
    """What scan finds, by plain loops: paragraph by paragraph, word by word."""

    def one(t):
        w = words_of(t)
        grams = [(x,) for x in w] + list(zip(w, w[1:], strict=False))
        z = [float(b) for b in model.bias]
        for g in grams:
            number = licenses.features(pa.array([" ".join(g)]))[0][-1]
            for k in range(len(z)):
                z[k] += float(model.weights[number, k]) / math.sqrt(len(grams))
        top = max(z)
        e = [math.exp((x - top) / model.temperature) for x in z]
        p = [x / sum(e) for x in e]
        if 1 - p[-1] <= model.bar:
            return None
        k = max(range(len(p) - 1), key=lambda i: (p[i], -i))
        mine = set(zip(w, w[1:], strict=False)) or set(w)
        alike = max(len(mine & n) / min(len(mine), len(n)) for n in (set(zip(words_of(t), words_of(t)[1:], strict=False)) for t in licenses.NOTICES[licenses.CLASSES[k]]))
        return licenses.CLASSES[k] if p[k] / sum(p[:-1]) >= model.sure and alike >= licenses.CONFIRM else "unknown"

    found, parts = [], brute_paragraphs(text)
    for i, lines in parts:
        whole = one(" ".join(lines))
        if whole:
            found.append((i, whole))
        elif len(lines) > 1:
            numbers = [j for j, x in enumerate(text.split("\n")) if j >= i and x.strip()][: len(lines)]
            found += [(j, k) for j, k in zip(numbers, map(one, lines), strict=True) if k]
    return len(parts), ",".join(f"{i}:{k}" for i, k in sorted(found))


def test_license_scan_against_brute_force(spark):
    r = random.Random(5)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = licenses.train(docs)
    prose = [x for d in docs.limit(30).collect() for x in d.text.split("\n")[:4]]
    wrap = lambda t, n: re.sub(rf"(.{{{n},}}?) ", r"\1\n", t)
    notices = [t for v in licenses.NOTICES.values() for t in v]
    texts = [None, "", "\n \n\n", "Released under the MIT License.", "日本語の文章です。\nMIT ライセンス", "\u0645\u0631\u062d\u0628\u0627 " * 40]
    for i, t in enumerate([*notices, *OUTSIDE]):
        parts = [r.choice(prose), wrap(t, 40) if i % 2 else t, r.choice(prose)[:200]]
        texts.append(("\n\n" if i % 3 else "\n").join(parts))
    texts.append("no end here\nReleased under the MIT License\nand no end there\n" + "\n".join(["words of no kind"] * 30))
    texts += texts[3:9]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("lines", F.lit("clash")).repartition(5)
    got = {x.doc_id: x for x in licenses.scan(df, model).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        n, lines = brute_scan(model, t)
        assert (got[i].n_paragraphs, got[i].lines) == (n, lines), t
        kinds = [x.split(":")[1] for x in lines.split(",") if x]
        assert (got[i].n_licensed, got[i].n_unknown) == (sum(k != "unknown" for k in kinds), kinds.count("unknown"))
        assert got[i].families == ",".join(sorted(set(kinds) - {"unknown"}))


def test_wrapped_notices_and_unknown_licences(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = licenses.train(docs)
    assert model.known_below <= licenses.UNSURE + 0.01 and 0 < model.sure < 1
    rows = [(k, re.sub(r"(.{35,}?) ", r"\1\n", t)) for k, v in licenses.NOTICES.items() for t in v]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {x.doc_id: x for x in licenses.scan(df, model).collect()}
    right = sum(k in got[i].families.split(",") for i, (k, _) in enumerate(rows))
    assert right >= 0.9 * len(rows)
    out = licenses.scan(spark.createDataFrame(list(enumerate(OUTSIDE)), "doc_id long, text string"), model).collect()
    assert sum(x.n_unknown > 0 for x in out) >= 0.7 * len(OUTSIDE)
    assert sum(x.n_licensed > 0 for x in out) <= 1


def test_license_features_are_counts():
    """Equal counts of 1- and 2-grams give equal features, others don't."""
    lines = ["a b c a b", "A b C a B", "b a b c a", "", "ä 日本 x1", "a"]
    f, first = licenses.features(pa.array(lines))
    sets = [tuple(np.sort(f[first[i] : first[i + 1]])) for i in range(len(lines))]
    assert sets[0] == sets[1] and sets[0] != sets[2] and sets[3] == () and len(sets[4]) == 5 and len(sets[5]) == 1
