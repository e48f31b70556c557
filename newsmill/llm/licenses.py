"""License scans by a trained paragraph classifier.

A paragraph is a run of lines without a blank one, up to a line that ends a sentence; so wrapped notices are judged whole
and a notice that is a line of its own isn't lost among others. Where a paragraph of several lines shows no licence, its
lines are judged one by one as well. Sparse counts of its word 1- and 2-grams (hashed) feed a softmax regression over
licence families and a class of other prose. It is trained in numpy on the driver from a bounded sample: the families'
own notices and paragraphs with words left out or added by a seeded generator (PER_FAMILY each), lines of the corpus that
name a licence and resemble exactly one family (at most SAMPLE), and other lines (at most SAMPLE), both in hash order.

A held-out fifth calibrates it: a temperature makes probabilities honest, and the bar for any licence is set where at
most FALSE of the held-out prose passes. The class of unknown licences is calibrated by leaving families out: FOLDS
models, each without a part of the families, show how sure the model is of a family that it knows and of one that it
doesn't; the bar between the two is where both are told apart best, and at most UNSURE of the held-out known ones fall
below it. A prediction is also compared with the family's notices (CONFIRM of the smaller side's 2-grams shared). A
paragraph that passes the bar for any licence, but not these two, is of an unknown licence.

All paragraphs of all documents are scored, batch by batch, in numpy; the broadcast model has a fixed size.

Defined results: null and empty texts have no paragraphs; rows are scored one by one, so repeats and null ids keep a
row each; of equally likely families the first by name is taken; texts in any script are words to the model; an empty
table gives no rows; other columns aren't read.
"""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsmill.llm import wordhash
from newsmill.llm.common import first_by_hash, release, stage

BITS = 16
SAMPLE = 2000
#: Lengths of the corpus lines that the model may be fitted on; lines of any length are judged.
TRAINED = (8, 2000)
PER_FAMILY = 120
FALSE = 0.002
CONFIRM = 0.6
SEED = 7
OTHER = "other"
#: Parts of the families that are left out in turn, and the rounds that those models are fitted for.
FOLDS, FOLD_ROUNDS = 4, 60
#: The share of held-out paragraphs of known families that may be taken for unknown ones.
UNSURE = 0.02
#: A line that ends a sentence ends its paragraph.
SENTENCE_END = r"""[.!?:;]["')\]]*\s*$"""
#: The notices by which licences are declared, and the paragraphs that stand at the head of files.
NOTICES = {
    "AGPL-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
        "Licensed under the GNU Affero General Public License, version 3.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
        "Released under the 3-clause BSD License.",
    ],
    "CC-BY": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0."],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    ],
    "LGPL": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
        "Licensed under the GNU Lesser General Public License, version 3.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY.',
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License, version 2.0.",
    ],
    "Proprietary": ["All rights reserved. No part of this work may be reproduced without prior written permission of the publisher.", "Confidential and proprietary. Unauthorized copying is strictly prohibited."],
}
CLASSES = [*NOTICES, OTHER]


def features(lines: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all lines in order, and where each line's begin; 1-grams and 2-grams, one number a word at least."""
    h, first = wordhash.words(lines, wordhash.ALNUM)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    two = wordhash.grams(h, 2)
    ok = row[: len(two)] == row[1:][: len(two)]
    keys = np.concatenate([wordhash.mix(h), two[ok]]) >> np.uint64(64 - BITS)
    rows = np.concatenate([row, row[: len(two)][ok]])
    order = np.argsort(rows, kind="stable")
    return keys[order].astype(np.int64), np.searchsorted(rows[order], np.arange(len(first)))


def _scores(weights: np.ndarray, bias: np.ndarray, f: np.ndarray, first: np.ndarray) -> np.ndarray:
    out = np.zeros((len(first) - 1, len(bias)), np.float32)
    n = np.diff(first)
    some = np.flatnonzero(n)
    if len(some):
        out[some] = np.add.reduceat(weights[f], first[:-1][some], axis=0) / np.sqrt(n[some])[:, None]
    return out + bias


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def bigrams(text: str) -> set:
    h, _ = wordhash.words(pa.array([text]), wordhash.ALNUM)
    return set(wordhash.grams(h, 2).tolist() if len(h) > 1 else h.tolist())


_NOTICE_GRAMS = {k: [bigrams(t) for t in v] for k, v in NOTICES.items()}


def resemblance(family: str, text: str) -> float:
    """The largest share of 2-grams that a notice of the family and the text have in common, of the smaller side's."""
    mine = bigrams(text)
    return max((len(mine & g) / max(1, min(len(mine), len(g))) for g in _NOTICE_GRAMS[family]), default=0.0) if mine else 0.0


def fit(texts: list[str], y: np.ndarray, rounds: int = 150, rate: float = 2.0, decay: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases of a softmax regression by gradient descent; classes count alike, whatever their sizes."""
    f, first = features(pa.array(texts, pa.string()))
    row, n = np.repeat(np.arange(len(texts)), np.diff(first)), np.maximum(1, np.diff(first))
    used, f = np.unique(f, return_inverse=True)
    w, bias = np.zeros((len(used), len(CLASSES)), np.float32), np.zeros(len(CLASSES), np.float32)
    order = np.argsort(f, kind="stable")
    start, row = np.searchsorted(f[order], np.arange(len(used))), row[order]
    share = (1 / np.sqrt(n)).astype(np.float32)
    weigh = 1 / np.maximum(1, np.bincount(y, minlength=len(CLASSES)))[y]
    weigh = (weigh / weigh.sum()).astype(np.float32)
    for _ in range(rounds):
        p = _softmax(_scores(w, bias, f, first))
        p[np.arange(len(y)), y] -= 1
        g = p * weigh[:, None]
        if len(used):
            w -= rate * (np.add.reduceat((g * share[:, None])[row], start, axis=0) * 10 + decay * w)
        bias -= rate * g.sum(axis=0)
    weights = np.zeros((1 << BITS, len(CLASSES)), np.float32)
    weights[used] = w
    return weights, bias


def certainty(p: np.ndarray) -> np.ndarray:
    """The likeliest family's share of all families' probability."""
    return p.max(axis=1) / np.maximum(1e-12, p.sum(axis=1))


class Model:
    def __init__(self, texts: list[str], labels: list[int], seed: int = SEED):
        order = np.random.default_rng(seed).permutation(len(texts))
        held, inside = order[: len(order) // 5], order[len(order) // 5 :]
        y, other = np.array(labels), len(CLASSES) - 1
        of = lambda at: [texts[i] for i in at]
        self.weights, self.bias = fit(of(inside), y[inside])
        z = self.scores(pa.array(of(held), pa.string()))
        grid = [0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0]
        loss = [-np.log(np.maximum(1e-9, _softmax(z / t)[np.arange(len(held)), y[held]])).mean() if len(held) else 0 for t in grid]
        self.temperature = grid[int(np.argmin(loss))]
        got = _softmax(z / self.temperature)
        prose = 1 - got[y[held] == other][:, -1]
        self.bar = float(max(0.5, np.quantile(prose, 1 - FALSE) if len(prose) else 0.5))
        self.accuracy = float((got.argmax(axis=1) == y[held]).mean()) if len(held) else 1.0
        known, strange = [], []
        for part in range(FOLDS):
            out = np.arange(other) % FOLDS == part
            away = np.append(out, False)[y]
            near = inside[~away[inside]]
            weights, bias = fit(of(near), y[near], FOLD_ROUNDS)
            for at, to in ((held[~away[held] & (y[held] != other)], known), (np.flatnonzero(away), strange)):
                p = _softmax(_scores(weights, bias, *features(pa.array(of(at), pa.string()))) / self.temperature)
                to.append(certainty(p[:, :-1][:, ~out]))
        known, strange = np.concatenate(known), np.concatenate(strange)
        bars = np.unique(np.concatenate([known, strange]))
        apart = np.searchsorted(np.sort(strange), bars) / max(1, len(strange)) - np.searchsorted(np.sort(known), bars) / max(1, len(known))
        mine = certainty(got[y[held] != other][:, :-1])
        #: below this certainty a licence is of no known family; the shares of left-out and of known paragraphs below it
        self.sure = float(min(bars[apart.argmax()], np.quantile(mine, UNSURE))) if len(bars) and len(mine) else 0.5
        self.strange_below, self.known_below = float((strange < self.sure).mean()) if len(strange) else 0.0, float((mine < self.sure).mean()) if len(mine) else 0.0

    def scores(self, lines: pa.Array) -> np.ndarray:
        return _scores(self.weights, self.bias, *features(lines))

    def judge(self, lines: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The likeliest family of each text, -1 where none passes the bar, and whether its certainty is that of a known family."""
        p = _softmax(self.scores(lines) / self.temperature)
        best = p[:, :-1].argmax(axis=1)
        return np.where(1 - p[:, -1] > self.bar, best, -1), certainty(p[:, :-1]) >= self.sure

    def judge_all(self, lines: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As judge, a few thousand texts at a time."""
        got = [self.judge(lines.slice(i, 4096)) for i in range(0, len(lines), 4096)]
        return (np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])) if got else (np.zeros(0, int), np.zeros(0, bool))

    def name(self, kind: int, sure: bool, text: str) -> str:
        return CLASSES[kind] if sure and resemblance(CLASSES[kind], text) >= CONFIRM else "unknown"


def paragraphs(lines: pa.Array, owner: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The paragraphs of texts' lines (owner: each line's text, ascending), the numbers of their lines, and where each one's begin."""
    filled = pc.match_substring_regex(lines, r"\S").to_numpy(zero_copy_only=False)
    ends = pc.match_substring_regex(lines, SENTENCE_END).to_numpy(zero_copy_only=False)
    fresh = np.ones(len(lines), bool)
    fresh[1:] = (owner[1:] != owner[:-1]) | ~filled[:-1] | ends[:-1]
    at = np.flatnonzero(filled)
    first = np.append(np.flatnonzero(fresh[at]), len(at))
    runs = pa.LargeListArray.from_arrays(pa.array(first, pa.int64()), lines.take(pa.array(at)))
    return pc.binary_join(runs, pa.scalar(" ", lines.type)), at, first


def train(docs: DataFrame, sample: int = SAMPLE, seed: int = SEED) -> Model:
    r = random.Random(seed)
    texts, labels = [], []
    for i, notices in enumerate(NOTICES.values()):
        for k in range(PER_FAMILY):
            w = notices[k % len(notices)].split()
            w = [x for x in w if r.random() > 0.08] or w
            texts.append(" ".join(w if k % 3 else [*w, *r.sample(w, min(3, len(w)))]))
            labels.append(i)
    lines = docs.select(F.explode(F.array_distinct(F.split(F.coalesce("text", F.lit("")), "\n", -1))).alias("line")).where(F.length("line").between(*TRAINED))
    named = F.col("line").rlike("(?i)licen[sc]|copyright|creative commons|all rights reserved")
    share = min(1.0, 16 * sample / max(1, docs.count()))  # a hash part of the other lines that holds a few times the sample
    some = F.pmod(F.xxhash64("line", F.lit(1)), F.lit(1 << 20)) < int(share * (1 << 20))
    lines = stage(lines.where(named | some).withColumn("named", named), "licence-lines")
    for t in first_by_hash(lines.where("named"), "line", sample):
        alike = sorted(((resemblance(k, t), i) for i, k in enumerate(NOTICES)), reverse=True)
        if alike[0][0] >= 0.8 > alike[1][0]:
            texts.append(t)
            labels.append(alike[0][1])
    plain = first_by_hash(lines.where("NOT named"), "line", sample)
    release(lines)
    texts += plain or ["the quick brown fox jumps over the lazy dog"] * 8
    labels += [len(CLASSES) - 1] * (len(texts) - len(labels))
    return Model(texts, labels, seed)


def scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, n_paragraphs, n_licensed, n_unknown, families (sorted, comma-joined), lines (number of a paragraph's first line:family, comma-joined)."""
    model = model or train(docs)
    held = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def run(batches):
        m = held.value
        for big in batches:
            for at in range(0, big.num_rows, 512):
                batch = big.slice(at, 512)
                parts = pc.split_pattern(batch.column(1).cast(pa.large_string()), "\n")
                lines, owner = pc.list_flatten(parts), pc.list_parent_indices(parts).to_numpy(zero_copy_only=False)
                start = np.searchsorted(owner, np.arange(batch.num_rows))
                texts, line, first = paragraphs(lines, owner)
                kind, sure = m.judge_all(texts)
                got: list[list] = [[] for _ in range(batch.num_rows)]
                for i in np.flatnonzero(kind >= 0).tolist():
                    n = line[first[i]]
                    got[owner[n]].append((int(n - start[owner[n]]), m.name(kind[i], sure[i], texts[i].as_py())))
                single = line[np.repeat((kind < 0) & (np.diff(first) > 1), np.diff(first))]
                kind, sure = m.judge_all(lines.take(pa.array(single)))
                for i in np.flatnonzero(kind >= 0).tolist():
                    n = single[i]
                    got[owner[n]].append((int(n - start[owner[n]]), m.name(kind[i], sure[i], lines[n].as_py())))
                for g in got:
                    g.sort()
                filled = np.bincount(owner[line[first[:-1]]], minlength=batch.num_rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array(filled, pa.int64()),
                        pa.array([sum(k != "unknown" for _, k in g) for g in got], pa.int64()),
                        pa.array([sum(k == "unknown" for _, k in g) for g in got], pa.int64()),
                        pa.array([",".join(sorted({k for _, k in g} - {"unknown"})) for g in got], pa.string()),
                        pa.array([",".join(f"{i}:{k}" for i, k in g) for g in got], pa.string()),
                    ],
                    names=["doc_id", "n_paragraphs", "n_licensed", "n_unknown", "families", "lines"],
                )

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_paragraphs long, n_licensed long, n_unknown long, families string, lines string")
