"""Secret scans by grammar inference.

Labelled credentials (a bounded, hash-ordered sample of the base matches, at most SAMPLE a kind; an assigned value that
has the format of another kind is that kind's) form a prefix tree for each kind. Prefixes that fewer than RARE samples
have carry too little evidence to be compared; they are pooled by their length, so that length and position aren't
lost. States whose symbol and end frequencies, and those of what follows them, agree within a Hoeffding bound are then
merged into a probabilistic automaton (the ALERGIA scheme). Background automata are inferred in the same way from the
corpus's own tokens that can't be told from ordinary writing, one for each class of them: numbers, times, words, paths.

Every candidate token of the corpus, SHORTEST characters or more of the credential alphabet, is scored over all its
characters by all automata at once; it becomes a span of the likeliest kind where its mean log-likelihood beats every
background by MARGIN bits a symbol and comes within MARGIN of what all but HELD_OUT of the kind's own held-out
credentials reach.

Base spans always stay; a scored token that overlaps any base span adds nothing. The text is read once: spans and
candidates are staged without it. Scoring is an Arrow batch function over that narrow table: the tokens of a batch walk
through the transition tables together, a position a step. Tables are bounded by SAMPLE and LONGEST.

Defined results: null and empty texts have no spans; rows are handled one by one, so repeats and null ids keep one
result row each; without labelled credentials of a kind nothing of that kind is added; with few, the automaton is one
of pooled positions; an empty table gives no rows; columns other than doc_id and text aren't read.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsmill.llm.common import first_by_hash, located, stage

KINDS = ("assign", "access", "hex")
SAMPLE = 400
#: Characters of a credential that the training sample keeps; scoring takes all characters.
LONGEST = 96
ALPHA = 0.05
MARGIN = 0.5
#: Prefixes of fewer samples are pooled by length.
RARE = 16
#: Least length of a candidate token.
SHORTEST = 12
#: Share of a kind's held-out credentials that may score below its bar.
HELD_OUT = 0.05
#: Characters of a credential.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
#: Classes of tokens that ordinary writing has, the first that fits: numbers, times and dates, words, paths of words and numbers.
BACKGROUND = ("^[0-9+/_.=-]+$", "^[0-9TZ+/_.=-]+$", "^[A-Za-z]+$", "no run of both letters and digits")

# Base formats.
ASSIGN = r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*+[:=]\x20*+[\"']?([A-Za-z0-9+/_.=-]++)"
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"[0-9a-f]{24,}+"
TOKEN = r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{12,}+"


class Automaton:
    """A deterministic probabilistic automaton: per state the counts of ends and of (symbol, next state)."""

    def __init__(self, words: list[str], alpha: float = ALPHA, rare: int = RARE):
        words = [w[:LONGEST] for w in words]
        had = Counter(w[:i] for w in words for i in range(len(w) + 1))
        name = lambda p: p if not p or had[p] >= rare else len(p)  # noqa: E731  a prefix, or the pool of its length
        number = {"": 0}
        self.next: list[dict] = [{}]
        self.count: list[dict] = [{}]
        self.ends = [0]
        for w in words:
            s = 0
            for i, c in enumerate(w):
                to = name(w[: i + 1])
                if to not in number:
                    number[to] = len(self.next)
                    self.next.append({})
                    self.count.append({})
                    self.ends.append(0)
                self.next[s][c] = number[to]
                self.count[s][c] = self.count[s].get(c, 0) + 1
                s = number[to]
            self.ends[s] += 1
        self.same = list(range(len(self.next)))  # the state that each one was merged into
        self._merge(math.sqrt(0.5 * math.log(2 / alpha)))
        self.next = [{c: self.state(to) for c, to in n.items()} for n in self.next]
        self.sums = [self.total(s) for s in range(len(self.next))]

    def state(self, s: int) -> int:
        while self.same[s] != s:
            self.same[s] = self.same[self.same[s]]
            s = self.same[s]
        return s

    def total(self, s: int) -> int:
        return self.ends[s] + sum(self.count[s].values())

    def states(self) -> set[int]:
        """States that words lead to."""
        seen, todo = {0}, [0]
        while todo:
            new = set(self.next[todo.pop()].values()) - seen
            seen |= new
            todo += new
        return seen

    def _differ(self, a: int, b: int, bound: float) -> bool:
        """Whether two states, or states that the same symbols reach from them, have unlike frequencies."""
        todo, seen = [(a, b)], {(a, b)}
        while todo:
            a, b = todo.pop()
            m, n = self.total(a), self.total(b)
            if not m or not n:
                continue
            far = bound * (1 / math.sqrt(m) + 1 / math.sqrt(n))
            if abs(self.ends[a] / m - self.ends[b] / n) > far:
                return True
            for c in self.count[a].keys() | self.count[b].keys():
                if abs(self.count[a].get(c, 0) / m - self.count[b].get(c, 0) / n) > far:
                    return True
                if c in self.next[a] and c in self.next[b]:
                    pair = (self.state(self.next[a][c]), self.state(self.next[b][c]))
                    if pair[0] != pair[1] and pair not in seen:
                        seen.add(pair)
                        todo.append(pair)
        return False

    def _join(self, a: int, b: int) -> None:
        """Makes b the same state as a, and what equal symbols then lead to as well."""
        todo = [(a, b)]
        while todo:
            a, b = map(self.state, todo.pop())
            if a == b:
                continue
            self.same[b] = a
            self.ends[a] += self.ends[b]
            for c, n in self.count[b].items():
                self.count[a][c] = self.count[a].get(c, 0) + n
                if c in self.next[a]:
                    todo.append((self.next[a][c], self.next[b][c]))
                else:
                    self.next[a][c] = self.next[b][c]

    def _merge(self, bound: float) -> None:
        """Settled states grow from the root: the commonest state that one leads to joins the first like it, or is settled."""
        settled = [0]
        while True:
            settled = list(dict.fromkeys(map(self.state, settled)))
            edge = [(n, -r, c, to) for r in settled for c, n in self.count[r].items() if (to := self.state(self.next[r][c])) not in settled]
            if not edge:
                return
            b = max(edge)[3]
            like = next((r for r in settled if not self._differ(r, b, bound)), None)
            if like is None:
                settled.append(b)
            else:
                self._join(like, b)

    def bits(self, word: str) -> float:
        """Mean log2 probability of a symbol of the word and of its end; each of 64 symbols has a tenth of a sighting everywhere.

        A symbol not seen in a state costs dearly and leads back to the start.
        """
        s, total = 0, 0.0
        for c in word:
            total += math.log2((self.count[s].get(c, 0) + 0.1) / (self.sums[s] + 6.5))
            s = self.next[s].get(c, 0)
        total += math.log2((self.ends[s] + 0.1) / (self.sums[s] + 6.5))
        return total / (len(word) + 1)


def classed(token: Column) -> Column:
    """The number of a token's class in BACKGROUND, null for one of letters and digits in one run."""
    runs = F.split(token, "[+/_.=-]+")
    mixed = F.exists(runs, lambda r: r.rlike("[A-Za-z]") & r.rlike("[0-9]"))
    numbers, times, words = (token.rlike(p) for p in BACKGROUND[:3])
    return F.when(numbers, 0).when(times, 1).when(words, 2).when(~mixed, 3)


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, base (kind, start, end, value) in order of start and kind, and tokens (start, end, hit) that no base span overlaps."""
    text = F.coalesce(F.col("text"), F.lit(""))
    none = F.expr("cast(array() as array<struct<start:int,end:int,hit:string,part:string>>)")
    gates = (text.rlike("(?i)passw|secret|token|api_?key"), text.contains("AKIA"), text.rlike("[0-9a-f]{24}"))
    found = docs.select("doc_id", *[F.when(g, located(text, p, n)).otherwise(none).alias(k) for k, g, p, n in zip(KINDS, gates, (ASSIGN, ACCESS, HEX), (2, 0, 0), strict=True)], F.when(text.rlike(TOKEN), located(text, TOKEN)).otherwise(none).alias("tokens"))
    one = lambda i: lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("kind"), s["end"].alias("end"), s["part"].alias("value"))
    base = F.concat(F.transform(F.filter("assign", lambda s: F.length(s["part"]) >= 6), one(0)), F.transform("access", one(1)), F.transform("hex", one(2)))
    found = found.select("doc_id", F.array_sort(base).alias("base"), "tokens")
    free = F.filter("tokens", lambda t: ~F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    return found.select("doc_id", "base", F.transform(free, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["hit"].alias("hit"))).alias("tokens"))


def infer(cands: DataFrame, sample: int = SAMPLE) -> tuple[dict, list, dict]:
    """Automata by kind, those of ordinary tokens, and the bar of each kind: a low quantile of its held-out credentials' scores."""
    value = F.substr(F.col("b.value"), F.lit(1), F.lit(LONGEST))
    first = lambda df, c: first_by_hash(df.select(c.alias("v")), "v", sample)
    rows = cands.where(F.size("base") > 0).select(F.explode("base").alias("b"))
    # an assigned value of another kind's format says nothing about assigned ones
    rows = rows.where((F.col("b.kind") > 0) | ~F.col("b.value").rlike(f"^(?:{ACCESS}|{HEX})$"))
    automata, least = {}, {}
    for i in range(len(KINDS)):
        words = first(rows.where(F.col("b.kind") == i), value)
        held, fit = words[: len(words) // 5], words[len(words) // 5 :]
        if fit:
            automata[i] = Automaton(fit)
            scores = sorted(map(automata[i].bits, held or fit))
            least[i] = scores[int(HELD_OUT * len(scores))] - MARGIN
    tokens = cands.select(F.explode("tokens.hit").alias("t")).select("t", classed(F.col("t")).alias("c"))
    plain = [first(tokens.where(F.col("c") == i), F.substr(F.col("t"), F.lit(1), F.lit(LONGEST))) for i in range(len(BACKGROUND))]
    return automata, [Automaton(w) for w in plain], least


class Tables:
    """Automata as one table of symbol costs and next states, so that all tokens walk through all automata together."""

    def __init__(self, automata: list[Automaton]):
        number = {c: i for i, c in enumerate(ALPHABET)}
        n = sum(len(a.next) for a in automata)
        self.cost, self.to, self.end = np.zeros((n, len(number))), np.zeros((n, len(number)), "int32"), np.zeros(n)
        self.start, at = [], 0
        for a in automata:
            self.start.append(at)
            self.to[at : at + len(a.next)] = at  # a symbol not seen leads back to the start
            for s in range(len(a.next)):
                self.cost[at + s] = math.log2(0.1 / (a.sums[s] + 6.5))
                self.end[at + s] = math.log2((a.ends[s] + 0.1) / (a.sums[s] + 6.5))
                for c, to in a.next[s].items():
                    self.cost[at + s, number[c]] = math.log2((a.count[s].get(c, 0) + 0.1) / (a.sums[s] + 6.5))
                    self.to[at + s, number[c]] = at + to
            at += len(a.next)
        self.symbol = np.zeros(128, "uint8")
        self.symbol[[ord(c) for c in ALPHABET]] = range(len(ALPHABET))

    def bits(self, tokens: list[str]) -> np.ndarray:
        """Mean log2 probability of a symbol and the end: a row for each token, a column for each automaton."""
        size = np.array([len(t) for t in tokens], "int64")
        order = np.argsort(-size, kind="stable")
        text = self.symbol[np.frombuffer("".join(tokens).encode("ascii"), "uint8")]
        begin = (np.cumsum(size) - size)[order]
        state = np.tile(np.array(self.start, "int32"), (len(tokens), 1))
        total = np.zeros(state.shape)
        left = np.searchsorted(-size[order], -np.arange(int(size.max(initial=0))), side="left")  # tokens longer than a position
        for at, n in enumerate(left.tolist()):
            symbol, now = text[begin[:n] + at][:, None], state[:n]
            total[:n] += self.cost[now, symbol]
            state[:n] = self.to[now, symbol]
        total += self.end[state]
        out = np.empty_like(total)
        out[order] = total / (size[order][:, None] + 1)
        return out


def score(cands: DataFrame, automata: dict, plain: list, least: dict, margin: float = MARGIN) -> DataFrame:
    """doc_id, base and added (kind, start, end) for every row."""
    kinds = sorted(automata)
    tables, bar = Tables([automata[k] for k in kinds] + plain), np.array([least[k] for k in kinds])
    span = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])

    def best(tokens: list[str]) -> np.ndarray:
        """The likeliest kind of each token, or -1."""
        if not kinds or not tokens:
            return np.full(len(tokens), -1, "int32")
        bits = tables.bits(tokens)
        own, ordinary = bits[:, : len(kinds)], bits[:, len(kinds) :]
        top = own.argmax(axis=1)
        high = own[np.arange(len(tokens)), top]
        return np.where((high >= ordinary.max(axis=1) + margin) & (high >= bar[top]), np.array(kinds, "int32")[top], -1)

    def run(batches):
        for batch in batches:
            lists = batch.column(2)
            flat = lists.flatten()
            kind = best(flat.field("hit").to_pylist())
            kept = kind >= 0
            ends = np.concatenate([[0], np.cumsum(np.array([len(x) for x in lists], "int64"))])
            offsets = np.concatenate([[0], np.cumsum(kept)])[ends].astype("int32")
            spans = pa.StructArray.from_arrays([pa.array(kind[kept], pa.int32()), *[flat.field(c).filter(pa.array(kept)) for c in ("start", "end")]], fields=list(span))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(offsets), spans)], names=["doc_id", "base", "added"])

    base = cands.schema["base"].dataType.simpleString()
    return cands.mapInArrow(run, f"doc_id {cands.schema['doc_id'].dataType.simpleString()}, base {base}, added array<struct<kind:int,start:int,end:int>>")


def find(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, base and added spans for every row of docs."""
    cands = stage(candidates(docs), "secrets")
    return score(cands, *infer(cands, sample))


def digest(found: DataFrame) -> DataFrame:
    names = F.array(*[F.lit(k) for k in KINDS])
    text = lambda spans: F.array_join(F.transform(spans, lambda c: F.concat_ws(":", F.get(names, c["kind"]), c["start"].cast("string"), c["end"].cast("string"))), ",")
    bare = lambda spans: F.transform(spans, lambda b: F.struct(b["start"].alias("start"), b["kind"].alias("kind"), b["end"].alias("end")))
    counts = [F.size(F.filter("base", lambda b: b["kind"] == i)).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]  # noqa: B023
    both = F.array_sort(F.concat(bare(F.col("base")), bare(F.col("added"))))
    return found.select("doc_id", *counts, F.sha2(text(F.col("base")), 256).alias("base_sha256"), text(both).alias("spans"))
