"""Stories and near duplicates over live posts: keyed state with timers.

The key of the state is a lane, a column of the caller's (a language, an edition): posts meet inside their lane, and
lanes run in parallel. What a lane holds is bounded by time: event-time timers drop stories and posts that nothing can
match any more. The rules and their weights are those of the batch forms, and so are the results where posts come in
order; rows of a batch are taken by time and id.

Both need the RocksDB state store (spark.sql.streaming.stateStore.providerClass).
"""

from __future__ import annotations

import json
import math
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from newsmill.operators import clusters as C
from newsmill.operators import dedup as D

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LISTS = ("numbers", "casualty_numbers", "event_numbers", "locations", "actors", "targets", "phases")


def _bound(a: str, b: str) -> float:
    """What the sequence ratio can be at most, from the characters in common."""
    return 2 * (Counter(a) & Counter(b)).total() / (len(a) + len(b)) if a and b else 0.0


def _ratio(a: str, b: str) -> float:
    return (1.0 if a == b else SequenceMatcher(None, a, b).ratio()) if a and b else 0.0


# ---- stories ----------------------------------------------------------------------------------------------------


def story_pair(a: dict, b: dict, least: float = C.MATCH) -> dict | None:
    """Score, similarity, change and better headline of a post against a story's facts, or none where they don't fit."""
    x, y = a["facts"], b["facts"]
    both = {c: len(set(x[c]) & set(y[c])) for c in LISTS}
    one = a["taxonomy_key"] != "" and a["taxonomy_key"] == b["taxonomy_key"]
    points = C.POINTS["topic"] * (a["topic_key"] != "" and a["topic_key"] == b["topic_key"]) + C.POINTS["category"] * one + C.POINTS["phases"] * (both["phases"] > 0) + C.POINTS["official"] * (x["official"] and y["official"])
    points += sum(min(C.POINTS[c][1], C.POINTS[c][0] * both[c]) for c in ("actors", "locations", "targets"))
    differ = {c: bool(x[c] and y[c]) and not both[c] for c in LISTS}
    other = bool(a["taxonomy_key"] and b["taxonomy_key"]) and not one and not both["actors"] and not both["locations"]
    need = max([C.UNLIKE["both"]] * (differ["actors"] and differ["locations"]) + [C.UNLIKE["one"]] * (differ["actors"] and not both["locations"] or differ["locations"] and not both["actors"]) + [C.UNLIKE["category"]] * other + [0.0])
    fits = lambda s: s >= need and points + C.POINTS["similarity"] * s >= least
    if not fits(_bound(x["norm"], y["norm"])):
        return None
    s = _ratio(x["norm"], y["norm"])
    if not fits(s):
        return None
    gain = headline_quality(a["headline"]) - headline_quality(b["headline"])
    return {"score": round(points + C.POINTS["similarity"] * s, 6), "similarity": round(s, 6), "delta": _delta(x, y, both, differ), "better": bool(a["headline"] and b["headline"] and gain > 1.0 and s >= 0.35)}


def _delta(x: dict, y: dict, both: dict, differ: dict) -> str:
    for c, name in (("casualty_numbers", "casualty_change"), ("event_numbers", "event_count_change")):
        if x[c] and set(x[c]) != set(y[c]):
            return name
    for c, name in (("locations", "location_change"), ("actors", "actor_change"), ("targets", "target_change")):
        if differ[c]:
            return name
    if x["official"] and not y["official"]:
        return "official_confirmation"
    return "phase_change" if set(x["phases"]) - set(y["phases"]) and (both["locations"] or both["actors"]) else "none"


def headline_quality(x: str) -> float:
    """How well a line reads as a headline, as in the batch form."""
    if not x:
        return -100.0
    n, low = len(x), x.lower()
    length = 5.0 if 35 <= n <= 160 else -2.0 if n < 28 else -min(6.0, (n - 160) / 25.0)
    opens = low.startswith(("flash update", "live update", "breaking", "alert", "why "))
    hedges = any(w in low for w in ("reportedly", "what explains", "reasons for", "ways to address"))
    return length - 3.0 * x.count("?") - 0.5 * x.count('"') - 0.5 * x.count(":") - 4.0 * opens - 3.0 * hedges


class Stories(StatefulProcessor):
    """A lane's active stories: the facts and headline that stand, times and the count of updates.

    A story that nothing has updated leaves after `silent` minutes, others after `kept`; both at least the `minutes`
    for which a story can be met.
    """

    def __init__(self, minutes: int = 180, burst: int = 60, silent: int = 240, kept: int = 1440):
        if min(silent, kept) < minutes:
            raise ValueError("stories must be kept for as long as they can be met")
        self.minutes, self.burst, self.silent, self.kept = minutes, burst, silent, kept

    def init(self, handle) -> None:
        self.handle = handle
        self.stories = handle.getMapState("stories", "id long", "post long, row string, opened long, updated long, updates long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values(["t", "id"])
        held = [(k[0], *v) for k, v in self.stories.iterator()]
        active = [{"id": i, "facts": post, "opened": opened, "updated": updated, "updates": n} for i, post, _, opened, updated, n in sorted(held, key=lambda x: (x[3], x[0]))]
        facts = {x[1]: json.loads(x[2]) for x in held}
        out, changed = [], set()
        for i, t, row in zip(new["id"].tolist(), new["t"].tolist(), new["row"], strict=True):
            active = [c for c in active if t - c["updated"] <= 60 * self.minutes]
            now = json.loads(row)
            edges = [{"b": c["facts"], **e} for c in active if (e := story_pair(now, facts[c["facts"]]))]
            story, decision, updates = C.step(active, i, t, edges, self.burst)
            facts[i] = now
            changed.add(story)
            out.append((key[0], i, story, decision, updates))
        for c in active:
            if c["id"] in changed:
                self.stories.updateValue((c["id"],), (c["facts"], json.dumps(facts[c["facts"]]), c["opened"], c["updated"], c["updates"]))
                self.handle.registerTimer(1000 * self._leaves(c["updated"], c["updates"]))
        yield pd.DataFrame(out, columns=["lane", "id", "cluster", "decision", "updates"])

    def _leaves(self, updated: int, updates: int) -> int:
        return updated + 60 * (self.kept if updates else self.silent) + 1

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        for story in [k for k, v in self.stories.iterator() if 1000 * self._leaves(v[3], v[4]) <= now]:
            self.stories.removeKey(story)
        return iter([])

    def close(self) -> None:
        pass


def story_stream(facts: DataFrame, lane: str, delay: str = "10 minutes", **how) -> DataFrame:
    """lane, id, cluster, decision and updates of a stream of story facts (a result of story_facts with a lane column)."""
    row = F.to_json(F.struct("topic_key", "taxonomy_key", "headline", "facts"), {"ignoreNullFields": "false"})
    rows = facts.withWatermark("ts", delay).select(F.col(lane).alias("lane"), "id", F.unix_seconds("ts").alias("t"), "ts", row.alias("row"))
    return rows.groupBy("lane").transformWithStateInPandas(Stories(**how), "lane string, id long, cluster long, decision string, updates long", "append", "eventTime")


# ---- near duplicates --------------------------------------------------------------------------------------------


def dup_score(a: dict, b: dict, threshold: float = D.THRESHOLD) -> float:
    """The near-duplicate score of two posts' features (0 below the threshold)."""
    if a["hash"] == b["hash"]:
        return 1.0
    ta, tb = Counter(a["tokens"]), Counter(b["tokens"])
    common = ta.keys() & tb.keys()
    if not common:
        return 0.0
    part = {"jaccard": len(common) / len(ta.keys() | tb.keys())}
    norm = lambda t: math.sqrt(sum(n * n * (1.0 if w in common else D.ALONE**2) for w, n in t.items()))
    part["tfidf"] = min(1.0, sum(ta[w] * tb[w] for w in common) / (norm(ta) * norm(tb)))
    if part["tfidf"] < 0.48 and part["jaccard"] < 0.40:
        return 0.0
    dice = lambda x, y: 2 * len(x & y) / (len(x) + len(y)) if x & y else 0.0
    grams = lambda t: {"_".join(p) for p in zip(t, t[1:])}
    pieces = lambda k: {k[i : i + 4] for i in range(len(k) - 3)}
    ca, cb = pieces(a["key"]), pieces(b["key"])
    part |= {"bigram": dice(grams(a["tokens"]), grams(b["tokens"])), "anchor": dice(set(a["anchors"]), set(b["anchors"])), "chargram": len(ca & cb) / len(ca | cb) if ca & cb else 0.0}

    def final(order: float) -> float:
        p = part | {"order": order}
        p["semantic"] = sum(w * p[c] for c, w in D.SEMANTIC.items())
        return max([sum(w * p[c] for c, w in D.BLEND.items()), *(v for needs, v in D.BOOSTS if all(p[c] >= x for c, x in needs.items()))])

    if final(_bound(a["key"], b["key"])) < threshold:
        return 0.0
    score = final(_ratio(a["key"], b["key"]))
    return score if score >= threshold else 0.0


class NearDuplicates(StatefulProcessor):
    """Posts that were kept, for some hours, and an index of their tokens: token -> kept posts that have it.

    Only kept posts are anchors, and a duplicate doesn't lengthen its anchor's stay. A post is scored against the kept
    posts that share a token with it and lie within the hours.
    """

    def __init__(self, hours: int = 4, threshold: float = D.THRESHOLD):
        self.span, self.threshold = 3600 * hours, threshold

    def init(self, handle) -> None:
        self.handle = handle
        self.posts = handle.getMapState("posts", "id long", "t long, row string")
        self.index = handle.getMapState("index", "token string", "ids array<long>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values(["t", "id"])
        seen: dict[int, tuple] = {}  # what this batch has read or kept
        lists: dict[str, list] = {}
        fresh, touched, out = [], set(), []
        for i, t, row in zip(new["id"].tolist(), new["t"].tolist(), new["row"], strict=True):
            now = json.loads(row)
            tokens = set(now["tokens"])
            for w in tokens - lists.keys():
                lists[w] = list(self.index.getValue((w,))[0]) if self.index.containsKey((w,)) else []
            found = []
            for b in {b for w in tokens for b in lists[w]}:
                if b not in seen:
                    at, text = self.posts.getValue((b,))
                    seen[b] = (at, json.loads(text))
                at, old = seen[b]
                if t - at <= self.span and (at, b) < (t, i) and (score := dup_score(now, old, self.threshold)):
                    found.append((score, -b))
            if found:
                out.append((key[0], i, False, -max(found)[1], max(found)[0]))
                continue
            out.append((key[0], i, True, None, None))
            seen[i] = (t, now)
            fresh.append((i, t, row))
            touched |= tokens
            for w in tokens:
                lists[w].append(i)
        for i, t, row in fresh:
            self.posts.updateValue((i,), (t, row))
            self.handle.registerTimer(1000 * (t + self.span + 1))
        for w in touched:
            self.index.updateValue((w,), (lists[w],))
        yield pd.DataFrame(out, columns=["lane", "id", "kept", "matched", "score"]).astype({"matched": "Int64", "score": "float64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        gone = {k[0]: json.loads(v[1]) for k, v in self.posts.iterator() if 1000 * (v[0] + self.span + 1) <= now}
        for w in {w for row in gone.values() for w in row["tokens"]}:
            if self.index.containsKey((w,)):
                left = [i for i in self.index.getValue((w,))[0] if i not in gone]
                if left:
                    self.index.updateValue((w,), (left,))
                else:
                    self.index.removeKey((w,))
        for i in gone:
            self.posts.removeKey((i,))
        return iter([])

    def close(self) -> None:
        pass


def near_dedup_stream(posts: DataFrame, lane: str, delay: str = "10 minutes", **how) -> DataFrame:
    """lane, id, kept, matched (the kept post of the best score) and score of a stream of posts, each against its lane."""
    f = D.features(posts.withColumn("_lane", F.col(lane)), ["_lane"])
    row = F.to_json(F.struct(F.col("text_hash").alias("hash"), "tokens", "key", "anchors"))
    rows = f.withWatermark("ts", delay).select(F.col("_lane").alias("lane"), "id", F.unix_seconds("ts").alias("t"), "ts", row.alias("row"))
    return rows.groupBy("lane").transformWithStateInPandas(NearDuplicates(**how), "lane string, id long, kept boolean, matched long, score double", "append", "eventTime")
