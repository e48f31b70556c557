"""Benchmark decontamination by winnowing.

Texts become word hashes; both sides keep the minimum K-gram hash of every run of SPAN - K + 1 consecutive K-grams, so
any shared span of SPAN words shares a kept fingerprint. Fingerprints that meet are extended: each SPAN-word window
of the item around the hit is compared with the document's window at the same offset. Items shorter than SPAN words
have no full run; their whole sequences are looked up by length instead.

A benchmark of at most `block_words` words, counted first, is one broadcast of a fixed bound: documents are scanned where
they lie and nothing is shuffled. A larger one is joined instead: documents that have a fingerprint of the benchmark
are found by a semi-join on fingerprints, and only their windows are joined with the items' windows. Both ways give the
same rows; a lost executor costs its own tasks.

Defined results: null or empty texts have no words and no hits; items without words never occur; a null item_id counts
as the empty string; repeated items count once by id; repeated or null doc_ids keep one result row each; an empty
benchmark contaminates nothing; other columns aren't read (`drop_contaminated` passes them through).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsmill.llm import wordhash
from newsmill.llm.common import fields, packed, stage

SPAN, K = 10, 5
#: Words of lower-cased text: letters, digits and all that isn't ASCII.
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BLOCK_WORDS = 2_000_000


class Block:
    """Fingerprints of some items, as sorted arrays."""

    def __init__(self, ids: list[str], texts: list[str]):
        self.ids = ids
        h, first = wordhash.words(pa.array(texts, pa.string()), wordhash.ALNUM)
        n = np.diff(first)
        self.first, self.short = first, {}
        for length in np.unique(n[(n > 0) & (n < SPAN)]):
            item = np.flatnonzero(n == length)
            key = wordhash.grams(h, int(length))[first[item]]
            order = np.argsort(key, kind="stable")
            self.short[int(length)] = (key[order], item[order])
        self.windows = wordhash.grams(h, SPAN)
        prints, at = fingerprints(h, first)
        order = np.argsort(prints, kind="stable")
        self.prints, self.at = prints[order], at[order]
        self.item = np.searchsorted(first, self.at, "right") - 1


def fingerprints(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Winnowed K-gram hashes of rows of at least SPAN words, and their word positions."""
    w = SPAN - K + 1
    g = wordhash.grams(h, K)
    if len(g) < w:
        return g[:0], np.zeros(0, np.int64)
    low = g[: len(g) - w + 1].copy()
    for i in range(1, w):
        np.minimum(low, g[i : len(g) - w + 1 + i], out=low)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    inside = row[: len(low)] == row[SPAN - 1 :][: len(low)]  # runs within one row only
    kept = np.zeros(len(g), bool)
    for i in range(w):
        kept[i : i + len(low)] |= inside & (g[i : i + len(low)] == low)
    at = np.flatnonzero(kept)
    return g[at], at


def _pairs(keys: np.ndarray, sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (i, j) with keys[i] == sorted_keys[j]."""
    lo, hi = np.searchsorted(sorted_keys, keys, "left"), np.searchsorted(sorted_keys, keys, "right")
    n = hi - lo
    i = np.repeat(np.arange(len(keys)), n)
    return i, np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(len(i))


def match(h: np.ndarray, first: np.ndarray, block: Block, hit: np.ndarray, found: list[set]) -> None:
    """Marks the words of h that the block's windows cover; adds to each row's set the ids of items that occur."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    for length, (keys, items) in block.short.items():
        g = wordhash.grams(h, length)
        ok = np.flatnonzero(row[: len(g)] == row[length - 1 :][: len(g)])
        ok = ok[np.isin(g[ok], keys)]
        i, j = _pairs(g[ok], keys)
        _mark(ok[i], length, items[j], row, block, hit, found)
    if not len(block.prints):
        return
    prints, at = fingerprints(h, first)
    some = np.isin(prints, block.prints)
    prints, at = prints[some], at[some]
    step = 200_000  # bounds the pairs held at once where a fingerprint is frequent on both sides
    windows = wordhash.grams(h, SPAN)
    for k in range(0, len(prints), step):
        i, j = _pairs(prints[k : k + step], block.prints)
        p, q, item = at[k : k + step][i], block.at[j], block.item[j]
        for back in range(SPAN - K + 1):
            d, s = p - back, q - back
            ok = (s >= block.first[item]) & (s + SPAN <= block.first[item + 1]) & (d >= first[row[p]]) & (d + SPAN <= first[row[p] + 1])
            d, s, it = d[ok], s[ok], item[ok]
            same = windows[d] == block.windows[s]
            _mark(d[same], SPAN, it[same], row, block, hit, found)


def _mark(at, length, items, row, block, hit, found) -> None:
    if not len(at):
        return
    for i in range(length):
        hit[at + i] = True
    for r, it in np.unique(np.stack([row[at], items]), axis=1).T:
        found[r].add(block.ids[it])


def _items(benchmark: DataFrame) -> DataFrame:
    """id and text of the items that have a word; the others never occur, however many there are."""
    return benchmark.where(F.translate("text", UPPER, UPPER.lower()).rlike(WORDS)).select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("id"), "text")


def fits(benchmark: DataFrame, block_words: int) -> bool:
    """Whether the benchmark has at most block_words words (two characters a word at least)."""
    chars = _items(benchmark).agg(F.sum(F.length("text") + 1)).first()[0] or 0
    return chars // 2 <= block_words


def scan(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """All columns of docs, then n_words, n_hit, n_items and items (hash of the sorted ids), under names that docs doesn't have.

    The benchmark is broadcast; see `fits`.
    """
    rows = _items(benchmark).collect()  # bounded by block_words
    held = docs.sparkSession.sparkContext.broadcast(Block([r.id for r in rows], [r.text for r in rows]))
    at = docs.columns.index("text")
    names = added(docs)
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", " + ", ".join(f"`{n}` {t}" for n, t in zip(names, ("long", "long", "long", "string"), strict=True))

    def run(batches):
        for batch in batches:
            h, first = wordhash.words(batch.column(at), wordhash.ALNUM)
            hit, found = np.zeros(len(h), bool), [set() for _ in range(batch.num_rows)]
            match(h, first, held.value, hit, found)
            total = np.concatenate([[0], np.cumsum(hit)])
            more = [
                pa.array(np.diff(first), pa.int64()),
                pa.array(total[first[1:]] - total[first[:-1]], pa.int64()),
                pa.array([len(s) for s in found], pa.int64()),
                pa.array([hashlib.sha256(",".join(sorted(s)).encode()).hexdigest() for s in found], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, *names])

    return docs.mapInArrow(run, out)


def added(docs: DataFrame) -> list[str]:
    """Names of what a scan adds: n_words, n_hit, n_items and items behind as many underscores as it takes."""
    taken, mark = {c.lower() for c in docs.columns}, "_"
    while any((mark + n) in taken for n in ("n_words", "n_hit", "n_items", "items")):
        mark += "_"
    return [mark + n for n in ("n_words", "n_hit", "n_items", "items")]


def _marks(rows: DataFrame, keys: list[str], lengths: list[int], windows: bool) -> DataFrame:
    """The keys, and for each row the fingerprints and grams of the given lengths that it has; with windows instead of
    fingerprints also their positions (at) and lengths (len), one row each."""
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*keys).schema)
    salt = np.uint64(0x9E6C63D0876A9A47)

    def tagged(h, length):
        with np.errstate(over="ignore"):
            return wordhash.mix(wordhash.grams(h, length) + np.uint64(length) * salt)

    def run(batches):
        for batch in batches:
            h, first = wordhash.words(batch.column(len(keys)), wordhash.ALNUM)
            row = np.repeat(np.arange(len(first) - 1), np.diff(first))
            parts = []
            if not windows:
                prints, at = fingerprints(h, first)
                parts.append((prints, at, SPAN))
            for length in [*lengths, *([SPAN] if windows else [])]:
                g = tagged(h, length)
                at = np.flatnonzero(row[: len(g)] == row[length - 1 :][: len(g)]) if len(g) else np.zeros(0, np.int64)
                parts.append((g[at], at, length))
            mark = np.concatenate([m for m, *_ in parts]).view(np.int64)
            place = np.concatenate([a for _, a, _ in parts])
            size = np.repeat([n for *_, n in parts], [len(a) for _, a, _ in parts])
            if not windows:  # each mark of a row once
                mark, owner = np.unique(np.stack([mark, row[place]]), axis=1) if len(mark) else (mark, row[place])
                place, size = np.zeros(len(mark), np.int64), np.zeros(len(mark), np.int64)
            else:
                owner = row[place]
                place = place - first[owner]
            for i in range(0, len(mark), 50_000):
                part = slice(i, i + 50_000)
                own = [c.take(pa.array(owner[part])) for c in batch.columns[: len(keys)]]
                yield pa.RecordBatch.from_arrays([*own, pa.array(mark[part]), pa.array(place[part], pa.int64()), pa.array(size[part], pa.int64())], names=[*keys, "mark", "at", "len"])

    return rows.select(*keys, "text").mapInArrow(run, f"{kinds}, mark long, at long, len long")


def joined(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """k1, k2 (names of a text), n_hit, n_items and items of the texts of docs that the benchmark hits, by joins."""
    text = F.coalesce(F.col("text"), F.lit(""))
    items = _items(benchmark)
    n = F.size(F.regexp_extract_all(F.translate("text", UPPER, UPPER.lower()), F.lit(WORDS), F.lit(0)))
    short = sorted(r[0] for r in items.select(n.alias("n")).where((F.col("n") > 0) & (F.col("n") < SPAN)).distinct().collect())  # 9 lengths at most
    whole = items.select("id", "text", n.alias("n"))
    long, brief = whole.where(F.col("n") >= SPAN), whole.where((F.col("n") > 0) & (F.col("n") < SPAN))
    sequences = _marks(brief, ["id", "n"], short, True).where("at = 0 AND len = n").select("id", "mark", "len")
    texts = docs.select(*text_name(text), text.alias("text"))
    wanted = _marks(long, ["id"], [], False).select("mark").unionByName(sequences.select("mark")).distinct()
    some = _marks(texts, ["k1", "k2"], short, False).select("k1", "k2", "mark").join(wanted, "mark", "left_semi").select("k1", "k2").distinct()
    near = stage(texts.join(some, ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"]), "near-benchmark")
    spans = stage(_marks(long, ["id"], [], True).select("id", "mark", "len").unionByName(sequences).distinct(), "benchmark-windows")
    hits = _marks(near, ["k1", "k2"], short, True).join(spans, ["mark", "len"]).select("k1", "k2", "at", "len", "id")
    words = hits.select("k1", "k2", F.explode(F.sequence(F.col("at"), F.col("at") + F.col("len") - 1)).alias("w")).distinct().groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n_hit"))
    ids = hits.select("k1", "k2", "id").distinct().groupBy("k1", "k2").agg(F.array_sort(F.collect_list("id")).alias("ids"))  # one document's items
    return words.join(ids, ["k1", "k2"]).select("k1", "k2", "n_hit", F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join("ids", ","), 256).alias("items"))


def text_name(text) -> list:
    """k1 and k2: 128 bits that name a text."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")]


def report(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    docs = docs.select("doc_id", "text")
    if fits(benchmark, block_words):
        s = scan(docs, benchmark)
        return s.select("doc_id", *[F.col(a).alias(b) for a, b in zip(added(docs), ("n_words", "n_hit", "n_items", "items_sha256"), strict=True)]).withColumn("contaminated", F.col("n_hit") > 0)
    text = F.coalesce(F.col("text"), F.lit(""))
    n = F.regexp_count(F.translate(text, UPPER, UPPER.lower()), F.lit(WORDS)).cast("long")
    rows = docs.select("doc_id", n.alias("n_words"), *text_name(text)).join(joined(docs, benchmark), ["k1", "k2"], "left")
    none = F.sha2(F.lit(""), 256)
    hit = F.coalesce("n_hit", F.lit(0))
    return rows.select("doc_id", "n_words", hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("items", none).alias("items_sha256"), (hit > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Documents that share no window with the benchmark, with the columns they came with, whatever their names."""
    if fits(benchmark, block_words):
        names = added(docs)
        return scan(docs, benchmark).where(F.col(names[1]) == 0).drop(*names)
    rows = packed(docs).withColumns(dict(zip(("k1", "k2"), text_name(F.coalesce("row.text", F.lit(""))), strict=True)))
    return rows.join(joined(docs.select("doc_id", "text"), benchmark).select("k1", "k2"), ["k1", "k2"], "left_anti").select(*fields(docs.columns))
