"""Spelling variant grouping over a bit-sliced position index.

Words that differ by one inserted, deleted or replaced letter share the first or the last half of the shorter one, so a
word of length n is dealt to four buckets: (n, first n // 2 letters), (n, last n // 2 letters), and the two that it would
have if one letter shorter. Words near each other meet in the bucket of the shorter one's length, whatever the size of
the vocabulary. A bucket of more than BUCKET words is split into cells of (part, part), so none is held in one task.

Inside a task, buckets are gathered into blocks of up to BLOCK words. A block's index is sliced by position: for each
(position, letter) a bitset says which words have that letter there. All words of the block are looked up at once: sets
of index words that agree with the query so far without an error, with one replaced letter, one surplus letter (the
index shifted one position back) and one missing letter (one position ahead) are carried along the positions by word-
parallel ands and ors, 64 index words an operation. The slices of three positions are held at a time, so the length of
words doesn't matter to memory.

A word's form is its near word of largest count, if that is RATIO times its own; counts grow along forms, so roots are
found in a few rounds of pointer doubling, however large the vocabulary.

Defined results: null texts have no words; a null doc_id counts as empty in the noise; repeated rows count as often as
they stand; of near words of equal counts the first in code-point order is the form; an empty table gives no rows; very
long runs of letters are words like others; columns other than doc_id and text aren't read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsmill.llm.common import release, stage

LEAST_LENGTH = 7
LEAST_COUNT = 2
RATIO = 10
#: Words of a bucket above which it is split, words of a block, and letters that the longest of them times their number makes.
BUCKET = 2048
BLOCK = 2048
LETTERS = 1 << 21
#: Letters of a word, and one run in NOISE loses a letter in the query.
RUN = r"[A-Za-zÀ-ÿ]"
NOISE = 31

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(docs: DataFrame, noise: int = NOISE, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n: runs of letters in A-Z lower case, of which every noise-th by hash has lost a letter (0: none)."""
    runs = F.regexp_extract_all("text", F.lit(f"{RUN}{{{least_length},}}+"), F.lit(0))
    run = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    run = run.select("id", F.translate("run", _UPPER, _LOWER).alias("run"))
    if noise:
        h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
        at = F.pmod("h", F.length("run")).cast("int")
        cut = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
        run = run.select("run", h.alias("h")).select(F.when(F.col("h") % noise == 0, cut).otherwise(F.col("run")).alias("run"))
    return run.where(F.length("run") >= least_length).groupBy(F.col("run").alias("word")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def buckets(vocabulary: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """half (0 first, 1 last), length, key, cell, word, n: the words of each cell of each bucket."""
    size = F.length("word")

    def place(half: int, shorter: int) -> Column:
        length = size - shorter
        k = F.expr(f"cast((length(word) - {shorter}) div 2 as int)")
        key = F.substr("word", F.lit(1), k) if half == 0 else F.substr("word", size - k + 1)
        return F.struct(F.lit(half).alias("half"), length.alias("length"), key.alias("key"))

    places = F.array(*[place(half, shorter) for half in (0, 1) for shorter in (0, 1)])
    dealt = vocabulary.select("word", "n", F.explode(places).alias("at")).select("at.half", "at.length", "at.key", "word", "n")
    words = F.count(F.lit(1)).alias("words")
    need = F.ceil(F.greatest(F.col("words") / bucket, F.col("words") * F.col("length") / LETTERS)).cast("int")
    large = dealt.groupBy("half", "length", "key").agg(words).select("half", "length", "key", need.alias("parts")).where("parts > 1")
    parts = F.coalesce("parts", F.lit(1))
    own = F.pmod(F.xxhash64("word"), parts).cast("int")
    # part i meets part j in the cell of the lower and the higher number
    cells = F.transform(F.sequence(F.lit(0), parts - 1), lambda j: F.least(own, j) * parts + F.greatest(own, j))
    return dealt.join(large, ["half", "length", "key"], "left").select("half", "length", "key", F.explode(cells).alias("cell"), own.alias("part"), parts.alias("parts"), "word", "n")


def one_error(index: list[str], queries: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(query, index word) numbers of the pairs that differ by one replaced, one surplus and one missing letter of the query."""
    size = np.array([len(w) for w in index])
    lengths = np.array([len(w) for w in queries])
    longest, cells = max(int(size.max()), int(lengths.max())), -(-len(index) // 64)
    letters = np.unique(np.array(list("".join(index)), dtype="<U1")) if index else np.array([])
    number = {c: i for i, c in enumerate(letters)}
    own = np.full((len(index), longest + 3), len(letters), "int32")
    for i, w in enumerate(index):
        own[i, : len(w)] = [number[c] for c in w]
    asked = np.full((len(queries), longest + 1), len(letters) + 1, "int32")
    for i, w in enumerate(queries):
        asked[i, : len(w)] = [number.get(c, len(letters) + 1) for c in w]

    bit = np.uint64(1) << (np.arange(len(index), dtype="uint64") % np.uint64(64))
    cell = np.arange(len(index)) // 64

    def slices(at: int) -> np.ndarray:
        """Bitsets of the index words by their letter at a position; last those of words that have ended, and of a foreign letter."""
        out = np.zeros((len(letters) + 2, cells), "uint64")
        if at >= 0:
            np.bitwise_or.at(out, (own[:, at], cell), bit)
        return out

    def of_length(n: np.ndarray) -> np.ndarray:
        out = np.zeros((len(n), cells), "uint64")
        for k in np.unique(n):
            row = np.zeros(cells, "uint64")
            held = size == k
            np.bitwise_or.at(row, cell[held], bit[held])
            out[n == k] = row
        return out

    shape = (len(queries), cells)
    same, replaced, surplus, missing = np.full(shape, ~np.uint64(0)), np.zeros(shape, "uint64"), np.zeros(shape, "uint64"), np.zeros(shape, "uint64")
    wanted = [of_length(lengths), of_length(lengths - 1), of_length(lengths + 1)]
    ended = [np.zeros(shape, "uint64") for _ in wanted]
    before, here, ahead = slices(-1), slices(0), slices(1)
    for at in range(longest):
        letter = asked[:, at]
        hit = here[letter]
        # the query's letter may stand for another, be surplus, or come after one that the query lacks
        missing = (missing | same) & ahead[letter]
        surplus = (surplus & before[letter]) | same
        replaced = (replaced & hit) | (same & ~hit)
        same = same & hit
        done = lengths == at + 1
        if done.any():
            tail = missing[done] | same[done]  # the missing letter may be the last one
            for out, now, want in zip(ended, (replaced[done], surplus[done], tail), wanted, strict=True):
                out[done] = now & want[done]
        before, here, ahead = here, ahead, slices(at + 2)

    found = []
    for out in ended:
        q, c = np.nonzero(out)
        bits = np.unpackbits(out[q, c].astype("<u8").view("uint8").reshape(-1, 8), axis=1, bitorder="little")
        i, b = np.nonzero(bits)
        found.append((q[i], c[i] * 64 + b))
    return found


def _near_in_block(rows: list[tuple]) -> list[tuple]:
    """word, near words, count and word of the best, for the rows (half, length, key, cell, part, parts, word, n) of whole cells."""
    names = [r[6] for r in rows]
    bucket = {}
    home = np.array([bucket.setdefault(r[:4], len(bucket)) for r in rows])
    best: dict[int, list] = {}
    for q, i in one_error(names, names):
        together = home[q] == home[i]
        for a, b in zip(q[together].tolist(), i[together].tolist(), strict=True):
            half, length, _, cell, part, parts, word, _ = rows[a]
            near, n = rows[b][6:]
            shorter = min(len(word), len(near))
            if shorter != length:
                continue  # both are the longer ones here: they meet in their own length's bucket
            if parts > 1 and part == rows[b][4] and cell != part * parts + part:
                continue  # two words of one part meet in that part's own cell
            if half and word[: shorter // 2] == near[: shorter // 2]:
                continue  # met by the first half already
            now = best.setdefault(a, [0, 0, ""])
            now[0] += 1
            if (-n, near) < (-now[1], now[2]):
                now[1:] = n, near
    return [(rows[a][6], *now) for a, now in best.items()]


def near_words(vocabulary: DataFrame, bucket: int = BUCKET, block: int = BLOCK) -> DataFrame:
    """word, n_near, form, form_n (the near word of largest count) for words that have near words."""
    cells = buckets(vocabulary, bucket)
    dealt = cells.repartition("half", "length", "key", "cell").sortWithinPartitions("length", "half", "key", "cell")
    names = ["word", "n_near", "form_n", "form"]

    def run(batches):
        held, cell = [], []

        def out(rows):
            found = _near_in_block(rows) if len(rows) > 1 else []
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], kinds[j]) for j, i in enumerate((0, 1, 2, 3))], names=names)

        def full(held, cell):
            n = len(held) + len(cell)
            return n > block or n * (cell[0][1] + 1) > LETTERS  # cells come by length

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if cell and cell[0][:4] != row[:4]:
                    if held and full(held, cell):
                        yield out(held)
                        held = []
                    held, cell = held + cell if len(cell) > 1 else held, []
                cell.append(row)
        if held and full(held, cell):
            yield out(held)
            held = []
        yield out(held + cell)

    found = dealt.mapInArrow(run, "word string, n_near long, form_n long, form string")
    first = F.min(F.struct((-F.col("form_n")).alias("less"), "form")).alias("first")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), first).select("word", "n_near", F.col("first.form").alias("form"), (-F.col("first.less")).alias("form_n"))


def group(vocabulary: DataFrame, ratio: int = RATIO, bucket: int = BUCKET, block: int = BLOCK) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of a vocabulary (word, n)."""
    if ratio < 2:
        raise ValueError("a form must have at least twice the count, or forms could go in circles")
    held = stage(vocabulary, "vocabulary")
    near = near_words(held, bucket, block)
    all_words = held.join(near, "word", "left")
    formed = F.col("form_n") >= ratio * F.col("n")
    known = stage(all_words.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, F.col("form")).alias("form"), F.when(formed, F.col("form_n")).alias("form_n")), "forms")

    most = held.agg(F.max("n")).first()[0] or 1
    steps = max(1, math.ceil(math.log(most, ratio)))  # forms in a row at most
    root = stage(known.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots-0")
    for k in range(1, math.ceil(math.log2(steps)) + 1):
        ahead = root.select(F.col("word").alias("root"), F.col("root").alias("further"))
        last, root = root, stage(root.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root")), f"roots-{k}")
        release(last)
    return known.join(root, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
