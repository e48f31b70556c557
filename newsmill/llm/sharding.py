"""Sharding over fixed virtual slots.

Records hash into SLOTS slots by their text, so equal texts stay together. Bytes are aggregated by slot, and a stored,
versioned slot-to-shard map (a table of SLOTS rows for each version, whatever the corpus) says where a slot lies. A run
over a stored map reads its latest version, edits it where shards have been added or sizes have drifted apart, and
appends the edited map as the next version; a run that changes nothing appends nothing. Shards are added by moving slots
into them alone. Records never move between slots.

Position numbers within a shard come from counts of cells, a cell being a part of a slot of about CELL rows, dealt by
a staged number of the row: no shard, slot, hot text or run of equal rows is numbered in one task.

Defined results: a null text has the bytes of the empty one; null ids and repeated rows are kept, each with a position
of its own; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

import heapq
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsmill.llm.common import exists, fields, packed, shared_dir, stage

SLOTS = 8192
CELL = 1024
OVERHEAD = 16


def records(docs: DataFrame, slots: int = SLOTS, carry: bool = False) -> DataFrame:
    """doc_id, size, text_crc32, virtual slot and uid, a number of the row; with carry also the whole row."""
    docs = packed(docs) if carry else packed(docs.select("doc_id", "text"))
    text = F.coalesce(F.col("row.text"), F.lit(""))
    kept = ["row"] if carry else []
    return docs.select(*kept, F.monotonically_increasing_id().alias("uid"), F.col("row.doc_id").alias("doc_id"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"), F.pmod(F.xxhash64(text), F.lit(slots)).cast("int").alias("vslot"))


def initial_map(shards: int, slots: int = SLOTS) -> dict[int, int]:
    """Version 0: slots dealt in turn."""
    return {s: s % shards for s in range(slots)}


def rebalance(held: dict[int, int], size: dict[int, int], shards: int, moves: int | None = None) -> dict[int, int]:
    """The map edited until sizes are near equal: the largest slots are placed first, each in the smallest shard.

    A slot stays where it is when its shard is among those that have room, so few slots move when little has changed.
    """
    out, load = {}, [0] * shards
    fair = sum(size.values()) / shards if shards else 0
    order = sorted(held, key=lambda s: (-size.get(s, 0), s))
    heap = [(0, i) for i in range(shards)]
    for s in order:
        n, own = size.get(s, 0), held[s]
        if load[own] + n <= 0.97 * fair:
            to = own
        else:
            while heap[0][0] != load[heap[0][1]]:
                heapq.heappop(heap)
            to = heap[0][1]
        out[s] = to
        load[to] += n
        heapq.heappush(heap, (load[to], to))
    return out


def grow(held: dict[int, int], size: dict[int, int], shards: int) -> dict[int, int]:
    """The map with shard number `shards` added: slots move only into it, from the fullest shards, up to its fair share."""
    out, load = dict(held), [0] * shards
    own: dict[int, list[int]] = {i: [] for i in range(shards)}
    for s, i in held.items():
        load[i] += size.get(s, 0)
        own[i].append(s)
    for v in own.values():
        v.sort(key=lambda s: (size.get(s, 0), s))
    fair, got = sum(load) / (shards + 1), 0
    while True:
        i = max(range(shards), key=lambda j: (load[j], -j))
        if not own[i] or load[i] <= fair:
            return out
        s = own[i].pop()
        n = size.get(s, 0)
        if got + n > fair and n:
            continue
        out[s], got, load[i] = shards, got + n, load[i] - n


def balanced(held: dict[int, int], size: dict[int, int], shards: int, tolerance: float = 0.01) -> dict[int, int]:
    """The map rebalanced as long as that makes the largest shard smaller by more than a share of the mean one.

    The result stays as it is when it is balanced again with the same sizes.
    """
    most = lambda m: max(_loads(m, size, shards), default=0)
    fair = sum(size.values()) / shards
    while True:
        edited = rebalance(held, size, shards)
        if most(held) - most(edited) <= tolerance * fair:
            return held
        held = edited


def _loads(held: dict[int, int], size: dict[int, int], shards: int) -> list[int]:
    out = [0] * shards
    for s, i in held.items():
        out[i] += size.get(s, 0)
    return out


def store_map(spark, held: dict[int, int], version: int, at: str) -> None:
    """Adds a version to the map at a path, at most SLOTS rows; a version that is already there is an error."""
    spark.createDataFrame([(s, i) for s, i in held.items()], "vslot int, shard int").coalesce(1).write.mode("errorifexists").parquet(f"{at}/version={version}")


def versions(spark, at: str) -> list[int]:
    """The stored versions at a path, in order; none where nothing is stored."""
    if not exists(spark, at):
        return []
    return [r[0] for r in spark.read.parquet(at).select(F.col("version").cast("int")).distinct().orderBy("version").collect()]


def load_map(spark, at: str, version: int | None = None) -> DataFrame:
    """One version of the stored map, the latest if none is named."""
    version = versions(spark, at)[-1] if version is None else version
    return spark.read.schema("vslot int, shard int").parquet(f"{at}/version={version}")


def edited(spark, size: dict[int, int], shards: int, slots: int, at: str) -> dict[int, int]:
    """The map to use: the latest stored one, edited where shards were added or sizes drifted; a changed one is stored."""
    known = versions(spark, at)
    if known:
        held = {r.vslot: r.shard for r in load_map(spark, at, known[-1]).collect()}  # at most SLOTS rows
        if sorted(held) != list(range(slots)):
            raise ValueError(f"the map at {at} is not one of {slots} slots")
    else:
        held = initial_map(shards, slots)
        store_map(spark, held, 0, at)
        known = [0]
    had = max(held.values()) + 1
    if shards < had:
        raise ValueError(f"the map at {at} has {had} shards, more than {shards}")
    new = held
    for n in range(had, shards):
        new = grow(new, size, n)
    new = new if shards > had else balanced(new, size, shards)
    if new != held:
        store_map(spark, new, known[-1] + 1, at)
    return new


def shard(docs: DataFrame, shards: int = 40, slots: int = SLOTS, at: str | None = None, carry: bool = False) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot (the row's position in its shard, from 0) and grown_shard.

    at: where the map is stored; a map that is there already is read and edited, with none named a new one begins.
    With carry, the other columns of docs come first; those that share a name with the results are replaced.
    """
    spark = docs.sparkSession
    recs = stage(records(docs, slots, carry), "records")
    by_slot = recs.groupBy("vslot").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
    sums = {r.vslot: (r.size, r.n) for r in by_slot.collect()}  # at most SLOTS rows
    at = at or f"{shared_dir(spark)}/slot-map-{uuid.uuid4().hex}"
    held = edited(spark, {s: v[0] for s, v in sums.items()}, shards, slots, at)
    where = spark.createDataFrame([(s, held[s], -(-n // CELL)) for s, (_, n) in sums.items()], "vslot int, shard int, parts int")
    placed = recs.join(F.broadcast(where), "vslot")
    placed = placed.withColumn("cell", F.pmod(F.xxhash64("uid"), F.col("parts")).cast("int"))
    cells = placed.groupBy("shard", "vslot", "cell").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("vslot", "cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("vslot", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("vslot", "cell").orderBy("doc_id", "size", "text_crc32", "uid")
    numbered = placed.withColumn("rank", F.row_number().over(inside) - 1)
    out = numbered.join(cells, ["vslot", "cell"])
    results = ("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
    others = fields([c for c in docs.columns if c.lower() not in results]) if carry else []
    return out.select(*others, "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), (F.col("before") + F.col("rank")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
