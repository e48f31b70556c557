"""Exact n-gram Jaccard self-join by token-combination prefixes.

A document is its set of WIDTH-word shingles, a token being a shingle's 64-bit hash. Equal sets form one class first.
Two sets of n and m tokens are similar enough when they share o = ceil(percent * (n + m) / (100 + percent)) or more.

First the classes that can't link are told apart cheaply. A pool holds a set's smallest hashes, half as many again as
a prefix needs. A class with enough pool tokens that no other pool has is rich: by the prefix principle it can link
only to a class that isn't, and only through one of those tokens. Poor classes, and rich ones of which a poor class
of a near size has such a token, are open. Only their whole sets are read, and only their tokens are counted.

Open sets are ordered by frequency among the open ones, rare tokens first. If the first token that two sets share is
rare, it stands at position n - o at most in the one and m - o at most in the other: each rare token of such a prefix
is indexed by itself. Else all that they share is frequent, and the prefix is extended: with B hash buckets, the first
B + 1 shared tokens stand at n - o + B at most, and two of them lie in one bucket. So frequent tokens are indexed as
pairs (k = 2) within a bucket. A posting keeps the largest o that its position allows, its room (for a pair also: all
that a set has of frequent tokens); two postings make a candidate only where both rooms reach the pair's o. Candidates are verified on whole sets.

Short posting lists are compared pair by pair, long ones aren't expanded. Each member of a long list is compared with
the list's centre, the member with the least share of tokens of its own, which joins most of a group of near copies at
once. In further rounds each member outside a list's largest component is compared with one member of it, picked by
hash. When a round stops helping, members still outside are compared with all of their lists that lie in other
components, as far as rooms allow, so that no link between components is missed. Hot copies are pre-aggregated into
their class, and no step collects a list.

Defined results: null and empty texts have no shingles, link to nothing and are their own component; exact repeats
share a class; a null doc_id takes part in links and gets the smallest id of its component, null if there is none; an
empty table gives no rows; other columns aren't read. percent is meant to be 70 or more.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsmill.llm import wordhash
from newsmill.llm.common import fields, packed, release, stage

WIDTH = 3
PERCENT = 90
#: Tokens in more open sets than this are frequent.
FREQUENT = 8
#: Positions of a prefix for each bucket that frequent tokens are paired in.
SLACK = 8
#: Tokens in a pool beyond half as many again as a prefix needs.
EXTRA = 8
#: Lists of at most so many members are compared pair by pair: a bounded number of pairs for each row of theirs.
SHORT = 8


def need_of(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


def shingle_sets(column: pa.Array, width: int = WIDTH) -> list[np.ndarray]:
    """Each row's sorted distinct shingle hashes, as signed numbers."""
    h, first = wordhash.words(column)
    full = wordhash.grams(h, width).view(np.int64)
    short = {k: wordhash.grams(h, k).view(np.int64) for k in range(1, width)}
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        n = b - a
        out.append(np.unique(full[a : b - width + 1]) if n >= width else short[n][a : a + 1] if n else full[:0])
    return out


def _lists(arrays: list[np.ndarray], kind=pa.int64()) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, np.int64), kind))


def sketch(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, text_key, n, need, k1, k2 (names of the set) and pool, the smallest hashes in order, for every row."""
    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), "text")

    def run(batches):
        for batch in batches:
            n, need, k1, k2, pools = [], [], [], [], []
            for s in shingle_sets(batch.column(2), width):
                n.append(len(s))
                need.append(need_of(len(s), percent))
                with np.errstate(over="ignore"):
                    u = s.view(np.uint64)
                    k1.append(np.add.reduce(wordhash.mix(u)).astype(np.uint64))
                    k2.append(np.add.reduce(wordhash.mix(u ^ np.uint64(0x5851F42D4C957F2D))).astype(np.uint64))
                linked = 100 * len(s) // percent > len(s) or need[-1] > 1  # else only an equal set is similar enough
                pools.append(s[: need[-1] + need[-1] // 2 + EXTRA] if linked else s[:0])
            ints = [pa.array(x, pa.int64()) for x in (n, need)]
            keys = [pa.array(np.array(x, np.uint64).view(np.int64), pa.int64()) for x in (k1, k2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *ints, *keys, _lists(pools)], names=["doc_id", "text_key", "n", "need", "k1", "k2", "pool"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text_key long, n long, need long, k1 long, k2 long, pool array<long>")


def whole_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """id, n and tokens, the whole set, of the classes in wanted (id, doc_id, text_key); the texts are read anew."""
    texts = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), "text")
    w = wanted.select("id", F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"))
    found = texts.join(w, texts["doc_id"].eqNullSafe(F.col("_id")) & (texts["text_key"] == F.col("_key"))).select("id", "text")

    def run(batches):
        for batch in batches:
            sets = shingle_sets(batch.column(1), width)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), _lists(sets)], names=["id", "n", "tokens"])

    return found.mapInArrow(run, "id long, n long, tokens array<long>").dropDuplicates(["id"])


def components(edges: DataFrame) -> DataFrame:
    """node and root, the smallest node of its component, for the nodes of edges (a, b); large-star and small-star in turns."""
    edges = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    before, last = None, None
    while True:
        edges = stage(edges, "edges")
        release(last)
        last = edges
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("root"))).groupBy("node").agg(F.min("root").alias("root"))
        before = now
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.where("b > a").join(low, "a").select(F.col("low").alias("a"), "b").where("a < b").distinct()
        down = large.groupBy("b").agg(F.min("a").alias("low"))
        small = large.join(down, "b").select(F.col("low"), F.explode(F.array("a", "b")).alias("b"))
        edges = small.select(F.col("low").alias("a"), "b").where("a < b").distinct()


def buckets(level, percent: int):
    """Buckets at a level of sizes (2^level and up): one for each SLACK positions of a prefix, so that they extend it little."""
    return F.greatest(F.lit(1), F.floor((1 - percent / 100) * F.pow(F.lit(2.0), level) / SLACK)).cast("int")


def opened(docs: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """id, n and tokens of the classes that may link to another one.

    A rich class links only through one of its first `need` own tokens, and only to a poor one that has this token
    behind its pool. The ranges of hashes where that can be, by size, leave few tokens to compare.
    """
    held = classes.where(F.size("pool") > 0)
    own = held.select("id", F.explode("pool").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("id")).where("c = 1")  # tokens of one pool
    own = own.groupBy("id").agg(F.sort_array(F.collect_list("token")).alias("own"))  # one pool's tokens
    grade = F.floor(F.log("n") / (-1.000001 * math.log(percent / 100))).alias("grade")  # sizes that may link lie in one grade or in neighbours
    end = F.when(F.size("pool") < F.col("n"), F.element_at("pool", -1))  # null: the pool is the whole set
    ranked = held.select("id", "doc_id", "text_key", "n", "need", grade, end.alias("end")).join(own, "id", "left")
    poor = F.coalesce(F.size("own"), F.lit(0)) < F.col("need")
    ranked = stage(ranked.select("id", "doc_id", "text_key", "n", "grade", "end", poor.alias("poor"), F.when(~poor, F.slice("own", 1, F.col("need").cast("int"))).alias("own")), "ranked")
    sets = stage(whole_sets(docs, ranked.where("poor"), width), "poor-sets")

    around = F.explode(F.array(F.col("grade") - 1, F.col("grade"), F.col("grade") + 1)).alias("grade")
    first = ranked.where("poor AND end IS NOT NULL").select(around, "end").groupBy("grade").agg(F.min("end").alias("from"))
    last = ranked.where("NOT poor").select(around, F.element_at("own", -1).alias("to")).groupBy("grade").agg(F.max("to").alias("to"))
    mine = ranked.where("NOT poor").join(F.broadcast(first), "grade").select("id", "n", F.explode(F.filter("own", lambda t: t > F.col("from"))).alias("token"))  # a row for each of some hundred grades
    behind = ranked.where("poor AND end IS NOT NULL").join(F.broadcast(last), "grade").select("id", "end", "to")
    asked = sets.join(behind, "id").select("n", F.explode(F.filter("tokens", lambda t: (t > F.col("end")) & (t <= F.col("to")))).alias("token"))
    asked = asked.groupBy("token").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    near = (100 * F.col("n") >= percent * F.col("lo")) & (percent * F.col("n") <= 100 * F.col("hi"))
    rich = mine.join(asked, "token").where(near).select("id").distinct()
    more = stage(whole_sets(docs, ranked.where("NOT poor").join(rich, "id"), width), "rich-sets")
    release(ranked)
    return sets.unionByName(more)


def signatures(sets: DataFrame, percent: int, frequent: int) -> DataFrame:
    """sig, id, n, solo (tokens that no other open set has) and room: what each open set is indexed by."""
    tokens = sets.select("id", "n", F.explode("tokens").alias("token"))
    known = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    # one document's tokens, the rare ones first
    order = tokens.join(known, "token").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("t")).withColumn("solo", F.col("n") - F.size("t"))
    widest = F.col("n") - F.ceil(F.col("n") * percent / 100)  # the last position of any prefix
    levels = F.array_distinct(F.transform(F.array(F.ceil(F.col("n") * percent / 100), F.floor(F.col("n") * 100 / percent)), lambda x: F.floor(F.log2(x.cast("double"))).cast("int")))
    order = order.where(F.col("solo") <= widest).withColumns({"widest": widest, "levels": levels})
    order = order.withColumn("t", F.slice("t", 1, F.greatest(F.lit(0), F.col("widest") - F.col("solo") + 1 + buckets(F.array_max("levels"), percent)).cast("int")))
    order = order.withColumn("often", F.col("n") - F.col("solo") - F.size(F.filter("t", lambda x: x["df"] <= frequent)))  # of a set that is indexed by pairs
    at = order.select("id", "n", "solo", "widest", "levels", "often", F.posexplode("t").alias("i", "x")).select("id", "n", "solo", "widest", "levels", "often", (F.col("solo") + F.col("i")).alias("at"), "x.df", "x.token")
    at = stage(at, "prefixes")
    rare = at.where((F.col("df") <= frequent) & (F.col("at") <= F.col("widest"))).select(F.col("token").alias("sig"), "id", "n", "solo", (F.col("n") - F.col("at")).alias("room"))
    often = at.where(F.col("df") > frequent).select("id", "n", "solo", "widest", "often", "at", "token", F.explode("levels").alias("level")).withColumn("b", buckets(F.col("level"), percent))
    often = often.where(F.col("at") <= F.col("widest") + F.col("b")).groupBy("id", "n", "solo", "often", "level", "b", F.pmod(F.xxhash64("token"), "b").alias("bucket")).agg(F.sort_array(F.collect_list(F.struct("token", "at"))).alias("t"))  # a prefix's part: tens of tokens
    room = lambda x, y: F.least(F.col("often"), F.col("n") - F.greatest(x["at"], y["at"]) + F.col("b"))
    two = lambda x, y: F.struct(F.xxhash64("level", x["token"], y["token"]).alias("sig"), room(x, y).alias("room"))
    pairs = F.flatten(F.transform("t", lambda x, i: F.transform(F.slice("t", i + 2, F.size("t")), lambda y: two(x, y))))
    return rare.unionByName(often.select("id", "n", "solo", F.explode(pairs).alias("p")).select("p.sig", "id", "n", "solo", "p.room"))


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose sets are similar enough."""
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("tokens").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("tokens").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return stage(both.where(100 * common >= percent * (F.size("x") + F.size("y") - common)).select("a", "b"), "links")


def _placed(lists: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows of the lists that lie in several components, with their component and the list's largest one."""
    rows = lists.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    sizes = rows.groupBy("sig", "root").agg(F.count(F.lit(1)).alias("m"))
    mixed = sizes.groupBy("sig").agg(F.count(F.lit(1)).alias("roots"), F.max(F.struct("m", "root")).alias("top")).where("roots > 1")
    return stage(rows.join(mixed.select("sig", F.col("top.root").alias("top"), F.col("top.m").alias("m")), "sig"), "mixed")


def _new(pairs: DataFrame, tested: DataFrame | None) -> DataFrame:
    p = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    return stage(p if tested is None else p.join(tested, ["a", "b"], "left_anti"), "pairs")


def linked(sets: DataFrame, lists: DataFrame, percent: int) -> DataFrame:
    """node and root for all open sets that link to another one. lists: sig, id, n, solo, room."""
    side = lambda d, k: d.select("sig", *[F.col(c).alias(f"{k}{c}") for c in d.columns if c != "sig"])
    least = F.ceil(percent * (F.col("xn") + F.col("yn")) / (100 + percent))
    possible = (F.least("xroom", "yroom") >= least) & (F.least("xn", "yn") >= least)
    centre = F.min(F.struct((F.col("solo") / F.col("n")).alias("own"), "id", "n", "room")).alias("c")
    held = lists.groupBy("sig").agg(F.count(F.lit(1)).alias("members"), centre).where("members > 1")
    sized = stage(lists.join(held, "sig"), "lists")
    short, long = sized.where(F.col("members") <= SHORT), sized.where(F.col("members") > SHORT)
    row = ["sig", "id", "n", "room"]
    pairs = side(short.select(row), "x").join(side(short.select(row), "y"), "sig").where((F.col("xid") < F.col("yid")) & possible)
    first = side(long.select(row), "x").join(long.select("sig", F.col("c.id").alias("yid"), F.col("c.n").alias("yn"), F.col("c.room").alias("yroom")).distinct(), "sig").where((F.col("xid") != F.col("yid")) & possible)
    tested = _new(pairs.unionByName(first.select(pairs.columns)).select(F.col("xid").alias("x"), F.col("yid").alias("y")), None)
    links = verified(tested, sets, percent)
    roots = components(links)

    outside = None
    while True:
        placed = _placed(long.select(row), roots)
        out = placed.where("root != top")
        left = out.count()
        if left == 0 or outside is not None and left > 0.7 * outside:
            break
        # one partner in the largest component for each member outside it, on average
        inner = side(placed.where("root = top").select(*row, F.pmod(F.xxhash64("id", F.lit(left)), F.col("m")).alias("k")), "y")
        mates = side(out.select(*row, F.pmod(F.xxhash64("id", "sig", F.lit(left)), F.col("m")).alias("k")), "x").join(inner, "sig").where((F.col("xk") == F.col("yk")) & possible)
        more = _new(mates.select(F.col("xid").alias("x"), F.col("yid").alias("y")), tested)
        tested, links = tested.unionByName(more), links.unionByName(verified(more, sets, percent))
        release(placed)
        roots, outside = components(links), left
    if left:  # what no round has linked is compared with its whole lists
        mates = side(out.select(*row, "root"), "x").join(side(placed.select(*row, "root"), "y"), "sig").where((F.col("xroot") != F.col("yroot")) & possible)
        links = links.unionByName(verified(_new(mates.select(F.col("xid").alias("x"), F.col("yid").alias("y")), tested), sets, percent))
        roots = components(links)
    release(placed, sized)
    return roots


def join(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, text_key, n_shingles and component_id for every row of docs.

    Components only: pairs inside a component needn't all be verified, so there are no link counts.
    """
    sketches = stage(sketch(docs.select("doc_id", "text"), width, percent), "sketches")
    unique = sketches.where("n > 0").select("k1", "k2", "doc_id", "text_key", "n", "need", "pool").dropDuplicates(["k1", "k2"])
    pooled = stage(unique.withColumn("id", F.monotonically_increasing_id()), "pools")
    rows, classes = stage(sketches.select("doc_id", "text_key", "n", "k1", "k2"), "rows"), stage(pooled.select("id", "k1", "k2"), "classes")
    release(sketches)
    sets = opened(docs, pooled, width, percent)
    release(pooled)
    roots = linked(sets, signatures(sets, percent, frequent), percent)
    named = classes.select("id", "k1", "k2").join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    least = rows.where("n > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("least"))
    named = named.join(least, ["k1", "k2"])
    named = stage(named.join(named.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("k1", "k2", "component_id"), "components")
    release(classes)
    out = rows.where("n > 0").join(named, ["k1", "k2"]).select("doc_id", "text_key", "n", "component_id")
    alone = rows.where("n = 0").select("doc_id", "text_key", "n", F.col("doc_id").alias("component_id"))
    return out.unionByName(alone).withColumnRenamed("n", "n_shingles")


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """One document of each component, that of the smallest id, with the columns docs came with.

    A document without id stays only where its component has none with an id; of exact repeats one row stays.
    """
    found = join(docs.select("doc_id", "text"), **how).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    found = found.select("doc_id", "text_key").distinct()
    rows = packed(docs).withColumn("key", F.xxhash64(F.coalesce("row.text", F.lit(""))))
    rows = rows.join(found, F.col("row.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("key") == F.col("text_key")))
    return rows.dropDuplicates(["doc_id", "text_key"]).select(*fields(docs.columns))
